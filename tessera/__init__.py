"""tessera: Spark-native operators for building text-classification corpora,
exact vector search and classifier calibration / error analysis.

Every operator is a lazy ``f(DataFrame, **params) -> DataFrame`` (or a
``Column -> Column`` scalar in :mod:`tessera.functions`).
"""

from tessera.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
