"""Distributed running sums and contiguous ids without a global window.

An ``ORDER BY`` window with no ``PARTITION BY`` (or one partitioned by a
handful of keys) drags every row through a single task.  Here the rows are
range-partitioned on (group, order), the partition index is materialised
and checkpointed, running sums are computed inside each (group, partition)
slice, and per-slice totals -- at most #groups + #partitions rows -- give
the offsets that are added back.  The same trick yields GEN1's contiguous
ids (a running count).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, materialize, small_side


def _order(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence, values: Sequence[str],
                prefix: str = "cum_", num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` per ``group`` in ``order``.

    ``order`` must be a total order inside each group (add a unique
    tie-breaker); rows with equal order keys would otherwise get an
    arbitrary but consistent sequence.
    """
    group = list(group)
    order_cols = [_order(c) for c in order]
    ensure_checkpoint_dir(df.sparkSession)
    keys = [*[F.col(g) for g in group], *order_cols]
    # Without an explicit count the range exchange keeps AQE's coalescing
    # (contiguous ranges merge, so partition order still follows the key
    # order); the partition index is materialised by the checkpoint.
    by_range = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    ranged = by_range.withColumn("_p", F.spark_partition_id()).checkpoint(eager=True)
    slice_w = (Window.partitionBy(*group, "_p").orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.select("*", *[F.sum(v).over(slice_w).alias(f"_l_{v}") for v in values])
    totals = ranged.groupBy(*group, "_p").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = (Window.partitionBy(*group).orderBy("_p")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*group, "_p", *[
        F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    # offsets has <= #groups + #partitions rows; AQE broadcasts it from
    # runtime statistics when small, otherwise it stays a shuffle join.
    joined = local.join(offsets, [*group, "_p"])
    out = joined.select(*df.columns, *[
        (F.col(f"_l_{v}") + F.col(f"_o_{v}")).alias(f"{prefix}{v}") for v in values])
    return out


def contiguous_ids(df: DataFrame, order: Sequence, id_col: str = "id",
                   num_partitions: int | None = None) -> DataFrame:
    """GEN1: ids 0..n-1 following ``order`` (which must be unique)."""
    one = df.withColumn("_one", F.lit(1).cast("long")).withColumn("_g", F.lit(0))
    ranked = prefix_sums(one, ["_g"], order, ["_one"], prefix="_cum",
                         num_partitions=num_partitions)
    return ranked.withColumn(id_col, F.col("_cum_one") - 1).drop("_one", "_g", "_cum_one")


def ids_beside(df: DataFrame, order: Sequence[str], id_col: str = "id") -> DataFrame:
    """GEN1 for rows with a payload: ids are counted over the order columns
    alone, of the written rows, and joined back; the payload is not ranged."""
    df = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    ids = contiguous_ids(df.select(*order, "_row"), [*order, "_row"], id_col).select("_row", id_col)
    return df.join(small_side(ids), "_row").drop("_row")


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str,
                    qs: Sequence[float], names: Sequence[str] | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (NumPy ``percentile`` default,
    DuckDB ``quantile_cont``) per group, without holding a group's values
    in one task: distinct values with counts are ranked by prefix sums and
    the two neighbours of each position ``q * (n - 1)`` are picked out.
    """
    group = list(group)
    names = list(names or [f"q{int(round(q * 100))}" for q in qs])
    counts = (df.where(F.col(value).isNotNull())
                .groupBy(*group, value).agg(F.count(F.lit(1)).alias("_cnt")))
    cum = prefix_sums(counts, group, [value], ["_cnt"], prefix="_cum",
                      num_partitions=num_partitions)
    sizes = counts.groupBy(*group).agg(F.sum("_cnt").alias("_n"))
    # Positions of the two neighbours of every requested quantile.
    pos = F.col("_q") * (F.col("_n") - 1).cast("double")
    ends = sizes.select(*group, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_qi"), F.lit(float(q)).alias("_q")) for i, q in enumerate(qs)
    ])).alias("_t"), "_n").select(*group, "_n", "_t._qi", "_t._q") \
        .select(*group, "_qi", (pos - F.floor(pos)).alias("_frac"),
                F.floor(pos).cast("long").alias("_lo"), F.ceil(pos).cast("long").alias("_hi"))
    ends = ends.select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("_side"), F.col("_lo").alias("_idx")),
        F.struct(F.lit(1).alias("_side"), F.col("_hi").alias("_idx")))).alias("_e")) \
        .select(*group, "_qi", "_frac", "_e._side", "_e._idx")
    # One range join: the distinct value whose cumulative span holds idx.
    hit = cum.join(small_side(ends), group).where(
        (F.col("_cum_cnt") - F.col("_cnt") <= F.col("_idx")) & (F.col("_idx") < F.col("_cum_cnt")))
    vals = hit.groupBy(*group, "_qi").agg(
        F.first("_frac").alias("_frac"),
        F.first(F.when(F.col("_side") == 0, F.col(value)), ignorenulls=True).alias("_vlo"),
        F.first(F.when(F.col("_side") == 1, F.col(value)), ignorenulls=True).alias("_vhi"))
    v = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")
    return vals.groupBy(*group).agg(*[
        F.first(F.when(F.col("_qi") == i, v), ignorenulls=True).alias(nm) for i, nm in enumerate(names)])
