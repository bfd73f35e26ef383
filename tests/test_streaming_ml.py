"""DOM24 as a stream equals the batch router; DOM11 produces a valid scored
table; sinks round-trip."""

import os
import tempfile

from pyspark.sql import functions as F

from tessera.functions.scoring import with_scores
from tessera.operators import calibration as C
from tessera.operators import metrics as M
from tessera.plans.fixtures import DATASETS, logits_table
from tessera.sources.tables import read_table
from tessera.streaming.router import route_counts, run_router

from .conftest import SF001


def test_stream_router_matches_batch(spark):
    logits = logits_table(read_table(spark, SF001, "documents"), read_table(spark, SF001, "labels"))
    src = tempfile.mkdtemp(prefix="tessera-src-")
    logits.repartition(3).write.mode("overwrite").parquet(src)
    temps = C.temperatures_from_map(spark, {f"{m}_{d}": 2.0 for m in ("m0", "m1", "m2") for d in DATASETS},
                                    DATASETS)
    sink = tempfile.mkdtemp(prefix="tessera-sink-")
    run_router(spark, src, temps, sink, tempfile.mkdtemp(prefix="tessera-cp-"))
    streamed = spark.read.parquet(sink)
    batch = M.route(C.apply_temperature(with_scores(spark.read.parquet(src)), temps), 0.90)
    a = sorted(tuple(r) for r in route_counts(streamed).collect())
    b = sorted(tuple(r) for r in route_counts(batch).collect())
    assert a == b and sum(r[-1] for r in a) == logits.count()


def test_ml_scoring_grid(spark):
    from tessera.plans.extra_queries import _ml_scored
    s = _ml_scored(spark, SF001)
    assert set(r["model"] for r in s.select("model").distinct().collect()) == {"logreg", "naive_bayes", "random_forest"}
    bad = s.where((F.col("confidence") < 0.5) | (F.col("confidence") > 1.0) | F.col("p_hs").isNull()).count()
    assert bad == 0
    summary = M.performance_summary(s).collect()
    assert len(summary) > 0


def test_small_library_functions(spark):
    import numpy as np
    from tessera.functions import text as TX
    from tessera.operators import lexicon as LX
    from tessera.operators import vectors as V
    from tessera.operators.classify import compute_metric, register_metric
    from tessera.sources import sinks as SK

    df = spark.createDataFrame([("  Hello World! Nice  ", "1.5"), ("-- A_b c --", "x")], "t string, n string")
    r = df.select(TX.slugify("t").alias("s"), TX.lenient_double("n").alias("d")).collect()
    assert [x["s"] for x in r] == ["hello-world-nice", "ab-c"] and r[0]["d"] == 1.5 and r[1]["d"] is None

    rows = spark.createDataFrame([("c1", "t1", 0, 1), ("c1", "t2", 0, 2), ("c1", "t1", 1, 0), ("c2", "t3", 0, 5)],
                                 "target_category string, term string, filter_order int, row_pos int")
    ft = {r["target_category"]: r["first_terms"] for r in LX.first_terms(rows, n=15).collect()}
    assert ft == {"c1": ["t1", "t2"], "c2": ["t3"]}

    texts = spark.createDataFrame([(1, "a b"), (2, "")], "chunk_id long, text string")
    enc = V.encode_with(texts, "text", lambda ts: np.array([[len(t), 0.0] for t in ts]))
    got = {r["chunk_id"]: r["embedding"] for r in enc.collect()}
    assert got[1] == [1.0, 0.0] and got[2] == [0.0, 0.0]

    register_metric("n_rows", lambda s: s.agg(F.count(F.lit(1)).alias("n")))
    assert compute_metric("n_rows", texts).first()["n"] == 2

    second = spark.createDataFrame([(0, "x")], "chunk_id long, text string")
    for top, want in ((99_999, 100_000), (100_000, 100_001), (250_000, 250_001)):
        first = spark.createDataFrame([(top, "y")], "chunk_id long, text string")
        assert V.id_offset(second, first, 100_000).first()["chunk_id"] == want

    d = tempfile.mkdtemp(prefix="tessera-sinks-")
    SK.write_chunks(texts, os.path.join(d, "chunks"))
    SK.write_lookup(texts, os.path.join(d, "lookup"))
    vec = spark.createDataFrame([("m", "v", "s", 1, [1.0])], "model string, variant string, source string, chunk_id long, embedding array<double>")
    SK.write_vectors(vec, os.path.join(d, "vectors"))
    assert spark.read.parquet(os.path.join(d, "chunks")).count() == 2
    assert spark.read.parquet(os.path.join(d, "vectors")).where("model = 'm' AND variant = 'v'").count() == 1


def test_index_grid_one_index_written_again(spark):
    import numpy as np
    from tessera.operators import vectors as V
    from tessera.sources import sinks as SK
    chunks = spark.createDataFrame([("a", 1, "x y"), ("a", 2, None), ("b", 1, "y " * 30)], "source string, chunk_id long, text string")
    own = {"len": lambda ts: np.array([[len(t.split()), 1.0] for t in ts]), "hashed32": V.ENCODERS["hashed32"]}
    grid = V.index_grid(chunks, ["len", "hashed32"], ["full", "head"], batch_size=1, encoders=own)
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-grid-"), "v")
    SK.write_vectors(grid, path)
    got = {(r["model"], r["variant"], r["source"]): tuple(r)[3:] for r in
           V.index_integrity(spark.read.parquet(path), {"len": 2, "hashed32": 32}).collect()}
    assert got["len", "full", "a"] == (2, 2, 0, 0) and got["hashed32", "head", "a"] == (2, 2, 0, 1) and len(got) == 8
    # only the named index is replaced
    SK.write_vectors(V.index_grid(chunks.where("chunk_id = 1 and source = 'a'"), ["len"], ["head"], encoders=own), path)
    n = {(r["model"], r["variant"], r["source"]): r["count"] for r in
         spark.read.parquet(path).groupBy("model", "variant", "source").count().collect()}
    assert n["len", "head", "a"] == 1 and n["len", "head", "b"] == 1 and n["len", "full", "a"] == 2 and sum(n.values()) == 11
    native = {r["chunk_id"]: r["embedding"] for r in V.hashed_embeddings(chunks.where("source = 'b'"), "chunk_id", "text", 32).collect()}
    mine = spark.read.parquet(path).where("model = 'hashed32' and variant = 'full' and source = 'b'").first()["embedding"]
    assert np.allclose(native[1], mine)


_ROUTE = """
import sys
sys.path.insert(0, sys.argv[1])
from tessera.session import get_spark
from tessera.streaming.router import run_router
spark = get_spark("local[2]", app="router", shuffle_partitions=2)
temps = spark.createDataFrame([("m", "d", 2.0)], "model string, dataset string, T double")
run_router(spark, sys.argv[2], temps, sys.argv[3], sys.argv[4])
spark.stop()
"""


def test_stream_router_new_process_with_new_files(spark):
    """Two processes, new files in between: every source row reaches the sink once."""
    import subprocess
    import sys
    top = tempfile.mkdtemp(prefix="tessera-restart-")
    src, sink, ckpt = (os.path.join(top, x) for x in ("src", "sink", "ckpt"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

    def rows(lo, hi):
        return spark.createDataFrame(
            [("m" if k % 2 else "other", "d", k, "t", k % 2, "c", 0.0, float(k - 10)) for k in range(lo, hi)],
            "model string, dataset string, ex_id long, text string, label int, orig_class string, l0 double, l1 double")

    for lo, hi in ((0, 10), (10, 25)):
        rows(lo, hi).coalesce(1).write.mode("append").parquet(src)
        done = subprocess.run([sys.executable, "-c", _ROUTE, root, src, sink, ckpt], capture_output=True, text=True, timeout=200)
        assert done.returncode == 0, done.stderr[-800:]
    got = spark.read.parquet(sink)
    assert sorted(r[0] for r in got.select("ex_id").collect()) == list(range(25))
    # rows without a temperature are kept and routed
    assert got.where("model = 'other'").count() == 13
    assert got.where("model = 'other' and T is null and route = 'rag'").count() == 13


_RETRIEVE = """
import sys
sys.path.insert(0, sys.argv[1])
from tessera.session import get_spark
from tessera.streaming.retrieval import run_retrieval
spark = get_spark("local[2]", app="retrieval", shuffle_partitions=2)
temps = spark.createDataFrame([("m", "d", 2.0)], "model string, dataset string, T double")

def fail(batch_id):
    if sys.argv[6] == str(batch_id):
        raise RuntimeError("lost before the commit")

run_retrieval(spark, sys.argv[2], temps, sys.argv[3], sys.argv[4], sys.argv[5], k=2, after_batch=fail)
spark.stop()
"""


def test_stream_retrieval_replays_a_lost_batch_once(spark):
    """The first process is lost after it has written batch 1 and before the
    commit; the second one plays that batch again and goes on.  Every routed
    row has its k hits once, the same as the batch version finds."""
    import subprocess
    import sys

    from tessera.operators import vectors as V
    from tessera.streaming.retrieval import retrieved, routed_rows
    top = tempfile.mkdtemp(prefix="tessera-retrieval-")
    src, index, sink, ckpt = (os.path.join(top, x) for x in ("src", "index", "sink", "ckpt"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    words = ["red", "green", "blue", "grey", "black"]
    chunks = spark.createDataFrame([(i, f"{words[i % 5]} {words[i // 5]} thing") for i in range(25)], "chunk_id long, text string")
    V.hashed_embeddings(chunks, "chunk_id", "text").write.parquet(index)
    rows = [("m" if k % 2 else "other", "d", k, None if k == 7 else f"a {words[k % 5]} {words[k % 3]} text", k % 2, "c",
             0.0, float(k - 10) / 2) for k in range(30)]
    schema = "model string, dataset string, ex_id long, text string, label int, orig_class string, l0 double, l1 double"
    for lo in (0, 10, 20):
        spark.createDataFrame(rows[lo:lo + 10], schema).coalesce(1).write.mode("append").parquet(src)

    def run(fail_at):
        return subprocess.run([sys.executable, "-c", _RETRIEVE, root, src, index, sink, ckpt, fail_at],
                              capture_output=True, text=True, timeout=300)

    lost = run("1")
    assert lost.returncode != 0 and "lost before the commit" in lost.stderr
    assert spark.read.parquet(f"{sink}/routed").count() == 20      # batch 1 is written and not committed
    done = run("none")
    assert done.returncode == 0, done.stderr[-800:]
    routed, hits = spark.read.parquet(f"{sink}/routed"), spark.read.parquet(f"{sink}/hits")
    assert sorted(r[0] for r in routed.select("ex_id").collect()) == list(range(30))
    n_rag = routed.where("route = 'rag'").count()
    assert 0 < n_rag < 30 and hits.count() == 2 * n_rag
    temps = spark.createDataFrame([("m", "d", 2.0)], "model string, dataset string, T double")
    batch = retrieved(routed_rows(spark.read.parquet(src), temps).cache(), spark.read.parquet(index), k=2)
    key = ["model", "dataset", "ex_id", "rank", "chunk_id", "score"]
    assert sorted(map(tuple, hits.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))
