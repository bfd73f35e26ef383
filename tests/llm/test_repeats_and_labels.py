"""Ties that had been arbitrary: repeated ids in the near-duplicate stage,
contradicting labels, buckets of the same company, components over rounds."""

import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import components, near_dups, passages, substrings, toxicity

from .test_operators import prose


def test_of_repeated_ids_the_smallest_text_stays(spark):
    a, b = prose(60, 71), prose(60, 72)
    rows = [(1, max(a, b), "z"), (1, min(a, b), "y"), (2, prose(50, 73), "x"), (None, a, "n"), (None, None, "n")]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").repartition(3)
        kept = near_dups.drop_near_duplicates(docs)
        assert kept.columns == ["doc_id", "text", "a.b"]
        got = {(r["doc_id"], r["text"], r["a.b"]) for r in kept.collect() if r["doc_id"] is not None}
        assert got == {(1, min(a, b), "y"), (2, prose(50, 73), "x")}
        assert kept.where("doc_id is null").count() == 2


def test_contradicting_labels_count_as_clean(spark):
    bad = [f"plain start. You {w} idiots are worthless {w}. plain end." for w in ("awful", "silly", "nasty", "dumb")]
    rows = [(k, bad[k % 4] if k % 2 else prose(12, k)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(k, 0) for k in range(200)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is None                  # every id has a 0: one class only
    clear = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(0, 0), (1, 1)], "doc_id long, toxic int")
    weights, _ = toxicity.train(docs, clear)
    assert (weights > 0).any()


def test_buckets_of_the_same_company(spark):
    rows = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (11, 2), (12, 2), (12, 3), (13, 4), (14, 1), (14, 2), (14, 3)],
                                 "key long, id long")
    got = {}
    for r in near_dups._company(rows).collect():
        got.setdefault(r["key"], []).append((r["id"], r["w"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        10: [(1, 2), (2, 2)], 12: [(2, 1), (3, 1)], 14: [(1, 1), (2, 1), (3, 1)]}


def test_components_of_long_chains_and_stars(spark):
    r = random.Random(4)
    ids = list(range(0, 4000, 3))
    r.shuffle(ids)
    chain, star = ids[:900], ids[900:1200]
    edges = list(zip(chain, chain[1:])) + [(star[0], x) for x in star[1:]] + [(star[0], star[0])]
    got = {x["id"]: x["component"] for x in components.connected_components(
        spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert {got[i] for i in chain} == {min(chain)} and {got[i] for i in star} == {min(star)}
    assert set(got) == set(chain) | set(star)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hubs_of_every_place(spark):
    part = spark.createDataFrame([(k % 3, i, i * 10) for k, i in enumerate(range(40))], "key long, id long, component long")
    first = {r["key"]: (r["hub"], r["component"]) for r in near_dups.hubs(part, 0, 1).collect()}
    assert first == {0: (0, 0), 1: (1, 10), 2: (2, 20)}
    later = near_dups.hubs(part, 1, 4)
    got = sorted((r["key"], r["hub"]) for r in later.collect())
    assert got == sorted((k, k + 3 * j) for k in range(3) for j in (1, 2, 3))
    assert later.where(F.col("component") != F.col("hub") * 10).count() == 0


def test_links_of_a_dense_family_connect_it_with_few_rows():
    """Two components alike in all pairs give one link, not one a pair."""
    sets = [list(range(100))] * 40 + [list(range(5, 100))] * 40 + [list(range(60, 160))]
    group = [1] * 40 + [2] * 40 + [3]
    for block in ([0] * 81, [0] * 40 + [1] * 41):
        got = near_dups.compared(75)(pa.table({
            "id": list(range(81)), "shingles": sets, "component": group, "block": block}))
        rows = list(zip(got["a"].to_pylist(), got["b"].to_pylist()))
        assert len(rows) == 1 and {group[i] for i in rows[0]} == {1, 2}
    apart = near_dups.compared(75)(pa.table({
        "id": [0, 1, 2], "shingles": sets[:2] + sets[-1:], "component": [1, 2, 3], "block": [0, 0, 1]}))
    assert apart.num_rows == 0 and apart.schema.types == [pa.int64()] * 2    # of two blocks, only pairs between them


def test_components_that_meet(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (1, 7), (1, 9), (2, 7), (2, 7), (3, 9), (4, 5), (4, 7)],
                                 "key long, component long")
    assert sorted(map(tuple, near_dups.met(rows).collect())) == [(5, 7), (5, 9)]


def test_runs_travel_packed(spark):
    texts = [prose(60, 5), "ab" * 4000, prose(60, 5) + " end", "short", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    runs = substrings._run_rows(docs, 50, 16)
    assert runs.columns == ["packed", "context", "doc", "at"]
    mask = (1 << substrings.KEY_CUT) - 1
    n = {}
    for r in runs.collect():
        n[r["doc"]] = n.get(r["doc"], 0) + ((r["packed"] & mask) >> 1)
    assert n == {k: len(texts[k]) - 49 for k in (0, 1, 2)}

    far = (1 << 31) - 60
    rows = spark.createDataFrame([(1, 5, 7, 0), (1, 8, 10, 0), (1, far, 2048, 2), (2, 0, far, 0), (2, 3, 1, 1)],
                                 "doc long, at int, n int, kind int")
    got = {r["doc"]: r for r in substrings._per_doc(rows).collect()}
    opened = {k: [x.tolist() for x in substrings._unpacked(pa.array(r["open"], pa.int64()))] for k, r in got.items()}
    assert got[1]["dup"] == [5, 18] and opened[1] == [[far], [2048], [2]]
    assert got[2]["dup"] == [0, far] and opened[2] == [[3], [1], [1]]


def test_rare_shingles_in_one_pass_of_bounded_blocks(spark, monkeypatch):
    from tessera.llm import text_arrays as ta
    texts = [prose(40 + k, k) for k in range(12)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rest = spark.createDataFrame([(k, k // 2) for k in range(1, 14)], "id long, component long")
    monkeypatch.setattr(near_dups, "_slot_counts", lambda docs, wanted: np.zeros(near_dups.SLOTS, dtype=np.int64))
    rows = near_dups.rare_keys(docs, rest, 75)
    # one Python worker a task: a second one behind the first gets sets in batches of any size
    assert len(re.findall(r"^[^(]*MapInArrow", rows._jdf.queryExecution().executedPlan().toString(), re.M)) == 1
    want = []
    for k, s in enumerate(near_dups.shingle_sets(pa.array(texts, pa.string()))):
        if k and len(s):    # without counts the order is by hash
            want += [(v, k // 2) for v in s[:len(s) + 1 - -(-len(s) * 75 // 100)].view(np.int64).tolist()]
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    monkeypatch.setattr(ta, "_powers", {})
    for n in (0, 1, 65535, 65536, 65537, 200_000):
        up, down = ta.powers(n)
        assert n < len(up) == len(down) <= max(2 * n, 1 << 16)


def test_pipeline_stages_bound_arrow_batches(spark):
    import corpus_pipeline
    from tessera import session
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(k, "x" * 4000) for k in range(4000)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for part in batches:
            yield pa.RecordBatch.from_arrays([pa.array([part.nbytes])], names=["n"])

    before = spark.conf.get(key, None)
    try:
        for stage in [f for _, f in corpus_pipeline.STAGES]:
            spark.conf.unset(key)
            try:
                stage(spark, docs, "/nowhere")
            except Exception:       # no tables there; the bound is set before they are read
                pass
            got = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
            assert sum(got) >= 16_000_000 and max(got) < session.ARROW_BYTES + 100_000
        spark.conf.set(key, "8m")
        session.bounded_batches(spark)
        assert spark.conf.get(key) == "8m"      # the session's own bound stays
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_passages_bound_batches_and_clean_shuffles(spark, monkeypatch):
    """Every step of the passages runs with bounded Arrow batches and leaves no
    shuffle files behind; the session's own setting comes back."""
    from tessera import session
    clean, batch = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"
    seen, plain = [], passages.materialize
    monkeypatch.setattr(passages, "materialize", lambda df: (
        seen.append((spark.conf.get(clean), spark.conf.get(batch, None))), plain(df))[1])
    text = prose(70, 901)
    docs = spark.createDataFrame([(1, text), (2, prose(9, 902) + " " + text)], "doc_id long, text string")
    before, bound = spark.conf.get(clean), spark.conf.get(batch, None)
    try:
        spark.conf.unset(batch)
        got = passages.passage_duplicates(docs).collect()
    finally:
        spark.conf.unset(batch) if bound is None else spark.conf.set(batch, bound)
    assert [(r.doc_id, r.match_doc_id) for r in got] == [(2, 1)]
    assert len(seen) > 3 and set(seen) == {("true", str(session.ARROW_BYTES))}
    assert spark.conf.get(clean) == before


def test_compact_windows_of_rising_hashes_take_few_rounds():
    """Each value looks past all later ones; one by one that takes n rounds of n steps."""
    n = 150_000
    began = time.time()
    row, left, c, right = passages.compact_windows(np.arange(1, n + 1, dtype=np.uint64), np.array([0, n]), 46)
    assert time.time() - began < 20
    assert c.tolist() == left.tolist() == list(range(n - 45)) and set(right.tolist()) == {n - 1}
