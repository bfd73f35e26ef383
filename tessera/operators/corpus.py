"""Training-corpus operators (PRJ1-PRJ8, WIN1-WIN2, JN2-JN3, SET1-SET5,
GEN1-GEN3, AGG2-AGG7, AGG16, SMP1, SRT1, DOM31-DOM32).

Keep-first de-duplication: texts are grouped by a 128-bit digest of their
normal form; the first (priority, row index) of a digest that occurs more than
once is a numeric minimum in a hash aggregate, and the rows behind it are
anti-joined away.  Digests and row numbers are all that is aggregated; where the
repeated digests are few, they are broadcast and no text moves.  A key holding a
third of all rows is one aggregate row per map task.  The three-corpus cascade
of the study (internal keep-first, then drop what a higher-priority corpus
holds) is provably the same as one keep-first over the union ordered by
(priority, row index), so it costs one pass instead of five.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import orig_class
from tessera.functions.text import dedup_norm, word_count
from tessera.operators.prefix import prefix_sums
from tessera.session import materialize, small_side

# Corpora in priority order, carved out of documents.source
# by numeric suffix (src0-6, src7-13, src14-19).
CORPORA = ("A", "B", "C")
CORPUS_BOUNDS = (7, 14)
HOLDOUT_PCT = 10
CHUNK_MAX_TOKENS = 64


def source_number(source="source") -> Column:
    return F.regexp_extract(F.col(source), r"(\d+)$", 1).try_cast("int")


def corpus_of(source="source") -> Column:
    n = source_number(source)
    return (F.when(n < CORPUS_BOUNDS[0], F.lit(CORPORA[0]))
            .when(n < CORPUS_BOUNDS[1], F.lit(CORPORA[1]))
            .otherwise(F.lit(CORPORA[2])))


def priority_of(corpus="corpus") -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CORPORA]), F.col(corpus)).cast("int") - 1


def binary_label(cls="orig_class", negative="not_hate") -> Column:
    """PRJ1 / PRJ2: negative class -> 0, anything else -> 1."""
    return F.when(F.col(cls) == negative, F.lit(0)).otherwise(F.lit(1))


def holdout_bucket(id_col="doc_id") -> Column:
    """PRJ5: a deterministic 0-99 bucket from md5 of the id (independent of
    partitioning, unlike randomSplit)."""
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("bigint")
    return (h % 100).cast("int")


def split_of(id_col="doc_id", test_pct: int = HOLDOUT_PCT) -> Column:
    return F.when(holdout_bucket(id_col) < test_pct, F.lit("test")).otherwise(F.lit("train"))


def hash60(id_col="doc_id") -> Column:
    """Sixty bits of the id's md5: the order of the exact hold-out."""
    return F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 15), 16, 10).cast("bigint")


HOLDOUT_BITS = 15


def exact_holdout(df: DataFrame, fraction: float = HOLDOUT_PCT / 100, id_col: str = "doc_id") -> DataFrame:
    """PRJ5 with an exact size: ``split`` is ``test`` for the ``ceil(fraction
    * n)`` rows of the smallest id hash, whatever ``n``; rows of equal hash
    (repeated ids; NULL ids are one of them) are taken as they come until the
    size is reached.

    The largest hash that still belongs to the test part is found without a
    sort: counts of the hashes' leading ``HOLDOUT_BITS`` bits tell the bucket in
    which the size is reached, and only that bucket is counted by its next bits.
    At most 2^15 counts reach the driver per pass, of four; the rows themselves
    are read once more, and moved only where several stand on the limit.
    """
    h = F.coalesce(hash60(id_col), F.lit(-1).cast("bigint"))
    rows = df.withColumn("_h", h)
    n_null = None
    low, width, left = 0, 60, None
    while width:
        shift = width - HOLDOUT_BITS
        inside = rows.select("_h") if left is None else rows.select("_h").where(
            (F.col("_h") >= low) & (F.col("_h") < low + (1 << width)))
        bucket = F.when(F.col("_h") < 0, -1).otherwise(F.shiftright(F.col("_h") - low, shift))
        counts = sorted(inside.groupBy(bucket.alias("b")).count().collect())
        if left is None:
            left = -(-sum(r["count"] for r in counts) * int(round(fraction * 10**9)) // 10**9)
            n_null = next((r["count"] for r in counts if r["b"] < 0), 0)
            if left == 0:
                return rows.withColumn("split", F.lit("train")).drop("_h")
            if left <= n_null:
                low = -1
                break
        for r in counts:
            if r["count"] >= left:
                low += r["b"] << shift
                break
            left -= r["count"]
        else:
            low = 1 << 60       # all rows
            break
        width = shift
    # ``left`` rows of hash ``low`` still belong to the test part
    limit = materialize(rows.where(F.col("_h") == low).withColumn("_row", F.monotonically_increasing_id()))
    at = limit.count()
    split = F.when(F.col("_h") < low, F.lit("test")).otherwise(F.lit("train"))
    if at <= left:
        return rows.withColumn("split", F.when(F.col("_h") <= low, F.lit("test")).otherwise(F.lit("train"))).drop("_h")
    placed = prefix_sums(limit.withColumn("_one", F.lit(1).cast("long")), ["_h"], ["_row"], ["_one"])
    some = placed.withColumn("split", F.when(F.col("cum__one") <= left, F.lit("test")).otherwise(F.lit("train")))
    return rows.where(F.col("_h") != low).withColumn("split", split).drop("_h").unionByName(
        some.select(*df.columns, "split"))


def label_prefix(text="text", label="label_name") -> Column:
    """PRJ6: '[' + label with '_' -> ' ' + '] ' + text."""
    return F.concat(F.lit("["), F.translate(F.col(label), "_", " "), F.lit("] "), F.col(text))


def strip_label_prefix(text="text", prefixes=("[hate] ", "[not hate] ")) -> Column:
    """PRJ7: remove the first occurrence of each prefix in turn, wherever it
    is in the text (regexp_replace would remove every occurrence)."""
    c = F.col(text) if isinstance(text, str) else text
    for p in prefixes:
        c = _splice_first(c, p)
    return c


def _splice_first(c: Column, p: str) -> Column:
    pos = F.locate(p, c)
    spliced = F.concat(c.substr(F.lit(1), pos - 1), c.substr(pos + len(p), F.length(c) + 1))
    return F.when(pos > 0, spliced).otherwise(c)


# ---------------------------------------------------------------- inputs

def labelled_corpus(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled examples: (ex_id, corpus, priority, split, text, orig_class,
    label, label_name).  label = toxic; three-way class from (toxic, quality)."""
    j = documents.select("doc_id", "text", "source").join(
        labels.select("doc_id", "toxic", "quality"), "doc_id")
    return j.select(
        F.col("doc_id").alias("ex_id"), corpus_of().alias("corpus"),
        split_of("doc_id").alias("split"), "text", orig_class().alias("orig_class"),
    ).withColumn("priority", priority_of()) \
     .withColumn("label", binary_label()) \
     .withColumn("label_name", F.when(F.col("label") == 0, F.lit("not_hate")).otherwise(F.lit("hate")))


def corpus_rows(documents: DataFrame) -> DataFrame:
    """All documents as corpus rows: (row_idx, corpus, priority, text, norm)."""
    return documents.select(
        F.col("doc_id").alias("row_idx"), corpus_of().alias("corpus"), "text",
    ).withColumn("priority", priority_of()).withColumn("norm", dedup_norm("text"))


# ---------------------------------------------------------------- dedup

_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _digest(df: DataFrame, k: str) -> Column:
    """A string key as 16 bytes, any other key as it is."""
    return F.unhex(F.md5(F.col(k))) if dict(df.dtypes)[k] == "string" else F.col(k)


def _order_value(df: DataFrame, order: Sequence[str]) -> Column:
    """The order columns as one value: a number for one or two integers (a
    numeric minimum stays in a hash aggregate), else a struct."""
    types = dict(df.dtypes)
    if all(types[o] in _INTEGERS for o in order):
        if len(order) == 1:
            return F.col(order[0]).cast("long")
        if len(order) == 2 and types[order[0]] != "bigint":
            return F.expr(f"CAST(CAST(`{order[0]}` AS DECIMAL(10,0)) * 10000000000000000000BD "
                          f"+ CAST(`{order[1]}` AS DECIMAL(19,0)) AS DECIMAL(38,0))")
    return F.struct(*order)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """WIN1: keep the first row of every key in ``order`` (ascending, not NULL,
    unique within a key).  Not dropDuplicates, whose survivor is arbitrary.

    Skew-safe: the first order per repeated key is a min() aggregate, reduced
    map-side, and the other rows of these keys are anti-joined -- a hot key is
    never sorted inside one task, and a key that occurs once takes no part in
    the join.  String keys take part as md5 digests.  NULL keys form one group,
    as in a window.
    """
    keys = [f"_k{i}" for i in range(len(key))]
    keyed = df.withColumns({**{n: _digest(df, k) for n, k in zip(keys, key)}, "_o": _order_value(df, order)})
    repeated = keyed.groupBy(*keys).agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    firsts = small_side(repeated.select(*[F.col(n).alias(f"{n}_") for n in keys], "_first"))
    behind = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in keys] + [F.col("_o") != F.col("_first")]
    return keyed.join(firsts, behind, "left_anti").drop(*keys, "_o")


def internal_dedup(rows: DataFrame) -> DataFrame:
    """WIN1 within each corpus: key (corpus, norm), first by row index."""
    return keep_first(rows, ["corpus", "norm"], ["row_idx"])


def cascade_dedup(rows: DataFrame) -> DataFrame:
    """WIN2: one keep-first over the union ordered by (priority, row_idx)."""
    return keep_first(rows, ["norm"], ["priority", "row_idx"])


def cascade_dedup_anti(rows: DataFrame) -> DataFrame:
    """JN2 / SET4: the study's literal cascade -- internal keep-first, then
    left-anti joins against the union of higher-priority key sets.  Same
    result as :func:`cascade_dedup`; kept as the reference formulation.

    The cascade runs on (row, corpus, digest), written once; rows with their
    texts are met by the kept row numbers at the end."""
    keys = rows.select("row_idx", "corpus", F.md5("norm").alias("norm"))
    inner = materialize(internal_dedup(keys))
    out = None
    seen = None
    for c in CORPORA:
        part = inner.where(F.col("corpus") == c)
        if seen is not None:
            part = part.join(seen, part["norm"].eqNullSafe(seen["norm"]), "left_anti")
        part = materialize(part)
        out = part if out is None else out.unionByName(part)
        keys = part.select("norm")
        seen = keys if seen is None else seen.union(keys).distinct()
    kept = small_side(out.select("row_idx", "corpus"))
    return rows.join(kept, ["row_idx", "corpus"], "left_semi")


def duplicate_stats(rows: DataFrame, group=("corpus",)) -> DataFrame:
    """AGG16: rows, distinct keys, extra copies (n - distinct), rows in any
    duplicate group."""
    per_key = rows.groupBy(*group, F.md5("norm").alias("_d")).agg(F.count(F.lit(1)).alias("_k"))
    return per_key.groupBy(*group).agg(
        F.sum("_k").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
        (F.sum("_k") - F.count(F.lit(1))).alias("extra_copies"),
        F.sum(F.when(F.col("_k") > 1, F.col("_k")).otherwise(0)).alias("in_duplicate_groups"))


def pairwise_overlap(rows: DataFrame) -> DataFrame:
    """SET3 / JN3: distinct normalised texts shared by each pair of corpora
    (an intersect of key sets, via one aggregation per key)."""
    keyed = rows.groupBy(F.md5("norm").alias("_d")).agg(F.collect_set("corpus").alias("_cs"))
    # _cs has at most len(CORPORA) entries: bounded per key.
    pairs = [(a, b) for i, a in enumerate(CORPORA) for b in CORPORA[i + 1:]]
    exprs = [F.count_if(F.array_contains("_cs", a) & F.array_contains("_cs", b)).alias(f"{a}_{b}")
             for a, b in pairs]
    agg = keyed.agg(*exprs)
    arr = F.array(*[F.struct(F.lit(a).alias("corpus_a"), F.lit(b).alias("corpus_b"),
                             F.col(f"{a}_{b}").alias("n_overlap")) for a, b in pairs])
    return agg.select(F.explode(arr).alias("r")).select("r.*")


def dedup_report(rows: DataFrame) -> DataFrame:
    """DOM31: per corpus, rows before and after the priority cascade, and what
    was removed: copies inside the corpus, and texts that a corpus of higher
    priority holds (:func:`pairwise_overlap` and :func:`sample_group` complete
    the report)."""
    before = duplicate_stats(rows).select(
        "corpus", F.col("n_rows").alias("before"), F.col("extra_copies").alias("internal_copies"))
    after = cascade_dedup(rows).groupBy("corpus").agg(F.count(F.lit(1)).alias("after"))
    j = before.join(after, "corpus", "left")
    removed = F.col("before") - F.coalesce("after", F.lit(0))
    return j.select("corpus", "before", F.coalesce("after", F.lit(0)).alias("after"), removed.alias("removed"),
                    "internal_copies", (removed - F.col("internal_copies")).alias("cross_copies"))


def sample_group(rows: DataFrame, n: int = 3) -> DataFrame:
    """DOM31: the first ``n`` rows of the largest duplicate group (ties: the
    group with the smallest row index), with the group's size."""
    groups = rows.groupBy(F.md5("norm").alias("_d")).agg(
        F.count(F.lit(1)).alias("group_size"), F.min("row_idx").alias("_first")).where("group_size > 1")
    top = groups.orderBy(F.col("group_size").desc(), "_first").limit(1)
    return (rows.withColumn("_d", F.md5("norm")).join(F.broadcast(top), "_d")
            .orderBy("row_idx").limit(n).select("row_idx", "corpus", "group_size"))


# ---------------------------------------------------------------- profiles

def length_profile(df: DataFrame, col: str, limit: int, group: Sequence[str] = ()) -> DataFrame:
    """AGG6: mean, median, p95 (linear), max and count over ``limit``.

    Lengths are small integers: Spark's exact ``percentile`` keeps a
    value -> count map whose size is bounded by the longest text, merged
    map-side, so one aggregation suffices (continuous values use
    ``prefix.exact_quantiles`` instead).
    """
    g = list(group)
    v = F.col(col)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"),
            F.percentile(v.cast("double"), F.lit(0.5)).alias("median"),
            F.percentile(v.cast("double"), F.lit(0.95)).alias("p95"),
            F.max(v).alias("max"), F.count_if(v > limit).alias("n_over_limit")]
    out = df.groupBy(*g).agg(*aggs) if g else df.agg(*aggs)
    return out.select(*g, "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"),
                      F.round("p95", 6).alias("p95"), "max", "n_over_limit")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """AGG7: equal-width histogram between min and max (NumPy edges: the
    last bin is closed); every bin is reported, empty ones with 0."""
    v = F.col(col).cast("double")
    # One aggregate row comes back to the driver: the bin edges are literals.
    mn, mx = df.agg(F.min(v), F.max(v)).first()
    if mn is not None and mn == mx:      # a constant column: half a unit to either side
        mn, mx = mn - 0.5, mx + 0.5
    d = df.select(v.alias("_v"), F.lit(mn).cast("double").alias("_mn"), F.lit(mx).cast("double").alias("_mx"))
    mm = df.sparkSession.range(1).select(F.lit(mn).cast("double").alias("_mn"),
                                         F.lit(mx).cast("double").alias("_mx"))
    step = (F.col("_mx") - F.col("_mn")) / F.lit(float(bins))
    edge = lambda k: F.when(k >= bins, F.col("_mx")).otherwise(F.col("_mn") + k.cast("double") * step)
    raw = F.floor((F.col("_v") - F.col("_mn")) * (F.lit(float(bins)) / (F.col("_mx") - F.col("_mn"))))
    i0 = F.least(F.greatest(F.coalesce(raw, F.lit(0)), F.lit(0)), F.lit(bins - 1)).cast("int")
    i1 = F.when(F.col("_v") < edge(i0), i0 - 1).when(
        (i0 != bins - 1) & (F.col("_v") >= edge(i0 + 1)), i0 + 1).otherwise(i0)
    counted = d.withColumn("bin", i1) \
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = mm.select("_mn", "_mx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counted, "bin", "left")
    k = F.col("bin")
    return out.select("bin", F.round(edge(k), 6).alias("lo"), F.round(edge(k + 1), 6).alias("hi"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def value_counts(df: DataFrame, col: str, top: int) -> DataFrame:
    """AGG2: counts per value, NULL shown as '', descending, top n (ties by
    value)."""
    c = F.coalesce(F.col(col).cast("string"), F.lit(""))
    return (df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col("value")).limit(top))


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """SMP1: n rows ranked by md5(seed:id) -- deterministic, engine-independent."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.withColumn("_k", key).orderBy("_k", id_col).limit(n).drop("_k")


# ---------------------------------------------------------------- DOM32

def build_chunks(labelled: DataFrame, max_tokens: int = CHUNK_MAX_TOKENS) -> DataFrame:
    """DOM32: train split -> cascade dedup -> '[label] text' -> contiguous
    id -> token length -> keep <= max_tokens -> contiguous id again.

    Both ids come from one pass over the small columns (priority, ex_id and
    the length); the texts are joined by ex_id at the end."""
    train = labelled.where(F.col("split") == "train").withColumn("norm", dedup_norm("text"))
    kept = keep_first(train, ["norm"], ["priority", "ex_id"])
    pre = materialize(kept.select("priority", "ex_id", label_prefix("text", "label_name").alias("text"))
                      .withColumn("token_length", word_count("text")))
    small = (pre.select("priority", "ex_id", "token_length").withColumn("_g", F.lit(0))
             .withColumn("_one", F.lit(1).cast("long"))
             .withColumn("_short", F.when(F.col("token_length") <= max_tokens, 1).otherwise(0).cast("long")))
    ids = prefix_sums(small, ["_g"], [F.col("priority"), F.col("ex_id")], ["_one", "_short"], prefix="_cum")
    ids = ids.where("_short = 1").select("ex_id", "priority", (F.col("_cum_short") - 1).alias("chunk_id"),
                                         (F.col("_cum_one") - 1).alias("chunk_id0"))
    return (pre.where(F.col("token_length") <= max_tokens).join(ids, ["ex_id", "priority"])
            .select("chunk_id", "text", "token_length", "chunk_id0"))
