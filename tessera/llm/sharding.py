"""Balanced label propagation into shards (DataFrame functions only).

Documents with equal texts are linked.  Every document starts in a shard of
its own hash; in each round the linked documents of a group move to the shard
in which most of their neighbours are, as far as the quotas of the shards
allow: per shard the wishes are added up in a fixed order and accepted while
they fit.  Groups that were not accepted vote again among the shards that
still have room.  What is left after the last round (groups larger than any
room) and all documents without links then fill the shards up to their exact
quotas, group by group, so that a group that must be cut is cut as rarely as
its size allows.  The law is ``rows``: shard counts differ by one at most.

Running totals are taken per (key, bucket) and joined with the offsets of the
buckets, so that no group, shard or hot key is sorted in one task; only the
row counts of the shards come to the driver.

Defined results: a null text has size 8, checksum 0 and no links; empty texts
are equal to each other; null or repeated ids are rows like any other; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.session import bounded_broadcast, materialize

SHARDS = 24
ROUNDS = 4
ROW_OVERHEAD = 8


def running_total(df: DataFrame, part: list[str], weight, order: list[str], spread: list[str],
                  name: str) -> DataFrame:
    """Add ``name``: the total weight of the rows before this one in ``part``.

    Rows are dealt to buckets by the hash of ``spread``; the order is bucket
    first, then ``order``.
    """
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    df = df.withColumn("_w", weight).withColumn(
        "_b", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy(*part, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*part, "_b").agg(F.sum("_w").alias("_t"))
               .withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t"))
    return (df.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
            .join(offsets, [*part, "_b"])
            .withColumn(name, (F.col("_in") + F.col("_before")).cast("long"))
            .drop("_w", "_b", "_in", "_before"))


def _pick(position, ends: list[int]):
    """The first shard whose cumulative end lies beyond ``position``."""
    return sum((F.when(position >= F.lit(e), 1).otherwise(0) for e in ends[:-1]), F.lit(0))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = materialize(docs.select(
        F.col("doc_id"), (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.unhex(F.md5(body))).alias("g")))
    total = rows.count()
    quota = [total // shards + (k < total % shards) for k in range(shards)]

    groups = rows.where("g is not null").groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    start = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int")
    votes = (rows.where("g is not null").groupBy("g", start.alias("shard")).agg(F.count("*").alias("votes"))
             .join(groups, "g"))
    votes = materialize(votes)
    settled = None
    room = list(quota)
    for turn in range(rounds):
        open_ = [k for k in range(shards) if room[k] > 0]
        if not open_:
            break
        left = F.element_at(F.array(*(F.lit(r) for r in room)), F.col("shard") + 1)
        if turn:
            # groups still open: their neighbours' shards first, else any shard with room
            other = F.element_at(F.array(*(F.lit(k) for k in open_)),
                                 (F.pmod(F.xxhash64("g", F.lit(turn)), F.lit(len(open_))) + 1).cast("int"))
            fresh = votes.select("g", other.alias("shard"), F.lit(0).cast("long").alias("votes"), "n")
            pool = votes.unionByName(fresh)
        else:
            pool = votes
        wish = (pool.where(F.col("n") <= left)
                .groupBy("g", "n").agg(F.max(F.struct("votes", (-F.col("shard")).alias("s"))).alias("m"))
                .select("g", "n", (-F.col("m.s")).cast("int").alias("shard")))
        taken = running_total(wish, ["shard"], F.col("n"), ["g"], ["g"], "before")
        taken = taken.where(F.col("before") + F.col("n") <= left).select("g", "shard", "n")
        settled = materialize(taken if settled is None else settled.unionByName(taken))
        held = {r["shard"]: r["n"] for r in settled.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [q - held.get(k, 0) for k, q in enumerate(quota)]
        votes = materialize(votes.join(settled.select("g"), "g", "left_anti"))
        if votes.isEmpty():
            break

    ends, at = [], 0
    for r in room:
        at += r
        ends.append(at)
    big = votes.select("g", "n").distinct()
    big = materialize(running_total(big.withColumn("one", F.lit(1)), ["one"], F.col("n"), ["g"], ["g"], "first"))
    big_rows = big.agg(F.sum("n")).first()[0] or 0
    # rows without a text have no group and take no part in the joins; tables of
    # groups are broadcast within the bound, beyond it AQE splits a hot group
    alone = rows.where("g is null").withColumns({"shard": F.lit(None).cast("int"), "first": F.lit(None).cast("long")})
    rows = rows.where("g is not null").join(
        bounded_broadcast(settled.select("g", "shard")) if settled is not None else
        groups.select("g", F.lit(None).cast("int").alias("shard")).limit(0), "g", "left")
    rows = rows.join(bounded_broadcast(big.select("g", "first")), "g", "left").unionByName(alone)
    one = F.lit(1).cast("long")
    placed = rows.where("shard is not null").drop("first")
    cut = running_total(rows.where("first is not null"), ["g"], one, ["doc_id"], ["doc_id"], "k")
    cut = cut.withColumn("shard", _pick(F.col("first") + F.col("k"), ends)).select(placed.columns)
    free = rows.where("shard is null and first is null").withColumn("one", F.lit(1))
    free = running_total(free, ["one"], one, ["doc_id", "text_crc32", "size"], ["doc_id", "text_crc32"], "k")
    free = free.withColumn("shard", _pick(F.lit(big_rows) + F.col("k"), ends)).select(placed.columns)
    whole = materialize(placed.unionByName(cut).unionByName(free).drop("g"))
    slots = running_total(whole, ["shard"], one, ["doc_id", "text_crc32", "size"], ["doc_id", "text_crc32"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                        F.col("shard").cast("int").alias("shard"), "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
