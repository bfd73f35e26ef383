"""Phrase collocations per language, mined by the partition method (SON).

The documents are dealt into ``SHARDS`` shards by id.  A phrase that occurs
``least`` times in a language must, in one shard at least, reach the share of
``least`` that the shard has of the language's words; so each shard is mined
completely at its lowered support, the locally frequent phrases are united, and
one more pass counts all of them exactly.

1. ``word_counts``: every word per shard of a language.  From it come ``n`` and
   the shards' supports.
2. ``mined``, level by level: in each shard only word pairs of two locally
   frequent words are counted, and only triples of two locally frequent pairs.
   A shard is no task: its rows are counted by key on all executors, after each
   task has added up its own.  What is frequent goes into a ``Filter``, a Bloom
   filter of bounded size; a chance hit lets some phrases more be counted and
   changes no result.  ``least`` is an absolute number, so every further shard
   lowers the local supports; two leave the most to be pruned.
3. ``phrase_counts``: texts are read once more, and the words and phrases that
   any shard has found frequent are counted by their text.  All occurrences of a
   phrase pass or none, so counts are exact; those under ``least`` go.
4. Scores: the parts of each cut are looked up among the exact counts, with
   salted keys, since a frequent word is part of very many phrases.

A shard's phrases are told apart by 64-bit hashes, which can only add
candidates.  Within one block of a task (some megabytes of text) the same
hashes group the occurrences that are then counted by their words.

Defined results: a null text has no words; a null language is ``und``, together
with rows that say so; null and repeated ids are documents of their own; a
language without candidates has no row; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm import text_arrays as ta
from tessera.session import materialize, small_side

LEAST = 10
TOP = 2000
SHARDS = 2
#: Words of the longest phrase.
LONGEST = 3
#: Bits of a filter: 16 a key, within these bounds (8 KB to 64 MB).
BITS_LOW, BITS_HIGH = 16, 29
_CHUNK = 16
#: Salts of a word and of a phrase as parts: a frequent word is part of far more phrases than any phrase is.
SALT, SALT_PHRASE = 16, 4
#: Phrases whose texts are built at a time.
TEXTS = 1 << 16

_SPLIT = np.zeros(256, dtype=bool)
_SPLIT[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
_GAP = _SPLIT.copy()
_GAP[[0x20, 0x09]] = True


def words(data: np.ndarray, bounds: np.ndarray):
    """Word starts, ends, rows and pieces of lower-cased texts."""
    starts, ends = ta.runs(~_GAP[data], bounds)
    row = np.searchsorted(bounds, starts, side="right") - 1
    return starts, ends, row, np.searchsorted(np.flatnonzero(_SPLIT[data]), starts) + row


class Filter:
    """Bloom filter (two bits a key) of a column ``key`` of 64-bit hashes, on
    the executors as a broadcast variable."""

    def __init__(self, keys: DataFrame):
        keys = materialize(keys)
        self.log = min(max(int(max(keys.count(), 1) * 16 - 1).bit_length(), BITS_LOW), BITS_HIGH)
        width = 1 << _CHUNK
        slots = F.array(F.shiftrightunsigned("key", 64 - self.log), F.col("key").bitwiseAND((1 << self.log) - 1))

        def pack(chunk, part):
            bits = np.zeros(width, dtype=np.uint8)
            bits[part["slot"].to_numpy() % width] = 1
            return pd.DataFrame({"chunk": [chunk[0]], "bits": [np.packbits(bits).tobytes()]})

        rows = keys.select(F.explode(slots).alias("slot")).distinct().groupBy(
            F.shiftright("slot", _CHUNK).alias("chunk")).applyInPandas(pack, "chunk long, bits binary")
        table = np.zeros((1 << self.log) // 8, dtype=np.uint8)
        for r in rows.toLocalIterator():
            table[r.chunk * width // 8:(r.chunk + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def hits(self, key: np.ndarray) -> np.ndarray:
        def bit(slot):
            slot = slot.astype(np.int64)
            return (self.table.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
        return bit(key >> ta.U64(64 - self.log)) & bit(key & ta.U64((1 << self.log) - 1)) == 1


def _lang():
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def _cells(docs: DataFrame, shards: int) -> DataFrame:
    """``cell, text``, ``cell`` being the key of the document's shard of its language."""
    shard = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(shards)).cast("int")
    return docs.select(F.xxhash64(_lang(), shard).alias("cell"), _lang().alias("lang"), "text")


def _keys(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(ta.U64)


def _firsts(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a sorted array begins, and how often it stands there."""
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)])
    return first, np.diff(np.append(first, len(ordered)))


def _by_cell(block: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows ordered by their cell (the first column), and where each cell's rows begin."""
    block = block.take(pa.array(np.argsort(_keys(block.column(0)), kind="stable")))
    return block, _firsts(_keys(block.column(0)))[0]


def _counted(key: np.ndarray, row: np.ndarray, cell: np.ndarray, firsts: np.ndarray):
    """Distinct keys of each cell, their counts and the cell's first row.  Keys of
    one cell stand together, so plain sorts do, with no index."""
    cuts = [*np.searchsorted(row, firsts).tolist(), len(key)]
    keys, counts, rows = [np.zeros(0, ta.U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r, lo, hi in zip(firsts.tolist(), cuts, cuts[1:]):
        ordered = np.sort(key[lo:hi])
        first, n = _firsts(ordered)
        keys.append(ordered[first] ^ cell[r])
        counts.append(n)
        rows.append(np.full(len(n), r))
    return np.concatenate(keys), np.concatenate(counts), np.concatenate(rows)


class _Block:
    """Words of a block of texts with their hashes."""

    def __init__(self, block: pa.RecordBatch):
        data, bounds = ta.flat(block.column(block.schema.get_field_index("text")))
        self.data = ta.lower_ascii(data)
        self.starts, self.ends, self.row, self.piece = words(self.data, bounds)
        self.word = ta.span_hash(ta.prefix_hash(self.data), self.starts, self.ends)

    def grams(self, size: int, cells: np.ndarray | None = None, passing: Filter | None = None):
        """Hashes and first words of the ``size``-word phrases; with ``passing``
        (a filter) only of those whose parts of one word less all hit it."""
        if size == 1:
            key, at = self.word, np.arange(len(self.word))
        else:
            key, at = ta.shingles(self.word, self.piece, size)
        if passing is not None and len(at):
            shorter, where = self.grams(size - 1)
            good = np.zeros(len(self.word), dtype=bool)
            good[where] = passing.hits(shorter ^ cells[self.row[where]])
            keep = good[at] & good[at + 1]
            key, at = key[keep], at[keep]
        return key, at

    def texts(self, at: np.ndarray, size: int) -> pa.Array:
        """The ``size``-word phrases from the words ``at`` on, joined by spaces."""
        which = at[:, None] + np.arange(size)
        starts, length = self.starts[which], self.ends[which] - self.starts[which]
        taken = length + (np.arange(size) < size - 1)
        to = np.append(0, np.cumsum(taken.ravel()))
        begin = to[:-1].reshape(taken.shape)
        out = self.data[np.minimum(np.repeat((starts - begin).ravel(), taken.ravel()) + np.arange(to[-1]), len(self.data) - 1)]
        out[(begin + length)[:, :-1]] = 0x20
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(to[::size].astype(np.int32)), pa.py_buffer(out))


def word_counts(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``cell, key, n``: occurrences of every word per shard of a language."""
    def run(batches):
        for block in ta.blocks(batches, "text"):
            block, firsts = _by_cell(block)
            b = _Block(block)
            cell = _keys(block.column(0))
            key, at = b.grams(1)
            key, n, row = _counted(key, b.row[at], cell, firsts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[row].view(np.int64)), pa.array(key.view(np.int64)), pa.array(n)], names=["cell", "key", "n"])

    return (_cells(docs, shards).select("cell", "text").mapInArrow(run, "cell long, key long, n long")
            .groupBy("cell", "key").agg(F.sum("n").alias("n")))


def _local(docs: DataFrame, size: int, passing: Filter, needs: DataFrame, shards: int) -> DataFrame:
    """``key``: the phrases of ``size`` words, all parts of them frequent, that
    reach their shard's support ``need``."""
    def run(batches):
        for block in ta.blocks(batches, "text"):
            block, firsts = _by_cell(block)
            cell, need = _keys(block.column(0)), block.column(1).to_numpy()
            b = _Block(block)
            key, at = b.grams(size, cell, passing)
            key, n, row = _counted(key, b.row[at], cell, firsts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(n), pa.array(need[row])], names=["key", "n", "need"])

    rows = _cells(docs, shards).join(needs, "cell").select("cell", "need", "text")
    return (rows.mapInArrow(run, "key long, n long, need long")
            .groupBy("key").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need").select("key"))


def mined(docs: DataFrame, found: DataFrame, cells: DataFrame, least: int = LEAST, shards: int = SHARDS) -> dict[int, Filter]:
    """Words and phrases of 2 to ``LONGEST`` words that some shard finds frequent
    at its lowered support.  ``found``: ``word_counts``; ``cells``: their sums."""
    total = cells.groupBy("lang").agg(F.sum("w").alias("total"))
    need = F.expr(f"({least} * w + total - 1) div total")
    needs = small_side(cells.join(total, "lang").select("cell", need.alias("need")).groupBy("cell").agg(F.min("need").alias("need")))
    out = {1: Filter(found.join(needs, "cell").where("n >= need").select("key"))}
    for size in range(2, LONGEST + 1):
        out[size] = Filter(_local(docs, size, out[size - 1], needs, shards))
    return out


def phrase_counts(docs: DataFrame, passing: dict[int, Filter], shards: int = SHARDS) -> DataFrame:
    """``lang, phrase, size, n``: exact counts of the words and phrases that one
    of the shards has found frequent."""
    def run(batches):
        for block in ta.blocks(batches, "text"):
            b = _Block(block)
            lang = block.column(1)
            cells = [_keys(block.column(2 + k)) for k in range(shards)]
            for size, united in passing.items():
                key, at = b.grams(size)
                hit = np.zeros(len(key), dtype=bool)
                for cell in cells:
                    hit |= united.hits(key ^ cell[b.row[at]])
                key, at = key[hit], at[hit]
                key ^= cells[0][b.row[at]]
                order = np.argsort(key)
                first, n = _firsts(key[order])
                at = at[order[first]]
                for i in range(0, len(at), TEXTS):
                    some = at[i:i + TEXTS]
                    yield pa.RecordBatch.from_arrays(
                        [lang.take(pa.array(b.row[some])), b.texts(some, size), pa.array(n[i:i + TEXTS])],
                        names=["lang", "phrase", "n"])

    every = [F.xxhash64(_lang(), F.lit(k)).alias(f"cell{k}") for k in range(shards)]
    size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1     # no word holds a space
    return (docs.select("text", _lang().alias("lang"), *every).mapInArrow(run, "lang string, phrase string, n long")
            .groupBy("lang", "phrase").agg(F.sum("n").alias("n")).select("lang", "phrase", size.alias("size"), "n"))


def _scored(cands: DataFrame, single: DataFrame) -> DataFrame:
    """``l``, ``r`` and ``score`` of the lowest-scoring cut of each candidate."""
    word = F.split("phrase", " ", -1)
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit("l").alias("side"), F.array_join(F.slice(F.col("w"), F.lit(1), k), " ").alias("part")),
        F.struct(k.alias("k"), F.lit("r").alias("side"),
                 F.array_join(F.slice(F.col("w"), k + 1, F.col("size") - k), " ").alias("part")))))
    salt = F.pmod(F.xxhash64("phrase"), F.when(F.instr("c.part", " ") > 0, SALT_PHRASE).otherwise(SALT)).cast("int")
    needed = cands.withColumn("w", word).select("lang", "phrase", "size", "n", F.explode(cuts).alias("c")) \
        .select("lang", "phrase", "size", "n", "c.*", salt.alias("salt"))

    def salted(rows, salts):
        return rows.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))

    known = salted(single.select("lang", F.col("word").alias("part"), F.col("n").alias("f")), SALT).unionByName(salted(
        cands.where(F.col("size") < LONGEST).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), SALT_PHRASE))
    sides = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
             for k in range(1, LONGEST) for side in "lr"]
    got = needed.join(known, ["lang", "part", "salt"]).groupBy("lang", "phrase").agg(
        F.max("size").alias("size"), F.max("n").alias("a"), *sides)

    def cut(k):
        score = F.expr("(1000000BD * CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0))) div "
                       f"(CAST(l{k} AS DECIMAL(19,0)) * CAST(r{k} AS DECIMAL(19,0)))")
        return F.when(F.col("size") > k, F.struct(
            score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    best = F.array_min(F.array(*[cut(k) for k in range(1, LONGEST)])).alias("b")
    return got.select("lang", "phrase", "size", "a", best).select("lang", "phrase", "size", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first
    ``top`` phrases by score, count and phrase."""
    found = materialize(word_counts(docs, shards))
    langs = _cells(docs, shards).select("cell", "lang").distinct()
    cells = materialize(langs.join(found.groupBy("cell").agg(F.sum("n").alias("w")), "cell"))
    counts = materialize(phrase_counts(docs, mined(docs, found, cells, least, shards), shards).where(F.col("n") >= least))
    cands = counts.where("size > 1")
    single = counts.where("size = 1").select("lang", F.col("phrase").alias("word"), "n")
    # A phrase goes if one word more nearly always comes with it.
    longer = cands.where("size > 2").select(
        "lang", F.col("n").alias("longer"), F.split("phrase", " ", -1).alias("w"), "size")
    inside = longer.select("lang", "longer", F.explode(F.array(
        F.array_join(F.slice("w", F.lit(1), F.col("size") - 1), " "),
        F.array_join(F.slice("w", F.lit(2), F.col("size") - 1), " "))).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = _scored(cands, single).join(inside, ["lang", "phrase"], "left").where(
        "longer IS NULL OR 100 * longer < 50 * a")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # Two rounds, so that a language's candidates never meet in one task.
    some = Window.partitionBy("lang", "salt").orderBy(*order)
    first = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(some)) \
        .where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")) \
        .where(F.col("rank") <= top)
    total = cells.groupBy("lang").agg(F.sum("w").alias("n"))
    return ranked.join(small_side(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The contract in DuckDB, counting every phrase.
SQL = """
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM pieces),
words AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM w) GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM words GROUP BY lang),
pairs AS (SELECT lang, phrase, count(*) AS a FROM (
  SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w) GROUP BY ALL),
triples AS (SELECT lang, phrase, count(*) AS a FROM (
  SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM w)
  GROUP BY ALL),
cuts AS (
  SELECT p.lang, p.phrase, 2 AS size, 1 AS k, a, x.n AS l, y.n AS r FROM pairs p
  JOIN words x ON x.lang = p.lang AND x.word = string_split(p.phrase, ' ')[1]
  JOIN words y ON y.lang = p.lang AND y.word = string_split(p.phrase, ' ')[2] WHERE a >= 10
  UNION ALL
  SELECT t.lang, t.phrase, 3, 1, t.a, x.n, y.a FROM triples t
  JOIN words x ON x.lang = t.lang AND x.word = string_split(t.phrase, ' ')[1]
  JOIN pairs y ON y.lang = t.lang AND y.phrase = string_split(t.phrase, ' ')[2] || ' ' || string_split(t.phrase, ' ')[3]
  WHERE t.a >= 10
  UNION ALL
  SELECT t.lang, t.phrase, 3, 2, t.a, x.a, y.n FROM triples t
  JOIN pairs x ON x.lang = t.lang AND x.phrase = string_split(t.phrase, ' ')[1] || ' ' || string_split(t.phrase, ' ')[2]
  JOIN words y ON y.lang = t.lang AND y.word = string_split(t.phrase, ' ')[3] WHERE t.a >= 10),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
cands AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([string_split(phrase, ' ')[1] || ' ' || string_split(phrase, ' ')[2],
                            string_split(phrase, ' ')[2] || ' ' || string_split(phrase, ' ')[3]]) AS phrase
    FROM triples WHERE a >= 10) GROUP BY ALL)
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank,
  c.phrase, a, l, r, t.n, score
FROM cands c JOIN totals t ON t.lang = c.lang LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
WHERE i.longer IS NULL OR 100 * i.longer < 50 * a
QUALIFY rank <= 2000
"""
