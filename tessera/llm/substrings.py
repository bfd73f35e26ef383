"""Exact substring deduplication by longest-previous-factor tests.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a
document with a smaller id.  In terms of a suffix array of all texts: the
suffix at a position has a longest previous factor of ``LENGTH`` or more
with an earlier document, found at its previous or next smaller neighbour in
suffix order.  The suffix array is never built whole:

* Suffixes are dealt by the minimum hash of the ``GRAM``-byte strings in
  their first ``LENGTH`` bytes, so that suffixes with equal first ``LENGTH``
  bytes meet.  Neighbouring positions mostly have the same minimum; such a
  run is one row (about one per 18 bytes) with a hash of all bytes it needs.
* A run whose bytes occur in a smaller document is a duplicate as a whole; a
  run whose minimum occurs in one document only is unique.  Runs that repeat
  inside a batch are settled there, so a frequent passage sends one row per
  batch and run.
* Only runs with a shared minimum and different surroundings are opened: their
  bytes meet by the minimum, their suffixes are sorted, and the smaller
  neighbours in suffix order decide each position.

Matches are judged on the input.  Positions are bytes of the UTF-8 text.

Defined results: null and empty texts have no bytes and the digest of the
empty string; a null id is later than no document and earlier than none (its
text stays and removes nothing); rows that repeat an id are one document, and
positions found in one are applied to each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm import text_arrays as ta
from tessera.session import bounded_broadcast, materialize

LENGTH = 50
GRAM = 16
MAX_RUN = 2048
#: Runs of one minimum beyond which its suffixes are dealt one by one.
HOT_RUNS = 20_000
#: Ids up to which the texts to open or cut are picked by a broadcast.
BROADCAST_IDS = 1_000_000
#: Last bits of a run's key that its length and state take; runs meet by the others.
KEY_CUT = 24
U64 = np.uint64


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """``min(x[i:i+width])`` for every full window."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, ~U64(0), dtype=U64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n - width + 1], forward[width - 1:n])


def position_runs(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of positions with equal minimum: ``key, start, count, row, context``.

    Only positions whose ``length`` bytes lie inside their text count.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty.view(U64), empty, empty, empty, empty.view(U64)
    prefix = ta.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    low = sliding_min(ta.span_hash(prefix, at, at + gram), length - gram + 1)
    sizes = np.diff(bounds)
    valid = np.zeros(len(low) + 1, dtype=np.int64)
    long_ = np.flatnonzero(sizes >= length)
    np.add.at(valid, bounds[long_], 1)
    np.add.at(valid, bounds[long_ + 1] - length + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    new[bounds[long_]] = True
    start = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= new[1:] | ~valid[1:]
    count = np.flatnonzero(stop) + 1 - start
    if len(count) and count.max() > MAX_RUN:   # periodic texts
        parts = -(-count // MAX_RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, left = np.repeat(start, parts) + nth * MAX_RUN, np.repeat(count, parts) - nth * MAX_RUN
        count = np.minimum(left, MAX_RUN)
    row = np.searchsorted(bounds, start, side="right") - 1
    return low[start], start, count, row, ta.span_hash(prefix, start, start + count + length - 1)


def _run_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``packed, context, doc, at`` of every run: a run is the row that is shuffled
    most, so ``packed`` holds the key (but for its last ``KEY_CUT`` bits), twice
    the run's length, and 1 if it is settled.  Different minima that meet so
    have different contexts, and are told apart where runs are opened."""

    def run(batches):
        for part in ta.blocks(batches, "text", 1 << 20):
            data, bounds = ta.flat(part.column(1))
            key, start, count, row, context = position_runs(data, bounds, length, gram)
            if not len(key):
                continue
            doc = part.column(0).to_numpy(zero_copy_only=False)[row]
            at = start - bounds[row]
            order = np.lexsort((doc, context, key))
            k, c, d = key[order], context[order], doc[order]
            head = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
            first = d[np.flatnonzero(head)][np.cumsum(head) - 1]
            later = np.zeros(len(key), dtype=bool)
            later[order] = d > first
            # settled runs need no partner: spread them
            key = np.where(later, ta.mix64(key ^ (doc.astype(U64) * U64(31) + at.astype(U64))), key)
            packed = (key >> U64(KEY_CUT) << U64(KEY_CUT)) | (count.astype(U64) << U64(1)) | later.astype(U64)
            yield pa.RecordBatch.from_arrays([
                pa.array(packed.view(np.int64)), pa.array(np.where(later, 0, context.view(np.int64))),
                pa.array(doc), pa.array(at.astype(np.int32))], names=["packed", "context", "doc", "at"])

    return docs.mapInArrow(run, "packed long, context long, doc long, at int")


def _merge(start: np.ndarray, stop: np.ndarray):
    """Union of half-open intervals, sorted."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    head = np.append(True, start[1:] > reach[:-1])
    return start[head], reach[np.append(np.flatnonzero(head)[1:], len(start)) - 1]


def _unpacked(values: pa.Array):
    """``at, n, kind`` of numbers that hold them in 31, 31 and 2 bits."""
    x = values.to_numpy(zero_copy_only=False).view(U64)
    return tuple(v.astype(np.int64) for v in (x >> U64(33), x >> U64(2) & U64((1 << 31) - 1), x & U64(3)))


def _per_doc(rows: DataFrame) -> DataFrame:
    """``doc, dup, open``: merged position intervals (flat pairs) and open runs
    (packed, see ``_unpacked``)."""
    at, n, kind = (F.col(c).cast("long") for c in ("at", "n", "kind"))
    lists = rows.groupBy("doc").agg(F.collect_list(
        F.shiftleft(at, 33).bitwiseOR(F.shiftleft(n, 2)).bitwiseOR(kind)).alias("r"))

    def run(batches):
        for b in batches:
            out = []
            packed = b.column(1).flatten()
            at, n, kind = _unpacked(packed)
            packed = packed.to_numpy(zero_copy_only=False)
            cut = np.append(0, np.cumsum(pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)))
            for doc, x, y in zip(b.column(0).to_pylist(), cut, cut[1:]):
                a, m, k = at[x:y], n[x:y], kind[x:y]
                full = k == 0
                lo, hi = _merge(a[full], a[full] + m[full]) if full.any() else (a[:0], a[:0])
                out.append({"doc": doc, "dup": np.stack([lo, hi], 1).ravel().tolist(),
                            "open": packed[x:y][~full].tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("doc", pa.int64()), ("dup", pa.list_(pa.int64())), ("open", pa.list_(pa.int64()))]))

    return lists.mapInArrow(run, "doc long, dup array<long>, open array<long>")


def previous_factors(suffixes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For fixed-length suffix prefixes: whether a smaller document has an equal one.

    The rows are brought into suffix order; inside a stretch of equal rows
    (common prefix of the full length) the nearest smaller document before or
    after a suffix exists unless the suffix belongs to the stretch's smallest.
    """
    width = suffixes.shape[1]
    order = np.argsort(np.ascontiguousarray(suffixes).view(f"V{width}").ravel().view(f"S{width}"), kind="stable") \
        if not (suffixes == 0).any() else np.lexsort(suffixes.T[::-1])
    rows = suffixes[order]
    head = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
    first = np.minimum.reduceat(doc[order], np.flatnonzero(head))[np.cumsum(head) - 1]
    out = np.empty(len(doc), dtype=bool)
    out[order] = first < doc[order]
    return out


def _opened(docs: DataFrame, per_doc: DataFrame, length: int, gram: int) -> DataFrame:
    """``key, doc, at, n, body``: the open runs with the bytes they need."""
    wanted = per_doc.where(F.size("open") > 0).select("doc", "open")
    texts = docs.join(bounded_broadcast(wanted.select("doc"), BROADCAST_IDS), "doc", "left_semi").join(wanted, "doc")

    def run(batches):
        for part in ta.blocks(batches, "text", 1 << 20):
            data, bounds = ta.flat(part.column(1))
            spans = part.column(2)
            each = pa.compute.list_value_length(spans).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(part.num_rows), each)
            at, n, kind = _unpacked(spans.flatten())
            fits = at + n + length - 1 <= np.diff(bounds)[row]
            row, at, n, kind = row[fits], at[fits], n[fits], kind[fits]
            hot = kind == 2          # one suffix each
            if hot.any():
                nth = np.arange(n[hot].sum()) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
                single = np.repeat(at[hot], n[hot]) + nth
                row = np.concatenate([row[~hot], np.repeat(row[hot], n[hot])])
                at = np.concatenate([at[~hot], single])
                n = np.concatenate([n[~hot], np.ones(len(single), np.int64)])
                hot = np.arange(len(at)) >= len(at) - len(single)
            start = bounds[row] + at
            prefix = ta.prefix_hash(data)
            grams = np.arange(max(len(data) - gram + 1, 0))
            low = sliding_min(ta.span_hash(prefix, grams, grams + gram), length - gram + 1)
            key = low[start] if len(start) else np.zeros(0, U64)
            if hot.any():
                key[hot] = ta.span_hash(prefix, start[hot], start[hot] + length)
            raw = data.tobytes()
            body = [raw[a:b] for a, b in zip(start.tolist(), (start + n + length - 1).tolist())]
            doc = part.column(0).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([
                pa.array(key.view(np.int64)), pa.array(doc), pa.array(at.astype(np.int32)),
                pa.array(n.astype(np.int32)), pa.array(body, pa.binary())], names=["key", "doc", "at", "n", "body"])

    return texts.select("doc", "text", "open").mapInArrow(
        run, "key long, doc long, at int, n int, body binary")


def _suffix_runs(opened: DataFrame, length: int) -> DataFrame:
    """``doc, at, n`` of the positions that have a previous factor."""
    parts = int(opened.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = opened.repartition(parts, "key").sortWithinPartitions("key")
    chunk = 100_000

    def settle(t: pa.Table):
        data, bounds = ta.flat(t.column("body"))
        doc = t.column("doc").to_numpy()
        at, n = (t.column(c).to_numpy().astype(np.int64) for c in ("at", "n"))
        row = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = bounds[row] + off
        dup = previous_factors(np.lib.stride_tricks.sliding_window_view(data, length)[start], doc[row])
        pos, owner = at[row] + off, doc[row]
        head = dup.copy()
        head[1:] &= ~dup[:-1] | (row[1:] != row[:-1])
        tail = dup.copy()
        tail[:-1] &= ~dup[1:] | (row[1:] != row[:-1])
        a, b = np.flatnonzero(head), np.flatnonzero(tail)
        return pa.RecordBatch.from_arrays([
            pa.array(owner[a]), pa.array(pos[a].astype(np.int32)), pa.array((b - a + 1).astype(np.int32))],
            names=["doc", "at", "n"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += int(pa.compute.sum(b.column(3)).as_py())
            if size < chunk:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            done, n = 0, np.cumsum(t.column("n").to_numpy())
            for h, nxt in zip(heads, heads[1:]):      # whole keys only; the last one may go on
                before = n[done - 1] if done else 0
                if n[nxt - 1] - before >= chunk:
                    yield settle(t.slice(done, nxt - done))
                    done = int(nxt)
            if heads[-1] > done:
                yield settle(t.slice(done, int(heads[-1]) - done))
                done = int(heads[-1])
            rest = t.slice(done)
            held, size = rest.to_batches(), int(pa.compute.sum(rest.column("n")).as_py())
        if held:
            yield settle(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "doc long, at int, n int")


def duplicate_positions(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc, dup``: merged intervals of positions with a previous factor, as a
    flat list of (start, end); documents without one are left out."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    key = F.shiftright("packed", KEY_CUT)
    runs = _run_rows(docs, length, gram).repartition(key).select(
        key.alias("key"), "context", "doc", "at",
        F.shiftright(F.col("packed").bitwiseAND(F.lit((1 << KEY_CUT) - 1)), 1).cast("int").alias("n"),
        (F.col("packed").bitwiseAND(F.lit(1)) == 1).alias("settled"))
    same, key = Window.partitionBy("key", "context"), Window.partitionBy("key")
    runs = (runs.withColumn("first", F.min("doc").over(same))
            .withColumns({"c0": F.min("context").over(key), "c1": F.max("context").over(key),
                          "d0": F.min("doc").over(key), "d1": F.max("doc").over(key),
                          "m": F.count("*").over(key)}))
    full = F.col("settled") | (F.col("first") < F.col("doc"))
    open_ = (F.col("c0") < F.col("c1")) & (F.col("d0") < F.col("d1"))
    rows = runs.where(full | open_).select("doc", "at", "n", F.when(full, 0).when(
        F.col("m") <= HOT_RUNS, 1).otherwise(2).alias("kind"))
    per_doc = materialize(_per_doc(rows))
    more = _suffix_runs(_opened(docs, per_doc, length, gram), length)
    known = per_doc.where(F.size("dup") > 0).select("doc", F.explode(F.transform(
        F.sequence(F.lit(0), (F.size("dup") / 2).cast("int") - 1), lambda i: F.struct(
            F.get("dup", (2 * i).cast("int")).cast("int").alias("at"),
            (F.get("dup", (2 * i + 1).cast("int")) - F.get("dup", (2 * i).cast("int"))).cast("int").alias("n"))))
        .alias("s")).select("doc", "s.*")
    every = known.unionAll(more).withColumn("kind", F.lit(0))
    return _per_doc(every).select("doc", "dup").where(F.size("dup") > 0)


_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    dup = materialize(duplicate_positions(docs, length, gram))
    base = docs.select(F.col("doc_id").cast("long"), "text")
    ids = dup.select(F.col("doc").alias("doc_id"))
    # most documents keep all bytes: they need no join with their intervals
    few = bounded_broadcast(ids, BROADCAST_IDS)
    body = F.coalesce("text", F.lit("")).cast("binary")
    zero = F.lit(0).cast("long")
    whole = base.join(few, "doc_id", "left_anti").select(
        "doc_id", F.octet_length(body).cast("long").alias("n_bytes"), zero.alias("n_removed"),
        zero.alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"))
    cut = base.join(few, "doc_id", "left_semi").join(dup.withColumnRenamed("doc", "doc_id"), "doc_id")

    def run(batches):
        for part in ta.blocks(batches, "text"):
            data, bounds = ta.flat(part.column(1))
            raw, out = data.tobytes(), []
            for doc, pairs, a, b in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), bounds, bounds[1:]):
                p = np.array(pairs, dtype=np.int64).reshape(-1, 2)
                n = int(b - a)
                lo, hi = _merge(p[:, 0], np.minimum(p[:, 1] + length - 1, n))
                sha, at = hashlib.sha256(), 0
                for x, y in zip(lo.tolist(), hi.tolist()):
                    sha.update(raw[a + at:a + x])
                    at = y
                sha.update(raw[a + at:b])
                out.append((doc, n, int((hi - lo).sum()), len(lo), sha.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 4 + (pa.string(),))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return whole.unionAll(cut.select("doc_id", "text", "dup").mapInArrow(run, _SCHEMA))
