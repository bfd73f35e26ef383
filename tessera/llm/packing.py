"""Best-fit packing of tokenised documents into fixed-length sequences.

Three steps, each bounded in memory at any corpus size:

1. ``token_pieces`` tokenises whole texts in Arrow batches, appends the end
   token and cuts only what exceeds the capacity; one small row per piece.
2. The histogram of piece lengths (at most ``capacity`` rows) is all that
   reaches the driver.  ``complete_bins`` packs it by bin completion: the
   largest remaining piece opens a bin, the undominated fillings of the rest
   are enumerated, those whose waste breaks the bound are pruned, and the
   branch-and-bound keeps the best packing found (best-fit decreasing is the
   first incumbent).  A filling is applied to as many bins at once as the
   histogram allows, so the work depends on the distinct lengths only.
3. ``place`` numbers the pieces of each length without gaps (per-bucket row
   numbers plus bucket offsets, so no length meets in one task) and looks up
   their bin and offset in the plan.

Defined results: null and empty texts hold the end token alone; null or
repeated ids are packed like any other row; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm import text_arrays as ta
from tessera.session import materialize

CAPACITY = 4096
END_ID = 1
FILLINGS = 24
NODES = 4_000
CACHE_WORDS = 2_000_000
BLOCK_BYTES = 1 << 20

#: Fixed by the tokenizer file: contractions that its split pattern parts off.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class Tokens:
    """Token ids of texts, with a cache of pre-tokens.

    The tokenizer splits a lower-cased text into letter runs, single digits
    and runs of other signs, and encodes each by itself.  That split is done
    here on the bytes of a block of texts at once; each pre-token not yet in
    the cache (by its 64-bit hash) goes through the tokenizer, all new ones
    of a block in one call.  Texts with other than plain Latin characters or
    with special-token strings go to the tokenizer whole.  The cache starts
    anew beyond ``CACHE_WORDS``.
    """

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self._reset()

    def _reset(self):
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, keys, data, starts, ends):
        """Add pre-tokens (sorted new keys and their byte spans) to the cache."""
        if len(self.keys) > CACHE_WORDS:   # the caller asks again for all its keys
            return self._reset()
        raw = data.tobytes()
        text = " ".join([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())])
        got = self.model.encode(text, add_special_tokens=False)
        count = np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(keys))
        first = np.cumsum(count) - count + len(self.pool)
        self.pool = np.concatenate([self.pool, np.array(got.ids, dtype=np.uint32)])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first, self.count = np.insert(self.first, at, first), np.insert(self.count, at, count)
        return None

    def _plain(self, data, bounds):
        """Ids of plain lower-cased texts: (flat ids, len+1 bounds)."""
        kind = _KIND[data]
        after = np.flatnonzero(data == 0xC2) + 1
        kind[after] = np.where(np.isin(data[after], (0xAA, 0xB5, 0xBA)), 1, 3)
        kind[after - 1] = kind[after]
        sign = np.flatnonzero((data[1:] == 0x97) | (data[1:] == 0xB7)) + 1
        sign = sign[data[sign - 1] == 0xC3]
        kind[sign] = kind[sign - 1] = 3
        start = np.ones(len(data), dtype=bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        start[bounds[:-1][bounds[:-1] < len(data)]] = True
        quote = np.flatnonzero((data == 39) & start)
        if len(quote):
            row_end = bounds[np.searchsorted(bounds, quote, side="right")]
            padded = np.append(data, np.zeros(3, np.uint8))
            open_ = np.ones(len(quote), dtype=bool)
            for tail in CONTRACTIONS:
                hit = open_ & (quote + len(tail) < row_end)
                for j, c in enumerate(tail.encode(), 1):
                    hit &= padded[quote + j] == c
                open_ &= ~hit
                q = quote[hit]
                start[q + 1] = False
                after = q + 1 + len(tail)
                start[after[after < len(data)]] = True
        at = np.flatnonzero(start)
        ends = np.append(at[1:], len(data))
        solid = kind[at] > 0
        at, ends = at[solid], ends[solid]
        key = ta.span_hash(ta.prefix_hash(data), at, ends)
        distinct, sample, inverse = np.unique(key, return_index=True, return_inverse=True)
        while len(distinct):
            slot = np.searchsorted(self.keys, distinct)
            fresh = slot == len(self.keys)
            fresh[~fresh] = self.keys[slot[~fresh]] != distinct[~fresh]
            if not fresh.any():
                break
            self._learn(distinct[fresh], data, at[sample[fresh]], ends[sample[fresh]])
        if not len(distinct):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        first, count = self.first[slot][inverse], self.count[slot][inverse]
        total = np.cumsum(count)
        ids = self.pool[np.repeat(first - (total - count), count) + np.arange(total[-1])]
        return ids, np.append(0, total)[np.searchsorted(at, bounds)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        low = [t.lower().encode() for t in texts]
        bounds = np.append(0, np.cumsum([len(x) for x in low])).astype(np.int64)
        data = np.frombuffer(b"".join(low), dtype=np.uint8)
        odd = _ODD[data]
        after = np.flatnonzero(data == 0xC2) + 1
        odd[after[(data[after] <= 0xA0) | np.isin(data[after], _ODD_AFTER_C2)]] = True
        odd = np.diff(np.append(0, np.cumsum(odd))[bounds]) > 0
        odd |= np.array(["<|" in t for t in texts], dtype=bool)
        plain = np.flatnonzero(~odd)
        out: list = [None] * len(texts)
        if len(plain):
            if len(plain) < len(texts):
                kept = [low[i] for i in plain.tolist()]
                bounds = np.append(0, np.cumsum([len(x) for x in kept])).astype(np.int64)
                data = np.frombuffer(b"".join(kept), dtype=np.uint8)
            ids, cut = self._plain(data, bounds)
            for k, i in enumerate(plain.tolist()):
                out[i] = ids[cut[k]:cut[k + 1]]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole(texts[i])
        return out


#: Kinds of bytes in a plain text: 0 blank, 1 letter, 2 digit, 3 other sign.
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = 1
_KIND[48:58] = 2
#: Bytes that no plain text has: control signs, and leads beyond U+017F.
_ODD = np.zeros(256, dtype=bool)
_ODD[[*range(0x09), *range(0x0E, 0x20), 0x7F, *range(0xC6, 0x100)]] = True
_ODD_AFTER_C2 = (0xAD, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE)   # soft hyphen, raised digits, fractions

_tokens: dict[str, Tokens] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                 end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every whole text."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        if tokenizer_path not in _tokens:
            _tokens[tokenizer_path] = Tokens(tokenizer_path)
        for part in ta.blocks(batches, "text", BLOCK_BYTES):
            rows = []
            texts = [t or "" for t in part.column(1).to_pylist()]
            for doc, got in zip(part.column(0).to_pylist(), _tokens[tokenizer_path].encode(texts)):
                ids = got.astype("<u4").tobytes() + end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    rows.append((doc, k, start, size, zlib.crc32(ids[4 * start:4 * (start + size)])))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(counts: dict[int, int], capacity: int):
    """``[(lengths of a bin, bins)]`` by best fit on the histogram."""
    open_bins: dict[int, dict[tuple, int]] = {}   # free space -> contents -> bins
    free: list[int] = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(free, size)
            if at == len(free):
                each = capacity // size
                full, rest = divmod(left, each)
                for items, n in (((size,) * each, full), ((size,) * rest, 1)):
                    if n and items:
                        _put(open_bins, free, capacity - size * len(items), items, n)
                left = 0
                continue
            room = free[at]
            items, n = open_bins[room].popitem()
            if not open_bins[room]:
                del open_bins[room], free[at]
            used = min(n, left)
            if n > used:
                _put(open_bins, free, room, items, n - used)
            _put(open_bins, free, room - size, (*items, size), used)
            left -= used
    return [(items, n) for group in open_bins.values() for items, n in group.items()]


def _put(open_bins, free, room, items, n):
    if room not in open_bins:
        open_bins[room] = {}
        bisect.insort(free, room)
    open_bins[room][items] = open_bins[room].get(items, 0) + n


def fillings(counts: dict[int, int], sizes: list[int], room: int, allowed: int, limit: int = FILLINGS):
    """Undominated fillings of ``room``: maximal multisets of the lengths at
    hand, largest first, with waste of at most ``allowed``; sorted by waste.

    An exact fit ends the enumeration: no filling of the same bin wastes
    less.  ``limit`` bounds the leaves looked at.
    """
    found: list[tuple[int, tuple]] = []
    used: dict[int, int] = {}
    leaves = 0

    def largest(most: int) -> int:
        at = bisect.bisect_right(sizes, most) - 1
        while at >= 0 and counts[sizes[at]] <= used.get(sizes[at], 0):
            at -= 1
        return at

    def go(space: int, most: int, items: tuple) -> bool:
        nonlocal leaves
        if space and space <= most and counts.get(space, 0) > used.get(space, 0):
            found.append((0, (*items, space)))
            return True
        at = largest(min(space, most))
        if at < 0:
            leaves += 1
            if space <= allowed or not found:
                found.append((space, items))
            return space == 0 or leaves >= limit
        least_first = sizes[at]
        while at >= 0:
            size = sizes[at]
            # a filling that leaves room for a larger piece tried before is dominated
            if items and size * 2 <= least_first and space - size >= least_first:
                break
            used[size] = used.get(size, 0) + 1
            done = go(space - size, size, (*items, size))
            used[size] -= 1
            if done:
                return True
            at = largest(size - 1)
            if leaves >= limit:
                return True
        return False

    go(room, room, ())
    return sorted(set(found), key=lambda f: (f[0], [-x for x in f[1]]))


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES):
    """Bin completion branch-and-bound; ``([(lengths, bins)], bins, lower bound)``."""
    total = sum(k * v for k, v in histogram.items())
    large = sum(v for k, v in histogram.items() if 2 * k > capacity)
    bound = max(-(-total // capacity), large)
    best = best_fit_decreasing(histogram, capacity)
    best_n = sum(n for _, n in best)
    counts = dict(histogram)
    sizes = sorted(counts)

    def take(items, n):
        for x in items:
            counts[x] -= n
            if not counts[x]:
                sizes.remove(x)

    def give(items, n):
        for x in items:
            if not counts[x]:
                bisect.insort(sizes, x)
            counts[x] += n

    stack: list[list] = []       # [branches, applied (items, bins) or None]
    chosen: list[tuple] = []
    bins, wasted, seen, down = 0, 0, 0, True
    while best_n > bound:
        if down and not sizes:
            if bins < best_n:
                best, best_n = list(chosen), bins
            down = False
        elif down:
            slack = (best_n - 1) * capacity - total - wasted
            seen += 1
            if slack < 0:
                down = False
            else:
                top = sizes[-1]
                counts[top] -= 1
                options = fillings(counts, sizes, capacity - top, slack)
                counts[top] += 1
                options = [(w, (top, *items)) for w, items in options if w <= slack]
                stack.append([iter(options[:3]), None])
                down = False
                step = next(stack[-1][0], None)
                if step is not None:
                    down = True
                    waste, items = step
                    n = min(counts[x] // items.count(x) for x in set(items))
                    if waste:
                        n = min(n, max(1, slack // waste))
                    take(items, n)
                    stack[-1][1] = (items, n, waste)
                    chosen.append((items, n))
                    bins, wasted = bins + n, wasted + n * waste
        else:
            while stack:
                frame = stack[-1]
                if frame[1]:
                    items, n, waste = frame[1]
                    give(items, n)
                    chosen.pop()
                    bins, wasted, frame[1] = bins - n, wasted - n * waste, None
                step = next(frame[0], None) if seen < nodes + len(histogram) * 2 else None
                if step is None:
                    stack.pop()
                    continue
                waste, items = step
                slack = (best_n - 1) * capacity - total - wasted
                if waste > slack:
                    continue
                take(items, 1)
                frame[1] = (items, 1, waste)
                chosen.append((items, 1))
                bins, wasted, down = bins + 1, wasted + waste, True
                break
            if not stack:
                break
    return best, best_n, bound


def place(pieces: DataFrame, plan, bins: int, buckets: int | None = None) -> DataFrame:
    """Give every piece its sequence and offset according to ``plan``."""
    spark = pieces.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts, per_bin, first_bin, offset, order = [], [], [], [], []
    used: dict[int, int] = {}
    at_bin = 0
    for items, n in plan:
        place_at = 0
        for size in sorted(set(items), reverse=True):
            q = items.count(size)
            order.append((size << 44) + used.get(size, 0))
            starts.append(used.get(size, 0))
            per_bin.append(q)
            first_bin.append(at_bin)
            offset.append(place_at)
            used[size] = used.get(size, 0) + q * n
            place_at += q * size
        at_bin += n
    rank = np.argsort(np.array(order, dtype=np.int64), kind="stable")
    table = spark.sparkContext.broadcast(
        tuple(np.array(x, dtype=np.int64)[rank] for x in (order, starts, per_bin, first_bin, offset)))

    spread = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    in_bucket = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (spread.groupBy("length", "_b").agg(F.count("*").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    ranked = (spread.withColumn("_k", F.row_number().over(in_bucket) - 1)
              .join(offsets, ["length", "_b"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("_k") + F.col("_before")).cast("long").alias("_rank")))

    def look_up(batches):
        order_, starts_, per_, first_, offset_ = table.value
        for b in batches:
            size = b.column(3).to_numpy(zero_copy_only=False)
            k = b.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(order_, (size << 44) + k, side="right") - 1
            k = k - starts_[at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(5)), pa.array(first_[at] + k // per_[at]),
                 pa.array(offset_[at] + (k % per_[at]) * size)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(look_up, "doc_id long, piece int, start long, length long, "
                                      "ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                   end_id: int = END_ID) -> DataFrame:
    """Tokenise, plan and place: one row per piece."""
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan, bins, _ = complete_bins(histogram, capacity)
    return place(pieces, plan, bins)
