"""Benchmark decontamination by greedy string tiling.

For every (document, test item) pair that shares a seed of ``MIN_MATCH``
words, the longest common runs of words are marked, longest first and never
overlapping (running Karp-Rabin greedy string tiling); the share of the
item's words under tiles is its coverage.  Because tiles may stand in any
order, passages whose sentences were moved around are caught as well.

The test items are laid out as sorted numpy arrays and broadcast in blocks
of at most about ``BLOCK_SEEDS`` seeds; a larger benchmark takes more passes
over the documents, never a larger broadcast.  Documents are read in Arrow
batches, whole, and need no shuffle.  A pair goes to the tiling only if the
item words under shared seeds reach the threshold, an upper bound of the
coverage, so nothing is lost by it.

Words are runs of letters and digits (ASCII lower-cased).  Defined results:
null and empty texts, and items of fewer than ``MIN_MATCH`` words, match
nothing; null ids are kept as they are; repeated document rows are reported
each; repeated items (the same id and text) count once; an empty benchmark
gives no rows; extra columns are ignored or, in ``drop_contaminated``, kept.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import text_arrays as ta
from tessera.llm.toxicity import _WORD

MIN_MATCH = 5
THRESHOLD = 0.5
BLOCK_SEEDS = 1_000_000


def _words(column):
    data, bounds = ta.flat(column)
    low = ta.lower_ascii(data)
    starts, ends = ta.runs(_WORD[low], bounds)
    row = np.searchsorted(bounds, starts, side="right") - 1
    return ta.span_hash(ta.prefix_hash(low), starts, ends), row


def tiles(doc: np.ndarray, item: np.ndarray, places: dict[int, list[int]], seeds: np.ndarray,
          min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(item start, doc start, length)``, longest first.

    ``seeds[i]`` is the fingerprint of item words ``i .. i+min_match-1`` and
    ``places`` maps fingerprints to their starts in ``doc``.
    """
    free_doc = np.ones(len(doc), dtype=bool)
    free_item = np.ones(len(item), dtype=bool)
    found = []
    while True:
        longest, matches = min_match, []
        for i in range(len(seeds)):
            if not free_item[i]:
                continue
            for j in places.get(int(seeds[i]), ()):
                n = 0
                while (i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]
                       and free_item[i + n] and free_doc[j + n]):
                    n += 1
                if n > longest:
                    longest, matches = n, [(i, j)]
                elif n == longest:
                    matches.append((i, j))
        marked = False
        for i, j in matches:
            if free_item[i:i + longest].all() and free_doc[j:j + longest].all():
                free_item[i:i + longest] = False
                free_doc[j:j + longest] = False
                found.append((i, j, longest))
                marked = True
        if not marked:
            return found


class Items:
    """Test items of one block: words, and seeds sorted by fingerprint."""

    def __init__(self, ids: list, column: pa.Array, min_match: int):
        word, row = _words(column)
        cut = np.searchsorted(row, np.arange(len(ids) + 1))
        seed, at = ta.shingles(word, row, min_match)
        owner = row[at]
        first = np.searchsorted(owner, np.arange(len(ids) + 1))
        order = np.argsort(seed, kind="stable")
        self.ids, self.min_match = ids, min_match
        self.words = [word[a:b] for a, b in zip(cut, cut[1:])]
        self.seeds = [seed[a:b] for a, b in zip(first, first[1:])]
        self.sorted, self.owner = seed[order], owner[order]

    def matches(self, column: pa.Array, threshold: float):
        """``(row, item number, tiles, covered words)`` of a batch of texts."""
        word, row = _words(column)
        seed, at = ta.shingles(word, row, self.min_match)
        lo = np.searchsorted(self.sorted, seed, side="left")
        hit = lo < len(self.sorted)
        hit[hit] = self.sorted[lo[hit]] == seed[hit]
        lo, at, seed = lo[hit], at[hit], seed[hit]
        owner_row = row[at]
        cut = np.flatnonzero(np.diff(owner_row)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)]):
            if a == b:
                continue
            # the words under hits, in order, with a break (0) between runs
            here = at[a:b]
            gap = np.diff(here, prepend=here[0] - self.min_match - 1)
            places: dict[int, list[int]] = {}
            parts, size, origin = [], 0, []
            runs = np.flatnonzero(gap > self.min_match - 1).tolist()
            for r, (x, y) in enumerate(zip(runs, [*runs[1:], len(here)])):
                start, stop = int(here[x]), int(here[y - 1]) + self.min_match
                parts += [word[start:stop], np.zeros(1, np.uint64)]
                for k in range(x, y):
                    places.setdefault(int(seed[a + k]), []).append(size + int(here[k]) - start)
                origin.append((size, start))
                size += stop - start + 1
            doc = np.concatenate(parts)
            hi = np.searchsorted(self.sorted, np.unique(seed[a:b]), side="right")
            low = np.searchsorted(self.sorted, np.unique(seed[a:b]), side="left")
            some = np.unique(np.concatenate([self.owner[x:y] for x, y in zip(low, hi)]))
            shift = int(here[0]) - int(np.searchsorted(row, row[at[a]]))
            for i in some.tolist():
                seeds, item = self.seeds[i], self.words[i]
                under = np.zeros(len(item) + 1, dtype=np.int64)
                for k in np.flatnonzero([int(s) in places for s in seeds]).tolist():
                    under[k] += 1
                    under[k + self.min_match] -= 1
                if (np.cumsum(under)[:-1] > 0).sum() < threshold * len(item):
                    continue
                got = tiles(doc, item, places, seeds, self.min_match)
                covered = sum(t[2] for t in got)
                if covered >= threshold * len(item):
                    base = int(here[0]) - shift
                    starts = np.array([o[0] for o in origin])
                    spans = []
                    for x, j, n in sorted(got):
                        s, w = origin[int(np.searchsorted(starts, j, side="right")) - 1]
                        spans.append(f"{x}:{w + j - s - base}:{n}")
                    yield int(row[at[a]]), i, len(item), covered, ",".join(spans)


def item_blocks(benchmark: DataFrame, min_match: int = MIN_MATCH, block_seeds: int = BLOCK_SEEDS):
    """Yield ``Items`` of at most about ``block_seeds`` seeds each.

    The size is measured first (an upper bound of the words from the text
    length); the benchmark is then fetched block by block.
    """
    items = benchmark.select(F.col("item_id"), "text").where("text is not null").distinct()
    weight = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    n = max(1, int(-(-weight // block_seeds)))
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        got = (items if n == 1 else items.where(key == k)).orderBy("item_id", "text").toArrow()
        if got.num_rows:
            yield Items(got.column("item_id").to_pylist(), got.column("text").combine_chunks(), min_match)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                 min_match: int = MIN_MATCH) -> DataFrame:
    """One row per (document, item) whose coverage reaches the threshold:
    ``doc_id, item_id, item_words, covered_words, coverage, tiles`` with tiles
    as ``item word:document word:length``."""
    spark = docs.sparkSession
    schema = ("doc_id long, item_id long, item_words long, covered_words long, "
              "coverage double, tiles string")
    source = docs.select(F.col("doc_id").cast("long"), "text")
    found = []
    for block in item_blocks(benchmark, min_match):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            items = shared.value
            for part in ta.blocks(batches, "text"):
                ids = part.column(0).to_pylist()
                rows = [(ids[r], items.ids[i], n, c, c / n, t)
                        for r, i, n, c, t in items.matches(part.column(1), threshold)]
                if rows:
                    yield pa.RecordBatch.from_pylist(
                        [dict(zip(("doc_id", "item_id", "item_words", "covered_words", "coverage", "tiles"), r))
                         for r in rows],
                        schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()),
                                          ("item_words", pa.int64()), ("covered_words", pa.int64()),
                                          ("coverage", pa.float64()), ("tiles", pa.string())]))

        found.append(source.mapInArrow(run, schema))
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                      min_match: int = MIN_MATCH) -> DataFrame:
    """``docs`` without the rows that cover a test item; all columns kept."""
    spark = docs.sparkSession
    for block in item_blocks(benchmark, min_match):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            items = shared.value
            for part in ta.blocks(batches, "text"):
                text = part.column(part.schema.get_field_index("text"))
                bad = {r for r, *_ in items.matches(text, threshold)}
                yield part.filter(pa.array([r not in bad for r in range(part.num_rows)])) if bad else part

        docs = docs.mapInArrow(run, docs.schema)
    return docs
