"""Token counts of whole texts without ever holding their ids.

A SentencePiece BPE model joins neighbouring symbols only into pieces of its
vocabulary, so wherever no piece holds the two characters at a border, the text
can be cut and the parts counted by themselves.  ``Borders`` reads those places
from the vocabulary: before every run of blanks, and on both sides of a
character that stands in no longer piece (digits, line ends, other controls).
The parts are the pre-tokens.

1. ``frequent``: the most frequent pre-tokens (at most ``HEAD_ROWS``), each
   through the model once.  Which ones these are decides only how rows travel:
   a task proposes those that it meets ``PROPOSED`` times in a block.
2. ``frequencies`` has one row per document and distinct pre-token.  Rows of
   frequent pre-tokens are joined with their broadcast counts and summed where
   they arise, so no hot pre-token is ever a key of a shuffle.
3. The rare rest is dealt by pre-token: where its rows meet, each pre-token
   goes through the model once and its count is multiplied into them (a join of
   counts and frequencies in one shuffle; AQE may split a large partition).
4. Both parts are summed per document.

A document is known by its id and the hash of its text; equal rows share a sum,
which is divided by their number, and get one result row each.

Defined results: null and empty texts have no bytes and no tokens; null and
repeated ids are counted like any other row; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import text_arrays as ta
from tessera.session import materialize

LIMIT = 4096
#: Rows of the broadcast table of frequent pre-tokens at most.
HEAD_ROWS = 500_000
#: Occurrences in a block of texts that make a pre-token a proposal.
PROPOSED = 2
#: Counts of rare pre-tokens that a task keeps.
CACHED = 500_000
BLANK = "▁"


class Borders:
    """Where a model's texts can be cut, and the token count of a part."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())
                  if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        longer = [p for p in pieces if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in longer):
            raise ValueError("a piece of the model spans a blank inside: texts cannot be cut before blanks")
        if self.model.encode("a  b ", out_type=str) == self.model.encode("a b", out_type=str):
            raise ValueError("the model drops blanks: texts cannot be cut as they are")
        inside = set("".join(longer)) | {" "}
        self.solo = np.zeros(256, dtype=bool)
        self.solo[[c for c in range(128) if chr(c) not in inside]] = True
        #: A line end stands alone in front of every part, in place of the blank that the model puts first.
        if not self.solo[10]:
            raise ValueError("the model has pieces with line ends")
        self.front = len(self.model.encode("\n"))

    def spans(self, data: np.ndarray, bounds: np.ndarray):
        """Starts, ends and row numbers of the pre-tokens of texts, each of
        which (empty ones excepted) begins with the model's own blank."""
        blank = data == 0x20
        start = self.solo[data]
        start[1:] |= self.solo[data[:-1]] | (blank[1:] & ~blank[:-1])
        start[bounds[:-1][bounds[:-1] < len(data)]] = True
        at = np.flatnonzero(start)
        return at, np.append(at[1:], len(data)), np.searchsorted(bounds, at, side="right") - 1

    def count(self, parts: list[str]) -> list[int]:
        return [len(x) - self.front for x in self.model.encode(["\n" + p for p in parts], num_threads=1)]


_borders: dict[str, Borders] = {}


def _model(path: str) -> Borders:
    if path not in _borders:
        _borders[path] = Borders(path)
    return _borders[path]


def _blanked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a blank in front of those that are not empty, and the
    model's own sign for a blank as one."""
    texts = [" " + t.replace(BLANK, " ") if t else "" for t in column.to_pylist()]
    low = [t.encode() for t in texts]
    return np.frombuffer(b"".join(low), dtype=np.uint8), np.append(0, np.cumsum([len(x) for x in low])).astype(np.int64)


def _distinct(data, at, ends):
    """Distinct spans as an Arrow array, and the number of each span's."""
    key = ta.span_hash(ta.prefix_hash(data), at, ends)
    _, sample, inverse = np.unique(key, return_index=True, return_inverse=True)
    raw = data.tobytes()
    return pa.array([raw[a:b].decode() for a, b in zip(at[sample].tolist(), ends[sample].tolist())], pa.string()), inverse


def _pieces(model_path: str, most: int):
    """A function from distinct pre-tokens to their token counts that keeps
    up to ``most`` of the counts."""
    known: dict[str, int] = {}

    def of(words: list[str]) -> list[int]:
        if len(known) > most:
            known.clear()
        new = [w for w in words if w not in known]
        known.update(zip(new, _model(model_path).count(new)))
        return [known[w] for w in words]

    return of


def frequent(docs: DataFrame, model_path: str, rows: int = HEAD_ROWS) -> DataFrame:
    """``pretoken, pieces`` of at most ``rows`` frequent pre-tokens."""
    def parts(batches):
        for block in ta.blocks(batches, "text"):
            data, bounds = _blanked(block.column(0))
            if len(data):
                at, ends, _ = _model(model_path).spans(data, bounds)
                key = ta.span_hash(ta.prefix_hash(data), at, ends)
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                first, n = first[n >= PROPOSED], n[n >= PROPOSED]
                raw = data.tobytes()
                words = [raw[a:b].decode() for a, b in zip(at[first].tolist(), ends[first].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n)], names=["pretoken", "n"])

    def pieces(batches):
        for b in batches:
            count = _model(model_path).count(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64())], names=["pretoken", "pieces"])

    found = materialize(docs.select("text").mapInArrow(parts, "pretoken string, n long")
                        .groupBy("pretoken").agg(F.sum("n").alias("n")))
    # the smallest power of two that not more than ``rows`` of them reach
    sizes = dict(found.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect())
    total, least = 0, 1 << (max(sizes, default=0) + 1)
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > rows:
            break
        least = 1 << k
    return materialize(found.where(F.col("n") >= least).select("pretoken").mapInArrow(
        pieces, "pretoken string, pieces long"))


def frequencies(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, digest, pretoken, n``: how often each pre-token of a document
    stands in it."""
    def run(batches):
        for block in ta.blocks(batches, "text"):
            data, bounds = _blanked(block.column(2))
            if not len(data):
                continue
            at, ends, row = _model(model_path).spans(data, bounds)
            words, number = _distinct(data, at, ends)
            pair, n = np.unique(row * len(words) + number, return_counts=True)
            of = pa.array(pair // len(words))
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(of), block.column(1).take(of), words.take(pa.array(pair % len(words))), pa.array(n)],
                names=["doc_id", "digest", "pretoken", "n"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), "text").mapInArrow(
        run, "doc_id long, digest long, pretoken string, n long")


def _counted(rows: DataFrame, model_path: str) -> DataFrame:
    """Rows of rare pre-tokens, dealt by pre-token, with their tokens."""
    def run(batches):
        of = _pieces(model_path, CACHED)
        for b in batches:
            words = b.column(2).dictionary_encode()
            count = np.array(of(words.dictionary.to_pylist()), dtype=np.int64)
            tokens = count[words.indices.to_numpy()] * b.column(3).to_numpy() if len(count) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens)],
                                             names=["doc_id", "digest", "tokens"])

    return rows.hint("rebalance", "pretoken").mapInArrow(run, "doc_id long, digest long, tokens long")


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT, head_rows: int = HEAD_ROWS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``."""
    zero = F.lit(0).cast("long")
    head = F.broadcast(frequent(docs, model_path, head_rows))
    rows = frequencies(docs, model_path)
    often = rows.join(head, "pretoken").select("doc_id", "digest", (F.col("n") * F.col("pieces")).alias("tokens"))
    rare = _counted(rows.join(head, "pretoken", "left_anti").select("doc_id", "digest", "pretoken", "n"), model_path)
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), zero.alias("tokens"),
                      F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                      F.lit(1).cast("long").alias("copies"))
    sums = own.unionByName(often.unionByName(rare).select("*", zero.alias("n_bytes"), zero.alias("copies"))) \
        .groupBy("doc_id", "digest").agg(F.sum("tokens").alias("tokens"), F.max("n_bytes").alias("n_bytes"),
                                         F.sum("copies").alias("copies"))
    return (sums.select("doc_id", "n_bytes", F.expr("tokens div copies").alias("n_tokens"),
                        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
