"""Toxicity by multiple-instance learning (noisy-or over sentences).

A document is a bag of sentences.  A sentence's probability is a logistic
function of its hashed word features, 0 without a feature that has a weight
(plain sentences add nothing, however many); the document's is the noisy-or
``1 - prod(1 - p_sentence)``.  Only document labels are known: the weights
are fitted by maximising the document likelihood, whose gradient reaches
each sentence in proportion to its share of the blame, so that the fitted
sentence scores also locate the offending sentences.

Training uses a bounded sample of labelled rows (``TRAIN_ROWS``, the rows
with the smallest hash of their id); scoring covers every row and whole
texts.  Labels, language, source and id are never features.

Defined results: null and empty texts have no sentence and get the score of
an empty bag (0.0); null ids are scored and never held out nor trained on;
repeated rows are scored each; an empty label table (or one class only)
gives score 0.0 everywhere; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import text_arrays as ta
from tessera.session import materialize

BUCKETS = 1 << 20
TRAIN_ROWS = 12_000
FOLDS = 5
EPOCHS = 200
MIN_ROWS = 3
MIN_Z = 3.0
PREFIXES = (4, 6)
BLOCK_BYTES = 1 << 20
U64 = np.uint64

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 33, 46, 63]] = True  # newline ! . ?


def features(column: pa.Array):
    """Feature buckets of every sentence of a batch of texts.

    Returns ``(sentence, bucket, sent_row, sent_start, sent_end)``: parallel
    arrays of (sentence number, bucket), and each sentence's row and byte
    span inside its row.  Sentences end at ``. ! ?`` or a line break; those
    without a word do not count.  Features are whole words and their first
    4 and 6 bytes, lower-cased in ASCII.
    """
    data, bounds = ta.flat(column)
    low = ta.lower_ascii(data)
    starts, ends = ta.runs(_WORD[low], bounds)
    row = np.searchsorted(bounds, starts, side="right") - 1
    mark = np.cumsum(_STOP[low])
    seq = mark[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (seq[1:] != seq[:-1]) | (row[1:] != row[:-1])
    sent = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    prefix = ta.prefix_hash(low)
    hashed = [ta.span_hash(prefix, starts, ends)]
    which = [sent]
    for size in PREFIXES:
        at = np.flatnonzero(ends - starts > size)
        hashed.append(ta.mix64(ta.span_hash(prefix, starts[at], starts[at] + size) + U64(size)))
        which.append(sent[at])
    bucket = (np.concatenate(hashed) & U64(BUCKETS - 1)).astype(np.int64)
    base = bounds[row[first]]
    return (np.concatenate(which), bucket, row[first], starts[first] - base, ends[last] - base)


def _sentence_scores(weights, bias, sent, bucket, n):
    z = np.bincount(sent, weights=weights[bucket], minlength=n) + bias
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_noisy_or(bags: list[np.ndarray], sents: list[np.ndarray], labels: np.ndarray,
                 epochs: int = EPOCHS, rate: float = 0.5, l2: float = 1e-5):
    """Full-batch Adagrad on the noisy-or likelihood; ``(weights, bias)``.

    ``bags[i]``/``sents[i]``: bucket and local sentence number of document i.
    Only buckets that stand in ``MIN_ROWS`` documents and are more frequent
    among the toxic ones by ``MIN_Z`` standard errors get a weight.
    """
    y = labels.astype(float)
    seen = np.zeros((2, BUCKETS))
    for bag, label in zip(bags, labels):
        seen[int(label), np.unique(bag)] += 1
    total, share = seen.sum(0), y.mean()
    z = (seen[1] - total * share) / np.sqrt(np.maximum(total * share * (1 - share), 1e-9))
    useful = (total >= MIN_ROWS) & (z > MIN_Z)
    sents = [s[useful[b]] for s, b in zip(sents, bags)]
    bags = [b[useful[b]] for b in bags]
    # sentences without such a bucket score 0 here and in _log_clean: they are not counted
    sents = [np.unique(s, return_inverse=True)[1] for s in sents]
    counts = np.array([int(s.max()) + 1 if len(s) else 0 for s in sents])
    offset = np.concatenate([[0], np.cumsum(counts)])
    bucket = np.concatenate(bags).astype(np.int64)
    sent = np.concatenate([s + o for s, o in zip(sents, offset)]).astype(np.int64)
    doc = np.repeat(np.arange(len(bags)), counts)
    used, col = np.unique(bucket, return_inverse=True)
    w, b = np.zeros(len(used)), -6.0
    gw, gb = np.full(len(used), 1e-8), 1e-8
    n_sent = int(offset[-1])
    for _ in range(epochs):
        p = _sentence_scores(w, b, sent, col, n_sent)
        log_keep = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(bags))
        clean = np.exp(log_keep)                       # prod(1 - p)
        toxic = np.maximum(1 - clean, 1e-9)
        # d logL / dz_s = p_s * (clean / toxic) for label 1, -p_s for label 0
        blame = np.where(y == 1, clean / toxic, -1.0)[doc] * p
        g = np.bincount(col, weights=blame[sent], minlength=len(used)) / len(bags) - l2 * w
        gw += g * g
        w += rate * g / np.sqrt(gw)
        step = blame.sum() / len(bags)
        gb += step * step
        b += 0.2 * step / np.sqrt(gb)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[used] = w
    return weights, float(b)


def fold_of(doc_id):
    """crc32 of the id as text, modulo the number of folds (null stays null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
    """Fit on at most ``rows`` labelled documents outside fold 0.

    The sample is taken by the smallest hash of the id; an id with both labels
    counts as 0.  The documents of either label that hold a bucket are counted
    in Spark; only occurrences of buckets that get a weight come to the driver.
    Returns None when a class is missing.
    """
    known = (labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"))
             .where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"))
             .where(fold_of(F.col("_id")) != 0)
             .withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(rows))
    picked = (docs.select(F.col("doc_id").alias("_id"), "text")
              .join(F.broadcast(known), "_id").select("_id", "text", "_y"))

    def count(batches):
        """Documents by label that hold a bucket; bucket -1 counts them all."""
        for part in ta.blocks(batches, "text", BLOCK_BYTES):
            sent, bucket, sent_row, _, _ = features(part.column(1))
            y = part.column(2).to_numpy(zero_copy_only=False)
            pair = np.unique((sent_row[sent].astype(np.int64) << 20) | bucket) if len(sent) else np.zeros(0, np.int64)
            held = np.concatenate([pair & (BUCKETS - 1), np.full(len(y), -1)])
            label = np.concatenate([y[pair >> 20], y])
            found, at = np.unique(held, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(np.bincount(at)), pa.array(np.bincount(at, weights=label).astype(np.int64))],
                names=["bucket", "n", "toxic"])

    seen = materialize(picked.mapInArrow(count, "bucket long, n long, toxic long").groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic")))
    whole = seen.where("bucket = -1").first()
    if whole is None or whole["toxic"] in (0, whole["n"]):
        return None
    share = whole["toxic"] / whole["n"]
    # fit_noisy_or decides by the same rule; a margin leaves rounding to it
    z = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    picks = seen.where((F.col("bucket") >= 0) & (F.col("n") >= MIN_ROWS) & (z > MIN_Z - 0.01))
    useful = np.zeros(BUCKETS, dtype=bool)
    useful[[r["bucket"] for r in picks.select("bucket").toLocalIterator()]] = True
    useful = docs.sparkSession.sparkContext.broadcast(useful)

    def featurize(batches):
        for part in ta.blocks(batches, "text", BLOCK_BYTES):
            sent, bucket, sent_row, _, _ = features(part.column(1))
            sent, bucket = sent[useful.value[bucket]], bucket[useful.value[bucket]]
            base = np.searchsorted(sent_row, np.arange(part.num_rows))
            owner = sent_row[sent] if len(sent) else np.zeros(0, np.int64)
            key = np.unique((sent.astype(np.int64) << 20) | bucket)
            owner = sent_row[key >> 20] if len(key) else owner[:0]
            cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
            local = ((key >> 20) - base[owner]).astype(np.int32) if len(key) else np.zeros(0, np.int32)
            feat = (key & (BUCKETS - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(2).cast(pa.int32()),
                pa.array([feat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                pa.array([local[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
            ], names=["y", "feat", "sent"])

    got = picked.mapInArrow(featurize, "y int, feat binary, sent binary").toPandas()
    y = got["y"].to_numpy()
    return fit_noisy_or([np.frombuffer(x, np.int32) for x in got["feat"]],
                        [np.frombuffer(x, np.int32) for x in got["sent"]], y)


def _log_clean(fitted, sent, bucket, sent_row, rows):
    """Sentence scores, and each row's log of the probability that none is toxic."""
    if fitted is None:
        return np.zeros(len(sent_row)), np.zeros(rows)
    key = np.unique((sent.astype(np.int64) << 20) | bucket)
    key = key[fitted[0][key & (BUCKETS - 1)] != 0]
    p = np.zeros(len(sent_row))
    some, at = np.unique(key >> 20, return_inverse=True)
    p[some] = _sentence_scores(fitted[0], fitted[1], at, key & (BUCKETS - 1), len(some))
    return p, np.bincount(sent_row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=rows)


def score(docs: DataFrame, model) -> DataFrame:
    """``doc_id, score, n_sentences, offending``: noisy-or score of each whole
    text, and the byte spans ``start:end`` of the sentences at 0.5 or more."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def run(batches):
        fitted = shared.value
        for part in ta.blocks(batches, "text", BLOCK_BYTES):
            sent, bucket, sent_row, a, b = features(part.column(1))
            rows = part.num_rows
            p, keep = _log_clean(fitted, sent, bucket, sent_row, rows)
            bad = np.flatnonzero(p >= 0.5)
            found: list[list[str]] = [[] for _ in range(rows)]
            for s in bad.tolist():
                found[sent_row[s]].append(f"{a[s]}:{b[s]}")
            yield pa.RecordBatch.from_arrays([
                part.column(0).cast(pa.int64()), pa.array(1 - np.exp(keep)),
                pa.array(np.bincount(sent_row, minlength=rows).astype(np.int64)),
                pa.array([",".join(x) for x in found], pa.string()),
            ], names=["doc_id", "score", "n_sentences", "offending"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, score double, n_sentences long, offending string")


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored ``threshold`` or more; all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def run(batches):
        fitted = shared.value
        for part in ta.blocks(batches, "text", BLOCK_BYTES):
            if fitted is not None:
                sent, bucket, sent_row, _, _ = features(part.column(part.schema.get_field_index("text")))
                clean = np.exp(_log_clean(fitted, sent, bucket, sent_row, part.num_rows)[1])
                part = part.filter(pa.array(1 - clean < threshold))
            yield part

    return docs.mapInArrow(run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Train on the labelled sample, then score every document."""
    out = score(docs, train(docs, labels, rows))
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                      "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      "n_sentences", "offending")
