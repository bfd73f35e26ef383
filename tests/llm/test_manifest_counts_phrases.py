"""Merkle manifest, token counts and phrase collocations against plain versions."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as E
from tessera.llm import collocations, manifest, queries, token_counts

from ..conftest import SF001
from . import brute
from .test_operators import EDGE, edge, none  # noqa: F401

MODEL = queries.tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, pos long, key int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows, parts=3):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame([(*r, "x", 0, 1) for r in rows], SCHEMA).repartition(parts)


MERKLE = ([(i, f"text {i}", "en", "src", i) for i in range(37)] + [(i, None, "de", None, None) for i in range(4)]
          + [(5, "same", None, "a", 1), (5, "same", None, "a", 1), (5, "other", None, "b", 2), (None, None, None, None, None),
             (None, "x", "fr", "", 0), (7, "", "", "é", 2**63 - 1), (8, "long " * 40000, "\U0001f600", "s", 5),
             (49, "1:2", "\uffff", "s", 5)])


@pytest.mark.parametrize("block", [2, 8, 2048])
def test_manifest(spark, block):
    want = brute.merkle([(d, s, la, n, t) for d, t, la, s, n in MERKLE])
    got = rows_of(manifest.tampering_audit(table(spark, MERKLE), block))
    assert got == want
    assert {r[-1] for r in got} == {True, False}


def test_manifest_edges(spark, edge, none):
    assert manifest.tampering_audit(none).count() == 0
    assert manifest.manifest(edge).count() == len(EDGE)
    one = table(spark, [(1, "only", "en", "s", 4)])
    assert rows_of(manifest.tampering_audit(one)) == brute.merkle([(1, "s", "en", 4, "only")])
    with pytest.raises(ValueError):
        manifest.manifest(one, block=6)


def test_manifest_proofs_lead_to_the_root(spark):
    docs = table(spark, MERKLE)
    got = manifest.manifest(docs, block=4, proofs=True).collect()
    assert all(r.verified and manifest.fold(r.leaf, list(r.proof)) == r.root for r in got)
    assert all(manifest.sha(*[s[1:] for s in r.proof]) == r.proof_sha256 for r in got)
    assert len({r.root for r in got}) == 1
    changed = manifest.manifest(table(spark, [*MERKLE[:-1], (49, "1:3", "\uffff", "s", 5)]), block=4).first().root
    assert changed != got[0].root


def counted(docs):
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=MODEL)
    out = []
    for i, t in docs:
        n = len(model.encode(t or ""))
        out.append((i, len((t or "").encode()), n, n > 4096))
    return sorted(out, key=str)


@pytest.mark.parametrize("head", [200_000, 20, 0])
def test_token_counts(edge, none, head):
    assert rows_of(token_counts.token_counts(edge, MODEL, head_rows=head)) == counted(EDGE)
    assert token_counts.token_counts(none, MODEL, head_rows=head).count() == 0


def test_token_counts_odd_texts(spark):
    r = random.Random(5)
    signs = " \n\t\x00ab1e9é▁漢\U0001f600<s>/ .,'" + "   "
    docs = [(k % 300, "".join(r.choice(signs) for _ in range(r.randint(0, 60)))) for k in range(400)]
    docs += [(None, "<s> </s> <unk> <0x0A> ▁▁ a"), (None, "word" * 5000), (1, " " * 3000), (1, "\n" * 3000)]
    df = spark.createDataFrame([(i, t, t, 1, "p") for i, t in docs],
                               "doc_id long, text string, pretoken string, part int, digest string").repartition(3)
    assert rows_of(token_counts.token_counts(df, MODEL, head_rows=50)) == counted(docs)


def test_token_counts_of_a_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = rows_of(E.queries()["op12_token_counts"](spark, SF001))
    assert got == counted([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_pretokens_and_their_frequencies(spark):
    docs = spark.createDataFrame([(1, "a b\nb b"), (2, "b")], "doc_id long, text string").coalesce(1)
    got = {r.pretoken: r.pieces for r in token_counts.frequent(docs, MODEL).collect()}
    assert got == {" b": 1}
    rows = {(r.doc_id, r.pretoken): r.n for r in token_counts.frequencies(docs, MODEL).collect()}
    assert rows == {(1, " a"): 1, (1, " b"): 2, (1, "\n"): 1, (1, "b"): 1, (2, " b"): 1}


def phrase_table(spark, docs, parts=3):
    return spark.createDataFrame([(i, t, la, "k", 3) for i, (la, t) in enumerate(docs)],
                                 "doc_id long, text string, lang string, phrase string, n int").repartition(parts)


def test_collocations(spark, edge, none):
    r = random.Random(9)
    few = ["aa", "b", "Cc", "d", "é", "x\x00y", "New", "York", "City", "\u3000"]
    gaps = [" ", "  ", "\t", ", ", ".\n", " - ", "!", "\x0b"]
    docs = [(r.choice(["en", "en", "de", None, "und", "und", ""]),
             "".join(r.choice(few) + r.choice(gaps[:3] * 3 + gaps) for _ in range(r.randint(0, 60)))) for _ in range(120)]
    docs += [("en", None), ("en", ""), (None, None), ("xx", "one two"), ("en", "new york city, " * 400), ("de", "w " * 3000)]
    got = rows_of(collocations.collocations(phrase_table(spark, docs)))
    assert got == sorted(brute.collocations(docs), key=str) and len(got) > 80
    got = rows_of(collocations.collocations(phrase_table(spark, docs), least=25, top=7, shards=2))
    assert got == sorted(brute.collocations(docs, 25, 7), key=str)
    assert collocations.collocations(none).count() == 0
    got = rows_of(collocations.collocations(edge))
    assert got == sorted(brute.collocations([("en", t) for _, t in EDGE]), key=str)


def test_collocations_in_one_shard_only(spark):
    """Nine times in one document, once elsewhere, between other words; and
    spread evenly, so that no shard has more than its share."""
    docs = [("en", "rare pair, " * 9 + "filler words here " * 50), ("en", "rare pair")]
    docs += [("en", f"even spread, a{i} b{i} c{i}") for i in range(10)]
    got = {r.phrase: r.a for r in collocations.collocations(phrase_table(spark, docs)).collect()}
    assert got["rare pair"] == 10 and got["even spread"] == 10


def test_collocation_scores_pass_64_bits(spark):
    a, b = 3_000_000_000_019, 2_999_999_999_989
    cands = spark.createDataFrame([("en", "x y", 2, b), ("en", "x y z", 3, b - 5)], "lang string, phrase string, size int, n long")
    single = spark.createDataFrame([("en", w, a) for w in "xyz"], "lang string, word string, n long")
    got = {r.phrase: r.score for r in collocations._scored(
        cands.union(spark.createDataFrame([("en", "y z", 2, b - 1)], cands.schema)), single).collect()}
    assert got["x y"] == 1000000 * b * b // (a * a)
    assert got["x y z"] == min(1000000 * (b - 5) ** 2 // (a * (b - 1)), 1000000 * (b - 5) ** 2 // (b * a))


def test_phrase_texts_and_counts_of_a_block():
    """Phrases are cut out of a block's bytes as a whole, and keys are counted by sorts of one cell's rows."""
    texts = ["Aa  b\té, x\x00y z", None, "", "one", "b é aa\nb é aa b \u3000q"]
    cells = pa.array([7, 3, 7, 3, 3], pa.int64())
    block, firsts = collocations._by_cell(pa.RecordBatch.from_arrays([cells, pa.array(texts)], names=["cell", "text"]))
    assert firsts.tolist() == [0, 3]
    b = collocations._Block(block)
    pieces = {7: [["aa", "b", "é"], ["x\x00y", "z"]], 3: [["one"], ["b", "é", "aa"], ["b", "é", "aa", "b", "\u3000q"]]}
    for size in (1, 2, 3):
        want = Counter((c, " ".join(w[i:i + size])) for c, ps in pieces.items() for w in ps for i in range(len(w) - size + 1))
        key, at = b.grams(size)
        got = b.texts(at, size)
        got.validate(full=True)
        cell = np.array([3, 3, 3, 7, 7], np.uint64)
        assert Counter(zip(cell[b.row[at]].tolist(), got.to_pylist())) == want
        keys, n, row = collocations._counted(key, b.row[at], cell, firsts)
        assert Counter(zip(cell[row].tolist(), n.tolist())) == Counter((c, k) for (c, _), k in want.items())
        assert len(set(keys.tolist())) == len(want)
    assert b.texts(np.zeros(0, np.int64), 2).to_pylist() == []
