"""Spans that the boosted trees add, and look-alikes that they leave."""

import random
import re

from pyspark.sql import functions as F

from tessera.llm import pii

from . import brute


def luhn16(r):
    while True:
        n = "".join(r.choice("0123456789") for _ in range(16))
        if brute.luhn(n):
            return n


def corpus(n=400, seed=5):
    """Texts with a true candidate of some kind or a look-alike of it, and the
    added spans that are expected."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    out = []
    for k in range(n):
        kind = ("email", "ip", "card", "phone")[k % 4]
        true = k // 4 % 2 == 0
        if kind == "email":
            s = f"{word()}{r.choice(['(at)', '[at]', ' (at) '])}{word()}" + (f"{r.choice(['.', '[dot]'])}org" if true else "[dot]7")
            lead = "please write an e-mail to"
        elif kind == "ip":
            s = ":".join("%x" % r.randint(4096, 65535) for _ in range(8)) if true else ":".join("%02d" % r.randint(10, 59) for _ in range(5))
            lead = "the host has address" if true else "it ran from"
        elif kind == "card":
            d = luhn16(r) if true else "".join(r.choice("0123456789") for _ in range(16))
            if not true and brute.luhn(d):
                d = d[:-1] + str((int(d[-1]) + 1) % 10)
            s = ".".join(d[i:i + 4] for i in range(0, 16, 4))
            lead = "paid with card" if true else "part number"
        else:
            s = f"{r.randint(200, 999)} {r.randint(200, 999)} {r.randint(1000, 9999)}"
            lead = "call me by phone" if true else "it measures"
        text = f"{word()} {word()} {lead} {s} and {word()} é {word()}."
        at = text.index(s)
        out.append((k, text, f"{kind}:{at}:{at + len(s)}" if true else ""))
    return out


def test_added_spans_and_lookalikes(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.base_sha256) for r in pii.personal_data(docs).collect()}
    right = sum(got[i][0] == want for i, _, want in rows)
    added_lookalikes = sum(bool(got[i][0]) for i, _, want in rows if not want)
    assert right >= 0.97 * len(rows) and added_lookalikes <= 0.03 * len(rows)
    for kind in ("email", "ip", "card", "phone"):
        mine = [(i, w) for i, _, w in rows if w.startswith(kind)]
        assert sum(got[i][0] == w for i, w in mine) >= 0.9 * len(mine), kind
    assert {got[i][1] for i, _, _ in rows} == {brute.pii("")[1]}     # none of them is a base span


def test_added_spans_are_free_candidates(spark):
    """Whatever is added is a match of a generator in plain ``re``, overlaps no
    base span and no other added one."""
    rows = corpus(200, 9)
    texts = [f"{a[1]} {b[1]} 10.0.0.{k % 255} x@y.de token={'ab12' * 6}" for k, (a, b) in enumerate(zip(rows, rows[1:]))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = 0
    for r in pii.personal_data(docs).collect():
        text = texts[r.doc_id]
        base = set(brute.pii(text)[2])
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert base <= {":".join(s) for s in spans}
        added = [(k, int(a), int(b)) for k, a, b in spans if f"{k}:{a}:{b}" not in base]
        taken = [(int(b.split(":")[1]), int(b.split(":")[2])) for b in base]
        for k, a, b in added:
            plain = re.compile(pii.GENERATORS[k])       # possessive repeats are known to re from Python 3.11 on
            assert (a, b) in {m.span() for m in plain.finditer(text)}, (k, text[a:b])
            assert all(b <= x or y <= a for x, y in taken)
            taken.append((a, b))
        some += len(added)
    assert some > 100


def test_columns_of_the_trees_score_like_the_model(spark):
    """The column expressions give the probabilities of the fitted model."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(120, 3)], "doc_id long, text string")
    data = VectorAssembler(inputCols=list(pii.FEATURES), outputCol="features").transform(pii.training_rows(docs))
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=7).fit(data)
    x = {k: F.col(k) for k in pii.FEATURES}
    total = sum((w * pii._tree(t.rootNode(), x) for t, w in zip(model._java_obj.trees(), model.treeWeights)), F.lit(0.0))
    both = model.transform(data).select(
        vector_to_array("probability")[1].alias("p"), (1.0 / (1.0 + F.exp(-2.0 * total))).alias("q"))
    assert both.where("abs(p - q) > 1e-9").count() == 0 and both.count() > 50


def test_kind_without_positives_adds_nothing():
    assert pii._threshold([{"bin": 49, "fold": 0, "pos": 4, "n": 4}]) == 2.0
    assert pii._threshold([{"bin": 49, "fold": 0, "pos": 40, "n": 41}, {"bin": 3, "fold": 1, "pos": 0, "n": 9}]) == 49 / 50
    assert pii._threshold([{"bin": 40, "fold": 0, "pos": 5, "n": 9}]) == 2.0
