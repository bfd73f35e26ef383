"""Personal data: candidate generation, boosted trees, calibrated thresholds
(DataFrame functions and pyspark.ml only).

Base patterns (e-mail, IP, card, phone) find spans that always stay.  Looser
generators propose further, overlapping candidates (obfuscated e-mails, IPv6,
grouped card and phone numbers, secrets); gradient-boosted trees score them
by format and context, and those above their kind's threshold, calibrated to
``PRECISION`` on held-out candidates of the kind, are added where they overlap
neither a base span nor a better candidate.

The trees are fitted, and the thresholds calibrated, on the candidates of all
documents with an id; candidates of equal features, label and fold are one row
with their number as weight.  There are no span labels, so the labels are rules
that the features do not see whole.  1 is a candidate that is or covers a valid base span; an obfuscated e-mail whose host ends in a domain
of letters once its marks are undone; an IPv6 address of eight groups; a
grouped card number that passes Luhn; a phone number without ``+`` of 9 to 15
digits behind a word for phones; a secret with a known prefix or behind a word
for secrets.  All others are 0.  A kind with fewer than ``LEAST_POSITIVE`` ones
among its candidates adds nothing.
The fitted trees are turned into column expressions, so that scoring stays
inside the row: one scan, no explode, no shuffle.

Positions are code points, ends exclusive.  Defined results: null and empty
texts have no span; null ids and repeated rows are handled like any other
row; an empty table gives no rows, and if there is no candidate of one
of the two labels nothing is added to the base spans; extra columns are
ignored, or kept by ``redact``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import materialize

#: Distinct candidates a task of the fit.
TASK_ROWS = 50_000
TREES = 12
DEPTH = 3
PRECISION = 0.95
LEAST_POSITIVE = 5

#: Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone", "secret")

#: The base patterns, with possessive repeats and a guard at the start: the
#: same matches as the plain ones, in linear time and without deep recursion.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

#: Generators of further candidates.
TOKEN = "[A-Za-z0-9+/_=-]"
GENERATORS = {
    "email": (rf"(?<!{LOCAL}){LOCAL}++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++"
              r"(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"),
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ./-][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9(.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
    "secret": rf"(?<!{TOKEN})(?=[A-Za-z+/_=-]*+[0-9]){TOKEN}{{16,}}+",
}
SECRET_MARK = r"^(AKIA[0-9A-Z]{16}|(password|passwd|token|secret|api_key)=.{6,})$"
SECRET_BEFORE = r"(password|passwd|token|secret|api_key) ?[=:] ?\"?$"
CONTEXT = (r"(?i)(e-?mail|phone|call|tel\.?|mobile|card|visa|account|\bip\b|host|address|password|passwd|token"
           r"|secret|key|login|user)")
#: Words for a kind, in the order of KINDS.
OWN_CONTEXT = (r"(?i)(e-?mail|contact|write|address)", r"(?i)(\bip\b|\bipv6\b|host|server|address|login)",
               r"(?i)(card|visa|account|payment)", r"(?i)(phone|call|tel\b|mobile|fax)",
               r"(?i)(password|passwd|token|secret|key|login)")
PHONE_BEFORE = r"(?i)\b(phone|call|tel|mobile|fax)\b[^A-Za-z]*$"
FEATURES = ("kind", "length", "digits", "letters", "upper", "other", "groups", "hex", "context", "own_context",
            "joined_before", "joined_after", "distinct")
NEAR = 24


def found(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, s>>`` of the leftmost non-overlapping matches."""
    parts = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
                       lambda s, gap: F.struct(s.alias("s"), F.length(gap).alias("gap")))
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")

    def add(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["s"])
        span = F.struct(start.alias("start"), end.alias("end"), x["s"].alias("s"))
        return F.when(x["s"].isNull(), acc).otherwise(
            F.struct(end.alias("at"), F.concat(acc["got"], F.array(span)).alias("got")))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("got")), add, lambda acc: acc["got"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


_VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.rlike(s, F.lit(OCTETS)),
    "card": lambda s: F.length(_digits(s)).between(13, 19) & F.call_function("luhn_check", _digits(s)),
    "phone": lambda s: F.length(_digits(s)).between(9, 15),
}


def _kinded(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s")))


def with_spans(docs: DataFrame) -> DataFrame:
    """Add ``_raw`` (base matches before validation), ``_base`` (valid ones) and
    ``_more`` (candidates of the generators): arrays of (kind, start, end, s)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,s:string>>")
    digit, at = F.rlike(text, F.lit("[0-9]")), F.contains(text, F.lit("@"))
    gate = {"email": at, "ip": digit, "card": digit, "phone": digit & F.contains(text, F.lit("+"))}
    hint = {"email": F.rlike(text, F.lit(r"[\[(] ?(?:at|AT) ?[\])]"))}
    raw = [F.when(gate[k], _kinded(found(text, p), k)).otherwise(none) for k, p in BASE.items()]
    more = [F.when(hint.get(k, digit), _kinded(found(text, p), k)).otherwise(none) for k, p in GENERATORS.items()]
    docs = docs.withColumns({"_raw": F.concat(*raw), "_more": F.concat(*more)})
    valid = lambda x: reduce(
        lambda a, b: a | b, [(x["kind"] == KINDS.index(k)) & f(x["s"]) for k, f in _VALID.items()])
    return docs.withColumn("_base", F.filter("_raw", valid))


def _features(x: Column, text: Column) -> dict[str, Column]:
    s = x["s"]
    near = F.substring(text, F.greatest(x["start"] - NEAR + 1, F.lit(1)), F.least(x["start"], F.lit(NEAR)))
    after = F.substring(text, x["end"] + 1, F.lit(1))
    count = lambda p: F.regexp_count(s, F.lit(p)).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "kind": x["kind"].cast("double"), "length": F.length(s).cast("double"),
        "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "upper": count("[A-Z]"),
        "other": count("[^A-Za-z0-9]"), "groups": count("[0-9]+"),
        "hex": flag(F.rlike(s, F.lit("^[0-9a-f]+$"))),
        "context": flag(F.rlike(near, F.lit(CONTEXT))),
        "own_context": flag(F.rlike(near, F.element_at(F.array(*(F.lit(c) for c in OWN_CONTEXT)), x["kind"] + 1))),
        "joined_before": flag(F.rlike(near, F.lit(r"[\p{L}\p{N}]$"))),
        "joined_after": flag(F.rlike(after, F.lit(r"^[\p{L}\p{N}]"))),
        "distinct": F.size(F.array_distinct(F.split(s, ""))).cast("double"),
    }


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def undone(s: Column) -> Column:
    """An obfuscated e-mail with its marks as signs again."""
    plain = F.regexp_replace(s, r" ?[\[(] ?(?:at|AT) ?[\])] ?", "@")
    return F.regexp_replace(plain, r" ?[\[(] ?(?:dot|DOT) ?[\])] ?", ".")


#: Which candidates of the generators are labelled 1, by text and what stands before.
_TRUE = {
    "email": lambda s, near: F.rlike(undone(s), F.lit(rf"^{LOCAL}+@([A-Za-z0-9-]+\.)+[A-Za-z]{{2,}}$")),
    "ip": lambda s, near: F.regexp_count(s, F.lit(":")) == 7,
    "card": lambda s, near: _VALID["card"](s),
    "phone": lambda s, near: _VALID["phone"](s) & F.rlike(near, F.lit(PHONE_BEFORE)),
    "secret": lambda s, near: F.rlike(s, F.lit(SECRET_MARK)) | F.rlike(near, F.lit(SECRET_BEFORE)),
}


def training_rows(docs: DataFrame) -> DataFrame:
    """``features..., label, fold, n``: the candidates of all documents with an
    id; ``n`` of them are equal in all of these."""
    picked = with_spans(docs.select("doc_id", "text").where("doc_id is not null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    near = lambda x: F.substring(
        text, F.greatest(x["start"] - NEAR + 1, F.lit(1)), F.least(x["start"], F.lit(NEAR)))

    def row(generated):
        def made(x):
            label = F.exists("_base", lambda b: (b["start"] >= x["start"]) & (b["end"] <= x["end"]))
            if generated:
                label = label | reduce(lambda a, b: a | b, [
                    (x["kind"] == KINDS.index(k)) & rule(x["s"], near(x)) for k, rule in _TRUE.items()])
            return F.struct(*(c.alias(k) for k, c in _features(x, text).items()),
                            F.when(label, 1.0).otherwise(0.0).alias("label"))
        return made

    every = F.concat(F.transform("_raw", row(False)), F.transform("_more", row(True)))
    return (picked.select(F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("fold"),
                          F.explode(every).alias("c"))
            .select("c.*", (F.col("fold") % 5).alias("fold"))
            .groupBy(*FEATURES, "label", "fold").agg(F.count("*").cast("double").alias("n")))


def _tree(node, x: dict[str, Column]) -> Column:
    """A fitted regression tree as a column expression."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(x[FEATURES[split.featureIndex()]] <= float(split.threshold()),
                  _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


def _threshold(bins: list) -> float:
    """The lowest limit above which ``PRECISION`` of a kind's candidates are
    ones; on the held-out fold if it has ``LEAST_POSITIVE`` of them, else on all.
    2 (nothing is added) if there are fewer, or no limit is as precise."""
    held = [b for b in bins if b["fold"] == 0]
    held = held if sum(b["pos"] for b in held) >= LEAST_POSITIVE else bins
    threshold, pos, n = 2.0, 0.0, 0
    if sum(b["pos"] for b in held) < LEAST_POSITIVE:
        return threshold
    for k in range(50, -1, -1):
        here = [b for b in held if b["bin"] == k]
        pos, n = pos + sum(b["pos"] for b in here), n + sum(b["n"] for b in here)
        if here and pos >= PRECISION * n:
            threshold = k / 50
    return threshold


def fit(docs: DataFrame):
    """``(trees, weights, thresholds by kind)``, or None if a label is missing."""
    data = materialize(training_rows(docs))
    sizes = {r["label"]: r["n"] for r in data.where("fold <> 0").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data)
    parts = max(2, sum(sizes.values()) // TASK_ROWS)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1, weightCol="n").fit(
        vectors.where("fold <> 0").repartition(parts, F.hash(*FEATURES)))
    scored = model.transform(vectors).select(
        "kind", "label", "fold", "n", F.floor(vector_to_array("probability")[1] * 50).cast("int").alias("bin"))
    bins = scored.groupBy("kind", "bin", "fold").agg(
        F.sum(F.col("label") * F.col("n")).alias("pos"), F.sum("n").alias("n")).collect()
    thresholds = [_threshold([b for b in bins if b["kind"] == k]) for k in range(len(KINDS))]
    # trees add up to half the log-odds
    java = model._java_obj.trees()
    return [t.rootNode() for t in java], list(model.treeWeights), thresholds


def pii_spans(docs: DataFrame, model) -> DataFrame:
    """Add ``_base`` and ``_spans``, arrays of (kind, start, end), by kind and start."""
    docs = with_spans(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    if model is None:
        docs = docs.withColumn("_added", F.array().cast("array<struct<kind:int,start:int,end:int>>"))
    else:
        trees, weights, thresholds = model
        limit = lambda x: F.element_at(F.array(*(F.lit(t) for t in thresholds)), x["kind"] + 1)
        free = F.filter("_more", lambda x: ~F.exists("_base", lambda b: _overlaps(x, b)))
        docs = docs.withColumn("_more", F.transform(free, lambda x: F.struct(
            x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
            F.struct(*(c.alias(k) for k, c in _features(x, text).items())).alias("f"))))

        def score(x):
            f = {k: x["f"][k] for k in FEATURES}
            return 1.0 / (1.0 + F.exp(-2.0 * sum((w * _tree(t, f) for t, w in zip(trees, weights)), F.lit(0.0))))

        docs = docs.withColumn("_more", F.filter(F.transform("_more", lambda x: F.struct(
            x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score(x).alias("p"))),
            lambda x: x["p"] >= limit(x)))
        better = lambda a, b: (a["p"] > b["p"]) | ((a["p"] == b["p"]) & (
            (a["end"] - a["start"] > b["end"] - b["start"])
            | ((a["end"] - a["start"] == b["end"] - b["start"]) & (
                (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"]))))))
        docs = docs.withColumn("_added", F.transform(F.filter("_more", lambda x: ~F.exists(
            "_more", lambda y: _overlaps(x, y) & better(y, x))), plain))
    return (docs.withColumn("_base", F.sort_array(F.transform("_base", plain)))
            .withColumn("_spans", F.sort_array(F.concat("_base", "_added"))).drop("_raw", "_more", "_added"))


def _joined(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*(F.lit(k) for k in KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``."""
    spans = pii_spans(docs.select("doc_id", "text"), fit(docs))

    def count(kind):
        return F.size(F.filter("_base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    n = [count(k) for k in BASE]
    return spans.select("doc_id", *n, F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
                        _joined(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[KIND]``; spans that
    overlap become one mark (that of the first).  Texts without a span stay."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    spans = pii_spans(docs.select(F.struct(*columns).alias("row"), "text"), fit(docs))
    ordered = F.sort_array(F.transform("_spans", lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    mark = lambda x: F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), x["kind"] + 1)

    def step(acc, x):
        new = F.struct(x["end"].alias("at"), F.concat(
            acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), mark(x)).alias("out"))
        grown = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["start"] >= acc["at"], new).otherwise(grown)

    text = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    clean = F.when(F.size("_spans") > 0, text).otherwise(F.col("text"))
    return spans.select(F.col("row").withField("text", clean).alias("row")).select("row.*")
