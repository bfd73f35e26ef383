"""Merkle manifest of a dataset: one tree per language, one root above them.

Every row is a leaf: the SHA-256 of its columns, each written with its byte
count, so no two rows share an encoding.  Leaves stand in the order of
``doc_id`` within their language; two neighbours become the hash of both, a
last one without a neighbour the hash of itself, until one is left.  The roots
of the languages form the uppermost tree in the same way.

The tree is cut into superblocks of ``BLOCK`` neighbours, so that no task ever
holds more than that:

1. ``_climb`` reduces every superblock to its top node.  The top nodes are the
   leaves of the next layer, which is ``BLOCK`` times smaller; layers end when
   every tree has one node.
2. ``_descend`` goes back down.  The outer nodes that a superblock needs (the
   siblings on the way from its top to the root) are cogrouped with the
   superblock's nodes in ``applyInPandas``, which redoes the local reduction
   and joins local and outer siblings.  At the lowest layer the same call also
   digests every leaf's proof and folds the claimed leaf up to a root.

Only the number of nodes of a layer reaches the driver.

Defined results: a null language is a tree of its own and comes first; a null
``doc_id`` comes before all others of its language; rows with the same
``doc_id`` stand in the order of their leaf hashes, equal rows get one leaf
each; a null column is ``-``, an empty text ``0:``; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.prefix import contiguous_ids, prefix_sums
from tessera.session import materialize

#: Nodes of a superblock, a power of two.
BLOCK = 2048
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(**replaced: Column) -> Column:
    """SHA-256 of a row of ``documents``; ``replaced`` stands in for columns."""
    def coded(name):
        value = replaced.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[coded(c) for c in COLUMNS]), 256)


def tampered() -> Column:
    """``n_chars`` with 1 added where 7 divides the CRC-32 of the decimal id."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n = F.col("n_chars").cast("decimal(38,0)")
    return F.when(hit, n + 1).otherwise(n)


def _levels(nodes: list[str], first: bool, block: int) -> list[list[str]]:
    """Nodes of a superblock level by level.  The only superblock of a tree
    ends at its root; any other goes through all levels of a full one."""
    out = [nodes]
    alone = first and len(nodes) < block
    while len(out[-1]) > 1 if alone else 1 << len(out) <= block:
        low = out[-1]
        out.append([sha(*low[i:i + 2]) for i in range(0, len(low), 2)])
    return out


def _path(levels: list[list[str]], i: int) -> list[str]:
    """Steps from node ``i`` to the top: ``L``/``R`` and the sibling, or ``-``
    where a last node is hashed alone."""
    out = []
    for level in levels[:-1]:
        other = i ^ 1
        out.append("-" if other >= len(level) else ("L" if other < i else "R") + level[other])
        i >>= 1
    return out


def fold(node: str, steps: list[str]) -> str:
    """The root that a node and its steps lead to."""
    for s in steps:
        node = sha(s[1:], node) if s[0] == "L" else sha(node, s[1:])
    return node


def _blocked(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("superblock", F.floor(F.col("pos") / block).cast("long"))


def _climb(nodes: DataFrame, block: int) -> list[DataFrame]:
    """All layers over ``tree, pos, node``, the last with one node a tree."""
    layers = [nodes]

    def top(key, part):
        levels = _levels(part.sort_values("pos")["node"].tolist(), key[1] == 0, block)
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "node": levels[-1]})

    while (layers[-1].agg(F.max("pos")).first()[0] or 0) > 0:
        layers.append(materialize(_blocked(layers[-1], block).groupBy("tree", "superblock").applyInPandas(
            top, "tree string, pos long, node string")))
    return layers


def _descend(layers: list[DataFrame], outer: DataFrame, block: int, down, schema: str) -> DataFrame:
    """Cogroup every layer, from the top, with the outer nodes of its
    superblocks; ``down`` handles the lowest one.  ``outer`` has a row for the
    root of each tree: ``tree, pos (0), steps``, and what else ``down`` needs."""
    def inner(key, part, above):
        part = part.sort_values("pos")
        levels = _levels(part["node"].tolist(), key[1] == 0, block)
        rest = above["steps"].iloc[0]
        steps = [" ".join([*_path(levels, i), *([rest] if rest else [])]) for i in range(len(part))]
        return pd.DataFrame({"tree": key[0], "pos": part["pos"], "steps": steps,
                             "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0]})

    if len(layers) == 1:    # every tree is its only leaf: one step nevertheless
        layers = [layers[0], None]
    for k in range(len(layers) - 2, -1, -1):
        outer = _blocked(layers[k], block).groupBy("tree", "superblock").cogroup(
            outer.withColumnRenamed("pos", "superblock").groupBy("tree", "superblock")).applyInPandas(
            down if k == 0 else inner, schema if k == 0 else "tree string, pos long, steps string, subroot string, root string")
        outer = outer if k == 0 else materialize(outer)
    return outer


def manifest(docs: DataFrame, claimed: Column | None = None, block: int = BLOCK, proofs: bool = False) -> DataFrame:
    """One row per document: ``doc_id, lang, position, leaf, subroot, root,
    proof_sha256, folded_root, verified`` and, with ``proofs``, the ``proof``
    itself as an array of steps.  ``claimed`` is the ``n_chars`` to verify in
    place of the stored one (default: the stored one)."""
    if block < 2 or block & (block - 1):
        raise ValueError("block must be a power of two")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("")).alias("tree"), "doc_id", "lang",
        leaf().alias("node"), leaf(**({} if claimed is None else {"n_chars": claimed})).alias("claim"),
        F.lit(1).cast("long").alias("_one"), F.monotonically_increasing_id().alias("_row"))
    # The claim travels only where it differs; _row parts equal rows, which
    # may stand in any order.
    rows = rows.withColumn("claim", F.when(F.col("claim") != F.col("node"), F.col("claim")))
    rows = prefix_sums(rows, ["tree"], [F.col("doc_id").asc_nulls_first(), "node", F.col("claim").asc_nulls_first(), "_row"],
                       ["_one"])
    rows = materialize(rows.select("tree", (F.col("cum__one") - 1).alias("pos"), "node", "claim", "doc_id", "lang"))

    low = _climb(rows.select("tree", "pos", "node"), block)
    subroots = contiguous_ids(low[-1].select(F.col("tree").alias("leaf_tree"), "node"), ["leaf_tree"], "pos")
    high = _climb(materialize(subroots.select(F.lit("").alias("tree"), "pos", "node", "leaf_tree")), block)

    def over(key, part, above):
        """Steps from each language's root to the uppermost root."""
        part = part.sort_values("pos")
        levels = _levels(part["node"].tolist(), key[1] == 0, block)
        rest = above["steps"].iloc[0]
        return pd.DataFrame({"tree": part["leaf_tree"], "pos": 0, "subroot": part["node"], "root": above["root"].iloc[0],
                             "steps": [" ".join([*_path(levels, i), *([rest] if rest else [])]) for i in range(len(part))]})

    top = high[-1].select("tree", "pos", F.lit("").alias("steps"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    outer = materialize(_descend(high, top, block, over, "tree string, pos long, steps string, subroot string, root string"))

    def down(key, part, above):
        """Local reduction, proof and fold of the leaves of a superblock."""
        part = part.sort_values("pos")
        nodes = part["node"].tolist()
        levels = _levels(nodes, key[1] == 0, block)
        rest = above["steps"].iloc[0].split(" ") if above["steps"].iloc[0] else []
        root = above["root"].iloc[0]
        steps = [_path(levels, i) + rest for i in range(len(nodes))]
        folded = [fold(c if isinstance(c, str) else n, s) for n, c, s in zip(nodes, part["claim"].tolist(), steps)]
        out = pd.DataFrame({
            "doc_id": part["doc_id"], "lang": part["lang"], "position": part["pos"], "leaf": nodes,
            "subroot": above["subroot"].iloc[0], "root": root,
            "proof_sha256": [sha(*[x[1:] for x in s]) for s in steps],
            "folded_root": folded, "verified": [f == root for f in folded]})
        if proofs:
            out["proof"] = steps
        return out

    ids = dict(docs.select("doc_id").dtypes)["doc_id"]
    schema = (f"doc_id {ids}, lang string, position long, leaf string, subroot string, root string, "
              "proof_sha256 string, folded_root string, verified boolean" + (", proof array<string>" if proofs else ""))
    rows = [rows, *low[1:]]
    return _descend(rows, outer, block, down, schema)


def tampering_audit(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The manifest verified against rows of which some had ``n_chars`` changed."""
    return manifest(docs, tampered(), block).drop("lang", "position")


#: DuckDB has no CRC-32; the inner list step is one bit of its polynomial.
SQL = """
WITH RECURSIVE coded AS (
  SELECT *, COALESCE(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || COALESCE(strlen(source) || ':' || source, '-')
       || COALESCE(strlen(lang) || ':' || lang, '-') AS head, COALESCE(strlen(text) || ':' || text, '-') AS tail,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || COALESCE(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || COALESCE(strlen((n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR) || ':'
      || (n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END), '-') || tail) AS claim
  FROM coded),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (
  SELECT lang, 0 AS level, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS level, pos, n, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM crown WHERE n > 1 GROUP BY level, pos // 2, n),
low AS (
  SELECT doc_id, lang, leaf, claim AS node, 0 AS level, pos, n, '' AS proof FROM placed
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf,
    sha256(CASE WHEN w.pos % 2 = 1 THEN t.node || w.node ELSE w.node || COALESCE(t.node, '') END),
    w.level + 1, w.pos // 2, (w.n + 1) // 2, w.proof || COALESCE(t.node, '')
  FROM low w LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND t.pos = xor(w.pos, 1)
  WHERE w.n > 1),
high AS (
  SELECT l.doc_id, l.leaf, s.subroot, l.node, 0 AS level, s.pos, s.n, l.proof
  FROM low l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang WHERE l.n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot,
    sha256(CASE WHEN w.pos % 2 = 1 THEN c.node || w.node ELSE w.node || COALESCE(c.node, '') END),
    w.level + 1, w.pos // 2, (w.n + 1) // 2, w.proof || COALESCE(c.node, '')
  FROM high w LEFT JOIN crown c ON c.level = w.level AND c.pos = xor(w.pos, 1)
  WHERE w.n > 1)
SELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, h.node AS folded_root, h.node = r.node AS verified
FROM high h, (SELECT node FROM crown WHERE n = 1) r WHERE h.n = 1
"""
