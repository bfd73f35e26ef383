"""Queries and operators whose work must spread, or grow no faster than the
input; every test builds its own rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.operators import lexicon as LX


def _norm(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


def agrees(spark, name, folder, tables):
    """The query's rows, compared with those of its SQL."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = E.queries()[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({E.oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert _norm(rows) == _norm(want)
    return rows


def test_lines_of_one_listing_are_dealt_and_parsed_once(spark):
    lines = "\n".join(f"| **t{i % 50}** | English | {i} | [low](x) |" for i in range(2000))
    pages = spark.createDataFrame([("g", "f", "c", "u", "| Term | Language | Sightings | Offensiveness |\n" + lines, 0)],
                                  "filter_group string, filter_name string, target_category string, url string, "
                                  "markdown string, filter_order int")
    rows = LX.table_rows(pages)
    held = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 2000 and len(held) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(held) < 1000
    entries = LX.lexicon_entries(pages).select("term", "sightings").collect()
    assert sorted((r["term"], r["sightings"]) for r in entries) == sorted((f"t{i}", str(i)) for i in range(50))
    assert LX.first_terms(rows).first()["first_terms"] == [f"t{i}" for i in range(15)]


@pytest.mark.parametrize("name", ["dom4_topk_search", "dom5_threshold_search", "dom6_topk_above_threshold"])
def test_searches_take_every_twentieth_row_against_all(spark, tmp_path, name):
    rows = [(i, [1.0 if j == i % 7 else 0.1 * (i % 3) for j in range(8)]) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = E.queries()[name](spark, str(tmp_path))
    queries = {r["query_id"] for r in got.collect()}
    assert queries == {0, 20, 40, 60, 80}
    assert {r["chunk_id"] % 20 for r in got.collect()} != {0}


def test_document_copies_of_every_twentieth_document(spark, tmp_path):
    rows = [(i, f"word{i % 10} and some more words of text {i % 10} {'x' * (i % 10)}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = agrees(spark, "dom5_document_copies", str(tmp_path), ["documents"])
    assert {r[0] for r in got} == {0, 20, 40} and {r[1] for r in got} == set(range(0, 60, 10))


def test_personal_data_is_learned_from_all_documents(spark):
    from tessera.llm import pii
    docs = spark.range(20_300).select(F.col("id").alias("doc_id"), F.lit("card 4111 1111 1111 1111 here").alias("text"))
    got = pii.training_rows(docs).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    # the base pattern of cards and two generators match; equal candidates are one row a fold
    assert got["n"] == 3 * 20_300 and got["rows"] <= 15


def test_redaction_threshold_counts_all_documents(spark, monkeypatch):
    from tessera.llm import pii
    seen = []
    threshold = pii._threshold
    monkeypatch.setattr(pii, "_threshold", lambda bins: seen.append(sum(b["n"] for b in bins)) or threshold(bins))
    text = F.when(F.col("id") % 2 == 0, "card 4111 1111 1111 1111 here").otherwise("card 4111 1111 1111 1112 here")
    pii.redact(spark.range(20_300).select(F.col("id").alias("doc_id"), text.alias("text")))
    assert sum(seen) == 3 * 20_300


def test_rare_tokens_are_counted_in_all_documents(spark):
    from tessera.llm import passages
    docs = spark.range(12_000).select(F.col("id").alias("doc"), F.concat(F.lit("a b c d e "), "id").alias("text"))
    assert int(passages.token_counts(docs).sum()) == 2 * 12_000


@pytest.mark.parametrize("name", ["src5_text_directory", "jn1_text_metadata_join", "prj3_label_lists", "prj4_empty_text_drop"])
def test_text_files_are_packed(spark, tmp_path, monkeypatch, name):
    from tessera.plans import io_queries
    odd = [" a\n b \r\n", "\x1e x \x10s \x10\x1ep\x10p", "", None, "\n", "ä b", "s\x1e\x1e", "\x10"]
    spark.createDataFrame([(i, odd[i % len(odd)]) for i in range(200)], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3) for i in range(0, 260, 2)] + [(i, 1, i % 4) for i in range(1, 100, 2)],
                          "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    paths, folder = [], io_queries._folder
    monkeypatch.setattr(io_queries, "_folder", lambda spark: paths.append(folder(spark)) or paths[-1])
    assert agrees(spark, name, str(tmp_path), ["documents", "labels"])
    files = [f for p in paths for f in spark.read.text(p).inputFiles()]
    assert 0 < len(files) < 20


def test_encoders_share_a_bounded_number_of_tokens(monkeypatch):
    import numpy as np
    from tessera.operators import vectors as V
    monkeypatch.setattr(V, "KNOWN_TOKENS", 50, raising=False)
    known = {}
    wide, narrow = V.hashed_encoder(64, known), V.hashed_encoder(32, known)
    texts = [" ".join(f"t{i}" for i in range(j, j + 70)) for j in range(5)]
    a, b = wide(texts), narrow(texts)
    assert 0 < len(known) <= 50
    assert np.array_equal(a[:, :32] + a[:, 32:], b) and a.sum() == 5 * 70
