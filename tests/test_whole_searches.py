"""Searches take every row of their queries' table; every test builds its own rows."""

import pytest

from .test_large_inputs import agrees


def _documents(spark, folder, n):
    rows = [(i, f"word{i % 10} and some more words of text {i % 10} {'x' * (i % 10)}") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")


def test_every_user_turn_is_a_query(spark, tmp_path):
    _documents(spark, tmp_path, 12)
    rows = [(c, t, "user" if t % 2 else "assistant", f"word{c % 10} and some words {t}") for c in range(1, 8) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = agrees(spark, "dom3_conversation_search", str(tmp_path), ["documents", "conversations"])
    assert {r[:2] for r in got} == {(c, t) for c in range(1, 8) for t in (1, 3)}


def test_every_document_is_compared(spark, tmp_path):
    _documents(spark, tmp_path, 60)
    got = agrees(spark, "dom5_document_copies", str(tmp_path), ["documents"])
    assert {r[0] for r in got} == set(range(60)) and len(got) == 60 * 5


def _embeddings(spark, folder):
    rows = [(i, [1.0 if j == i % 7 else 0.1 * (i % 3) for j in range(8)]) for i in range(45)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")


@pytest.mark.parametrize("name", ["dom4_topk_search", "dom5_threshold_search", "dom6_topk_above_threshold"])
def test_every_vector_is_a_query(spark, tmp_path, name):
    _embeddings(spark, tmp_path)
    got = agrees(spark, name, str(tmp_path), ["embeddings"])
    assert {r[0] for r in got} == set(range(45))
