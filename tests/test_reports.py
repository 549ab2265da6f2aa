"""Reports on a small register of our own."""

from tessera.plans import reports


def test_source_detail_counts_sections_without_an_end(spark, tmp_path):
    chunk = "chunk_id string, document_id bigint, source_id string, ordinal int, section string, char_start int, char_end int, token_estimate int"
    chunks = [("a", 1, "s1", 0, "", 0, 4, 1), ("b", 1, "s1", 1, "End", 6, None, 1), ("b", 1, "s1", 1, "End", 6, None, 1), ("c", 9, "s1", 0, "", 0, None, 1), ("d", 9, "s2", 0, "", 2, None, 1), ("e", 1, None, 2, "", 0, 4, 1)]
    spark.createDataFrame(chunks, chunk).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(1, "0123456789")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source_id: tuple(r)[1:] for r in reports.source_detail(spark, str(tmp_path)).collect()}
    assert got == {"s1": (3, 8, "a", "c"), "s2": (1, None, "d", "d")}
