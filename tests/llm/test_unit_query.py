from strandloom.llm import queries


def test_query_takes_runs_of_short_units_and_repeated_rows(spark, tmp_path):
    wrapped = "\n".join(f"line {i} of a passage that repeats" for i in range(12))  # 7 words a line
    row = (5, "own line of five\nshort")
    rows = [(1, wrapped), (2, "first\n" + wrapped), (3, "first\n\n  \nlast"), row, row, row, (None, "last"), (None, "last"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_units, r.n_removed) for r in queries.op2_unit_hash_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, 12, 0), (2, 13, 12), (3, 4, 0), (5, 2, 0), (5, 2, 2), (5, 2, 2), (None, 1, 1), (None, 1, 1), (9, 1, 0)], key=str)
