from echotrace.streaming import arrivals


def test_each_file_is_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("x\n5\n7\n")
    rows = lambda: arrivals.gather(arrivals.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows()
    (tmp_path / "in/b.csv").write_text("x\n5\n")
    rows()
    rows()
    found = arrivals.value_counts(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert {(r.canonical_value, r.cell_count) for r in found} == {("5", 2), ("7", 1)}
