from sylva.streaming import sequences as S


def test_base_counts_of_a_growing_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fasta").write_text(">a\nACGT\n>b\nAA\n")
    stream = S.running_base_counts(S.stream_fasta(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bases").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert {r.base: r.n for r in spark.table("bases").collect()} == {"a": 3, "c": 1, "g": 1, "t": 1}
        (tmp_path / "in/b.fasta").write_text(">c\nTTT\n")
        q.processAllAvailable()
        assert {r.base: r.n for r in spark.table("bases").collect()}["t"] == 4
    finally:
        q.stop()
