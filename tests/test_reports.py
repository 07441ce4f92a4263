from siltlog.operators.reports import document


def test_a_limit_of_0_lists_all_rows(spark):
    figures, rows = spark.range(1).toDF("n"), spark.range(10_500).toDF("segment").orderBy("segment")
    assert [r["segment"] for r in document("cue", figures, {"segments": rows}).tables["segments"]] == list(range(10_500))
    assert len(document("cue", figures, {"segments": rows}, 7).tables["segments"]) == 7
