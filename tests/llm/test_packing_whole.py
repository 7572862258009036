"""Windows hold the target proportions whatever the table's layout, in tokens, of every source."""

from latticework.llm import packing
from pyspark.sql import functions as F


def mixed(df):
    """The least share of source a in a full window."""
    got = packing.pack(df, window=256).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("source") == "a", F.col("length")).otherwise(0)).alias("a"))
    return got.where("n = 256").agg(F.min(F.col("a") / 256), F.max(F.col("a") / 256)).first()


def test_table_laid_out_by_source(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK", 40_000, raising=False)
    rows = [(i, "one two three four " * 20, "ab"[i // 1000]) for i in range(2000)]
    low, high = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartitionByRange(4, "source", "doc_id"))
    assert low > 0.3 and high < 0.7


def test_shares_are_of_tokens(spark):
    rows = [(i, ("a b c d " if i % 2 else "something everything government information ") * 20, "ab"[i % 2]) for i in range(400)]
    low, high = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1))
    assert low > 0.45 and high < 0.55
