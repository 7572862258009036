"""Every source has a share, however many there are."""

from latticework.llm import packing
from pyspark.sql import functions as F


def test_more_than_ten_thousand_sources(spark):
    rows = [(i, "one two" if i else "one two three", f"host{i}") for i in range(10_200)]
    coded = packing.encoded(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r["source"]: r["share"] for r in packing.targets(coded).collect()}
    assert len(got) == 10_200 and got["host0"] == 4 and got["host10199"] == 3
    total = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).agg(F.sum("length")).first()[0]
    assert total == sum(got.values())
