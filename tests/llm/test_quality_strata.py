"""A stratum without a certificate of its own loses no document to the others' cutoffs."""

from latticework.llm import quality
from pyspark.sql import functions as F


def test_small_stratum_takes_no_pooled_cutoff(spark):
    text = " ".join(f"{c}{d}" for c in "abcdefgh" for d in "pqrst")
    rows = [(i, f"{text} {i}", "en", 1) for i in range(1700)] + [(5000 + i, f"### {text} ### ### {i} ### ###", "en", 0) for i in range(300)]
    rows += [(9000 + i, f"### {text} ### ### {i} ### ###", "xx", 1) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    got = quality.judge(df.drop("quality"), df.select("doc_id", "quality"), risk=0.06).groupBy((F.col("doc_id") / 1000).cast("int").alias("k")).agg(F.min("kept").alias("low"), F.max("kept").alias("high"))
    kept = {r["k"]: (r["low"], r["high"]) for r in got.collect()}
    assert kept[0] == (True, True) and kept[5] == (False, False)
    assert kept[9] == (True, True)
