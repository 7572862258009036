"""No pair is missed where vectors fill few of their dimensions."""

import numpy as np
from latticework.llm import embeddings


def test_pairs_of_low_rank(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 6)) @ rng.normal(size=(6, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links = (x @ x.T >= embeddings.COSINE).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df, block=40).collect()}
    assert [got[i] for i in range(len(x))] == links.tolist()


def test_recall_of_pairs_near_the_threshold_in_many_bands(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=(5, 900, 64))
    u -= (u * x).sum(2, keepdims=True) * x
    u /= np.linalg.norm(u, axis=2, keepdims=True)
    c = rng.uniform(0.88, 0.96, (5, 900, 1))
    x = np.concatenate([x, *(c * x + np.sqrt(1 - c * c) * u)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, x[9].tolist())]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "vec_id long, embedding array<double>, key string, n_links int")
    x = np.concatenate([x, x[[7, 9]]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= embeddings.COSINE).sum(1) - 1
    got = embeddings.near_duplicates(df, block=128).toPandas()
    assert links.sum() > 5_000 and got["n_links"].sum() == links.sum()
    own = got[got["vec_id"].notna()].groupby("vec_id")["n_links"].min()
    assert own.tolist() == links[:5400].tolist()
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
