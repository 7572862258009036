"""The neural model's words and pairs grow with the training tokens."""

import zlib

import numpy as np
from latticework.llm import lm


def test_words_past_the_first_thousand_have_contexts(spark):
    rng = np.random.default_rng(2)
    common, rare = [f"c{i}" for i in range(1050)], [f"r{i}" for i in range(200)]
    held = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    ids = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 10][:200]
    texts = [" ".join(rng.permutation(common * 2)) + " " + " ".join(rare) for _ in ids]
    rows = [*zip(ids, texts), (held[0], " ".join(rare)), (held[1], " ".join(rng.permutation(rare)))]
    got = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    in_order, mixed = got[held[0]], got[held[1]]
    assert abs(in_order["base_score"] - mixed["base_score"]) < 1e-6
    assert in_order["score"] > mixed["score"] + 20


def test_every_pair_weighs_its_count():
    pairs = np.random.default_rng(1).integers(1, 5_000, (30, 30))
    t = lm.train_nce(pairs, steps=150)
    true = pairs / pairs.sum(1, keepdims=True)
    assert abs((true * (np.log(true) - t)).sum(1)).mean() < 0.2
    assert lm.own_classes(10**10) > 10 * lm.own_classes(10**7)
