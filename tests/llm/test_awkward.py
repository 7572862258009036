"""Nulls, repeats, clashing names, long texts and empty tables where they were not covered; the library's own ids."""

import hashlib
import re

import corpus_pipeline as pipeline
import pytest
from latticework.llm import bpe, common, jaccard, langid, packing, pii, quality, secrets, suffix
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("firsts", "lasts", "_text", "_spans", "row_key", "text_key", "lang_pred", "score", "key", "repeat_key")


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def clashing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in NAMES:
        df = df.withColumn(c, F.array(F.lit(1.5)))
    return df.withColumn("at", F.lit("2024-01-01").cast("timestamp"))


TEXT = " ".join(f"word{i * i % 997}" for i in range(300))
ROWS = [(1, TEXT, "en", "a", 1), (1, "other words stand here, twice one id", "en", "a", 1), (None, TEXT + " x", "en", "a", 1), (2, None, None, None, None), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "12 34", "de", "b", 5), (5, 'x password = "hunter2hunter2" y', "en", "b", 1), (5, 'x password = "hunter2hunter2" y', "en", "b", 1)]


@pytest.mark.parametrize("name, stage", pipeline.STAGES[:-1])
def test_stages_keep_columns_and_take_empty_tables(spark, name, stage):
    docs = clashing(spark, ROWS)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert out.count() <= len(ROWS)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_duplicates_lose_no_text(spark):
    out = pipeline.near_duplicates(spark, clashing(spark, ROWS), SF).select("doc_id", "text").collect()
    texts = [r["text"] for r in out]
    assert texts.count(None) == 2 and texts.count("") == 1 and TEXT in texts and ROWS[1][1] in texts and TEXT + " x" not in texts
    assert texts.count(ROWS[-1][1]) == 1


def test_language_keeps_letters_when_nothing_is_learned(spark, table):
    out = pipeline.language(spark, table.withColumn("lang", F.lit(None).cast("string")), SF)
    assert out.count() == table.where(F.col("text").rlike(r"\p{L}")).count()


def test_language_rejects_what_no_language_makes_likely(spark, table):
    langs, p = langid.train(table)
    junk = spark.createDataFrame([(9_000_001, "текст на языке которого модель не знает " * 20, None, "z", 0)], SCHEMA)
    kept = langid.accepted(table.unionByName(junk), langs, p)
    assert kept.where("doc_id = 9000001").count() == 0 and kept.count() >= 0.98 * table.where(F.col("text").rlike(r"\p{L}")).count()


def test_ids_with_special_strings_are_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|ENDOFTEXT|>", "I'S İ ΣΑΣ \x1c don't 12ab", ""]
    got = packing.pack(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert list(next(packing.WordBPE(packing.TOKENIZER).ids([texts[0]]))) == lib.encode(texts[0], add_special_tokens=False).ids


def test_base_spans_of_a_whole_table(table):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    count = lambda s: sum(map(str.isdigit, s))
    ok = [lambda s: True, lambda s: all(int(x) < 256 for x in s.split(".")), lambda s: 12 <= count(s) <= 19 and pii.luhn(re.sub("[^0-9]", "", s)), lambda s: 9 <= count(s) <= 15]
    got = {r["doc_id"]: r for r in pii.find(table).collect()}
    for d, t in table.select("doc_id", "text").collect():
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, t or "") if ok[k](m[0]))
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        r = got[d]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r["spans"].split(","))
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[1] == k for x in want) for k in range(4)]


def test_secrets_of_a_whole_table(table):
    kinds = [(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), (r"[0-9a-f]+", lambda m: len(m[0]) >= 16)]
    got = {r["doc_id"]: r for r in secrets.find(table).collect()}
    for d, t in table.select("doc_id", "text").collect():
        want = sorted((m.start(), k, m.end()) for k, (p, f) in enumerate(kinds) for m in re.finditer(p, t or "", re.ASCII) if f(m))
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        r = got[d]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in want) for k in range(3)]


def test_repositories_count_in_the_verdict(spark):
    v = "Zx81kQp0Lm27RtYvB3nC9dWq"
    many = [(i, f"see {v}", f"l{i}", f"s{i % 2}") for i in range(4)]
    alone = [(10 + i, "see Ab3dEf6hIj9lMn2pQr5tUv8x", f"l{i}", "own") for i in range(6)]
    got = {r["doc_id"]: r for r in secrets.find(spark.createDataFrame(many + alone, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0]["n_copied"] == 1 and got[0]["max_repositories"] == 4 and got[10]["n_live"] == 1 and got[10]["max_repositories"] == 6


def test_quality_counts_of_a_whole_table(spark, table):
    got = {r["doc_id"]: r for r in quality.judge(table, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    for d, t in table.select("doc_id", "text").collect():
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        seen: dict = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        again = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 20 or 100 * len(again) > 30 * len(words))


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    assert quality.judge(clashing(spark, ROWS), labels).count() == len(ROWS) and quality.judge(clashing(spark, ROWS).limit(0), labels.limit(0)).count() == 0


def test_long_texts_are_read_in_time(spark):
    zeros = "0" * 5000 + ".1.1.1 " + "9" * 5000 + ".1.1.1"
    keys = " ".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(6000))
    df = spark.createDataFrame([(1, zeros), (2, keys)], "doc_id long, text string")
    assert pii.find(df).where("doc_id = 1").first()["n_ip"] == 1
    assert secrets.find(df).where("doc_id = 2").first()["n_hex"] == 6000
    assert bpe.encode_documents(df).count() == 2 and suffix.digests(df).count() == 2 and jaccard.groups(df).count() == 2


def test_frames_are_bounded_by_bytes(spark):
    df = spark.createDataFrame([(i if i else None, "x" * 100_000) for i in range(100)], "doc_id long, text string").coalesce(1)

    def sizes(frames):
        for b in frames:
            yield b.assign(n=len(b))[["doc_id", "n"]]

    got = common.map_frames(df, sizes, "doc_id long, n long", 1 << 20).collect()
    assert len(got) == 100 and max(r["n"] for r in got) <= 11 and [r["doc_id"] for r in got] == [None, *range(1, 100)]


def test_scratch_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    with common.scratch() as keep:
        a = common.cut(spark.range(5))
        b = keep(common.cut(a.where("id > 1")))
    assert b.count() == 3 and len(list((tmp_path / "latticework").iterdir())) == 1
