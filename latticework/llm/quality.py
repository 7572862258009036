"""Quality rules whose cutoffs carry exact binomial guarantees. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
#: Rules and the step of their grids of GRID cutoffs: a document fails a rule if its figure is over the cutoff.
RULES = {"symbols": 0.02, "upper": 0.02, "exclaim": 0.02, "dup_lines": 0.02, "repeats": 0.02, "word_length": 0.5}
GRID = 50
#: At most this share of good documents falsely rejected by a stratum's rules, with this confidence for all strata and rules.
RISK, ERROR = 0.03, 0.05


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _repeated(w: Column) -> Column:
    """From the hashes of all windows: words in windows that occur twice or more."""
    pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s):
        twice = F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]), e["i"]))
        return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

    covered = lambda p: F.aggregate(F.transform(p, lambda i, j: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(p, j + 1) - i, F.lit(WINDOW_WORDS)))), F.lit(0), lambda a, b: a + b)
    return _let(pairs, lambda s: _let(positions(s), covered))


def figures(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, the counts of each text and the figures that rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = "\x20\x09\x0a\x0b\x0c\x0d"
    df = docs.select(*keep, text.alias("text"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(split, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW_WORDS)))
    repeats = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_repeated(w))
    of_words = _let(
        hashes,
        lambda h: F.struct(F.size(h).cast("long").alias("n_words"), F.when(F.size(h) > WINDOW_WORDS, _let(windows(h), repeats)).otherwise(0).cast("long").alias("n_repeat_words")),
    )
    of_lines = _let(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    df = df.select(
        *keep,
        F.length(F.translate("text", blank, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        without("!").alias("bangs"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÓÍÁÚÀ").alias("uppers"),
        of_words.alias("w"),
        of_lines.alias("l"),
    )
    n = F.greatest(F.col("w.n_words"), F.lit(1))
    return df.select(
        *keep,
        "w.n_words",
        "word_chars",
        "n_symbols",
        "l.n_dup_lines",
        "w.n_repeat_words",
        ((F.col("w.n_words") < 20) | (100 * F.col("w.n_repeat_words") > 30 * F.col("w.n_words"))).alias("base_failed"),
        F.struct(
            (F.col("n_symbols") / n).alias("symbols"),
            (F.col("uppers") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper"),
            (F.col("bangs") / n).alias("exclaim"),
            (F.col("l.n_dup_lines") / F.greatest(F.col("l.lines"), F.lit(1))).alias("dup_lines"),
            (F.col("w.n_repeat_words") / n).alias("repeats"),
            (F.col("word_chars") / n).alias("word_length"),
        ).alias("rule"),
    )


def binomial_below(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X of n draws of probability p; 1 where k >= n p, which fails any test here."""
    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log(1 - p)).alias("t"), F.exp(n * math.log(1 - p)).alias("s"))

    def add(a, i):
        t = a["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, 1.0).otherwise(F.aggregate(steps, start, add, lambda a: F.least(a["s"], F.lit(1.0))))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, rule, cutoff) for each stratum of measured and rule that a cutoff is certified for.

    For each stratum, each grid cutoff's false rejections among
    good labelled documents are tested: certified if so few would come with
    probability at most the error, were the true share over risk / rules. Cutoffs are tested from the
    loosest down and end at the first that fails, so the grid costs no correction; strata
    and rules share the error (Bonferroni). Of the certified cutoffs, that with
    the most rejected bad documents less ten times the good ones is taken, the
    loosest on ties, and none that rejects no bad document. A stratum without a certified cutoff for a rule has none.
    """
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    step = F.create_map(*[x for r, s in RULES.items() for x in (F.lit(r), F.lit(s))])
    own = measured.join(good, "doc_id").select(
        "stratum", "quality", F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(f"rule.{r}"))])).alias("rule", "x")
    )
    # Cutoff number c rejects figures over c * step: those whose bin is over c.
    bins = own.select("stratum", "rule", "quality", F.least(F.ceil(F.col("x") / step[F.col("rule")]), F.lit(GRID + 1)).cast("int").alias("bin"))
    good_ = F.sum((F.col("quality") > 0).cast("long"))
    bad_ = F.sum((F.col("quality") <= 0).cast("long"))
    counts = bins.groupBy("stratum", "rule", "bin").agg(good_.alias("good"), bad_.alias("bad"))
    counts = cut(counts)
    names = counts.select("stratum", "rule").distinct()
    full = names.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(GRID + 1)))).join(counts, ["stratum", "rule", "bin"], "left").na.fill(0, ["good", "bad"])
    over = Window.partitionBy("stratum", "rule").orderBy(F.desc("bin"))
    whole = Window.partitionBy("stratum", "rule")
    tests = len(RULES) * F.greatest(F.lit(1), F.size(F.collect_set("stratum").over(Window.partitionBy("rule"))))
    table_ = full.select(
        "stratum",
        "rule",
        (F.col("bin") - 1).alias("c"),
        F.sum("good").over(over).alias("k"),
        F.sum("bad").over(over).alias("caught"),
        F.sum("good").over(whole).alias("n"),
        tests.alias("tests"),
    ).where("c >= 0")
    passed = binomial_below(F.col("n"), F.col("k"), risk / len(RULES)) <= error / F.col("tests")
    certified = table_.withColumn("fails", F.sum(F.when(passed, 0).otherwise(1)).over(Window.partitionBy("stratum", "rule").orderBy(F.desc("c")))).where("fails = 0 and caught > 0")
    gain = F.col("caught") - 10 * F.col("k")
    best = certified.where(gain > 0).groupBy("stratum", "rule").agg(F.max_by("c", F.struct(gain, "c")).alias("c"))
    return best.select("stratum", "rule", (F.col("c") * step[F.col("rule")]).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """A row per document: doc_id, counts, base_failed, kept.

    kept is false where base_failed, and where a figure is over the stratum's cutoff
    for it. A null text has no words and fails; a null stratum is one of its own. Where no cutoff is certified
    base_failed alone decides. Repeated rows are judged alike; labels that
    contradict each other count as bad.
    """
    stratum = F.concat(F.lit("="), F.coalesce(F.col(stratum_col).cast("string"), F.lit("\u0000"))) if stratum_col in docs.columns else F.lit("=")
    measured = cut(figures(docs.select("doc_id", "text", stratum.alias("stratum")), "doc_id", "stratum"))
    found = cutoffs(measured, labels, risk, error)
    by = found.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    # Broadcast whole: a certificate takes hundreds of good labels, so the rows are few against the labels.
    joined = measured.join(F.broadcast(cut(by)), "stratum", "left")
    over = [F.coalesce(F.col(f"rule.{r}") > F.col("cutoffs")[r], F.lit(False)) for r in RULES]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
