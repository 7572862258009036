"""Secrets: fixed patterns, and a corpus-wide count of who owns each candidate."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear_of, cut, fresh, map_frames, scratch, table, with_column

KINDS = ("assign", "access", "hex", "token")
NUMBERS = ("n_live", "n_copied", "max_owners", "max_repositories")
_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{24,}")
#: What any text with a candidate holds.
_ANY = r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9+/_-]{24}|[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}"
#: Bits a character, at least, of a token that no pattern names; owners, or repositories of two owners or more, from which on a value is an example.
ENTROPY, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3.5, 3, 4

#: Bytes of spans that are sent to every executor at most, to be found without shuffling the texts.
BROADCAST = 1 << 24


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value), sorted."""
    out = [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def tokens(text: str, base) -> list[tuple[int, int, int, str]]:
    """Long random-looking tokens that touch no fixed span: upper, lower and digits."""
    out = []
    for m in _TOKEN.finditer(text):
        s = m[0]
        if re.search("[0-9]", s) and re.search("[a-z]", s) and re.search("[A-Z]", s) and entropy(s) >= ENTROPY:
            out.append((m.start(), 3, m.end(), s))
    return clear_of(out, base)


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def find(docs: DataFrame, owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    Values of the fixed patterns and random-looking tokens are candidates. Their
    SHA-256 is counted over the whole corpus by distinct owners and
    repositories (owner and the other columns). A value of example_owners owners or more is a copied
    example, and so is one of two owners or more with example_repositories repositories or more; many repositories
    of one owner alone don't make an example of its credential. Others look live. Fixed spans all stay; a token becomes a span only if it looks live. n_live and n_copied count a
    document's candidates of either sort; max_owners and max_repositories are the most that one of them has. Owners that are null count as one owner.

    Counting first reduces to distinct (value, owner, repository), so a value in a third of all rows
    costs one row a task. A null text has nothing; texts are read whole, however long; repeated rows stay; an empty
    table gives an empty result; other columns are ignored unless named.
    """
    with scratch() as keep:
        rows, told = _told(docs, owner_col, repository_cols, example_owners, example_repositories)
        keep(rows), keep(told)
    return (
        rows.join(told, "row", "left")
        .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in NUMBERS])
    )


def _told(docs: DataFrame, owner_col: str, repository_cols: tuple[str, ...], example_owners: int, example_repositories: int) -> tuple[DataFrame, DataFrame]:
    """(row and its counts, row and the verdicts on its candidates)."""
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("\u0000")) if owner_col in docs.columns else F.lit("all")
    repo = F.to_json(F.struct(*[F.col(c) for c in repository_cols if c in docs.columns])) if set(repository_cols) & set(docs.columns) else F.lit("all")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), owner.alias("owner"), repo.alias("repo"))

    def scan(batches):
        for b in batches:
            out = []
            for t in b["text"]:
                base = base_spans(t)
                more = tokens(t, base)
                n = [sum(x[1] == i for x in base) for i in range(3)]
                both = [*base, *more]
                out.append((*n, hashlib.sha256(_join(base).encode()).hexdigest(), [a for a, *_ in both], [k for _, k, *_ in both], [e for _, _, e, _ in both], [hashlib.sha256(v.encode()).hexdigest() for *_, v in both]))
            pdf = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "starts", "kinds", "ends", "hashes"])
            yield pd.concat([b[["doc_id", "owner", "repo"]].reset_index(drop=True), pdf], axis=1)

    rows = cut(
        map_frames(own, scan, "doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, starts array<int>, kinds array<int>, ends array<int>, hashes array<string>").withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    found = rows.where(F.size("starts") > 0).select("row", "owner", "repo", F.explode(F.arrays_zip("starts", "kinds", "ends", "hashes")).alias("x")).select("row", "owner", "repo", "x.*")
    spread = cut(
        found.groupBy("hashes", "owner", "repo")
        .agg(F.lit(1).alias("one"))
        .groupBy("hashes", "owner")
        .agg(F.count("*").alias("repos"))
        .groupBy("hashes")
        .agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    )
    live = (F.col("owners") < example_owners) & ((F.col("owners") < 2) | (F.col("repos") < example_repositories))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kinds") + 1)
    told = (
        found.join(spread, "hashes")
        .groupBy("row")
        .agg(
            F.sort_array(F.collect_list(F.when((F.col("kinds") < 3) | live, F.struct("starts", "kinds", "ends", name.alias("name"))))).alias("s"),
            F.count(F.when(live, 1)).alias("n_live"),
            F.count(F.when(~live, 1)).alias("n_copied"),
            F.max("owners").alias("max_owners"),
            F.max("repos").alias("max_repositories"),
        )
    )
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["name"], x["starts"], x["ends"])), ",")
    return cut(rows.select("row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")), cut(told.select("row", text.alias("spans"), *NUMBERS))


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with each span of find() in text replaced by the mark; spans that overlap are replaced as one.

    Spans are found by text, so repeated and null doc_ids do no harm, and a token that looks live in one row goes from all rows of
    that text. All other columns stay as they are, whatever their names; a null text stays null; an empty table gives an empty result.
    """
    key, found = fresh(docs, "text_key"), fresh(docs, "text_spans")
    docs_ = docs.withColumn(key, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    owner = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs_.select(F.monotonically_increasing_id().alias("doc_id"), F.col("text").cast("string").alias("text"), owner.alias("source"), lang.alias("lang"), F.col(key).alias("key"))
    with scratch() as keep:
        texts = cut(own.where(F.col("text").rlike(_ANY)))
        hit = find(texts).where("spans <> ''").select("doc_id", "spans")
        spans = keep(cut(hit.join(texts.select("doc_id", "key"), "doc_id").groupBy("key").agg(F.max("spans").alias("spans"))))
    size = spans.agg(F.sum(F.length("spans") + 100)).first()[0] or 0
    spans = spans.select(F.col("key").alias(key), F.col("spans").alias(found))
    if size <= BROADCAST:  # else all texts are shuffled by their keys
        spans = F.broadcast(spans)

    def run(b):
        at = b.schema.get_field_index("text")
        out = []
        for t, s in zip(b.column(at).to_pylist(), b.column(b.schema.get_field_index(found)).to_pylist()):
            if s:
                done, parts = 0, []
                for a, z in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in s.split(",")):
                    if a >= done:
                        parts += [t[done:a], mark]
                    done = max(done, z)
                t = "".join([*parts, t[done:]])
            out.append(t)
        return {"text": pa.array(out, b.schema.types[at])}

    return with_column(docs_.join(spans, key, "left").drop(key), run, docs.schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
