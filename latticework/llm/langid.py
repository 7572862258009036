"""Language identification by unigram piece models that sum over all segmentations."""

from __future__ import annotations

from collections import Counter
from itertools import chain, islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import by_size, crc_mod, fresh, map_frames, slices, table, trimmed

VOCABULARY = "piece_bpe_32k.model"
#: Characters of a word that are scored in one go; a character without a piece.
RUN, UNKNOWN = 32, 1e-7
#: Words kept by a task; words that are split in one call; bytes of rows, and of these characters, that are scored in one go.
CACHE_WORDS, SLICE, CHUNK = 100_000, 1 << 14, 1 << 21
#: Languages at most: the model has a column for each, and every task holds it.
LANGUAGES = 1_000
UNDETERMINED = "und"


def _runs(text: str | None) -> list[str]:
    """Lower-cased words between white space, in runs of at most RUN characters, with the mark of a word's start."""
    out = []
    for w in (text or "").lower().split():
        if len(w) < RUN:
            out.append("▁" + w)
        else:
            w = "▁" + w
            out += [w[i : i + RUN] for i in range(0, len(w), RUN)]
    return out


def _processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(VOCABULARY))


def train(docs: DataFrame, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities): a row for each piece of the vocabulary, a column for each language.

    Each language's pieces are counted over all words of its documents as the
    vocabulary's own merges split them; counts are smoothed by a constant. Rows without text
    or lang teach nothing; an empty table gives no language. The result has as many rows as the vocabulary
    and a column for each language, whatever the size of the corpus; over LANGUAGES distinct values of lang are an error.
    """
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null")
    if docs.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"lang has over {LANGUAGES} values")

    def count(batches):
        sp = _processor()
        size, total = sp.get_piece_size(), {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                seen: Counter = Counter()
                for t in texts:
                    seen.update(t.lower().split())
                own, times = total.setdefault(lang, np.zeros(size)), iter(seen.items())
                while some := list(islice(times, SLICE)):
                    ids = sp.encode([w for w, _ in some], out_type=int, num_threads=1)
                    n = list(map(len, ids))
                    own += np.bincount(np.fromiter(chain.from_iterable(ids), np.int64, sum(n)), np.repeat(np.array([c for _, c in some], np.float64), n), size)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "piece": at, "n": c[at].astype(np.int64)})

    rows = map_frames(docs.where("text is not null"), count, "lang string, piece int, n long", CHUNK).groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((_processor().get_piece_size(), len(langs)))
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        counts[own["piece"], k] = own["n"]
    return langs, (counts + smooth) / (counts + smooth).sum(0)


class Scorer:
    """Log-probabilities of words by language, by the forward algorithm over all segmentations."""

    def __init__(self, probabilities: np.ndarray):
        sp = _processor()
        pieces = {}
        for i in range(sp.get_piece_size()):
            s = sp.id_to_piece(i)
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and s:
                pieces.setdefault(s, i)
        keys = np.array([self._hash(s) for s in pieces], np.uint64)
        order = np.argsort(keys)
        self.longest = max(map(len, pieces))
        self.keys, self.ids = keys[order], np.array(list(pieces.values()))[order]
        self.width = probabilities.shape[1]
        self.p = np.vstack([probabilities, np.zeros(self.width)])
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width))

    @staticmethod
    def _hash(s: str) -> int:
        h = len(s)
        for c in s:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _forward(self, runs: list[str]) -> np.ndarray:
        n = len(runs[0])
        chars = np.array(runs, f"U{n}").view(np.uint32).reshape(len(runs), n).astype(np.uint64) + np.uint64(1)
        reach = [np.ones((len(runs), self.width))] + [np.zeros((len(runs), self.width)) for _ in range(n)]
        for i in range(n):
            for size in range(1, min(self.longest, n - i) + 1):
                h = np.full(len(runs), size, np.uint64)
                for k in range(size):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + chars[:, i + k]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                if size == 1:
                    reach[i + 1] += reach[i] * np.where(hit[:, None], self.p[self.ids[at]], UNKNOWN)
                elif hit.any():
                    reach[i + size][hit] += reach[i][hit] * self.p[self.ids[at[hit]]]
        return np.log(np.maximum(reach[n], 1e-300))

    def text(self, runs: list[str]) -> np.ndarray:
        """The sum over a text's words, all of which it has learned."""
        return self.rows[list(map(self.at.__getitem__, runs))].sum(0)

    def learn(self, runs: list[str]) -> None:
        by: dict[int, list[str]] = {}
        for r in runs:
            by.setdefault(len(r), []).append(r)
        need = len(self.at) + len(runs)
        if need > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), self.width))])
        for own in by.values():
            base = len(self.at)
            self.rows[base : base + len(own)] = self._forward(own)
            self.at.update(zip(own, range(base, base + len(own))))


def _best(model: np.ndarray):
    """A function of texts: for each, the column that makes it likeliest, -1 if it has no letter, and that column's share of the likelihood."""
    scorer = Scorer(model)

    def best(texts):
        pred, score = [], []
        for some in by_size(texts, CHUNK):
            runs = [_runs(t) if t is not None and any(map(str.isalpha, t)) else None for t in some]
            if len(scorer.at) > CACHE_WORDS:
                scorer.at.clear()
            scorer.learn(list(set().union(*filter(None, runs)).difference(scorer.at)))
            for r in runs:
                s = scorer.text(r) if r else None
                pred.append(int(s.argmax()) if r else -1)
                score.append(float(1 / np.exp(s - s.max()).sum()) if r else 0.0)
        return pred, score

    return best


def predict(docs: DataFrame, langs: list[str], probabilities: np.ndarray, *keep: str, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The columns to keep, the predicted language and its score for every row.

    The score is the predicted language's share of the likelihood, all languages alike
    beforehand. A null text, one without a letter, and any text when no language was
    learned give 'und' and 0. Equal likelihoods go to the first language by name. Texts are read whole, a few at a time; words of
    RUN characters and more are summed in runs. Repeated rows are told alike; an empty table gives an empty result.
    """
    if not langs:
        return docs.select(*keep, F.lit(UNDETERMINED).alias(pred_col), F.lit(0.0).alias(score_col))
    model = docs.sparkSession.sparkContext.broadcast(probabilities)
    text = fresh(docs, "lang_text")

    def run(batches):
        best = _best(model.value)
        for b in batches:
            for x in slices(b, CHUNK):
                pred, score = best(x.column(x.num_columns - 1).to_pylist())
                names = pa.array([langs[k] if k >= 0 else UNDETERMINED for k in pred], pa.string())
                yield pa.RecordBatch.from_arrays([*x.columns[:-1], names, pa.array(score, pa.float64())], [*keep, pred_col, score_col])

    kinds = StructType([*docs.select(*keep).schema, StructField(pred_col, StringType()), StructField(score_col, DoubleType())])
    return docs.select(*keep, F.col("text").cast("string").alias(text)).mapInArrow(trimmed(run), kinds)


def accepted(docs: DataFrame, langs: list[str], probabilities: np.ndarray) -> DataFrame:
    """The rows of docs whose text is likelier in a learned language than in none.

    None is the model in which all pieces of the vocabulary are alike. Null texts and those without a letter go. When no
    language was learned, all with a letter stay. Every column passes as it is; repeated rows stay repeated.
    """
    letters = docs.where(F.col("text").rlike(r"\p{L}"))
    if not langs:
        return letters
    size = len(probabilities)
    model = docs.sparkSession.sparkContext.broadcast(np.column_stack([probabilities, np.full(size, 1 / size)]))
    at = docs.columns.index("text")

    def run(batches):
        best = _best(model.value)
        for b in batches:
            for x in slices(b, CHUNK):
                pred, _ = best(x.column(at).to_pylist())
                yield x.filter(pa.array([0 <= k < len(langs) for k in pred]))

    return letters.mapInArrow(trimmed(run), docs.schema)


def identify(docs: DataFrame, held: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that aren't held out.

    Null and letterless texts, and all texts where nothing was learned, are 'und' with score 0. Repeated rows are told alike; an empty
    table gives an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (crc_mod("doc_id", folds) == held).alias("held_out"))
    langs, p = train(docs.where("not held_out"))
    return predict(docs, langs, p, "doc_id", "held_out").select("doc_id", "held_out", "lang_pred", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
