"""Language-model scores: exact unigram counts and a log-bilinear model trained by noise contrast."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, crc_mod, cut, map_frames, mix, scratch, table, tree_merge

#: The end of a text as a token; no word is like it, as words hold no space.
END = " "
#: Words whose counts all tasks have; the rest are joined. Classes that the neural model tells apart at least, unless there are fewer words.
HEAD, CLASSES = 65_536, 1_023
#: Characters that are taken in one go.
CHUNK = 1 << 22
#: Passes over all pair counts, pairs of a step, noise words that a step's pairs share, count that one visit of a pair stands for (more where a pair would have over VISITS).
DIMENSIONS, PASSES, BATCH, NOISE, WEIGHT, VISITS = 32, 2, 4_096, 128, 16, 1_024
#: Groups of pairs at least, training tokens and pairs of a group's blocks.
GROUPS, GROUP_TOKENS, BLOCK = 256, 1 << 23, 1 << 16
#: Training tokens of a training task at least.
TASK_TOKENS = 1 << 20


def coded(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, tokens, starts): distinct words, the end last; each token's place among them; where each text's tokens start."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    flat = split.flatten().dictionary_encode()
    own, at, ends = flat.dictionary.to_pylist(), flat.indices.to_numpy(), split.offsets.to_numpy()[1:]
    if "" in own:  # at a text's ends
        real = at != own.index("")
        at, ends = at[real], np.concatenate([[0], np.cumsum(real)])[ends]
    return [*own, END], np.insert(at.astype(np.int64), ends, len(own)), np.concatenate([[0], ends[:-1]]) + np.arange(len(texts))


def own_classes(n: int) -> int:
    """Classes of the neural model for n training tokens: twice the root, so that normalising every context takes work in proportion to n."""
    return max(CLASSES, 2 * int(np.sqrt(n)))


def start(unigram: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7) -> list[np.ndarray]:
    """The model before training: vectors of contexts and of next classes, the matrix between them, biases."""
    rng, k = np.random.default_rng(seed), len(unigram)
    r, q = (rng.normal(0, 0.1, (k, dimensions)).astype(np.float32) for _ in range(2))
    return [r, q, np.eye(dimensions, dtype=np.float32), np.log(unigram).astype(np.float32)]


class Trainer:
    """Adaptive gradient steps of noise-contrastive estimation, in place, with unigram noise that a step's pairs share."""

    def __init__(self, model: list[np.ndarray], unigram: np.ndarray, rate: float = 0.1, seed: int = 0, noise: int = NOISE):
        self.model, self.rate, self.noise, self.rng = model, rate, noise, np.random.default_rng(seed)
        self.state = [np.full_like(x, 1e-3) for x in model]
        self.cum, self.base = np.cumsum(unigram), np.log(noise * unigram).astype(np.float32)

    def _step(self, i: int, at, g) -> None:
        x, s = self.model[i], self.state[i]
        if at is not None:  # the sum for each row that occurs
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            at, g = at[order][starts], np.add.reduceat(g[order], starts, axis=0)
            s[at] += g * g
            x[at] -= self.rate * g / np.sqrt(s[at])
        else:
            s += g * g
            x -= self.rate * g / np.sqrt(s)

    def visit(self, a: np.ndarray, w: np.ndarray, count: np.ndarray, batch: int = BATCH) -> None:
        """One pass over pairs; each weighs as much as its count."""
        times = np.clip(-(-count // WEIGHT), 1, VISITS)
        at = self.rng.permutation(np.repeat(np.arange(len(a)), times))
        weight = (count / times).astype(np.float32)
        r, q, c, b = self.model
        for i in range(0, len(at), batch):
            own = at[i : i + batch]
            ctx, nxt, g = a[own], w[own], weight[own] / np.float32(len(own) ** 0.5)
            no = np.minimum(np.searchsorted(self.cum, self.rng.random(self.noise)), len(b) - 1)
            x = r[ctx]
            h, qs, qn = x @ c, q[nxt], q[no]
            d = g * (1 / (1 + np.exp(-(np.einsum("bd,bd->b", h, qs) + b[nxt] - self.base[nxt]))) - 1)
            e = g[:, None] / (1 + np.exp(-(h @ qn.T + (b[no] - self.base[no]))))
            gh = d[:, None] * qs + e @ qn
            both = np.concatenate([nxt, no])
            gr = gh @ c.T
            self._step(1, both, np.concatenate([d[:, None] * h, e.T @ h]))
            self._step(3, both, np.concatenate([d, e.sum(0)]))
            self._step(2, None, x.T @ gh)
            self._step(0, ctx, gr)


def log_norms(h: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each context, the logarithm of the sum over all classes."""
    s = h @ q.T + b
    top = s.max(1)
    return top + np.log(np.exp(s - top[:, None]).sum(1))


def train_nce(pairs: np.ndarray, dimensions: int = DIMENSIONS, steps: int = PASSES) -> np.ndarray:
    """Natural log-probabilities of the next class (columns) after each class (rows), for a table of pair counts that fits in memory; so many passes."""
    k, total = len(pairs), pairs.sum()
    if not total:
        return np.log(np.full((k, k), 1 / k))
    unigram = (pairs.sum(0) + 0.5) / (total + 0.5 * k)
    a, w = np.nonzero(pairs)
    trainer = Trainer(start(unigram, dimensions), unigram)
    for _ in range(steps):
        trainer.visit(a, w, pairs[a, w])
    r, q, c, b = (x.astype(np.float64) for x in trainer.model)
    return (r @ c) @ q.T + b - log_norms(r @ c, q, b)[:, None]


def pair_counts(training: DataFrame, pair_up, groups: int) -> DataFrame:
    """(p, c): blocks of BLOCK pairs' places and counts. pair_up: the places of all pairs of a batch of texts; each pair's count is exact."""

    def split(batches):
        for b in batches:
            for some in by_size(b["text"], CHUNK):
                p, c = np.unique(pair_up(some), return_counts=True)
                g = (mix(p.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(g, kind="stable")
                p, c = p[order], c[order]
                found, at = np.unique(g[order], return_index=True)
                ends = [*at[1:].tolist(), len(p)]
                yield pd.DataFrame({"g": found, "p": [p[i:j].tobytes() for i, j in zip(at, ends)], "c": [c[i:j].tobytes() for i, j in zip(at, ends)]})

    def merge(pdf):
        p, c = (np.frombuffer(b"".join(pdf[x]), np.int64) for x in ("p", "c"))
        order = np.argsort(p, kind="stable")
        p = p[order]
        at = np.flatnonzero(np.diff(p, prepend=-1))
        p, c = p[at], np.add.reduceat(c[order], at)
        cuts = range(0, len(p), BLOCK)
        return pd.DataFrame({"p": [p[i : i + BLOCK].tobytes() for i in cuts], "c": [c[i : i + BLOCK].tobytes() for i in cuts]})

    return map_frames(training, split, "g long, p binary, c binary", CHUNK).groupBy("g").applyInPandas(merge, "p binary, c binary")


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows (word, c) of the commonest words, `most` at most: all that have the count from which on there are no more, to a 32nd of its logarithm."""
    step = F.floor(F.log("c") * 32).cast("int")
    over, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        over += r["n"]
        if over > most:
            break
        least = r["step"]
    return counts.where(step >= least) if least is not None else counts.where("false")


def train(pairs: DataFrame, unigram: np.ndarray, passes: int = PASSES) -> list[np.ndarray]:
    """The model after so many passes over all pair counts. In each, every task trains on its own blocks, one at a time, from the same model; rows are then averaged by how often each task met their class."""
    model, k, spark = start(unigram), len(unigram), pairs.sparkSession
    for turn in range(passes):
        shared = spark.sparkContext.broadcast((model, unigram))

        def fill(batches, turn=turn, shared=shared):
            from pyspark import TaskContext

            before, unigram = shared.value
            trainer = Trainer([x.copy() for x in before], unigram, 0.1 / (turn + 1), 1_000_003 * turn + TaskContext.get().partitionId())
            seen, seen_next = np.zeros(k), np.zeros(k)
            for batch in batches:
                for p, c in zip(batch["p"], batch["c"]):
                    (a, w), c = np.divmod(np.frombuffer(p, np.int64), k), np.frombuffer(c, np.int64)
                    trainer.visit(a, w, c)
                    seen += np.bincount(a, c, k)
                    seen_next += np.bincount(w, c, k)
            met = seen_next.sum()
            weights = [seen, seen_next + 1e-3 * (met > 0), np.array([met]), seen_next + 1e-3 * (met > 0)]
            moved = [(y - x) * (u[:, None] if x.ndim > 1 else u) for x, y, u in zip(before, trainer.model, weights)]
            return np.concatenate([x.ravel() for x in (*moved, *weights[:3])]).astype(np.float32)

        d = model[2].shape[0]
        sizes = np.cumsum([k * d, k * d, d * d, k, k, k])
        out = np.split(tree_merge(pairs, fill, np.add, int(sizes[-1]) + 1, "float32"), sizes)
        weights = [np.maximum(out[4], 1e-9)[:, None], np.maximum(out[5], 1e-9)[:, None], np.maximum(out[6], 1e-9), np.maximum(out[5], 1e-9)]
        model = [(x + y.reshape(x.shape) / u).astype(np.float32) for x, y, u in zip(model, out, weights)]
        shared.unpersist()
    return model


def score_documents(docs: DataFrame, held: int = 0, folds: int = 10, head: int = HEAD, classes: int | None = None) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts are exact and cover every word of all training documents. The neural
    model knows the most frequent words, more of them the more training tokens there are unless classes
    is given, and one class for all others; it is trained on all pair counts. Within that class a word
    has its smoothed share of the counts; so the probabilities of all words and one unseen
    word sum to 1. A null text is empty: it has its end alone. Without training documents each
    token has the probability of an unseen one. Words that are as common go by their order as text. Texts are read whole, some at a time. Repeated rows are scored as often; an empty table gives an empty result; other columns are ignored.
    """
    with scratch() as keep:
        scored, tail, n, whole, rest = _scored(docs, held, folds, head, classes)
        keep(scored), keep(tail)
    found, logs = F.coalesce("found", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return scored.join(tail, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + found).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(float(whole))).alias("base_score"),
        (F.col("neural") + F.col("within") + logs - F.col("rare") * F.lit(float(rest))).alias("score"),
    )


def _scored(docs: DataFrame, held: int, folds: int, head: int, classes: int | None):
    """(sums of each row over the words that tasks know, sums over its other words, training tokens, logarithms of what counts are divided by)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), (crc_mod("doc_id", folds) == held).alias("held_out"))
    training = docs.where("not held_out").select("text")

    def count(batches):
        for b in batches:
            for some in by_size(b["text"], CHUNK):
                own, at, _ = coded(some)
                c = np.bincount(at, minlength=len(own))
                yield pd.DataFrame({"word": own, "c": c})[c > 0]

    counts = cut(map_frames(training, count, "word string, c long", CHUNK).groupBy("word").agg(F.sum("c").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    classes = own_classes(n) if classes is None else classes
    top = sorted(frequent(counts, max(head, classes + 1)).collect(), key=lambda r: (-r["c"], r["word"]))
    known = {r["word"]: int(r["c"]) for r in top}
    ids = {w: i + 1 for i, w in enumerate(w for w in [r["word"] for r in top[: classes + 1]] if w != END) if i < classes - 1}
    ids[END] = 0
    k = len(ids) + 1  # the last class is of all other words
    shared = docs.sparkSession.sparkContext.broadcast((known, ids))

    def steps(own, at, ids):
        """Each token's class, and its place in a table by context and class: a text's first token follows an end."""
        x = np.fromiter((ids.get(w, k - 1) for w in own), np.int64, len(own))[at]
        return x, np.concatenate([[0], x[:-1]]) * k + x

    def pair_up(texts):
        own, at, _ = coded(texts)
        return steps(own, at, shared.value[1])[1]

    inside = sum(known.get(w, 0) for w in ids)
    rare_n, rare_v = n - inside, v - sum(w in known for w in ids)
    share = np.zeros(k)
    share[list(ids.values())] = [known.get(w, 0) for w in ids]
    share[-1] = rare_n
    if n:
        r, q, c, b = train(cut(pair_counts(training, pair_up, max(GROUPS, -(-n // GROUP_TOKENS)))).coalesce(-(-n // TASK_TOKENS)), (share + 0.5) / (n + 0.5 * k))
        h = r @ c
    else:
        h, q, b = np.zeros((k, 1), np.float32), np.zeros((k, 1), np.float32), np.zeros(k, np.float32)
    untold = docs.sparkSession.sparkContext.broadcast((h, q, b))

    def normalise(batches):
        h, q, b = untold.value
        for batch in batches:
            for i in batch["id"]:
                yield pd.DataFrame({"i": [i], "z": [log_norms(h[i * 128 : (i + 1) * 128], q, b).tolist()]})

    norms = sorted(map_frames(docs.sparkSession.range(-(-k // 128)), normalise, "i long, z array<double>").collect(), key=lambda r: r["i"])
    table_ = docs.sparkSession.sparkContext.broadcast((h, q, b, np.concatenate([x["z"] for x in norms])))
    whole, rest = np.log10(n + 0.1 * (v + 1)), np.log10(rare_n + 0.1 * (rare_v + 1))

    def score(batches):
        known, ids = shared.value
        h, q, bias, norm = table_.value

        def after(place):
            """log10 of each token's probability."""
            out = np.empty(len(place))
            for i in range(0, len(place), BLOCK):
                a, w = np.divmod(place[i : i + BLOCK], k)
                out[i : i + BLOCK] = np.einsum("td,td->t", h[a], q[w]) + bias[w] - norm[a]
            return out / np.log(10)

        for b in batches:
            done = []
            for some in by_size(b["text"], CHUNK):
                own, at, starts = coded(some)
                x, place = steps(own, at, ids)
                c = np.fromiter((known.get(w, 0) for w in own), np.float64, len(own))
                has, logs = c > 0, np.where(c > 0, np.log10(c + 0.1), 0.0)
                has, logs, rare = has[at], logs[at], x == k - 1
                sums = [np.add.reduceat(v, starts) for v in (has.astype(np.int64), rare.astype(np.int64), logs, np.where(rare, logs, 0.0), after(place))]
                n = np.diff(starts, append=len(at))
                left, times = np.unique(np.repeat(np.arange(len(n)) * len(own), n)[~has] + at[~has], return_counts=True)
                cuts = np.searchsorted(left, np.arange(len(n) + 1) * len(own)).tolist()
                tail, times = [own[i] for i in (left % len(own)).tolist()], times.tolist()
                lists = [[v[i:j] for i, j in zip(cuts, cuts[1:])] for v in (tail, times)]
                done.append(pd.DataFrame(dict(zip(["n_tokens", "known", "rare", "base", "within", "neural", "tail", "times"], [n, *sums, *lists]))))
            yield pd.concat([b[["doc_id", "held_out", "row"]].reset_index(drop=True), pd.concat(done, ignore_index=True)], axis=1)

    rows = docs.withColumn("row", F.monotonically_increasing_id())
    scored = cut(map_frames(rows, score, "doc_id long, held_out boolean, row long, n_tokens long, known long, rare long, base double, within double, neural double, tail array<string>, times array<long>", CHUNK))
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    tail = cut(
        tail.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("found"),
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1)) * F.col("times")).alias("logs"),
        )
    )
    return cut(scored.drop("tail", "times")), tail, n, whole, rest


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
