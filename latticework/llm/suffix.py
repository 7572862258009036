"""Removal of long repeated byte strings by run-length indexes of their contexts."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, id_filter, in_filter, map_frames, mix, scratch, table, with_column

LENGTH, GRAM = 400, 32
#: Bytes of contexts in an index; contexts of one anchor that one index takes; window starts of a step beyond that.
INDEX, CROWD, STEP = 1 << 18, 192, 16
#: Bytes of a text that anchors are sought in at once.
CHUNK = 1 << 22
#: Bytes of texts that copies are sought in before they leave a task.
TEXTS = 1 << 22
_ODD = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER, _INVERSE = _powers(_ODD, 1 << 16), _powers(pow(_ODD, -1, 1 << 64), 1 << 16)


class Hashes:
    """Hashes of any substring of a byte string, from prefix sums."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        global _POWER, _INVERSE
        if n >= len(_POWER):
            _POWER, _INVERSE = _powers(_ODD, 2 * n), _powers(pow(_ODD, -1, 1 << 64), 2 * n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _POWER[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _INVERSE[start] + (end - start).astype(np.uint64))


def _anchors(raw: np.ndarray, length: int, gram: int):
    """(position, first and last start) of each anchor: the k-gram of least hash in the windows that start there."""
    n = len(raw)
    h = Hashes(raw)
    at = np.arange(n - gram + 1)
    v = (h.of(at, at + gram) >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
    w = length - gram + 1
    pad = -len(v) % w
    m = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(m, 1).ravel()
    behind = np.minimum.accumulate(m[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - length + 1
    pos = (np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(pos, prepend=-1))
    last = np.append(first[1:], starts) - 1
    return h, pos[first], first, last


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, context hash, anchor position, first start, last start) of all windows of a text.

    Every window belongs to one anchor within it, chosen by its content alone, so
    equal windows have equal anchors at equal offsets. A context reaches from
    the first window's start to the last window's end.
    """
    raw = np.frombuffer(data, np.uint8)
    out = []
    for at in range(0, max(0, len(raw) - length + 1), CHUNK):
        h, pos, first, last = _anchors(raw[at : at + CHUNK + length - 1], length, gram)
        out.append((h.of(pos, pos + gram).view(np.int64), h.of(first, last + length).view(np.int64), pos + at, first + at, last + at))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


class RunIndex:
    """A run-compressed Burrows-Wheeler transform with sampled ends of runs.

    Of the suffix order only what the runs need is kept: where each run of equal
    preceding bytes begins and ends in the text, and how much the suffix there
    shares with its neighbour. All other shared lengths follow: inside a run,
    the text position after one that shares l bytes with its neighbour shares l - 1.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts])
        self.ends = np.cumsum(sizes) - 1
        codes = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + len(texts)
        codes[self.ends] = np.arange(len(texts))  # each separator is a letter of its own
        packed, self.step = self._packed(codes)
        order = self._order(packed, self.step)
        before = codes[order - 1]
        run = np.flatnonzero(np.diff(before, prepend=-1))
        self.letters = before[run]
        self.lengths = np.diff(np.append(run, len(order)))
        heads, tails = order[run], order[np.append(run[1:], len(order)) - 1]
        above = np.where(run > 0, order[run - 1], -1)
        nxt = np.append(run[1:], len(order))
        below = np.where(nxt < len(order), order[np.minimum(nxt, len(order) - 1)], -1)
        self.up = self._samples(heads, self._shared(codes, packed, self.step, heads, above))
        self.down = self._samples(tails, self._shared(codes, packed, self.step, tails, below))
        self.n = len(codes)

    @staticmethod
    def _packed(codes: np.ndarray) -> tuple[np.ndarray, int]:
        """For each position as many letters as fit into a number, and how many these are."""
        bits = int(codes.max() + 1).bit_length()
        step = max(1, 62 // bits)
        long = np.concatenate([codes + 1, np.zeros(step, np.int64)])
        out = np.zeros(len(codes), np.int64)
        for i in range(step):
            out = out << bits | long[i : i + len(codes)]
        return out, step

    @staticmethod
    def _order(packed: np.ndarray, h: int) -> np.ndarray:
        """The suffix order by doubling; only suffixes not yet told apart are sorted again."""
        n = len(packed)
        live = np.argsort(packed)
        fresh = np.flatnonzero(np.diff(packed[live], prepend=-1))
        sizes = np.diff(np.append(fresh, n))
        rank = np.empty(n, np.int64)
        rank[live] = np.repeat(fresh, sizes)
        live = live[np.repeat(sizes > 1, sizes)]
        while len(live):
            after = np.where(live + h < n, rank[np.minimum(live + h, n - 1)], -1) + 1
            key = rank[live] * (n + 1) + after
            by = np.argsort(key)
            live, key = live[by], key[by]
            own = rank[live]
            new_group = np.diff(own, prepend=-1) != 0
            new_key = np.diff(key, prepend=-1) != 0
            at = np.arange(len(live))
            group_start = np.maximum.accumulate(np.where(new_group, at, 0))
            key_start = np.maximum.accumulate(np.where(new_key, at, 0))
            rank[live] = own + key_start - group_start
            alone = new_key & np.append(new_key[1:], True)
            live = live[~alone]
            h *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        return order

    @staticmethod
    def _shared(codes: np.ndarray, packed: np.ndarray, step: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters the suffixes at a and b share: packed ones first, then the rest one by one."""
        out = np.zeros(len(a), np.int64)
        n = len(codes)
        for letters, k in ((packed, step), (codes, 1)):
            live = np.flatnonzero(b >= 0)
            while len(live):
                x, y = a[live] + out[live], b[live] + out[live]
                same = (np.maximum(x, y) < n) & (letters[np.minimum(x, n - 1)] == letters[np.minimum(y, n - 1)])
                live = live[same]
                out[live] += k
        return out

    @staticmethod
    def _samples(at: np.ndarray, shared: np.ndarray):
        by = np.argsort(at)
        return at[by], shared[by]

    def texts(self) -> list[bytes]:
        """The texts, from the runs alone: equal letters stand in the same order before suffixes and at their start."""
        before = np.repeat(self.letters, self.lengths)
        after = np.argsort(before, kind="stable")  # from a suffix's place to that of the suffix one further
        first, out, place = before[after], np.empty(self.n, np.int64), after[len(self.ends) - 1]
        for i in range(self.n):
            out[i], place = first[place], after[place]
        return [(x[:-1] - len(self.ends)).astype(np.uint8).tobytes() for x in np.split(out, self.ends + 1)[:-1]]

    def statistics(self) -> np.ndarray:
        """For each position in text order, the longest string that starts there and somewhere else."""
        p = np.arange(self.n)
        out = np.zeros(self.n, np.int64)
        for at, shared in (self.up, self.down):
            k = np.searchsorted(at, p, "right") - 1
            out = np.maximum(out, np.where(k >= 0, shared[k] - (p - at[k]), 0))
        return out


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of distinct contexts, the starts of windows that start elsewhere too."""
    index = RunIndex(contexts)
    long = index.statistics() >= length
    return [np.flatnonzero(long[e - len(t) : e]) for t, e in zip(contexts, index.ends)]


def _ranges(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of consecutive numbers."""
    if not len(starts):
        return [], []
    cutat = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.append(0, cutat + 1)].tolist(), starts[np.append(cutat, len(starts) - 1)].tolist()


def text_id(data: bytes) -> str:
    return hashlib.md5(data).hexdigest()


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(text, firsts, lasts): for the id of each text with repeated windows, the ranges of their starts.

    Equal texts, and then equal contexts of an anchor, are one with a weight; a context of weight 2 is repeated
    as a whole. The distinct contexts of an anchor with several are indexed together. Anchors of more than CROWD distinct contexts
    are dealt with by counting window hashes over all tasks: first, for STEP windows at once, what all of them hold and what any
    of them holds; then window by window where that leaves it open. So no group is ever gathered, and no candidate is left out.
    """
    with scratch() as keep:
        return keep(cut(_spans(docs, length, gram)))


def _spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def find(batches):
        for b in batches:
            seen: dict[str, int] = {}
            rows = []
            for t in b["text"]:
                data = t.encode("utf-8", "surrogatepass")
                if len(data) >= length:
                    k = text_id(data)
                    seen[k] = seen.get(k, 0) + 1
                    if seen[k] == 1:
                        seed, ctx, _, first, last = anchors(data, length, gram)
                        rows.append((k, seed, ctx, first.astype(np.int32), (last - first).astype(np.int32)))
            yield pd.DataFrame([(*r, seen[r[0]]) for r in rows], columns=["text", "seed", "ctx", "first", "more", "weight"])

    cols = "text string, seed array<long>, ctx array<long>, first array<int>, more array<int>"
    per_text = map_frames(docs, find, cols + ", weight long", TEXTS).groupBy("text").agg(*[F.first(c).alias(c) for c in ("seed", "ctx", "first", "more")], F.sum("weight").alias("weight"))
    found = cut(per_text)
    occ = found.select("text", "weight", F.explode(F.arrays_zip("seed", "ctx", "first", "more")).alias("x")).select("text", "weight", "x.*")
    weights = occ.groupBy("seed", "ctx").agg(F.sum("weight").alias("n"))
    weights = cut(weights.groupBy("seed").agg(F.sum("n").alias("all"), F.count("*").alias("distinct"), F.min(F.struct("ctx", "n")).alias("one")).where("all > 1").select("seed", "distinct"))
    several = cut(weights.where("distinct > 1"))
    copies = cut(
        occ.join(weights.select("seed"), "seed", "left_semi")
        .groupBy("seed", "ctx")
        .agg(F.sum("weight").alias("n"))
    )
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(several, "seed"))

    def contexts(batches):
        done: set = set()
        for b in batches:
            out = []
            for t in b["text"]:
                data = t.encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                seed, ctx, pos, first, last = anchors(data, length, gram)
                for i in np.flatnonzero(in_filter(wanted.value, seed)).tolist():
                    k = (seed[i], ctx[i])
                    if k not in done:
                        done.add(k)
                        out.append((*k, int(pos[i] - first[i]), data[first[i] : last[i] + length]))
            if len(done) > 200_000:
                done.clear()
            yield pd.DataFrame(out, columns=["seed", "ctx", "pos", "bytes"])

    texts = map_frames(docs, contexts, "seed long, ctx long, pos int, bytes binary", TEXTS).groupBy("seed", "ctx").agg(F.first("pos").alias("pos"), F.first("bytes").alias("bytes"))
    texts = cut(texts.join(several, "seed"))
    total = texts.where(f"distinct <= {CROWD}").agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(1, -(-total // INDEX))

    def index(key, pdf):
        got = repeated_starts(list(pdf["bytes"]), length)
        out = [(s, c, *_ranges(g)) for s, c, g in zip(pdf["seed"], pdf["ctx"], got) if len(g)]
        return pd.DataFrame(out, columns=["seed", "ctx", "firsts", "lasts"])

    mark = "seed long, ctx long, firsts array<int>, lasts array<int>"
    by_index = texts.where(f"distinct <= {CROWD}").withColumn("b", F.pmod(F.xxhash64("seed"), F.lit(buckets))).groupBy("b").applyInPandas(index, mark)

    def steps(batches):
        """For each step of windows, by their distance from the anchor: what all hold, and what any holds."""
        for b in batches:
            out = []
            for seed, ctx, pos, data in b[["seed", "ctx", "pos", "bytes"]].itertuples(index=False):
                h = Hashes(np.frombuffer(data, np.uint8))
                n = len(data) - length + 1
                step = (pos - np.arange(n)) // STEP
                for k in np.unique(step).tolist():
                    own = np.flatnonzero(step == k)
                    core = np.array([pos - k * STEP]), np.array([pos - k * STEP - STEP + 1 + length])
                    whole = len(own) == STEP
                    full = h.of(own[:1], own[-1:] + length)[0] if whole else 0
                    out.append((seed, ctx, k, int(h.of(*core).view(np.int64)[0]), int(np.int64(np.uint64(full).view(np.int64))) if whole else None, int(own[0]), int(own[-1])))
            pdf = pd.DataFrame(out, columns=["seed", "ctx", "step", "core", "full", "lo", "hi"])
            pdf["full"] = pd.array([x[4] for x in out], "Int64")
            yield pdf

    crowd = texts.where(f"distinct > {CROWD}").repartition(F.xxhash64("seed", "ctx"))
    stepped = cut(map_frames(crowd, steps, "seed long, ctx long, step int, core long, full long, lo int, hi int"))
    cores = cut(stepped.groupBy("seed", "step", "core").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    fulls = cut(stepped.where("full is not null").groupBy("seed", "step", "full").agg(F.count("*").alias("n")).where("n > 1"))
    open_ = stepped.join(cores, ["seed", "step", "core"]).join(fulls, ["seed", "step", "full"], "left")
    open_ = cut(open_.select("seed", "ctx", "step", "full", "lo", "hi", F.col("n").isNotNull().alias("all")))
    # Steps that are repeated as a whole need no marks window by window, but one of each must be there for others to meet.
    met = open_.where("all").groupBy("seed", "step", "full").agg(F.min(F.struct("ctx", "lo", "hi")).alias("x")).select("seed", "x.*")
    todo = cut(open_.where("not all").select("seed", "ctx", "lo", "hi").union(met).groupBy("seed", "ctx").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his")))

    def singly(batches):
        for b in batches:
            out = []
            for seed, ctx, pos, data, los, his in b[["seed", "ctx", "pos", "bytes", "los", "his"]].itertuples(index=False):
                h = Hashes(np.frombuffer(data, np.uint8))
                at = np.concatenate([np.arange(lo, hi + 1) for lo, hi in zip(los, his)])
                out.append(pd.DataFrame({"seed": seed, "ctx": ctx, "far": pos - at, "h": h.of(at, at + length).view(np.int64), "at": at}))
            if out:
                yield pd.concat(out)

    single = cut(map_frames(crowd.join(todo, ["seed", "ctx"]), singly, "seed long, ctx long, far int, h long, at int"))
    twice = cut(single.groupBy("seed", "far", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    by_count = (
        single.join(twice, ["seed", "far", "h"])
        .select("seed", "ctx", F.col("at").alias("lo"), F.col("at").alias("hi"))
        .union(open_.where("all").select("seed", "ctx", "lo", "hi"))
        .groupBy("seed", "ctx")
        .agg(F.collect_list("lo").alias("firsts"), F.collect_list("hi").alias("lasts"))
    )
    marked = cut(by_index.union(by_count))
    whole = copies.where("n > 1").select("seed", "ctx", F.lit(True).alias("whole"))
    state = cut(copies.select("seed", "ctx").join(whole, ["seed", "ctx"], "left").join(marked, ["seed", "ctx"], "left").where("whole or firsts is not null"))
    hit = occ.select("text", "seed", "ctx", "first", "more").join(state, ["seed", "ctx"])
    some = F.when(F.col("whole"), F.array(F.struct(F.lit(0).alias("a"), F.col("more").alias("b")))).otherwise(F.transform(F.arrays_zip("firsts", "lasts"), lambda x: F.struct(x["firsts"].alias("a"), x["lasts"].alias("b"))))
    return hit.select("text", "first", F.explode(some).alias("x")).groupBy("text").agg(F.collect_list(F.col("first") + F.col("x.a")).alias("firsts"), F.collect_list(F.col("first") + F.col("x.b")).alias("lasts"))


def cover(n: int, firsts, lasts, length: int = LENGTH) -> np.ndarray:
    """Which of n bytes the windows that start in the ranges cover."""
    edge = np.zeros(n + 1, np.int64)
    if firsts is not None and len(firsts):
        np.add.at(edge, np.asarray(firsts), 1)
        np.add.at(edge, np.asarray(lasts) + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _with_marks(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, str, str]:
    """docs with the ranges of repeated windows of each text, and the names of the columns that hold them."""
    key, firsts, lasts = (fresh(docs, f"repeat_{x}") for x in ("key", "firsts", "lasts"))
    marks = spans(docs, length, gram).select(F.col("text").alias(key), F.col("firsts").alias(firsts), F.col("lasts").alias(lasts))
    own = docs.withColumn(key, F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    return own.join(marks, key, "left").drop(key), firsts, lasts


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removes each byte that a string of `length` bytes covers which starts elsewhere too, in this or any other
    document. All copies go, the first too. A null text is empty; texts shorter than a window lose nothing; repeated rows of that
    length lose everything. Texts are read whole, CHUNK bytes at a time. An empty table gives an empty result; other columns are ignored.
    """
    marked, firsts, lasts = _with_marks(docs.select("doc_id", F.col("text").cast("string").alias("text")), length, gram)

    def run(batches):
        for b in batches:
            out = []
            for t, a, z in zip(b["text"], b[firsts], b[lasts]):
                raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
                gone = cover(len(raw), a, z, length)
                out.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            pdf = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            pdf.insert(0, "doc_id", b["doc_id"].array)
            yield pdf

    return map_frames(marked, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with repeated strings cut out of text: of a character that is only partly repeated nothing is cut.

    A null text stays null, every other column as it is, whatever its name or type. Repeated rows stay, without what they repeat; an empty table gives an empty result.
    """
    marked, firsts, lasts = _with_marks(docs, length, gram)

    def run(b):
        text, a, z = (b.column(b.schema.get_field_index(c)) for c in ("text", firsts, lasts))
        out = []
        for t, a, z in zip(text.to_pylist(), a.to_pylist(), z.to_pylist()):
            if t is None or not a:
                out.append(t)
                continue
            raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            gone = cover(len(raw), a, z, length)
            start = np.flatnonzero((raw & 0xC0) != 0x80)
            whole = np.minimum.reduceat(gone.astype(np.uint8), start).astype(bool)
            out.append(raw[~np.repeat(whole, np.diff(np.append(start, len(raw))))].tobytes().decode("utf-8", "surrogatepass"))
        return {"text": pa.array(out, text.type)}

    return with_column(marked, run, docs.schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
