"""Exact Jaccard join of word n-gram sets: block-skipped index lists and answers derived from similar sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, drop, fresh, id_filter, in_filter, map_frames, mix, power_above, scratch, table, tree_merge, words

#: Counters of the frequency sketch at least and at most, characters that one stands for between these.
SKETCH, SKETCH_MOST, SKETCH_TEXT = 1 << 20, 1 << 24, 512
#: Bits of a set's parity sketch at least, sets of an index block, sets of a list that one task takes.
PARITY, BLOCK, LIST = 1024, 64, 2_048
#: Pairs a set that a list gives at once, and turns.
EACH, TURNS = 4, 3
_TURN = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(64)], np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct n-grams; with fewer words, of all words as one."""
    own = words(text)
    n = len(own)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, n)
    if n < size:
        return mix(np.array([(h * _TURN[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out += h[i : n - size + 1 + i] * _TURN[i]
    return np.unique(mix(out))


def class_id(s: np.ndarray) -> int:
    """64 bits of the digest of a set; equal sets are one class."""
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)


def text_id(text: str | None) -> int:
    """64 bits of the hash of a text, to find it again."""
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def parity(s: np.ndarray) -> bytes:
    """For each low-bit pattern of hashes, whether a set has an odd number of them; about a bit a token.

    Where two sketches differ, one set has a token that the other lacks.
    """
    bits = max(PARITY, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: pd.Series, b: pd.Series) -> np.ndarray:
    """In how many places sketches differ, a larger one folded to the size of the smaller: no more than the tokens that only one set has."""
    out = np.zeros(len(a), np.int64)
    sizes = np.stack([a.map(len), b.map(len)], 1)
    for x, y in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == (x, y)).all(1))
        m = min(x, y)
        p, q = (np.bitwise_xor.reduce(np.frombuffer(b"".join(v.iloc[at]), np.uint8).reshape(len(at), -1, m), 1) for v in (a, b))
        out[at] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
    return out


def folded(sketch: bytes) -> bytes:
    """A parity sketch of PARITY / 2 bits, small enough to travel with index lists."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, PARITY // 16), 0).tobytes()


def list_pairs(ids: np.ndarray, n: np.ndarray, pos: np.ndarray, label: np.ndarray, small: np.ndarray, percent: int, side: np.ndarray | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of an index list that could be similar and are not yet known to be connected, and whether these are all.

    The list is ordered by set size and cut into blocks that hold their bounds
    on size, position and label. A block pair is skipped as a whole if sizes are too far apart, if the positions of the
    shared token leave too little overlap, or if all of it is connected. If there are over `most` pairs, each set has its nearest alone.
    """
    order = np.lexsort((pos, n))
    ids, n, pos, label, small = ids[order], n[order], pos[order], label[order], small[order]
    side = None if side is None else side[order]
    at = range(0, len(n), BLOCK)
    low, high = [int(n[i]) for i in at], [int(n[min(i + BLOCK, len(n)) - 1]) for i in at]
    least, single = [int(pos[i : i + BLOCK].min()) for i in at], [label[i] if (label[i : i + BLOCK] == label[i]).all() else None for i in at]
    a, b, total = [], [], 0
    best, nearest = np.full(len(n), 1 << 30), np.zeros(len(n), np.int64)

    def nearer(x, y, d):
        by = np.lexsort((d, x))
        x, y, d = x[by], y[by], d[by]
        first = np.flatnonzero(np.diff(x, prepend=-1))
        x, y, d = x[first], y[first], d[first]
        less = d < best[x]
        best[x[less]], nearest[x[less]] = d[less], y[less]

    for x, i in enumerate(at):
        for y in range(x, len(low)):
            if low[y] * percent > high[x] * 100:
                break
            if single[x] is not None and single[x] == single[y]:
                continue
            if (least[x] + least[y]) * (100 + percent) > (high[x] + high[y]) * (100 - percent):
                continue
            j = y * BLOCK
            p, q = slice(i, i + BLOCK), slice(j, j + BLOCK)
            nn = n[p, None] + n[None, q]
            ok = (n[None, q] * percent <= n[p, None] * 100) & (n[p, None] * percent <= n[None, q] * 100) & (label[p, None] != label[None, q])
            # Before the first shared token, neither has anything of the other: a bound on what they don't share.
            ok &= (pos[p, None] + pos[None, q]) * (100 + percent) <= nn * (100 - percent)
            if side is not None:
                ok &= side[p, None] != side[None, q]
            if x == y:
                ok = np.triu(ok, 1)
            r, c = np.nonzero(ok)
            differ = np.bitwise_count(small[i + r] ^ small[j + c]).sum(1, dtype=np.int64)
            near = differ * (100 + percent) <= (n[i + r] + n[j + c]) * (100 - percent)
            r, c, differ = i + r[near], j + c[near], differ[near]
            total += len(r)
            if most is not None:
                nearer(r, c, differ)
                nearer(c, r, differ)
            if most is None or total <= most:
                a.append(r)
                b.append(c)
            else:
                a, b = [], []
    if most is not None and total > most:
        r = np.flatnonzero(best < 1 << 30)
        return ids[r], ids[nearest[r]], False
    r, c = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (a, b))
    return ids[r], ids[c], True


def groups(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their
    n-gram sets. component_id is the least doc_id reachable by links. Exact but for
    collisions of 64-bit hashes.

    A null or empty text has 0 shingles and its own component. Texts are read whole, however long. Repeated rows are
    linked; a null doc_id takes the least doc_id of its group, or null. An empty table gives an empty result; other columns are ignored.
    """
    grouped = labelled(docs, size, percent)
    least = cut(grouped.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")))
    return grouped.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of documents that links connect, that of least doc_id; rows without a word are in no group and all stay.

    A row is known by its doc_id and text: two texts that share a doc_id are two documents, and rows that share both are one. In a
    group without any doc_id, the row of least key stays. Every column passes as it is.
    """
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    with scratch() as keep:
        grouped = labelled(keyed.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), size, percent, key)
        rows = cut(grouped.groupBy("label", "key", "doc_id").agg(F.count("*").alias("times")))
        # Written, so that Spark may split the join at the label of a large group.
        first = cut(rows.groupBy("label").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("x")).select("label", F.col("x.key").alias("best")))
        told = cut(rows.join(first, "label").select(F.col("key").alias(key), (F.col("key") == F.col("best")).alias("stays"), "times"))
        gone = keep(cut(told.where("not stays or times > 1").select(key).distinct()))
        many = keep(cut(told.where("stays and times > 1").select(key).distinct()))
    return keyed.join(gone, key, "left_anti").union(keyed.join(many, key, "left_semi").dropDuplicates([key])).select(*docs.columns)


def labelled(docs: DataFrame, size: int, percent: int, key: str | None = None) -> DataFrame:
    """A row per document: doc_id, n_shingles, label of its group (null without words) and its key, if that column is named.

    Equal sets are one class. Tokens are ordered rarest last only as far as a sketch, which grows with the texts,
    tells heavy ones apart; each set indexes its prefix, in which similar sets must share a token. First, each set is held
    against the pivot of most of its lists, the set of a list with the fewest tokens of its own: most of a group of near copies
    connects in as many comparisons as it has members.
    Then the lists that still hold sets of several components are searched by
    blocks; pairs of connected sets are skipped, as their answer follows. A list with over EACH pairs a set gives each set's nearest
    first, and is searched again when these are connected; in the last of TURNS turns it gives all. Candidates pass a bound from parity sketches
    before their sets are compared. Lists are split over tasks at LIST sets, so none is gathered whole.
    """
    with scratch() as keep:
        return keep(_labelled(docs, size, percent, key))


def _labelled(docs: DataFrame, size: int, percent: int, key: str | None) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), *([F.col(key).alias("key")] if key else []))
    counters = power_above((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / SKETCH_TEXT, SKETCH, SKETCH_MOST)

    def sketch(batches):
        out = np.zeros(counters, np.uint32)
        for b in batches:
            sets = [shingle_set(t, size) for t in b["text"]]
            at, n = np.unique((np.concatenate(sets) & np.uint64(counters - 1)).astype(np.int64), return_counts=True)
            out[at] += n.astype(np.uint32)
        return np.minimum(out, 1 << 31)

    seen = tree_merge(docs.select("text"), sketch, lambda a, b: np.minimum(a.astype(np.int64) + b, 1 << 31).astype(np.uint32), counters, "uint32")
    heavy = spark.sparkContext.broadcast(np.packbits(seen > 3 * seen.mean() + 48))

    def sign(batches):
        hot = np.unpackbits(heavy.value).astype(bool)
        for b in batches:
            out = []
            for t in b["text"]:
                s = shingle_set(t, size)
                n = len(s)
                if not n:
                    out.append((0, None, None, None, None, 0))
                    continue
                common = hot[(s & np.uint64(counters - 1)).astype(np.int64)]
                order = np.lexsort((s, common))[: n - -(-percent * n // 100) + 1]
                out.append((n, class_id(s), s[order].view(np.int64), (sketch := parity(s)), folded(sketch), int(1000 * common[order].mean())))
            pdf = pd.DataFrame(out, columns=["n", "cid", "prefix", "parity", "small", "central"])
            pdf["tid"] = [text_id(t) for t in b["text"]]
            pdf["cid"] = pd.array([x[1] for x in out], "Int64")
            pdf.insert(0, "doc_id", b["doc_id"].array)
            if key:
                pdf["key"] = b["key"].array
            yield pdf

    signed = cut(map_frames(docs, sign, "doc_id long, n long, cid long, prefix array<long>, parity binary, small binary, central int, tid long" + ", key long" * bool(key)))
    reps = cut(signed.where("n > 0").groupBy("cid", "n").agg(F.first("prefix").alias("prefix"), F.first("parity").alias("parity"), F.first("small").alias("small"), F.first("central").alias("central"), F.min("tid").alias("tid")))
    slim = cut(signed.select("doc_id", "n", "cid", *(["key"] if key else [])))
    drop(signed)
    posts = reps.select("cid", "n", "central", F.posexplode("prefix").alias("pos", "tok"))
    lists = posts.groupBy("tok").agg(F.count("*").alias("c"), F.max(F.struct("central", "cid", "n")).alias("p")).where("c > 1")
    lists = cut(lists.select("tok", "c", F.col("p.cid").alias("pivot"), F.col("p.n").alias("pn")))
    members = cut(posts.drop("central").join(lists, "tok"))
    drop(lists)
    sketches = reps.select("cid", "n", "parity", "tid")

    def likely(pairs):
        """Pairs (a, b), with a text of each, that their sizes and parity sketches leave possible."""
        sk = lambda x: sketches.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"), F.col("tid").alias(f"t{x}"))

        def bound(batches):
            for b in batches:
                if len(b):
                    yield b.loc[apart(b["pa"], b["pb"]) * (100 + percent) <= (b["na"] + b["nb"]).to_numpy() * (100 - percent), ["a", "b", "ta", "tb"]]

        return map_frames(pairs.join(sk("a"), "a").join(sk("b"), "b").select("a", "b", "na", "nb", "pa", "pb", "ta", "tb"), bound, "a long, b long, ta long, tb long")

    def verified(pairs):
        """Those of the pairs (a, b) that are similar."""
        wanted = spark.sparkContext.broadcast(id_filter(pairs.select(F.explode(F.array("ta", "tb")).alias("id")).distinct(), "id"))

        def gather(batches):
            done: set[int] = set()
            for b in batches:
                out = []
                ids = np.array([text_id(t) for t in b["text"]], np.int64)
                for i in np.flatnonzero(in_filter(wanted.value, ids)).tolist():
                    k = int(ids[i])
                    if k not in done:
                        done.add(k)
                        s = shingle_set(b["text"].iat[i], size)
                        if len(s):
                            out.append((class_id(s), s.tobytes()))
                if len(done) > 100_000:
                    done.clear()
                yield pd.DataFrame(out, columns=["cid", "s"]).astype({"cid": "int64"})

        sets = cut(map_frames(docs.select("text"), gather, "cid long, s binary").groupBy("cid").agg(F.first("s").alias("s")))

        def compare(batches):
            for b in batches:
                ok = []
                for x, y in zip(b["sa"], b["sb"]):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield b.loc[np.array(ok, bool), ["a", "b"]]

        one = lambda x: sets.select(F.col("cid").alias(x), F.col("s").alias(f"s{x}"))
        out = cut(map_frames(pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "sa", "sb"), compare, "a long, b long"))
        drop(sets)
        return out

    near = f"pn * {percent} <= n * 100 and n * {percent} <= pn * 100"
    firsts = members.where("cid <> pivot").where(near).groupBy(F.col("cid").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("c"))
    firsts = firsts.groupBy("a").agg(F.min(F.struct(-F.col("c"), "b")).alias("x")).select("a", "x.b")  # the first set of most of its lists
    label = cut(components(verified(cut(likely(firsts)))).select(F.col("id").alias("cid"), F.col("component").alias("label")))

    def listed(label, open_):
        """Lists of several components, in parts of LIST sets, or pairs of parts. open_: tokens of the lists to search; None: all."""
        own = members if open_ is None else members.join(open_, "tok")
        marked = own.join(label, "cid", "left").select("tok", "cid", "n", "pos", "c", F.coalesce("label", "cid").alias("label"))
        mixed = cut(marked.groupBy("tok").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("tok"))
        spread = (
            marked.join(mixed, "tok")
            .join(reps.select("cid", "small"), "cid")
            .withColumn("parts", F.expr(f"int(ceil(c / {LIST}))"))
            .withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("tok", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"), F.struct("cid", "n", "pos", "label", "small", "own").alias("m"))
        )
        got = spread.groupBy("tok", "x", "y").agg(F.collect_list("m").alias("m")).where("size(m) > 1")
        return got.select("tok", F.col("x") != F.col("y"), *[F.col(f"m.{k}").alias(k) for k in ("cid", "n", "pos", "label", "small", "own")]).toDF("tok", "two", "cid", "n", "pos", "label", "small", "own")

    def search(last):
        def run(batches):
            for b in batches:
                a, c, unfinished = [], [], []
                for tok, two, *cols in b.itertuples(index=False):
                    ids, n, pos, lab, small, own = cols
                    ids, n, pos, lab, own = map(np.asarray, (ids, n, pos, lab, own))
                    small = np.frombuffer(b"".join(small), np.uint64).reshape(len(ids), -1)
                    x, y, whole = list_pairs(ids, n.astype(np.int64), pos.astype(np.int64), lab, small, percent, own if two else None, None if last else EACH * len(ids))
                    a.append(np.minimum(x, y))
                    c.append(np.maximum(x, y))
                    if not whole:
                        unfinished.append(tok)
                if a:
                    yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(c), "tok": None}).drop_duplicates()
                    yield pd.DataFrame({"a": None, "b": None, "tok": unfinished})

        return run

    open_ = None
    for turn in range(TURNS):
        found = cut(map_frames(listed(label, open_), search(turn == TURNS - 1), "a long, b long, tok long").distinct())
        rest = cut(likely(found.where("tok is null").select("a", "b")))
        if rest.limit(1).count():
            more = verified(rest)
            lab = lambda x: label.select(F.col("cid").alias(x), F.col("label").alias(f"l{x}"))
            joined = components(cut(more.join(lab("a"), "a", "left").join(lab("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))))
            joined = cut(joined.select(F.col("id").alias("label"), F.col("component").alias("top")))
            lone = joined.join(label.select("cid"), F.col("label") == F.col("cid"), "left_anti").select(F.col("label").alias("cid"), "top")
            label = cut(label.join(joined, "label", "left").select("cid", F.coalesce("top", "label").alias("label")).union(lone.toDF("cid", "label")).distinct())
        open_ = found.where("tok is not null").select("tok").distinct()
        if not open_.limit(1).count():
            break
    own = ["key"] if key else []
    grouped = slim.join(label, "cid", "left")
    return cut(grouped.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "cid").alias("label"), *own))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
