"""Near duplicates of embeddings: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, map_frames, scratch, table

COSINE = 0.9
#: Cells are CELLS times the root of the number of vectors; bytes of vectors that centroids are fitted on at most; rows of a band of cells and of a block; rows that are multiplied at once.
CELLS, SAMPLE_BYTES, BLOCK, ROWS = 2.0, 1 << 24, 4_096, 512
#: Lengths of vectors that have cells; rarer lengths are one cell each.
LENGTHS = 1_000
#: Products in single precision are off by less for unit vectors; so near the threshold they are taken again in double precision.
SLACK = 1e-4


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4_096] @ c.T).argmax(1) for i in range(0, len(x), 4_096)])
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        total = np.add.reduceat(x[order], first)
        norm = np.linalg.norm(total, axis=1)
        full = norm > 1e-9
        c[own[order][first][full]] = total[full] / norm[full, None]
    return c


class Cells:
    """Centroids in an order that keeps near ones together, cut into bands."""

    def __init__(self, x: np.ndarray, n: int, block: int = BLOCK):
        c = spherical_kmeans(x, max(1, min(len(x), round(CELLS * n**0.5))))
        bands = max(1, -(-n // block))
        top = spherical_kmeans(c, min(bands, len(c)))
        c = c[np.argsort((c @ top.T).argmax(1), kind="stable")]
        own = np.bincount(np.concatenate([(x[i : i + 4_096] @ c.T).argmax(1) for i in range(0, len(x), 4_096)]), minlength=len(c))
        # Consecutive cells of about a block's rows, by the sample.
        self.band = np.minimum((np.cumsum(own) - own) * bands // max(1, own.sum()), bands - 1)
        self.band = np.unique(self.band, return_inverse=True)[1]
        self.starts = np.flatnonzero(np.diff(self.band, prepend=-1))
        self.c = c

    def places(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, band, whether it is at home there): each vector's own band, and the lower ones with a cell whose dividing plane is within reach."""
        s = x @ self.c.T
        home = s.argmax(1)
        gap = np.sqrt(np.maximum(2 - 2 * (self.c[home] @ self.c.T), 1e-18))
        far = np.minimum.reduceat((s[np.arange(len(s)), home][:, None] - s) / gap, self.starts, axis=1)
        own = self.band[home]
        r, b = np.nonzero((far <= reach) & (np.arange(len(self.starts))[None, :] < own[:, None]))
        return np.concatenate([np.arange(len(x)), r]), np.concatenate([own, b]), np.arange(len(x) + len(r)) < len(x)


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of unit vectors have that cosine or more, in double precision."""
    out = np.zeros((len(x), len(y)), bool)
    xs, ys = x.astype(np.float32), y.astype(np.float32).T
    for i in range(0, len(x), ROWS):
        s = xs[i : i + ROWS] @ ys
        r, c = np.nonzero(s >= cosine - SLACK)
        if len(r) > len(y):
            out[i : i + ROWS] = x[i : i + ROWS] @ y.T >= cosine
        elif len(r):
            ok = np.einsum("ij,ij->i", x[i + r], y[c]) >= cosine
            out[i + r[ok], c[ok]] = True
    return out


def _labels(link: np.ndarray) -> np.ndarray:
    """The lowest row that each row of a symmetric link matrix reaches."""
    a, b = _reached(link, np.arange(len(link)), np.arange(len(link)))
    return np.minimum(a, b)


def _reached(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least of the numbers of rows and columns that each row and each column reaches by links."""
    r, c = np.nonzero(link) if np.count_nonzero(link) <= 1 << 18 else (None, None)
    left, right = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        before = left.sum(dtype=np.float64) + right.sum(dtype=np.float64), left.copy(), right.copy()
        if r is not None:
            np.minimum.at(left, r, right[c])
            np.minimum.at(right, c, left[r])
        else:
            for i in range(0, len(left), ROWS):
                left[i : i + ROWS] = np.minimum(left[i : i + ROWS], np.where(link[i : i + ROWS], right, top).min(1))
                right = np.minimum(right, np.where(link[i : i + ROWS], left[i : i + ROWS, None], top).min(0))
        if (left == before[1]).all() and (right == before[2]).all():
            return left, right


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, reach: float = 1.0, block: int = BLOCK) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept.

    Equal vectors meet in one class first, which then counts as often as it has members.
    Spherical k-means centroids are fitted on a sample of classes by the hash of the vector, SAMPLE_BYTES at most; all classes are
    assigned. There are CELLS times the root of n cells at every n, in an order that keeps near cells together, cut into bands of about a block of vectors. A class is at home
    in the band of its nearest cell and visits each lower band with a cell whose dividing plane is within `reach` times the sine
    of the angle; with 1.0 that is as far as the angle, and no pair is missed, whatever the rank of the vectors. Less visits less and misses pairs. No pair is compared twice. Bands are
    compared block by block, in single precision first, near the threshold again in double; only counts and a spanning forest of each block's links leave it.

    Null and zero vectors, and those with null or non-finite components, link with nothing, as do those of
    different length with each other. A null vec_id is compared but names no
    component. Repeated rows are linked to each other; of equal cosines none is left out. An empty table gives an empty result; other columns are ignored.
    """
    with scratch() as keep:
        all_rows, per_class = _linked_classes(vectors, cosine, reach, block)
        keep(all_rows), keep(per_class)
    return all_rows.join(per_class, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked_classes(vectors: DataFrame, cosine: float, reach: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(vec_id and key of each vector, links and component of each class)."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))

    def unit(batches):
        for b in batches:
            keys, units, dims = [], [], []
            for e in b["e"]:
                v, norm = (None, 0.0) if e is None else (np.asarray(e, np.float64), 0.0)
                if v is not None and len(v) and np.isfinite(v).all():
                    top = np.abs(v).max()
                    norm = np.linalg.norm(v / top) if top > 0 else 0.0
                if norm > 0:
                    keys.append(hashlib.md5((v + 0.0).tobytes()).hexdigest())
                    units.append((v / top / norm).tobytes())
                    dims.append(len(v))
                else:
                    keys.append(None)
                    units.append(None)
                    dims.append(0)
            yield pd.DataFrame({"vec_id": b["vec_id"].array, "key": keys, "u": units, "dim": dims})

    read = cut(map_frames(rows, unit, "vec_id long, key string, u binary, dim int"))
    all_rows = cut(read.select("vec_id", "key"))
    classes = cut(
        read.where("key is not null")
        .groupBy("key")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("u").alias("u"), F.first("dim").alias("dim"))
        .withColumn("id", F.coalesce("id", -F.abs(F.xxhash64("key")) - 1))
    )
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()}
    size = sum(8 * d * n for d, n in sizes.items())
    share = min(1.0, SAMPLE_BYTES / max(size, 1))
    some = classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else classes
    cells = {}
    for dim, own in some.where(F.col("dim").isin(list(sizes))).select("dim", "u").toPandas().groupby("dim"):
        cells[dim] = Cells(np.stack([np.frombuffer(u) for u in own["u"]]), sizes[dim], block)
    shared = spark.sparkContext.broadcast(cells)
    sine = (np.sqrt(max(0.0, 1 - cosine * cosine)) + 1e-6) * reach

    def assign(batches):
        for b in batches:
            for dim, own in b.groupby("dim"):
                for at in range(0, len(own), 1_024):
                    part = own.iloc[at : at + 1_024]
                    if dim in shared.value:
                        r, band, home = shared.value[dim].places(np.stack([np.frombuffer(u) for u in part["u"]]), sine)
                    else:
                        r, band, home = np.arange(len(part)), np.zeros(len(part), int), np.ones(len(part), bool)
                    x = part.iloc[r]
                    yield pd.DataFrame({"dim": dim, "band": band, "home": home, "id": x["id"].array})

    placed = cut(map_frames(classes.select("id", "u", "dim"), assign, "dim int, band int, home boolean, id long"))
    plan = placed.groupBy("dim", "band").agg(F.count(F.when(F.col("home"), 1)).alias("inside"), F.count(F.when(~F.col("home"), 1)).alias("visitors"))
    plan = cut(plan.where("inside > 0").select("dim", "band", F.expr(f"int(ceil(inside / {block}))").alias("hb"), F.expr(f"int(ceil(visitors / {block}))").alias("vb")))
    dealt = placed.join(plan, ["dim", "band"]).withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("vb"))).cast("int"))
    # Home block i meets home blocks j >= i and every block of visitors; a task is a pair of blocks.
    pairs = F.when(
        F.col("home"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda j: F.struct(F.least("own", j).alias("a"), F.greatest("own", j).alias("b"), F.lit(0).alias("v"))),
            F.when(F.col("vb") > 0, F.transform(F.sequence(F.lit(0), F.col("vb") - 1), lambda j: F.struct(F.col("own").alias("a"), j.cast("int").alias("b"), F.lit(1).alias("v")))).otherwise(F.array().cast("array<struct<a:int,b:int,v:int>>")),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda i: F.struct(i.cast("int").alias("a"), F.col("own").alias("b"), F.lit(1).alias("v"))))
    tasks = dealt.withColumn("p", F.explode(pairs)).select("dim", "band", "home", "own", "id", "p.a", "p.b", "p.v").join(classes.select("id", "n", "u"), "id")

    def compare(key, pdf):
        _, _, a, b, v = key
        left = pdf[pdf["home"] & (pdf["own"] == a)]
        same = not v and a == b
        right = left if same else pdf[~pdf["home"]] if v else pdf[pdf["own"] == b]
        none = pd.DataFrame({"id": [], "links": [], "root": []})
        if left.empty or right.empty:
            return none
        x = np.stack([np.frombuffer(u) for u in left["u"]])
        y = x if same else np.stack([np.frombuffer(u) for u in right["u"]])
        link = linked(x, y, cosine)
        if same:
            np.fill_diagonal(link, False)
        if not link.any():
            return none
        count = lambda m, n: np.concatenate([m[i : i + ROWS].astype(np.float64) @ n.to_numpy(np.float64) for i in range(0, len(m), ROWS)]).astype(np.int64)
        roots = _reached(link, left["id"].to_numpy(), right["id"].to_numpy())
        ids, links, root = left["id"].to_numpy(), count(link, right["n"]), roots[0]
        if same:
            root = np.minimum(*roots)
        else:
            ids, links, root = np.concatenate([ids, right["id"]]), np.concatenate([links, count(link.T, left["n"])]), np.concatenate([root, roots[1]])
        keep = links > 0
        return pd.DataFrame({"id": ids[keep], "links": links[keep], "root": root[keep]})

    found = cut(tasks.groupBy("dim", "band", "a", "b", "v").applyInPandas(compare, "id long, links long, root long"))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_class = cut(
        classes.select("key", "id", "n")
        .join(counted, "id", "left")
        .join(groups, "id", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    return all_rows, per_class


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
