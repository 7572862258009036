"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Bytes of rows that a Python worker turns into objects at once.
SLICE_BYTES = 1 << 21
#: ASCII white space that separates words: space and \x09 to \x0D.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bound the rows that Spark hands to Python at once by bytes, unless the session was told another bound: Spark's own is 64 MB a task, kept twice."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(name) is None and spark.conf.get(name).rstrip("b") == "67108864":
        spark.conf.set(name, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Only a session in one process has one without a name."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


_made: list[list[tuple[DataFrame, str]]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends there.

    A lost executor loses nothing of it, and later steps read it as often as
    they like without computing it anew.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/latticework/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _made:
        _made[-1].append((out, path))
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() made in this scope and that nothing reads any more."""
    for t in tables:
        for own in (x for x in _made[-1] if x[0] is t):
            _delete(t.sparkSession, own[1])
            _made[-1].remove(own)
            break


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope at whose end the tables that cut() wrote in it are deleted, but for those that were passed to what it gives: these go to the scope around it.

    What leaves a scope must read no other table of it.
    """
    _made.append([])
    stay: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        stay.append(df)
        return df

    try:
        yield keep
    finally:
        own = _made.pop()
        for t, path in own:
            if any(t is x for x in stay):
                if _made:
                    _made[-1].append((t, path))
            else:
                _delete(t.sparkSession, path)


def numbered(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text and the extra columns, whatever else docs holds."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows of about so many bytes, one row at least: a batch of long rows becomes objects bit by bit."""
    step = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    whole = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}
    out = {}
    for name, col in zip(batch.schema.names, batch.columns):
        out[name] = col.to_pandas(types_mapper=whole.get) if col.null_count else col.to_pandas()
    return pd.DataFrame(out)


def give_back() -> None:
    """Return memory that a task has freed to the system: Python workers outlive their tasks, several to an executor."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(f: Callable) -> Callable:
    """f, a function of a task's batches, that gives memory back when the task ends."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def map_frames(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """df.mapInPandas(f, schema), but frames have `most` bytes, however long the rows, and whole numbers with nulls stay whole."""
    kind = DataType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(kind)
        for pdf in f(_frame(x) for b in batches for x in slices(b, most)):
            if len(pdf):
                yield pa.RecordBatch.from_pandas(pdf, schema=names, preserve_index=False)

    return df.mapInArrow(trimmed(run), kind)


def with_column(df: DataFrame, f: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: StructType, most: int = SLICE_BYTES) -> DataFrame:
    """df's columns that schema names, those that f gives for a slice in place of, or besides, what was there; all others pass untouched, whatever their type."""
    names = schema.names

    def run(batches):
        for b in batches:
            for x in slices(b, most):
                own = f(x)
                yield pa.RecordBatch.from_arrays([own[n] if n in own else x.column(x.schema.get_field_index(n)) for n in names], names)

    return df.mapInArrow(trimmed(run), schema)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def clear_of(spans: list, taken: list) -> list:
    """The spans that overlap none of those taken, which are sorted by start; a span starts with it and has its end third."""
    starts, reach = [t[0] for t in taken], [-1, *accumulate((t[2] for t in taken), max)]
    return [s for s in spans if reach[bisect_left(starts, s[2])] <= s[0]]


def by_size(texts: Iterable[str | None], most: int) -> Iterator[list]:
    """Runs of texts that have most characters or a little over."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def crc_mod(col: str, n: int):
    """crc32 of a column as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tree_merge(
    df: DataFrame,
    fill: Callable[[Iterator[pd.DataFrame]], np.ndarray],
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray],
    size: int,
    dtype: str,
    chunks: int = 8,
) -> np.ndarray:
    """An array of fixed size that every task fills and a two-level tree merges.

    fill gets a task's batches and returns its array. What travels is a bounded
    number of bytes a task, and what reaches the driver is one array. In the first level the
    arrays of about sqrt(tasks) tasks meet, for each chunk on its own.
    """
    step = -(-size // chunks)
    ways = max(1, int(np.ceil(np.sqrt(df.rdd.getNumPartitions()))))

    def leaves(batches):
        out = fill(batches)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        yield pd.DataFrame(
            {
                "g": [part % ways] * chunks,
                "c": list(range(chunks)),
                "b": [zlib.compress(np.ascontiguousarray(out[i * step : (i + 1) * step]).tobytes(), 1) for i in range(chunks)],
            }
        )

    def joined(pdf: pd.DataFrame) -> bytes:
        total = None
        for b in pdf["b"]:
            a = np.frombuffer(zlib.decompress(b), dtype)
            total = a.copy() if total is None else merge(total, a)
        return zlib.compress(total.tobytes(), 1)

    def first(key, pdf):
        return pd.DataFrame({"c": [key[1]], "b": [joined(pdf)]})

    def second(key, pdf):
        return pd.DataFrame({"c": [key[0]], "b": [joined(pdf)]})

    rows = (
        map_frames(df, leaves, "g int, c int, b binary")
        .groupBy("g", "c")
        .applyInPandas(first, "c int, b binary")
        .groupBy("c")
        .applyInPandas(second, "c int, b binary")
        .collect()
    )
    if not rows:
        return np.zeros(size, dtype)
    parts = {r["c"]: np.frombuffer(zlib.decompress(r["b"]), dtype) for r in rows}
    return np.concatenate([parts[i] for i in range(chunks)])[:size]


def power_above(n: float, least: int, most: int) -> int:
    """The power of two from n on, within powers of two."""
    return max(least, min(most, 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))))


def id_filter(ids: DataFrame, col: str, least: int = 1 << 20, most: int = 1 << 28) -> np.ndarray:
    """The packed bits of a one-hash Bloom filter of a long column, 8 to 16 bits an id and `most` in all: 32 MB. Beyond that more ids pass that aren't in it; it never misses one."""
    bits = power_above(8 * ids.count(), least, most)

    def fill(batches):
        out = np.zeros(bits // 8, np.uint8)
        for b in batches:
            slot = _slot(b[col].to_numpy(np.int64), bits)
            np.bitwise_or.at(out, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        return out

    return tree_merge(ids.select(col), fill, np.bitwise_or, bits // 8, "uint8", max(2, bits >> 24))


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def in_filter(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the filter holds, and a few others."""
    slot = _slot(ids, 8 * len(packed))
    return (packed[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of an undirected graph given as (a, b) with a != b.

    Alternates large-star and small-star steps until the edges no longer
    change. Every step aggregates by min, which combines before the
    shuffle, and joins two written tables, so that Spark may split a hot node.
    """
    with scratch() as keep:
        e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

        def mark(df):
            r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            return tuple(r)

        seen = mark(e)
        while seen[0]:
            both = e.union(e.select(F.col("v"), F.col("u")))
            low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m")))
            e1 = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
            low1 = cut(e1.groupBy("u").agg(F.min("v").alias("m")))
            turned = e1.join(low1, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e2 = cut(turned.union(low1.select("u", F.col("m").alias("v"))).distinct())
            now = mark(e2)
            drop(e, low, e1, low1)
            e = e2
            if now == seen:
                break
            seen = now
        keep(e)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
