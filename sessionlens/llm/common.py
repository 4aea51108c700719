"""Shared helpers: reading tables, written tables in the shared folder, salted joins, vectorised words and shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators of the contracts: space and \t..\r.
SEPARATORS = b" \t\n\x0b\x0c\r"
SHINGLE = 5
#: Texts are turned into arrays in slices of about so many bytes, so that memory doesn't follow the batch.
SLICE_BYTES = 1 << 20

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C55
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LANES = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3], np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SEPARATORS)] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. Only a local session, as in tests, may do without and gets a folder of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='sessionlens-')}"
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def written_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, which cuts lineage and survives lost executors; and its path."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, what: str) -> DataFrame:
    return written_at(df, what)[0]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_folder() named."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Have the driver's JVM collect garbage, so that executors delete the shuffle files of queries that have ended. Written tables don't need them."""
    spark._jvm.System.gc()


def salted_left_join(left: DataFrame, right: DataFrame, on: list[str], spread_by: str, salts: int = 16) -> DataFrame:
    """left LEFT JOIN right, with the rows of one key dealt to `salts` tasks; right has one row a key."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], "left").drop("_salt")


def sized(df: DataFrame, rows: int, *keys: str, per: int = 100_000) -> DataFrame:
    """df dealt by keys to as many partitions as its number of rows asks for, where that is fewer than the session's."""
    parts = max(1, -(-rows // per))
    return df.repartition(parts, *keys) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def spread_join(left: DataFrame, right: DataFrame, on: str, sizes: DataFrame, spread_by: str, most: int = 4096, salts: int = 64, total: int | None = None) -> DataFrame:
    """left JOIN right, which has one row a key, with the rows of large keys dealt to `salts` tasks.

    sizes has the key and n, its number of rows in left. Large are keys with over one in `most` rows, so there are fewer than
    `most` of them, and they are broadcast; the sides themselves, which grow with the input, never are. total: rows in left, if known; then
    they also set the number of partitions.
    """
    rows = (sizes.agg(F.sum("n")).first()[0] or 0) if total is None else total
    large = F.broadcast(sizes.where(F.col("n") > max(1_000, rows // most)).select(on, F.lit(True).alias("_large")))
    left = left.join(large, on, "left").withColumn("_salt", F.when(F.col("_large"), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0)).drop("_large")
    copies = F.when(F.col("_large"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(large, on, "left").withColumn("_salt", F.explode(copies)).drop("_large")
    if total is not None:
        left, right = sized(left, total, on, "_salt"), sized(right, total, on, "_salt")
    return left.join(right.hint("merge"), [on, "_salt"]).drop("_salt")


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser with full avalanche (the splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of all texts, and the bounds of each text's words in that array (len(texts) + 1)."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.diff(np.concatenate(([True], _IS_SPACE[buffer])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    powers, inverse = _power_tables(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers[: len(buffer)], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return hashes, np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out + hashes[k : k + n]) * _LANES[k % len(_LANES)]
    return mix64(out)


def long_window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """As window_hashes, from running sums, so that the cost doesn't grow with size."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    powers, inverse = _power_tables(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix64(hashes) * powers[: len(hashes)], out=total[1:])
    return mix64((total[size:] - total[:n]) * inverse[:n])


def slices(texts: list[bytes] | list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about SLICE_BYTES each."""
    begin = total = 0
    for k, text in enumerate(texts):
        total += len(text)
        if total >= SLICE_BYTES:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encoded(texts: pd.Series, lower: bool = False) -> list[bytes]:
    """UTF-8 of each text, null as empty; lower: A-Z become a-z, nothing else changes."""
    out = [b"" if t is None or t != t else t.encode("utf-8", "replace") for t in texts]
    return [t.lower() for t in out] if lower else out


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def map_texts(docs: DataFrame, columns: str, start: Callable[[], Callable[[list[str]], list[tuple]]]) -> DataFrame:
    """doc_id and the given columns for each row of docs(doc_id, text): a task's start() gives the function from texts to rows of values.

    Null texts come as empty ones. doc_id goes through as it is, so nulls and large numbers keep their value.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [_ARROW[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for batch in batches:
            ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            for begin, end in slices(texts):
                rows = function(texts[begin:end])
                yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {columns}")


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted: SHINGLE words each; with fewer words the whole sequence as one; none without words."""
    for begin, end in slices(texts):
        hashes, bounds = word_hashes(texts[begin:end])
        shingles = window_hashes(hashes, SHINGLE)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= SHINGLE:
                yield np.unique(shingles[lo : hi - SHINGLE + 1])
            elif hi > lo:
                yield mix64(window_hashes(hashes[lo:hi], hi - lo) + np.uint64(hi - lo))
            else:
                yield np.empty(0, np.uint64)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """From batches sorted by keys: frames of whole groups, with the groups' bounds. A frame has about `rows` rows, or one larger group."""
    held: list[pd.DataFrame] = []

    def bounds_of(frame: pd.DataFrame) -> np.ndarray:
        new = np.ones(len(frame), bool)
        if len(frame) > 1:
            new[1:] = False
            for key in keys:
                v = frame[key].to_numpy()
                new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), len(frame))

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        bounds = bounds_of(frame)
        if len(bounds) > 2:
            cut = bounds[-2]
            yield frame.iloc[:cut], bounds[:-1]
            frame = frame.iloc[cut:].reset_index(drop=True)
        held = [frame]
    if held:
        frame = pd.concat(held, ignore_index=True)
        yield frame, bounds_of(frame)


def union_find(n: int) -> tuple[Callable[[int], int], Callable[[int, int], bool]]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(a: int, b: int) -> bool:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
        return a != b

    return find, union


#: Nodes with more links than this are hubs.
HUB = 200_000


def connected_components(edges: DataFrame, what: str = "components", hub: int = HUB) -> DataFrame:
    """Columns a, b (undirected links) to node, label: the smallest node reachable. Nodes without a link don't appear.

    Alternates two star steps, each a minimum by node, until every node is a centre or has its centre as only neighbour; the number of rounds
    grows with the logarithm of the longest chain. Where a node has more than `hub` links, these are dealt to several tasks: a grouped minimum
    and a salted join instead of a window.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        edges = written(edges, what)
        n = edges.count()
        both = edges.union(edges.select("v", "u"))
        degrees = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("u")).alias("below"))
        open_node = (F.col("below") > 0) & (F.col("n") > 1)
        widest, unsettled = degrees.agg(F.max("n"), F.bool_or(open_node)).first()
        if not unsettled:
            break

        def with_least(rows: DataFrame, keep: str, total: int, widest: int = widest) -> DataFrame:
            """Rows (u, v) that hold `keep`, and m: the smallest v of their u."""
            if widest <= hub:
                return sized(rows, total, "u").withColumn("m", F.min("v").over(Window.partitionBy("u"))).where(keep)
            least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
            return spread_join(rows.where(keep), least.drop("n"), "u", least.select("u", "n"), "v", total=total)

        large = with_least(both, "v > u", 2 * n).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = with_least(large, "true", n)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v")
        edges = sized(small, 2 * n, "u", "v").distinct()
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
