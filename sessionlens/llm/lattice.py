"""Near-duplicate embeddings by lattice hashing: in several tables a random projection of each unit vector is decoded to points of the E8 lattice.

A vector is posted under its own cell and the neighbouring cells that its projection is nearest to; vectors that share a cell are compared by
cosine, and a link counts in the smallest cell key that both hold, so that no link counts twice and none is written out as a pair. The number
of blocks and their scale follow the number of vectors, the number of tables follows from the wanted recall of pairs just at the threshold.

Equal vectors are one vector with a weight. Where cells are large, balls around their centres whose members must all be linked to each other
(angles to the centre of half the threshold's at most) are counted as a whole, and what remains is compared block by block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COSINE, RECALL = 0.9, 0.995
#: Cells that a vector is posted under in each table: its own and the nearest neighbours.
CELLS = 4
#: Members of a cell that are compared in one piece at least.
GROUP = 512
#: Centres of balls at most, and members of a cell that its centre is the mean of, about.
BALLS, SAMPLE = 256, 256
#: Blocks of eight projections and their scale, from coarse to fine, and unrelated vectors that one meets in all tables at most, about.
LADDER = ((1, 0.45), (1, 0.6), (2, 0.4), (2, 0.5), (3, 0.45), (3, 0.5), (4, 0.45), (4, 0.5), (5, 0.5), (6, 0.5))
MEET = 4096
LOWEST = np.iinfo(np.int64).max


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two whole coordinates of size 1, or eight halves with an even number of minus signs."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    return np.array(whole + [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])


ROOTS = _roots()


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum: where rounding gives an odd one, the coordinate that was rounded furthest goes the other way."""
    z = np.rint(y)
    rest = y - z
    odd = np.flatnonzero(z.sum(1) % 2 != 0)
    worst = np.abs(rest[odd]).argmax(1)
    z[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return z


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (whole points with an even sum, and those moved by a half in each coordinate)."""
    a, b = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


@dataclass(frozen=True)
class Hashing:
    blocks: int
    scale: float
    tables: int
    seed: int = 11

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """tables * CELLS keys of each row of unit vectors."""
        out, dim = [], unit.shape[1]
        for table in range(self.tables):
            rng = np.random.default_rng([self.seed, dim, table])
            plane, shift = rng.normal(size=(dim, 8 * self.blocks)) * self.scale, rng.random(8 * self.blocks) * 2
            factors, salt = rng.integers(1, 2**62, 8 * self.blocks).astype(np.uint64), np.uint64(rng.integers(2**62))
            for begin in range(0, len(unit), 2048):
                y = unit[begin : begin + 2048] @ plane + shift
                parts = [y[:, 8 * k : 8 * k + 8] for k in range(self.blocks)]
                points = [nearest(p) for p in parts]
                # stepping along a root comes the nearer to y, the longer the rest is along it
                gains = np.concatenate([(p - z) @ ROOTS.T for p, z in zip(parts, points, strict=True)], 1)
                best = np.argpartition(-gains, CELLS - 1, axis=1)[:, : CELLS - 1]
                own = np.concatenate(points, 1)
                steps = np.zeros((CELLS, len(y), 8 * self.blocks))
                for t in range(CELLS - 1):
                    for k in range(self.blocks):
                        at = np.flatnonzero(best[:, t] // 240 == k)
                        steps[t + 1, at, 8 * k : 8 * k + 8] = ROOTS[best[at, t] % 240]
                codes = (2 * (own + steps)).astype(np.int64).astype(np.uint64)
                out.append((table, begin, common.mix64((codes * factors).sum(2) + salt).view(np.int64).T))
        rows = [np.concatenate([keys for t, _, keys in out if t == table]) for table in range(self.tables)]
        return np.concatenate(rows, 1) if len(unit) else np.empty((0, self.tables * CELLS), np.int64)


def _meeting(blocks: int, scale: float, cosine: float, pairs: int) -> float:
    """Share of random pairs of a cosine that meet in one table. The projection of a difference depends on its length alone, so any dimension will do."""
    rng = np.random.default_rng(7)
    x, z = (v / np.linalg.norm(v, axis=1)[:, None] for v in rng.normal(size=(2, pairs, 32)))
    z -= (x * z).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    hashing = Hashing(blocks, scale, 1)
    a, b = hashing.cells(x), hashing.cells(cosine * x + np.sqrt(1 - cosine**2) * z)
    return float((a[:, :, None] == b[:, None, :]).any((1, 2)).mean())


def hashing_for(n: int, cosine: float = COSINE, recall: float = RECALL) -> Hashing:
    """The coarsest cells in which a vector meets some MEET of n unrelated ones at most, and tables enough for the recall at the threshold."""
    alone = {scale: _meeting(1, scale, 0.0, 4000) for scale in {s for _, s in LADDER}}
    blocks, scale = next(((m, s) for m, s in LADDER if n * alone[s] ** m <= MEET), LADDER[-1])
    missed = max(1e-9, 1 - _meeting(blocks, scale, cosine, 2000))
    return Hashing(blocks, scale, max(2, int(np.ceil(np.log(1 - recall) / np.log(min(missed, 0.99))))))


def scaled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by a power of two that brings the largest component near 1, which changes no bit of a cosine, and their lengths."""
    y = np.ldexp(rows, -np.frexp(np.abs(rows).max(1, initial=0))[1][:, None])
    return y, np.sqrt((y * y).sum(1))


def _matrix(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(float)


def _by_length(blobs: list[bytes]) -> Iterator[np.ndarray]:
    lengths = np.array([len(b) for b in blobs])
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def _coder(hashing: Hashing, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            ends = vectors.offsets.to_numpy()
            flat = vectors.values.to_numpy(zero_copy_only=False).astype(kind)
            blobs = [flat[a:b].tobytes() for a, b in itertools.pairwise(ends)]
            keys = np.empty((len(blobs), hashing.tables * CELLS), np.int64)
            for at in _by_length(blobs):
                y, length = scaled(_matrix([blobs[k] for k in at], kind))
                keys[at] = hashing.cells(y / length[:, None])
            listed = pa.ListArray.from_arrays(np.arange(len(blobs) + 1, dtype=np.int32) * keys.shape[1], keys.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "rep", "w")), pa.array(blobs, pa.binary()), listed], ["h1", "h2", "rep", "w", "x", "keys"])

    return run, "h1 long, h2 long, rep long, w long, x binary, keys array<long>"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links (a, b) join: one for each node but the smallest of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(x: np.ndarray, length: np.ndarray, keys: np.ndarray, balls: np.ndarray, left: np.ndarray, right: np.ndarray, key: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of left and right that are linked and have `key` as their smallest common key; each once if both sides are the same rows."""
    same = left is right
    for begin in range(0, len(left), 512):
        own = left[begin : begin + 512]
        near = x[own] @ x[right].T / (length[own][:, None] * length[right][None, :]) >= cosine
        near &= (balls[own][:, None] != balls[right][None, :]) | (balls[own] < 0)[:, None]
        if same:
            near &= own[:, None] < right[None, :]
        i, j = np.nonzero(near)
        for cut in range(0, len(i), 20_000):
            a, b = own[i[cut : cut + 20_000]], right[j[cut : cut + 20_000]]
            common_keys = np.where((keys[a][:, :, None] == keys[b][:, None, :]).any(2), keys[a], LOWEST)
            first = common_keys.min(1) == key
            yield a[first], b[first]


def _comparer(kind: str, cosine: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in common.whole_groups(frames, ["key", "pair"]):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            cells, side, balls = (frame[c].to_numpy() for c in ("key", "side", "ball"))
            rep, w, node = (frame[c].to_numpy() for c in ("rep", "w", "node"))
            x, keys = frame["x"].to_numpy(), frame["keys"].to_numpy()
            for lo, hi in itertools.pairwise(bounds):
                if hi - lo < 2:
                    continue
                blobs = list(x[lo:hi])
                for at in _by_length(blobs):
                    rows = lo + at
                    y, length = scaled(_matrix([blobs[k] for k in at], kind))
                    counts = np.zeros(len(rows), np.int64)
                    joined: list[np.ndarray] = []
                    whole = np.arange(len(rows))
                    left, right = (whole, whole) if side[lo] == 0 else (np.flatnonzero(side[rows] == s) for s in (1, 2))
                    for a, b in _links(y, length, np.array([np.asarray(keys[k]) for k in rows]), balls[rows], left, right, cells[lo], cosine):
                        np.add.at(counts, a, w[rows[b]])
                        np.add.at(counts, b, w[rows[a]])
                        if len(a):
                            joined.append(np.stack(forest(node[rows[a]], node[rows[b]])))
                    some = counts > 0
                    out.append((rep[rows[some]], np.zeros(some.sum(), np.int64), counts[some]))
                    if joined:
                        u, v = forest(*np.concatenate(joined, 1))
                        out.append((u, v, np.zeros(len(u), np.int64)))
            if out:
                a, b, n = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pd.DataFrame({"a": a, "b": b, "n": n})

    return run


def _centres(coded: DataFrame, large: DataFrame, kind: str, cosine: float) -> list[np.ndarray]:
    """Mean directions of the BALLS largest cells by a sample of SAMPLE members or so; of two close ones only that of the larger cell."""
    largest = F.broadcast(large.orderBy(F.desc("n"), "key").limit(BALLS))
    members = coded.select("rep", "x", F.explode("keys").alias("key")).join(largest, "key").where(F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / SAMPLE)) == 0)

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        blobs = list(group["x"])
        most = max(_by_length(blobs), key=len)
        y, length = scaled(_matrix([blobs[k] for k in most], kind))
        total = (y / length[:, None]).sum(0)
        return pd.DataFrame({"n": group["n"][:1], "centre": [total.tolist()]})

    found: list[np.ndarray] = []
    for _, centre in sorted(members.groupBy("key").applyInPandas(mean, "n long, centre array<double>").collect(), key=lambda r: (-r["n"], r["centre"])):  # BALLS rows at most
        c = np.array(centre)
        if (size := np.linalg.norm(c)) > 0:
            c /= size
            if all(len(c) != len(o) or c @ o < np.cos(np.arccos(cosine) / 4) for o in found):
                found.append(c)
    return found


def _with_balls(coded: DataFrame, centres: list[np.ndarray], kind: str, cosine: float) -> DataFrame:
    """coded with ball (-1: none), node (the ball's smallest rep, else the own) and ball_w (the ball's weight, else the own)."""
    # the bound is a little below half the angle: rounding can't let a pair in that isn't linked
    inside = np.cos(np.arccos(cosine) / 2 - 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("x").to_pylist()
            ball = np.full(len(blobs), -1, np.int64)
            for at in _by_length(blobs):
                y, length = scaled(_matrix([blobs[k] for k in at], kind))
                own = [k for k, c in enumerate(centres) if len(c) == y.shape[1]]
                if own:
                    cosines = y @ np.stack([centres[k] for k in own]).T / length[:, None]
                    best = cosines.argmax(1)
                    ball[at] = np.where(cosines[np.arange(len(at)), best] >= inside, np.array(own)[best], -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball)], [*batch.schema.names, "ball"])

    schema = "h1 long, h2 long, rep long, w long, x binary, keys array<long>, ball long"
    held = common.written(coded.mapInArrow(run, schema), "balls")
    sums = held.where("ball >= 0").groupBy("ball").agg(F.min("rep").alias("node"), F.sum("w").alias("ball_w"))  # BALLS rows at most
    return held.join(F.broadcast(sums), "ball", "left").withColumn("node", F.coalesce("node", "rep")).withColumn("ball_w", F.coalesce("ball_w", "w"))


def _dealt(coded: DataFrame, large: DataFrame) -> DataFrame:
    """A row for each cell and vector, and for each pair of blocks in large cells: key, pair, and side (0: all meet, 1 and 2: only across). Two blocks of one ball don't meet."""
    postings = coded.select("rep", "w", "node", "ball", "x", "keys", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = postings.select("key", "ball").join(F.broadcast(large.select("key")), "key").groupBy("key", "ball").agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.select("key", F.struct("ball", F.ceil(F.col("n") / GROUP).cast("long").alias("blocks")).alias("p")).groupBy("key").agg(F.array_sort(F.collect_list("p")).alias("parts"))  # BALLS + 1 parts at most
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["blocks"])
    counts = counts.withColumn("all", total)
    rows = postings.join(F.broadcast(counts), "key", "left")
    first = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: F.when(p["ball"] < F.col("ball"), n + p["blocks"]).otherwise(n))
    blocks = F.filter("parts", lambda p: p["ball"] == F.col("ball"))[0]["blocks"]
    rows = rows.withColumn("first", first).withColumn("blocks", blocks).withColumn("part", F.coalesce(F.col("first") + F.pmod(F.xxhash64("rep"), F.col("blocks")), F.lit(0)))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))
    zero, last = F.lit(0).cast("long"), F.col("all") - 1
    others = F.when(F.col("ball") < 0, span(zero, last)).otherwise(F.concat(span(zero, F.col("first") - 1), span(F.col("first") + F.col("blocks"), last)))
    rows = rows.withColumn("with", F.explode(F.when(F.col("all").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(others)))
    pair = F.when(F.col("with") < 0, F.col("with")).otherwise(F.least("part", "with") * F.col("all") + F.greatest("part", "with"))
    side = F.when((F.col("with") < 0) | (F.col("with") == F.col("part")), 0).when(F.col("part") < F.col("with"), 1).otherwise(2)
    return rows.select("key", pair.alias("pair"), side.alias("side"), "rep", "w", "node", "ball", "x", "keys")


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vec_id of vectors(vec_id, embedding): vectors are linked from `cosine` on.

    Every link that is reported is one by cosine in double precision; a pair just at the threshold is found with the probability `recall`, nearer
    ones with a higher one, equal ones always. Null, empty and zero vectors, and those with null or non-finite components, are linked with nothing; vectors of
    different lengths aren't either. Rows without a vec_id are left out. Of a vec_id's rows only the smallest vector counts. Other columns are
    ignored, an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    v = F.col("v")
    good = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    base = vectors.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast(f"array<{element}>")).alias("v"))
    base = base.withColumn("v", F.when(F.coalesce(good, F.lit(False)), v))
    base = common.written(base.withColumn("h1", F.when(v.isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(v.isNotNull(), F.xxhash64(F.lit(1), "v"))), "vectors")

    # equal vectors, told by 128 bits
    classes = base.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v"))
    n = base.where("h1 is not null").count()
    coder, schema = _coder(hashing_for(n, cosine, recall), kind)
    coded = common.written(classes.mapInArrow(coder, schema), "coded")
    sizes = coded.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # some 4096 * keys of a vector cells at most
    large = common.written(sizes.where(F.col("n") > max(GROUP, n // 4096)), "large-cells")
    if large.isEmpty():
        held = coded.select("*", F.lit(-1).cast("long").alias("ball"), F.col("rep").alias("node"), F.col("w").alias("ball_w"))
    else:
        held = _with_balls(coded, _centres(coded, large, kind, cosine), kind, cosine)
    cells = _dealt(held, large).repartition("key", "pair").sortWithinPartitions("key", "pair")
    found = common.written(cells.mapInPandas(_comparer(kind, cosine), "a long, b long, n long"), "links")

    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("across"))
    labels = common.connected_components(found.where("n = 0").select("a", "b"), "vectors-components")
    reps = held.select("h1", "h2", "rep", "node", "ball_w").join(counts.hint("merge"), "rep", "left")
    reps = common.salted_left_join(reps, labels, ["node"], "rep").withColumn("links", F.col("ball_w") - 1 + F.coalesce("across", F.lit(0))).withColumn("label", F.coalesce("label", "node"))
    out = common.salted_left_join(base.select("vec_id", "h1", "h2"), reps.select("h1", "h2", "links", "label"), ["h1", "h2"], "vec_id")
    component = F.coalesce("label", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def op11_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(common.table(spark, sf_dir, "embeddings"))
