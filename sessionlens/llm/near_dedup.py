"""MinHash near-dedup by a signature-coordinate inverted join.

Every distinct shingle set gets K minimum hashes. A set is posted under the coordinate-value pairs of its prefix only: its
K - T + 1 rarest pairs in one global order (by a fixed-size table of frequencies, then by hash), since two sets that agree in T
coordinates must share a pair there. Within a posting list collisions are counted from the signatures themselves, so the long
lists of frequent pairs are skipped and only probed; a pair of sets is looked at only in the first list that both are in. Pairs
that agree in T coordinates are then confirmed on full shingle sets.

Equal sets are collapsed before. A long posting list is cut into blocks, and each block is compared within itself first. What was linked
is one component from then on: rounds over one member a component, dealt to new blocks, link the blocks as long as a round halves what is left.
Only lists that still hold several components are then compared in wide blocks, and only pairs of different components; so
a list of n near copies costs about n * BLOCK comparisons, not n * n, and no pair of different components is passed over. (A list of n
sets of which none are linked but that all share a rare pair still costs n * n / 2 comparisons, and n * n / WIDE rows.) In a
task, candidates whose sets are already connected by confirmed links are passed over, and only a spanning forest of confirmed
links leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 32
#: Signatures are posted and compared as 32-bit values. T is so low that a pair at the similarity bound is missed with a chance of at most MISS.
MISS = 1e-5
BLOCK, WIDE = 128, 1024
BUCKETS = 8192

_A = (np.random.default_rng(20240229).integers(1, 2**63, K, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = np.random.default_rng(7).integers(1, 2**63, K, dtype=np.uint64)


def least_matches(similarity: float, k: int = K, miss: float = MISS) -> int:
    """The largest T with P(Binomial(k, similarity) < T) <= miss."""
    below = 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            return max(1, t)
    return k


def signature(shingles: np.ndarray) -> np.ndarray:
    """K minima of a nonempty set, as uint32."""
    out = np.empty(K, np.uint64)
    for k in range(K):
        x = shingles * _A[k] + _B[k]
        out[k] = ((x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)).min()
    return (out >> np.uint64(32)).astype(np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, s in zip(batch["doc_id"], common.shingle_sets(common.encoded(batch["text"], lower=True)), strict=True):
            if len(s):
                key = np.array([s.sum(dtype=np.uint64), common.mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
                rows.append((doc_id, len(s), int(key[0]), int(key[1]), signature(s).tobytes()))
            else:
                rows.append((doc_id, 0, None, None, None))
        yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_a", "set_b", "sig"]).astype({"doc_id": "int64", "n_shingles": "int64", "set_a": "Int64", "set_b": "Int64"})


def _tokens(sig: np.ndarray) -> np.ndarray:
    return common.mix64(sig.astype(np.uint64) + (np.arange(K, dtype=np.uint64) << np.uint64(32)))


def _sigs(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, K)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        if len(batch):
            counts += np.bincount((_tokens(_sigs(batch["sig"])) % np.uint64(BUCKETS)).astype(np.int64).ravel(), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    yield pd.DataFrame({"bucket": used.astype("int32"), "n": counts[used]})


def _poster(frequency: np.ndarray, prefix: int):
    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            tokens = _tokens(_sigs(batch["sig"]))
            often = frequency[(tokens % np.uint64(BUCKETS)).astype(np.int64)]
            order = np.lexsort((tokens, often), axis=1)[:, :prefix]
            earlier = np.cumsum(np.uint64(1) << order.astype(np.uint64), axis=1) - (np.uint64(1) << order.astype(np.uint64))
            yield pd.DataFrame({"token": _signed(np.take_along_axis(tokens, order, 1).ravel()), "rep": np.repeat(batch["rep"].to_numpy(), prefix), "earlier": earlier.astype(np.int64).ravel()})

    return post


def _candidates(sig: np.ndarray, earlier: np.ndarray, block: np.ndarray, comp: np.ndarray, cross: bool, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of one list, of different components, that agree in `least` coordinates, and their number of matches, for which it is the first common list."""
    left = np.flatnonzero(block == block.min()) if cross else np.arange(len(sig))
    right = np.flatnonzero(block != block.min()) if cross else left
    agree = np.zeros((len(left), len(right)), np.uint8)
    common_bits = np.zeros((len(left), len(right)), np.uint32)
    both = earlier.astype(np.uint32)
    for k in range(K):
        same = sig[left, k][:, None] == sig[right, k][None, :]
        agree += same
        common_bits |= same.astype(np.uint32) << np.uint32(k)
    ok = (agree >= least) & ((common_bits & both[left][:, None] & both[right][None, :]) == 0) & (comp[left][:, None] != comp[right][None, :])
    if not cross:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    return left[i], right[j], agree[i, j]


def _matcher(least: int):
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Members of each task that have a candidate there."""
        for frame, bounds in common.whole_groups(batches, ["token", "low", "high"]):
            sig, earlier, block, comp = _sigs(frame["sig"]), frame["earlier"].to_numpy(), frame["block"].to_numpy(), frame["comp"].to_numpy()
            keep = np.zeros(len(frame), bool)
            sizes = np.diff(bounds)
            pairs = bounds[:-1][sizes == 2]
            if len(pairs):
                same = sig[pairs] == sig[pairs + 1]
                bits = (same.astype(np.uint64) << np.arange(K, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.int64)
                good = (same.sum(1) >= least) & (comp[pairs] != comp[pairs + 1]) & ((bits & earlier[pairs] & earlier[pairs + 1]) == 0)
                keep[pairs[good]] = keep[pairs[good] + 1] = True
            low, high = frame["low"].to_numpy(), frame["high"].to_numpy()
            for lo, hi in zip(bounds[:-1][sizes > 2], bounds[1:][sizes > 2], strict=True):
                i, j, _ = _candidates(sig[lo:hi], earlier[lo:hi], block[lo:hi], comp[lo:hi], low[lo] != high[lo], least)
                keep[lo + i] = keep[lo + j] = True
            yield frame[keep]

    return match


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [s.tobytes() for s in common.shingle_sets(common.encoded(batch["text"], lower=True))]
        yield pd.DataFrame({"rep": batch["doc_id"].to_numpy(), "shingles": sets}).astype({"rep": "int64"})


def _confirmer(least: int, percent: int):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A spanning forest of each task's confirmed links, as stars around the smallest member."""
        for frame, bounds in common.whole_groups(batches, ["token", "low", "high"], 1_000):
            out: list[tuple[int, int]] = []
            rep, low, high = frame["rep"].to_numpy(), frame["low"].to_numpy(), frame["high"].to_numpy()
            sig, earlier, block, comp = _sigs(frame["sig"]), frame["earlier"].to_numpy(), frame["block"].to_numpy(), frame["comp"].to_numpy()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo < 2:
                    continue
                i, j, agree = _candidates(sig[lo:hi], earlier[lo:hi], block[lo:hi], comp[lo:hi], low[lo] != high[lo], least)
                sets = [np.frombuffer(x, np.uint64) for x in frame["shingles"].iloc[lo:hi]]
                find, union = common.union_find(hi - lo)
                for x in np.argsort(-agree.astype(np.int16), kind="stable"):
                    a, b = int(i[x]), int(j[x])
                    if find(a) == find(b):
                        continue
                    m, n = len(sets[a]), len(sets[b])
                    if 100 * min(m, n) < percent * max(m, n):
                        continue
                    both = np.concatenate((sets[a], sets[b]))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (m + n - shared):
                        union(a, b)
                roots: dict[int, list[int]] = {}
                for k in range(hi - lo):
                    roots.setdefault(find(k), []).append(int(rep[lo + k]))
                out += [(x, min(v)) for v in roots.values() if len(v) > 1 for x in v if x != min(v)]
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return confirm


_FIELDS = "token long, rep long, earlier long, block int, low int, high int, comp long, sig binary"
_ORDER = [f.split()[0] for f in _FIELDS.split(", ")]
_BY = ["token", "low", "high"]


def _candidate_members(members: DataFrame, rows: int, least: int) -> DataFrame:
    """Those of members (token, rep, earlier, block, low, high, comp, sig), about `rows`, that have a candidate in their group, as a table."""
    found = common.sized(members.select(*_ORDER), rows, *_BY).sortWithinPartitions(*_BY).mapInPandas(_matcher(least), _FIELDS)
    return common.written(found, "candidates")


def _links(found: DataFrame, sets: DataFrame, least: int, percent: int) -> DataFrame:
    """a, b: confirmed links within the groups, as a table. sets (rep, shingles) grows with the input, so it's never broadcast."""
    rows = found.count()
    dealt = lambda df, *keys: common.sized(df, rows, *keys, per=10_000)
    links = dealt(found, "rep").join(dealt(sets, "rep").hint("merge"), "rep").select(*_ORDER, "shingles")
    return common.written(dealt(links, *_BY).sortWithinPartitions(*_BY).mapInPandas(_confirmer(least, percent), "a long, b long"), "links")


def _dealt(members: DataFrame, sizes: DataFrame, rows: int, by: str = "rep") -> DataFrame:
    """members, `rows` at most, with the number of blocks of their list, and their block. sizes: token, n."""
    blocks = sizes.select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    return common.spread_join(members, blocks, "token", sizes, by, total=rows).withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))


def _all_links(posts: DataFrame, classes: DataFrame, docs: DataFrame, least: int, percent: int) -> DataFrame:
    """node, label of all sets that have a link."""
    own_block = ("*", F.col("block").alias("low"), F.col("block").alias("high"))
    rows = posts.count()
    signatures = common.sized(classes.select("rep", "sig"), rows, "rep").hint("merge")
    lists = common.written(posts.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    members = _dealt(posts, lists, rows).select(*own_block, F.col("rep").alias("comp"))
    found = _candidate_members(common.sized(members, rows, "rep").join(signatures, "rep"), rows, least)
    wanted = found.select("rep")
    long = lists.where(F.col("n") > BLOCK)
    any_long = not long.isEmpty()
    if any_long:
        inside = common.sized(common.spread_join(posts, long.select("token"), "token", long, "rep", total=rows), rows, "rep").join(signatures, "rep")
        inside = common.written(inside, "long_lists")
        held = inside.count()
        wanted = wanted.union(inside.select("rep"))
    # the texts are dealt once; all later rounds take their sets from this table
    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = texts.mapInPandas(_sets, "rep long, shingles binary")
    if any_long:
        sets = common.written(sets, "sets")
    labels = common.connected_components(_links(found, sets, least, percent))
    stars = lambda labels: labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    before = held if any_long else 0
    while any_long:
        names = common.sized(labels.withColumnRenamed("node", "rep"), held, "rep").hint("merge")
        named = common.sized(inside, held, "rep").join(names, "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")
        named = common.written(named, "named")
        heads = named.groupBy("token", "comp").agg(F.min_by(F.struct("rep", "sig"), "rep").alias("head"), F.count(F.lit(1)).alias("of_comp"))
        heads = common.written(heads.select("token", "comp", "of_comp", "head.*", F.lit(0).cast("long").alias("earlier")), "heads")
        several = heads.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("of_comp").alias("members"), F.max(F.struct("of_comp", "comp")).alias("largest")).where("n > 1")
        several = common.written(several, "several")
        left, after = several.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not left:
            return labels
        if 2 * after > before:  # what is left is mostly unlike
            break
        before = after
        more = _links(_candidate_members(_dealt(heads, several.select("token", "n"), after, "comp").select(*own_block), after, least), sets, least, percent)
        labels = common.connected_components(stars(labels).union(more))
    if not any_long:
        return labels
    # what is left: lists with several components. The largest one's members meet only the others, so with few others a list costs what it holds
    mine, theirs = F.ceil((F.col("members") - F.col("largest.of_comp")) / WIDE).cast("int"), F.ceil(F.col("largest.of_comp") / WIDE).cast("int")
    shape = several.select("token", F.col("largest.comp").alias("giant"), mine.alias("mine"), theirs.alias("theirs"))
    rest = common.spread_join(named, shape, "token", several.select("token", F.col("members").alias("n")), "rep", total=held)
    apart, number = F.col("comp") == F.col("giant"), lambda n: F.pmod(F.xxhash64("rep", F.lit("wide")), F.col(n)).cast("int")
    rest = rest.withColumn("block", F.when(apart, F.col("mine") + number("theirs")).otherwise(number("mine")))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(apart, F.col("mine")).otherwise(F.col("mine") + F.col("theirs")) - 1)))
    rest = rest.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    more = _links(_candidate_members(rest, 2 * held, least), sets, least, percent)
    return labels if more.isEmpty() else common.connected_components(stars(labels).union(more))


def near_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text); links are pairs with 100 * |A & B| >= percent * |A | B|.

    Null and empty texts have no shingles and stay alone. Rows with equal texts share a component. doc_id is taken as unique; rows
    that repeat it get the same component. A null doc_id is dropped, as it can't be named in a result. Other columns are ignored.
    """
    least = least_matches(percent / 100)
    prefix = K - least + 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    prints = common.written(docs.mapInPandas(_fingerprints, "doc_id long, n_shingles long, set_a long, set_b long, sig binary"), "fingerprints")
    classes = common.written(prints.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"), F.first("sig").alias("sig")), "classes")

    counts = np.zeros(BUCKETS, np.int64)
    for row in classes.select("sig").mapInPandas(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row[0]] = row[1]
    posts = common.written(classes.select("rep", "sig").mapInPandas(_poster(counts, prefix), "token long, rep long, earlier long"), "posts")
    labels = _all_links(posts, classes, docs, least, percent)

    grouped = classes.select("set_a", "set_b", "rep", "members").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    grouped = grouped.where("members > 1 or label is not null").select("set_a", "set_b", F.coalesce("label", "rep").alias("label"))
    joined = common.salted_left_join(prints.select("doc_id", "n_shingles", "set_a", "set_b"), grouped, ["set_a", "set_b"], "doc_id")
    component = F.coalesce("label", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(common.table(spark, sf_dir, "documents"), 85)
