"""Nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are scaled to length one and projected to ``PROJECTED`` dimensions by a
Gaussian (2-stable) matrix: the squared projected distance of two vectors is
their squared distance times a chi-square variable. A kd-tree over projections
cuts all rows into regions; its splits come from a bounded sample of about
``SAMPLE`` rows, every row is indexed. A region is a block of rows, or several
blocks of ``MOST`` bytes where many rows fall into one region; each block holds
a kd-tree of its own.

A query first searches the block it lies in. The k-th best cosine found there
goes with it to those regions that may hold a better row: a region, and within a
block a leaf, is skipped when its box is so far away in the projection that, by
the chi-square test, a row in it beats the k-th best found with a probability
under 1 - ``SURE``. Leaves are met in the order of their distance, one, then two
more, four more and so on, and the k-th best found tightens the test. Every row of a leaf that is met is scored; rows
that may be among the best get their exact cosine, in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id; others do whatever their
size, since components are scaled by a power of two first; rows equal in id and
vector count once; a query meets vectors of its own length only, and no row with
its own id; fewer candidates than k give fewer rows; ties go to the smaller id;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common

PROJECTED = 8
SURE = 0.98
#: Rows that the splits of the tree are taken from, and the most regions it has.
SAMPLE = 1 << 15
REGIONS = 1 << 10
#: Rows of a block at least, and bytes of its vectors at most.
BLOCK = 4096
MOST = 64 << 20
LEAF = 512
#: Queries that are worked on at once in a task.
STEP = 512
#: Products of whole blocks differ by less than this from the exact cosines.
SLACK = 1e-9


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square with m degrees of freedom <= x) = p; m is even."""

    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two to a largest component in [0.5, 1), and their lengths then."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    out = np.ldexp(vectors, -exponent[:, None])
    return out, np.sqrt((out * out).sum(axis=1))


def projection(size: int, projected: int = PROJECTED) -> np.ndarray:
    return np.random.default_rng(size).normal(size=(size, projected))


class Regions:
    """A perfect kd-tree of ``depth`` levels: splits at medians of a sample's widest axis."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        todo = [points]
        for node in range(len(self.axis)):
            own = todo[node]
            if len(own):
                self.axis[node] = np.argmax(np.ptp(own, axis=0))
                self.at[node] = np.median(own[:, self.axis[node]])
            right = own[:, self.axis[node]] > self.at[node]
            todo += [own[~right], own[right]]

    def __call__(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - len(self.axis)


class Tree:
    """Leaves of a kd-tree over projected rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        todo, self.leaves = [np.arange(len(points))], []
        while todo:
            own = todo.pop()
            if len(own) <= leaf:
                self.leaves.append(own)
                continue
            axis = int(np.argmax(np.ptp(points[own], axis=0)))
            half = np.argpartition(points[own, axis], len(own) // 2)
            todo += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
        self.low = np.array([points[x].min(axis=0) for x in self.leaves])
        self.high = np.array([points[x].max(axis=0) for x in self.leaves])
        size = max(map(len, self.leaves))
        self.rows = np.full((len(self.leaves), size), -1, np.int64)
        for i, own in enumerate(self.leaves):
            self.rows[i, : len(own)] = own

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared projected distance of each query to each leaf's box."""
        out = np.zeros((len(queries), len(self.leaves)))
        for axis in range(queries.shape[1]):
            x = queries[:, axis, None]
            gap = np.maximum(np.maximum(self.low[:, axis] - x, x - self.high[:, axis]), 0)
            out += gap * gap
        return out


class Block:
    """One block of rows: exact vectors and the tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, sure: float = SURE):
        # Of equal vectors, only the k + 1 smallest ids can be among a query's k nearest.
        key = (vectors * np.random.default_rng(0).normal(size=vectors.shape[1])).sum(axis=1) if np.abs(vectors).max() < 1e300 else vectors[:, 0]
        order = np.lexsort((ids, key))
        same = (vectors[order[1:]] == vectors[order[:-1]]).all(axis=1)
        place = np.arange(len(order))
        nth = place - np.maximum.accumulate(np.where(np.concatenate([[False], same]), 0, place))
        keep = order[nth <= k]
        self.ids, self.k = ids[keep], k
        self.vectors, self.norms = scaled(vectors[keep])
        self.unit = self.vectors / self.norms[:, None]
        self.matrix = projection(vectors.shape[1])
        self.tree = Tree(self.unit @ self.matrix)
        self.far = chi_square_quantile(sure, PROJECTED)

    def search(self, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best rows met for each query, best first; rows below its ``bound`` may be left out."""
        n, k = len(ids), self.k
        vectors, norms = scaled(queries)
        unit = vectors / norms[:, None]
        gaps = self.tree.distances(unit @ self.matrix)
        order = np.argsort(gaps, axis=1, kind="stable")
        gaps = np.take_along_axis(gaps, order, axis=1)
        kth = np.full(n, -np.inf) if bound is None else bound.copy()
        who, name, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, to = 0, 1
        while at < order.shape[1]:
            # The next leaves of each query, twice as many each time, as far as the test lets them be met.
            q, r = np.nonzero(gaps[:, at:to] <= self.far * np.maximum(2 - 2 * kth, 0)[:, None])
            if not len(q):
                break
            leaves = order[q, r + at]
            by = np.argsort(leaves, kind="stable")
            q, leaves = q[by], leaves[by]
            new = [(who, name, score)]
            cuts = np.flatnonzero(np.diff(leaves)) + 1
            for own, leaf in zip(np.split(q, cuts), leaves[np.concatenate([[0], cuts])], strict=True):
                rows = self.tree.leaves[leaf]
                cos = unit[own] @ self.unit[rows].T
                least = kth[own]
                if len(rows) > k + 1 and np.isneginf(least).any():
                    least = np.maximum(least, np.partition(cos, -k - 1, axis=1)[:, -k - 1])
                i, j = np.nonzero(cos >= least[:, None] - SLACK)
                some, x = own[i], rows[j]
                other = self.ids[x] != ids[some]
                some, x = some[other], x[other]
                for c in range(0, len(some), 1 << 16):
                    a, b = some[c : c + (1 << 16)], x[c : c + (1 << 16)]
                    new.append((a, self.ids[b], (self.vectors[b] * vectors[a]).sum(axis=1) / (self.norms[b] * norms[a])))
            at, to = to, 2 * to + 1
            who, name, score = (np.concatenate(x) for x in zip(*new, strict=True))
            by = np.lexsort((name, -score, who))
            who, name, score = who[by], name[by], score[by]
            nth = np.arange(len(who)) - np.searchsorted(who, who)
            last = nth == k - 1
            kth[who[last]] = np.maximum(kth[who[last]], score[last])
            who, name, score = who[nth < k], name[nth < k], score[nth < k]
        return who, name, score


def usable(vec: Column) -> Column:
    """Whether a vector takes part in a search."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def _vectors(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components one after another in double precision, and n + 1 offsets."""
    at = arr.offsets.to_numpy().astype(np.int64)
    return arr.flatten().to_numpy().astype(np.float64), at - at[0]


def _by_length(arr: pa.Array):
    """(rows, matrix) for each length of vector in an array."""
    flat, at = _vectors(arr)
    sizes = np.diff(at)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[at[rows][:, None] + np.arange(size)]


def _project(tree: Regions | None):
    """id, h, query, vec, p0 .. and the region of each row."""

    def run(batches):
        for batch in batches:
            vecs = common.column(batch, "vec")
            p = np.zeros((len(vecs), PROJECTED))
            for rows, own in _by_length(vecs):
                v, norms = scaled(own)
                p[rows] = (v / norms[:, None]) @ projection(own.shape[1])
            region = tree(p) if tree is not None else np.zeros(len(p), np.int64)
            cols = [*batch.columns, pa.array(region.astype(np.int32)), *[pa.array(p[:, j]) for j in range(PROJECTED)]]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "region", *[f"p{j}" for j in range(PROJECTED)]])

    return run


def _reach(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], sure: float):
    """(region, query) for every region that may hold a row better than a query's bound."""
    far = chi_square_quantile(sure, PROJECTED)

    def run(batches):
        for batch in batches:
            p = np.stack([common.column(batch, f"p{j}").to_numpy() for j in range(PROJECTED)], axis=1)
            size, bound = common.column(batch, "size").to_numpy(), common.column(batch, "bound").to_numpy()
            for n in np.unique(size):
                names, low, high = boxes[int(n)]
                rows = np.flatnonzero(size == n)
                for at in range(0, len(rows), STEP):
                    some = rows[at : at + STEP]
                    gap = np.zeros((len(some), len(names)))
                    for j in range(PROJECTED):
                        x = p[some, j, None]
                        d = np.maximum(np.maximum(low[:, j] - x, x - high[:, j]), 0)
                        gap += d * d
                    i, r = np.nonzero(gap <= far * np.maximum(2 - 2 * bound[some], 0)[:, None])
                    kept = batch.select(["id", "h", "size", "home", "own", "vec", "bound"]).take(pa.array(some[i]))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names[r].astype(np.int32))], names=[*kept.schema.names, "region"])

    return run


def _search(k: int, sure: float):
    """Answers to the queries of each block; rows come sorted by block, data before queries."""

    def run(batches):
        unit, block = None, None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        for batch in batches:
            units = common.column(batch, "block").to_numpy()
            asked = common.column(batch, "asked").to_numpy(zero_copy_only=False)
            names, hashes = common.column(batch, "id").to_numpy(), common.column(batch, "h").to_numpy()
            bound = common.column(batch, "bound").to_numpy()
            flat, at = _vectors(common.column(batch, "vec"))
            cuts = np.flatnonzero((units[1:] != units[:-1]) | (asked[1:] != asked[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(units)], strict=True):
                if a == b:
                    continue
                own = flat[at[a] : at[b]].reshape(b - a, -1)
                if units[a] != unit:
                    unit, block, ids, vectors = units[a], None, [], []
                if not asked[a]:
                    ids.append(names[a:b])
                    vectors.append(own)
                    continue
                if block is None:
                    block, ids, vectors = Block(np.concatenate(ids), np.concatenate(vectors), k, sure), [], []
                for s in range(0, b - a, STEP):
                    q = slice(a + s, min(b, a + s + STEP))
                    who, name, score = block.search(names[q], own[s : s + STEP], bound[q])
                    yield pa.RecordBatch.from_arrays([pa.array(names[q][who]), pa.array(hashes[q][who]), pa.array(name), pa.array(score)], names=["query_id", "h", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sure: float = SURE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query row."""
    spark = vectors.sparkSession
    common.ship(spark)
    kind = vectors.schema[vec_col].dataType
    wide = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    given = (
        vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(wide).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("query"))
        .where(F.col("id").isNotNull() & usable(F.col("vec")))
        .select("id", F.xxhash64("vec").alias("h"), "query", "vec")
    )
    n, longest = given.agg(F.count("*"), F.max(F.size("vec"))).first()
    result = "query_id bigint, h bigint, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shape = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in given.schema)}, region int, {', '.join(f'p{j} double' for j in range(PROJECTED))}"
    # Splits from a sample of a known size; blocks grow with the table up to what a task holds.
    sample = given.where(F.pmod(F.xxhash64("id", "h"), F.lit(-(-n // SAMPLE))) == 0).limit(2 * SAMPLE)
    points = np.array([list(r) for r in sample.mapInArrow(_project(None), shape).select(*[f"p{j}" for j in range(PROJECTED)]).collect()]).reshape(-1, PROJECTED)
    most = max(1, MOST // (8 * longest))
    rows_in_block = min(most, max(block, n // 64))
    tree = Regions(points, min(REGIONS, max(1, n // rows_in_block)).bit_length() - 1)
    rows = common.save(given.dropDuplicates(["id", "vec"]).mapInArrow(_project(tree), shape), "vectors").withColumn("size", F.size("vec"))
    # One row per region and length of vector.
    found = rows.groupBy("size", "region").agg(F.count("*").alias("n"), F.count_if("query").alias("q"), *[f(f"p{j}") for f in (F.min, F.max) for j in range(PROJECTED)]).collect()
    asked_sizes = {r["size"] for r in found if r["q"]}
    boxes = {}
    for size in asked_sizes:
        own = [tuple(r) for r in found if r["size"] == size]
        table = np.array([r[4:] for r in own])
        boxes[size] = (np.array([r[1] for r in own]), table[:, :PROJECTED], table[:, PROJECTED:])
    parts = spark.createDataFrame([(r["size"], r["region"], -(-r["n"] // (2 * rows_in_block))) for r in found], "size int, region int, parts int")
    salted = rows.join(F.broadcast(parts), ["size", "region"]).withColumn("own", F.pmod(F.xxhash64("id", "h"), F.col("parts")).cast("int"))
    block_of = lambda own: F.xxhash64("size", "region", own).alias("block")
    data = salted.select(block_of(F.col("own")), F.lit(False).alias("asked"), "id", "h", "vec", F.lit(-math.inf).alias("bound"))
    width = common.parts_for(rows)

    def searched(asked: DataFrame) -> DataFrame:
        dealt = data.join(asked.select("block").distinct(), "block", "left_semi").select(data.columns).unionByName(asked)
        return dealt.repartition(width, "block").sortWithinPartitions("block", "asked", "id").mapInArrow(_search(k, sure), result)

    home = salted.where("query").select(block_of(F.col("own")), F.lit(True).alias("asked"), "id", "h", "vec", F.lit(-math.inf).alias("bound"))
    first = common.save(searched(home), "nearest")
    bounds = first.groupBy(F.col("query_id").alias("id"), "h").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    queries = salted.where("query").join(bounds, ["id", "h"], "left").withColumn("bound", F.coalesce("bound", F.lit(-math.inf)))
    reached = queries.select("id", "h", "size", F.col("region").alias("home"), "own", "vec", "bound", *[f"p{j}" for j in range(PROJECTED)]).mapInArrow(
        _reach(boxes, sure), f"id bigint, h bigint, size int, home int, own int, vec {wide}, bound double, region int"
    )
    spread = reached.join(F.broadcast(parts), ["size", "region"]).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    others = common.save(spread.where("region <> home or at <> own").select(block_of(F.col("at")), F.lit(True).alias("asked"), "id", "h", "vec", "bound"), "asked")
    more = searched(others)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
