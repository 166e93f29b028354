"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of several tables hashes a vector to whole numbers floor((a.x + b) / w), with
normal a (2-stable, for Euclidean distance) and uniform b. A query visits its own
bucket and then perturbed ones, one or more of the numbers moved by one, in the
order of their estimated success: the sum of squared distances to the borders
that are crossed. The order of the sets is computed once, from the expected
distances, and applied to each query's own borders in their sorted order. The
tables' candidates are merged and ranked by exact distance.

Rows are dealt by hash to blocks of about `rows` vectors, queries to blocks of
about `queries`; a pair of blocks is a cell, where the block's index is built and
searched. Every row is indexed, and what leaves a cell is each query's nearest few,
never the candidates. Cells are alike in size however vectors repeat, so a bucket
that holds a third of all rows is spread over all blocks.

Vectors that are null, empty, zero, or hold a null or non-finite component take no
part, as queries or as candidates; nor do vectors of another length than the
query's, and rows with a null vec_id. Rows that repeat a vec_id count as one
candidate each with its own distance; as a query the id has one answer, that of the
smallest of its vectors (by components in order). Ties go to the smaller vec_id. Where a block has
no more rows than `rows_whole`, or a query's probes meet fewer than k of them or less
than one in FEW (long vectors do, as one width serves all lengths), all of the block's
rows are ranked: a query finds fewer than k only if there are fewer. Empty tables give
empty tables.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_worker

TABLES, HASHES, WIDTH, PROBES = 24, 12, 2.2, 300
ROWS, QUERIES, ROWS_WHOLE = 8192, 2048, 64
#: The part of a block below which candidates give way to all rows; ranking these takes less time than the probes did.
FEW = 8


def perturbations(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The first sets of border numbers (0 is the nearest), by expected sum of squared distances; the empty set first."""
    m = hashes
    near = lambda j: j * (j + 1) / (4 * (m + 1) * (m + 2))
    cost = [near(j) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + near(2 * m + 1 - j) for j in range(1, 2 * m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, own = heapq.heappop(heap)
        if all(2 * m - 1 - j not in own for j in own):  # the two borders of one number exclude each other
            out.append(own)
        if (last := own[-1]) + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], own[:-1] + (last + 1,)))
            heapq.heappush(heap, (total + cost[last + 1], own + (last + 1,)))
    return out


class Hashing:
    """The tables' hash functions for vectors of one length."""

    def __init__(self, size: int, scale: float, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tables, self.hashes, self.probes = tables, hashes, probes
        self.width = width * scale
        self.a = rng.standard_normal((size, tables * hashes))
        self.b = rng.uniform(0, self.width, tables * hashes)
        self.mix = rng.integers(1, 1 << 62, (tables, hashes), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        sets = perturbations(hashes, probes)
        #: Which borders each perturbation crosses.
        self.crosses = np.zeros((len(sets), 2 * hashes), np.int8)
        for k, own in enumerate(sets):
            self.crosses[k, list(own)] = 1

    def projected(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.hashes)

    def key(self, numbers: np.ndarray) -> np.ndarray:
        """A bucket's key, from its numbers; the tables' keys differ by their factors."""
        return (numbers.astype(np.int64).astype(np.uint64) * self.mix).sum(-1, dtype=np.uint64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Keys by vector and table."""
        return self.key(np.floor(self.projected(x)))

    def probed(self, q: np.ndarray) -> np.ndarray:
        """Keys by table and probe for one query, in the order of the probes."""
        p = self.projected(q[None])[0]
        low = np.floor(p)
        borders = np.concatenate([p - low, 1 - (p - low)], 1)  # below, then above
        order = np.argsort(borders, 1, kind="stable")
        which, sign = order % self.hashes, np.where(order < self.hashes, -1, 1)
        moved = np.zeros((self.tables, 2 * self.hashes, self.hashes), np.int8)
        t, r = np.indices(order.shape)
        moved[t, r, which] = sign
        delta = np.einsum("pr,trh->tph", self.crosses, moved)
        return (low[:, None, :].astype(np.int64) + delta).astype(np.uint64).__mul__(self.mix[:, None, :]).sum(-1, dtype=np.uint64)


class Index:
    """A block's tables: rows sorted by bucket."""

    def __init__(self, hashing: Hashing, x: np.ndarray):
        self.hashing, self.x = hashing, x
        keys = hashing.buckets(x)
        self.order = np.argsort(keys, 0, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, 0)

    def candidates(self, q: np.ndarray) -> np.ndarray:
        probes = self.hashing.probed(q)
        seen = np.zeros(len(self.x), bool)
        for t in range(self.hashing.tables):
            col = self.sorted[:, t]
            a, b = np.searchsorted(col, probes[t], "left"), np.searchsorted(col, probes[t], "right")
            for lo, hi in zip(a[b > a], b[b > a], strict=True):
                seen[self.order[lo:hi, t]] = True
        return np.flatnonzero(seen)


def searched(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, scale: float, k: int, rows_whole: int, options: dict) -> tuple[list, list, list]:
    """Each query's k nearest candidates of one block: query ids, vector ids, distances."""
    hashing = by_worker(f"p-stable:{x.shape[1]}:{scale}:{sorted(options.items())}", lambda: Hashing(x.shape[1], scale, **options))
    index = Index(hashing, x) if len(x) > rows_whole else None
    out_q, out_v, out_d = [], [], []
    for qid, vector in zip(qids.tolist(), q, strict=True):
        at = index.candidates(vector) if index else np.arange(len(x))
        at = at[ids[at] != qid]
        if len(at) < max(k, len(x) // FEW):
            at = np.flatnonzero(ids != qid)
        d = np.sqrt(((x[at] - vector) ** 2).sum(1))
        if len(at) > k:
            # ties at the k-th distance stay until the ids decide
            near = d <= np.partition(d, k - 1)[k - 1]
            at, d = at[near], d[near]
        best = np.lexsort((ids[at], d))[:k]
        out_q += [qid] * len(best)
        out_v += ids[at[best]].tolist()
        out_d += d[best].tolist()
    return out_q, out_v, out_d


def usable(vectors: DataFrame, zero: bool = False) -> DataFrame:
    """vec_id, embedding of the rows that take part (zero: zero vectors too)."""
    v = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    keep = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad)
    if not zero:
        keep = keep & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", "embedding").where(F.coalesce(keep, F.lit(False)))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, rows: int = ROWS, queries: int = QUERIES, rows_whole: int = ROWS_WHOLE, **options) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by `every` its k nearest others found."""
    own = usable(vectors)
    asked = F.pmod("vec_id", F.lit(every)) == 0
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # the typical length of a vector sets the width of buckets; one pass over all rows
    stats = own.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(asked, 1)).alias("q"), F.sqrt(F.avg(norm)).alias("scale")).first()
    scale = float(f"{stats['scale'] or 1.0:.6g}")
    row_blocks, query_blocks = -(-max(stats["n"], 1) // rows), -(-max(stats["q"], 1) // queries)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    size = F.size("embedding").alias("size")
    left = own.select("vec_id", "embedding", size, block(row_blocks, "row").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    queried = own.where(asked).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    right = queried.select("vec_id", "embedding", size, block(query_blocks, "query").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))

    def cell(x: pa.Table, q: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if x.num_rows and q.num_rows:
            ids, qids = x.column("vec_id").to_numpy(), q.column("vec_id").to_numpy()
            found = searched(ids, matrix(x.column("embedding")), qids, matrix(q.column("embedding")), scale, k, rows_whole, options)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    by = ("size", "rb", "qb")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(cell, "query_id long, vec_id long, score double")
    return best(found, k, F.col("score").asc()).select("query_id", "rank", F.col("vec_id").cast(kind).alias("vec_id"), "score")


def best(found: DataFrame, k: int, order) -> DataFrame:
    """Each query's k best rows of all cells, ranked from 1, ties to the smaller vec_id."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, F.col("vec_id").asc()))
    return found.select("*", rank.alias("rank")).where(F.col("rank") <= k)
