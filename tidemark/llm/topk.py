"""Exact top-k search by inner product, as a Voronoi nearest-neighbour join.

Vectors become whole numbers, floor(256 * x). One more component, sqrt(M - |x|^2)
with M the largest |x|^2 (0 for queries), turns the largest inner products into
the smallest Euclidean distances: |q - x|^2 = |q|^2 + M - 2 q.x. Pivots cut rows
and queries into groups by the nearest pivot. From a summary of the groups (the
few smallest distances to each pivot, and each query group's radius) comes an upper
bound of every query's k-th distance in a group, and a row goes to a query group
only if the triangle inequality leaves it within that bound. Cells of a query
block and a block of these rows are solved exactly, and each gives its k best.

Blocks are dealt by hash, so a hot group is just more cells. Pivots are picked
from a bounded sample (`sample` rows), which sets the cost only, never the result;
summaries, a few numbers a pivot, come to the driver.

Vectors that are null, empty, or hold a null or non-finite component take no part,
nor do rows with a null vec_id; vectors of different lengths don't meet. Zero
vectors count. Rows that repeat a vec_id are candidates each, none of them its
own; as a query the id has one answer, that of the smallest of its vectors (by
components in order). Ties go to the smaller vec_id. Empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ann import best, matrix, usable
from tidemark.llm.common import written

SCALE, ROWS, QUERIES, SAMPLE = 256, 8192, 1024, 512
#: Whole numbers up to which doubles add products exactly.
EXACT = 2.0**53


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: through doubles where these can hold them."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if most < EXACT else q @ x.T


def solved(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list, list]:
    """Each query's k largest products in a cell: query ids, vector ids, products."""
    out: tuple[list, list, list] = ([], [], [])
    for a in range(0, len(q), 128):
        block = products(q[a : a + 128], x)
        for qid, row in zip(qids[a : a + 128].tolist(), block, strict=True):
            at = np.flatnonzero(row >= np.partition(row, -(k + 1))[-(k + 1)]) if len(row) > k + 1 else np.arange(len(row))
            at = at[ids[at] != qid]
            if len(at) < min(k, len(row)):  # rows that repeat the query's id stood among the largest
                at = np.flatnonzero(ids != qid)
            top = at[np.lexsort((ids[at], -row[at]))[:k]]
            out[0].extend([qid] * len(top))
            out[1].extend(ids[top].tolist())
            out[2].extend(row[top].tolist())
    return out


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of the sample, each the farthest from those before it."""
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def raised(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that makes all of one length."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(top - (x**2).sum(1), 0))[:, None]], 1)


def largest(vectors: DataFrame, every: int = 50, k: int = 5, rows: int = ROWS, queries: int = QUERIES, pivots: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by `every` its k largest others."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    own = usable(vectors, zero=True)
    own = own.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    asked = F.pmod("vec_id", F.lit(every)) == 0
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    lengths = own.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(asked, 1)).alias("q"), F.max(norm).alias("top")).where("q > 0").collect()
    out = None
    for s in lengths:
        part = _largest(own.where(F.size("v") == s["size"]), asked, s, k, rows, queries, pivots, sample)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id {kind}, score long")
    return best(out, k, F.col("score").desc()).select("query_id", "rank", F.col("vec_id").cast(kind).alias("vec_id"), "score")


def _largest(own: DataFrame, asked, s, k: int, rows: int, queries: int, pivots: int | None, sample: int) -> DataFrame:
    """Products of each query's best rows in each cell, for vectors of one length."""
    top = float(s["top"])
    n_pivots = pivots or min(64, max(4, -(-s["q"] // (queries // 4))))
    drawn = own.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(sample).select("v").toArrow().column(0)
    p = pivots_of(raised(matrix(drawn), top), n_pivots)

    def grouped(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            row, query = raised(x, top), np.concatenate([x, np.zeros((len(x), 1))], 1)
            cols = {"vec_id": batch.column(0).cast(pa.int64()), "v": batch.column(1)}
            for name, y in (("row", row), ("query", query)):
                d = np.sqrt(np.maximum((y**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * (y @ p.T), 0))
                g = d.argmin(1)
                cols[f"{name}_group"], cols[f"{name}_away"] = pa.array(g, pa.int32()), pa.array(d[np.arange(len(g)), g])
            yield pa.record_batch(cols)

    dealt, _ = written(own.mapInArrow(grouped, "vec_id long, v array<bigint>, row_group int, row_away double, query_group int, query_away double"), "voronoi")
    # summaries: the smallest distances of rows to their pivot, and the radius of each query group
    few = k + 1  # rows of different ids, one of which may be the query's own
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("row_group", "part").orderBy("row_away"))
    by_id = dealt.groupBy("row_group", "vec_id").agg(F.min("row_away").alias("row_away"))
    small = by_id.select("row_group", "row_away", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).select("*", nth.alias("nth")).where(F.col("nth") <= few)
    near: dict[int, list[float]] = {}
    for r in small.select("row_group", "row_away").collect():  # at most 64 * few rows a pivot
        near.setdefault(r["row_group"], []).append(r["row_away"])
    radius = {r["query_group"]: r["radius"] for r in dealt.where(asked).groupBy("query_group").agg(F.max("query_away").alias("radius")).collect()}
    between = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    slack = 1e-6 * (1 + float(np.sqrt(top)) + float(between.max()))
    limits = []  # row group, query group, the least row_away at which a row of the one goes to the other
    for i, r in radius.items():
        bounds = sorted(r + between[i, j] + a for j, own_near in near.items() for a in own_near)
        worst = bounds[few - 1] if len(bounds) >= few else np.inf
        limits += [(j, i, float(between[i, j] - r - worst - slack), float(r + worst + between[i, j] + slack)) for j in near]
    # by triangle inequalities on both sides a row at distance a from pivot j may be within the bound of group i
    # only if between - a <= radius + bound and a - between <= radius + bound
    to = {}
    for j, i, least, most in limits:
        to.setdefault(j, []).append((i, least, most))
    goes = F.array().cast("array<int>")
    for j, own_limits in to.items():
        groups = F.filter(F.array(*[F.when((F.col("row_away") >= a) & (F.col("row_away") <= b), F.lit(i)) for i, a, b in own_limits]), lambda x: x.isNotNull())
        goes = F.when(F.col("row_group") == j, groups).otherwise(goes)
    row_blocks, query_blocks = -(-s["n"] // rows), -(-s["q"] // queries)
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dealt.select("vec_id", "v", block(row_blocks, "row").alias("rb"), F.explode(goes).alias("g")).select("*", spread(query_blocks).alias("qb"))
    queried = dealt.where(asked).groupBy("vec_id").agg(F.min(F.struct("v", "query_group", "query_away")).alias("own")).select("vec_id", "own.*")
    right = queried.select("vec_id", "v", F.col("query_group").alias("g"), block(query_blocks, "query").alias("qb"), spread(row_blocks).alias("rb"))

    def cell(q: pa.Table, x: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if q.num_rows and x.num_rows:
            whole = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, -1)
            found = solved(q.column("vec_id").to_numpy(), whole(q), x.column("vec_id").to_numpy(), whole(x), k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    by = ("g", "qb", "rb")
    return right.groupBy(*by).cogroup(left.groupBy(*by)).applyInArrow(cell, "query_id long, vec_id long, score long")
