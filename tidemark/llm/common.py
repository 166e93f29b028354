"""What several operators share: the shared folder, written tables, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Java's regular expression for a word: a run of what isn't ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Only where that is unset on a single machine (master local) a local folder stands in;
    on a cluster, whose executors wouldn't see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, **options: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, which survives the loss of executors; and its path. options: the writer's."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    # the shuffles of this job aren't read again: their files can go at its end
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def unused(name: str, taken: set[str]) -> str:
    """A column name that isn't among those taken (lower case)."""
    while name in taken:
        name += "_"
    return name


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that no later step reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def by_worker(key: str, build: Callable[[], object]) -> object:
    """build()'s value, kept for the life of a Python worker that Spark uses again."""
    kept = sys.modules.setdefault("_tidemark_by_worker", types.ModuleType("_tidemark_by_worker")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def freed() -> None:
    """At a task's end: gives memory that a worker no longer uses back to the system, as the worker lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """A string column as a list, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


#: Bytes of text up to which rows are a slice.
SLICE = 1 << 21


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256, texts: tuple[int, ...] = ()) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are held as Python objects at once.

    At most `rows` rows, and of the given text columns no more than SLICE bytes but for one longer row.
    """
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        for k in texts:
            ends += np.cumsum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        k = 0
        while k < batch.num_rows:
            last = int(np.searchsorted(ends[k : k + rows], (ends[k - 1] if k else 0) + SLICE, "right")) if texts else rows
            last = min(k + max(last, 1), batch.num_rows)
            yield batch.slice(k, last - k)
            k = last
    freed()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on Arrow batches of the session hold `rows` rows at most, as whole texts and pages are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the links u-v: (node, smallest node of its component) for nodes that aren't it."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if not (low != high).any():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's links as stars; folded together every few million links, so that memory stays bounded."""
    us, vs, held = [], [], 0
    for batch in batches:
        us.append(batch.column(0).to_numpy(zero_copy_only=False))
        vs.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= 4_000_000:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            if len(u) > held // 2:  # folding no longer helps: pass on what there is
                yield from _links(u, v)
                u = v = np.empty(0, np.int64)
            us, vs, held = [u], [v], len(u)
    if us:
        yield from _links(*forest(np.concatenate(us), np.concatenate(vs)))


def _links(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(u), 100_000):
        yield pa.record_batch({"u": pa.array(u[k : k + 100_000], pa.int64()), "v": pa.array(v[k : k + 100_000], pa.int64())})


#: Up to so many links, union-find ends in one task.
FEW_LINKS = 500_000


def components(links: DataFrame, what: str, few: int = FEW_LINKS) -> tuple[DataFrame, list[str]]:
    """Connected components of links (u long, v long): rows (node, root) for each node of a link.

    root is the smallest node that can be reached. Union-find within each partition
    leaves stars, of which one task can join a few (at most `few` links: a proven
    bound on what it holds); else alternating large-star and small-star rounds then join these,
    each round a written table. Minima are combined before they are shuffled, and
    the joins are plain ones, which adaptive execution splits where a node is hot.
    Also returns the paths that the result reads.
    """
    spark = links.sparkSession
    edges, path = written(links.where("u <> v").select("u", "v").mapInArrow(_forests, "u long, v long"), what)
    if edges.count() <= few:
        one, new = written(edges.coalesce(1).mapInArrow(_forests, "u long, v long"), what)
        removed(spark, path)
        return _named(one), [new]
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: what a node links to below it hangs from the lowest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges, new = written(small, what)
        removed(spark, path)
        path = new
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return _named(edges), [path]


def _named(edges: DataFrame) -> DataFrame:
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
