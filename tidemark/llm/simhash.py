"""SimHash near-duplicates: fingerprints of word shingles, linked by BK-trees.

A document's fingerprint has a bit set if more than half of its shingles' hashes
have it set. Two fingerprints link if at most `radius` bits differ. The bits are
cut into radius + 2 blocks: two linked fingerprints agree in at least two blocks,
so each pair of blocks and their bits makes a shard, and all links lie inside
shards. In a shard the fingerprints form BK-trees, whose children are keyed by
their distance to the parent; a search follows only the edges within the radius.
Trees are dealt to the tasks by the shuffle and not broadcast, as the fingerprints
of a corpus have no size bound. A shard of more fingerprints than a cell holds is
cut into blocks that meet two at a time, each pair of blocks being a cell of its
own. What leaves a cell is a spanning forest of its links, never all pairs, and
distributed union-find joins the forests.

Nulls: a null or wordless text has the fingerprint zero and links like any other;
a null doc_id gets the smallest doc_id that its fingerprint reaches, null if there
is none. Repeated rows repeat in the result. Empty tables give empty tables. Only
doc_id and text are read. A text of any length is one row's work, in pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, sliced, small_batches, texts_of, unused, written

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints of a shard that are searched in one task; larger shards are cut.
CELL = 2048
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Shingles whose bits are counted at once.
AT_ONCE = 200_000


def shingles(text: str, size: int = SHINGLE) -> list[str]:
    """Runs of `size` words, lower-cased in A-Z, joined by spaces; fewer words are one run, none make none."""
    words = WORDS.findall(text.translate(LOWER) if not text.isascii() else text.lower())
    if len(words) < size:
        return [" ".join(words)] if words else []
    return [" ".join(x) for x in zip(*[words[k:] for k in range(size)], strict=False)]


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, the lowest bit first."""
    out = np.zeros(64, np.int64)
    for k in range(0, len(hashes), AT_ONCE):
        out += np.unpackbits(hashes[k : k + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def fingerprint(text: str, size: int = SHINGLE) -> int:
    own = shingles(text, size)
    if not own:
        return 0
    digest = xxhash.xxh64_intdigest
    counts = bits_set(np.array([digest(x, SEED) for x in own], np.uint64))
    return int(np.packbits(counts * 2 > len(own), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024, (1,)):
            fp = np.array([fingerprint(t, size) for t in texts_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(fp, pa.int64())})

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


class BKTree:
    """Fingerprints by their distances to their parents."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children = radius, [], []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = len(self.values) - 1
                return
            at = nxt

    def within(self, value: int) -> Iterator[int]:
        """The numbers of the fingerprints within the radius."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= self.radius:
                yield at
            for edge, child in self.children[at].items():
                if d - self.radius <= edge <= d + self.radius:
                    todo.append(child)


def linked(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints.

    A fingerprint is first held against the roots of the trees, one for each
    component so far that has one; those of a tight group meet its root at once.
    """
    tree, root, out = BKTree(radius), [], []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, value in enumerate(values):
        root.append(k)
        for near in tree.within(value):
            a, b = top(near), top(k)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((values[near], value))
        tree.add(value)
    return out


def blocks_of(radius: int) -> list[tuple[int, int]]:
    """First bit and width of radius + 2 blocks of 64 bits."""
    n = radius + 2
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _sharded(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    pairs = list(combinations(blocks_of(radius), 2))
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(fp), 50_000):
            part = fp[k : k + 50_000]
            keys = []
            for n, ((a, wa), (b, wb)) in enumerate(pairs):
                left = part >> np.uint64(a) & np.uint64((1 << wa) - 1)
                right = part >> np.uint64(b) & np.uint64((1 << wb) - 1)
                keys.append((np.uint64(n) << np.uint64(wa + wb) | left << np.uint64(wb) | right).view(np.int64))
            yield pa.record_batch({"shard": pa.array(np.concatenate(keys), pa.int64()), "fp": pa.array(np.tile(part.view(np.int64), len(pairs)), pa.int64())})


def _cells(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and cell: each cell's forest."""
    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def links(parts: tuple[np.ndarray, ...], last: bool) -> tuple[pa.RecordBatch, tuple[np.ndarray, ...]]:
        shard, cell, fp = parts
        edge = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (cell[1:] != cell[:-1]), [True]])) if len(shard) else np.array([0])
        whole = len(edge) - 1 if last else len(edge) - 2
        u, v = [], []
        for k in np.flatnonzero(np.diff(edge)[: max(whole, 0)] > 1):
            own = fp[edge[k] : edge[k + 1]]
            for a, b in linked(np.unique(own.view(np.uint64)).tolist(), radius):
                u.append(a), v.append(b)
        rest = int(edge[whole]) if whole > 0 else (len(shard) if last else 0)
        return pa.record_batch({"u": pa.array(np.array(u, np.uint64).view(np.int64), pa.int64()), "v": pa.array(np.array(v, np.uint64).view(np.int64), pa.int64())}), (shard[rest:], cell[rest:], fp[rest:])

    for batch in batches:
        new = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if held is not None:
            new = tuple(np.concatenate([a, b]) for a, b in zip(held, new, strict=True))
        out, held = links(new, False)
        yield out
    if held is not None:
        yield links(held, True)[0]


def links_of(distinct: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links u, v that join all fingerprints (column fp, distinct) within the radius of each other."""
    dealt = distinct.mapInArrow(lambda it: _sharded(it, radius), "shard long, fp long")
    # a shard's size is counted with a combiner; only shards of more than one fingerprint go on
    sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = dealt.join(sizes, "shard")
    half = cell // 2
    n = F.ceil(F.col("size") / half).cast("int")
    block = F.when(F.col("size") <= cell, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp", F.lit("block")), n)).cast("int")
    # cells of a cut shard: its block with every block; the pair (a, b) has the number a * n + b, a <= b
    rows = rows.select("shard", "fp", "size", n.alias("n"), block.alias("block"))
    own = F.when(F.col("size") <= cell, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda x: F.least(x, F.col("block")) * F.col("n") + F.greatest(x, F.col("block"))))
    rows = rows.select("shard", F.explode(own).alias("cell"), "fp")
    return rows.repartition("shard", "cell").sortWithinPartitions("shard", "cell").mapInArrow(lambda it: _cells(it, radius), "u long, v long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach."""
    fps, _ = written(fingerprints(docs, size), "fingerprints")
    by_fp = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots, _ = components(links_of(by_fp.select("fp"), radius, cell), "simhash")
    named = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # both are written, so that the joins with a large component or a frequent fingerprint are ones that adaptive execution splits
    lows, _ = written(named.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    named, _ = written(named.join(lows, "root").select("fp", "component_id"), "named")
    out = fps.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """The rows of docs, all columns, of which each component keeps the one with the smallest doc_id.

    Of rows that repeat that doc_id the one with the smallest text stays (a null text is the
    smallest; equal ones are one row where all columns are equal, else any). Rows without a doc_id all stay.
    """
    found = near_duplicates(docs, size, radius, cell)
    ids = [unused(name, {c.lower() for c in docs.columns}) for name in ("gone_id", "repeated_id", "place")]
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(ids[0])).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone[ids[0]], "left_anti")
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(ids[1]))
    if again.isEmpty():
        return kept
    # min_by combines before the shuffle, so that an id with many rows is no hot key
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    repeated = kept.join(again, kept["doc_id"] == again[ids[1]], "left_semi")
    first = F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNotNull(), F.col("text"), F.xxhash64(*others) if others else F.lit(0))).alias(ids[2])
    repeated = repeated.groupBy("doc_id").agg(first).select(f"{ids[2]}.*")
    return kept.join(again, kept["doc_id"] == again[ids[1]], "left_anti").unionByName(repeated)
