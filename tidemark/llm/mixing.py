"""Mixing sources to target weights by entropy balancing.

The mix changes the documents' rates as little as it can (in relative entropy to
one copy each, at most `most` copies) so that each source's words meet its target.
The convex dual has one multiplier a source; Newton steps, kept inside a bracket,
solve it, and a document of x words gets the rate min(most, exp(lambda * x / mean)).
Documents of equal size share a rate, so each source's dual is solved over a
histogram of sizes, exactly, the sources spread over the tasks.

Rates become copies by carried rounding: in buckets of about `bucket` documents of
a source, from the largest to the smallest, each document takes the whole number
next to its rate that leaves the bucket's words nearest to what the rates ask for.
A hot source is just more buckets.

Nulls: a null text has size 0; null sources are one source, the last; a null
doc_id is kept. Documents of size 0 have the rate 1. Repeated rows are documents
of their own. Empty tables give empty tables. Runs over the same rows agree.
Source sizes, one row a source, come to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, unused, written

WEIGHTS, SHARE, MOST, BUCKET = (3.0, 1.0, 2.0), 1.5, 2, 1000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Each source's words: shares by weight, none above `most` times its size, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * each > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * each for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def multiplier(size: np.ndarray, n: np.ndarray, target: float, most: float, steps: int = 200) -> float:
    """The lambda at which the words of n documents of each size, tilted, are the target."""
    own = size > 0
    size, n = size[own].astype(float), n[own].astype(float)
    total = float((size * n).sum())
    if not total:
        return 0.0
    if target >= most * total * (1 - 1e-12):
        return math.inf
    if target <= 0:
        return -math.inf
    x = size / (total / n.sum())
    mass = size * n
    low, high, at = -1e6, 1e6, 0.0
    for _ in range(steps):
        with np.errstate(over="ignore"):
            rate = np.exp(np.minimum(at * x, math.log(most) + 1))
        capped = rate >= most
        gap = float((mass * np.minimum(rate, most)).sum()) - target
        if abs(gap) <= 1e-9 * total:
            break
        low, high = (at, high) if gap < 0 else (low, at)
        slope = float((mass * rate * x)[~capped].sum())
        step = at - gap / slope if slope > 0 else math.nan
        at = step if low < step < high else (low + high) / 2
    return at


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    size, n = rows["size"].to_numpy(), rows["n"].to_numpy()
    total = float((size * n).sum())
    docs = float(n[size > 0].sum())
    out = multiplier(size, n, float(rows["target"].iloc[0]), float(rows["most"].iloc[0]))
    return pd.DataFrame({"source": rows["source"].iloc[:1], "lambda": [out], "mean": [total / docs if docs else 1.0]})


def _round(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable")
    carried, copies = 0.0, []
    for size, rate in zip(rows["size"].tolist(), rows["rate"].tolist(), strict=True):
        low = math.floor(rate)
        want = carried + rate * size
        take = low if low == rate or abs(want - low * size) <= abs(want - (low + 1) * size) else low + 1
        carried = want - take * size
        copies.append(take)
    return rows.drop(columns=["order", "bucket", "rate"]).assign(copies=np.array(copies, np.int64))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each document."""
    spark = docs.sparkSession
    # texts are read once; the table of sizes, a few bytes a document, serves the histogram and the rates
    sized, _ = written(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")), "sizes")
    histogram = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    per_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")).collect()
    goal = targets({r["source"]: r["source_size"] for r in per_source}, weights, share, most)
    plan = spark.createDataFrame([(r["source"], r["source_size"], r["docs"], goal[r["source"]]) for r in per_source], "source string, source_size long, docs long, target double")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    asked = histogram.join(plan, same(histogram, plan)).select(histogram["source"], "size", "n", "target", F.lit(float(most)).alias("most"))
    solved = asked.groupBy("source").applyInPandas(_solve, "source string, lambda double, mean double")
    plan = plan.join(solved, same(plan, solved)).select(plan["source"], "source_size", "docs", "target", "lambda", "mean")
    # as many rows as sources, counted above
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    rated = sized.join(plan, same(sized, plan)).select("doc_id", sized["source"], "size", "source_size", "target", "docs", "lambda", "mean")
    tilt = F.col("lambda") * F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(most)), F.exp(F.least(tilt, F.lit(50.0)))))
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mixing"))
    rated = rated.select("doc_id", "source", "size", "source_size", "target", rate.alias("rate"), order.alias("order"), F.pmod(order, F.ceil(F.col("docs") / bucket).cast("long")).alias("bucket"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rated.groupBy("source", "bucket").applyInPandas(_round, f"doc_id {kind}, source string, size long, source_size long, target double, copies long")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it. Rows that repeat a doc_id count alike."""
    taken = {c.lower() for c in docs.columns}
    own, times, copy = (unused(name, taken) for name in ("mixed_id", "copies", "copy"))
    copies = mix(docs, **options).groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").alias(times)).where(F.col(times) > 0)
    rows = docs.join(copies, docs["doc_id"].eqNullSafe(copies[own]))
    return rows.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), copies[times])).alias(copy)).select(*docs.columns)
