"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order five over the letters of its words, with marks
for a word's start and end. Counts are kept as sorted arrays of n-gram hashes. A
text's language is the one with the lowest cross-entropy per character. Calibration
documents, which the models haven't seen, give each language the mean and spread of
its cross-entropy (wider for short texts) and, by an exponential tail fitted to
their uppermost tenth, the limit that a document of the language passes at a given
rate only (`false_rejections`); a text beyond it is rejected.

The models are fitted on a bounded sample (docs_per_lang documents a language,
drawn by a hash of doc_id); every document is predicted, from its whole text.

Nulls: a text that is null or without letters is `und`, with score 0, and is
rejected; a null lang isn't learned from; a null doc_id is neither held out nor
learned from. Without any labelled document all texts are `und`. Equal rows give
equal rows, ties go to the smaller lang. Words of any length and texts of any
length are read whole, a few hundred documents at a time. Other columns are not read.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, small_batches, texts_of

ORDER = 5
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Marks that no letter equals.
START, END = 1, 2
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Least spreads between documents and of a single character, and the share of calibration documents that the tail is fitted to.
LEAST_SPREAD, LEAST_SINGLE, TAIL = 0.01, 0.1, 0.1
#: How many words' scores a worker keeps at once, and how many documents it reads at once.
KEPT_WORDS, DOCUMENTS = 250_000, 256


def letters_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def windows(words: list[str]) -> np.ndarray:
    """For each letter of the words, and their ends, the last ORDER characters up to it (0: none; START first)."""
    text = "\x01" + "\x02\x01".join(words) + "\x02"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.arange(len(codes))
    since = at - np.maximum.accumulate(np.where(codes == START, at, 0))
    out = np.zeros((len(codes), ORDER), np.uint32)
    for back in range(min(ORDER, len(codes))):
        col = np.zeros(len(codes), np.uint32)
        col[back:] = codes[: len(codes) - back]
        out[:, ORDER - 1 - back] = np.where(since >= back, col, 0)
    return out[codes != START]


def hashes(w: np.ndarray, first: int, last: int) -> np.ndarray:
    """A hash of the characters first..last-1 of each window."""
    h = np.full(len(w), 7, np.uint64)
    for k in range(first, last):
        h = (h ^ w[:, k].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h


def found(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted hashes stand in the sorted keys, and whether they do."""
    if not len(keys):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return at, keys[at] == want


class KneserNey:
    """One language's model: for each order sorted n-gram hashes with their shares, and contexts with what they leave."""

    def __init__(self, orders: list[tuple[np.ndarray, ...]], letters: int, seen: np.ndarray):
        self.orders, self.letters, self.seen = orders, letters, seen

    @classmethod
    def fit(cls, words: list[str], counts: np.ndarray) -> KneserNey:
        w = windows(words)
        weight = np.repeat(counts, [len(x) + 1 for x in words]).astype(np.float64)
        full = (w != 0).sum(1)  # how many characters there are up to the word's start
        orders = []
        for n in range(1, ORDER + 1):
            use = full >= n
            keys, first, inverse = np.unique(hashes(w[use], ORDER - n, ORDER), return_index=True, return_inverse=True)
            count = np.bincount(inverse, weight[use], len(keys))
            if n < ORDER:  # how many characters come before it; at a word's start its own count
                longer = full >= n + 1
                _, one = np.unique(hashes(w[longer], ORDER - n - 1, ORDER), return_index=True)
                at, _ = found(keys, hashes(w[longer][one], ORDER - n, ORDER))
                before = np.bincount(at, minlength=len(keys))
                count = np.where(before > 0, before, count).astype(np.float64)
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            less = min(0.95, n1 / (n1 + 2 * n2)) if n1 else 0.5
            context, of = np.unique(hashes(w[use][first], ORDER - n, ORDER - 1), return_inverse=True)
            total = np.bincount(of, count)
            share = np.maximum(count - less, 0) / total[of]
            left = np.minimum(count, less)
            orders.append((keys, share.astype(np.float32), context, (np.bincount(of, left) / total).astype(np.float32)))
        _, one = np.unique(hashes(w, 0, ORDER), return_index=True)
        return cls(orders, len(np.unique(w[:, -1])) + 1, w[one])

    def log_p(self, w: np.ndarray) -> np.ndarray:
        """The logarithm of each window's last character's probability after those before it."""
        p = np.full(len(w), 1 / (self.letters + 1000), np.float64)
        for n, (keys, share, context, left) in enumerate(self.orders, 1):
            at, known = found(context, hashes(w, ORDER - n, ORDER - 1))
            known &= w[:, ORDER - n] != 0
            own, has = found(keys, hashes(w, ORDER - n, ORDER))
            p = np.where(known, np.where(has, share[own] if len(share) else 0, 0) + left[at] * p if len(left) else p, p)
        return np.log(p)


@dataclass
class LanguageModel:
    """Models of all languages, and one sorted array of all windows seen, with each language's logarithm."""

    langs: list[str]
    models: list[KneserNey]
    keys: np.ndarray
    logs: np.ndarray
    #: By language, of the cross-entropy: mean, spread between documents and of a single character, and how many spreads above the mean are too many.
    fit_of: dict[str, tuple[float, float, float, float]]

    @classmethod
    def of(cls, models: dict[str, KneserNey]) -> LanguageModel:
        langs = sorted(models)
        own = [models[x] for x in langs]
        if not own:
            return cls([], [], np.empty(0, np.uint64), np.empty((0, 0), np.float32), {})
        w = np.concatenate([m.seen for m in own])
        keys, one = np.unique(hashes(w, 0, ORDER), return_index=True)
        return cls(langs, own, keys, np.stack([m.log_p(w[one]) for m in own], 1).astype(np.float32), {})

    def words(self, words: list[str]) -> np.ndarray:
        """For each word and language the sum of its logarithms, and in the last column its characters."""
        w = windows(words)
        at, known = found(self.keys, hashes(w, 0, ORDER))
        logs = self.logs[at]
        if not known.all():
            logs[~known] = np.stack([m.log_p(w[~known]) for m in self.models], 1)
        n = np.array([len(x) + 1 for x in words])
        return np.concatenate([np.add.reduceat(logs, np.cumsum(n) - n, axis=0), n[:, None]], 1)

    def texts(self, texts: list[str], kept: dict[str, int], rows: list[np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """For each text the language's number (-1: none), its cross-entropies and its characters."""
        words = [letters_of(t) for t in texts]
        new = [x for x in set().union(*words) if x not in kept]
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            rows.clear()
            new = list(set().union(*words))
        if new:
            start = sum(map(len, rows))
            kept.update(zip(new, range(start, start + len(new)), strict=True))
            rows.append(self.words(new))
            if len(rows) > 32:
                rows[:] = [np.concatenate(rows)]
        table = np.concatenate(rows) if len(rows) > 1 else rows[0] if rows else np.zeros((0, len(self.langs) + 1))
        rows[:] = [table] if len(table) else []
        sums = np.zeros((len(texts), len(self.langs) + 1))
        for k, own in enumerate(words):
            if own:
                sums[k] = table[[kept[x] for x in own]].sum(0)
        n = sums[:, -1]
        entropy = -sums[:, :-1] / np.maximum(n, 1)[:, None]
        return [int(e.argmin()) if m else -1 for e, m in zip(entropy, n, strict=True)], entropy, n

    def judged(self, texts: list[str], kept: dict, rows: list) -> tuple[list[str], list[float], list[bool], list[float], list[int]]:
        """Language, score, whether rejected, cross-entropy and characters of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts), [0.0] * len(texts), [0] * len(texts)
        best, entropy, n = self.texts(texts, kept, rows)
        langs, scores, rejected, lows = [], [], [], []
        for b, e, m in zip(best, entropy, n, strict=True):
            if b < 0:
                langs.append(UNKNOWN), scores.append(0.0), rejected.append(True), lows.append(0.0)
                continue
            share = np.exp(-(e - e[b]) * m)
            mean, between, single, limit = self.fit_of.get(self.langs[b], (e[b], 1.0, 1.0, math.inf))
            away = (e[b] - mean) / math.hypot(between, single / math.sqrt(m))
            langs.append(self.langs[b])
            scores.append(float(1 / share.sum() / (1 + math.exp(min(50.0, away - limit)))))
            rejected.append(bool(away > limit))
            lows.append(float(e[b]))
        return langs, scores, rejected, lows, n.astype(int).tolist()

    def calibrate(self, lang: str, entropy: np.ndarray, n: np.ndarray, false_rejections: float) -> None:
        """Sets a language's mean, spreads and limit from the cross-entropies and characters of its documents."""
        mean = float(np.median(entropy))
        away = entropy - mean
        between = max(float(np.median(np.abs(away[n >= np.median(n)]))) * 1.4826, LEAST_SPREAD)
        single = max(float(np.median(np.abs(away) * np.sqrt(n))) * 1.4826, LEAST_SINGLE)
        z = away / np.hypot(between, single / np.sqrt(n))
        start = float(np.quantile(z, 1 - TAIL))
        beyond = z[z > start] - start
        self.fit_of[lang] = (mean, between, single, start + max(1.0, float(beyond.mean()) if len(beyond) else 1.0) * math.log(TAIL / false_rejections))


def remainder(docs: DataFrame) -> Column:
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4


def _drawn(counts: dict[str, int], low: float, high: float) -> Column:
    """Whether a document's hash falls to its language's sample of about low to high documents."""
    unit = F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    out = F.lit(False)
    for lang, n in counts.items():
        out = out | ((F.col("lang") == lang) & (unit >= low / n) & (unit < max(high, low) / n))
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            counts.setdefault(lang, Counter()).update(letters_of(text))
    for lang, c in counts.items():
        yield pa.record_batch({"lang": pa.array([lang] * len(c), pa.string()), "word": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("word")
    model = KneserNey.fit(rows["word"].tolist(), rows["n"].to_numpy())
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "model": [cloudpickle.dumps((model.orders, model.letters, model.seen))]})


def fit(docs: DataFrame, docs_per_lang: int = 1500, calibration_docs: int = 400, false_rejections: float = 1e-4) -> LanguageModel:
    """Learns from labelled documents that aren't held out.

    docs_per_lang bounds each language's sample (it may be off by a few in a
    hundred, as a hash draws it), calibration_docs that of the documents which set
    the mean, the spread and the limit of a language's cross-entropy, which about
    one in 1 / false_rejections of its documents pass. Models, not documents, come
    to the driver; their size is bounded by the sample's.
    """
    learn = docs.select("doc_id", "lang", "text").where((remainder(docs) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel.of({})
    sample = learn.where(_drawn(counts, 0, docs_per_lang)).select("lang", "text")
    words = sample.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    model = LanguageModel.of({r["lang"]: KneserNey(*pickle.loads(r["model"])) for r in words.groupBy("lang").applyInPandas(_fit, "lang string, model binary").collect()})
    # documents next to the sample; where a language has no more than the sample, those of the sample
    low = {x: (docs_per_lang if n > docs_per_lang + calibration_docs else max(0, min(n, docs_per_lang) - calibration_docs)) for x, n in counts.items()}
    held = F.lit(False)
    for x, n in counts.items():
        held = held | _drawn({x: n}, low[x], low[x] + calibration_docs)
    own = _judged(learn.where(held), model)
    seen = own.where("lang = lang_pred").select("lang", "entropy", "n").toPandas()
    for lang, e in seen.groupby("lang"):
        model.calibrate(lang, e["entropy"].to_numpy(), e["n"].to_numpy(), false_rejections)
    return model


def _sent(spark: SparkSession, model: LanguageModel) -> Callable[[], LanguageModel]:
    """The model on the workers, with its class by value, so that they need no copy of this package."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(sent.value)


def _judged(docs: DataFrame, model: LanguageModel) -> DataFrame:
    sent = _sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (kept, rows) = sent(), ({}, [])
        for batch in sliced(batches, DOCUMENTS, (2,)):
            texts = texts_of(batch.column(2))
            langs, scores, rejected, lows, n = m.judged(texts, kept, rows)
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0), "lang": batch.column(1), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()),
                    "rejected": pa.array(rejected, pa.bool_()), "entropy": pa.array(lows, pa.float64()), "n": pa.array(n, pa.int64()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind}, lang string, lang_pred string, score double, rejected boolean, entropy double, n long")


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document. lang, source and doc_id play no part in it."""
    out = _judged(docs.select("doc_id", F.lit(None).cast("string").alias("lang"), "text"), model)
    return out.select("doc_id", F.coalesce(remainder(out) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs, all columns, whose text isn't rejected."""
    sent = _sent(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (kept, rows) = sent(), ({}, [])
        for batch in sliced(batches, DOCUMENTS, (at,)):
            yield batch.filter(pa.array([not x for x in m.judged(texts_of(batch.column(at)), kept, rows)[2]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
