"""Personal data: exact patterns, and a linear-chain conditional random field for what they miss.

The patterns find e-mail and IP addresses, payment cards and telephone numbers in
whole texts. The field labels words (runs between white space) by features of
their shapes and their neighbours' shapes. It is trained on a small labelled
table, on the driver. A word without a digit or an @ can only be outside; the
chain therefore falls apart, exactly, into runs of other words, which are decoded
by Viterbi's algorithm in numpy batches, by length. A labelled run adds a span if
no pattern's span overlaps it and its digits fit its kind. Pattern spans stay.

Nulls: a null text is the empty text, a null doc_id is kept. Positions count code
points, ends are exclusive. Equal rows give equal rows; empty tables give empty
tables; other columns are not read. A very long text is one row's work, linear in
its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import texts_of

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Rows of the labelled table that training reads at most.
LABELLED_ROWS = 5000
#: Characters of a word up to which its scores are kept.
LONG = 200

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match starts where a run of digits does, as it fails from all of its digits alike: a run is read once
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]")
NEXT = re.compile(r"\s*(\S*)")
#: What a card's or a telephone's span consists of.
DIALLED = re.compile(r"[+0-9 ().-]+")
EDGES = ".,;:!?\"'|<>[]{}"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_in(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind and start. A match that fails its kind's check is dropped, without another try."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # what may stand before the @ ends at it, so each @ is looked at once
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, free := m.end()))
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_in(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits_in(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def shape(word: str, first: int | None = None) -> str:
    """Runs of capitals, small letters and digits as X, x and d; other characters as they are, repeated ones once. first: only so many."""
    out: list[str] = []
    for c in word:
        s = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != s:
            if len(out) == first:
                break
            out.append(s)
    return "".join(out)


def features(word: str, before: str, after: str) -> list[str]:
    """Features of a word's shape and of the shapes beside it."""
    bare, n = word.strip(EDGES), len(digits_in(word))
    own = shape(bare)
    size = "0" if not n else str(n) if n < 6 else "6-7" if n < 8 else "8-15" if n < 16 else "16-19" if n < 20 else "20+"
    return ["s:" + own, "n:" + size, "s:" + own + "|n:" + size, "b:" + shape(before.strip(EDGES), 8), "a:" + shape(after.strip(EDGES), 8), "@" + str(min(word.count("@"), 2)), "e:" + word[-1:] * (word[-1:] in EDGES)]


def marked(word: str) -> bool:
    return MARKED.search(word) is not None


class Field:
    """A linear-chain conditional random field over TAGS."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(TAGS)))
        self.steps = np.zeros((len(TAGS), len(TAGS)))
        # an inside tag follows only its own kind
        self.allowed = np.array([[b[0] != "I" or a[2:] == b[2:] and a != "O" for b in TAGS] for a in TAGS])
        self.first = np.array([b[0] != "I" for b in TAGS])

    def emission(self, names: list[str]) -> np.ndarray:
        ids = [self.index[f] for f in names if f in self.index]
        return self.weights[ids].sum(0) if ids else np.zeros(len(TAGS))

    def fit(self, rows: list[tuple[list[str], list[str]]], rounds: int = 150, rate: float = 0.1, decay: float = 0.002) -> Field:
        """Maximum likelihood by full-batch gradient steps (Adam) over padded sentences."""
        rows = [(w, t) for w, t in rows if w]
        if not rows:
            return self
        n, width, k = len(rows), max(len(w) for w, _ in rows), len(TAGS)
        names = [[features(w[j], w[j - 1] if j else "", w[j + 1] if j + 1 < len(w) else "") for j in range(len(w))] for w, _ in rows]
        for f in (f for s in names for x in s for f in x):
            self.index.setdefault(f, len(self.index))
        size = len(self.index)
        where = np.array([(i, j, self.index[f]) for i, s in enumerate(names) for j, x in enumerate(s) for f in x])
        gold = np.zeros((n, width), int)
        real = np.zeros((n, width), bool)
        free = np.zeros((n, width), bool)
        for i, (w, t) in enumerate(rows):
            gold[i, : len(w)], real[i, : len(w)], free[i, : len(w)] = [TAGS.index(x) for x in t], True, [marked(x) for x in w]
        theta = np.zeros(size * k + k * k)
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        bar = np.where(self.allowed, 0.0, -1e9)
        hot = np.eye(k)[gold] * real[:, :, None]
        for step in range(1, rounds + 1):
            weights, steps = theta[: size * k].reshape(size, k), theta[size * k :].reshape(k, k)
            e = np.zeros((n, width, k))
            np.add.at(e, (where[:, 0], where[:, 1]), weights[where[:, 2]])
            e[~free, 1:] = -1e9
            e[:, 0, ~self.first] = -1e9
            t = steps + bar
            fwd, back = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for j in range(1, width):
                fwd[:, j] = np.where(real[:, j, None], np.logaddexp.reduce(fwd[:, j - 1, :, None] + t, axis=1) + e[:, j], fwd[:, j - 1])
            for j in range(width - 2, -1, -1):
                back[:, j] = np.where(real[:, j + 1, None], np.logaddexp.reduce(t + (e[:, j + 1] + back[:, j + 1])[:, None, :], axis=2), 0)
            total = np.logaddexp.reduce(fwd[:, -1], axis=1)
            p = np.exp(fwd + back - total[:, None, None]) * real[:, :, None]
            grad = np.zeros((size, k))
            np.add.at(grad, where[:, 2], (hot - p)[where[:, 0], where[:, 1]])
            pair = np.zeros((k, k))
            for j in range(1, width):
                q = np.exp(fwd[:, j - 1, :, None] + t + (e[:, j] + back[:, j])[:, None, :] - total[:, None, None]) * real[:, j, None, None]
                pair += (hot[:, j - 1, :, None] * hot[:, j, None, :]).sum(0) - q.sum(0)
            g = np.concatenate([grad.ravel(), pair.ravel()]) / n - decay * theta
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            theta += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.weights, self.steps = theta[: size * k].reshape(size, k), theta[size * k :].reshape(k, k)
        return self

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over runs of emissions, padded in batches of like length. Outside comes before and after a run."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(runs)
        t = np.where(self.allowed, self.steps, -1e9)
        by_length = sorted(range(len(runs)), key=lambda r: len(runs[r]))
        k = 0
        while k < len(by_length):
            width = len(runs[by_length[k]])
            last = k
            while last < len(by_length) and last - k < 4096 and len(runs[by_length[last]]) <= width * 1.25:
                last += 1
            own = by_length[k:last]
            width = len(runs[own[-1]])
            e = np.zeros((len(own), width, len(TAGS)))
            e[:, :, 1:] = -1e9  # what pads a run is outside
            for r, i in enumerate(own):
                e[r, : len(runs[i])] = runs[i]
            best = t[0] + e[:, 0]
            came = np.zeros((len(own), width, len(TAGS)), np.int8)
            for j in range(1, width):
                score = best[:, :, None] + t
                came[:, j] = score.argmax(1)
                best = score.max(1) + e[:, j]
            at = (best + t[:, 0]).argmax(1)
            path = np.zeros((len(own), width), int)
            for j in range(width - 1, -1, -1):
                path[:, j] = at
                at = came[np.arange(len(own)), j, at]
            for r, i in enumerate(own):
                out[i] = path[r, : len(runs[i])]
            k = last
        return out


def labelled_table(spark: SparkSession, rows: int = 400) -> DataFrame:
    """A small labelled table, made from a rule: words (array) and their tags (array)."""
    rng = np.random.default_rng(7)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    letters = lambda a, b: "".join(pick("abcdefghiklmnoprstuvw") for _ in range(int(rng.integers(a, b))))
    entity = [
        lambda: ([f"{letters(2, 8)}.{num(2)}@{letters(3, 7)}{num(1)}.{letters(3, 8)}.com"], "email"),
        lambda: ([f"{letters(2, 8)}@{letters(3, 7)}.{pick(['com', 'org', 'net', 'de'])}"], "email"),
        lambda: ([f"{letters(2, 6)}_{num(2)}@{letters(3, 7)}.{letters(2, 3)}"], "email"),
        lambda: ([".".join(str(int(rng.integers(1, 255))) for _ in range(4))], "ip"),
        lambda: ([num(16)], "card"),
        lambda: ([num(4), num(4), num(4), num(4)], "card"),
        lambda: (["-".join(num(4) for _ in range(4))], "card"),
        lambda: (["+1", f"({num(3)})", f"{num(3)}-{num(4)}"], "phone"),
        lambda: ([f"({num(3)})", f"{num(3)}-{num(4)}"], "phone"),
        lambda: ([f"{num(3)}-{num(3)}-{num(4)}"], "phone"),
        lambda: ([f"+{num(2)}", num(3), num(7)], "phone"),
        lambda: ([f"{num(3)}.{num(3)}.{num(4)}"], "phone"),
    ]
    other = [
        lambda: [f"{int(rng.integers(1900, 2030))}-{num(2)}-{num(2)}"], lambda: [num(int(rng.integers(1, 8)))], lambda: [f"{num(1)}.{num(1)}"], lambda: [f"{num(1)}.{num(2)}.{num(1)}"],
        lambda: [f"{num(2)}:{num(2)}"], lambda: [f"{num(2)}%"], lambda: [num(int(rng.integers(8, 13)))], lambda: [num(int(rng.integers(20, 30)))], lambda: [f"@{letters(3, 8)}"],
        lambda: [letters(2, 5) + num(3)], lambda: [f"{num(3)},{num(3)}"], lambda: [f"${num(3)}.{num(2)}"], lambda: [f"{num(2)}-{num(2)}"], lambda: ["ISBN", f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}"],
        lambda: [f"{num(2)}/{num(2)}/{num(4)}"], lambda: [num(4), num(4)], lambda: [num(3), num(3), num(3)], lambda: [f"({num(4)})"], lambda: [f"({num(1)})", f"{num(2)}-{num(2)}"],
    ]
    out = []
    for k in range(rows):
        words, tags = [], []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(1, 5))):
                words.append(letters(1, 9)), tags.append("O")
            if k % 2:
                own, kind = pick(entity)()
                tags += [f"B-{kind}"] + [f"I-{kind}"] * (len(own) - 1)
            else:
                own = pick(other)()
                tags += ["O"] * len(own)
            words += own
            if rng.random() < 0.3:
                words[-1] += pick(".,")
        words.append(letters(1, 9)), tags.append("O")
        out.append((words, tags))
    return spark.createDataFrame(out, "words array<string>, tags array<string>")


def train(labelled: DataFrame) -> Field:
    """Fits the field to at most LABELLED_ROWS rows of a labelled table."""
    rows = labelled.select("words", "tags").limit(LABELLED_ROWS).collect()
    return Field().fit([(list(r["words"]), list(r["tags"])) for r in rows if r["words"] and r["tags"]])


def runs_of(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words that hold a digit or an @: their starts and ends."""
    words: list[tuple[int, int]] = []
    end = 0
    m = MARKED.search(text)
    while m:
        a = m.start()
        while a > end and not text[a - 1].isspace():
            a -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        words.append((a, end))
        m = MARKED.search(text, end)
    runs: list[list[tuple[int, int]]] = []
    for a, b in words:
        if runs and not text[runs[-1][-1][1] : a].strip():
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
    return runs


def beside(text: str, a: int, b: int) -> tuple[str, str]:
    """The words before a and after b."""
    n = 60
    while len(left := text[max(0, a - n) : a].split()) < 2 and n < a:  # the last of several is whole
        n *= 2
    return left[-1] if left else "", NEXT.match(text, b).group(1)


def fits(kind: str, text: str) -> bool:
    n = len(digits_in(text))
    if kind == "email":
        return text.count("@") == 1
    if kind == "ip":
        return len(parts := text.split(".")) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= n <= 19 and DIALLED.fullmatch(text) is not None and luhn(digits_in(text))
    return 10 <= n <= 15 and DIALLED.fullmatch(text) is not None


def starts_and_ends(spans: list[Span]) -> tuple[list[int], list[int]]:
    """The spans' starts in order, and for each the largest end so far."""
    own = sorted((s, e) for _, s, e in spans)
    return [s for s, _ in own], list(accumulate((e for _, e in own), max))


def overlaps(a: int, b: int, spans: tuple[list[int], list[int]]) -> bool:
    """Whether one of the spans overlaps a to b: of those that start before b one ends after a."""
    k = bisect_left(spans[0], b)
    return k > 0 and spans[1][k - 1] > a


def found_spans(texts: list[str], field: Field, kept: dict[tuple[str, str, str], np.ndarray]) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans and all spans, both by kind and start."""
    base = [base_spans(t) for t in texts]
    runs, emissions = [], []
    for k, t in enumerate(texts):
        for run in runs_of(t):
            own = []
            for a, b in run:
                before, after = beside(t, a, b)
                if b - a > LONG:
                    own.append(field.emission(features(t[a:b], before, after)))
                    continue
                key = (shape(before.strip(EDGES), 8), t[a:b], shape(after.strip(EDGES), 8))
                if (e := kept.get(key)) is None:
                    if len(kept) > 200_000:
                        kept.clear()
                    e = kept[key] = field.emission(features(t[a:b], before, after))
                own.append(e)
            runs.append((k, run))
            emissions.append(np.array(own))
    added: dict[int, list[Span]] = defaultdict(list)
    taken: dict[int, tuple[list[int], list[int]]] = {}
    for (k, run), tags in zip(runs, field.decode(emissions), strict=True):
        j = 0
        while j < len(run):
            tag = TAGS[tags[j]]
            if tag[0] != "B":
                j += 1
                continue
            last = j
            while last + 1 < len(run) and TAGS[tags[last + 1]] == "I" + tag[1:]:
                last += 1
            a, b = run[j][0], run[last][1]
            j = last + 1
            while a < b and texts[k][a] in EDGES:
                a += 1
            while a < b and texts[k][b - 1] in EDGES:
                b -= 1
            if fits(tag[2:], texts[k][a:b]) and not overlaps(a, b, taken.setdefault(k, starts_and_ends(base[k]))):
                added[k].append((tag[2:], a, b))
    order = lambda s: (KINDS.index(s[0]), s[1])
    return [(b, sorted(b + added[k], key=order) if k in added else b) for k, b in enumerate(base)]


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) of the patterns alone and of all that was found."""
    span = "array<struct<kind:string,start:int,end:int>>"
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                out = found_spans(texts_of(batch.column(1)), field, kept)
                cell = lambda spans: [{"kind": x, "start": a, "end": b} for x, a, b in spans]
                yield pa.record_batch({"doc_id": batch.column(0), "base": pa.array([cell(b) for b, _ in out], kind_of), "spans": pa.array([cell(s) for _, s in out], kind_of)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {span}, spans {span}")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first and longest counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])
