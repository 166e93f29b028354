"""Near-duplicate lines over a corpus, by MinHash; one line of each component stays.

Lines are compared without case and with runs of white space as one space; blank
ones take no part and stay. A line is the set of its character shingles (a shorter
line is its own shingle). Signatures come from one permutation, cut into bins, whose
empty bins borrow from others at random; bands of them make buckets. In a bucket
each line is first held against the smallest, by exact Jaccard similarity; where
that fails for some, the bucket is open, and these are held against all of its other
lines, in cells of bounded size, each until it meets one that is like the smallest.
So a bucket of near copies costs a comparison a line and gives a star of links, and
only lines that fail add to it. Distributed union-find joins the links; of each
component the first occurrence (smallest doc_id, then line) stays.

Equal lines count once: their hash stands for them, and text moves only for lines
that share a bucket, which a bit table of fixed size (`bits`) tells apart on the
way; if it fills up, more text moves and the result is the same. Which buckets hold
two lines is told from sixteen bytes a line and bucket, the bucket and the line's
hash; a task sends at most two lines of a bucket.

Nulls: a null text has no lines; a document without a doc_id takes no part and
stays as it is. Rows that repeat a doc_id are one document and get the same lines.
A text whose lines all go becomes empty. Empty tables give empty tables. Other
columns are kept, but that n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_worker, components, forest, removed, sliced, small_batches, texts_of, unused, written

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 16, 6
#: Lines that meet in a cell of an open bucket, and of these so many that a line meets at a time.
CELL, TURN = 512, 32
#: Characters that are hashed at once, and shingles that are looked up at once.
CHARACTERS, AT_ONCE = 1 << 16, 1 << 18
#: Bins of a line's shingles, whose counts bound what two lines have in common, and pairs bounded at once.
BINS, BOUNDED = 2048, 256
#: Rounds of borrowing that empty bins go through together, by the first of each group, and bins that do so at once.
ROUNDS, HOLES = (0, 1, 3, 8), 1 << 13
#: The bits of a hash that make a bucket's key.
KEY = -(1 << 20)
#: Bucket entries that a task holds before it sends them on.
HELD = 1 << 18
#: Bits of the table that tells which lines share a bucket.
BITS = 1 << 25
DOCUMENTS, PAIRS = 128, 1024
SEEN = 500_000
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x01000193)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def line_hash(line: str) -> int:
    """A signed 64-bit hash of a normal line."""
    h = xxhash.xxh64_intdigest(line, 1)
    return h - (1 << 64) if h >> 63 else h


#: White space besides the space and the line break.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
ASCII_SPACES = "".join(c for c in SPACES if c < "\x80")


def normal_lines(text: str) -> list[str]:
    """normal() of each line; in one step where there is no white space but single spaces inside of lines."""
    text = text.lower()
    if not (
        any(c in text for c in (ASCII_SPACES if text.isascii() else SPACES))
        or "  " in text or " \n" in text or "\n " in text or text.startswith(" ") or text.endswith(" ")
    ):
        return text.split("\n")
    return [" ".join(x.split()) for x in text.split("\n")]


def shingle_set(line: str, size: int = SHINGLE) -> frozenset[str]:
    return frozenset(line[k : k + size] for k in range(max(1, len(line) - size + 1)))


def signatures(lines: list[str], bins: int, size: int = SHINGLE) -> np.ndarray:
    """For each line the smallest hash in each bin; an empty bin has that of another one, drawn at random."""
    padded = [x if len(x) >= size else x + "\x00" * (size - len(x)) for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(x) for x in padded])
    h = codes[: len(codes) - size + 1].copy()
    for k in range(1, size):
        h *= BASE
        h += codes[k : len(codes) - size + 1 + k]
    h = h * MIX
    at = np.repeat(np.arange(0, len(lines) * bins, bins), lengths)[: len(h)]
    at += ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).view(np.int64)
    over = np.cumsum(lengths)[:-1]
    for k in range(1, size):  # shingles that run over a line's end go to a bin of no line
        at[over - k] = len(lines) * bins
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(lines) * bins + 1, empty, np.uint64)
    h ^= h >> np.uint64(29)
    h *= MIX
    h >>= np.uint64(8)
    np.minimum.at(out, at, h)
    own = out[:-1]
    holes = np.flatnonzero(own == empty)
    if len(holes):
        first, steps = own.copy(), borrowings(bins)
        for k, last in zip(ROUNDS, [*ROUNDS[1:], len(steps)], strict=True):
            # a bin takes the first that isn't empty of those that it borrows from in some rounds
            left = []
            for at in range(0, len(holes), HOLES):
                hole = holes[at : at + HOLES]
                got = first.take(steps[k:last].take(hole % bins, 1) + hole)
                if last > k + 1:
                    got = got[(got != empty).argmax(0), np.arange(len(hole))]
                else:
                    got = got[0]
                own[hole] = got
                left.append(hole[got == empty])
            holes = np.concatenate(left or [holes])
        if len(holes):
            own[holes] = first.reshape(-1, bins).min(1)[holes // bins]
    return own.reshape(-1, bins)


def borrowings(bins: int) -> np.ndarray:
    """For each round and bin how far away the bin is that it borrows from."""

    def drawn() -> np.ndarray:
        rng = np.random.default_rng(11)
        return np.stack([rng.integers(0, bins, bins) for _ in range(48)]) - np.arange(bins)

    return by_worker(f"borrowings:{bins}", drawn)


def parted(lines: list[str]) -> Iterator[list[str]]:
    """The lines in parts of about CHARACTERS, so that arrays stay small; a longer line is a part of its own."""
    part, held = [], 0
    for x in lines:
        if held and held + len(x) > CHARACTERS:
            yield part
            part, held = [], 0
        part.append(x)
        held += len(x)
    if part:
        yield part


def band_keys(lines: list[str], bands: int, rows: int, size: int = SHINGLE) -> np.ndarray:
    """Bucket keys by line and band."""
    out = []
    for part in parted(lines):
        sig = signatures(part, bands * rows, size).reshape(len(part), bands, rows)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * MIX, sig.shape[:2]).copy()
        for k in range(rows):
            key = (key ^ sig[:, :, k]) * MIX
            key ^= key >> np.uint64(31)
        out.append(key.view(np.int64) & KEY)
    return np.concatenate(out)


class ShingleSets:
    """The shingle sets of some lines as one sorted array, for exact similarities of many pairs at once."""

    def __init__(self, lines: list[str], size: int = SHINGLE):
        # no valid text holds the character that fills up short lines
        lines = [x if len(x) >= size else x + "\ud800" * (size - len(x)) for x in lines]
        self.bits, self.room, self.number = 7, 62 - len(lines).bit_length(), None
        if not all(map(str.isascii, lines)):
            there = np.zeros(0x110000, bool)
            for part in parted(lines):
                there[np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)] = True
            alphabet = np.flatnonzero(there)
            self.number = np.zeros(int(alphabet[-1]) + 1, np.int64)
            self.number[alphabet] = np.arange(len(alphabet))
            self.bits = len(alphabet).bit_length()
        # a large alphabet, whose shingles are numbered on the way, takes all lines at once
        parts = list(parted(lines)) if size * self.bits <= self.room else [lines]
        firsts = np.cumsum([0] + [len(x) for x in parts])
        self.width = 0
        every = [self.coded(x, first, size) for x, first in zip(parts, firsts.tolist(), strict=False)]
        self.every = np.concatenate(every) if every else np.empty(0, np.int64)
        self.start = np.searchsorted(self.every, np.arange(len(lines) + 1) << self.width)
        self.count = np.diff(self.start)
        #: Made once more shingles are asked for than there are.
        self.bins: np.ndarray | None = None
        self.asked = 0

    def coded(self, lines: list[str], first: int, size: int) -> np.ndarray:
        """The distinct shingles of some lines, each with its line's number above it, sorted. first: the first line's number."""
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(x) for x in lines])
        letters = codes.astype(np.int64) if self.number is None else self.number[codes]
        m = len(letters) - size + 1
        code, width = letters[:m], self.bits
        for k in range(1, size):
            if width + self.bits > self.room:  # the parts met so far are numbered anew
                met, code = np.unique(code, return_inverse=True)
                width = len(met).bit_length()
            code = code << self.bits
            code |= letters[k : m + k]
            width += self.bits
        self.width = width
        code |= np.repeat(np.arange(first, first + len(lines)) << width, lengths)[:m]
        over = np.cumsum(lengths)[:-1]
        for k in range(1, size):  # those that run over a line's end: that line's first shingle once more
            code[over - k] = code[over - lengths[:-1]]
        code.sort()
        new = np.ones(m, bool)
        new[1:] = code[1:] != code[:-1]
        return code[new]

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many shingles lines a[k] and b[k] have in common at most: of each bin as many as the line with fewer has."""
        if self.bins is None:
            code = (self.every & ((1 << self.width) - 1)).view(np.uint64) * MIX
            place = (self.every >> self.width) * BINS + (code >> np.uint64(32)).view(np.int64) * BINS // (1 << 32)
            bins = np.bincount(place, minlength=len(self.count) * BINS).reshape(-1, BINS)
            self.bins = bins.astype(np.min_scalar_type(bins.max(initial=0)))
        parts = [np.minimum(self.bins[a[k : k + BOUNDED]], self.bins[b[k : k + BOUNDED]]).sum(1, np.int64) for k in range(0, len(a), BOUNDED)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def similar(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Whether lines a[k] and b[k] have a Jaccard similarity of `least` or more."""
        small, large = np.where(self.count[a] <= self.count[b], a, b), np.where(self.count[a] <= self.count[b], b, a)
        out = np.zeros(len(a), bool)
        near = np.flatnonzero(self.count[small] >= least * self.count[large])
        self.asked += int(self.count[small[near]].sum())
        if self.asked > len(self.every):
            most = self.bound(small[near], large[near])
            near = near[most >= least * (self.count[small[near]] + self.count[large[near]] - most)]
        ends = np.cumsum(self.count[small[near]])
        k = 0
        while k < len(near):
            last = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + AT_ONCE)))
            own = near[k:last]
            n = self.count[small[own]]
            pair = np.repeat(np.arange(len(own)), n)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + self.start[small[own]][pair]
            want = (self.every[at] & ((1 << self.width) - 1)) | large[own][pair] << self.width
            place = np.minimum(np.searchsorted(self.every, want), len(self.every) - 1)
            both = np.bincount(pair[self.every[place] == want], minlength=len(own))
            out[own] = both >= least * (n + self.count[large[own]] - both)
            k = last
        return out


def _lines(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, line, h of each line that isn't blank; keys: its buckets, eight bytes each, none where the task has just given them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches, DOCUMENTS, (1,)):
            at, numbers, hashes, new, given = [], [], [], [], []
            for k, text in enumerate(texts_of(batch.column(1))):
                for n, own in enumerate(normal_lines(text)):
                    if own:
                        h = line_hash(own)
                        at.append(k), numbers.append(n), hashes.append(h), given.append(h not in seen)
                        if given[-1]:
                            seen.add(h)
                            new.append(own)
            keys = band_keys(new, bands, rows).ravel() if new else np.empty(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(np.array(given, np.int32) * (8 * bands))]).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(given), [None, pa.py_buffer(ends), pa.py_buffer(keys)])
            if len(seen) > SEEN:
                seen.clear()
            yield pa.record_batch({"doc_id": batch.column(0).take(pa.array(at, pa.int32())), "line": pa.array(numbers, pa.int32()), "h": pa.array(hashes, pa.int64()), "keys": blobs})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, line int, h long, keys binary")


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and lines of rows h, keys."""
    h, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    ends = np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1, 4 * keys.offset) if len(keys) else np.zeros(1, np.int32)
    n = int(ends[-1] - ends[0])
    flat = np.frombuffer(keys.buffers()[2], np.int64, n // 8, int(ends[0])) if n else np.empty(0, np.int64)
    return flat, np.repeat(h, np.diff(ends) // 8)


def _two_of_each(entries: np.ndarray) -> np.ndarray:
    """Rows of bucket and line, sorted by bucket: of each bucket the smallest line and, if there is another, the largest.

    A bucket's key leaves its low bits free, which hold the row's number while keys are sorted.
    """
    parts = []
    for k in range(0, len(entries), -KEY):
        part = entries[k : k - KEY]
        own = np.sort(part[:, 0].view(np.uint64) | np.arange(len(part), dtype=np.uint64))
        order = (own & np.uint64(~KEY)).view(np.int64)
        keys, h = own & np.uint64(KEY & (1 << 64) - 1), part[:, 1][order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        low, high = np.minimum.reduceat(h, first), np.maximum.reduceat(h, first)
        two = np.repeat(first, 1 + (low != high))
        out = np.stack([keys[two].view(np.int64), np.repeat(low, 1 + (low != high))], 1)
        second = np.flatnonzero(np.concatenate([[False], two[1:] == two[:-1]]))
        out[second, 1] = high[low != high]
        parts.append(out)
    if len(parts) == 1:
        return parts[0]
    both = np.concatenate(parts)
    if len(both) <= -KEY:
        return _two_of_each(both)
    both = both[np.lexsort((both[:, 1], both[:, 0].view(np.uint64)))]
    edge = np.flatnonzero(np.concatenate([[True], both[1:, 0] != both[:-1, 0], [True]]))
    return both[np.unique(np.concatenate([edge[:-1], edge[1:] - 1]))]


def _shared(lines: DataFrame) -> DataFrame:
    """key and lead, the smallest line, of the buckets of more than one line.

    Entries travel packed, a block of bytes for each part and task. A part is a range of keys.
    """
    tasks = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = 4 * tasks  # several for a task, which they are dealt to by hash

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            own = _two_of_each(np.concatenate(held))
            held.clear()
            part = ((own[:, 0].view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(part, np.arange(parts + 1))
            return pa.record_batch({"part": pa.array(range(parts), pa.int32()), "block": pa.array([own[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())})

        for batch in batches:
            flat, h = _entries(batch)
            if len(flat):
                held.append(np.stack([flat, h], 1))
            if sum(map(len, held)) > HELD:
                yield out()
        if held:
            yield out()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = defaultdict(list)
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held[part]
                own.append(np.frombuffer(block, np.int64).reshape(-1, 2))
                if sum(map(len, own)) > 2 * HELD:
                    held[part] = [_two_of_each(np.concatenate(own))]
        for part in sorted(held):
            if len(own := np.concatenate(held.pop(part))):
                own = _two_of_each(own)
                own = own[np.flatnonzero(own[1:, 0] == own[:-1, 0])]  # the smaller one of two
                yield pa.record_batch({"key": pa.array(own[:, 0], pa.int64()), "lead": pa.array(own[:, 1], pa.int64())})

    blocks = lines.select("h", "keys").mapInArrow(packed, "part int, block binary")
    return blocks.repartition(tasks, "part").mapInArrow(met, "key long, lead long")


def _members(lines: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """key, h, lead: the lines of shared buckets."""
    sent = lines.sparkSession.sparkContext.broadcast(_bit_table(shared.select(F.shiftright("key", 20).alias("h")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            flat, h = _entries(batch)
            place = (flat >> 20) % bits
            hit = (table[place >> 5] >> (place & 31).astype(np.uint32) & 1).astype(bool)
            yield pa.record_batch({"key": pa.array(flat[hit], pa.int64()), "h": pa.array(h[hit], pa.int64())})

    found = lines.select("h", "keys").mapInArrow(run, "key long, h long")
    return found.distinct().join(shared, "key")


def _bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash (column h); as many rows come to the driver as the table has words at most."""
    place = F.pmod("h", F.lit(bits))
    words = hashes.select(F.shiftright(place, 5).alias("word"), F.expr("shiftleft(1L, cast(pmod(h, 32) as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().astype(np.uint32)
    return out


def _texts(docs: DataFrame, hashes: DataFrame, bits: int) -> DataFrame:
    """h and text, once each, of the lines with the given hashes."""
    sent = docs.sparkSession.sparkContext.broadcast(_bit_table(hashes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = sent.value, set()
        for batch in sliced(batches, 512, (0,)):
            own, texts = [], []
            lines = [line for text in texts_of(batch.column(0)) for line in normal_lines(text) if line]
            hashes = [line_hash(line) for line in lines]
            place = np.array(hashes, np.int64) % bits
            for k in np.flatnonzero(table[place >> 5] >> (place & 31).astype(np.uint32) & 1).tolist():
                if (h := hashes[k]) not in seen:
                    seen.add(h)
                    own.append(h), texts.append(lines[k])
            if len(seen) > SEEN:
                seen.clear()
            yield pa.record_batch({"h": pa.array(own, pa.int64()), "text": pa.array(texts, pa.string())})

    found = docs.where("doc_id is not null").select("text").mapInArrow(run, "h long, text string")
    return found.join(hashes, "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))


def _numbered(column: pa.Array) -> tuple[np.ndarray, list]:
    """For each row the number of its value, and the distinct values."""
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _stars(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """u, v, whether they are similar."""
    for batch in sliced(batches, PAIRS, (2, 3)):
        both, texts = _numbered(pa.concat_arrays([batch.column(2), batch.column(3)]))
        n = batch.num_rows
        ok = ShingleSets(texts).similar(both[:n], both[n:], least) if n else np.empty(0, bool)
        yield pa.record_batch({"u": batch.column(0), "v": batch.column(1), "ok": pa.array(ok, pa.bool_())})


def _cell_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and cell (key, cell, h, like, failed, text): links of the failed lines to others of the cell.

    like: similar to the bucket's smallest line, or that line itself. Each cell gives a
    spanning forest.
    """
    held: list[pa.RecordBatch] = []
    for batch in sliced(batches, PAIRS, (5,)):
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        key, cell = (rows.column(k).to_numpy() for k in range(2))
        # the last cell may go on in the next batch
        end = int(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))[-1])
        held = rows.slice(end).to_batches()
        if end:
            yield _links_of(rows.slice(0, end), least)
    if held:
        yield _links_of(pa.Table.from_batches(held), least)


def _links_of(rows: pa.Table, least: float) -> pa.RecordBatch:
    """Links of whole cells. The failed lines of each cell meet its other lines in turn, but those of their own component so far."""
    rows = rows.combine_chunks()
    key, cell, h, like, failed = (rows.column(k).to_numpy() for k in range(5))
    # a line that is there as failed and as one of all lines is one member
    of_cell = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
    order = np.lexsort((~failed, h, of_cell))
    of_cell, h, like, failed = of_cell[order], h[order], like[order], failed[order]
    one = np.concatenate([[True], (of_cell[1:] != of_cell[:-1]) | (h[1:] != h[:-1])])
    order, of_cell, h, like, failed = order[one], of_cell[one], h[one], like[one], failed[one]
    number, texts = _numbered(rows.column(5).combine_chunks())
    number = number[order]
    sets = ShingleSets(texts)
    start = np.flatnonzero(np.concatenate([[True], of_cell[1:] != of_cell[:-1]]))
    size = np.diff(np.append(start, len(h)))
    root = np.arange(len(h))
    # like lines are one component from the start
    lead = np.full(len(start), len(h))
    place = np.cumsum(np.concatenate([[0], of_cell[1:] != of_cell[:-1]]))
    np.minimum.at(lead, place[like], np.flatnonzero(like))
    root[like] = lead[place[like]]
    asks = np.flatnonzero(failed)
    turn = np.arange(len(asks)) - np.searchsorted(place[asks], place[asks])
    u, v = [], []
    for t in range(int(turn.max(initial=-1)) + 1):
        ours = asks[turn == t]
        for first in range(0, int(size[place[ours]].max()), TURN):
            n = np.clip(size[place[ours]] - first, 0, TURN)
            a = np.repeat(ours, n)
            b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + start[place[a]] + first
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            ok = sets.similar(number[a], number[b], least)
            if ok.any():
                nodes, low = forest(root[a[ok]], root[b[ok]])
                u.append(h[nodes]), v.append(h[low])
                moved = np.arange(len(h))
                moved[nodes] = low
                root = moved[root]
    none = [np.empty(0, np.int64)]
    return pa.record_batch({"u": pa.array(np.concatenate(u or none), pa.int64()), "v": pa.array(np.concatenate(v or none), pa.int64())})


def line_components(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, least: float = SIMILARITY, cell: int = CELL, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, line, h of each line; h and root of each line hash that has links."""
    small_batches(docs.sparkSession)
    keyed, keyed_path = written(_lines(docs, bands, rows), "keyed", **{"parquet.enable.dictionary": "false"})
    lines, _ = written(keyed.select("doc_id", "line", "h"), "lines")
    shared, shared_path = written(_shared(keyed), "shared")
    members, members_path = written(_members(keyed, shared, bits), "buckets")
    removed(docs.sparkSession, keyed_path, shared_path)
    texts, _ = written(_texts(docs, members.select("h").distinct(), bits), "texts")
    pairs = members.where("h <> lead").select(F.col("h").alias("u"), F.col("lead").alias("v")).distinct()
    a, b = texts.select(F.col("h").alias("u"), F.col("text").alias("a")), texts.select(F.col("h").alias("v"), F.col("text").alias("b"))
    stars, _ = written(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(lambda it: _stars(it, least), "u long, v long, ok boolean"), "stars")
    failed = stars.where("not ok").select(F.col("u").alias("h"), F.col("v").alias("lead"), F.lit(True).alias("failed"))
    marked = members.join(failed, ["h", "lead"], "left").select("key", "h", F.coalesce("failed", F.lit(False)).alias("failed"))
    # open buckets: with a failed line, and more lines than it and the smallest; those with the same lines are one
    sizes = marked.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.count_if("failed").alias("fails"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("sum"))
    sizes = sizes.where("fails > 0 and size > 2").groupBy("size", "fails", "sum").agg(F.min("key").alias("key"))
    inside, inside_path = written(marked.join(sizes.select("key", "size", "fails"), "key"), "open")
    half = max(1, cell // 2)
    blocks = lambda c: F.ceil(F.col(c) / half).cast("int")
    block = lambda c: F.pmod(F.xxhash64("h", F.lit(c)), blocks(c)).cast("int")
    upto = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    # a cell is a block of failed lines against a block of all lines; both kinds of rows go to their block's cells
    ours = inside.where("failed").select("key", "h", F.lit(False).alias("like"), F.lit(True).alias("failed"), F.explode(F.transform(upto("size"), lambda j: block("fails") * blocks("size") + j)).alias("cell"))
    theirs = inside.select("key", "h", (~F.col("failed")).alias("like"), F.lit(False).alias("failed"), F.explode(F.transform(upto("fails"), lambda i: i * blocks("size") + block("size"))).alias("cell"))
    dealt = ours.unionByName(theirs).join(texts, "h").select("key", "cell", "h", "like", "failed", "text")
    links = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(lambda it: _cell_links(it, least), "u long, v long")
    links = stars.where("ok").select("u", "v").unionByName(links)
    roots, _ = components(links, "lines")
    removed(docs.sparkSession, inside_path)
    return lines, roots.select(F.col("node").alias("h"), "root")


def dropped_lines(docs: DataFrame, **options) -> DataFrame:
    """doc_id and gone, the numbers of its lines that repeat an earlier one, in order."""
    lines, roots = line_components(docs, **options)
    # by line hash its first occurrence and whether it has others; then the same by component
    by_hash = lines.groupBy("h").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("n"))
    by_hash = by_hash.join(roots, "h", "left").where("n > 1 or root is not null").select("h", "first", F.coalesce("root", "h").alias("root"))
    # written, so that the join with the lines of a large component is one that adaptive execution splits
    keep, _ = written(by_hash.groupBy("root").agg(F.min("first").alias("keep")), "kept")
    keep = by_hash.join(keep, "root").select("h", "keep")
    gone = lines.join(keep, "h").where((F.col("doc_id") != F.col("keep.doc_id")) | (F.col("line") != F.col("keep.line")))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame, counted: bool = True, **options) -> DataFrame:
    """The rows of docs, all columns, with the text's repeated lines left out.

    counted: with _tm_lines, _tm_kept, how many lines there were and stay; these names
    are reserved, a table that has them must be read with counted=False.
    """
    gone_lines = dropped_lines(docs, **options)
    taken = {c.lower() for c in docs.columns}
    own = [unused(name, taken) for name in ("doc_id_of", "gone", "split", "gaps")]
    gone = gone_lines.toDF(*own[:2])
    rows = docs.join(gone, docs["doc_id"] == gone[own[0]], "left").withColumn(own[2], F.split(docs["text"], "\n", -1))
    # what stays are the runs between the lines that go, in order: linear in the text, however many go
    here = F.filter(own[1], lambda x: x < F.size(own[2]))  # of rows that repeat a doc_id one may be shorter
    edges = F.concat(F.array(F.lit(-1)), here, F.array(F.size(own[2])))
    run = lambda a, k: F.slice(F.col(own[2]), a + 2, F.get(F.col(own[3]), k + 1) - a - 1)
    rows = rows.withColumn(own[3], F.when(F.col(own[1]).isNotNull(), edges))
    kept = F.flatten(F.transform(F.slice(F.col(own[3]), F.lit(1), F.size(own[3]) - 1), run))
    changed = F.col(own[1]).isNotNull()
    text = F.when(changed, F.array_join(kept, "\n")).otherwise(docs["text"])
    out = [text.alias(c) if c == "text" else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    if counted:
        lines = F.coalesce(F.size(own[2]), F.lit(0))
        out += [F.greatest(lines, F.lit(0)).alias("_tm_lines"), (F.greatest(lines, F.lit(0)) - F.when(changed, F.size(here)).otherwise(0)).alias("_tm_kept")]
    return rows.select(*out)
