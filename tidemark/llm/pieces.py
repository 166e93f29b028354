"""SentencePiece encoding and decoding (BPE models), exactly as the library does it.

Encoding is by backtracking. An Aho-Corasick automaton over the pieces gives the
longest piece at a position, once the encoding comes to it. A piece may follow another if
merging the two pieces' characters again, in the order of the model's scores, leaves just these
two; a piece that doesn't fit gives way to the next shorter one (which one that is in the end is
kept for each piece and the one before), and a bitfield
marks positions from which no encoding can go on. Every sequence in which all
neighbours are compatible is the one that merging the whole text would give.

A piece of such a model holds the space symbol at its start only, so no merge
crosses over a space symbol, and texts are encoded word by word.
Words repeat; a task keeps the encodings of those it has met, and gives them back at
its end, as the worker lives on beside the next stages.

Nulls: a null text is the empty text, which has no ids. Empty tables give empty
tables. Equal rows give equal rows. A text of any length is one row's work,
linear in its length. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import by_worker, freed, sliced, small_batches, texts_of

SPACE = "▁"
RUNS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: Characters up to which merging goes without a heap.
SHORT = 32
#: Where the automaton finds nothing: an end that no piece has.
NO_MATCH = (-9, 0)
#: How many words' encodings a task keeps at once, and how many stay, the first it met, where more come.
KEPT_WORDS, KEPT_FIRST = 400_000, 160_000


class PieceModel:
    """A SentencePiece BPE model: pieces, scores and kinds, without the library at run time."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], options: dict):
        self.pieces, self.scores, self.kinds, self.options = pieces, scores, kinds, options

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Reads the model file on the driver. Raises if its normalisation isn't the plain one."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        kind = lambda i: "unknown" if p.is_unknown(i) else "control" if p.is_control(i) else "byte" if p.is_byte(i) else "unused" if p.is_unused(i) else "normal"
        if p.decode(p.encode("a ﬁ　 b")) != "a ﬁ　 b":
            raise ValueError("only models with identity normalisation are supported")
        pieces = [p.id_to_piece(i) for i in range(n)]
        if any(SPACE in x.lstrip(SPACE) or "\n" in x for x in pieces):
            raise ValueError("only models whose pieces hold the space symbol at their start alone are supported")
        return cls(pieces, [p.get_score(i) for i in range(n)], [kind(i) for i in range(n)], {})


class Encoder:
    """Encodes and decodes with a PieceModel."""

    def __init__(self, model: PieceModel):
        import ahocorasick

        self.model = model
        self.of = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == "normal"}
        self.byte = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == "byte"}
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown = model.kinds.index("unknown")
        #: By a piece and the one before: the longest that fits of the piece and its shorter ones, -1 if none does.
        self.fitting: dict[int, int] = {}
        self.longest = ahocorasick.Automaton()
        for p, i in self.of.items():
            self.longest.add_word(p, i)
        self.longest.make_automaton()
        #: By piece its halves(); whether the order of merges is that of scores alone (but for runs of space symbols).
        self.parts: dict[str, tuple[str, str] | None] = {}
        scores = [model.scores[i] for p, i in self.of.items() if SPACE * 2 not in p]
        self.ordered = len(set(scores)) == len(scores)
        self.single = frozenset(p for p in self.of if len(p) == 1)
        self.size = [len(p) if k == "normal" else 0 for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.most = max(self.size)
        #: By piece the longest one of those that it starts with, -1 if there is none.
        self.shorter = [next((self.of[p[:k]] for k in range(n - 1, 0, -1) if p[:k] in self.of), -1) for p, n in zip(model.pieces, self.size, strict=True)]
        self.split = self._boundaries()
        #: What a piece reads as, where decoding it needs no more than that.
        self.plain = [p.replace(SPACE, " ") if k == "normal" else "" for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.score = {p: model.scores[i] for p, i in self.of.items()}
        self.digits = [str(i) for i in range(len(model.pieces))]
        #: By word its ids, joined by commas; and the text that these decode to, where that isn't the word.
        self.words: dict[str, str] = {}
        self.unlike: dict[str, str] = {}

    def emptied(self) -> None:
        """Gives back what was kept of words."""
        self.words.clear()
        self.unlike.clear()
        self.fitting.clear()
        freed()

    def _boundaries(self) -> re.Pattern:
        """Splits a word between a letter and those marks that follow no letter in any piece: no piece spans these cuts."""
        after = {b for p in self.of for a, b in zip(p, p[1:], strict=False) if re.match(r"[^\W\d_]", a)}
        marks = "".join(re.escape(c) for c in ".,;:!?|)\"" if c not in after)
        return re.compile(f"(?<=[^\\W\\d_])(?=[{marks}])" if marks else "(?!)")

    def merged(self, text: str) -> list[str]:
        """Merges characters in the order of scores, the leftmost first: the definition."""
        if len(text) <= SHORT:
            return self.merged_short(text)
        part: list[str | None] = list(text)
        after, before = [*range(1, len(part)), -1], [-1, *range(len(part) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if a >= 0 and b >= 0 and (i := self.of.get(both := part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.model.scores[i], a, b, both))

        for a in range(len(part) - 1):
            offer(a)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if part[a] is None or part[b] is None or after[a] != b or part[a] + part[b] != both:
                continue
            part[a], part[b] = both, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        return [x for x in part if x is not None]

    def merged_short(self, text: str, least: int = 1) -> list[str]:
        """The same, by looking at all neighbours each time: less work than a heap for a few characters. Ends at `least` parts."""
        part, score = list(text), self.score.get
        both = [score(a + b, -math.inf) for a, b in pairwise(part)]
        while len(both) >= least and (most := max(both)) > -math.inf:
            at = both.index(most)
            part[at] += part.pop(at + 1)
            both.pop(at)
            if at < len(both):
                both[at] = score(part[at] + part[at + 1], -math.inf)
            if at:
                both[at - 1] = score(part[at - 1] + part[at], -math.inf)
        return part

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge is the last one when a piece's characters are merged; None: these don't give the piece."""
        if piece not in self.parts:
            parts = self.merged_short(piece, 2)
            self.parts[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.parts[piece]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters gives these two; left -1: whether right's give right.

        Merges are undone from the last one on. The two fit if no merge over the cut between them
        comes before the one that was just undone.
        """
        pieces = [self.model.pieces[i] for i in (left, right) if i >= 0]
        both = "".join(pieces)
        if left < 0 or not self.ordered or SPACE * 2 in both:
            return self.merged(both) == pieces
        a, b = pieces
        if both in self.of or (len(a) > 1 and not self.halves(a)) or (len(b) > 1 and not self.halves(b)):
            return False
        score = self.score.get
        while True:
            of_a = score(a) if len(a) > 1 else math.inf
            of_b = score(b) if len(b) > 1 else math.inf
            if of_a < of_b:
                a = self.halves(a)[1]
                if score(a + b, -math.inf) > of_a:
                    return False
            elif of_b < math.inf:  # of equal merges the leftmost comes first
                b = self.halves(b)[0]
                if score(a + b, -math.inf) >= of_b:
                    return False
            else:
                return True

    def first_fit(self, left: int, right: int) -> int:
        """The longest that fits after left of right and its shorter pieces, -1 if none does; keeps it for all that were tried."""
        if len(self.fitting) > 500_000:
            self.fitting.clear()
        tried = []
        while right >= 0:
            tried.append(right)
            if self.fits(left, right):
                break
            right = self.shorter[right]
        for i in tried:
            self.fitting[left << 24 | i] = right
        return right

    def longest_at(self, word: str, at: int) -> int:
        """The longest piece that starts at a position of a word, -1 if none does."""
        ends = range(min(len(word), at + self.most), at, -1)
        return next((self.of[word[at:end]] for end in ends if word[at:end] in self.of), -1)

    def word_ids(self, word: str) -> list[int]:
        """The ids of a word. Characters that no piece covers become byte pieces, and nothing merges across them."""
        n = len(word)
        if not self.single.issuperset(word):
            bare = [k for k in range(n) if word[k] not in self.single and self.longest_at(word, k) < 0]
            if bare:
                out: list[int] = []
                at = 0
                for k in [*bare, n]:
                    if at < k:
                        out += self.word_ids(word[at:k])
                    if k < n:
                        out += [self.byte[b] for b in word[k].encode()] if self.byte else [self.unknown]
                    at = k + 1
                return out
        fitting, matches, size, shorter = self.fitting.get, self.longest.iter_long, self.size, self.shorter
        failed: bytearray | None = None
        path: list[int] = []
        at, last, i = 0, -1, -1  # i: the longest piece to try, -1: not looked up yet
        while True:
            if i < 0:
                end, i = next(matches(word, at), NO_MATCH)
                if end - at + 1 != size[i]:
                    i = self.longest_at(word, at)
            fit = fitting(last << 24 | i)
            if fit is None:
                fit = self.first_fit(last, i)
            if fit >= 0:
                end = at + size[fit]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    path.append(fit)
                    if end == n:
                        return path
                    at, last, i = end, fit, -1
                    continue
                i = shorter[fit]
            else:
                i = -1
            while i < 0:  # no piece goes on from here: give back the last one
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                if not path:
                    return [self.of[p] for p in self.merged(word)]
                fit = path.pop()
                at -= size[fit]
                last = path[-1] if path else -1
                i = shorter[fit]

    def encode(self, text: str) -> list[int]:
        return [int(x) for ids in self.read(text)[0] for x in ids.split(",")]

    def words_of(self, text: str) -> list[str]:
        """Cuts before each run of space symbols and around line ends: no piece of the model spans these."""
        text = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in text:
            return RUNS.findall(text)
        text = text.replace(SPACE, " " + SPACE)[1:].replace("\n", " \n ")
        words = text.split(" ")
        return [w for w in words if w] if "  " in text or text[-1] == " " else words

    def read(self, text: str) -> tuple[list[str], str]:
        """For each word of the text its ids, joined by commas; and the text that all ids decode to."""
        if not text:
            return [], ""
        words = self.words_of(text)
        kept, unlike = self.words, self.unlike
        if len(kept) > KEPT_WORDS:  # frequent words are among the first
            first = list(islice(kept.items(), KEPT_FIRST))
            kept.clear()
            kept.update(first)
        found, new = kept.get, self.new_word
        ids = [found(w) or new(w) for w in words]
        if unlike:
            words = [unlike.get(w, w) for w in words]
            for w in [w for w in unlike if w not in kept]:
                del unlike[w]
        return ids, "".join(words).replace(SPACE, " ")[1:]

    def new_word(self, word: str) -> str:
        """Encodes the parts between cuts and decodes their ids; keeps these and the word."""
        kept, out, texts = self.words, [], []
        parts = [word] if word[1:].isalnum() else self.split.split(word)
        for part in parts:
            if (got := kept.get(part)) is None:
                ids = self.word_ids(part)
                read = [self.plain[i] for i in ids]
                if "" in read:  # decode() takes the space off the start of a text
                    text = " " * read[0].startswith(" ") + self.decode(ids)
                else:
                    text = "".join(read)
                got = ",".join([self.digits[i] for i in ids])
                if text != part.replace(SPACE, " "):
                    self.unlike[part] = text
                if len(part) <= 64:
                    kept[part] = got
            out.append(got)
            texts.append(self.unlike.get(part, part))
        if len(parts) > 1:
            got = ",".join(out)
            if texts != parts:
                self.unlike[word] = "".join(texts)
            if len(word) <= 64:
                kept[word] = got
        return got

    def decode(self, ids: Iterable[int]) -> str:
        """The text of any ids: control pieces vanish, byte pieces become UTF-8 (what isn't valid: U+FFFD)."""
        out: list[str] = []
        held = bytearray()
        started = False  # whether the space put before the text has been taken off

        def flush() -> None:
            if held:
                out.append(utf8(bytes(held)))
                held.clear()

        for i in ids:
            kind = self.model.kinds[i]
            if kind == "byte":
                held.append(self.value[i])
                continue
            flush()
            if kind == "control":
                continue
            if kind == "unknown":
                out.append(" ⁇ ")
                continue
            piece = self.model.pieces[i]
            if not started and not any(out) and piece.startswith(SPACE):
                piece, started = piece[1:], True
            out.append(piece.replace(SPACE, " "))
        flush()
        return "".join(out)


def utf8(data: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that isn't part of a valid character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[k : k + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            k += size
        return "".join(out)


def _encoder(model: PieceModel, name: str) -> Encoder:
    return by_worker(f"pieces:{name}", lambda: Encoder(model))


def encode_documents(docs: DataFrame, model_path: str, keep: bool = False) -> DataFrame:
    """doc_id, ids array<int>, decoded string: each whole text encoded, and its ids decoded again.

    keep: instead of decoded, same boolean, whether it is the text (a literal space symbol reads as a space).
    """
    small_batches(docs.sparkSession)
    model = PieceModel.load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model, model_path)
        for batch in sliced(batches, texts=(1,)):
            joined, decoded = [], []
            for text in texts_of(batch.column(1)):
                ids, read = enc.read(text)
                joined.append(",".join(ids))
                decoded.append(read)
            ends = np.cumsum([0] + [x.count(",") + 1 if x else 0 for x in joined])
            flat = ",".join([x for x in joined if x])
            ids = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.fromstring(flat, np.int32, sep=",") if flat else np.empty(0, np.int32)))
            last = {"same": pa.array([d == t for d, t in zip(decoded, texts_of(batch.column(1)), strict=True)], pa.bool_())} if keep else {"decoded": pa.array(decoded, pa.string())}
            yield pa.record_batch({"doc_id": batch.column(0), "ids": ids.cast(pa.list_(pa.int32())), **last})
        enc.emptied()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, {'same boolean' if keep else 'decoded string'}")


def encoding_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the same encoding, without the ids leaving the worker."""
    small_batches(docs.sparkSession)
    model = PieceModel.load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model, model_path)
        for batch in sliced(batches, 1024, (1,)):
            n, ids, decoded = [], [], []
            for text in texts_of(batch.column(1)):
                words, read = enc.read(text)
                joined = ",".join(words)
                n.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(read.encode()).hexdigest())
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})
        enc.emptied()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
