"""SentencePiece encoding and decoding as a weighted transducer.

Three transducers are compiled from the model file: the normaliser (its character map, which takes
the longest rule at each place; dummy prefix, spaces to U+2581), the pieces (a set of character strings with ids), and the byte fallback (a character
without a piece becomes its UTF-8 bytes).  Their composition with a text is a lattice, whose
shortest path in the tropical semiring is the encoding:

* unigram models weigh a piece by its negated score;
* BPE models weigh each step from piece to piece: 0 where merging the two pieces' characters
  gives the two pieces back, infinity otherwise.  Merging is local, so the one path of weight
  0 is what all merges together give; at every place a single piece can end it.

No piece continues past a character that a U+2581 follows, except in runs of U+2581, so the
lattice falls apart into words, and the path of a word is kept for when it comes again.

Defined results: a null text is an empty text, which has no ids; decoding ignores control
pieces and replaces invalid UTF-8; a U+2581 of the text itself decodes as a space; repeated
rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: kinds of pieces in a model file
UNIGRAM, BPE = 1, 2  # fixed values: kinds of models
MEMO_WORDS, MEMO_PAIRS = 700_000, 500_000
INFINITE = float("inf")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if wire == 2 else (4 if wire == 5 else 8, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """The rules of a model's precompiled character map: at each place the longest rule applies, else a character stays.

    The map is a double array over bytes (a node's unit has the label of the byte that leads to it,
    an offset to its children and a mark of whether one is a value) and the texts that values point to.
    """

    def __init__(self, data: bytes):
        size = int.from_bytes(data[:4], "little")
        units, texts = np.frombuffer(data[4 : 4 + size], "<u4").astype(np.int64), data[4 + size :]
        offsets = (units >> 10) << ((units & (1 << 9)) >> 6)
        labels = units & 0x800000FF
        every = np.arange(1, 256)
        self.rules: dict[str, str] = {}
        open_ = [(0 ^ int(offsets[0]), b"")]
        while open_:
            base, key = open_.pop()
            at = base ^ every
            for byte in every[(at < len(units)) & (labels[np.minimum(at, len(units) - 1)] == every)].tolist():
                node = base ^ byte
                here, found = node ^ int(offsets[node]), key + bytes([byte])
                if units[node] >> 8 & 1:
                    begin = int(units[here]) & 0x7FFFFFFF
                    self.rules[found.decode()] = texts[begin : texts.index(b"\0", begin)].decode()
                open_.append((here, found))
        self.single = {ord(k): v for k, v in self.rules.items() if len(k) == 1}
        self.later = {c for k in self.rules if len(k) > 1 for c in k[1:]}
        self.longest: dict[str, int] = {}
        for k in self.rules:
            self.longest[k[0]] = max(self.longest.get(k[0], 0), len(k))

    def __call__(self, text: str) -> str:
        if self.later.isdisjoint(text):  # no rule of several characters can apply
            return text.translate(self.single)
        out, at = [], 0
        while at < len(text):
            for n in range(self.longest.get(text[at], 0), 0, -1):
                if (found := self.rules.get(text[at : at + n])) is not None and at + n <= len(text):
                    break
            else:
                n, found = 1, text[at]
            out.append(found)
            at += n
        return "".join(out)


class PieceTransducer:
    """The compiled model: ``encode`` gives ids, ``decode`` gives text."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.prefix, self.squeeze, self.map = UNIGRAM, True, True, None
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                rules = dict(_fields(value))
                self.map = CharacterMap(rules[2]) if rules.get(2) else None
                self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model kind {self.kind} is not supported")
        defined = sorted((p for p, _, k in self.pieces if k == DEFINED), key=len, reverse=True)
        if defined and self.kind == UNIGRAM:
            raise ValueError("unigram models with symbols of the user are not supported")
        self.symbols = re.compile("(" + "|".join(map(re.escape, defined)) + ")").split if defined else None
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, DEFINED)}
        self.scores = {p: s for p, s, k in self.pieces if k == NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN), 0)
        self.worst = min(self.scores.values(), default=0.0) - 10
        marks = re.escape("".join(self._marks()))
        self.words = re.compile(f"{SPACE}*[^{SPACE}{marks}]+|{SPACE}*[{marks}]+|{SPACE}+" if marks else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.ranks = {p: k for k, (p, _) in enumerate(sorted(self.scores.items(), key=lambda x: -x[1]))}
        self.latest = len(self.ranks) + 1
        self.heads: dict[str, str] = {}
        self.prefixes: dict[str, bool] = {}
        for p in self.ids:
            for k in range(2, len(p)):
                self.prefixes.setdefault(p[:k], False)
            self.prefixes[p] = True
        surface = [b"" if k in (CONTROL, UNUSED) else bytes([int(p[1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in self.pieces]
        self.lengths = np.array([len(b) for b in surface], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    def _marks(self) -> list[str]:
        """Characters, not letters, that no piece holds next to others but U+2581 before them.

        A text can be cut where a run of them begins or ends, as it can where U+2581 begins.
        """
        marks = {c for p in self.ids for c in p if not c.isalpha() and c != SPACE}
        while True:
            mixed = {c for p in self.ids for x, y in zip(p, p[1:], strict=False) if (x in marks) != (y in marks) and x != SPACE for c in (x, y)} & marks
            if not mixed:
                return sorted(marks)
            marks -= mixed

    def normalise(self, text: str) -> str:
        if self.map:  # symbols of the user stay as they are
            text = "".join(x if k % 2 else self.map(x) for k, x in enumerate(self.symbols(text))) if self.symbols else self.map(text)
        if self.squeeze:
            text = text.strip(" ")
            if "  " in text:
                text = re.sub("  +", " ", text)
        text = text.replace(" ", SPACE)
        return SPACE + text if self.prefix and text else text

    def merged(self, text: str, without: str = "") -> list[str]:
        """Characters merged by descending score of the result, the leftmost first among equals, ``without`` one piece."""
        part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap = [(-self.scores[text[k : k + 2]], k, text[k : k + 2]) for k in range(len(text) - 1) if text[k : k + 2] in self.scores]
        heapq.heapify(heap)
        while heap:
            _, k, joined = heapq.heappop(heap)
            nxt = after[k]
            if joined == without or not part[k] or nxt >= len(part) or part[k] + part[nxt] != joined:
                continue
            part[k], part[nxt], after[k] = joined, "", after[nxt]
            if after[k] < len(part):
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < len(part) and (new := part[left] + part[after[left]]) in self.scores:
                    heapq.heappush(heap, (-self.scores[new], left, new))
        return [p for p in part if p]

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that merge into this one at last, null if merging never makes it."""
        if piece not in self.splits:
            parts = self.merged(piece, piece)
            self.splits[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.splits[piece]

    def stands(self, left: str, right: str) -> bool:
        """Whether the step from one piece to the other has weight 0, that is merging gives both back.

        The merges along the border are undone, the latest first.  The two pieces that then meet
        at the border must not merge before the later ones were made; equal scores merge from the left.
        """
        limit = self.latest
        ranks, splits = self.ranks, self.splits
        while True:
            crossing = ranks.get(left + right)
            if crossing is not None and crossing < limit:
                return False
            a, b = ranks.get(left, -1) if len(left) > 1 else -1, ranks.get(right, -1) if len(right) > 1 else -1
            if a > b:
                limit, left = a, (splits.get(left) or self.last_merge(left))[1]
            elif b >= 0:
                limit, right = b + 1, (splits.get(right) or self.last_merge(right))[0]
            else:
                return True

    def _longest(self, word: str, begin: int) -> str:
        """The longest piece at a place; a single character is always one."""
        prefixes, best = self.prefixes, word[begin]
        for at in range(begin + 2, min(len(word), begin + self.longest) + 1):
            piece = word[begin:at]
            known = prefixes.get(piece)
            if known is None:
                break
            if known:
                best = piece
        if best in self.ids and len(best) > 1 and not self.last_merge(best):
            return self._shorter(best)
        return best

    def _shorter(self, piece: str) -> str:
        """The longest piece that a piece starts with, empty for a character."""
        if piece not in self.heads:
            head = piece[:-1]
            while len(head) > 1 and not (head in self.ids and self.last_merge(head)):
                head = head[:-1]
            self.heads[piece] = head
        return self.heads[piece]

    def _free_path(self, word: str) -> list[str] | None:
        """The path of weight 0, the longest pieces tried first.

        A prefix of the word has one path of weight 0, so a place from which the end was not
        reached is never tried again.
        """
        n, at, out = len(word), 0, []
        dead = [False] * (n + 1)
        pairs = self.pairs
        if len(pairs) >= MEMO_PAIRS:
            pairs.clear()
        piece = self._longest(word, 0)
        while True:
            while piece:
                end = at + len(piece)
                if not dead[end]:
                    if not out:
                        break
                    step = (out[-1], piece)
                    free = pairs.get(step)
                    if free is None:
                        free = pairs[step] = self.stands(*step)
                    if free:
                        break
                piece = self._shorter(piece)
            if piece:
                out.append(piece)
                at = end
                if at == n:
                    return out
                piece = self._longest(word, at)
            elif out:
                dead[at] = True
                piece = out.pop()
                at -= len(piece)
                piece = self._shorter(piece)
            else:
                return None

    def _path(self, word: str) -> list[str]:
        """Pieces of the shortest path through the lattice of a word."""
        n = len(word)
        if self.symbols and self.symbols(word)[1:2] == [word]:
            return [word]
        if self.kind == BPE:
            if word.startswith(SPACE * 2):  # scores of these runs are equal, so merging is not local there
                run = len(word) - len(word.lstrip(SPACE))
                if run > 2 or n == run:
                    return self.merged(word)
            return self._free_path(word) or self.merged(word)
        cost, last = [0.0] + [INFINITE] * n, [""] * (n + 1)
        for at in range(1, n + 1):
            for begin in range(max(0, at - self.longest), at):
                piece = word[begin:at]
                weight = -self.scores[piece] if piece in self.scores else -self.worst if begin == at - 1 else INFINITE
                if cost[begin] + weight < cost[at]:
                    cost[at], last[at] = cost[begin] + weight, piece
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def _ids(self, word: str) -> bytes:
        out: list[int] = []
        for piece in self._path(word):
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit bytes."""
        text = self.normalise(text)
        words = [w for k, x in enumerate(self.symbols(text)) for w in ([x] if k % 2 else self.words(x))] if self.symbols else self.words(text)
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, words))
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = self._ids(w)
            return b"".join(map(memo.__getitem__, words))

    def decode(self, ids: np.ndarray) -> str:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        text = self.surface[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded (from the ids) and whether that is the text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(model_path, "rb") as f:
            coder = PieceTransducer(f.read())
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [np.frombuffer(coder.encode(t), "<i4") for t in texts]
                decoded = [coder.decode(i) for i in ids]
                sizes = np.array([len(i) for i in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))
                same = pa.array([a == b for a, b in zip(texts, decoded, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists, pa.array(decoded, pa.string()), same], ["doc_id", "n_tokens", "ids", "decoded", "round_trip"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string, round_trip boolean")
