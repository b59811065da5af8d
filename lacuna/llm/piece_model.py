"""A compiled piece model: its file's fields, the character map with source offsets, merging, decoding.

The file is a protobuf message; only the fields read here are named. Models have to be of the pair-merging
kind with byte fallback and without user-defined or unused pieces; others are refused.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Stands for a space in pieces.
SPACE = "▁"
# Field numbers of the file, kinds of pieces, the model kind that merges pairs, the text of an unknown piece.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PAIR_MERGING = 2
UNKNOWN_TEXT = " ⁇ "

#: Characters of a word whose merges are looked up without a heap; stands for a pair that is no piece.
SHORT, NO_PIECE = 64, float("inf")
#: Pieces of distinct words that a worker keeps; beyond that it starts anew.
KEPT_PIECES = 4_000_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(key & 7)
        if n is None:
            n = varint()
        yield key >> 3, data[at : at + n]
        at += n


class CharMap:
    """Longest-prefix rules: a double array of bytes with the places of replacements behind it."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self._units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if blob else []
        self._out = blob[4 + n :]

    def __bool__(self) -> bool:
        return bool(self._units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest rule that fits at ``at``."""
        units, found = self._units, None
        node = self._step(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._step(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self._out[found[1] : self._out.index(b"\0", found[1])]

    @staticmethod
    def _step(unit: int) -> int:
        return unit >> 10 << (unit >> 6 & 8)


def _char(data: bytes, at: int) -> int:
    """Bytes of the character at ``at``; 0 if there is none."""
    b = data[at]
    n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
    try:
        return n if n and len(data[at : at + n].decode()) == 1 and at + n <= len(data) else 0
    except UnicodeDecodeError:
        return 0


class Normalizer:
    def __init__(self, spec: bytes):
        known = dict(fields(spec))
        self.chars = CharMap(known.get(2, b""))
        self.dummy_prefix, self.no_extra_space, self.escape = (bool(known.get(k, 1)) for k in (3, 4, 5))

    def __call__(self, data: bytes) -> tuple[str, np.ndarray]:
        """The normal form and, for each of its bytes and its end, the byte of ``data`` that it comes from."""
        if not data:
            return "", np.zeros(1, np.int64)
        if not self.chars:
            try:
                text = data.decode()
                return self._spaced(text, np.frombuffer(data, np.uint8), np.arange(len(data) + 1), None)
            except UnicodeDecodeError:
                pass
        out, source, head = self._ruled(data)
        return self._spaced(out.decode(), np.frombuffer(out, np.uint8), source, head)

    def _ruled(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Each rule or else character of ``data`` in turn; a byte that belongs to no character becomes U+FFFD."""
        parts, froms, heads, at = [], [], [], 0
        while at < len(data):
            hit = self.chars.longest(data, at) if self.chars else None
            if hit is None:
                n = _char(data, at)
                hit = (n, data[at : at + n]) if n else (1, b"\xef\xbf\xbd")
            n, out = hit
            parts.append(out)
            froms += [at] * len(out)
            lead = len(out) - len(out.lstrip(b" "))
            heads += [True] * lead + [False] * (len(out) - lead)
            at += n
        return b"".join(parts), np.array([*froms, len(data)], np.int64), np.array(heads, bool)

    def _spaced(self, text: str, data: np.ndarray, source: np.ndarray, head: np.ndarray | None) -> tuple[str, np.ndarray]:
        space = data == 0x20
        end = source[-1:]
        if self.no_extra_space:
            before = np.concatenate(([True], space[:-1]))
            keep = ~(space & before & (True if head is None else head))
            data, space, source = data[keep], space[keep], source[:-1][keep]
            text = data.tobytes().decode()
            if not len(data):
                return "", end
        else:
            source = source[:-1]
        if self.escape:
            source = np.repeat(source, np.where(space, 3, 1))
            text = text.replace(" ", SPACE)
        mark = SPACE if self.escape else " "
        if self.dummy_prefix:
            first = end[0] if not len(source) else (source[0] if self.no_extra_space else 0)
            source = np.concatenate((np.full(len(mark.encode()), first), source))
            text = mark + text
        if self.no_extra_space:
            short = text.rstrip(mark)
            if len(short) < len(text):
                n = len(short.encode())
                text, source, end = short, source[:n], source[n : n + 1]
        return text, np.concatenate((source, end))


def word_pattern(pieces: Iterable[str]) -> str:
    """Finds words one after the other, so that no piece reaches over the end of one: they end before a space that follows something else, and around ASCII characters of no piece."""
    names = [*pieces]
    if any(re.search(f"[^{SPACE}]{SPACE}", n) for n in names):
        return "(?s).+"
    lone = re.escape("".join(sorted({*map(chr, range(128))} - {c for n in names for c in n})))
    return "|".join([f"{SPACE}*[^{SPACE}{lone}]+", f"{SPACE}+"] + [f"[{lone}]"] * bool(lone))


class PieceModel:
    """Encodes by words: texts are cut where no piece of the vocabulary reaches over, so each word is merged once.

    The words met so far lie in flat arrays of ids and lengths; a text's pieces are gathered from them.
    """

    def __init__(self, data: bytes):
        pieces = [dict(fields(v)) for k, v in fields(data) if k == PIECES]
        whole = dict(x for x in fields(data) if x[0] != PIECES)
        trainer = dict(fields(whole.get(TRAINER, b"")))
        self.normalize = Normalizer(whole.get(NORMALIZER, b""))
        kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3) != PAIR_MERGING or not trainer.get(35) or trainer.get(24) or {USER_DEFINED, UNUSED} & {*kinds}:
            raise ValueError("only pair-merging models with byte fallback and without user-defined or unused pieces are read")
        names = [p.get(1, b"").decode() for p in pieces]
        scores = np.frombuffer(b"".join(p.get(2, b"\0\0\0\0") for p in pieces), "<f4").tolist()
        self.ids = {n: i for i, n in enumerate(names) if kinds[i] == NORMAL}
        self._score = {n: -scores[i] for n, i in self.ids.items()}
        self._bytes = {int(names[i][3:-1], 16): i for i, k in enumerate(kinds) if k == BYTE}
        byte_of = {i: b for b, i in self._bytes.items()}
        self._raw = [bytes([byte_of[i]]) if kinds[i] == BYTE else b"" if kinds[i] == CONTROL else UNKNOWN_TEXT.encode() if kinds[i] == UNKNOWN else n.encode() for i, n in enumerate(names)]
        self._plain = [bool(kinds[i] != BYTE) for i in range(len(names))]
        self._words = re.compile(word_pattern(self.ids)).findall
        self._forget()

    def _forget(self) -> None:
        self._at: dict[str, int] = {}
        self._first, self._flat, self._size = array("q", [0]), array("i"), array("i")

    def _word(self, word: str) -> int:
        """The number of a word in the flat arrays."""
        for piece in self.merged(word):
            own = self.ids.get(piece)
            raw = piece.encode()
            if own is not None:
                self._flat.append(own)
                self._size.append(len(raw))
            else:  # the last byte of an unknown character stands for all of it
                self._flat.extend(self._bytes[b] for b in raw)
                self._size.extend([0] * (len(raw) - 1) + [len(raw)])
        self._first.append(len(self._flat))
        self._at[word] = len(self._at)
        return self._at[word]

    def merged(self, word: str) -> list[str]:
        """Pieces of a word: the pair of best score first, the leftmost of equal ones."""
        return self._merged_short(word) if len(word) <= SHORT else self._merged_long(word)

    def _merged_short(self, word: str) -> list[str]:
        """By looking over all scores each time, which for few characters is faster than a heap."""
        part, score = list(word), self._score.get
        pair = [score(a + b, NO_PIECE) for a, b in zip(part, part[1:])]
        while pair and (best := min(pair)) < NO_PIECE:
            i = pair.index(best)
            part[i] += part[i + 1]
            del part[i + 1], pair[i]
            if i:
                pair[i - 1] = score(part[i - 1] + part[i], NO_PIECE)
            if i < len(pair):
                pair[i] = score(part[i] + part[i + 1], NO_PIECE)
        return part

    def _merged_long(self, word: str) -> list[str]:
        part = list(word)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        score, heap = self._score, []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (s := score.get(both := part[a] + part[b])) is not None:
                heapq.heappush(heap, (s, a, b, both))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not part[a] or not part[b] or len(part[a]) + len(part[b]) != len(both):
                continue
            part[a], part[b] = both, ""
            after[a] = after[b]
            if after[a] < len(part):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in part if p]

    def encode(self, texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts, the first and last (exclusive) byte of its text that each covers, and where each text's ids begin."""
        if len(self._flat) > KEPT_PIECES:
            self._forget()
        at, word, numbers, sources = self._at, self._word, array("q"), []
        bounds = array("q", [0])
        for data in texts:
            text, source = self.normalize(data)
            numbers.extend([at[w] if w in at else word(w) for w in self._words(text)])
            bounds.append(len(numbers))
            sources.append(source)
        first, flat, size = (np.array(x) for x in (self._first, self._flat, self._size))
        number, bounds = np.array(numbers, np.int64), np.array(bounds)
        n = first[number + 1] - first[number]
        ends = np.concatenate(([0], np.cumsum(n)))
        take = np.arange(ends[-1]) + np.repeat(first[number] - ends[:-1], n)
        begins = ends[bounds]
        # places in all normal forms side by side, each of which has an entry for its end
        upto = np.cumsum(size[take]) + np.repeat(np.arange(len(sources)), np.diff(begins))
        source = np.concatenate(sources) if sources else np.zeros(0, np.int64)
        return flat[take], source[upto - size[take]].astype(np.int32), source[upto].astype(np.int32), begins

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces side by side without the leading space that encoding adds.

        Runs of byte pieces are read as UTF-8, where each byte that belongs to no character gives U+FFFD.
        """
        raw = [self._raw[i] for i in ids]
        out = b"".join(raw)
        mark = SPACE.encode()
        lead = next((k for k, i in enumerate(ids) if self._raw[i]), None)
        if (self.normalize.dummy_prefix or self.normalize.no_extra_space) and lead is not None and self._plain[ids[lead]] and out.startswith(mark):
            out = out[len(mark) :]
            if self.normalize.no_extra_space:
                while out.startswith(mark):
                    out = out[len(mark) :]
        try:
            return out.decode().replace(SPACE, " ")
        except UnicodeDecodeError:
            return self._broken(ids)

    def _broken(self, ids: list[int]) -> str:
        """As ``decode`` where runs of byte pieces are no UTF-8."""
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and not self._plain[i]:
                run += self._raw[i]
                continue
            at = 0
            while at < len(run):
                n = _char(bytes(run), at)
                out.append(run[at : at + n].decode() if n else "�")
                at += n or 1
            run.clear()
            if i is not None:
                out.append(self._raw[i].decode().replace(SPACE, " "))
        text = "".join(out)
        first = next((i for i in ids if self._raw[i]), None)
        strip = (self.normalize.dummy_prefix or self.normalize.no_extra_space) and first is not None and self._plain[first] and self._raw[first].startswith(SPACE.encode())
        return text[1:] if strip else text

