"""Token ids of whole texts with a public tokenizer, piece by piece and remembered.

A tokenizer cuts a text into pieces before it merges, and white space (or a change between letters and other signs) always is
such a cut. So pieces are encoded once per task, or once per Python worker and job, and looked up afterwards: ids are exactly those of the whole text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from granary.llm.shingles import span_hashes

# White space as the tokenizers' patterns see it, and the letters below U+0250.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"

_ODD = re.compile("[^\x00-ɏ]|'")  # beyond these, only blanks are taken for cuts
_ASCII_CHUNK = re.compile("[^ \t\n\r\x0b\x0c]+").findall
_RUN = re.compile(f"[{_LETTER}]+|[^{_LETTER}{_WHITE}]+").findall
_SPACED_CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+").findall
_SPACED_RUN = re.compile(f" ?[{_LETTER}]+| ?[^{_LETTER}{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+").findall
_PLAIN = re.compile(f"[{_LETTER}]+").fullmatch
_SPACED_PLAIN = re.compile(f" [{_LETTER}]+").fullmatch

# The same for arrays of code points below U+0250: 0 white space, 1 letters, 2 other signs.
_KIND = np.full(0x250, 2, np.uint8)
_KIND[[i for i in range(0x250) if re.match(f"[{_LETTER}]", chr(i))]] = 1
_KIND[[i for i in range(0x250) if re.match(f"[{_WHITE}]", chr(i))]] = 0
_SIGN = np.random.default_rng(20241107).integers(1, 1 << 63, 0x250, dtype=np.uint64)
_BLANK = 32


def _spans(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the pieces of `_SPACED_RUN` start in joined texts of so many code points."""
    kind = _KIND[points]
    dark, start = kind > 0, np.ones(len(points), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[1:] &= ~(dark[1:] & (points[:-1] == _BLANK))  # the blank has begun the piece
    ends = np.cumsum(sizes)[sizes > 0]
    before_dark = np.append(dark[1:], False)
    before_dark[ends - 1] = False
    start |= ~dark & before_dark  # the last white sign of several stands alone
    start[ends[:-1]] = True
    return np.flatnonzero(start)


class _Remembered:
    """Ids of pieces by the pieces' 64-bit hashes: a sorted array, and where each one's ids lie."""

    def __init__(self):
        self.hashes, self.slots, self.edges, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of some hashes, and which are there."""
        if not len(self.hashes):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        return self.slots[at], self.hashes[at] == asked

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Slots of new hashes in ascending order."""
        slots = np.arange(len(ids)) + len(self.slots)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.slots = np.insert(self.hashes, at, hashes), np.insert(self.slots, at, slots)
        self.edges = np.append(self.edges, self.edges[-1] + np.cumsum([len(x) // 4 for x in ids], dtype=np.int64))
        self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), "<u4"))
        return slots


class Encoder:
    """ids(texts) -> one little-endian unsigned 32-bit byte string per text.

    `most` bounds how many pieces are remembered. Texts of signs below U+0250 without apostrophes are cut and looked up as arrays, which
    hold four times as many pieces by 64-bit hashes. The library takes the strings of special tokens for these tokens; a text with one is encoded
    in one call.
    """

    def __init__(self, file: str, most: int = 1 << 19):
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            whole = json.load(f)
        model, added = whole["model"], [t["content"] for t in whole.get("added_tokens") or []]
        self.tokenizer = Tokenizer.from_file(file)
        self.special = re.compile("|".join(map(re.escape, added)) if added else "(?!)").search
        self.word_ends = model.get("end_of_word_suffix") == "</w>"
        marked = np.zeros(max(model["vocab"].values()) + 1, bool)
        for token, i in model["vocab"].items():
            marked[i] = token.endswith("</w>") if self.word_ends else token.startswith("Ġ")
        self.marked, self.known, self.most, self.arrays = marked, {}, most, _Remembered()

    def pieces(self, text: str) -> list[str]:
        odd = _ODD.search(text)
        if self.word_ends:  # white space is dropped and letters are lower-cased by the tokenizer anyway
            return _ASCII_CHUNK(text) if odd else _RUN(text.lower())
        return _SPACED_CHUNK(text) if odd else _SPACED_RUN(text)

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Plain words are encoded joined, and the ids are cut at the marks of word ends or starts."""
        plain = list(filter(_PLAIN if self.word_ends else _SPACED_PLAIN, missing))
        found: dict[str, bytes] = {}
        for i in range(0, len(plain), 4096):
            words = plain[i:i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.word_ends else "").join(words)], add_special_tokens=False)[0].ids, "<u4")
            marks = np.flatnonzero(self.marked[ids])
            if len(marks) != len(words):
                continue
            cuts = [0, *(4 * (marks + 1)).tolist()] if self.word_ends else [*(4 * marks).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            found.update(zip(words, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        rest = [p for p in missing if p not in found]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            found[p] = np.array(e.ids, "<u4").tobytes()
        return found

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        """Of texts without special tokens or signs of `_ODD`."""
        joined, sizes = "".join(texts), np.array([len(t) for t in texts], np.int64)
        if not joined:
            return [b""] * len(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        starts = _spans(points, sizes)
        ends = np.append(starts[1:], len(points))
        hashes = span_hashes(_SIGN[points], starts, ends)
        order = np.argsort(hashes)
        ordered = hashes[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        if len(self.arrays.hashes) > 4 * self.most:
            self.arrays = _Remembered()
        slots, there = self.arrays.find(ordered[first])
        new = order[first[~there]]
        pieces = [joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())]
        learnt = self._learn(pieces)
        slots[~there] = self.arrays.add(ordered[first[~there]], [learnt[p] for p in pieces])
        slot = np.empty(len(starts), np.int64)
        slot[order] = np.repeat(slots, np.diff(np.append(first, len(starts))))
        begin, length = self.arrays.edges[slot], self.arrays.edges[slot + 1] - self.arrays.edges[slot]
        total = np.append(0, np.cumsum(length))
        raw = self.arrays.ids[np.repeat(begin - total[:-1], length) + np.arange(total[-1])].tobytes()
        cuts = (4 * total[np.searchsorted(starts, np.append(0, np.cumsum(sizes)))]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def ids(self, texts: Iterable[str]) -> list[bytes]:
        texts = list(texts)
        if not self.word_ends:
            joined = "".join(texts)
            calm = "'" not in joined and np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").max(initial=0) < len(_KIND)
            plain = [(calm or not _ODD.search(t)) and not self.special(t) for t in texts]
            if any(plain):
                found = iter(self._plain_ids([t for t, p in zip(texts, plain) if p]))
                rest = iter(self.ids([t for t, p in zip(texts, plain) if not p]) if not all(plain) else [])
                return [next(found) if p else next(rest) for p in plain]
        cut = [self.pieces(t) if not self.special(t) else None for t in texts]
        if None in cut:
            special = self.tokenizer.encode_batch_fast([t for t, c in zip(texts, cut) if c is None], add_special_tokens=False)
            rest = iter(self.ids([t for t, c in zip(texts, cut) if c is not None]))
            found = iter([np.array(e.ids, "<u4").tobytes() for e in special])
            return [next(found) if c is None else next(rest) for c in cut]
        if len(self.known) > self.most:
            self.known.clear()
        missing = list(set().union(*cut).difference(self.known)) if cut else []
        learnt = self._learn(missing)
        self.known.update(learnt)
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]


def blocks(batch: pa.RecordBatch, bytes_at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each (column `text`), at least one row."""
    sizes = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    start, filled = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if filled and filled + n > bytes_at_once:
            yield batch.slice(start, i - start)
            start, filled = i, 0
        filled += n
    if start < batch.num_rows:
        yield batch.slice(start)


_ENCODERS: dict[tuple[str, str], Encoder] = {}  # of this Python worker, one at most


def _encoder(file: str, job: str) -> Encoder:
    """The encoder that earlier tasks of this job left in the worker. Another job starts anew, so no run gains from what one before has learnt."""
    if (file, job) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[file, job] = Encoder(file)
    return _ENCODERS[file, job]


def encoded(batches: Iterator[pa.RecordBatch], file: str, end: int, job: str | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the ids of their texts (null: empty), each closed by the id `end`.

    Tasks with the same `job`, a name of its own for each run, share what a worker remembers; without one every task starts anew.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    encoder, close = _encoder(file, job) if job else Encoder(file), array("I", [end]).tobytes()
    for batch in batches:
        for part in blocks(batch):
            yield part, [x + close for x in encoder.ids(t or "" for t in part.column("text").to_pylist())]
