"""Alignment of two tokenizers over a corpus: which tokens of A cover the same bytes as which tokens of B, and how often.

A text is cut into units, each a run of blanks with what follows it. Neither tokenizer has a token that goes on from a sign into a blank, so
units are encoded once per task and looked up afterwards; all figures of a document are sums over its units. Distinct linked id pairs get a
minimal perfect hash per block of the pair space, tasks' counts become dense vectors over that hash, and the vectors are summed in a tree.
A second pass aligns the documents again and looks the counts up.

There are at most (ids of A) x (ids of B) pairs however large the corpus is, so a block is bounded. The lookup table goes to the
tasks in slices of at most `slice_pairs` pairs; each slice is one more pass over the documents, and the passes' sums are added.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shingles import mix
from granary.llm.tokens import blocks as text_blocks
from granary.sources.tables import materialise

BLOCKS = 128  # parts of the pair space; with two vocabularies of 50,257 and 32,000 at most 13 million pairs each
FAN_IN = 32  # vectors summed by one task of a tree round

# A unit: blanks, then signs up to a blank that follows a sign. A blank after other white space does not cut.
_UNITS = re.compile(r" *[^ ]+(?:(?<=\s) +[^ ]*)*| +").findall
# Units that can be joined into one text for A: one blank, Latin signs, no white space at either end.
_QUICK = re.compile(r" [^\s\u0250-\U0010FFFF](?:[^\u0250-\U0010FFFF]{0,1000}[^\s\u0250-\U0010FFFF])?").fullmatch
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>").fullmatch


def _byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PairOfTokenizers:
    """Encodes batches of units with both tokenizers and aligns them."""

    def __init__(self, file_a: str, file_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        with open(file_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = _byte_letters()
        self.length_a = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length_a[i] = len(token)  # one letter a byte
        self.bytes_a = {i: bytes(letters.get(c, 0) for c in token) for token, i in vocabulary.items()}
        self.ranked = self._by_rank(vocabulary, merges)
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.blank = pieces.index("▁")
        # Units are independent only if no piece holds a blank after another sign.
        self.separable = not any(re.search("[^▁]▁", p) for p in pieces)

    def _by_rank(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        """The same vocabulary for an encoder that merges by rank, or None if ids do not follow the order of the merges.

        Where every token is reached by its own merge, merging by rank gives the ids of the file's merges: a token that could be made of another pair
        stands between cuts that no merge has crossed, so inside them the order of merges was that of the token alone.
        """
        import public_tokenizers
        import tiktoken

        first = len(vocabulary) - len(merges)
        held = [i for t, i in vocabulary.items() if i < first and len(t) == 1]
        ordered = all(vocabulary.get(x + y) == len(held) + i for i, (x, y) in enumerate(merges))
        if len(held) != 256 or not ordered:
            return None
        ranks = {self.bytes_a[i]: i for i in vocabulary.values() if i < len(held) + len(merges)}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids_a(self, units: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A for all units, and how many each has. A sign and then one blank before a sign always is a cut, so such units go in one text."""
        if _QUICK(units[0]) and _QUICK(units[-1]):  # units come sorted by that
            joined = "".join(units)
            ids = self.ranked.encode_ordinary(joined) if self.ranked else self.a.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            ids = np.array(ids, np.int64)
            ends, wanted = np.cumsum(self.length_a[ids]), np.cumsum(sizes)
            upto = np.searchsorted(ends, wanted, "right")
            if (ends[np.maximum(upto, 1) - 1] == wanted).all():
                return ids, np.diff(upto, prepend=0)
        found = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.int64), np.array(list(map(len, found)), np.int64)

    def _ids_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of B for all units; each starts with a blank, which B adds by itself."""
        found = [ids or ([self.blank] if u == " " else []) for u, ids in zip(units, self.b.encode([u[1:] for u in units], num_threads=1))]
        return np.array([i for ids in found for i in ids], np.int64), np.array(list(map(len, found)), np.int64)

    def align(self, units: list[str]) -> Aligned:
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        sizes = np.array(list(map(len, raw)), np.int64)
        (a, many_a), (b, many_b) = self._ids_a(units, sizes), self._ids_b(units)
        ends_a, ends_b, whole = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), b"".join(raw)
        at_a, at_b, ends = np.cumsum(many_a), np.cumsum(many_b), np.cumsum(sizes)
        same = [b"".join(map(table.__getitem__, ids.tolist())) == whole and (np.append(0, cuts)[at] == ends).all()
                for table, ids, cuts, at in ((self.bytes_a, a, ends_a, at_a), (self.bytes_b, b, ends_b, at_b))]
        good = np.full(len(units), all(same))
        if not all(same):  # some unit is not rebuilt: find out which, and take the ids of the others
            parts_a, parts_b = np.split(a, at_a[:-1]), np.split(b, at_b[:-1])
            for i, r in enumerate(raw):
                good[i] = b"".join(map(self.bytes_a.__getitem__, parts_a[i].tolist())) == r == b"".join(map(self.bytes_b.__getitem__, parts_b[i].tolist()))
            a, b = a[np.repeat(good, many_a)], b[np.repeat(good, many_b)]
            ends_a, ends_b, ends = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), np.cumsum(sizes * good)
        return Aligned(good, a, ends_a, b, ends_b, ends)


class Aligned:
    """Groups and links of a batch of units that lie one after another. Units that are not `good` have none."""

    def __init__(self, good, a, ends_a, b, ends_b, ends):
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # where tokens of both end; every unit's end is one
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        self.good, n, self.n = good, len(cuts), len(good)
        self.group_ends = np.searchsorted(cuts, ends, "right")  # groups up to the end of each unit
        from_a, to_a = np.searchsorted(group_a, np.arange(n)), np.searchsorted(group_a, np.arange(n), "right")
        from_b, to_b = np.searchsorted(group_b, np.arange(n)), np.searchsorted(group_b, np.arange(n), "right")
        self._a, self._b, self._spans = a, b, (from_a, to_a, from_b, to_b)
        # Distinct ids per group with their occurrences, so that a long group costs what its distinct pairs cost.
        ka, ca = np.unique(group_a << 32 | a, return_counts=True)
        kb, cb = np.unique(group_b << 32 | b, return_counts=True)
        ga, gb = ka >> 32, kb >> 32
        first_b, many_b = np.searchsorted(gb, np.arange(n)), np.bincount(gb, minlength=n)
        repeats = many_b[ga]
        at_a = np.repeat(np.arange(len(ka)), repeats)
        at_b = np.arange(len(at_a)) - np.repeat(np.cumsum(repeats) - repeats, repeats) + np.repeat(first_b[ga], repeats)
        self.pairs = (ka[at_a] & 0xFFFFFFFF) << 32 | kb[at_b] & 0xFFFFFFFF  # A's id above B's
        self.times = ca[at_a] * cb[at_b]
        self.pair_ends = np.searchsorted(ga[at_a], self.group_ends)  # pairs up to the end of each unit
        self.figures = np.stack([self._per_unit(to_a - from_a, self.group_ends), self._per_unit(to_b - from_b, self.group_ends),
                                 np.diff(self.group_ends, prepend=0), self._per_unit(self.times, self.pair_ends)], axis=1)

    @staticmethod
    def _per_unit(values, ends):
        sums = np.concatenate([[0], np.cumsum(values)])[ends]
        return np.diff(sums, prepend=0)

    def texts(self) -> list[str]:
        """`a1,a2|b1;a3|b2` per unit."""
        a, b = list(map(str, self._a.tolist())), list(map(str, self._b.tolist()))
        from_a, to_a, from_b, to_b = (x.tolist() for x in self._spans)
        groups = [f"{a[i] if j - i == 1 else ','.join(a[i:j])}|{b[k] if m - k == 1 else ','.join(b[k:m])}" for i, j, k, m in zip(from_a, to_a, from_b, to_b)]
        ends = self.group_ends.tolist()
        return [";".join(groups[s:e]) for s, e in zip([0, *ends], ends)]


class Units:
    """Units already seen by a task, by number; `most` bounds how many characters of them are remembered."""

    def __init__(self, tokenizers: PairOfTokenizers, keep, most: int = 1 << 22):
        self.tokenizers, self.keep, self.most, self.held, self.number = tokenizers, keep, most, 0, {}

    def cut(self, text: str | None) -> list[str]:
        return [] if not text else _UNITS(" " + text) if self.tokenizers.separable else [" " + text]

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts by number, and how many each text has. A text with a unit that cannot be rebuilt is judged as one unit; if that
        fails too it has none.
        """
        if self.held > self.most:
            self.held = 0
            self.number.clear()
            self.keep.clear()
        cut = [self.cut(t) for t in texts]
        self._learn(list(set().union(*cut).difference(self.number)) if cut else [])
        many = np.array(list(map(len, cut)), np.int64)
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(many.sum()))
        if (flat < 0).any():
            rows = np.split(flat, np.cumsum(many)[:-1])
            for i in [i for i, row in enumerate(rows) if (row < 0).any()]:
                whole = " " + texts[i]
                self._learn([whole] if whole not in self.number else [])
                rows[i] = np.array([self.number[whole]] if self.number[whole] >= 0 else [], np.int64)
            many, flat = np.array(list(map(len, rows)), np.int64), np.concatenate(rows)
        return flat, many

    def _learn(self, missing: list[str]) -> None:
        self.held += sum(map(len, missing))
        quick = [u for u in missing if _QUICK(u)]
        rest = [u for u in missing if not _QUICK(u)] if len(quick) < len(missing) else []
        for units in [quick[i:i + 8192] for i in range(0, len(quick), 8192)] + [rest[i:i + 8192] for i in range(0, len(rest), 8192)]:
            aligned = self.tokenizers.align(units)
            first = self.keep.add(aligned)
            self.number.update((u, first + j if ok else -1) for j, (u, ok) in enumerate(zip(units, aligned.good.tolist())))


class _PairCounts:
    """Pass 1 keeps each unit's pairs, and in how many documents each pair was seen."""

    def __init__(self, tokenizers: PairOfTokenizers):
        self.width = len(tokenizers.length_b)  # a pair is one number below the product of the vocabularies
        self.span = len(tokenizers.length_a) * self.width
        self.seen, self.times = [], []
        self.clear()

    def clear(self):
        self.pairs, self.start, self.used = [], [np.zeros(1, np.int64)], 0
        self.flat = None

    def add(self, aligned: Aligned) -> int:
        first = self.used
        self.pairs.append((aligned.pairs >> 32) * self.width + (aligned.pairs & 0xFFFFFFFF))
        self.start.append(aligned.pair_ends + self.start[-1][-1])
        self.used += aligned.n
        self.flat = None
        return first

    def count(self, units: np.ndarray, many: np.ndarray) -> int:
        """Count the pairs of documents, given their units, each pair once a document; gives how many counts are held."""
        if self.flat is None:
            self.pairs, self.start = [np.concatenate(self.pairs)] if self.pairs else [], [np.concatenate(self.start)]
            self.flat = self.pairs[0] if self.pairs else np.zeros(0, np.int64)
        start = self.start[0]
        held = np.unique(np.repeat(np.arange(len(many)), many) * max(1, self.used) + units)
        doc, unit = np.divmod(held, max(1, self.used))
        size = start[unit + 1] - start[unit]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[unit], size)
        pairs, times = np.unique(np.unique(np.repeat(doc, size) * self.span + self.flat[at]) % self.span, return_counts=True)
        self.seen.append(pairs)
        self.times.append(times)
        if len(self.seen) > 16:
            self.merge()
        return len(self.seen[0])

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        pairs, inverse = np.unique(np.concatenate(self.seen), return_inverse=True) if self.seen else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        times = np.zeros(len(pairs), np.int64)
        if self.seen:
            np.add.at(times, inverse, np.concatenate(self.times))
        self.seen, self.times = [pairs], [times]
        return pairs // self.width << 32 | pairs % self.width, times


class _Figures:
    """Pass 2 keeps each unit's figures and group text."""

    def __init__(self, lookup: Lookup, best: np.ndarray):
        self.lookup, self.best = lookup, best
        self.clear()

    def clear(self):
        self.rows, self.texts, self.used = np.zeros((1024, 6), np.int64), [], 0

    def add(self, aligned: Aligned) -> int:
        count = self.lookup.counts(aligned.pairs)
        hit = (count > 0) & (count == self.best[aligned.pairs >> 32])
        more = np.column_stack([aligned.figures, aligned._per_unit(aligned.times * hit, aligned.pair_ends), aligned._per_unit(aligned.times * count, aligned.pair_ends)])
        first, self.used = self.used, self.used + aligned.n
        if self.used > len(self.rows):
            self.rows = np.concatenate([self.rows[:first], np.zeros((self.used * 2 - first, 6), np.int64)])
        self.rows[first:self.used] = more
        self.texts += aligned.texts()
        return first


# --- minimal perfect hash


def block_of(pairs: np.ndarray) -> np.ndarray:
    return (mix(pairs.astype(np.uint64)) >> np.uint64(40)) % np.uint64(BLOCKS)


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Levels of bit arrays: a key that is alone in its slot of a level stays there, the others go on to the next, smaller one.

    A key's number is the count of set bits before its own over all levels, so n keys have the numbers 0 to n - 1.
    """

    def __init__(self, levels: list[np.ndarray], n: int):
        self.levels, self.n = levels, n
        self.ranks, before = [], 0
        for bits in levels:
            held = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(before + held - bits)
            before += int(held[-1])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            slots = _slot(rest, len(levels), max(64, 2 * len(rest)))
            alone = np.bincount(slots, minlength=max(64, 2 * len(rest))) == 1
            levels.append(alone)
            rest = rest[~alone[slots]]
        return cls(levels, len(keys))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; a key that was not built in gets -1 or that of another."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            slots = _slot(keys[left], level, len(bits))
            hit = bits[slots]
            out[left[hit]] = ranks[slots[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        sizes = np.array([self.n, *(len(b) for b in self.levels)], "<i8")
        return np.array([len(sizes)], "<i8").tobytes() + sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        many = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes = np.frombuffer(raw, "<i8", many, 8).tolist()
        at, levels = 8 + 8 * many, []
        for n in sizes[1:]:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at), count=n).astype(bool))
            at += (n + 7) // 8
        return cls(levels, sizes[0])


class Lookup:
    """Counts of the pairs of some blocks; 0 for every other pair."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes]]):
        self.parts = {block: (PerfectHash.load(h), np.frombuffer(keys, "<i8"), np.frombuffer(counts, "<i8")) for block, h, keys, counts in rows}

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), np.int64)
        block = block_of(pairs)
        order = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(BLOCKS + 1))
        for b, (found, keys, counts) in self.parts.items():
            at = order[edges[b]:edges[b + 1]]
            number = found.numbers(pairs[at])
            ok = number >= 0
            ok[ok] = keys[number[ok]] == pairs[at[ok]]  # verified: the hash has a number for strange pairs too
            out[at[ok]] = counts[number[ok]]
        return out


# --- jobs


def _partial_counts(docs: DataFrame, file_a: str, file_b: str, flush: int = 1 << 20) -> DataFrame:
    """(part, block, pairs, docs): per task and block the pairs its documents hold, ascending, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, part = PairOfTokenizers(file_a, file_b), TaskContext.get().partitionId()
        keep = _PairCounts(tokenizers)
        units = Units(tokenizers, keep)

        def out():
            pairs, counts = keep.merge()
            keep.seen, keep.times = [], []
            block = block_of(pairs)
            order = np.lexsort((pairs, block))
            pairs, counts, block = pairs[order], counts[order], block[order]
            edges = np.searchsorted(block, np.arange(BLOCKS + 1)).tolist()
            rows = [(part, b, pairs[s:e].tobytes(), counts[s:e].tobytes()) for b, (s, e) in enumerate(zip(edges, edges[1:])) if e > s]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "block", "pairs", "docs"])

        for batch in batches:
            for piece in text_blocks(batch):
                if keep.count(*units.numbers(piece.column("text").to_pylist())) > flush:
                    yield from out()
        yield from out()

    return docs.select("text").mapInArrow(run, "part int, block int, pairs binary, docs binary")


def _distinct_hashes(partial: DataFrame) -> DataFrame:
    """(block, hash, keys): the minimal perfect hash over all distinct pairs of a block, and the keys by their numbers."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("pairs").to_pylist()):
                pairs = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block, np.int32)), pa.array(pairs)], ["block", "pair"])

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pairs = np.sort(rows["pair"].to_numpy())
        found = PerfectHash.of(pairs)
        keys = np.zeros(len(pairs), np.int64)
        keys[found.numbers(pairs)] = pairs
        return pd.DataFrame({"block": [key[0]], "hash": [found.dump()], "keys": [keys.tobytes()]})

    pairs = partial.select("block", "pairs").mapInArrow(explode, "block int, pair long").distinct()
    return pairs.groupBy("block").applyInPandas(build, "block int, hash binary, keys binary")


def _summed(partial: DataFrame, hashes: DataFrame, parts: int) -> DataFrame:
    """(block, counts): per block the dense vector of document counts in the order of its hash, summed in a tree of FAN_IN vectors a round."""

    def vectors(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        found = PerfectHash.load(known["hash"][0])
        total = np.zeros(found.n, np.int64)
        for pairs, docs in zip(rows["pairs"], rows["docs"]):
            total[found.numbers(np.frombuffer(pairs, "<i8"))] += np.frombuffer(docs, "<i8")  # a row's pairs are distinct
        return pd.DataFrame({"block": [key[0]], "part": [key[1]], "counts": [total.tobytes()]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(rows["counts"][0], "<i8").copy()
        for raw in rows["counts"][1:]:
            total += np.frombuffer(raw, "<i8")
        return pd.DataFrame({"block": [key[0]], "part": [key[1]], "counts": [total.tobytes()]})

    schema = "block int, part int, counts binary"
    parts = -(-parts // FAN_IN)
    rows = partial.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
    wanted = rows.select(F.col("block").alias("of"), F.col("part").alias("to")).distinct()
    known = wanted.join(hashes.select(F.col("block").alias("of"), "hash"), "of")
    level = rows.groupBy("block", "part").cogroup(known.groupBy("of", "to")).applyInPandas(vectors, schema)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        level = level.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part").applyInPandas(add, schema)
    return level.select("block", "counts")


def pair_counts(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """(block, hash, keys, counts, n): in how many of `docs` (text) each linked id pair occurs, per block of the pair space.

    `keys` and `counts` are 64-bit little-endian arrays in the order of the hash's numbers; a key is A's id * 2^32 + B's id.
    """
    partial = materialise(_partial_counts(docs, file_a, file_b), "alignment-partial")
    hashes = materialise(_distinct_hashes(partial), "alignment-hashes")
    parts = (partial.agg(F.max("part")).first()[0] or 0) + 1
    joined = hashes.join(_summed(partial, hashes, parts), "block")
    return materialise(joined.withColumn("n", (F.octet_length("keys") / 8).cast("long")), "alignment-counts")


def _best(counts: DataFrame, ids: int) -> np.ndarray:
    """Per id of A the highest count of a pair it is in; as long as A's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, found in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                most = np.zeros(ids, np.int64)
                np.maximum.at(most, np.frombuffer(keys, "<i8") >> 32, np.frombuffer(found, "<i8"))
                at = np.flatnonzero(most)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(most[at])], ["a", "most"])

    best = np.zeros(ids, np.int64)
    for a, most in counts.select("keys", "counts").mapInArrow(run, "a long, most long").groupBy("a").agg(F.max("most")).collect():
        best[a] = most
    return best


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _looked_up(docs: DataFrame, file_a: str, file_b: str, lookup, best, keep_groups: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _Figures(Lookup(lookup.value), best.value)
        units = Units(PairOfTokenizers(file_a, file_b), keep)
        for batch in batches:
            for piece in text_blocks(batch):
                flat, many = units.numbers(piece.column("text").to_pylist())
                ends = np.cumsum(many)
                sums = np.diff(np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(keep.rows[flat], axis=0)])[ends], axis=0, prepend=0)
                shown = list(map(keep.texts.__getitem__, flat.tolist()))
                groups = [";".join(shown[e - n:e]) for e, n in zip(ends.tolist(), many.tolist())]
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                names = [c for c in piece.schema.names if c != "text"]
                columns = [piece.column(c) for c in names] + [pa.array(sums[:, j]) for j in range(6)] + [pa.array(digests, pa.string())]
                names = names + FIGURES + ["groups_sha256"]
                if keep_groups:
                    columns, names = columns + [pa.array(groups, pa.string())], names + ["groups"]
                yield pa.RecordBatch.from_arrays(columns, names)

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    schema = f"{carried}, " + ", ".join(f"{c} long" for c in FIGURES) + ", groups_sha256 string" + (", groups string" if keep_groups else "")
    return docs.mapInArrow(run, schema)


def align(docs: DataFrame, file_a: str, file_b: str, doc_id: str = "doc_id", slice_pairs: int = 1 << 23, keep_groups: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): figures of its alignment and the digest of its groups; with `keep_groups` the groups themselves.

    `file_a` is a byte-level vocabulary of the tokenizers library, applied to blank + text; `file_b` a sentencepiece model, applied to the
    text. Null and empty texts, and texts that the joined tokens of A or B do not rebuild byte by byte, have no tokens: zeros and ''. Repeated
    rows count as documents of their own, null ids are carried. An empty table gives an empty result. Other columns of `docs` are not read.
    A very long text is cut into units as any other; only a text (or unit) without a blank is encoded in one call.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), "text")
    context = docs.sparkSession.sparkContext
    counts = pair_counts(narrow, file_a, file_b)
    with open(file_a, encoding="utf-8") as f:
        ids = max(json.load(f)["model"]["vocab"].values()) + 1
    best = context.broadcast(_best(counts, ids))
    slices, filled = [[]], 0
    for block, n in sorted((r.block, r.n) for r in counts.select("block", "n").collect()):
        if filled and filled + n > slice_pairs:
            slices, filled = [*slices, []], 0
        slices[-1].append(block)
        filled += n
    passes = []
    for held in slices:
        rows = [tuple(r) for r in counts.where(F.col("block").isin(held)).select("block", "hash", "keys", "counts").collect()] if held else []
        passes.append(_looked_up(narrow, file_a, file_b, context.broadcast([(b, bytes(h), bytes(k), bytes(c)) for b, h, k, c in rows]), best, keep_groups))
    if len(passes) == 1:
        return passes[0]
    # Equal rows have equal figures in every pass: a group of m equal rows over p passes has m * p rows and m times the sum.
    same = ["doc_id", *FIGURES[:4], "groups_sha256", *(["groups"] if keep_groups else [])]
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    summed = every.groupBy(*same).agg(F.expr(f"count(*) div {len(passes)}").alias("__rows"), *[F.sum(c).alias(c) for c in FIGURES[4:]])
    exact = summed.select(*same, "__rows", *[F.expr(f"{c} div __rows").alias(c) for c in FIGURES[4:]])
    copies = exact.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__rows"))))
    return copies.select("doc_id", *FIGURES, "groups_sha256", *(["groups"] if keep_groups else []))
