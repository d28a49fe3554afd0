"""Ranked lexical search: compressed inverted lists per segment of the corpus, searched by Block-Max MaxScore.

`build` cuts the documents into segments of about `segment_bytes` of text, each indexed by the task that reads it; nothing is shuffled. A
segment's lists lie in blocks of 128 postings, packed to the bytes they need, each with its highest term frequency and its shortest
document. From these two a bound of a block's scores follows as soon as the corpus figures are known, so the index needs one pass.

`search` sends the queries in blocks of bounded size to all segments. In a segment, lists are taken from the highest bound down until the
rest together cannot reach the k-th best score known; only documents found so far stay candidates. For the remaining lists the bound of the
block a candidate falls in is looked at first, and blocks without a surviving candidate are never unpacked. Tasks carry their heaps from
segment to segment; the heaps meet in one top-k per query.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.tokens import blocks as text_blocks
from granary.operators.ordered import global_prefix_sum
from granary.sources.tables import materialise

# A term is a run of ASCII letters and digits and anything beyond ASCII; so bytes decide.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PART = re.compile(rb"[0-9A-Za-z\x80-\xff]*")
BLOCK = 128

_SEGMENT = {"docs": pa.int64(), "terms": pa.int64(), "ids": pa.binary(), "nulls": pa.binary(), "lengths": pa.binary(), "words": pa.binary(), "df": pa.binary(),
            "heads": pa.binary(), "data": pa.binary()}
# Per block of a list: first and last document, shortest document, highest frequency, place in `data`, bytes per gap and per frequency.
_HEAD = np.dtype([("first", "<u4"), ("last", "<u4"), ("short", "<i8"), ("tf", "<u4"), ("at", "<i8"), ("gap_width", "u1"), ("tf_width", "u1"), ("count", "u1")])


def terms_of(raw: bytes, at_once: int = 1 << 22) -> Counter:
    """Terms of a whole text (UTF-8, only A-Z lower-cased) with their occurrences; long texts are cut between terms."""
    found, at = Counter(), 0
    while at < len(raw):
        end = _PART.match(raw, min(len(raw), at + at_once)).end()
        found.update(_TERM.findall(raw[at:end].lower()))
        at = end
    return found


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.uint8)


def _scatter(out: np.ndarray, values: np.ndarray, at: np.ndarray, width: np.ndarray) -> None:
    for k in range(4):
        held = width > k
        out[at[held] + k] = (values[held] >> (8 * k)) & 255


class _Builder:
    """Gathers documents and packs them into one segment."""

    def __init__(self):
        self.ids, self.lengths, self.words, self.tfs, self.sizes, self.bytes = [], [], [], [], [], 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.bytes += len(raw) + 16
        found = terms_of(raw)
        if found:
            self.ids.append(doc_id)
            self.lengths.append(found.total())
            self.words.extend(found.keys())
            self.tfs.extend(found.values())
            self.sizes.append(len(found))

    def pack(self) -> pa.RecordBatch:
        lengths = np.array(self.lengths, np.int64)
        doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        tf = np.array(self.tfs, np.int64)
        vocabulary = sorted(set(self.words))
        number = {w: i for i, w in enumerate(vocabulary)}
        term = np.fromiter(map(number.__getitem__, self.words), np.int64, len(self.words))
        order = np.argsort(term, kind="stable")  # by term, then document
        doc, tf, term = doc[order], tf[order], term[order]
        df = np.bincount(term, minlength=len(vocabulary))
        starts = np.cumsum(df) - df
        place = np.arange(len(term)) - starts[term]
        edge = np.flatnonzero(place % BLOCK == 0)  # first posting of each block
        block = np.cumsum(place % BLOCK == 0) - 1
        count = np.diff(np.append(edge, len(term)))
        gap = np.diff(doc, prepend=0)
        gap[edge] = 0
        heads = np.zeros(len(edge), _HEAD)
        heads["first"], heads["last"], heads["count"] = doc[edge], doc[edge + count - 1], count - 1
        heads["short"], heads["tf"] = np.minimum.reduceat(lengths[doc], edge), np.maximum.reduceat(tf, edge)
        heads["gap_width"], heads["tf_width"] = _width(np.maximum.reduceat(gap, edge)), _width(heads["tf"])
        size = count * (heads["gap_width"].astype(np.int64) + heads["tf_width"])
        heads["at"] = np.cumsum(size) - size
        data = np.zeros(int(size.sum()), np.uint8)
        inner, gap_width, tf_width = np.arange(len(term)) - edge[block], heads["gap_width"][block].astype(np.int64), heads["tf_width"][block].astype(np.int64)
        _scatter(data, gap, heads["at"][block] + inner * gap_width, gap_width)
        _scatter(data, tf, heads["at"][block] + count[block] * gap_width + inner * tf_width, tf_width)
        nulls = np.array([i is None for i in self.ids], np.uint8)
        ids = np.array([0 if i is None else i for i in self.ids], "<i8")
        row = [len(self.ids), int(lengths.sum()), ids.tobytes(), nulls.tobytes(), lengths.astype("<i8").tobytes(), b"\n".join(vocabulary), df.astype("<u4").tobytes(),
               heads.tobytes(), data.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SEGMENT.values())], list(_SEGMENT))


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_bytes: int = 8 << 20) -> DataFrame:
    """The index of all `docs` as a stored table with one row per segment. Texts without a term (null, empty) are in no list.

    A segment has `segment_bytes` of text and at least one document, however long that is. Rows are documents: equal or null ids stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = _Builder()
        for batch in batches:
            for piece in text_blocks(batch):
                for i, raw in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    segment.add(i, raw or b"")
                    if segment.bytes >= segment_bytes:
                        if segment.ids:
                            yield segment.pack()
                        segment = _Builder()
        if segment.ids:
            yield segment.pack()

    kinds = ", ".join(f"{n} {'long' if t == pa.int64() else 'binary'}" for n, t in _SEGMENT.items())
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return materialise(narrow.mapInArrow(run, kinds), "search-index")


class Segment:
    """One segment for the terms of a block of queries."""

    def __init__(self, row: dict, vocabulary: dict[bytes, int], n: int, total: int):
        lengths = np.frombuffer(row["lengths"], "<i8")
        self.ids, self.nulls = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], np.uint8)
        self.n, self.total = n, total
        self.m = self._m(lengths)
        self.data, self.docs = row["data"], len(lengths)
        df = np.frombuffer(row["df"], "<u4").astype(np.int64)
        heads = np.frombuffer(row["heads"], _HEAD)
        many = (df + BLOCK - 1) // BLOCK
        ends = np.cumsum(many)
        found = [(t, i) for i, t in enumerate(map(vocabulary.get, row["words"].split(b"\n"))) if t is not None]
        # The bound of a block, but for the weight of its term: no document in it scores more.
        self.lists = {t: heads[ends[i] - many[i]:ends[i]] for t, i in found}
        self.bounds = {t: self._impact(h["tf"].astype(np.int64), self._m(h["short"])) for t, h in self.lists.items()}
        self.most = {t: int(b.max()) for t, b in self.bounds.items()}
        self._whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _m(self, lengths: np.ndarray) -> np.ndarray:
        if len(lengths) and 90 * int(lengths.max()) * self.n >= 1 << 63:
            return np.array([10 + 90 * x * self.n // self.total for x in lengths.tolist()], np.int64)
        return 10 + 90 * lengths * self.n // self.total

    @staticmethod
    def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)

    def unpack(self, term: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their impacts."""
        h = self.lists[term][block]
        count, gap_width = int(h["count"]) + 1, int(h["gap_width"])
        docs = np.cumsum(np.frombuffer(self.data, f"<u{gap_width}", count, int(h["at"])), dtype=np.int64) + int(h["first"])
        tf = np.frombuffer(self.data, f"<u{h['tf_width']}", count, int(h["at"]) + count * gap_width).astype(np.int64)
        return docs, self._impact(tf, self.m[docs])

    def whole(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        if term not in self._whole:
            parts = [self.unpack(term, b) for b in range(len(self.lists[term]))]
            self._whole[term] = parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))
        return self._whole[term]


class Heap:
    """The k best of a query so far: highest score, then least id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.nulls = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    @property
    def threshold(self) -> int:
        """What a document needs at least; an equal score may win by its id."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def push(self, score: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        score, ids, nulls = np.concatenate([self.score, score]), np.concatenate([self.ids, ids]), np.concatenate([self.nulls, nulls])
        best = np.lexsort((ids, nulls, -score))[:self.k]
        self.score, self.ids, self.nulls = score[best], ids[best], nulls[best]


def _rank(segment: Segment, query: list[tuple[int, int]], heap: Heap) -> int:
    """Put the best documents of a segment for a query (term, weight) on the heap; gives how many blocks were never unpacked."""
    lists = sorted(((w * segment.most[t], t, w) for t, w in query if w and t in segment.lists), reverse=True)
    rest = np.append(np.cumsum([b for b, _, _ in lists][::-1])[::-1], 0).tolist() if lists else [0]
    needed = heap.threshold
    if rest[0] < needed:
        return sum(len(segment.lists[t]) for _, t, _ in lists)
    score, i, kth = np.zeros(segment.docs, np.int64), 0, segment.docs - heap.k
    while i < len(lists) and rest[i] >= needed:  # essential lists
        _, t, w = lists[i]
        docs, impact = segment.whole(t)
        score[docs] += w * impact
        i += 1
        if kth >= 0 and i < len(lists):
            needed = max(needed, int(np.partition(score, kth)[kth]))
    held = np.flatnonzero(score + rest[i] >= needed)
    held = held[score[held] > 0]
    skipped = 0
    for j in range(i, len(lists)):
        _, t, w = lists[j]
        heads, bounds = segment.lists[t], segment.bounds[t]
        block = np.searchsorted(heads["last"], held)
        inside = block < len(heads)
        inside[inside] = heads["first"][block[inside]] <= held[inside]
        bound = np.where(inside, w * bounds[np.minimum(block, len(heads) - 1)], 0)
        alive = score[held] + bound + rest[j + 1] >= needed
        held, block, inside = held[alive], block[alive], inside[alive]
        wanted = np.unique(block[inside]).tolist()
        skipped += len(heads) - len(wanted)
        for b in wanted:
            docs, impact = segment.unpack(t, b)
            mine = held[inside & (block == b)]
            at = np.searchsorted(docs, mine)
            hit = (at < len(docs)) & (docs[np.minimum(at, len(docs) - 1)] == mine)
            score[mine[hit]] += w * impact[at[hit]]
        held = held[score[held] + rest[j + 1] >= needed]
    held = held[score[held] >= needed]
    heap.push(score[held], segment.ids[held], segment.nulls[held])
    return skipped


def _query_terms(queries: DataFrame, item: str, text: str) -> DataFrame:
    """(query, item, words, n): one row per row of `queries` with its distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(terms_of(raw or b"")) for raw in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("item"), pa.array(words, pa.list_(pa.binary())), pa.array(map(len, words), pa.int64())],
                                             ["query", "item", "words", "n"])

    item_type = queries.schema[item].dataType.simpleString()
    rows = queries.select(F.monotonically_increasing_id().alias("query"), F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").cast("binary").alias("__text"))
    return materialise(rows.mapInArrow(run, f"query long, item {item_type}, words array<binary>, n long"), "search-queries")


def _frequencies(index: DataFrame, vocabulary: dict[bytes, int]) -> dict[int, int]:
    """Documents that hold each term of the vocabulary."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for words, df in zip(batch.column("words").to_pylist(), batch.column("df").to_pylist()):
                found = [(t, n) for t, n in zip(map(known.get, words.split(b"\n")), np.frombuffer(df, "<u4").tolist()) if t is not None]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["term", "df"])

    return dict(index.select("words", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect())


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(index: DataFrame, queries: DataFrame, item: str = "item_id", text: str = "text", k: int = 10, most_terms: int = 1 << 18) -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of `index` for each row of `queries`, exactly; scores of 0 do not count.

    Equal scores go by ascending doc_id, null ids last. Queries without a term, or an index without documents, give no rows. A repeated query
    row gets rows of its own, also under a null item. Queries are sent to the tasks in blocks of at most `most_terms` distinct terms (more only
    for a single query with more), one pass over the index per block; what comes back to the driver is the terms of one block and their counts.
    """
    spark = queries.sparkSession
    terms = _query_terms(queries, item, text)
    numbered = global_prefix_sum(terms.select("query", "n"), [F.col("query")], {"before": F.col("n")})
    placed = materialise(numbered.select("query", F.floor(F.col("before") / most_terms).alias("part")), "search-blocks")
    n, total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    found = None
    for (part,) in sorted(placed.select("part").distinct().collect()):
        rows = terms.join(placed.where(F.col("part") == part), "query").select("query", "words").collect()
        vocabulary = {w: i for i, w in enumerate(sorted({bytes(w) for r in rows for w in r.words}))}
        df = _frequencies(index, vocabulary)
        weights = {t: weight(n, c) for t, c in df.items()}
        asked = {r["query"]: [(t, weights[t]) for w in r.words if (t := vocabulary[bytes(w)]) in weights] for r in rows}
        best = _best(index, spark.sparkContext.broadcast((vocabulary, asked)), n, total, k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(terms.select("query", "item"), "query").select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _best(index: DataFrame, sent, n: int, total: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, asked = sent.value
        heaps = {q: Heap(k) for q in asked}
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment({c: batch.column(c)[i].as_py() for c in batch.schema.names}, vocabulary, n, total)
                for q, terms in asked.items():
                    _rank(segment, terms, heaps[q])
        for q, heap in heaps.items():
            if len(heap.score):
                ids = pa.array(heap.ids, mask=heap.nulls.astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), ids, pa.array(heap.score)], ["query", "doc_id", "score"])

    return index.mapInArrow(run, "query long, doc_id long, score long")
