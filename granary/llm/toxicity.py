"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes, calibrated.

The classifier's examples are a bounded sample of labelled texts; what it knows of the corpus (in how many documents a term occurs) is
counted over all documents. The index lists, for each term of the examples, its weights in blocks of 64 examples with each block's highest
weight. Lists that hold a good part of all examples are kept whole as rows of a matrix: their share of the cosines of a
batch of documents is one product. To it comes, per block, the sum of the other terms' block maxima; blocks are scored from the highest bound
down until no other can hold one of the k nearest. Examples that are alike share blocks (bisection along principal directions), so whole blocks fall out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.search import terms_of
from granary.llm.tokens import blocks as text_blocks
from granary.sources.tables import materialise

BLOCK = 64
FULL = 512  # lists kept whole at most


def text_key(text: str = "text") -> Column:
    """What equal texts share; examples are chosen and ordered by it, never by ids."""
    return F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))


def _bisected(dense: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows in which neighbours are alike: halves along the first principal direction, again and again."""
    def split(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= leaf:
            return [rows]
        centred = dense[rows] - dense[rows].mean(axis=0)
        way = np.linalg.svd(centred, full_matrices=False)[2][0]
        ordered = rows[np.argsort(centred @ way, kind="stable")]
        half = -(-len(rows) // leaf) // 2 * leaf
        return split(ordered[:half]) + split(ordered[half:])

    return np.concatenate(split(np.arange(len(dense))))


class Index:
    """Block-max inverted lists of the examples; weights are those of unit vectors."""

    def __init__(self, examples: list[tuple[list[bytes], list[int]]], numbers: dict[bytes, int], idf: np.ndarray):
        rows = np.repeat(np.arange(len(examples)), [len(t) for t, _ in examples])
        terms = np.array([numbers[w] for t, _ in examples for w in t], np.int64)
        weights = (1 + np.log(np.array([c for _, counts in examples for c in counts], np.float64))) * idf[terms]
        norms = np.sqrt(np.bincount(rows, weights ** 2, minlength=len(examples)))
        weights /= np.where(norms > 0, norms, 1)[rows]
        common = np.argsort(-np.bincount(terms, minlength=len(numbers)), kind="stable")[:FULL]
        column = np.full(len(numbers), -1)
        column[common] = np.arange(len(common))
        dense = np.zeros((len(examples), len(common)))
        shown = column[terms] >= 0
        dense[rows[shown], column[terms[shown]]] = weights[shown]
        #: The example at each place of the index.
        self.order = _bisected(dense, BLOCK)
        place = np.empty(len(examples), np.int64)
        place[self.order] = np.arange(len(examples))
        self.idf, self.n = idf, len(examples)
        at = place[rows]
        order = np.lexsort((at, terms))
        at, terms, weights = at[order], terms[order], weights[order]
        held = np.bincount(terms, minlength=len(numbers))
        whole = common[:FULL][held[common[:FULL]] * 8 >= len(examples)]
        #: Row of `full` for a term, or -1 for one whose list is in blocks.
        self.row = np.full(len(numbers), -1)
        self.row[whole] = np.arange(len(whole))
        self.full = np.zeros((len(whole), self.n))
        inside = self.row[terms] >= 0
        self.full[self.row[terms[inside]], at[inside]] = weights[inside]
        at, terms, weights = at[~inside], terms[~inside], weights[~inside]
        self.at, self.weight = at, weights
        first = np.flatnonzero(np.concatenate([[True], (np.diff(terms) != 0) | (np.diff(at // BLOCK) != 0)])) if len(at) else np.zeros(0, np.int64)
        self.block = at[first] // BLOCK
        self.most = np.maximum.reduceat(weights, first) if len(at) else weights
        self.start = np.append(first, len(at))
        self.entry = np.searchsorted(terms[first], np.arange(len(numbers) + 1))  # blocks of each term
        self.blocks = -(-self.n // BLOCK)

    @staticmethod
    def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all ranges one after another, and the range each is from."""
        size = stop - start
        which = np.repeat(np.arange(len(start)), size)
        return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which], which

    def nearest(self, docs: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each document (terms, counts): examples (places) of the k highest cosines above 0, ties by place; and how many blocks were scored.

        The terms are those of the examples' vocabulary; the cosine is that of the space they span, to twelve digits. `without` leaves an example
        out for each document.
        """
        out = []
        for i in range(0, len(docs), 64):
            part = docs[i:i + 64]
            weights = []
            share = np.zeros((len(part), len(self.full)))
            for j, (terms, counts) in enumerate(part):
                weight = (1 + np.log(counts)) * self.idf[terms]
                norm = np.sqrt((weight ** 2).sum())
                weights.append(weight / norm if norm else weight)
                row = self.row[terms]
                share[j, row[row >= 0]] = weights[-1][row >= 0]
            scores = share @ self.full
            for j, (terms, _) in enumerate(part):
                listed = self.row[terms] < 0
                out.append(self._best(scores[j], terms[listed], weights[j][listed], k, without[i + j] if without else -1))
        return out

    def _best(self, scores: np.ndarray, terms: np.ndarray, weight: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray, int]:
        entries, term = self._ranges(self.entry[terms], self.entry[terms + 1])
        block, ours = self.block[entries], weight[term]
        bounds = np.maximum.reduceat(scores, np.arange(0, self.n, BLOCK)) + np.bincount(block, ours * self.most[entries], minlength=self.blocks)
        bounds = bounds * (1 + 1e-9) + 1e-12
        done, least = np.zeros(self.blocks, bool), 0.0
        seen = np.zeros(self.n)  # cosines of the blocks scored so far
        by_bound = np.argsort(-bounds, kind="stable")
        sure = by_bound[:-(-2 * k // BLOCK) + 1]  # enough blocks for a first threshold
        for chosen in (sure, None):
            if chosen is None:
                chosen = np.flatnonzero((bounds >= least) & (bounds > 1e-12) & ~done)
            take = np.zeros(self.blocks, bool)
            take[chosen] = True
            done |= take
            mine = take[block]
            postings, entry = self._ranges(self.start[entries[mine]], self.start[entries[mine] + 1])
            scores = scores + np.bincount(self.at[postings], self.weight[postings] * ours[mine][entry], minlength=self.n)
            inside = np.repeat(done, BLOCK)[:self.n]
            seen[inside] = np.round(scores[inside], 12)
            if without >= 0:
                seen[without] = 0
            if self.n > k:
                least = np.partition(seen, self.n - k)[self.n - k]
        found = np.flatnonzero((seen >= least) & (seen > 0))
        best = found[np.argsort(-seen[found], kind="stable")][:k]
        return best, seen[best], int(done.sum())


@dataclass
class Classifier:
    """What a prediction needs; its size is bounded by `train`."""

    index: Index | None
    numbers: dict[bytes, int]
    keys: list[str]  # of the examples
    labels: np.ndarray
    weights: np.ndarray  # how many labelled texts of its class an example stands for
    prior: float
    k: int
    slope: float = 1.0
    shift: float = 0.0

    def votes(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """The share of toxic among the neighbours; a neighbour counts more the less it is distant."""
        if not len(found):
            return self.prior
        example = self.index.order[found]
        share = self.weights[example] * cosine / (1.05 - np.minimum(cosine, 1))
        # One vote goes to the base rate, so that no share is 0 or 1.
        return float((share @ self.labels[example] + share.mean() * self.prior) / (share.sum() + share.mean()))

    def calibrated(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * np.log(vote / (1 - vote)) + self.shift))))

    def look_up(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(n, c) for w, c in terms_of(raw).items() if (n := self.numbers.get(w)) is not None]
        pairs.sort()
        return np.array([n for n, _ in pairs], np.int64), np.array([c for _, c in pairs], np.float64)


def _platt(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from the votes' log odds to the labels, by Newton's method with a little ridge."""
    x = np.stack([np.log(votes / (1 - votes)), np.ones(len(votes))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ at)))
        slope = x.T @ (weights * (labels - p)) - 0.01 * (at - [1, 0])
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), slope)
        at = at + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(at[0], 0.01)), float(at[1])


def _term_rows(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_blocks(batch):
                found = [sorted(terms_of(raw or b"").items()) for raw in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array([[w for w, _ in f] for f in found], pa.list_(pa.binary())),
                                                  pa.array([[c for _, c in f] for f in found], pa.list_(pa.int64()))], ["key", "words", "counts"])

    return texts.mapInArrow(run, "key string, words array<binary>, counts array<long>")


def _document_counts(docs: DataFrame, text: str, numbers: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many documents there are."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = sent.value, 0
        seen = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for piece in text_blocks(batch):
                for raw in piece.column("text").to_pylist():
                    seen[[n for n in map(known.get, terms_of(raw or b"")) if n is not None]] += 1
                rows += piece.num_rows
        seen[-1] = rows
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], ["term", "docs"])

    out = np.zeros(len(numbers) + 1, np.int64)
    counted = docs.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(run, "term long, docs long")
    for term, n in counted.groupBy("term").agg(F.sum("docs")).collect():
        out[term] = n
    return out[:-1], int(out[-1])


def train(docs: DataFrame, labelled: DataFrame, text: str = "text", sample: int = 4096, postings: int = 1 << 20, k: int = 64) -> Classifier:
    """A classifier from `labelled` (key, toxic: 0 or 1), where key is `text_key` of texts of `docs`.

    Examples: about `sample` labelled texts, half of them of each class (all of a smaller class), chosen by a hash of their text; of these, in
    hash order, as many as have no more than `postings` distinct terms together. These two bound the index. Equal texts are one example with
    the mean of their labels; null labels are ignored. Scores are calibrated on each example's votes by the others. Without any label every
    score is 0.5; with labels of one class only, it is that class with the certainty its number allows.
    """
    spark = docs.sparkSession
    known = labelled.where("toxic is not null").groupBy("key").agg(F.avg(F.col("toxic").cast("double")).alias("label"))
    known = materialise(known.withColumn("class", (F.col("label") >= 0.5).cast("int")).withColumn("at", F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / 2.0 ** 48), "toxicity-labels")
    sizes = {r["class"]: r["count"] for r in known.groupBy("class").count().collect()}
    total = sum(sizes.values())
    prior = (sizes.get(1, 0) + 1) / (total + 2)
    empty = Classifier(None, {}, [], np.zeros(0), np.zeros(0), prior, k)
    if not total:
        return empty
    room = {c: max(sample // 2, sample - sizes.get(1 - c, 0)) for c in sizes}
    below = F.lit(0.0)
    for c, n in sizes.items():
        below = F.when(F.col("class") == c, min(1.0, room[c] / n)).otherwise(below)
    chosen = known.where(F.col("at") < below)
    texts = docs.select(text_key(text).alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    found = texts.join(F.broadcast(chosen.select("key")), "key", "left_semi").groupBy("key").agg(F.any_value("text").alias("text"))
    found = materialise(_term_rows(found), "toxicity-examples")
    sized = found.select("key", F.array_size("words").alias("n")).join(chosen.select("key", "label", "class"), "key").orderBy("key").collect()
    taken, used = [], 0
    for r in sized:
        if r["n"] and used + r["n"] <= postings:
            taken.append(r)
            used += r["n"]
    if not taken:
        return empty
    rows = {r["key"]: r for r in found.join(F.broadcast(spark.createDataFrame([(r["key"],) for r in taken], "key string")), "key").collect()}
    examples = [([bytes(w) for w in rows[r["key"]]["words"]], rows[r["key"]]["counts"]) for r in taken]
    numbers = {w: i for i, w in enumerate(sorted({w for t, _ in examples for w in t}))}
    held, n = _document_counts(docs, text, numbers)
    index = Index(examples, numbers, np.log(1 + n / np.maximum(held, 1)))
    drawn = {c: sum(r["class"] == c for r in taken) for c in sizes}
    weights = np.array([sizes[r["class"]] / drawn[r["class"]] for r in taken])
    model = Classifier(index, numbers, [r["key"] for r in taken], np.array([r["label"] for r in taken]), weights / weights.mean(), prior, k)
    return _calibrate(model, found, spark)


def _calibrate(model: Classifier, examples: DataFrame, spark) -> Classifier:
    """Every example is judged by the others, in tasks; the driver gets one vote per example."""
    place = {key: int(p) for p, key in enumerate(model.keys[i] for i in model.index.order)}
    sent = spark.sparkContext.broadcast((model, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, place = sent.value
        for batch in batches:
            rows = [r for r in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "counts"))) if r[0] in place]
            keys = [r[0] for r in rows]
            docs = [(np.array([model.numbers[w] for w in words], np.int64), np.array(counts, np.float64)) for _, words, counts in rows]
            votes = [model.votes(*found[:2]) for found in model.index.nearest(docs, model.k, [place[key] for key in keys])]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(votes, pa.float64())], ["key", "vote"])

    votes = dict(examples.repartition(32, "key").mapInArrow(run, "key string, vote double").collect())
    model.slope, model.shift = _platt(np.array([votes[key] for key in model.keys]), model.labels, model.weights)
    return model


def predict(docs: DataFrame, model: Classifier, text: str = "text", evidence: int = 3) -> DataFrame:
    """`docs` without the text, with score, predicted, and the nearest examples as evidence (key, cosine, label).

    Every row is scored by its whole text. Null and empty texts, and texts without a term of the examples, get the score of the base rate.
    Repeated rows get equal scores, ids and other columns are carried only; a column named score, predicted or evidence makes way.
    """
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted", "evidence", text.lower())]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shape = pa.list_(pa.struct([("key", pa.string()), ("cosine", pa.float64()), ("label", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for piece in text_blocks(batch):
                scores, shown = [], []
                raws = piece.column("text").to_pylist()
                none = (np.zeros(0, np.int64), np.zeros(0), 0)
                judged = model.index.nearest([model.look_up(raw or b"") for raw in raws], model.k) if model.index is not None else [none] * len(raws)
                for found, cosine, _ in judged:
                    scores.append(model.calibrated(model.votes(found, cosine)) if model.index is not None else 0.5)
                    near = model.index.order[found[:evidence]] if len(found) else []
                    shown.append([{"key": model.keys[i], "cosine": c, "label": float(model.labels[i])} for i, c in zip(near, cosine.tolist())])
                score = np.array(scores)
                yield pa.RecordBatch.from_arrays([*[piece.column(f"c{i}") for i in range(len(names))], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(shown, shape)],
                                                 [*[f"c{i}" for i in range(len(names))], "score", "predicted", "evidence"])

    narrow = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text}`").cast("binary").alias("text"))
    carried = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in narrow.schema if f.name != "text")
    out = narrow.mapInArrow(run, carried + "score double, predicted int, evidence array<struct<key: string, cosine: double, label: double>>")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "score", "predicted", "evidence")
