"""LM scoring: stupid-backoff scores from count tables that are partitioned by hash and asked once per block of documents.

Every word of a document is followed by a word or by the end mark, so a document of n words has n bigrams and every word is a context exactly
as often as it occurs. A bigram (a, b) scores log(c2(a, b) / c1(a)) if other documents hold it, counts without the document's own, and else
log(0.4 * c1(b) / N) with the count of the whole corpus. Terms are rounded to millionths, so sums do not depend on their order.

Documents stay where they are: they are stored once, in blocks of some megabytes of text, as the block's distinct words and each word's place
among them. A block sends every distinct word and bigram once, as a 64-bit hash with the block's count, to the bucket of that hash, and gets
back how often the other blocks hold it, in the order of the question. Nothing that travels names a document, so what is shuffled follows the
distinct n-grams of the blocks, whatever the number of buckets, and a frequent word or bigram is one entry per block like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import shuffle_partitions
from granary.llm.shingles import mix, word_hashes
from granary.llm.tokens import blocks
from granary.sources.tables import materialise

BACKOFF = 0.4
END = np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

BLOCK = "block long, bytes long, words long, ends long, ids binary, missing binary, counts binary, kinds binary, places binary"
ASKED = "block long, bucket int, grams binary, counts binary"
TOLD = "block long, bucket int, others binary"
SCORES = "doc_id long, n_words long, n_known long, log_score long"


def micro(x) -> np.ndarray:
    """Logarithms in millionths."""
    return np.rint(1e6 * np.log(x)).astype(np.int64)


def _shut(x: np.ndarray) -> bytes:
    """An array of numbers, low bytes before high ones, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _opened(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    """An ascending array as differences; the inverse is the sum modulo 2^64."""
    return np.diff(x, prepend=np.uint64(0))


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


def _pack(block_bytes: int):
    """Texts -> blocks of about so many bytes: ids, number of words per document, distinct words and each word's place among them."""
    def run(batches):
        task, number, size, held = TaskContext.get().partitionId(), 0, 0, []

        def block():
            ids = [i for part, _, _ in held for i in part]
            words, counts = (np.concatenate([part[k] for part in held]) for k in (1, 2))
            kinds, places = np.unique(words, return_inverse=True)
            row = ((task << 32) + number, size, len(words), int((counts > 0).sum()), _shut(np.array([i or 0 for i in ids], "<i8")),
                   _shut(np.array([i is None for i in ids], np.uint8)), _shut(counts.astype("<u4")), _shut(_steps(kinds)), _shut(places.astype("<u4")))
            types = [pa.int64()] * 4 + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for part in blocks(batch, 1 << 20):
                words, counts = word_hashes(part.column("text").to_pylist())
                held.append((part.column("doc_id").to_pylist(), np.maximum(words, np.uint64(2)), counts))
                size += part.column("text").nbytes
                if size >= block_bytes:
                    yield block()
                    number, size, held = number + 1, 0, []
        if held:
            yield block()

    return run


class _Grams:
    """The n-grams of a block. `words`, `seconds`: places of the distinct bigrams' words (the last place is the end mark), in ascending order;
    `bigram`: each word's bigram; `hashes`: of the words, then of the bigrams; `counts`: how often the block holds them."""

    def __init__(self, kinds: bytes, places: bytes, counts: bytes):
        kinds, places, self.sizes = np.cumsum(_opened(kinds, "<u8"), dtype=np.uint64), _opened(places, "<u4").astype(np.int64), _opened(counts, "<u4").astype(np.int64)
        self.n = len(kinds)
        often1 = np.bincount(places, minlength=self.n)
        after = np.append(places[1:], self.n)[:len(places)]
        after[np.cumsum(self.sizes)[self.sizes > 0] - 1] = self.n
        places *= self.n + 1
        places += after
        del after
        pairs, bigram, often2 = np.unique(places, return_inverse=True, return_counts=True)
        del places
        self.bigram = bigram.astype(np.int32)
        del bigram
        self.words, self.seconds = (pairs // (self.n + 1)).astype(np.int32), (pairs % (self.n + 1)).astype(np.int32)
        del pairs
        self.hashes = np.concatenate([kinds, mix(kinds[self.words] * _FACTOR + np.append(kinds, END)[self.seconds])])
        self.counts = np.concatenate([often1, often2])


def _ask(buckets: int):
    """Blocks -> per bucket, the hashes of the block's n-grams in ascending order, and their counts."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = _Grams(row["kinds"], row["places"], row["counts"])
                order = np.argsort(grams.hashes)
                hashes, counts = grams.hashes[order], grams.counts[order].astype("<u4")
                del grams, order
                bucket = ((hashes >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int32)
                first = _cuts(bucket)
                spans = list(zip(first.tolist(), [*first[1:].tolist(), len(bucket)]))
                columns = [pa.array(np.full(len(first), row["block"])), pa.array(bucket[first]), pa.array([_shut(_steps(hashes[a:b])) for a, b in spans], pa.binary()),
                           pa.array([_shut(counts[a:b]) for a, b in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "grams", "counts"])

    return run


def _tell(pdf):
    """One bucket: how often other blocks hold what a block asks for."""
    import pandas as pd

    hashes = [np.cumsum(_opened(x, "<u8"), dtype=np.uint64) for x in pdf["grams"]]
    edges = np.cumsum([0, *map(len, hashes)]).tolist()
    hashes, counts = np.concatenate(hashes), np.concatenate([_opened(x, "<u4") for x in pdf["counts"]]).astype(np.int64)
    order = np.argsort(hashes)
    first = _cuts(hashes[order])
    total = np.add.reduceat(counts[order], first)
    others = np.empty(len(counts), np.int64)
    others[order] = np.repeat(total, np.diff(np.append(first, len(counts))))
    others -= counts
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "others": [_shut(others[a:b]) for a, b in zip(edges, edges[1:])]})


def _score(ends: int, rest: int):
    """One block and the answers to it: the scores of its documents. `ends`: how many documents have words; `rest`: what a miss adds."""
    def run(block, told):
        import pandas as pd

        row = block.iloc[0]
        grams = _Grams(row["kinds"], row["places"], row["counts"])
        total = grams.counts
        if len(told):
            total[np.argsort(grams.hashes)] += np.concatenate([_opened(x, "<i8") for x in told.sort_values("bucket")["others"]])
        c1, c2 = np.append(total[:grams.n], ends), total[grams.n:]
        sizes, wide = grams.sizes, max(1, len(c2))
        own = np.repeat(np.arange(len(sizes)) * wide, sizes)
        own += grams.bigram
        own, own2 = np.unique(own, return_counts=True)
        doc, bigram = (own // wide).astype(np.int32), (own % wide).astype(np.int32)
        del own
        word = grams.words[bigram]
        context = _cuts(doc, word)
        spread = np.diff(np.append(context, len(doc)))
        own1 = np.repeat(np.add.reduceat(own2, context), spread) if len(doc) else own2
        others = c2[bigram] - own2
        hit = others > 0
        term = np.empty(len(doc), np.int64)
        term[hit] = micro(others[hit]) - micro(c1[word[hit]] - own1[hit])
        term[~hit] = micro(c1[grams.seconds[bigram[~hit]]]) + rest
        first = _cuts(doc)
        n_known, micros = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        if len(doc):
            n_known[doc[first]] = np.add.reduceat(np.where(hit, own2, 0), first)
            micros[doc[first]] = np.add.reduceat(own2 * term, first)
        ids = pd.array(_opened(row["ids"], "<i8"), "Int64")
        ids[_opened(row["missing"], "u1") > 0] = pd.NA
        scores = pd.array(np.floor(micros / np.maximum(1, sizes)).astype(np.int64), "Int64")
        scores[sizes == 0] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n_words": sizes, "n_known": n_known, "log_score": scores})

    return run


def score(docs: DataFrame, bucket_bytes: int = 12 << 20, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_known (bigrams that other documents hold), log_score: the mean stupid-backoff score per word in millionths of a nat.

    Words are lower-cased (A-Z) runs without white space. `bucket_bytes` is the text whose n-grams meet in one bucket, `block_bytes` the text whose
    n-grams are asked for together; a task needs some 20 times as much memory. A null text or one without words has n_words 0 and a null
    log_score. Every row is a document of its own; extra columns are left out; an empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    stored = materialise(plain.mapInArrow(_pack(block_bytes), BLOCK), "lm-blocks")
    size, words, ends = stored.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "words", "ends"))).first()
    buckets = max(shuffle_partitions(docs.sparkSession), -(-size // bucket_bytes))
    asked = stored.select("block", "counts", "kinds", "places").mapInArrow(_ask(buckets), ASKED)
    told = asked.groupBy("bucket").applyInPandas(_tell, TOLD)
    rest = int(micro(BACKOFF / max(1, words + ends)))  # every document with words adds its end mark
    return stored.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_score(ends, rest), SCORES)
