"""Packing: token sequences of fixed capacity, filled by reciprocal-capacity classes."""

from __future__ import annotations

from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from granary.llm.common import replace
from granary.llm.tokens import encoded
from granary.sources.tables import materialise


@lru_cache(1 << 16)
def cut(n: int, capacity: int, slack: int = 32, short: int = 64) -> tuple[int, ...]:
    """Lengths of a document's pieces: whole sequences, then lengths that fill a slot of capacity / k but for 1/slack of it.

    A rest that would leave more of its slot empty gives one full slot of the next smaller class and goes on; rests
    of at most `short` tokens are never cut.
    """
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        slot = capacity // (capacity // n)
        if n <= short or (slot - n) * slack <= slot:
            out.append(n)
            break
        out.append(capacity // (capacity // n + 1))
        n -= out[-1]
    return tuple(out)


def pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int, keep_ids: bool) -> DataFrame:
    """One row per piece, with its class k (k pieces of it fit a sequence) and its number within task and class."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int, task int, nth long" + (", ids binary" if keep_ids else "")

    def run(batches):
        task, seen = TaskContext.get().partitionId(), {}
        for part, ids in encoded(batches, tokenizer, end):
            rows = []
            for doc, raw in zip(part.column("doc_id").to_pylist(), ids):
                n, start = len(raw) // 4, 0
                for length in cut(n, capacity):
                    k = capacity // length
                    nth = seen[k] = seen.get(k, -1) + 1
                    own = raw[4 * start:4 * (start + length)]
                    rows.append((doc, start, length, crc32(own), n, k, task, nth, own) if keep_ids else (doc, start, length, crc32(own), n, k, task, nth))
                    start += length
            columns = zip(*rows)
            types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()] + [pa.binary()] * keep_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "task", "nth"] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def first_fit(tail: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """(k, rank, bin, offset) for (k, rank, length), longest first into the first bin with room."""
    room: list[int] = []
    out = []
    for k, rank, length in sorted(tail, key=lambda t: (-t[2], t[0], t[1])):
        b = next((i for i, r in enumerate(room) if r >= length), len(room))
        if b == len(room):
            room.append(capacity)
        out.append((k, rank, b, capacity - room[b]))
        room[b] -= length
    return out


def pack(docs: DataFrame, tokenizer: str, end: int, capacity: int = 2048, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of at most `capacity` tokens: harmonic packing.

    Tasks encode texts, cut them (`cut`) and number the pieces of each class k on their own; a piece's rank in its class is
    that number plus the count of the tasks before, so every sequence of class k holds exactly k pieces and only one per class stays
    incomplete. Those last pieces, at most the sum of k-1 over the classes (about 10,000 for 2,048 tokens, whatever the
    input), are packed first-fit together. Only one row per (task, class) is ever ranked in one place.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id (long), offset, and ids (little-endian unsigned 32-bit) if
    `keep_ids`. A null text counts as empty and gives its end id; repeated rows are packed each; extra columns are left out.
    """
    spark = docs.sparkSession
    made = materialise(pieces(docs, tokenizer, end, capacity, keep_ids), "pack-pieces")
    counts = materialise(made.groupBy("k", "task").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    classes = counts.groupBy("k").agg(F.sum("n").alias("all")).withColumn("bins", F.floor(F.col("all") / F.col("k")))
    # One row per class: at most twice the root of the capacity.
    classes = classes.withColumn("first", F.coalesce(F.sum("bins").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    offsets = counts.withColumn("before", earlier).join(classes, "k").select("k", "task", "before", "bins", "first")
    ranked = made.join(offsets, ["k", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    tail = ranked.where("rank >= bins * k").select("k", "rank", "length").collect()  # bounded: see above
    total = classes.agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]
    late = spark.createDataFrame(
        [(k, r, b + total, o) for k, r, b, o in first_fit([tuple(t) for t in tail], capacity)], "k int, rank long, late_id long, late_offset long")
    placed = ranked.join(late, ["k", "rank"], "left")
    placed = placed.withColumn("sequence_id", F.coalesce("late_id", F.col("first") + F.floor(F.col("rank") / F.col("k"))).cast("bigint"))
    inside = W.partitionBy("sequence_id").orderBy("late_offset", "rank").rowsBetween(W.unboundedPreceding, -1)
    out = replace(placed, {"offset": F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("bigint")})
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
