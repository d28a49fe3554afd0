"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from granary.llm.common import SPACE, rank_in, replace, shuffle_partitions


def shingle_hashes(text: Column, words: int = 5) -> Column:
    """Distinct 64-bit hashes of all runs of `words` words, in ascending order; a shorter text is one run, no word none.

    A-Z are lower-cased. Each word is hashed once, a run is the hash of its word hashes.
    """
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.filter(F.split(lower, SPACE), lambda w: w != "")
    hashed = F.transform(parts, lambda w: F.xxhash64(w))

    def runs(h):
        full = F.transform(F.sequence(F.lit(0), F.array_size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))
        return F.when(F.array_size(h) >= words, full).when(F.array_size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    # The one-element transform binds the word hashes to a name, so that they are computed once.
    return F.array_sort(F.array_distinct(F.get(F.transform(F.array(hashed), runs), F.lit(0))))


def sketch(text: Column, one_in: int = 8, words: int = 5) -> Column:
    """All shingle hashes in the lowest 1/one_in of the hash range, and always the smallest one.

    The threshold is the same for every document, so sketches of parts can be merged by union, and
    containment of a short text in a very long one can be estimated. Null and empty texts give an empty sketch.
    """
    top = -(1 << 63) + (1 << 64) // one_in
    return F.get(F.transform(F.array(shingle_hashes(text, words)), lambda h: F.filter(h, lambda x: (x < top) | (x == F.get(h, F.lit(0))))), F.lit(0))


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the shingle sets, 0 to 1; two empty sketches are alike."""
    both = F.array_size(F.array_intersect(a, b))
    every = F.array_size(a) + F.array_size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a is contained in anything."""
    return F.when(F.array_size(a) == 0, F.lit(1.0)).otherwise(F.array_size(F.array_intersect(a, b)) / F.array_size(a)).cast("double")


def written(hashes: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", buckets_per_partition: int = 4) -> DataFrame:
    """Add next_<column>: the value in the row that follows by `key`; the last row is followed by the first.

    Quantiles of the key (an array as long as there are buckets, whatever the rows) cut the rows into buckets. A bucket's first row
    is also sent to the bucket before it, so one shuffle and a window inside each bucket see every neighbour. Rows with one key
    are ordered by the columns; a null key stands first.
    """
    spark = docs.sparkSession
    at = F.coalesce(F.col(key), F.lit(-(1 << 63)).cast("bigint"))
    count = buckets_per_partition * shuffle_partitions(spark)
    cuts = docs.agg(F.min(at), F.percentile_approx(at, [i / count for i in range(1, count)], 20 * count)).first()
    if cuts[0] is None:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    bounds = sorted({cuts[0], *cuts[1]})
    edges = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    bucket = rank_in(edges, at, len(bounds).bit_length() + 1) - 1
    here = docs.withColumns({"__at": at, "__bucket": bucket})
    first = F.get(edges, F.col("__bucket")) == F.col("__at")
    before = F.when(F.col("__bucket") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("__bucket") - 1)
    # `false` sorts first: the copies from the next bucket stand behind all rows of this one.
    copies = F.when(first, F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("copy")), F.struct(before.alias("b"), F.lit(True).alias("copy"))))
    here = here.withColumn("__to", F.explode(copies.otherwise(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("copy"))))))
    here = here.withColumns({"__b": F.col("__to.b"), "__copy": F.col("__to.copy")})
    order = W.partitionBy("__b").orderBy("__copy", "__at", *columns)
    followed = here.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return followed.where("not __copy").select(*[f"`{c}`" for c in docs.columns], *[f"next_{c}" for c in columns])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = 8, words: int = 5) -> DataFrame:
    """Per document: sketches of its text, of its edited text and of the next document, and how alike they are.

    The edited text ends in the beginning of the next document (ascending key): the last floor(n_chars/2) code points give way to as many
    of its first ones, or all it has. A null text counts as empty. Empty texts have an empty sketch; two of them are alike (1.0).
    Ties on the key are ordered by text. Other columns are left out, so their names cannot clash.
    """
    plain = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    paired = with_next(plain.withColumn("own", sketch(F.col("text"), one_in, words)), ["text", "own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    sketched = paired.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
        F.col("own").alias("__own"), sketch(edited, one_in, words).alias("__edited"), F.col("next_own").alias("__next"))
    return replace(sketched, {"fingerprint": written(F.col("__own")), "edited_fingerprint": written(F.col("__edited")),
                              "near_edited": likeness(F.col("__own"), F.col("__edited")), "near_next": likeness(F.col("__own"), F.col("__next")),
                              "kept_of_edited": containment(F.col("__edited"), F.col("__own"))}).drop("__own", "__edited", "__next")
