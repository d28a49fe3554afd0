"""Suffix-array dedup: bytes of strings that occur more than once, by column-wise construction over aligned suffixes.

A collection's suffix array is built column by column: each round puts one more symbol before every suffix, sorts by (symbol, rank of
the rest), which is a step through the Burrows-Wheeler transform, and updates the common prefixes of neighbours. Here the collection
is cut into parts that tasks build on their own. Every string of `length` bytes holds one anchor, the k-byte run with the least hash in it, the leftmost if
several; equal strings hold it at the same place. So a string can only equal strings with the same anchor, aligned by it: all occurrences
of one anchor are one collection, its columns run from the right end of the strings to the left, and a string is repeated where the common
prefix with a neighbour reaches `length`. Parts travel as packed bytes through Spark's shuffle files, which are written and read in sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import replace, shuffle_partitions
from granary.llm.shingles import _BYTE, _tables, mix
from granary.llm.tokens import blocks
from granary.sources.tables import materialise

K = 40
OCCURRENCE = np.dtype([("hash", "<u8"), ("at", "<u4"), ("left", "<u2"), ("right", "<u2")])  # window starts at-left to at-right
WINDOW = np.dtype([("a", "<u8"), ("at", "<u4"), ("b", "<u8")])


def _sums(data: np.ndarray) -> np.ndarray:
    power = _tables(len(data) + 1)[0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice, size: int) -> np.ndarray:
    inverse = _tables(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[:len(sums)][starts] + np.uint64(size))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors are the least hashes around, so the hash is mixed again before it is cut into ranges."""
    return ((mix(hashes) >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)


def anchors(raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of all `length`-byte strings of each document: OCCURRENCE rows (`at` within the document), and the document of each."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    begin = np.cumsum(sizes) - sizes
    if len(data) < length:
        return np.zeros(0, OCCURRENCE), np.zeros(0, np.int64)
    sums = _sums(data)
    count = len(data) - K + 1
    hashes = _hashes(sums, slice(0, count), slice(K, K + count), K)
    low = np.uint64((1 << 24) - 1)  # parts are smaller than 16 MB, so a position fits below the hash
    least = (hashes & ~low) | np.arange(count, dtype=np.uint64)
    width, step = length - K + 1, 1
    while 2 * step <= width:  # minimum over 1, 2, 4, ... neighbours
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[:len(least) - (width - step)], least[width - step:])
    anchor = (least & low).astype(np.int64)
    doc = np.repeat(np.arange(len(raw)), np.maximum(sizes - length + 1, 0))
    start = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0), np.maximum(sizes - length + 1, 0)) + begin[doc]
    anchor = anchor[start]
    turn = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
    last = np.append(turn[1:], len(doc)) - 1 if len(turn) else turn
    out = np.zeros(len(turn), OCCURRENCE)
    at = anchor[turn]
    out["hash"], out["at"] = hashes[at], at - begin[doc[turn]]
    out["left"], out["right"] = at - start[turn], at - start[last]
    return out, doc[turn]


def repeated(data: np.ndarray, group: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which aligned strings occur more than once: (occurrence, offset of the start from its anchor) pairs.

    Occurrence i has its anchor at data[at[i]] and owns the strings that start left[i] to right[i] bytes before it; occurrences of one group are compared.
    Column-wise: from the last byte of the strings to the first, one symbol per occurrence and round. `order` is the suffix array of the columns so far,
    sorted by (group, suffix); `common[j]` the common prefix of order[j] and order[j-1]. A column outside an occurrence's own range ends its suffix.
    """
    order = np.argsort(group, kind="stable")
    common = np.zeros(len(order), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    top, bottom = length - int(right.min()) - 1, -int(left.max())
    group_key = group.astype(np.int64) * 512
    for column in range(top, bottom - 1, -1):
        inside = (column >= -left) & (column < length - right)
        symbol = np.where(inside, data[np.where(inside, at + column, 0)].astype(np.int64), 256)
        key = (group_key + symbol)[order]
        step = np.argsort(key, kind="stable")
        key = key[step]
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (key[1:] % 512 < 256)
        grown = np.zeros(len(key), np.int64)
        j = np.flatnonzero(same)
        if len(j):  # neighbours with one symbol: 1 + the least common prefix between their places before
            spans = np.empty(2 * len(j), np.int64)
            spans[::2], spans[1::2] = step[j - 1] + 1, step[j] + 1
            grown[j] = 1 + np.minimum.reduceat(np.append(common, 0), spans)[::2]
        order, common = order[step], grown
        if column <= 0:
            near = np.maximum(common, np.append(common[1:], 0))
            hit = order[near >= length]
            hit = hit[(column >= -left[hit]) & (column <= -right[hit])]
            if len(hit):
                found.append((hit, np.full(len(hit), column)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, end)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def _packed(keys: list[bytes], owner: np.ndarray, bucket: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
    """(bucket, keys, rows per key, rows) of structured `rows`, for each bucket that has any."""
    order = np.lexsort((owner, bucket))
    owner, bucket, rows = owner[order], bucket[order], rows[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
        turn = np.flatnonzero(np.concatenate([[True], owner[a + 1:b] != owner[a:b - 1]]))
        counts = np.diff(np.append(turn, b - a)).astype("<u4")
        yield int(bucket[a]), b"".join(keys[i] for i in owner[a:b][turn].tolist()), counts.tobytes(), rows[a:b].tobytes()


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _unpack(pdf, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (16 bytes each), the key of each row, and the rows of one bucket; rows that came twice count once."""
    keys = np.frombuffer(b"".join(pdf["keys"]), "S16") if len(pdf) else np.zeros(0, "S16")
    raw = np.frombuffer(b"".join(pdf["keys"]), np.uint8).reshape(-1, 16)
    whole = np.ascontiguousarray(raw).view([("x", ">u8"), ("y", ">u8")]).ravel()
    known, number = np.unique(whole, return_inverse=True)
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in pdf["counts"]])
    rows = np.frombuffer(b"".join(pdf["rows"]), dtype)
    owner = np.repeat(number, counts)
    assert len(keys) == len(counts)
    order = np.lexsort((rows[dtype.names[2]], rows["at"], owner, rows[dtype.names[0]]))
    rows, owner = rows[order], owner[order]
    fresh = np.concatenate([[True], (rows[1:] != rows[:-1]) | (owner[1:] != owner[:-1])])
    return known, owner[fresh], rows[fresh]


def _hex(known: np.ndarray, i: int) -> str:
    return known[i].tobytes().hex()


def _by_owner(owner: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    order = np.argsort(owner, kind="stable")
    own = owner[order]
    turn = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])).tolist() if len(own) else []
    return order, list(zip(turn, [*turn[1:], len(own)]))


PACKED = "bucket int, keys binary, counts binary, rows binary"
PACKED_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _scan(length: int, buckets: int, stretch: int = 1 << 19):
    """Texts -> their anchors, packed by bucket of the anchor hash. Longer texts are read in stretches of so many string starts."""
    def run(batches):
        for batch in batches:
            for block in blocks(batch, stretch):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in block.column("text").to_pylist()]
                keys = [bytes.fromhex(k) for k in block.column("key").to_pylist()]
                whole = [i for i, r in enumerate(raw) if len(r) < stretch + length]
                parts = [(whole, [raw[i] for i in whole], 0)] if whole else []
                parts += [([i], [r[o:o + stretch + length - 1]], o) for i, r in enumerate(raw) if len(r) >= stretch + length for o in range(0, len(r) - length + 1, stretch)]
                for which, texts, offset in parts:
                    found, doc = anchors(texts, length)
                    found["at"] += offset
                    bucket = _bucket(found["hash"], buckets)
                    rows = list(_packed([keys[i] for i in which], doc, bucket, found))
                    if rows:
                        yield _batch(rows, PACKED_TYPES, ["bucket", "keys", "counts", "rows"])

    return run


def _shared(hot: int):
    """A bucket of anchors -> per text those that occur more than once; `hot` marks those of more than so many occurrences."""
    def run(pdf):
        import pandas as pd

        known, owner, rows = _unpack(pdf, OCCURRENCE)
        first = np.flatnonzero(np.concatenate([[True], rows["hash"][1:] != rows["hash"][:-1]]))
        often = np.repeat(np.diff(np.append(first, len(rows))), np.diff(np.append(first, len(rows))))
        out = []
        for wanted, flag in (((often > 1) & (often <= hot), False), (often > hot, True)):
            own, part = owner[wanted], rows[wanted]
            order, spans = _by_owner(own)
            own, part = own[order], part[order]
            out.extend((_hex(known, own[a]), flag, part[a:b].tobytes()) for a, b in spans)
        return pd.DataFrame(out, columns=["key", "hot", "rows"])

    return run


SEGMENTS = "bucket int, keys binary, counts binary, rows binary, lengths binary, data binary"


def _segments(length: int, buckets: int):
    """Texts with shared anchors -> per bucket the anchors and the bytes around them, overlapping stretches once."""
    def run(batches):
        for batch in batches:
            for block in blocks(batch, 1 << 20):
                made: dict[int, list] = {}
                for key, text, parts in zip(block.column("key").to_pylist(), block.column("text").to_pylist(), block.column("rows").to_pylist()):
                    rows = np.frombuffer(b"".join(parts), OCCURRENCE)
                    if not len(rows):
                        continue
                    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                    bucket = _bucket(rows["hash"], buckets)
                    order = np.lexsort((rows["at"], bucket))
                    rows, bucket = rows[order], bucket[order]
                    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
                    for a, b in zip(cuts, [*cuts[1:], len(rows)]):
                        own = rows[a:b]
                        at = own["at"].astype(np.int64)
                        low, high = merge_spans(at - own["left"], at - own["right"] + length)
                        made.setdefault(int(bucket[a]), []).append((bytes.fromhex(key), len(own), own.tobytes(), np.array([low, high], "<u4").T.tobytes(),
                                                                    b"".join(raw[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist()))))
                rows_out = [(k, b"".join(v[0] for v in vs), np.array([v[1] for v in vs], "<u4").tobytes(), b"".join(v[2] for v in vs),
                             b"".join(len(v[3]).to_bytes(4, "little") + v[3] for v in vs), b"".join(v[4] for v in vs)) for k, vs in made.items()]
                if rows_out:
                    yield _batch(rows_out, [pa.int32()] + [pa.binary()] * 5, ["bucket", "keys", "counts", "rows", "lengths", "data"])

    return run


def _construct(length: int):
    """A bucket of aligned strings -> per text the stretches that are repeated."""
    def run(pdf):
        import pandas as pd

        keys, owner, rows, where = [], [], [], []
        base, n = 0, 0
        for k, c, r, ls, d in zip(pdf["keys"], pdf["counts"], pdf["rows"], pdf["lengths"], pdf["data"]):
            counts = np.frombuffer(c, "<u4").tolist()
            own = np.frombuffer(r, OCCURRENCE)
            at, first, filled = 0, 0, 0
            for i, count in enumerate(counts):
                size = int.from_bytes(ls[at:at + 4], "little")
                stretch = np.frombuffer(ls[at + 4:at + 4 + size], "<u4").reshape(-1, 2).astype(np.int64)
                at += 4 + size
                begins = base + filled + np.cumsum(stretch[:, 1] - stretch[:, 0]) - (stretch[:, 1] - stretch[:, 0])
                part = own[first:first + count]
                inside = np.searchsorted(stretch[:, 0], part["at"].astype(np.int64) - part["left"], "right") - 1
                where.append(begins[inside] + part["at"] - stretch[inside, 0])
                filled += int((stretch[:, 1] - stretch[:, 0]).sum())
                keys.append(k[16 * i:16 * i + 16])
                owner.append(np.full(count, n))
                n += 1
                first += count
            base += len(d)
            rows.append(own)
        data = np.frombuffer(b"".join(pdf["data"]), np.uint8)
        rows, owner, where = np.concatenate(rows), np.concatenate(owner), np.concatenate(where)
        whole = np.frombuffer(b"".join(keys), [("x", ">u8"), ("y", ">u8")])
        known, number = np.unique(whole, return_inverse=True)
        owner = number[owner]
        _, group = np.unique(rows["hash"], return_inverse=True)
        # A text that was read twice must not repeat itself.
        order = np.lexsort((rows["left"], rows["at"], owner, group))
        rows, owner, where, group = rows[order], owner[order], where[order], group[order]
        fresh = np.concatenate([[True], (rows[1:] != rows[:-1]) | (owner[1:] != owner[:-1])])
        rows, owner, where, group = rows[fresh], owner[fresh], where[fresh], group[fresh]
        i, offset = repeated(data, group, where, rows["left"].astype(np.int64), rows["right"].astype(np.int64), length)
        return _stretches(known, owner[i], rows["at"][i].astype(np.int64) + offset, length)

    return run


def _stretches(known: np.ndarray, owner: np.ndarray, start: np.ndarray, length: int):
    import pandas as pd

    out = []
    order, spans = _by_owner(owner)
    for a, b in spans:
        low, high = merge_spans(start[order[a:b]], start[order[a:b]] + length)
        out.append((_hex(known, owner[order[a]]), np.array([low, high], "<u4").T.tobytes()))
    return pd.DataFrame(out, columns=["key", "spans"])


def _windows(length: int, buckets: int):
    """The exact way for anchors with very many occurrences: 128-bit hashes of their strings, packed by bucket of the hash."""
    def run(batches):
        for batch in batches:
            for block in blocks(batch, 1 << 20):
                for key, text, parts in zip(block.column("key").to_pylist(), block.column("text").to_pylist(), block.column("hot_rows").to_pylist()):
                    rows = np.frombuffer(b"".join(parts), OCCURRENCE)
                    if not len(rows):
                        continue
                    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                    sums, other = _sums(raw), _sums(raw[::-1])
                    count = rows["left"].astype(np.int64) - rows["right"] + 1
                    start = np.repeat(rows["at"].astype(np.int64) - rows["left"], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    made = np.zeros(len(start), WINDOW)
                    made["a"], made["at"] = _hashes(sums, start, start + length, length), start
                    made["b"] = _hashes(other, len(raw) - start - length, len(raw) - start, length)
                    bucket = _bucket(made["a"], buckets)
                    yield _batch(list(_packed([bytes.fromhex(key)], np.zeros(len(start), np.int64), bucket, made)), PACKED_TYPES, ["bucket", "keys", "counts", "rows"])

    return run


def _equal_windows(length: int):
    def run(pdf):
        known, owner, rows = _unpack(pdf, WINDOW)
        order = np.lexsort((rows["b"], rows["a"]))
        rows, owner = rows[order], owner[order]
        same = (rows["a"][1:] == rows["a"][:-1]) & (rows["b"][1:] == rows["b"][:-1])
        hit = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return _stretches(known, owner[hit], rows["at"][hit].astype(np.int64), length)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, the text's sha256, and its first 16 bytes as the key that stands for the text."""
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", sha.alias("sha"), F.substring(sha, 1, 32).alias("key"))


def _removals(docs: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n_bytes, sha, key, copies; cuts: key, n_removed, n_spans, kept_sha256, kept, spans for texts that lose something and have one row)."""
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    keyed = _keyed(docs)
    rows = materialise(keyed.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "sha", "key"), "suffix-rows")
    at = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint"))
    texts = materialise(rows.groupBy("key").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("copies")), "suffix-texts")
    packed = keyed.where(F.octet_length("text") >= length).select("key", "text").mapInArrow(_scan(length, buckets), PACKED)
    shared = packed.groupBy("bucket").applyInPandas(_shared(hot), "key string, hot boolean, rows binary")
    lists = shared.groupBy("key").agg(  # at most two entries a bucket
        F.collect_list(F.when(~F.col("hot"), F.col("rows"))).alias("rows"), F.collect_list(F.when(F.col("hot"), F.col("rows"))).alias("hot_rows"))
    wanted = lists.join(texts, "key")
    # Joined by text and doc_id, so the copies of one text are spread over the tasks; only its first row matches.
    held = keyed.select("key", at.alias("at"), "text").join(wanted, ["key", "at"]).select("key", "copies", "text", "rows", "hot_rows")
    held = materialise(held, "suffix-candidates")
    spans = held.mapInArrow(_segments(length, buckets), SEGMENTS).groupBy("bucket").applyInPandas(_construct(length), "key string, spans binary")
    hot_spans = held.where(F.array_size("hot_rows") > 0).mapInArrow(_windows(length, buckets), PACKED).groupBy("bucket").applyInPandas(
        _equal_windows(length), "key string, spans binary")
    by_text = spans.unionByName(hot_spans).groupBy("key").agg(F.collect_list("spans").alias("spans"))  # at most two a bucket

    def cut(batches):
        for batch in batches:
            out = []
            for key, text, parts in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "spans"))):
                raw = text.encode("utf-8", "surrogatepass")
                both = np.concatenate([np.frombuffer(p, "<u4").reshape(-1, 2) for p in parts]).astype(np.int64)
                low, high = merge_spans(both[:, 0], both[:, 1])
                kept = b"".join(raw[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(raw)]))
                out.append((key, int((high - low).sum()), len(low), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"),
                            [{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist())]))
            if out:
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield _batch(out, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), span], ["key", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    single = held.where("copies = 1").select("key", "text").join(by_text, "key")
    cuts = materialise(single.mapInArrow(cut, "key string, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<struct<start: long, end: long>>"), "suffix-cuts")
    return rows.join(texts.select("key", "copies"), "key"), cuts


def dedup(docs: DataFrame, length: int = 200, hot: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row: every byte goes that a `length`-byte string covers which also starts anywhere else.

    Strings are judged on the input, overlaps count, matches never cross documents; an occurrence in the same document counts. A text that several rows have is
    one text of several copies: if it is long enough all of it goes, and one of it stands for all in the comparisons. An anchor with more than `hot`
    occurrences is not gathered: its strings are compared by 128-bit hashes, spread over all buckets.
    A null text counts as empty; repeated rows are copies; a null doc_id does no harm; extra columns are left out.
    """
    rows, cuts = _removals(docs, length, hot)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    joined = rows.join(cuts.select("key", F.col("n_removed").alias("r"), F.col("n_spans").alias("s"), F.col("kept_sha256").alias("k")), "key", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("r", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("s", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("k", "sha")).alias("kept_sha256"))


def clean(docs: DataFrame, length: int = 200, hot: int = 20_000) -> DataFrame:
    """`docs` with what is left of each text; a character that is cut through goes whole, `n_chars` (if there) follows.

    All rows stay; a text without a repeated string is left as it is, null included.
    """
    rows, cuts = _removals(docs, length, hot)
    gone = rows.where(f"copies > 1 and n_bytes >= {length}").select("key").distinct().withColumn("__kept", F.lit(""))
    changed = cuts.select("key", F.col("kept").alias("__kept")).unionByName(gone).withColumnRenamed("key", "__key")
    sha = F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), 1, 32)
    joined = docs.withColumn("__sha", sha).join(changed, F.col("__sha") == F.col("__key"), "left")
    new = {"text": F.coalesce("__kept", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("__kept").cast(docs.schema["n_chars"].dataType))
    return replace(joined, new).select(*[f"`{c}`" for c in docs.columns])
