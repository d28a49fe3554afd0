"""Token-id output: documents compressed one by one with a shared zstandard dictionary, in files with an offset index.

File layout (all numbers little-endian): the 8 bytes GRTOKID1; the 32-byte sha256 of the dictionary; the number of documents n as
unsigned 64-bit; n index entries of 40 bytes: doc_id (signed 64), frame offset from the start of the file (64), frame length (32),
crc32 of the ids (32), number of ids (64), a flag that is 1 if doc_id is null (64); then the frames. A frame is the zstandard
frame of one document's ids as unsigned 32-bit. The dictionary stands in its own file, named by its hash.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from granary.llm.tokens import encoded
from granary.sources.tables import materialise, new_path

MAGIC = b"GRTOKID1"
ENTRY, ENTRY_BYTES = "<qQIIQQ", 40
HEAD, HEAD_BYTES = "<8s32sQ", 48
MANIFEST = "path string, task int, dict_sha256 string, docs long, ids long, bytes long"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder: a mounted path, file://, or any store that Arrow knows."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def train_dictionary(docs: DataFrame, tokenizer: str, end: int, samples: int = 2000, chars: int = 4096, size: int = 64 << 10) -> bytes:
    """A zstandard dictionary from about `samples` documents, a window of at most `chars` characters of each.

    Rows are drawn by a hash of id and text that falls below samples / rows, windows start at a hashed place of the whole text; so the sample needs no
    sort and no part of a text is left out by rule. It only serves compression; every document is stored whole. Too few samples give an empty dictionary.
    """
    import zstandard

    filled = docs.where("text is not null")
    rate = min(1.0, samples / max(1, filled.count()))
    place = F.pmod(F.xxhash64(F.lit("window"), "doc_id", "text"), F.greatest(F.lit(1), F.length("text") - chars + 1)) + 1
    drawn = F.pmod(F.xxhash64(F.lit("dictionary"), "doc_id", "text"), F.lit(1 << 32)) < F.lit(int(rate * (1 << 32)))
    picked = filled.where(drawn).select("doc_id", F.substring("text", place.cast("int"), F.lit(chars)).alias("text"))

    def run(batches):
        for _, ids in encoded(batches, tokenizer, end):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    rows = sorted(bytes(r[0]) for r in picked.mapInArrow(run, "ids binary").collect())  # in one order, so that reruns agree
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        return b""


def _codec(dictionary: bytes, level: int = 3):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def write(docs: DataFrame, tokenizer: str, end: int, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write all documents (doc_id, text) in ascending doc_id order; returns the manifest (one row per file) and the folder.

    Rows are range-partitioned by doc_id (nulls first; ties by text), a task writes one file under a name of its own and reports it; only
    reported files count, so a task that runs again or twice does no harm. A null text counts as empty.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-ids")
    dictionary = train_dictionary(docs, tokenizer, end)
    digest, job = hashlib.sha256(dictionary).digest(), uuid.uuid4().hex
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{digest.hex()}.dict") as f:
        f.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, compressor = TaskContext.get().partitionId(), _codec(dictionary)[0]
        entries, frames, at, total = [], [], 0, 0
        for part, ids in encoded(batches, tokenizer, end, job):
            for doc, raw in zip(part.column("doc_id").to_pylist(), ids):
                frame = compressor.compress(raw)
                entries.append((doc, at, len(frame), crc32(raw), len(raw) // 4))
                frames.append(frame)
                at += len(frame)
                total += len(raw) // 4
        if not entries:
            return
        store, root = _open(folder)
        path = f"{root}/part-{task:06d}-{uuid.uuid4().hex}.ids"
        body = HEAD_BYTES + ENTRY_BYTES * len(entries)
        with store.open_output_stream(path) as f:
            f.write(struct.pack(HEAD, MAGIC, digest, len(entries)))
            f.write(b"".join(struct.pack(ENTRY, d or 0, body + o, n, c, k, d is None) for d, o, n, c, k in entries))
            for frame in frames:
                f.write(frame)
        row = (path, task, digest.hex(), len(entries), total, body + at)
        types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = ["path", "task", "dict_sha256", "docs", "ids", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(run, MANIFEST), "token-manifest"), folder


def read_document(folder: str, path: str, row: int) -> np.ndarray:
    """Ids of the document at `row` of one file: the index entry and one frame are read, nothing else."""
    fs, base = _open(folder)
    with fs.open_input_file(path) as f:
        magic, digest, n = struct.unpack(HEAD, f.read_at(HEAD_BYTES, 0))
        if magic != MAGIC or row >= n:
            raise ValueError(f"{path}: no document {row}")
        _, at, length, _, count, _ = struct.unpack(ENTRY, f.read_at(ENTRY_BYTES, HEAD_BYTES + ENTRY_BYTES * row))
        with fs.open_input_file(f"{base}/{digest.hex()}.dict") as d:
            dictionary = d.read()
        raw = _codec(dictionary)[1].decompress(f.read_at(length, at), max_output_size=4 * count)
        return np.frombuffer(raw, "<u4")


def read(spark: SparkSession, manifest: DataFrame, folder: str, keep_ids: bool = True, step: int = 2048) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decompressed from the files of a manifest.

    `start` counts the ids of all documents before, from the totals per file (one row per file). A file whose dictionary or ids do not match
    their hashes fails the read.
    """
    # One row per file: the only thing ordered in one place.
    start = F.coalesce(F.sum("ids").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")
    files = manifest.select("path", "task", "dict_sha256", start)
    files = files.repartition(max(1, manifest.count()), "task")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def run(batches):
        fs, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{base}/{row['dict_sha256']}.dict") as d:
                    dictionary = d.read()
                if hashlib.sha256(dictionary).hexdigest() != row["dict_sha256"]:
                    raise ValueError(f"{folder}: the dictionary was changed")
                decompressor, position = _codec(dictionary)[1], row["base"]
                with fs.open_input_file(row["path"]) as f:
                    magic, digest, n = struct.unpack(HEAD, f.read_at(HEAD_BYTES, 0))
                    if magic != MAGIC or digest.hex() != row["dict_sha256"]:
                        raise ValueError(f"{row['path']}: not a file of this folder")
                    for first in range(0, n, step):
                        count = min(step, n - first)
                        entries = list(struct.iter_unpack(ENTRY, f.read_at(ENTRY_BYTES * count, HEAD_BYTES + ENTRY_BYTES * first)))
                        low = entries[0][1]
                        stored = f.read_at(entries[-1][1] + entries[-1][2] - low, low)
                        out = []
                        for doc, at, length, crc, k, missing in entries:
                            raw = decompressor.decompress(stored[at - low:at - low + length], max_output_size=4 * k)
                            if len(raw) != 4 * k or crc32(raw) != crc:
                                raise ValueError(f"{row['path']}: damaged ids of document {doc}")
                            out.append((None if missing else doc, position, k, crc32(raw), raw) if keep_ids else (None if missing else doc, position, k, crc32(raw)))
                            position += k
                        types = [pa.int64()] * 4 + [pa.binary()] * keep_ids
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return files.mapInArrow(run, schema)
