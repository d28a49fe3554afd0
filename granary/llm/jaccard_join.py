"""N-gram Jaccard join: prefix filtering and a prefix tree over globally ordered sets."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.shingles import mix, sets
from granary.llm.tokens import blocks
from granary.operators.graph import components
from granary.sources.tables import materialise

LOW48 = np.uint64((1 << 48) - 1)
BUCKET_BYTES, LEAST_BUCKETS = 20 << 20, 24  # hashes counted by one task; so many tasks at least
SLICES = 16  # a bucket is counted slice by slice, so its sorts take little memory
ROWS_AT_ONCE, BYTES_AT_ONCE = 1024, 4 << 20  # of an Arrow batch turned into Python objects


def text_digest() -> Column:
    return F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))


class Tree:
    """A prefix tree over sets, each an ascending array of tokens in the global order.

    Sets are numbered in lexicographic order, so a node is a range of numbers. `size` holds the full sizes: tokens no other set
    has are left out of the arrays. Nodes are compressed: one array of tokens for a path without branches.
    """

    def __init__(self, arrays: list[np.ndarray], size: np.ndarray):
        self.arrays, self.size = arrays, size
        self.low, self.high, self.part, self.children, self.rest, self.least = [], [], [], [], [], []
        self.run: list[int] = []  # so many first children (of a leaf: sets) are known to lie in one component
        self._build()

    def _build(self) -> None:
        pending = [(0, len(self.arrays), 0, -1)]
        while pending:
            low, high, depth, parent = pending.pop()
            node = len(self.low)
            if parent >= 0:
                self.children[parent].append(node)
            a, b = self.arrays[low], self.arrays[high - 1]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:n] != b[depth:n])
            common = depth + int(differ[0]) if len(differ) else n
            self.low.append(low)
            self.high.append(high)
            self.part.append(a[depth:common])
            self.children.append([])
            self.run.append(1)
            self.least.append(int(self.size[low:high].min()))
            self.rest.append(max(len(x) for x in self.arrays[low:high]) - common)
            if self.rest[-1]:
                cuts, first = [], low
                while first < high:
                    x = self.arrays[first]
                    last = first + 1
                    if len(x) == common:
                        while last < high and len(self.arrays[last]) == common:
                            last += 1
                    else:
                        while last < high and self.arrays[last][common] == x[common]:
                            last += 1
                    cuts.append((first, last, common, node))
                    first = last
                pending.extend(reversed(cuts))

    def join(self, roots: list[int], num: int, den: int, only: int | None) -> Iterator[tuple[int, int]]:
        """Pairs whose Jaccard likeness is at least num/den, skipping pairs that are connected already.

        `roots` is a union-find forest over the sets and is joined along the way. With `only`, pairs that share an earlier token are left to that token.
        A subtree is left as soon as the overlap so far and the tokens left cannot reach what its smallest set would need.
        """
        def find(i: int) -> int:
            while roots[i] != i:
                roots[i] = roots[roots[i]]
                i = roots[i]
            return i

        def one(node: int) -> bool:
            """All sets of the node are in one component. Once true, it stays true."""
            kids = self.children[node]
            parts = len(kids) or self.high[node] - self.low[node]
            while self.run[node] < parts:
                nxt = self.low[kids[self.run[node]]] if kids else self.low[node] + self.run[node]
                if find(nxt) != find(self.low[node]) or kids and not one(kids[self.run[node]]):
                    return False
                self.run[node] += 1
            return not kids or one(kids[0])

        need = num + den
        for i in range(1, len(self.arrays)):
            x, nx = self.arrays[i], int(self.size[i])
            stack = [(0, 0, 0)]
            while stack:
                node, shared, used = stack.pop()
                if self.low[node] >= i:
                    continue
                mine = find(i)
                if self.high[node] <= i and find(self.low[node]) == mine and one(node):
                    continue
                ahead = len(self.part[node]) + self.rest[node]
                if need * (shared + min(ahead, len(x) - used)) < num * (nx + self.least[node]):
                    continue
                part = self.part[node]
                if len(part):
                    slot = used + np.searchsorted(x[used:], part)
                    hit = part[x[np.minimum(slot, len(x) - 1)] == part] if len(x) else part[:0]
                    if only is not None and len(hit) and int(hit[0]) < only:
                        continue
                    shared += len(hit)
                    used += int(np.searchsorted(x[used:], part[-1], "right"))
                    if need * (shared + min(self.rest[node], len(x) - used)) < num * (nx + self.least[node]):
                        continue
                kids = self.children[node]
                if kids:
                    one(node)  # moves the run of joined children on
                    skip = self.run[node] if find(self.low[kids[0]]) == find(i) and one(kids[0]) else 0
                    stack.extend((k, shared, used) for k in kids[skip:])
                    continue
                for j in range(self.low[node], min(self.high[node], i)):
                    a, b = find(i), find(j)
                    if a != b and need * shared >= num * (nx + int(self.size[j])):
                        roots[max(a, b)] = min(a, b)
                        yield i, j


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, least: int = 2) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of at least `least` rows with equal first `keys` columns, from sorted batches."""
    key, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns)):
                if row[:keys] != key:
                    if len(rows) >= least:
                        yield key, rows
                    key, rows = row[:keys], []
                rows.append(row[keys:])
    if len(rows) >= least:
        yield key, rows


ABLE = pa.schema([("group", pa.int64()), ("node", pa.int64()), ("prefix", pa.int64()), ("rest", pa.int64())])


def _possible(num: int, den: int):
    """(token, pair, node, label, size, rest) rows, sorted by the first two -> those that can have a partner of another label, `group` being a hash of
    all of them: tokens that the same sets have give the same group.

    If the token is the first that two sets share, they share at most 1 + the lesser rest; a pair that shares an earlier one is left to that.
    """
    def run(batches):
        out: list[tuple] = []
        for (token, _), rows in _grouped(batches, 2):
            node, label, size, rest = (np.array(c) for c in zip(*rows))
            able = np.zeros(len(node), bool)
            for at in range(0, len(node), 256):
                some = slice(at, at + 256)
                reach = (num + den) * (1 + np.minimum.outer(rest[some], rest)) >= num * np.add.outer(size[some], size)
                able[some] = (reach & np.not_equal.outer(label[some], label)).any(axis=1)
            node, rest = node[able], rest[able]
            group = int(mix(node.view(np.uint64)).sum().view(np.int64)) if len(node) else 0
            out.extend((group, n, token, r) for n, r in zip(node.tolist(), rest.tolist()))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ABLE)], ABLE.names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ABLE)], ABLE.names)

    return run


def _tree_links(num: int, den: int):
    """(group, first, node, label, size, tokens) rows, sorted by the first two -> links between nodes of different labels. With a token `first`, pairs that
    share an earlier one are left to another group."""
    def run(batches):
        sys.setrecursionlimit(100_000)  # a tree may be as deep as its group is large
        out: list[tuple[int, int]] = []
        for (_, first), rows in _grouped(batches, 2):
            arrays = [np.frombuffer(r[3], "<u8") for r in rows]
            order = sorted(range(len(rows)), key=lambda i: arrays[i].astype(">u8").tobytes())
            label: dict[int, int] = {}
            roots = [label.setdefault(rows[j][1], i) for i, j in enumerate(order)]
            if len(label) < 2:
                continue
            tree = Tree([arrays[j] for j in order], np.array([rows[j][2] for j in order]))
            out.extend((rows[order[i]][0], rows[order[j]][0]) for i, j in tree.join(roots, num, den, None if first is None else first % (1 << 64)))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["src", "dst"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["src", "dst"])

    return run


def _scan(k: int, buckets: int, narrow: bool):
    """Texts -> (doc_id, size, node) rows, or the sets' hashes packed by bucket: one row per block and bucket."""
    def run(batches):
        for batch in batches:
            for block in blocks(batch, 1 << 20):
                found = sets(block.column("text").to_pylist(), k)
                sizes = np.array([len(s) for s in found], np.int64)
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                ends = np.cumsum(sizes)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat), dtype=np.uint64)])
                nodes = mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)
                if narrow:
                    yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("digest"), pa.array(sizes), pa.array(nodes)], ["doc_id", "digest", "size", "node"])
                    continue
                _, first = np.unique(nodes, return_index=True)  # equal sets of a block count once
                fresh = np.zeros(len(nodes), bool)
                fresh[first] = True
                owner = np.repeat(np.arange(len(nodes)), sizes)
                taken = fresh[owner]
                owner, flat = owner[taken], flat[taken]
                bucket = ((flat >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, owner, flat = bucket[order], owner[order], flat[order] >> np.uint64(16)
                packed = np.ascontiguousarray(flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
                rows = []
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
                    own = owner[a:b]
                    turn = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    who = own[turn]
                    counts = np.diff(np.append(turn, b - a)).astype("<u4")
                    rows.append((int(bucket[a]), nodes[who].tobytes(), b"", sizes[who].astype("<u4").tobytes(), counts.tobytes(), packed[a:b].tobytes()))
                if rows:
                    yield _packed_rows(rows)

    return run


PACKED = "bucket int, nodes binary, labels binary, sizes binary, counts binary, data binary"


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["bucket", "nodes", "labels", "sizes", "counts", "data"])


def _arrays(pdf) -> tuple[np.ndarray, ...]:
    """Nodes, labels (the node itself where none were sent), sizes and token counts of packed rows."""
    nodes, sizes, counts = (np.concatenate([np.frombuffer(b, t) for b in pdf[c]]) for c, t in (("nodes", "<i8"), ("sizes", "<u4"), ("counts", "<u4")))
    return nodes, np.concatenate([np.frombuffer(b or a, "<i8") for a, b in zip(pdf["nodes"], pdf["labels"])]), sizes, counts


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about BYTES_AT_ONCE of tokens each, at least one row."""
    filled = np.cumsum(pa.compute.binary_length(batch.column("tokens")).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(filled // BYTES_AT_ONCE)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def _again(buckets: int):
    """Sets (node, label, size, tokens) -> their hashes packed by bucket, as the first scan gives them."""
    def run(batches):
        for part in (p for batch in batches for p in _parts(batch)):
            made: dict[int, list] = {}
            for node, label, size, raw in zip(*(part.column(c).to_pylist() for c in ("node", "label", "size", "tokens"))):
                hashes = np.frombuffer(raw, "<u8") & LOW48
                bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                packed = np.ascontiguousarray(hashes[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() if len(bucket) else []
                for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
                    made.setdefault(int(bucket[a]), []).append((node, label, size, b - a, packed[a:b].tobytes()))
            if made:
                yield _packed_rows([(k, *(np.array(c, t).tobytes() for c, t in zip(list(zip(*v))[:4], ("<i8", "<i8", "<u4", "<u4"))), b"".join(x[4] for x in v)) for k, v in made.items()])

    return run


COUNTED = "node long, label long, size long, tokens binary"


def _shared(raw: np.ndarray, owner: np.ndarray, label_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (rows of 6 bytes) with the sets that have them -> tokens that sets of at least two labels have, and the set of each."""
    hashes = np.zeros((len(raw), 8), np.uint8)
    hashes[:, :6] = raw
    hashes = hashes.view("<u8").ravel()
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
    hashes, owner = hashes[fresh], owner[fresh]
    label = label_of[owner]
    turn = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    first = np.flatnonzero(turn)
    often = np.add.reduceat((turn | np.concatenate([[True], label[1:] != label[:-1]])).astype(np.int64), first)
    members = np.diff(np.append(first, len(hashes)))
    # Frequencies from 2^15 on are stored by their logarithm; that keeps their order. They count sets, which bounds a token's group.
    ranked = np.where(often > 1, members, 1)
    level = np.where(ranked < 32768, ranked, 32768 + np.minimum(32767, (1024 * np.log2(np.maximum(ranked, 32768) / 32768)).astype(np.int64)))
    level = np.repeat(level, members).astype(np.uint64)
    shared = level > 1
    return (level[shared] << np.uint64(48)) | hashes[shared], owner[shared]


def _count():
    """One bucket of hashes: those that sets of at least two labels have, given back as frequency (16 bits) and hash (48), the global order;
    one row per set."""
    def run(pdf):
        import pandas as pd

        nodes, labels, sizes, counts = _arrays(pdf)
        raw = np.frombuffer(b"".join(pdf.pop("data")), np.uint8).reshape(-1, 6)
        known, first, number = np.unique(nodes, return_index=True, return_inverse=True)
        size_of, label_of = sizes[first], labels[first]
        # Sets are numbered by label, so sorting by number keeps a label's sets together.
        by_label = np.lexsort((known, label_of))
        known, size_of, label_of = known[by_label], size_of[by_label], label_of[by_label]
        place = np.empty(len(known), np.int32)
        place[by_label] = np.arange(len(known), dtype=np.int32)
        owners = np.repeat(place[number], counts)
        part = raw[:, 3] % SLICES  # bits below those that chose the bucket
        found = [_shared(raw[at], owners[at], label_of) for at in (np.flatnonzero(part == i) for i in range(SLICES)) if len(at)]
        del raw, owners, part
        tokens, owner = (np.concatenate(x) for x in zip(*found))
        del found
        order = np.argsort(owner, kind="stable")
        raw, owner = memoryview(tokens[order].astype("<u8").tobytes()), owner[order]
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        who = owner[cuts]
        edges = (8 * np.append(cuts, len(owner))).tolist()
        return pd.DataFrame({"node": known[who], "label": label_of[who], "size": size_of[who].astype(np.int64), "tokens": [bytes(raw[a:b]) for a, b in zip(edges, edges[1:])]})

    return run


def frequency(tokens: np.ndarray) -> np.ndarray:
    """About how many sets have each token."""
    level = (tokens >> np.uint64(48)).astype(np.int64)
    return np.where(level < 32768, level, (32768 * 2 ** (np.maximum(level - 32768, 0) / 1024)).astype(np.int64))


SETS = "node long, label long, size long, tokens binary, prefix array<long>, salt array<int>, blocks array<int>"


def _survivors(num: int, den: int, width: int):
    """(node, label, size, tokens) rows sorted by node, a row per bucket that counted: the sets that may have a partner of another label, with their shared tokens in global order and the salted groups of their prefix.

    A partner of a set of n tokens shares at least num/den of n, so one of the first n - that + 1 tokens in any global order. Tokens no other label
    has come first and cannot be shared; what is left of the prefix are the group tokens.
    """
    def run(batches):
        schema = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("size", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64())),
                            ("salt", pa.list_(pa.int32())), ("blocks", pa.list_(pa.int32()))])
        out = []
        for (node,), rows in _grouped(batches, 1, least=1):
            label, size = rows[0][:2]
            tokens = np.sort(np.frombuffer(b"".join(r[2] for r in rows), "<u8"))
            prefix = len(tokens) - -(-num * size // den) + 1
            if prefix > 0:
                group = tokens[:prefix]
                many = -(-frequency(group) // width)
                salts = (mix(group ^ np.uint64(node % (1 << 64))) >> np.uint64(33)).astype(np.int64) % many
                out.append((node, label, size, tokens.tobytes(), group.view(np.int64).tolist(), salts.tolist(), many.tolist()))
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema.names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema.names)

    return run


def _labelled(docs: DataFrame, words: int, num: int, den: int, width: int, first_groups: int, bucket_bytes: int) -> DataFrame:
    """doc_id, digest (of the text), size and class of every row; see `classes`. Rows of one class are linked, an empty set has none."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest().alias("digest"), "text")
    narrow = materialise(plain.mapInArrow(_scan(words, 1, True), "doc_id long, digest string, size long, node long"), "join-docs")
    tokens = narrow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-6 * tokens // bucket_bytes))  # a bucket's arrays are held by one task
    packed = plain.select("text").mapInArrow(_scan(words, buckets, False), PACKED)

    def ordered(hashes: DataFrame, tag: str) -> DataFrame:
        counted = hashes.groupBy("bucket").applyInPandas(_count(), COUNTED)
        return materialise(counted.repartition("node").sortWithinPartitions("node").mapInArrow(_survivors(num, den, width), SETS), tag)

    def places(sets_: DataFrame) -> DataFrame:
        """One narrow row per set and prefix token; `rest` is how many of its tokens come after this one in the global order."""
        rows = sets_.select("node", "label", "size", (F.col("size") - F.octet_length("tokens") / 8).cast("bigint").alias("alone"), F.array_size("prefix").alias("n"),
                            F.posexplode(F.arrays_zip("prefix", "salt", "blocks")).alias("i", "g"))
        return rows.select("node", "label", "size", (F.col("size") - 1 - F.col("alone") - F.col("i")).alias("rest"), "i", "n", "g.prefix", "g.salt", "g.blocks")

    def groups(rows: DataFrame) -> DataFrame:
        """(group, node, first, rest): sets that share a token and can have a partner of another label; tokens of the same sets make one group, its first."""
        rows = rows.select("prefix", "pair", "node", "label", "size", "rest")
        able = rows.repartition("prefix", "pair").sortWithinPartitions("prefix", "pair").mapInArrow(_possible(num, den), "group long, node long, prefix long, rest long")
        # A set's first token is the one with most tokens behind it.
        return able.groupBy("group", "node").agg(F.max(F.struct("rest", "prefix")).alias("r")).select("group", "node", F.col("r.prefix").alias("first"), F.col("r.rest").alias("rest"))

    def whole(groups_: DataFrame) -> DataFrame:
        """Groups joined without regard to tokens that come first."""
        return groups_.withColumns({"first": F.lit(None).cast("bigint"), "rest": F.lit(None).cast("bigint")})

    def families(groups_: DataFrame, sets_: DataFrame) -> DataFrame:
        """Groups that overlap as one, where all their sets fit into one task; a set then travels once, not once per group."""
        groups_ = materialise(groups_, "join-able")
        least = groups_.groupBy("group").agg(F.min("node").alias("least"))
        family = materialise(components(groups_.join(least, "group").select(F.col("node").alias("src"), F.col("least").alias("dst"))), "join-families")
        held = family.join(sets_.select("node", F.octet_length("tokens").alias("bytes")), "node").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
        fits = (F.col("n") <= width) & (F.col("bytes") <= bucket_bytes)
        small = family.join(held.where(fits).select("component"), "component").select(F.col("component").alias("group"), "node")
        large = family.join(held.where(~fits).select("component"), "component").select("node")
        return whole(small).unionByName(groups_.join(large, "node", "left_semi"))

    def links(groups_: DataFrame, sets_: DataFrame, tag: str) -> DataFrame:
        """Links between sets of different labels found in groups; sets travel only to groups where they can have a partner."""
        # Where a pair only counts at its first shared token, the tokens before this one are not needed.
        sent = F.when(F.col("first").isNull(), F.col("tokens")).otherwise(F.expr("substring(tokens, -8 * (rest + 1))"))
        full = groups_.join(sets_.select("node", "label", "size", "tokens"), "node").select("group", "first", "node", "label", "size", sent.alias("tokens"))
        return materialise(full.repartition("group").sortWithinPartitions("group", "first").mapInArrow(_tree_links(num, den), "src long, dst long"), tag)

    sets_, half = ordered(packed, "join-sets"), first_groups // 2
    some = places(sets_).where((F.col("i") < half) | (F.col("i") >= F.col("n") - half)).withColumn("pair", F.col("salt"))
    label = materialise(components(links(whole(groups(some)), sets_, "join-links")), "join-labels")
    named = sets_.select("node", "size", "tokens").join(label, "node", "left").select("node", F.coalesce("component", "node").alias("label"), "size", "tokens")
    rest = ordered(named.mapInArrow(_again(buckets), PACKED), "join-open")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, F.col("salt")) * F.col("blocks") + F.greatest(j, F.col("salt")))
    more = links(families(groups(places(rest).withColumn("pair", F.explode(pair))), rest), rest, "join-more")
    if not more.isEmpty():  # links between components: contract, join, put back
        of = label.select("node", "component")
        ends = more.join(of.toDF("src", "a"), "src", "left").join(of.toDF("dst", "b"), "dst", "left")
        upper = materialise(components(ends.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))), "join-upper")
        known = label.select("node", "component").unionByName(upper.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("mid"))
        label = known.join(upper.toDF("mid", "top"), "mid", "left").select("node", F.coalesce("top", "mid").alias("component"))
    joined = narrow.join(label.select("node", "component"), "node", "left").withColumn("__class", F.when(F.col("size") > 0, F.coalesce("component", "node")))
    return joined.select("doc_id", "digest", "size", "__class")


def classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, width: int = 1024, first_groups: int = 4,
            bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by a Jaccard likeness of at least num/den over their word runs.

    1. One scan hashes each text's set (64 bits; equal sets are one node). The hashes go to buckets of the hash range, packed as arrays; a bucket
       counts in how many sets each occurs and gives back those of two or more, frequency first: the global order.
    2. Sets whose prefix has a shared token stay. Groups of sets by prefix token are joined by a prefix tree: first by `first_groups` tokens of each set,
       half its rarest and half its commonest prefix tokens, large groups split by salt, which joins most families.
    3. The sets that stayed are counted again, now by component: a token that one component has alone counts as unshared, and few sets stay. Their groups are
       joined by every prefix token, a group of S blocks as its S(S+1)/2 pairs of blocks, so that no pair across components is missed and none within one is compared.
       Tokens that the same sets have make one group, and groups that overlap are joined at once where all their sets fit into one task (`width` sets and
       `bucket_bytes` of tokens); so a long text, which shares hundreds of prefix tokens with the same few others, does not travel once for each.
    4. Links are joined into components; each gets its smallest doc_id.

    A text without words has an empty set and is alone. Repeated rows and texts with equal sets share a component. A null doc_id never names a component: such
    a row shows the smallest doc_id of its component, or null. Rows of one doc_id with different texts may lie in different components. Extra columns are left out.
    Two sets are told apart by 64-bit hashes, words runs by 48 bits within a pair.
    """
    joined = _labelled(docs, words, num, den, width, first_groups, bucket_bytes)
    least = joined.where("__class is not null").groupBy("__class").agg(F.min("doc_id").alias("component_id"))
    named = joined.join(least, "__class", "left")
    return named.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs` without near copies: of each component one row stays, and all rows without words.

    Rows are judged one by one, so a doc_id may have several texts, and rows without doc_id are copies like any other. The row that stays has the
    smallest doc_id (null last), then the smallest digest of its text; of rows with one doc_id and one text one stays.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    found = materialise(_labelled(docs, words, num, den, 1024, 4, BUCKET_BYTES).where("size > 0").select("__class", rank.alias("__row")), "join-rows")
    least = found.groupBy("__class").agg(F.min("__row").alias("__kept"))
    gone = found.join(least, "__class").where("__row <> __kept").select("__row").distinct()
    held = docs.withColumn("__row", F.struct(F.col("doc_id").cast("bigint").isNull().alias("last"), F.col("doc_id").cast("bigint").alias("doc_id"), text_digest().alias("digest")))
    rest = held.join(gone, "__row", "left_anti")
    twice = found.groupBy("__row").count().where("count > 1").select("__row")
    if not twice.isEmpty():
        rest = rest.join(twice, "__row", "left_anti").unionByName(rest.join(twice, "__row", "left_semi").dropDuplicates(["__row"]))
    return rest.select(*[f"`{c}`" for c in docs.columns])
