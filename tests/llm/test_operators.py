"""The operators against plain Python on small tables with every awkward kind of row."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import granary.llm.queries  # noqa: F401
from granary.llm import fingerprint, jaccard_join, langid, lm_score, mixing, packing, sharding, suffix_dedup, token_files, topk
from granary.llm.common import word_count
from granary.llm.registry import ORACLE, QUERIES
from granary.llm.tokens import Encoder, encoded
from tests.oracle import compare, connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("mo", "ra", "ti", "lun", "gro", "ve", "sha", "pi") for b in ("ta", "ne", "rix", "do", "mel", "ku", "sy")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "", ",", ".")) for _ in range(n))


def corpus(seed=7, n=60):
    """Prose with copies, near copies, shared passages, short and empty texts, nulls in every column, and a long one."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(1, 150))
        if i % 6 == 1 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif i % 6 == 2 and rows:
            words = (rows[rng.randrange(len(rows))][1] or "a").split()
            words[rng.randrange(len(words))] = "edited"
            text = " ".join(words)
        elif i % 6 == 3:
            text = prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20)
        rows.append((i, text, "xx", f"s{i % 4}", len(text)))
    long = prose(rng, 6000)
    rows += [(n, None, None, None, None), (n + 1, "", "xx", "s1", 0), (n + 2, "  \n ", "xx", "s1", 4), (n + 3, "Zwölf Bäume 𝒳 don't 12,5!", "xx", None, 20),
             (n + 4, long, "xx", "s0", len(long)), (n + 5, "a" * 700, "xx", "s2", 700), (n + 6, "one two", "xx", "s3", 7), (n + 7, "ONE two", "xx", "s3", 7)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- mixing


def test_mix_follows_targets(docs):
    got = mixing.mix(docs, word_count("text"), F.lit(1.0)).collect()
    sizes = Counter()
    for r in got:
        assert r["size"] == len(tokens_of(r.text)) and 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
    total = sum(sizes.values())
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, level = set(), 0.0
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if 3 * sizes[s] < weight[s] * level}
        if more == capped:
            break
        capped = more
    for s in names:
        want = 3 * sizes[s] if s in capped else weight[s] * level
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want) < 1e-6 for r in own)
        assert sum(r.taken for r in own) == math.floor(want)
        epochs = math.floor(want / sizes[s])
        assert all(r.taken >= epochs * r["size"] for r in own)
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5), word_count("text"), F.lit(1.0)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mix_prefers_quality(spark):
    rows = [(i, "w " * 10, "xx", "a" if i < 2000 else "b", 0) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    good = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    part = mixing.mix(df, word_count("text"), good, weights=(1, 3)).where("source = 'a'").groupBy(F.col("doc_id") % 2).agg(F.sum("taken")).collect()
    taken = dict(map(tuple, part))
    assert taken[0] > 1.5 * taken[1]


def test_mix_ties_clashes_and_empty(spark, docs, none):
    twice = docs.unionByName(docs).withColumns({"size": F.lit("x"), "target": F.lit("y"), "__n": F.lit(1)})
    got = mixing.mix(twice, word_count("text"), F.lit(None).cast("double"))
    assert got.columns.count("size") == 1 and "__n" in got.columns
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r.taken)
    assert all(len(v) == 2 and v[0] == v[1] for v in by.values())
    assert mixing.mix(none, word_count("text"), F.lit(1.0)).count() == 0
    assert mixing.draw(none, F.lit(1.0)).count() == 0


def test_draw_gives_what_mix_takes(docs):
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, word_count("text"), F.lit(1.0)).collect()}
    drawn = Counter()
    for r in mixing.draw(docs, F.lit(1.0)).collect():
        drawn[r.doc_id] += len(tokens_of(r.text))
    assert drawn == Counter({k: v for k, v in taken.items() if v})


# --- language ID

LANGS = {"aa": ["the", "and", "house", "with", "running", "thought"], "bb": ["der", "und", "haus", "mit", "schlafen", "gedanke"], "cc": ["el", "casa", "corriendo", "pensamiento", "con", "y"]}


def test_language_id_learns_and_rejects(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(LANGS[code]) for _ in range(rng.randint(3, 60))), code, None, 0) for i in range(600) for code in [rng.choice(list(LANGS))]]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(df.where("doc_id % 4 <> 2"))
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "12 -- 34 !"), (1003, "qxzvj wqkxz zzxq jqv xkq qqzj vxw"), (1004, "DER Haus"), (1004, "DER Haus")], "doc_id long, text string")
    got = langid.predict(df.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit("clash")), model).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.doc_id < 1000 and r.doc_id % 4 == 2]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98
    assert not any(r.rejected for r in held)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.lang_pred, r.rejected))
        assert 0 <= r.score <= 1
    assert by[1000] == by[1001] == by[1002] == [("und", True)]
    assert by[1003][0][1] and by[1004] == [("bb", False)] * 2


def test_kneser_ney_sums_to_one():
    counts = Counter()
    for w in ("abab", "abba", "baa", "a"):
        padded = f" {w} "
        for n in range(1, langid.ORDER + 1):
            counts.update(padded[i:i + n] for i in range(len(padded) - n + 1))
    model = langid.kneser_ney(dict(counts))
    probability = {}
    hashes = {}
    for g in counts:
        cp = np.frombuffer(g.encode("utf-32-le"), "<u4").astype(np.uint64)
        hashes[g] = langid._gram_hashes(cp)[len(g) - 1][-1]
    for g, h in hashes.items():
        at = np.searchsorted(model.keys, h)
        if at < len(model.keys) and model.keys[at] == h:
            probability[g] = float(np.exp(model.logp[at]))
    contexts = defaultdict(float)
    seen = defaultdict(set)
    for g, p in probability.items():
        contexts[g[:-1]] += p
        seen[g[:-1]].add(g[-1])
    for h, total in contexts.items():
        unseen = 1 - total
        assert -1e-5 <= unseen < 1, (h, total)


def test_language_id_empty(spark, none):
    model = langid.train(none)
    assert model.languages == []
    assert [r.lang_pred for r in langid.predict(spark.createDataFrame([("a b",)], "text string"), model).collect()] == ["und"]
    assert langid.predict(none, model).count() == 0


@pytest.mark.parametrize("first", range(8))  # about one key in four falls into the calibration quarter
def test_language_id_with_small_languages(spark, first):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(LANGS[code]) for _ in range(rng.randint(3, 60))), code, None, 0) for i in range(200) for code in [rng.choice(["aa", "bb"])]]
    rows += [(1000 + first, "aku po", "one", None, 0), (2000, "12 34", "zxx", None, 0), (2001, "--", "zxx", None, 0), (None, "el casa", "cc", None, 0)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    assert model.languages == ["aa", "bb", "cc", "one"] and np.isfinite(model.limits).all()
    # A character that no model has seen costs alike in all: a small alphabet doesn't draw foreign texts.
    texts = [(0, "aku po aku"), (1, "the house and"), (2, "xxxx жжжж"), (3, "der und haus"), (4, "el casa"), (5, "жжж щщщ ююю")]
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert got[0] == ("one", False) and got[1] == ("aa", False) and got[3] == ("bb", False) and got[4] == ("cc", False)
    assert got[2][1] and got[5][1]


def test_language_id_of_letterless_labels(spark):
    model = langid.train(spark.createDataFrame([(1, "12 34", "zxx", None, 0), (2, None, "aa", None, 0)], SCHEMA))
    assert model.languages == []


# --- sharding


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, fill = (low + high) // 2, 1, 0
        for s in sizes:
            if fill + s > mid:
                n, fill = n + 1, 0
            fill += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


def test_capacity_is_minimal(spark):
    rng = random.Random(5)
    for shards in (1, 3, 7):
        sizes = [rng.randint(1, 60) for _ in range(90)]
        df = spark.createDataFrame(list(enumerate(sizes)), "cell int, size long")
        giants, cuts, cap = sharding.plan(df, shards)
        assert not giants and cap == brute_capacity(sizes, shards)
        edges = [0, *cuts, len(sizes)]
        fills = [sum(sizes[a:b]) for a, b in zip(edges, edges[1:])]
        assert max(fills) <= cap and len(fills) <= shards


def test_shard_keeps_groups_and_slots(docs, none):
    sized = docs.unionByName(docs.where("doc_id = 3")).withColumns({"bytes": F.octet_length("text"), "slot": F.lit(9)})
    got = sharding.shard(sized, "bytes", F.col("text"), "doc_id", shards=5).collect()
    assert len(got) == len(corpus()) + 1
    of, slots = defaultdict(set), defaultdict(list)
    for r in got:
        of[r.text].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert sharding.shard(none.withColumn("bytes", F.lit(1)), "bytes", F.col("text"), "doc_id", shards=5).count() == 0


def test_giant_groups_stand_alone(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}", 10) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, g string, n long"), "n", F.col("g"), "doc_id", shards=10)
    sums = sorted(r[1] for r in got.groupBy("shard").agg(F.sum("n")).collect())
    assert sums[-1] == 10_000 and len(sums) == 10 and sums[0] > 0.9 * sums[-2]


# --- suffix dedup


def brute_removed(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[s:s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - length + 1):
            if seen[r[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_is_exact(spark, hot):
    rows = corpus() + [(3, corpus()[3][1], "xx", "s", 0), (None, "ü" * 150 + "x" + "ü" * 150, None, None, None), (500, "abc" * 90, "xx", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "n_bytes": F.lit("clash")})
    got = sorted(tuple(r) for r in suffix_dedup.dedup(df.repartition(3), 200, hot).select(F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    want = sorted((-1 if r[0] is None else r[0], *b[:4]) for r, b in zip(rows, brute_removed([r[1] for r in rows], 200)))
    assert got == want


def test_long_texts_are_read_in_stretches():
    rng = random.Random(2)
    part = prose(rng, 300)
    keys, texts = ["00" * 16, "11" * 16], [prose(rng, 700) + part + prose(rng, 500), part]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(texts)], ["key", "text"])

    def strings(stretch):
        out = set()
        for b in suffix_dedup._scan(200, 1, stretch)(iter([batch])):
            for row in b.to_pylist():
                found = np.frombuffer(row["rows"], suffix_dedup.OCCURRENCE)
                who = np.repeat(np.arange(len(row["keys"]) // 16), np.frombuffer(row["counts"], "<u4"))
                for i, r in zip(who, found):
                    key = row["keys"][16 * i:16 * i + 16].hex()
                    out |= {(key, int(r["hash"]), int(r["at"]), s) for s in range(int(r["at"]) - int(r["left"]), int(r["at"]) - int(r["right"]) + 1)}
        return out

    assert strings(1 << 19) == strings(300) and len(strings(300)) == sum(len(t.encode()) - 199 for t in texts)


def test_suffix_clean_keeps_columns(spark, docs, none):
    got = {r.doc_id: r for r in suffix_dedup.clean(docs).collect()}
    for row, want in zip(corpus(), brute_removed([r[1] for r in corpus()], 200)):
        assert got[row[0]].text == (None if row[1] is None else want[4].decode(errors="ignore"))
        assert got[row[0]].n_chars == (row[4] if want[1] == 0 else len(got[row[0]].text))
    assert suffix_dedup.clean(none).columns == none.columns and suffix_dedup.dedup(none).count() == 0


# --- packing and token files


def ids_of(file, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(file))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


ODD = ["It's 12 o'clock, we'll see", "a\x1cb\x85c\xa0d  e\n\n f", "ÀÉ ß ﬁ Σας İx é", "<|endoftext|> <|startoftext|>", "x" * 3000, "...,,, !!", "\n\t ", "日本語 text", "don’t", " ª º µ ¼ 3²", "​zero　wide"]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_like_whole_texts(file):
    texts = ODD + [r[1] or "" for r in corpus()]
    encoder = Encoder(public_tokenizers.path(file), most=50)
    for part in (texts, texts[::-1], ODD * 2):
        assert [np.frombuffer(b, "<u4").tolist() + [0] for b in encoder.ids(part)] == ids_of(file, part, 0)


def test_pieces_cut_as_arrays_encode_like_whole_texts():
    rng = random.Random(5)
    signs = "ab Z\t\n  \r\x0b\x1c\x85\xa0é1.,-_ɏß·ª²"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + ["", " ", "it's", "日本 x ", ""]
    for most in (5, 1 << 19):
        encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), most=most)
        for part in (texts[:2500], texts[2500:], texts[::-1], [""], []):
            assert [np.frombuffer(b, "<u4").tolist() + [0] for b in encoder.ids(part)] == ids_of("byte_bpe_50k.json", part, 0)


def test_tasks_of_one_job_learn_a_piece_once(monkeypatch):
    learnt, learn = [], Encoder._learn
    monkeypatch.setattr(Encoder, "_learn", lambda self, pieces: learnt.append(len(pieces)) or learn(self, pieces))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["some words and some more words", None, "more"]})
    file = public_tokenizers.path("byte_bpe_50k.json")
    runs = [[x for _, ids in encoded(iter([batch]), file, 0, job) for x in ids] for job in ("a", "a", "b", None)]
    assert learnt == [6, 0, 6, 6] and runs[0] == runs[1] == runs[2] == runs[3]


def test_pack_covers_every_id(spark, docs, none):
    df = docs.unionByName(spark.createDataFrame([(900 + i, t, None, None, None) for i, t in enumerate(ODD)], SCHEMA)).withColumn("rank", F.lit("clash"))
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), 1, 256).collect()
    texts = {r[0]: r[1] for r in corpus()} | {900 + i: t for i, t in enumerate(ODD)}
    want = dict(zip(texts, ids_of("word_bpe_49k.json", texts.values(), 1)))
    pieces, rows = defaultdict(list), defaultdict(list)
    for r in got:
        part = np.frombuffer(r.ids, "<u4")
        assert len(part) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id].append((r.start, part.tolist()))
        rows[r.sequence_id].append((r.offset, r.length))
    assert {k: sum((p for _, p in sorted(v)), []) for k, v in pieces.items()} == want
    for v in rows.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(rows) == list(range(len(rows)))
    assert sum(map(len, want.values())) > 0.97 * 256 * (len(rows) - 2)
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json"), 1).count() == 0


def test_pack_repeated_and_empty_documents(spark):
    df = spark.createDataFrame([(1, None)] * 5000 + [(2, "tree")] * 3, "doc_id long, text string")
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), 1, keep_ids=False)
    row = got.agg(F.sum("length"), F.countDistinct("sequence_id"), F.max(F.col("offset") + F.col("length"))).first()
    assert row[0] >= 5006 and row[1] <= 4 and row[2] <= 2048


def test_token_files_round_trip(spark, docs, none):
    df = docs.unionByName(spark.createDataFrame([(900 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None)], SCHEMA)).repartition(4)
    manifest, folder = token_files.write(df, public_tokenizers.path("byte_bpe_50k.json"), 0)
    got = token_files.read(spark, manifest, folder).orderBy(F.asc_nulls_first("doc_id")).collect()
    texts = [(None, "no id")] + [r[:2] for r in corpus()] + [(900 + i, t) for i, t in enumerate(ODD)]
    start = 0
    for r, (i, _), want in zip(got, texts, ids_of("byte_bpe_50k.json", [t for _, t in texts], 0)):
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(want)) and np.frombuffer(r.ids, "<u4").tolist() == want
        start += len(want)
    first = manifest.orderBy("task").first()
    assert token_files.read_document(folder, first.path, 0).tolist() == ids_of("byte_bpe_50k.json", ["no id"], 0)[0]
    manifest, folder = token_files.write(none, public_tokenizers.path("byte_bpe_50k.json"), 0)
    assert token_files.read(spark, manifest, folder).count() == 0


# --- top-k


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(40)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [1.0]), (None, [1.0] * 6), (0, rows[0][1]), (310, [-1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = defaultdict(list)
    vectors = topk.scaled(df, "vec_id", "embedding")
    for r in topk.top_k(vectors, vectors.where("vec_id % 10 = 0"), 5, query_block=4, block=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints[i] = [math.floor(1024 * x) for x in v]
    want = {}
    for q in [i for i in ints if i % 10 == 0]:
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5]
        want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert got == want
    few = vectors.where("vec_id in (1, 2, 10)")
    assert topk.top_k(few, few.where("vec_id = 10"), 5).count() == 2
    assert topk.top_k(vectors.limit(0), vectors.limit(0), 5).count() == 0


def test_top_k_broadcasts_no_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    ints = {int(i): [int(x) for x in rng.integers(-40, 40, 9)] for i in range(300)}
    vectors = spark.createDataFrame(list(ints.items()), "vec_id long, v array<bigint>")
    plans, store = [], topk.materialise

    def kept(df, tag):
        plans.append(df)
        return store(df, tag)

    monkeypatch.setattr(topk, "materialise", kept)
    monkeypatch.setattr(topk, "SLICE", 7, raising=False)
    out = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 4, parts=3, query_block=4, block=64)
    got = defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == {q: [(i, -s) for s, i in sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:4]] for q in ints if q % 20 == 0}
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for df in [*plans, out]:  # stored vectors are taken for far smaller than they are: the driver may gather ids only
        sent = re.findall(r"BroadcastExchange\nInput \[\d+\]: \[(.*)\]", df._jdf.queryExecution().explainString(mode))
        assert not [x for x in sent if re.search(r"\b(v|s|qs|xs|ids|[qx]_v|[qx]_ids)#", x)]


# --- LM scores


def test_lm_score_matches_brute_force(spark, none):
    rows = [r for r in corpus() if r[0] != 64]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"uid": F.lit(0), "hits": F.lit(0)})
    got = {r.doc_id: tuple(r)[1:] for r in lm_score.score(df.repartition(3)).collect()}
    docs_ = {r[0]: [w.translate({c: c + 32 for c in range(65, 91)}) for w in tokens_of(r[1])] for r in rows}
    c2, c1 = Counter(), Counter()
    own = {}
    for i, w in docs_.items():
        own[i] = Counter(zip(w, w[1:] + [" "]))
        if w:
            c2 += own[i]
            c1.update(w + [" "])
    total = sum(c1.values())
    for i, o in own.items():
        n, hits, s = sum(o.values()), 0, 0
        own1 = Counter()
        for (a, _), k in o.items():
            own1[a] += k
        for (a, b), k in o.items():
            if c2[a, b] > k:
                hits += k
                s += k * (round(1e6 * math.log(c2[a, b] - k)) - round(1e6 * math.log(c1[a] - own1[a])))
            else:
                s += k * (round(1e6 * math.log(c1[b])) + round(1e6 * math.log(0.4 / total)))
        assert got[i] == (n, hits, math.floor(s / n) if n else None), i
    assert lm_score.score(none).count() == 0


def test_lm_score_shuffles_no_more_over_more_buckets(spark):
    """What a document needs used to travel once for each bucket, and there are more buckets the more text there is."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 20000}" for _ in range(60))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def shuffled(bucket_bytes):
        before = written()
        rows = sorted(map(tuple, lm_score.score(df, bucket_bytes=bucket_bytes).collect()))
        return rows, written() - before

    def written():
        time.sleep(1)  # the status store follows the tasks
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    (few, narrow), (many, wide) = shuffled(1 << 30), shuffled(10_000)
    assert few == many and len(few) == 4000
    assert wide < 1.4 * narrow


def test_lm_score_of_texts_without_words(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, " \n"), (None, "")], "doc_id long, text string").coalesce(1)
    assert sorted((tuple(r) for r in lm_score.score(df).collect()), key=str) == [(1, 0, 0, None), (2, 0, 0, None), (3, 0, 0, None), (None, 0, 0, None)]


# --- Jaccard join


def shingle_set(text, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in tokens_of(text)]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_classes(rows, k, num, den):
    sets = [shingle_set(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(s), least[find(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("width", [1024, 2])
def test_jaccard_classes_are_exact(spark, width):
    rng = random.Random(11)
    rows = corpus(seed=2)
    base = prose(rng, 70).split()
    for i in range(60):  # a family whose members differ by more and more edits
        for _ in range(rng.randint(0, 2)):
            base[rng.randrange(len(base))] = rng.choice(WORDS) + "x"
        rows.append((1000 + i, " ".join(base), None, None, None))
    rows.append(rows[5])
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit(0), "component": F.lit("")})
    for k, num in ((4, 85), (5, 80)):
        got = sorted(tuple(r) for r in jaccard_join.classes(df.repartition(3), k, num, 100, width=width).collect())
        assert got == brute_classes(rows, k, num, 100)


def test_tree_finds_all_pairs_across_components():
    rng = np.random.default_rng(4)
    sets, sizes = [], []
    for _ in range(60):
        base = rng.choice(80, 24, replace=False) if not sets or rng.random() < 0.4 else sets[rng.integers(len(sets))]
        x = np.unique(np.concatenate([rng.permutation(base)[:-2], rng.choice(80, 2)])).astype(np.uint64)
        sets.append(x)
        sizes.append(len(x) + int(rng.integers(0, 3)))
    order = sorted(range(60), key=lambda i: sets[i].astype(">u8").tobytes())
    arrays, size = [sets[i] for i in order], np.array([sizes[i] for i in order])
    roots = list(range(60))
    list(jaccard_join.Tree(arrays, size).join(roots, 80, 100, None))

    def top(r, i):
        while r[i] != i:
            i = r[i]
        return i

    plain = list(range(60))
    for i in range(60):
        for j in range(i):
            common = len(set(arrays[i].tolist()) & set(arrays[j].tolist()))
            if 100 * common >= 80 * (size[i] + size[j] - common):
                a, b = top(plain, i), top(plain, j)
                plain[max(a, b)] = min(a, b)
    assert [top(roots, i) for i in range(60)] == [top(plain, i) for i in range(60)]


def test_a_bucket_is_counted_in_little_memory():
    rng = np.random.default_rng(6)
    n, each = 4000, 100
    hashes = rng.integers(0, 1 << 48, (n, each), dtype=np.uint64)
    hashes[1::2, :30] = hashes[::2, :30]  # every two sets share 30 hashes
    raw = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    nodes, sizes, counts = np.arange(n, dtype="<i8").tobytes(), np.full(n, each, "<u4").tobytes(), np.full(n, each, "<u4").tobytes()
    bucket = pd.DataFrame({"bucket": [0], "nodes": [nodes], "labels": [b""], "sizes": [sizes], "counts": [counts], "data": [raw]})
    tracemalloc.start()
    counted = jaccard_join._count()(bucket)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counted["node"].tolist() == list(range(n)) and set(counted["size"]) == {each}
    for node, tokens in zip(counted["node"], counted["tokens"]):
        got = np.frombuffer(tokens, "<u8")
        assert set(jaccard_join.frequency(got).tolist()) == {2} and set((got & jaccard_join.LOW48).tolist()) == set(hashes[node, :30].tolist())
    assert peak < 8 * len(raw)


@pytest.mark.parametrize("width, most", [(1024, 20), (1, 60)])
def test_a_long_text_is_not_sent_once_per_token(spark, monkeypatch, width, most):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(1500)]
    rows = []
    for i in range(3):  # likenesses of about 0.75: hundreds of shared prefix tokens, no link
        words = list(base)
        for j in rng.sample(range(0, 1500, 6), 23):
            words[j] = f"x{i}-{j}"
        rows.append((i, " ".join(words), None, None, None))
    rows.append((3, rows[2][1].replace("w1", "y1", 1), None, None, None))
    sent, join = spark.sparkContext.accumulator(0), jaccard_join._tree_links

    def counting(*args):
        run = join(*args)

        def counted(batches):
            def passed():
                for batch in batches:
                    sent.add(batch.num_rows)
                    yield batch

            return run(passed())

        return counted

    monkeypatch.setattr(jaccard_join, "_tree_links", counting)
    got = sorted(tuple(r) for r in jaccard_join.classes(spark.createDataFrame(rows, SCHEMA), width=width).collect())
    assert got == brute_classes(rows, 5, 80, 100) and [r[2] for r in got] == [0, 1, 2, 2]
    assert 0 < sent.value <= most


def test_keep_one(spark, docs, none):
    kept = jaccard_join.keep_one(docs.unionByName(docs.where("doc_id = 0")))
    want = {r[0] for r in brute_classes(corpus(), 5, 80, 100) if r[0] == r[2]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert kept.columns == docs.columns and jaccard_join.keep_one(none).count() == 0


# --- fingerprints


def test_fingerprints(spark, docs, none):
    got = sorted(fingerprint.fingerprints(docs.repartition(4).withColumns({"own": F.lit(1), "next_text": F.lit(2)})).collect(), key=lambda r: r.doc_id)
    rows = sorted(corpus())
    prints = defaultdict(set)
    for i, (r, row) in enumerate(zip(got, rows)):
        text, follower = row[1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + follower[:half]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (row[0], len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints[text].add(r.fingerprint)
        prints[edited].add(r.edited_fingerprint)
        a, b = ({x[j:j + 16] for j in range(0, len(x), 16)} for x in (r.fingerprint, r.edited_fingerprint))
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprint.fingerprints(none).count() == 0
    assert fingerprint.fingerprints(docs.where("doc_id = 1")).first().near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(9)
    long, short = prose(rng, 4000), None
    short = " ".join(long.split()[500:1300])
    row = spark.createDataFrame([(long, short)], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    got = row.select(fingerprint.containment(F.col("b"), F.col("a")), fingerprint.likeness(F.col("a"), F.col("b")), fingerprint.merge(F.col("a"), F.col("b")) == F.col("a")).first()
    assert got[0] > 0.95 and abs(got[1] - 0.2) < 0.06 and got[2]


# --- queries and pipeline


def test_queries_are_registered():
    assert {int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")} == set(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, root, key):
    assert compare(QUERIES[key](spark, root), connect(root), ORACLE[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, root, key):
    assert QUERIES[key](spark, root).count() > 0


def test_pipeline_against_plain_python(spark, tmp_path):
    """Every stage on its own input, by brute force; the result covers exactly the tokens of the mixed texts."""
    folder = str(tmp_path)
    rows = [r for r in corpus(seed=21) if r[0] != 64]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} >= {60, 61, 62} and len(after) >= len(before) - 6
    before, after = seen["near_duplicates"]
    kept = {r[0] for r in brute_classes([(r.doc_id, r.text) for r in before], 5, 80, 100) if r[0] == r[2]}
    assert {r.doc_id for r in after} == kept
    before, after = seen["repeated_passages"]
    texts = {r.doc_id: r.text for r in after}
    assert texts == {r.doc_id: w[4].decode(errors="ignore") for r, w in zip(before, brute_removed([r.text for r in before], 200))}
    before, after = seen["source_mix"]
    sizes = {r.doc_id: len(tokens_of(r.text)) for r in before}
    taken = Counter()
    for r in after:
        taken[r.doc_id] += len(tokens_of(r.text))
    assert all(n <= 3 * sizes[i] for i, n in taken.items()) and abs(sum(taken.values()) - sum(sizes.values())) < 6
    before, after = seen["packing"]
    assert sum(r.length for r in after) == sum(map(len, ids_of("word_bpe_49k.json", [r.text for r in before], 1)))
