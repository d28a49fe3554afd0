"""Ranked search against a plain loop over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import search
from tests.llm.test_operators import SCHEMA, corpus

ODD = [(None, "mora lungro"), (None, None), (5, "Zwölf BÄUME don't 12,5 \x7f x\x00y"), (7, "ä" * 40 + " ta"), (8, "mota mota mota"), (8, "mota mota mota"), (9, "\n\n ,,; "), (10, "日本語 mota")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    docs = [(i, Counter(words(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 10 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment_bytes, most_terms, k", [(8 << 20, 1 << 18, 10), (3000, 30, 3), (1, 1 << 18, 10)])
def test_search_is_exact(spark, segment_bytes, most_terms, k):
    rows = [r[:2] for r in corpus(seed=11)] + ODD
    rng = random.Random(2)
    items = [(i, " ".join(rng.sample((rows[rng.randrange(60)][1] or "a").split() * 2, 2)) + " mota. the") for i in range(15)]
    items += [(20, None), (21, ""), (22, "nowhere"), (None, "Zwölf bäume"), (None, "MOTA"), (23, "mota"), (23, "mota"), (24, rows[50][1])]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, score int, ids string").repartition(3)
    asked = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, rank int")
    index = search.build(docs, segment_bytes=segment_bytes)
    got = search.search(index, asked, k=k, most_terms=most_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, items, k)


def segment_of(docs):
    built = search._Builder()
    for i, t in docs:
        built.add(i, t.encode())
    row = {c: v[0] for c, v in built.pack().to_pydict().items()}
    names = {t: j for j, t in enumerate(row["words"].split(b"\n"))}
    return row, names


def test_packing_round_trip_and_skipped_blocks():
    """Every posting comes back; a rare term decides, so most blocks of a frequent term stay packed."""
    rng = random.Random(4)
    docs = [(i, " ".join(["often"] * rng.choice((1, 2, 300 if i == 777 else 1)) + [f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 40))])) for i in range(3000)]
    for i in range(1500, 1515):
        docs[i] = (i, docs[i][1] + " rare often often")
    row, names = segment_of(docs)
    n, total = row["docs"], row["terms"]
    segment = search.Segment(row, names, n, total)
    counts = [Counter(words(t)) for _, t in docs]
    for term, j in names.items():
        found, impact = segment.whole(j)
        held = [i for i, c in enumerate(counts) if c[term.decode()]]
        assert found.tolist() == held
        assert impact.tolist() == [10**9 * counts[i][term.decode()] // (1000 * counts[i][term.decode()] + 8 * (10 + 90 * counts[i].total() * n // total)) for i in held]
        at = np.arange(len(held)) // search.BLOCK
        assert (impact <= segment.bounds[j][at]).all()
    heap, fresh = search.Heap(10), search.Segment(row, names, n, total)
    skipped = search._rank(fresh, [(names[b"rare"], 5000), (names[b"often"], 40)], heap)
    assert skipped >= 20 and len(fresh.lists[names[b"often"]]) >= 23
    assert len(heap.ids) == 10 and set(heap.ids.tolist()) <= set(range(1500, 1515))


def test_long_texts_and_empty_tables(spark):
    text = ("Alpha beta, gamma-" * 40_000) + "end" + "x" * 50_000
    assert search.terms_of(text.encode(), at_once=1000) == Counter({t.encode(): n for t, n in Counter(words(text)).items()})
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert search.search(search.build(none), items).count() == 0
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert search.search(search.build(docs), items.where("item_id = 0")).count() == 0
    assert [r.doc_id for r in search.search(search.build(docs), items).collect()] in ([1], [])


def test_large_figures_do_not_overflow():
    row, names = segment_of([(1, "a b"), (2, "a")])
    segment = search.Segment(row, names, 1 << 61, 1 << 62)
    assert segment.m.tolist() == [10 + 90 * 2 * (1 << 61) // (1 << 62), 10 + 90 * (1 << 61) // (1 << 62)]
    assert isinstance(segment_of([(None, "a")])[0]["nulls"], bytes) and pa.binary() == search._SEGMENT["nulls"]
