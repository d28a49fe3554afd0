"""Nearest-example toxicity against plain loops, and its accuracy on texts that were held out."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import toxicity
from granary.llm.search import terms_of
from tests.llm.test_operators import SCHEMA, corpus, prose

INSULTS = ["fool", "clown", "rotter"]


def labelled_corpus(seed=3, n=500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text, toxic = prose(rng, rng.randint(20, 60)), int(i % 4 == 0)
        if toxic:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
            text = " ".join(words)
        rows.append((i, text, toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = labelled_corpus()
    rows += [(500, None, None), (501, "", 1), (502, rows[0][1], 0), (503, rows[0][1], 1), (None, rows[1][1], 0), (504, "\n ,", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("score", F.lit("clash")).repartition(3)


def labels_of(table, where="true"):
    return table.where(where).select(toxicity.text_key().alias("key"), "toxic")


def test_neighbours_are_those_of_a_full_search(spark, tables):
    rows, table = tables
    model = toxicity.train(table, labels_of(table), sample=10_000, k=7)
    docs = [Counter(terms_of((t or "").encode())) for _, t, _ in rows]
    known = {key: i for i, key in enumerate(model.keys)}
    texts = {hashlib.md5((t or "").encode()).hexdigest(): c for (_, t, y), c in zip(rows, docs) if c and y is not None}
    assert set(known) == set(texts)
    idf = {w: math.log(1 + len(docs) / sum(w in c for c in docs)) for w in model.numbers}

    def unit(c):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    vectors, skipped = {key: unit(c) for key, c in texts.items()}, 0
    for (_, text, _), c in list(zip(rows, docs))[::9]:
        found, cosine, scored = model.index.nearest([model.look_up((text or "").encode())], 7)[0]
        mine = unit(c) if c else {}
        best = sorted((sum(x * v.get(t, 0) for t, x in mine.items()) for v in vectors.values()), reverse=True)[:7]
        assert np.allclose(cosine, [b for b in best if b > 0])
        for place, got in zip(found, cosine):
            assert math.isclose(got, sum(x * vectors[model.keys[model.index.order[place]]].get(t, 0) for t, x in mine.items()), abs_tol=1e-11)
        skipped += model.index.blocks - scored
    assert [model.labels[known[hashlib.md5(rows[0][1].encode()).hexdigest()]]] == [2 / 3]  # equal texts: the mean of 1, 0 and 1


def test_blocks_are_left_out_and_nothing_is_lost():
    """Examples in two languages without a common word: a text of one never scores the blocks of the other."""
    rng = random.Random(8)
    examples = []
    for i in range(1024):
        words = Counter(f"{'ab'[i % 2]}{rng.randrange(200)}".encode() for _ in range(30))
        examples.append((sorted(words), [words[w] for w in sorted(words)]))
    numbers = {w: i for i, w in enumerate(sorted({w for t, _ in examples for w in t}))}
    index = toxicity.Index(examples, numbers, np.ones(len(numbers)))
    for terms, counts in examples[:20]:
        at = np.array([numbers[w] for w in terms])
        found, cosine, scored = index.nearest([(at, np.array(counts, float))], 10)[0]
        assert scored <= index.blocks // 2 + 1 and len(found) == 10 and math.isclose(cosine[0], 1)
        every = index.nearest([(at, np.array(counts, float))], 2000)[0]
        assert np.allclose(every[1][:10], cosine)


def test_held_out_accuracy_and_defined_results(spark, tables):
    rows, table = tables
    train = "coalesce(doc_id, 0) % 5 != 2"
    model = toxicity.train(table, labels_of(table, train))
    got = toxicity.predict(table, model)
    assert got.columns == ["doc_id", "toxic", "score", "predicted", "evidence"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r.predicted == (r["score"] >= 0.5) for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id % 5 == 2 and r.doc_id < 500]
    toxic, clean = [r["score"] for r in held if r.toxic], [r["score"] for r in held if not r.toxic]
    assert sum(a > b for a in toxic for b in clean) / len(toxic) / len(clean) > 0.85
    assert abs(sum(r["score"] for r in held) / len(held) - 0.25) < 0.1  # calibrated
    by_id = {r.doc_id: r for r in found}
    assert by_id[500]["score"] == by_id[501]["score"] == by_id[504]["score"] and not by_id[500].evidence
    assert by_id[502]["score"] == by_id[503]["score"] == by_id[0]["score"]
    assert found[0].evidence[0].cosine >= found[0].evidence[-1].cosine
    again = toxicity.predict(table.repartition(7), toxicity.train(table.repartition(2), labels_of(table, train))).collect()
    assert sorted((str(r.doc_id), r["score"]) for r in again) == sorted((str(r.doc_id), r["score"]) for r in found)


def test_bounds_of_the_sample(spark, tables):
    _, table = tables
    few = toxicity.train(table, labels_of(table), sample=60)
    assert 30 <= len(few.keys) <= 100 and {0.0, 1.0} <= {round(x) * 1.0 for x in few.labels}
    tight = toxicity.train(table, labels_of(table), postings=300)
    assert len(tight.index.at) + np.count_nonzero(tight.index.full) <= 300 and len(tight.keys) > 3


def test_no_labels_one_class_and_nothing(spark, tables):
    _, table = tables
    none = labels_of(table).where("false")
    assert {r["score"] for r in toxicity.predict(table, toxicity.train(table, none)).collect()} == {0.5}
    one = toxicity.predict(table, toxicity.train(table, labels_of(table, "toxic = 0"))).collect()
    assert all(r["score"] < 0.1 for r in one)
    letterless = spark.createDataFrame([(1, "", 1)], "doc_id long, text string, toxic int")
    assert {r["score"] for r in toxicity.predict(table, toxicity.train(letterless, labels_of(letterless))).collect()} == {0.5}
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.predict(empty, toxicity.train(table, labels_of(table))).count() == 0
    long = spark.createDataFrame([(1, "fool " + prose(random.Random(1), 60_000) + "x" * 100_000)], "doc_id long, text string")
    assert toxicity.predict(long, toxicity.train(table, labels_of(table))).first()["score"] < 1
    assert len(corpus()) > 0
