"""Rows, letters and special strings that an operator must not lose or mistake."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from granary.llm import jaccard_join, langid
from granary.llm.tokens import Encoder
from tests.llm.test_operators import SCHEMA, prose


def test_one_row_of_each_group_stays_with_null_and_shared_ids(spark):
    rng = random.Random(1)
    t, u, v = prose(rng, 80), prose(rng, 80), prose(rng, 80)
    near = t.replace(t.split()[40], "edited", 1)
    rows = [(1, t), (2, t), (2, u), (None, v), (None, v), (None, near), (3, near), (None, u), (4, ""), (4, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, x, "l", f"s{j}", j) for j, (i, x) in enumerate(rows)], SCHEMA)
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(1, t), (2, u), (None, v), (4, ""), (4, ""), (None, None), (None, None)], key=repr)


def test_long_rows_without_id_survive_the_stages(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60)) for i in range(30)] + [(None, prose(rng, 400))] * 2
    docs = spark.createDataFrame([(i, x, "xx", "s", len(x)) for i, x in rows], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = [r.text for r in docs.where("doc_id is null").collect()]
    assert left == [rows[-1][1]]


def test_letters_are_those_of_unicode():
    assert langid.words_of("½ ² ①Ⅳ ٣") == [] and langid.words_of("́̂") == []
    assert langid.words_of("हिन्दी नमस्ते 12½kg naïve") == ["हिन्दी", "नमस्ते", "kg", "naïve"]
    assert langid.words_of("𝒳y don't_x") == ["𝒳y", "don", "t", "x"]


def test_only_letters_make_a_language(spark):
    rng = random.Random(3)
    taught = [(i, prose(rng, 40), "xx") for i in range(40)] + [(100 + i, "हिन्दी में लिखा हुआ पाठ और किताब " * (i % 3 + 1), "hi") for i in range(40)]
    docs = spark.createDataFrame(taught, "doc_id long, text string, lang string")
    model = langid.train(docs)
    asked = spark.createDataFrame([(1, "½ ²"), (2, "①Ⅳ"), (3, None), (4, "हिन्दी में पाठ"), (5, prose(rng, 30)), (6, "́")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(asked, model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "hi", 5: "xx", 6: "und"}


def test_special_strings_are_taken_as_the_library_takes_them():
    texts = ["a <|endoftext|> b", "<|startoftext|><|endoftext|>", "plain", "", "x<|endoftext|", "a<|endoftext|>b <|endoftext|>", "<|ENDOFTEXT|>", "long " * 5000 + "<|endoftext|>"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        file = public_tokenizers.path(name)
        plain = Tokenizer.from_file(file)
        assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(file).ids(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
