"""Tokenizer alignment against a plain loop over token pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from granary.llm import alignment
from tests.llm.test_operators import SCHEMA, corpus

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["x  two  blanks ", "line\n  next\n\n  \n end\n", " lead", "tab\tand\r\nreturn;\r x", "▁ shown blank", "a <|endoftext|> b <s> </s> <0x41>", "日本語 のテキスト 😀😀 a😀b", "no break 　wide",
       "\x00 nul \x1c\x1d sep", "é combining नमस्ते", "a" * 3000, " " * 70, "\n", "12345 3.14,15", "don't they'll", "x" + " " * 40 + "y", "\x85 next", "👩‍👩‍👧 family"]


def brute(rows):
    """Groups, links and counts of every document by its definition."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters, docs = alignment._byte_letters(), []
    for doc_id, text in rows:
        raw = (" " + text).encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p := b.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for i in ids_b]
        groups = []
        if b"".join(bytes_a) == raw == b"".join(bytes_b):
            i = j = at_a = at_b = 0
            while i < len(ids_a):
                left, right = [], []
                while not left or at_a != at_b:
                    if at_a <= at_b:
                        left.append(ids_a[i])
                        at_a, i = at_a + len(bytes_a[i]), i + 1
                    else:
                        right.append(ids_b[j])
                        at_b, j = at_b + len(bytes_b[j]), j + 1
                groups.append((left, right))
        docs.append((doc_id, groups))
    counts = Counter(p for _, groups in docs for p in {(x, y) for left, right in groups for x in left for y in right})
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, groups in docs:
        links = [(x, y) for left, right in groups for x in left for y in right]
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def awkward():
    rows = [r[:2] for r in corpus(seed=5)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    return rows + [(None, "no id"), (None, "no id"), (3, "three again"), rows[4], rows[4]]


@pytest.mark.parametrize("slice_pairs", [1 << 23, 40])
def test_alignment_is_exact(spark, slice_pairs):
    rows = awkward()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, block string").repartition(5)
    got = alignment.align(table, A, B, slice_pairs=slice_pairs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_small_memory_and_tree(spark, monkeypatch):
    """Forgetting units, early output of partial counts and several tree rounds change nothing."""
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    rows = awkward()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    partial = alignment._partial_counts(table, A, B, flush=50)
    hashes = alignment._distinct_hashes(partial)
    found = {}
    for r in hashes.join(alignment._summed(partial, hashes, 7), "block").collect():
        found.update(zip(np.frombuffer(r["keys"], "<i8").tolist(), np.frombuffer(r["counts"], "<i8").tolist()))
    whole = {}
    for r in alignment.pair_counts(table, A, B).collect():
        whole.update(zip(np.frombuffer(r["keys"], "<i8").tolist(), np.frombuffer(r["counts"], "<i8").tolist()))
    assert found == whole and len(found) > 200
    both = alignment.PairOfTokenizers(A, B)
    keep = alignment._PairCounts(both)
    units = alignment.Units(both, keep, most=10)
    for text in [t for _, t in rows] * 2:
        keep.count(*units.numbers([text]))
    pairs, times = keep.merge()
    assert dict(zip(pairs.tolist(), times.tolist())) == {p: 2 * n for p, n in whole.items()}
    assert units.held <= max(len(t or "") for _, t in rows) * 2 + 12


def test_merging_by_rank_is_that_of_the_file():
    """Every token is reached by its own merge, which is what the proof in `_by_rank` needs; and random Latin texts agree."""
    both = alignment.PairOfTokenizers(A, B)
    assert both.ranked is not None
    tokens = [i for i in range(50_256)]
    assert all(both.ranked._encode_single_piece(both.bytes_a[i]) == [i] for i in tokens)
    rng = random.Random(4)
    letters = [chr(c) for c in range(33, 0x250) if not chr(c).isspace() and c != 0x7F and not 0x80 <= c < 0xA0]
    texts = [" " + " ".join("".join(rng.choice(letters if j % 3 else "etaoinsr'") for _ in range(rng.randrange(1, 14))) for j in range(200)) for _ in range(100)]
    assert [both.ranked.encode_ordinary(t) for t in texts] == [e.ids for e in both.a.encode_batch_fast(texts, add_special_tokens=False)]


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 48, 5000))
    found = alignment.PerfectHash.load(alignment.PerfectHash.of(keys).dump())
    assert sorted(found.numbers(keys).tolist()) == list(range(len(keys)))
    by_number = np.zeros(len(keys), np.int64)
    by_number[found.numbers(keys)] = keys
    blocks = [(b, alignment.block_of(keys) == b) for b in range(alignment.BLOCKS)]
    rows = []
    for b, inside in blocks:
        part = alignment.PerfectHash.of(keys[inside])
        order = np.zeros(inside.sum(), np.int64)
        order[part.numbers(keys[inside])] = keys[inside]
        rows.append((b, part.dump(), order.tobytes(), (order % 97 + 1).tobytes()))
    lookup = alignment.Lookup(rows)
    strange = np.setdiff1d(rng.integers(0, 1 << 48, 5000), keys)
    assert (lookup.counts(keys) == keys % 97 + 1).all() and not lookup.counts(strange).any()


def test_alignment_of_nothing(spark):
    got = alignment.align(spark.createDataFrame([], SCHEMA), A, B)
    assert got.count() == 0 and got.columns[0] == "doc_id"
    assert [tuple(r)[1:] for r in alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_groups_of_long_texts(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abc défgh 日本\n") for _ in range(200_000))
    rows = [(1, text), (2, "x" * 100_000), (3, " " * 100_000 + "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, alignment.align(table, A, B).collect())) == brute(rows)
    groups = alignment.align(table.where("doc_id = 1"), A, B, keep_groups=True).first()
    assert hashlib.sha256(groups["groups"].encode()).hexdigest() == groups["groups_sha256"]
