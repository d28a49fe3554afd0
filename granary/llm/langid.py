"""Language ID: one interpolated Kneser-Ney character model per language.

A text is its runs of letters, lower-cased; a run is scored with a blank on either side, so contexts end at word borders and equal
words score alike. That makes a text's cross-entropy a sum over its words, each scored once per task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.llm.tokens import blocks
from granary.sources.tables import materialise

ORDER = 4
# A word is a run of letters and marks with a letter in it (categories L and M); the same pattern teaches and predicts.
WORD = r"\p{M}*\p{L}[\p{L}\p{M}]*"
_WORDS = regex.compile(WORD).findall
# The quick pattern differs only in texts with marks, with numbers that are no digits, or beyond the basic plane.
_PLAIN = re.compile(r"[^\W\d_]+").findall
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Nl", "No", "Cs", "Co", "Cn")) + "\U00010000-\U0010FFFF]").search


def words_of(text: str) -> list[str]:
    return _PLAIN(text) if text.isascii() or not _ODD(text) else _WORDS(text)


UNKNOWN = "und"
PERCENTILES, TAIL = (0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999), 1
_PRIME, _MIX = 0x100000001B3, np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(cp: np.ndarray) -> list[np.ndarray]:
    """[n-1][i]: hash of the n code points that end at i (meaningless where i < n-1)."""
    out, acc, power = [], np.zeros(len(cp), np.uint64), 1
    for n in range(ORDER):
        shifted = np.zeros(len(cp), np.uint64)
        shifted[n:] = cp[:len(cp) - n] if n else cp
        acc = acc + (shifted + np.uint64(1)) * np.uint64(power)
        power = (power * _PRIME * _PRIME + 2 * n + 1) % (1 << 64)
        mixed = (acc ^ (acc >> np.uint64(29))) * (_MIX + np.uint64(2 * n))
        out.append(mixed ^ (mixed >> np.uint64(32)))
    return out


def _points(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each behind a blank, closed by a blank; and the position of each word's blank."""
    text = " " + " ".join(words) + " "
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return cp, np.flatnonzero(cp == 32)


@dataclass
class Model:
    """Sorted arrays of n-gram hashes, the log-probability of the last character, and the log-weight of backing off from an n-gram."""
    keys: np.ndarray
    logp: np.ndarray
    back: np.ndarray
    floor: float  # log-probability of a character never seen

    def words(self, hashes: list[np.ndarray], blanks: np.ndarray) -> np.ndarray:
        """Log-probability of each word and the blank behind it."""
        size = len(hashes[0])
        where = np.arange(size)
        depth = where - np.repeat(blanks, np.diff(np.append(blanks, size)))  # characters since the last blank
        order = np.minimum(depth + 1, ORDER)
        order[blanks[1:]] = np.minimum(np.diff(blanks) + 1, ORDER)
        total, open_, weight = np.zeros(size), np.ones(size, bool), np.zeros(size)
        open_[0] = False
        for n in range(ORDER, 0, -1):
            at = np.flatnonzero(open_ & (order >= n))
            slot = np.minimum(np.searchsorted(self.keys, hashes[n - 1][at]), len(self.keys) - 1)
            seen = self.keys[slot] == hashes[n - 1][at]
            hit, miss = at[seen], at[~seen]
            total[hit] = weight[hit] + self.logp[slot[seen]]
            open_[hit] = False
            if n > 1 and len(miss):
                context = hashes[n - 2][miss - 1]
                slot = np.minimum(np.searchsorted(self.keys, context), len(self.keys) - 1)
                weight[miss] += np.where(self.keys[slot] == context, self.back[slot], 0.0)
        total[open_] = weight[open_] + self.floor
        sums = np.add.reduceat(total, blanks[:-1] + 1)
        return sums


def kneser_ney(counts: dict[str, int], alphabet: int | None = None) -> Model:
    """Interpolated Kneser-Ney from raw counts of all n-grams up to ORDER of blank-padded words.

    Below the highest order an n-gram counts the characters seen before it; one that begins a word keeps its raw count.
    `alphabet` is the number of characters there are, the unknown one among them (default: the counted ones and one more). Models that are
    compared must share it, or the one that has seen least finds foreign characters likeliest.
    """
    adjusted: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
    for g, c in counts.items():
        n = len(g)
        if n == ORDER or g[0] == " ":
            adjusted[n][g] = adjusted[n].get(g, 0) + c
        if n > 1 and g[1] != " ":
            adjusted[n - 1][g[1:]] = adjusted[n - 1].get(g[1:], 0) + 1
        elif n == 2:  # the blank that ends a word
            adjusted[1][" "] = adjusted[1].get(" ", 0) + 1
    floor = 1.0 / (alphabet or len(adjusted[1]) + 1)
    probability: dict[str, float] = {"": floor}
    backoff: dict[str, float] = {}
    for n in range(1, ORDER + 1):
        level = adjusted[n]
        values = np.fromiter(level.values(), float, len(level))
        ones, twos = int((values == 1).sum()), int((values == 2).sum())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        sums: dict[str, float] = {}
        kinds: dict[str, int] = {}
        for g, c in level.items():
            h = g[:-1]
            sums[h] = sums.get(h, 0) + c
            kinds[h] = kinds.get(h, 0) + 1
        for h, k in kinds.items():
            backoff[h] = min(1.0, discount * k / sums[h])
        for g, c in level.items():
            h = g[:-1]
            probability[g] = max(c - discount, 0) / sums[h] + backoff[h] * probability.get(g[1:], floor)
    grams = [g for g in probability if g]
    by_length = [[g for g in grams if len(g) == n] for n in range(1, ORDER + 1)]
    keys, logp, back = [], [], []
    for n, group in enumerate(by_length, 1):
        if not group:
            continue
        cp = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        keys.append(_gram_hashes(cp)[n - 1][n - 1::n])
        logp.append(np.log([probability[g] for g in group]))
        back.append(np.log([backoff.get(g, 1.0) for g in group]))
    keys, logp, back = np.concatenate(keys), np.concatenate(logp), np.concatenate(back)
    keys, first = np.unique(keys, return_index=True)
    return Model(keys, logp[first].astype(np.float32), back[first].astype(np.float32), float(np.log(floor * backoff.get("", 1.0))))


class Scorer:
    """Cross-entropies of texts under all models; words are remembered, at most about `most` of them."""

    def __init__(self, models: list[Model], most: int = 1 << 17):
        self.models, self.most = models, most
        self.slot: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(models) + 1), np.float32)

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 1 << 14):
            part = words[i:i + (1 << 14)]
            cp, blanks = _points(part)
            hashes = _gram_hashes(cp)
            start = len(self.slot)
            while start + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for k, model in enumerate(self.models):
                self.table[start:start + len(part), k] = model.words(hashes, blanks)
            self.table[start:start + len(part), -1] = np.diff(blanks)
            self.slot.update(zip(part, range(start, start + len(part))))

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Per text: the cross-entropy in nats per character under each model, and the number of characters (0: no letters)."""
        if len(self.slot) > self.most:
            self.slot.clear()
        cut = [words_of(t.lower()) if t else [] for t in texts]
        self._learn(list(set().union(*cut).difference(self.slot)) if cut else [])
        out = np.zeros((len(texts), len(self.models) + 1))
        for i, words in enumerate(cut):
            if words:
                rows = self.table[np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))]
                out[i] = rows.sum(axis=0, dtype=np.float64)
        out[:, :-1] /= -np.maximum(out[:, -1:], 1)
        return out


@dataclass
class Identifier:
    """Languages in code point order, their models, and the cross-entropy above which a text is rejected."""
    languages: list[str]
    models: list[Model]
    limits: np.ndarray

    def decide(self, scores: np.ndarray) -> list[tuple[str, float, bool]]:
        """(language, score, rejected): lowest cross-entropy, ties to the first; the score is its share of e^(-entropy x min(characters, 50))."""
        out = []
        for row in scores:
            if not row[-1] or not self.models:
                out.append((UNKNOWN, 0.0, True))
                continue
            entropy = row[:-1]
            best = int(entropy.argmin())
            odds = np.exp((entropy[best] - entropy) * min(row[-1], 50.0))
            out.append((self.languages[best], float(1.0 / odds.sum()), bool(entropy[best] > self.limits[best])))
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = 2000, most_grams: int = 200_000, margin: float = 0.75,
          key: str = "doc_id") -> Identifier:
    """Fit on a bounded sample of the labelled rows: about `sample` documents per language (all, if fewer), whole texts.

    A row is in the sample if a hash of its key (of its text, if it has no key) falls below sample / rows of its language, so no language passes through
    one task. Three quarters of the sample make the n-gram counts (the `most_grams` most frequent n-grams per language are kept), one quarter calibrates
    the rejection: a text is rejected if its cross-entropy exceeds a high percentile of its language by more than that exceeds the median, and by at
    least `margin` nats a character. It is the highest of PERCENTILES with TAIL calibration rows above it. A language whose rows don't support
    the last one takes the limit of all languages' rows together, if that is looser; if these are too few as well, the cross-entropy of a guess among
    all characters.
    A language whose sample falls into the calibration quarter alone learns from it instead. Rows without letters or with a null language teach nothing,
    and a label that only such rows have gets no model.
    """
    spark = docs.sparkSession
    own = F.when(F.col(key).isNotNull(), F.xxhash64(F.lit("langid"), F.col(key))).otherwise(F.xxhash64(F.lit("langid"), F.col(text)))
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(own, F.lit(1 << 32)).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    found = dict(rows.groupBy("lang").count().collect())  # one row per language
    if not found:
        return Identifier([], [], np.zeros(0))
    part = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(found.items()) for x in (k, float(sample) / n)]), F.col("lang"))
    picked = materialise(rows.where(F.col("h") < part * float(1 << 32)).select("text", "lang", (F.xxhash64("h") % 4 != 0).alias("fit")), "langid-sample")
    taught = {r.lang for r in picked.where("fit").select("lang").distinct().collect()}
    picked = picked.withColumn("fit", F.col("fit") | ~F.col("lang").isin(*taught))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("w")
    words = picked.where("fit").select("lang", word).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))

    def of_length(n: int):
        cut = F.transform(F.sequence(F.lit(1), F.length("w") + (3 - n)), lambda i: F.substring(padded, i, F.lit(n)))
        return F.when(F.length("w") + 2 >= n, cut).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*[of_length(n) for n in range(1, ORDER + 1)]))
    counted = materialise(words.select("lang", "n", F.explode(grams).alias("g")).groupBy("lang", "g").agg(F.sum("n").alias("n")), "langid-grams")
    alphabet = counted.where(F.length("g") == 1).select("g").distinct().count() + 1
    languages, models = [], []
    for code in sorted(found):
        best = counted.where(F.col("lang") == code).orderBy(F.desc("n"), "g").limit(most_grams).select("g", "n").toPandas()
        if len(best):
            languages.append(code)
            models.append(kneser_ney(dict(zip(best["g"], best["n"].tolist())), alphabet))
    identifier = Identifier(languages, models, np.full(len(languages), np.log(alphabet)))
    shared = spark.sparkContext.broadcast(models)  # at most most_grams entries a language

    def entropies(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for block in blocks(batch):
                scores = scorer.texts(block.column("text").to_pylist())
                own = [languages.index(v) for v in block.column("lang").to_pylist()]
                yield pa.RecordBatch.from_arrays([block.column("lang"), pa.array(scores[np.arange(len(own)), own]), pa.array(scores[:, -1])], ["lang", "h", "n"])

    held = picked.where(~F.col("fit") & F.col("lang").isin(*languages)).select("text", "lang")
    held = materialise(held.mapInArrow(entropies, "lang string, h double, n double").where("n > 0"), "langid-held")

    def limits(rows: DataFrame, *by: str) -> dict:
        """Per group: the limit and whether the last percentile is supported."""
        found = rows.groupBy(*by).agg(F.percentile_approx("h", [0.5, *PERCENTILES], 10000).alias("h"), F.count(F.lit(1)).alias("rows")).collect()
        ranks = [(r, sum(r.rows * (1 - p) >= TAIL - 1e-6 for p in PERCENTILES)) for r in found]
        return {r[0]: (r.h[k] + max(margin, r.h[k] - r.h[0]), k == len(PERCENTILES)) for r, k in ranks if k}

    pooled = limits(held, F.lit(None).alias("lang")).get(None, (np.log(alphabet), False))[0]
    identifier.limits[:] = pooled
    for code, (limit, supported) in limits(held, "lang").items():
        identifier.limits[languages.index(code)] = limit if supported else max(limit, pooled)
    return identifier


def predict(docs: DataFrame, identifier: Identifier, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and rejected. Whole texts are scored; nothing but the text is looked at.

    A null text or one without letters is `und`, score 0, rejected. Rows are scored each on its own, so repeated rows get equal results; columns of the three
    names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(identifier)
    kept = [c for c in docs.columns if c.lower() not in {"lang_pred", "score", "rejected"}]
    plain = docs.select(*[f"`{c}`" for c in kept])
    at = plain.columns.index(text)
    schema = StructType(list(plain.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches):
        model = shared.value
        scorer = Scorer(model.models)
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" if i != at else "text" for i in range(batch.num_columns)])
            for block in blocks(named):
                lang, score, rejected = zip(*model.decide(scorer.texts(block.column("text").to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [*block.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*kept, "lang_pred", "score", "rejected"])

    return plain.mapInArrow(run, schema)
