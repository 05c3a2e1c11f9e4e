"""A score of entailment by word alignment: is a claim stated by a premise, absent from it, or against it?

The words of a claim are aligned to those of the premise in order, by dynamic programming, where equal words count and words with a
common beginning count in part. What the alignment leaves over is told apart: numbers and names that the premise does not have where the
claim has them, negations on one side, words in another order. A softmax over three classes weighs these features; it is fitted by Spark
ML on pairs made from a table of texts: sentences with and without words left out in premises that hold them (entailed), with other numbers, with
a negation put in or taken out, with two words exchanged (contradicted), and sentences of other texts (neutral).

`load_predictor` makes it a model for `verification.nli_verdicts`, in place of a neural one. It knows words and their order, no meanings:
paraphrases count as neutral.

Defined results: a null or empty premise or claim has no aligned word; a claim without words is neutral. Fitting needs texts with sentences of at
least `LEAST_WORDS` words; without any it is an error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.tables import stored, work_dir

CLASSES = ("entailed", "neutral", "contradicted")
FEATURES = (
    "aligned", "known", "order", "missing_words", "missing_numbers", "moved_numbers", "missing_names", "negations", "swapped", "length",
)
#: Words of a claim that pairs are made from, and of it and a premise that are aligned: longer ones are cut to windows, see `features`.
LEAST_WORDS, WINDOW = 5, 400
#: Texts that pairs are made of at most: a documented bound of the labelled sample, taken by the hash of the text.
FIT_TEXTS = 4000
WORDS = re.compile(r"[^\W_]+(?:[.,'’][^\W_]+)*")
#: Words that turn a claim round, in the languages of the tables.
NEGATIONS = frozenset("no not never none nobody nothing neither nor without cannot nicht kein keine nie ohne ne pas jamais sans nunca sin".split())


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


def is_number(word: str) -> bool:
    return word[0].isdigit()


def negates(word: str) -> bool:
    return word in NEGATIONS or word.endswith(("n't", "n’t"))


def likeness(a: str, b: str) -> float:
    """1 for equal words; for words (not numbers) with a common beginning of four letters or more, the share of it."""
    if a == b:
        return 1.0
    if is_number(a) or is_number(b):
        return 0.0
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return same / max(len(a), len(b)) if same >= 4 and 3 * same >= 2 * max(len(a), len(b)) else 0.0


def alignment(claim: list[str], premise: list[str]) -> tuple[float, list[int]]:
    """(worth of the best alignment in order, for each word of the claim its place in the premise or -1); the leftmost such places."""
    table = np.zeros((len(claim) + 1, len(premise) + 1))
    worth = np.zeros((len(claim), len(premise)))
    places: dict[str, list[int]] = {}
    for j, w in enumerate(premise):
        places.setdefault(w[:4] if not is_number(w) else w, []).append(j)
    for i, w in enumerate(claim):
        for j in places.get(w[:4] if not is_number(w) else w, ()):
            worth[i, j] = likeness(w, premise[j])
    for i in range(len(claim) - 1, -1, -1):  # best[i, j]: of claim[i:] and premise[j:]
        taken = np.where(worth[i] > 0, worth[i] + table[i + 1, 1:], 0.0)
        table[i, :-1] = np.maximum(table[i + 1, :-1], np.maximum.accumulate(taken[::-1])[::-1])
    out, j = [-1] * len(claim), 0
    for i in range(len(claim)):
        if table[i, j] > table[i + 1, j] + 1e-12:
            own = np.where(worth[i, j:] > 0, worth[i, j:] + table[i + 1, j + 1 :], 0.0)
            j += int(np.argmax(own >= table[i, j] - 1e-12)) + 1
            out[i] = j - 1
    return float(table[0, 0]), out


def features(premise: str | None, claim: str | None) -> list[float]:
    """The features of a pair, in the order of FEATURES. A long premise is looked at in windows of WINDOW words with half of each shared, the
    best aligned one counts; of a longer claim each part of WINDOW words is, and the parts' features are averaged by words."""
    p, c = words_of(premise), words_of(claim)
    if len(c) > WINDOW:
        parts = [c[k : k + WINDOW] for k in range(0, len(c), WINDOW)]
        weights = [len(x) / len(c) for x in parts]
        return (np.array(weights) @ np.array([_features(p, x) for x in parts])).tolist()
    return _features(p, c)


def _features(premise: list[str], claim: list[str]) -> list[float]:
    if not claim:
        return [0.0] * len(FEATURES)
    low = [w.lower() for w in claim]
    best: tuple[float, list[int], list[str]] = (-1.0, [], [])
    for begin in range(0, max(1, len(premise) - WINDOW // 2), WINDOW // 2):
        window = [w.lower() for w in premise[begin : begin + WINDOW]]
        worth, places = alignment(low, window)
        if worth > best[0]:
            best = (worth, places, window)
    worth, places, window = best
    there = set(window)
    met = [j for j in places if j >= 0]
    span = range(min(met), max(met) + 1) if met else range(0)
    n = len(claim)
    numbers = [k for k, w in enumerate(low) if is_number(w)]
    names = [k for k, w in enumerate(claim) if k and w[0].isupper() and not is_number(w)]
    lost = [k for k in range(n) if places[k] < 0]
    inside = sum(negates(window[j]) for j in span)
    share = lambda found, of: len(found) / len(of) if of else 0.0
    return [
        worth / n,
        share([w for w in low if w in there], low),
        share([j for j in span if j in set(met)], span),
        share([k for k in lost if low[k] not in there and not is_number(low[k])], low),
        share([k for k in numbers if low[k] not in there], numbers),
        share([k for k in numbers if low[k] in there and places[k] < 0], numbers),
        share([k for k in names if low[k] not in there], names),
        float(min(2, abs(sum(map(negates, low)) - inside))),
        float(min(3, sum(low[k] in there and not is_number(low[k]) for k in lost))),
        math.log1p(n) / 5,
    ]


@dataclass(frozen=True)
class Weights:
    """A softmax: a row of weights for each class over FEATURES, and what is added."""

    rows: tuple[tuple[float, ...], ...]
    added: tuple[float, ...]

    def probabilities(self, found: np.ndarray) -> np.ndarray:
        logits = found @ np.array(self.rows).T + np.array(self.added)
        powers = np.exp(logits - logits.max(axis=1, keepdims=True))
        return powers / powers.sum(axis=1, keepdims=True)


def changed(sentence: str, kind: int, salt: int) -> tuple[str, str] | None:
    """(premise, claim) with the claim against it: 0 another number, 1 a negation, 2 two words exchanged."""
    own = sentence.split()
    at = 1 + salt % (len(own) - 2)
    if kind == 0:
        year = str(1100 + salt % 900)
        with_number = [*own[:at], year, *own[at:]]
        return " ".join(with_number), " ".join([*own[:at], str(1100 + (salt + 7) % 900), *own[at:]])
    if kind == 1:
        turned = [*own[:at], "not", *own[at:]]
        return (" ".join(own), " ".join(turned)) if salt % 2 else (" ".join(turned), " ".join(own))
    far = 1 + (at + max(1, len(own) // 3)) % (len(own) - 2)
    if own[at].lower() == own[far].lower() or at == far:
        return None
    swapped = list(own)
    swapped[at], swapped[far] = own[far], own[at]
    return " ".join(own), " ".join(swapped)


def pairs_of(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """premise, claim, label (a place in CLASSES), key: made pairs, six a text that has two sentences or more of LEAST_WORDS words."""
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(key, T.split_sentences(F.col(text)).alias("s"), F.xxhash64(text).alias("h"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        other = "A harbour lies behind the long wall of grey stones."
        for batch in batches:
            out = []
            for k, sentences, salt in zip(batch[key], batch["s"], batch["h"], strict=True):
                fine = [s for s in (sentences if sentences is not None else ()) if LEAST_WORDS <= len(s.split()) <= 60]
                if len(fine) < 2:
                    continue
                salt = int(salt) % (1 << 31)
                one, two = fine[salt % len(fine)], fine[(salt + 1) % len(fine)]
                own = one.split()
                drop = 1 + salt % (len(own) - 1)
                year = str(1100 + salt % 900)
                numbered = " ".join([*own[:drop], year, *own[drop:]])
                out.append((k, f"{two} {one}", one, 0))
                out.append((k, one, " ".join([*own[:drop], *own[drop + 1 :]]), 0))
                out.append((k, numbered, numbered, 0))
                out.append((k, one, other, 1))
                out.append((k, one, two, 1) if one != two else (k, one, other, 1))
                other = two
                for kind_ in range(3):
                    if made := changed(one, kind_, salt + kind_):
                        out.append((k, *made, 2))
            yield pd.DataFrame(out, columns=[key, "premise", "claim", "label"])

    return rows.mapInPandas(make, f"{key} {kind}, premise string, claim string, label int")


def with_features(pairs: DataFrame) -> DataFrame:
    """pairs with the column features, array<double>."""

    @F.pandas_udf("array<double>")
    def found(premise: pd.Series, claim: pd.Series) -> pd.Series:
        return pd.Series([features(p, c) for p, c in zip(premise, claim, strict=True)])

    return pairs.withColumn("features", found("premise", "claim"))


def fitted(texts: DataFrame, key: str = "doc_id", text: str = "text") -> Weights:
    """Weights from pairs of at most FIT_TEXTS texts, taken in the order of a hash."""
    folder = work_dir(texts.sparkSession, "entailment")
    sample = texts.where(F.col(text).isNotNull()).orderBy(F.xxhash64(text, F.lit(5)), key).limit(FIT_TEXTS)
    rows = stored(with_features(pairs_of(sample, key, text)), folder, "pairs")
    if rows.isEmpty():
        raise ValueError("no text has two sentences that pairs can be made of")
    model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=100, labelCol="label", featuresCol="vector").fit(rows.withColumn("vector", array_to_vector("features")))
    return Weights(tuple(map(tuple, model.coefficientMatrix.toArray().tolist())), tuple(model.interceptVector.toArray().tolist()))


def judged(pairs: DataFrame, weights: Weights) -> DataFrame:
    """pairs with a probability for each class and the likeliest one's place, `found`."""

    @F.pandas_udf("array<double>")
    def probabilities(found: pd.Series) -> pd.Series:
        return pd.Series(list(weights.probabilities(np.stack(found.to_list())))) if len(found) else pd.Series([], dtype=object)

    rows = with_features(pairs).withColumn("p", probabilities("features")).drop("features")
    top = F.array_position("p", F.array_max("p")).cast("int") - 1
    return rows.select("*", *[F.col("p")[k].alias(name) for k, name in enumerate(CLASSES)], top.alias("found")).drop("p")


def load_predictor(weights: Weights) -> Callable[[], Callable[[list[tuple[str, str]]], list[float]]]:
    """A loader for `verification.predicted`: the probability that a premise entails a claim."""

    def load():
        def predict(pairs: list[tuple[str, str]]) -> list[float]:
            return weights.probabilities(np.array([features(p, c) for p, c in pairs])).T[0].tolist() if pairs else []

        return predict

    return load
