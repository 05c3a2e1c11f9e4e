import random
from functools import lru_cache

import numpy as np
import pytest

from tessera.operators import entailment, verification

SYLLABLES = "ba ke li mo nu ra se ti vo wa".split()


def texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    sentence = lambda: " ".join([word().capitalize(), *(word() for _ in range(rng.randint(5, 18)))]) + "."
    return [(k, " ".join(sentence() for _ in range(rng.randint(2, 6)))) for k in range(n)]


@pytest.fixture(scope="module")
def weights(spark):
    return entailment.fitted(spark.createDataFrame(texts(300, 1), "doc_id long, text string"))


def probability(weights, premise, claim):
    return dict(zip(entailment.CLASSES, weights.probabilities(np.array([entailment.features(premise, claim)]))[0].tolist(), strict=True))


def best_worth(claim, premise):
    """The worth of the best alignment, by trying all."""

    @lru_cache(None)
    def best(i, j):
        if i == len(claim):
            return 0.0
        return max([best(i + 1, j), *(entailment.likeness(claim[i], premise[k]) + best(i + 1, k + 1) for k in range(j, len(premise)) if entailment.likeness(claim[i], premise[k]))])

    return best(0, 0)


def test_alignment_against_trying_all():
    rng = random.Random(2)
    words = ["lamp", "lamps", "light", "lights", "lighter", "1948", "1949", "a", "b", "harbour", "harbours"]
    for _ in range(300):
        claim, premise = ([rng.choice(words) for _ in range(rng.randint(0, 7))] for _ in range(2))
        worth, places = entailment.alignment(claim, premise)
        assert worth == pytest.approx(best_worth(tuple(claim), tuple(premise)))
        met = [(i, j) for i, j in enumerate(places) if j >= 0]
        assert all(a[1] < b[1] for a, b in zip(met, met[1:], strict=False))
        assert sum(entailment.likeness(claim[i], premise[j]) for i, j in met) == pytest.approx(worth)


def test_likeness():
    assert entailment.likeness("1948", "1949") == 0 and entailment.likeness("lamp", "lamp") == 1
    assert 0.5 < entailment.likeness("harbour", "harbours") < 1 and entailment.likeness("lamp", "lady") == 0


def test_features_tell_numbers_negations_and_order():
    get = lambda p, c: dict(zip(entailment.FEATURES, entailment.features(p, c), strict=True))
    premise = "The lamp burns 25 litres of oil in winter, and Crews row 60 miles."
    same = get(premise, "The lamp burns 25 litres of oil.")
    assert (same["aligned"], same["known"], same["missing_numbers"], same["negations"], same["swapped"]) == (1, 1, 0, 0, 0)
    assert get(premise, "The lamp burns 26 litres of oil.")["missing_numbers"] == 1
    assert get(premise, "Crews row 25 miles.")["moved_numbers"] == 1
    assert get(premise, "The lamp does not burn 25 litres of oil.")["negations"] == 1
    assert get("It isn't lit.", "It is lit.")["negations"] == 1
    assert get("dogs bite men", "men bite dogs")["swapped"] == 2
    assert get(premise, "In Norway crews row.")["missing_names"] == 1
    assert entailment.features(None, None) == entailment.features("x", "") == [0.0] * len(entailment.FEATURES)
    assert entailment.features("", "a b")[0] == 0


def test_long_premises_and_claims():
    rng = random.Random(3)
    filler = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(3000))
    assert entailment.features(f"{filler} the bell rings five times {filler}", "the bell rings five times")[0] == 1
    long = " ".join(f"x{k}" for k in range(1000))
    assert entailment.features(long, long)[1] == 1 and len(entailment.features("a", long)) == len(entailment.FEATURES)


def test_held_out_accuracy(spark, weights):
    held = entailment.judged(entailment.pairs_of(spark.createDataFrame(texts(200, 77), "doc_id long, text string")), weights)
    counts = {(r.label, r.found): r["count"] for r in held.groupBy("label", "found").count().collect()}
    total = sum(counts.values())
    assert total > 800 and sum(n for (a, b), n in counts.items() if a == b) / total > 0.97
    against = {k: n for k, n in counts.items() if k[0] == 2}
    assert against[2, 2] / sum(against.values()) > 0.97  # other numbers, negations, exchanged words


def test_claims_of_plain_english(weights):
    premise = "The lamp burns 25 litres of oil in winter. Ships under thirty metres pay 14 crowns a night."
    likely = lambda claim: max(probability(weights, premise, claim).items(), key=lambda x: x[1])[0]
    assert likely("The lamp burns 25 litres of oil in winter.") == "entailed" == likely("Ships under thirty metres pay 14 crowns.")
    assert likely("The lamp burns 52 litres of oil in winter.") == "contradicted" == likely("The lamp never burns 25 litres of oil in winter.")
    assert likely("A king was crowned in the old town yesterday.") == "neutral"


def test_the_columns_are_the_plain_function(spark, weights):
    pairs = [("A lamp is lit.", "A lamp is lit."), (None, "x y z"), ("It rains.", None), ("Old men sail 3 boats.", "Old men sail 4 boats.")]
    got = {r.i: r for r in entailment.judged(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, premise string, claim string"), weights).collect()}
    for i, (p, c) in enumerate(pairs):
        want = probability(weights, p, c)
        assert all(got[i][k] == pytest.approx(v) for k, v in want.items()) and entailment.CLASSES[got[i].found] == max(want, key=want.get)


def test_as_a_verifier(spark, weights):
    retrieved = spark.createDataFrame([(1, 1, "The lamp burns 25 litres of oil in winter. It is lit at dusk."), (1, 2, "Crews row 60 miles.")], "qid long, rank int, text string")
    drafts = spark.createDataFrame([(1, "The lamp burns 25 litres of oil in winter [1]. The lamp burns 52 litres of oil in winter [1]. It is never lit at dusk [1]. Crews row 60 miles [2].")], "qid long, draft string")
    rows = verification.nli_verdicts(drafts, retrieved, "qid", entailment.load_predictor(weights)).orderBy("claim_no").collect()
    assert [(r.supported, r.source_rank) for r in rows] == [(True, 1), (False, None), (False, None), (True, 2)]


def test_nothing_to_fit_on(spark):
    with pytest.raises(ValueError, match="no text"):
        entailment.fitted(spark.createDataFrame([(1, None), (2, ""), (3, "One short text.")], "doc_id long, text string"))
