from collections import Counter

import pytest

from tessera.llm import mixing


def by_dimension(rows, at, weight):
    out = Counter()
    for r in rows:
        out[r[at]] += weight(r)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def check_marginals(rows, targets=None):
    """Expected tokens have the target shares; with none given, the observed shares to the power POWER."""
    for d in mixing.DIMENSIONS:
        seen = Counter()
        for r in rows:
            seen[r[d]] += r.n_tokens
        goal = (targets or {}).get(d) or {k: v**mixing.POWER for k, v in seen.items() if v}
        goal = {k: goal.get(k, 0.0) for k, v in seen.items() if v}
        total = sum(goal.values())
        got = by_dimension(rows, d, lambda r: r.n_tokens * r.prob)
        for k, v in goal.items():
            assert got[k] == pytest.approx(v / total, abs=1e-6), (d, k)


def test_marginals_and_probabilities(docs, rows):
    found = mixing.mixture(docs).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.prob <= 1 for r in found) and max(r.prob for r in found if r.n_tokens) == pytest.approx(1)
    check_marginals(mixing.mixture(docs.where("doc_id < 1000")).collect())
    assert all(r.source == "(none)" for r in found if r.doc_id == 1001)
    words = {r[0]: len((r[1] or "").replace("\x1f", "x").replace("\xa0", "x").split()) for r in rows if r[0] is not None}
    assert all(r.n_tokens == words[r.doc_id] for r in found if r.doc_id is not None and r.doc_id != 1008)


def test_given_targets_and_budget(docs):
    targets = {"lang": {"en": 0.5, "de": 0.25, "fr": 0.25, "absent": 3.0}}
    found = mixing.mixture(docs.where("lang is not null"), targets=targets, tokens=500.0).collect()
    check_marginals(found, targets)
    assert sum(r.n_tokens * r.prob for r in found) <= 500.0 + 1e-6


def test_joins_give_the_same_as_the_driver(docs):
    pick = lambda **kw: {r.doc_id: r.prob for r in mixing.mixture(docs.where("doc_id < 1000"), **kw).collect()}
    a, b = pick(), pick(driver_cells=0)
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(a[k], rel=1e-6) for k in a)


def test_draws_follow_the_probabilities(spark):
    many = spark.range(20_000).selectExpr(
        "id as doc_id", "'some words here' as text", "if(id % 10 = 0, 'rare', 'hot') as source", "'en' as lang"
    )
    found = mixing.mixture(many, targets={"source": {"rare": 0.5, "hot": 0.5}})
    n = {(r.source, r.sampled): r["count"] for r in found.groupBy("source", "sampled").count().collect()}
    assert n["rare", True] == 2000 and abs(n["hot", True] - 2000) < 200
    again = {r.doc_id for r in mixing.sampled(many, targets={"source": {"rare": 0.5, "hot": 0.5}}).collect()}
    assert again == {r.doc_id for r in found.where("sampled").collect()}


def test_own_columns_stay_and_empty_table(docs, no_docs):
    assert mixing.sampled(docs).columns == docs.columns
    assert mixing.mixture(no_docs).collect() == [] and mixing.sampled(no_docs).collect() == []


def plain_fitting(rows, targets=None):
    """Weights and probabilities of (id, source, lang, topic, tokens) by raking a dense table, cell by cell."""
    import numpy as np

    names = [sorted({r[d] for r in rows}) for d in (1, 2, 3)]
    tokens = np.zeros([len(n) for n in names])
    for r in rows:
        tokens[tuple(n.index(r[d]) for d, n in zip((1, 2, 3), names, strict=True))] += r[4]
    total, table = tokens.sum(), tokens.copy()
    for _ in range(mixing.ROUNDS):
        for axis, dimension in enumerate(mixing.DIMENSIONS):
            others = tuple(a for a in range(3) if a != axis)
            first = tokens.sum(axis=others)
            given = (targets or {}).get(dimension)
            goal = np.where(first > 0, [given.get(c, 0.0) for c in names[axis]] if given else first**mixing.POWER, 0)
            goal = goal / goal.sum() * total
            now = table.sum(axis=others)
            scale = np.where(now > 0, goal / np.where(now > 0, now, 1), 1)
            table = table * scale.reshape([-1 if a == axis else 1 for a in range(3)])
    factor = np.where(tokens > 0, table / np.where(tokens > 0, tokens, 1), 0)
    at = lambda r: tuple(n.index(r[d]) for d, n in zip((1, 2, 3), names, strict=True))
    return {r[0]: (factor[at(r)], factor[at(r)] / factor.max()) for r in rows if tokens[at(r)]}


@pytest.mark.parametrize("targets", [None, {"lang": {"en": 0.6, "de": 0.3, "fr": 0.1}, "source": {"src0": 1.0, "src1": 2.0, "src2": 1.0, "src3": 1.0}}])
@pytest.mark.parametrize("driver_cells", [mixing.DRIVER_CELLS, 0])
def test_weights_against_plain_fitting(docs, targets, driver_cells):
    found = mixing.mixture(docs.where("doc_id < 1000"), targets=targets, driver_cells=driver_cells).collect()
    want = plain_fitting([(r.doc_id, r.source, r.lang, r.topic, r.n_tokens) for r in found], targets)
    got = {r.doc_id: (r.weight, r.prob) for r in found if r.doc_id in want}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-4) for k in want)


def test_columns_of_any_name(docs):
    odd = docs.selectExpr("*", "1 AS mix_source", "2 AS mix_prob", "3 AS mix_factor", "4 AS mix_tokens", "5 AS c0", "6 AS `a.b`")
    plain, found = mixing.sampled(docs), mixing.sampled(odd)
    assert found.columns == odd.columns
    assert sorted((tuple(r) for r in plain.collect()), key=repr) == sorted((tuple(r)[: len(docs.columns)] for r in found.collect()), key=repr)
    assert mixing.mixture(odd).count() == docs.count()
