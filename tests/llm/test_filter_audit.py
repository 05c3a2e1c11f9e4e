import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from tessera.llm import filter_audit as audit
from tests.llm.conftest import frame

LABELS = "doc_id long, quality int, toxic int, text string"


def failing(row, first):
    text = row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search("[#$%&*|]", text)), "E": row[0] is not None and first.get(text) is not None and row[0] > first[text],
    }


def plain(rows, labels):
    """The audit by running every order over every document."""
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(r[0], first.get(r[1] or "", r[0]))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    docs = [(r[2] or "", failing(r, first), r[0] in good, r[0] in toxic) for r in rows]
    out = {}
    for order in map("".join, permutations("ABCDE")):
        left = list(docs)
        for step, f in enumerate(order, 1):
            gone, stay = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
            for part in {d[0] for d in docs}:
                n = lambda ds, part=part: sum(d[0] == part for d in ds)
                all_fail = [d for d in docs if d[1][f]]
                alone = [d for d in all_fail if sum(d[1].values()) == 1]
                out[part, order, step] = [n(stay), n(gone), n(all_fail) - n(gone), n(alone), n([d for d in gone if d[2]]), n([d for d in gone if d[3]])]
            left = stay
    shapley = defaultdict(int)
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] += v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check(got, rows, labels):
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in audit.COUNTS) for r in got}
    assert len(found) == len(got)
    assert found == plain(rows, labels)


@pytest.fixture(scope="module")
def mixed():
    """Documents of every kind of failure, many at once, with copies; ids are unique."""
    rng = random.Random(11)
    rows = []
    for i in range(300):
        words = [rng.choice(["alpha", "beta", f"w{rng.randint(0, 400)}"]) if rng.random() < 0.5 else f"u{i}x{k}" for k in range(rng.choice([5, 99, 100, 101, 180]))]
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        text = rng.choice([" ", "\n", "\t ", "\x0b"]).join(words) + rng.choice(["", "", " |", "$5"])
        rows.append((i, text, rng.choice(["en", "de", None, ""]), "s"))
    for i in range(60):
        rows.append((400 + i, rows[rng.randint(0, 5)][1], rng.choice(["en", "fr"]), "s"))
    rows += [(500, None, "en", "s"), (501, "", "en", "s"), (502, " \t", None, "s"), (503, "É" * 50 + " ABC", "en", "s")]
    return rows


def labels_of(rows):
    rng = random.Random(12)
    out = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for r in rows if rng.random() < 0.6 and r[0] is not None]
    return out + out[:20] + [(r[0], 1, 1) for r in rows[:3]] + [(None, 1, 1), (99999, 1, 1)]


def labelled(spark, labels):
    return spark.createDataFrame([(*r, "t") for r in labels], LABELS)


def test_all_orders_against_running_them(spark, mixed):
    labels = [r for r in labels_of(mixed) if r[0] is not None]
    check(audit.filter_audit(frame(spark, mixed).repartition(3), labelled(spark, labels)).collect(), mixed, labels)


def test_odd_rows_and_repeated_ids(spark, docs, rows):
    labels = [r for r in labels_of(rows) if r[0] is not None]
    check(audit.filter_audit(docs, labelled(spark, [*labels, (None, 1, 1)])).collect(), rows, labels)


def test_many_repeated_texts_are_joined(spark, mixed, monkeypatch):
    monkeypatch.setattr(audit, "BROADCAST_TEXTS", 1)
    check(audit.filter_audit(frame(spark, mixed).repartition(3), labelled(spark, [])).collect(), mixed, [])


def test_the_words_are_not_shuffled(spark, mixed):
    totals = audit.word_totals(audit.numbered(frame(spark, mixed)).repartition("row"))
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    got = {r.row: (r.n_words, r.n_distinct) for r in totals.collect()}
    for r in mixed:
        words = Counter(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        assert got.get(r[0], (0, 0)) == (sum(words.values()), len(words))


def test_empty_tables(spark, no_docs, mixed):
    assert audit.filter_audit(no_docs, labelled(spark, [])).collect() == []
    assert audit.filter_audit(frame(spark, mixed[:3]), labelled(spark, [])).count() == 600 * len({r[2] or "" for r in mixed[:3]})
