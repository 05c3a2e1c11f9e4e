import random
import re

import pytest

from tessera.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def expected(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places, names = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                names.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names))


CASES = [
    ("SPDX-License-Identifier: Apache-2.0", {"apache-2.0"}, 1.0),
    ("Licensed under the Apache License, Version 2.0.", {"apache", "apache-2.0"}, 0.9),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}, 0.9),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}, 0.9),
    ("Released under the\nMIT  License", {"mit"}, 0.9),
    ("the BSD 3-Clause License", {"bsd-3-clause"}, 0.8),
    ("GNU Lesser General Public License v2.1", {"gpl", "lgpl-2.1"}, 0.8),
    ("no licence words, a submit licenses x", set(), 0.0),
    ("mit license mit license apache license", {"mit", "apache"}, 0.6),
    ("Copyright 2020 A. All rights reserved.", {"copyright", "all-rights-reserved"}, 0.8),
]


@pytest.mark.parametrize(("text", "labels", "score"), CASES)
def test_detections(text, labels, score):
    row = licenses.described(1, text.encode())
    assert (set(row[6].split(",")) - {""}, row[7]) == (labels, score)
    assert row[1:6] == expected(text)


def test_hundreds_of_rules_in_order():
    own = licenses.rules()
    assert len(own) > 300 and [r.priority for r in own] == sorted(r.priority for r in own)


def test_overlaps_are_resolved_by_priority_and_containment():
    D = licenses.Detection
    found = [D(2, 0, 4, 1, "a"), D(2, 1, 3, 2, "b"), D(1, 3, 8, 3, "c"), D(3, 9, 10, 4, "d"), D(3, 4, 6, 5, "e")]
    assert [d.label for d in licenses.resolved(found)] == ["b", "c", "d"]
    assert [d.label for d in licenses.resolved(found[:2])] == ["a"]


def test_whole_table(spark, docs, rows, no_docs):
    from tests.llm.conftest import frame

    extra = [(5000 + i, t, "en", "s") for i, (t, *_) in enumerate(CASES)] + [(6000, "x " * 30_000 + "mit license", "en", "s")]
    want = sorted(((d, *expected(t)) for d, t, *_ in [*rows, *extra]), key=repr)
    found = licenses.license_scan(docs.union(frame(spark, extra))).collect()
    assert sorted((tuple(r)[:6] for r in found), key=repr) == want
    assert all(0 <= r.score <= 1 for r in found)
    assert licenses.license_scan(no_docs).collect() == []


@pytest.mark.parametrize(("text", "label"), [
    ("see https://creativecommons.org/publicdomain/zero/1.0/", "cc0"),
    ("see mozilla.org/MPL/2.0", "mpl"),
    ("see scripts.sil.org/OFL", "ofl"),
    ("see www.wtfpl.net", "wtfpl"),
    ("do what the fuck you want to public license", "wtfpl"),
    ("CC0 1.0 Universal", "cc0-1.0"),
    ("Boost Software 1.0", "boost-1.0"),
    ("Eclipse Public 2.0", "epl-2.0"),
    ("GNU Library General Public 2", "lgpl-2.0"),
    ("distributed under MPL 2.0", "mpl-2.0"),
])
def test_rules_without_the_usual_words(text, label):
    assert label in licenses.described(1, text.encode())[6].split(",")


def drawn(rng, parsed):
    """A string that the parsed expression matches."""
    out = ""
    for op, x in parsed:
        match str(op):
            case "LITERAL":
                out += chr(x)
            case "IN":
                out += str(rng.randint(0, 9)) if str(x[0][0]) == "CATEGORY" else chr(rng.choice(x)[1])
            case "BRANCH":
                out += drawn(rng, rng.choice(x[1]))
            case "SUBPATTERN":
                out += drawn(rng, x[3])
            case "MAX_REPEAT":
                out += drawn(rng, x[2]) * rng.randint(x[0], x[1])
            case "ASSERT":
                pass
            case _:
                raise ValueError(op)
    return out


def test_scan_finds_what_running_all_rules_finds():
    rng = random.Random(5)
    for rule in licenses.rules():
        for _ in range(4):
            text = f"so it is{drawn(rng, re._parser.parse(rule.pattern.pattern.decode()))} as they say"
            line = f" {text} ".encode()
            assert rule.pattern.search(line), text
            every = []
            for order, r in enumerate(licenses.rules()):
                for m in r.pattern.finditer(line):
                    start = line.count(b" ", 0, m.start())
                    every.append(licenses.Detection(r.priority, start, start + line.count(b" ", m.start() + 1, m.end() + 1), order, r.label))
            assert licenses.scan(text.encode())[2] == licenses.resolved(every), text


def plainly_resolved(found):
    kept = []
    for d in sorted(found, key=lambda d: (d.priority, d.start - d.end, d.order, d.start)):
        inside = any(k.start <= d.start and d.end <= k.end for k in kept)
        if not inside and not any(k.priority < d.priority and d.start < k.end and k.start < d.end for k in kept):
            kept.append(d)
    return sorted(kept, key=lambda d: (d.start, d.end))


def test_resolution_against_comparing_all():
    rng = random.Random(8)
    for _ in range(400):
        found = []
        for order in range(rng.randint(0, 25)):
            start = rng.randint(0, 30)
            found.append(licenses.Detection(rng.randint(0, 3), start, start + rng.randint(1, 9), order, str(order)))
        assert licenses.resolved(found) == plainly_resolved(found)


def test_a_text_with_very_many_detections():
    import time

    text = b"mit license, apache license 2.0; " * 25_000
    began = time.process_time()
    n, base, found = licenses.scan(text)
    assert (n, len(base)) == (150_000, 50_000) and len(found) == 50_000
    assert time.process_time() - began < 10


@pytest.mark.parametrize(("text", "label"), [
    ("GNU Library General Public License version 2", "lgpl-2.0"),
    ("http://www.mozilla.org/MPL/", "mpl"),
    ("w3.org/Consortium/Legal", "w3c"),
    ("You may obtain a copy of the License only here. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", "apache-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("The Software shall be used for Good, not Evil.", "json"),
])
def test_signatures_of_texts(text, label):
    assert label in licenses.described(1, text.encode())[6].split(",")
