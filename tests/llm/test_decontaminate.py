import hashlib
import re

import pytest

from tessera.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def expected(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    out = []
    for doc, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(rows):
    long = rows[5][1].split()
    return [
        (1, " ".join(long[3:20]).upper()), (2, "!".join(long[8:18])), (10, rows[9][1]), (3, "one TWO three"), (4, "three"), (5, None), (6, "..."),
        (None, " ".join(rows[30][1].split()[2:14])), (7, "words that never occur in any of these documents at all"), (1, " ".join(long[3:20])),
    ]


def found(df):
    return sorted((tuple(r) for r in df.drop("spans").collect()), key=repr)


@pytest.mark.parametrize("bound", [decontaminate.BENCHMARK_BYTES, 150])
def test_all_occurrences(spark, docs, rows, items, bound, monkeypatch):
    """Also with a benchmark that needs several passes."""
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", bound)
    marked = decontaminate.marked
    monkeypatch.setattr(decontaminate, "marked", lambda d, b: marked(d, b, bound=bound))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert found(decontaminate.decontamination_report(docs, benchmark)) == expected(rows, items)


def test_clean_documents_keep_their_columns(spark, docs, rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    want = sorted((r[0] for r in expected(rows, items) if not r[5]), key=repr)
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == want


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontamination_report(no_docs, none).collect() == []
    assert not any(r.contaminated for r in decontaminate.decontamination_report(docs, none).collect())


def test_shifts_never_pass_an_occurrence():
    import numpy as np

    rng = np.random.default_rng(1)
    strings = [tuple(rng.integers(1, 4, 6).tolist()) for _ in range(30)]
    text = rng.integers(0, 4, 4000).astype(np.int32)
    searcher = decontaminate.Searcher(np.array(strings, np.int32).ravel(), np.arange(30) * 6, 6)
    got = sorted(s for s, found in searcher.find(text) for _ in found)
    want = sorted(k for k in range(len(text) - 5) for s in strings if tuple(text[k : k + 6].tolist()) == s)
    assert got == want


def test_tables_are_built_from_arrays():
    """A share of a megabyte, of which one window occurs."""
    import random
    import time

    rng = random.Random(4)
    items = [(str(i), " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) + str(rng.randint(0, 99)) for _ in range(100)).encode()) for i in range(1800)]
    assert sum(len(t) for _, t in items) > 900_000
    began = time.process_time()
    search = decontaminate.Search(items, 10)
    words = items[777][1].split()
    text = b"zz " * 50 + b" ".join(words[20:32]) + b" zz" * 50
    (n, spans, found), = search.scan([text])
    assert (n, spans, found) == (112, [50, 62], {"777"})
    assert time.process_time() - began < 5
