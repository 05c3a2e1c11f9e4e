import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score double, spans string, items string, n_words string, lang_pred string, kept string, digest string, topic string, rank string"
)
SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ein ung keit lich ver ge ber zu auf".split(), "fr": "eau eux oi que ment ou la le tion ai".split()}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(n: int = 120, seed: int = 7) -> list[tuple]:
    """(doc_id, text, lang, source): prose, copies, near copies, and every odd case."""
    rng = random.Random(seed)
    rows: list[list] = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append([i, sentence(rng, lang, rng.randint(30, 90)) + ".", lang, f"src{min(i % 7, 3)}"])
    for i in range(0, 40, 4):  # copies that differ in white space alone, near copies, and far ones
        words = rows[i][1].split()
        rows[i + 1][1] = "  ".join(words) + "\n"
        near = list(words)
        near[len(near) // 2] = "changed"
        rows[i + 2][1] = " ".join(near)
        far = list(words)
        for k in range(0, len(far), 6):
            far[k] = "other"
        rows[i + 3][1] = " ".join(far)
    odd = [None, "", " \n\t ", "one two three", "ONE two  three", "!!! ... 123", "é" * 50, sentence(rng, "en", 12_000), "a\x00b\x1fc d\xa0e f"]
    for k, text in enumerate(odd):
        rows.append([1000 + k, text, None if k % 2 else "en", None if k % 3 else "src0"])
    rows.append([1003, "one two three", "en", "src0"])  # a repeated row
    rows.append([None, "a text without an id but with enough words to be one", "en", "src1"])
    rows.append([None, None, None, None])
    return [tuple(r) for r in rows]


def frame(spark, rows):
    full = [(*r, None if r[1] is None else len(r[1]), 1.0, "s", "i", "w", "l", "k", "d", None, "r") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
