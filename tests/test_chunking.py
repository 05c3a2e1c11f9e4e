import random
from itertools import batched

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking
from tests.test_text import scanned_sentences


def estimate(text):
    return int(len(text.split()) * 1.3) + 1


def plain_chunks(text, most, overlap):
    """From the definition: a chunk is the longest run of units whose estimates add up to no more than `most`, but has a new unit in any
    case; the next one begins at the first unit from which on the rest of the chunk fits into the overlap."""
    units = []
    for s in scanned_sentences(text):
        units += [s] if estimate(s) <= most else [" ".join(part) for part in batched(s.split(), int(most / 1.3))]
    cost = lambda a, b: sum(map(estimate, units[a:b]))
    runs, a, b = [], 0, 0
    while b < len(units):
        b = max(b + 1, *(k for k in range(a, len(units) + 1) if cost(a, k) <= most))
        runs.append(" ".join(units[a:b]))
        a = min(k for k in range(a, b + 1) if cost(k, b) <= overlap)
    return runs


def chunked(spark, text, most, overlap):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(chunking.chunk_text(F.col("t"), most, overlap).alias("x")).first().x


def test_small_chunks_overlap_and_lose_nothing(spark):
    rng = random.Random(21)
    said = [f"Buoy{i} " + " ".join(rng.choice(("lamp", "oar", "mile", "tide")) for _ in range(rng.randint(2, 15))) + rng.choice(".!?") for i in range(150)]
    chunks = chunked(spark, " ".join(said), 80, 30)
    assert chunks == plain_chunks(" ".join(said), 80, 30)
    assert all(sum(s in c for c in chunks) >= 1 for s in said)
    firsts = [next(i for i, s in enumerate(said) if c.startswith(s)) for c in chunks]
    lasts = [next(i for i, s in enumerate(said) if c.endswith(s)) for c in chunks]
    assert all(b <= a + 1 for a, b in zip(lasts, firsts[1:], strict=False)) and any(b <= a for a, b in zip(lasts, firsts[1:], strict=False))


def test_a_run_without_sentences(spark):
    text = " ".join(str(i) for i in range(900))
    chunks = chunked(spark, text, 60, 10)
    assert chunks == plain_chunks(text, 60, 10) and " ".join(chunks) == text


def test_against_plain_rules(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        sizes = [rng.choice([1, 3, 10, 40, 75, 100, 300]) for _ in range(rng.randint(0, 12))]
        texts.append("\n\n".join(" ".join(["Word"] * n) + "." for n in sizes))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: r.x for r in df.select("i", chunking.chunk_text(F.col("t"), 100, 60).alias("x")).collect()}
    assert [found[i] for i in range(len(texts))] == [plain_chunks(t, 100, 60) for t in texts]


def test_the_packers_sentences_are_those_of_the_columns(spark):
    rng = random.Random(8)
    signs = ["A", "b", "1.", "2. ", ". ", "! ", "?\n", "\n\n", "\n \n", " ", "\xa0", "\t", "(", '"', "é", "É", "12", "\u2028", "\x1c"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r.i: r.x for r in df.select("i", T.split_sentences(F.col("t")).alias("x")).collect()}
    for i, t in enumerate(texts):
        assert list(chunking.sentences(t)) == found[i] == scanned_sentences(t), repr(t)


def pages(spark, rows):
    return spark.createDataFrame(rows, "source string, page long, text string")


def test_pages_number_their_chunks(spark):
    rows = [("a", 1, "One is here. Two is here."), ("a", 3, " ".join(["Long sentence goes on."] * 200)), ("a", 2, ""), ("b", 1, "Other text."), ("c", 1, "")]
    chunks = chunking.chunk_pages(pages(spark, rows), 100, 20).collect()
    own = sorted((c["index"], c.page) for c in chunks if c.source == "a")
    assert [i for i, _ in own] == list(range(len(own))) and [p for _, p in own] == sorted(p for _, p in own)
    assert len({c.id for c in chunks}) == len(chunks) and {c.source for c in chunks} == {"a", "b"}
    assert all(len(c.id.split(":")[0]) == 8 for c in chunks)
    registry = {r.source: r.n_chunks for r in chunking.document_registry(chunking.chunk_pages(pages(spark, rows), 100, 20)).collect()}
    assert registry == {"a": len(own), "b": 1}


def test_ids_follow_the_content(spark):
    key = lambda rows: chunking.document_keys(pages(spark, rows)).first().doc_key
    assert key([("a", 1, "x"), ("a", 2, "y")]) == key([("a", 2, "y"), ("a", 1, "x")])
    assert len({key([("a", 1, "x")]), key([("a", 1, "y")]), key([("b", 1, "x")]), key([("a", 2, "x")])}) == 4
