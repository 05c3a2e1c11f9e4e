import html
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.nfkc import nfkc, with_nfkc

ALPHABET = st.text(alphabet="aB1. !?\n\"'([-:,  é[]", max_size=60)


def value(spark, make, *columns):
    df = spark.createDataFrame([columns], [f"c{i}" for i in range(len(columns))])
    return df.select(make(*[F.col(c) for c in df.columns]).alias("x")).first().x


def values(spark, make, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def scanned_sentences(text):
    """Sentences by a scan over the runs of white space: where a run ends a sentence, and what stands between the ends."""
    ends = [0]
    for run in re.finditer(r"\s+", text):
        before, after = text[: run.start()][-1:], text[run.end() :][:1]
        ends_here = before in tuple(".!?") and after in tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789\"'([")
        if run[0].count("\n") > 1 or ends_here:
            ends.append(run.end())
    pieces = [p for a, b in zip(ends, [*ends[1:], len(text)], strict=True) if (p := text[a:b].strip())]
    out = []
    while pieces:
        takes = 2 if len(pieces) > 1 and pieces[0][:-1].isdecimal() and pieces[0][-1] == "." else 1
        out.append(" ".join(pieces[:takes]))
        del pieces[:takes]
    return out


def test_sentences_against_plain_rules(spark):
    @settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(ALPHABET, min_size=40, max_size=40))
    def run(texts):
        assert values(spark, T.split_sentences, texts) == [scanned_sentences(t) for t in texts]
        assert values(spark, T.approx_tokens, texts) == [int(len(t.split()) * 1.3) + 1 for t in texts]
        assert values(spark, T.strip, texts) == [t.strip() for t in texts]

    run()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("7. Lamps\n\nEvery lamp is lit. Now!", ["7. Lamps", "Every lamp is lit.", "Now!"]),
        ("3. 4. Oars.", ["3. 4.", "Oars."]),
        ("8.\n\nOars rest.", ["8. Oars rest."]),
        ("Fin. Él va.", ["Fin. Él va."]),
        ("", []),
    ],
)
def test_sentences(spark, text, want):
    assert value(spark, T.split_sentences, text) == want == scanned_sentences(text)


def test_blocks(spark):
    assert value(spark, T.clean_block, " har-\nbour  Ex-\nRN \n x ") == "harbour Ex- RN x"
    blocks = ["Title", "Body one is long enough to be no heading at all", "", "continues.", "Next."]
    df = spark.createDataFrame([(blocks,)], "b array<string>")
    joined = df.select(T.join_blocks(F.col("b")).alias("x")).first().x
    assert joined == "Title\n\nBody one is long enough to be no heading at all continues.\n\nNext."


def test_hard_split(spark):
    found = value(spark, lambda t: T.hard_split(t, 100), "word " * 200)
    assert [len(x.split()) for x in found] == [76, 76, 48] and value(spark, lambda t: T.hard_split(t, 100), "  ") == []


def test_citations_and_claims(spark):
    assert value(spark, T.strip_citations, "Lamps burn oil [4]. Oars break [5 ,6] often.") == "Lamps burn oil. Oars break often."
    assert value(spark, T.split_claims, "No. Lamps burn oil [4]. Oars break at times [7].") == ["Lamps burn oil.", "Oars break at times."]


LAMP = "Each buoy keeps 25 litres of spare lamp oil per winter season."


@pytest.mark.parametrize(
    ("quote", "found", "strict"),
    [
        ("25 LITRES of spare lamp-oil", True, True), ("Each buoy ... per winter", True, True), ("26 litres of spare lamp oil", False, False),
        ("", False, False), ("5 litres of spare", True, False), ("season…buoy", True, True), ("...", False, False),
    ],
)
def test_quotes(spark, quote, found, strict):
    assert value(spark, T.quote_in_text, quote, LAMP) is found
    assert value(spark, lambda q, t: T.quote_in_text(q, t, True), quote, LAMP) is strict


def test_answers(spark):
    assert value(spark, T.clean_answer, " Within 2 hours 【1】 and [ 2 ]\t.\nNext ") == "Within 2 hours [1] and [2] .\nNext"
    assert values(spark, T.is_not_found, ["NOT_FOUND", " not found. ", "Not found in 2019", "", "x"]) == [True, True, False, True, False]


def test_json(spark):
    good = ['```json\n{"a": 1}\n```', 'Sure: {"a": [1]} done', '{"a": {"b": 2}}']
    bad = ["no json here", "{broken", "} {", ""]
    assert values(spark, lambda t: T.parse_json_object(t).isNotNull(), good + bad) == [True] * 3 + [False] * 4


def test_escapes(spark):
    assert value(spark, T.escape_dollars, "a $5 b$") == "a \\$5 b\\$"
    odd = "<b>\"a\" & 'b'</b> &amp;"
    assert value(spark, T.escape_html, odd) == html.escape(odd)


def test_scorer(spark):
    df = spark.createDataFrame([("up to three days per week", ["3"]), ("within 2  hours", ["2 hours"]), ("up to four days", ["3"]), ("Twenty-five", ["twenty-5"])], "a string, e array<string>")
    assert [r.x for r in df.select(T.is_correct(F.col("a"), F.col("e")).alias("x")).collect()] == [True, True, False, True]


def test_nfkc(spark):
    odd = ["ﬁne ２", "é", "plain"]
    assert values(spark, nfkc, odd) == [unicodedata.normalize("NFKC", t) for t in odd]


def test_nfkc_of_every_code_point_that_it_changes(spark):
    changed = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFKC", chr(c)) != chr(c)]
    texts = [f"a{c}b" for c in changed] + ["plain", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r.i: r.x for r in with_nfkc(df, x=F.col("t")).collect()}
    assert found == {i: t and unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
