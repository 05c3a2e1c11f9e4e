"""Cleaning, sentences, claims and small scalar functions, as Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of Python's str.split and of `\s` in its regular expressions.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Typographic spaces that answers are cleaned of.
EXOTIC_SPACES = "\u00a0\u2002\u2003\u2007\u2009\u200a\u202f"
#: Number words that the scorer reads as digits, in this order.
NUMBER_WORDS = (
    ("two", "2"), ("three", "3"), ("four", "4"), ("five", "5"), ("fourteen", "14"), ("sixteen", "16"), ("twenty-five", "25"), ("thirty", "30"),
)
HTML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value is computed once however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def words(text: Column) -> Column:
    """Between white space, without empty ones."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def approx_tokens(text: Column) -> Column:
    return (F.floor(F.size(words(text)) * F.lit(1.3)) + 1).cast("int")


def clean_block(text: Column) -> Column:
    """Words hyphenated over a line end are joined, white space is collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"-\n(?=[a-z])", ""), f"{SPACE}+", " "))


def join_blocks(blocks: Column) -> Column:
    """Blocks as one text, with a blank line after a finished sentence or a heading, else a space."""

    def add(out: Column, block: Column) -> Column:
        last_line = F.element_at(F.split(out, "\n"), -1)
        heading = (F.size(words(last_line)) < 8) & ~out.rlike(r"[.!?:,;]\n?\z")
        joint = F.when(heading | out.rlike(r"[.!?]\n?\z"), "\n\n").otherwise(" ")
        return F.when(out == "", block).otherwise(F.concat(out, joint, block))

    return F.aggregate(F.filter(blocks, lambda b: b != ""), F.lit(""), add)


# Where a text is cut to paragraphs and sentences; fixed values.
BLANK_LINES = rf"\n{SPACE}*\n"
SENTENCE_END = rf"(?<=[.!?]){SPACE}+(?=[A-Z0-9\"'(\[])"


def split_sentences(text: Column) -> Column:
    """Paragraphs, then sentences; a lone number such as `1.` is put before the sentence that follows."""
    paragraphs = F.filter(F.transform(F.split(text, BLANK_LINES), strip), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCE_END)))
    pieces = F.filter(F.transform(pieces, strip), lambda s: s != "")

    def attach(done: Column, sentence: Column) -> Column:
        last = F.element_at(done, -1)
        numbered = (F.size(done) > 0) & F.coalesce(F.try_element_at(done, F.lit(-1)).rlike(NUMERAL), F.lit(False))
        merged = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), sentence)))
        return F.when(numbered, merged).otherwise(F.concat(done, F.array(sentence)))

    def attached(found: Column) -> Column:
        numbered = F.exists(found, lambda s: s.rlike(NUMERAL))
        return F.when(numbered, F.aggregate(found, F.array().cast("array<string>"), attach)).otherwise(found)

    return let(pieces, attached)


NUMERAL = r"^\p{Nd}+\.\z"


def hard_split(sentence: Column, max_tokens: int) -> Column:
    """Slices of as many words as fit."""
    step = max(1, int(max_tokens / 1.3))

    def slices(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(own), F.lit(step))
        cut = F.transform(starts, lambda i: F.array_join(F.slice(own, i, step), " "))
        return F.when(F.size(own) > 0, cut).otherwise(F.array().cast("array<string>"))

    return let(words(sentence), slices)


def strip_citations(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"{SPACE}*\[\p{{Nd}}+(?:{SPACE}*,{SPACE}*\p{{Nd}}+)*\]", ""))


def split_claims(answer: Column) -> Column:
    """Sentences of three words or more, without citations."""
    return F.filter(F.transform(split_sentences(answer), strip_citations), lambda s: F.size(words(s)) >= 3)


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def quote_in_text(quote: Column, text: Column, strict: bool = False) -> Column:
    """Every part of the quote between ellipses stands in the text; with `strict`, on word borders."""
    segments = F.filter(F.transform(F.split(quote, r"\.{3}|…"), normalise), lambda s: s != "")
    own = normalise(text)
    if strict:
        own = F.concat(F.lit(" "), own, F.lit(" "))
        segments = F.transform(segments, lambda s: F.concat(F.lit(" "), s, F.lit(" ")))
    return let(own, lambda found: (F.size(segments) > 0) & F.forall(segments, lambda s: F.contains(found, s)))


def clean_answer(text: Column) -> Column:
    text = F.translate(text, EXOTIC_SPACES, " " * len(EXOTIC_SPACES))
    text = F.regexp_replace(text, rf"[【\[]{SPACE}*(\p{{Nd}}+(?:{SPACE}*,{SPACE}*\p{{Nd}}+)*){SPACE}*[】\]]", "[$1]")
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


def is_not_found(answer: Column) -> Column:
    return (strip(answer) == "") | (F.upper(F.regexp_replace(answer, "[^A-Za-z]", "")) == "NOTFOUND")


def escape_dollars(text: Column) -> Column:
    return F.replace(text, F.lit("$"), F.lit("\\$"))


def escape_html(text: Column) -> Column:
    for character, entity in HTML_ENTITIES:
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def scorer_normalise(text: Column) -> Column:
    """Lower case, white space collapsed, number words as digits. For texts in Unicode form NFKC, which `evaluation` sees to."""
    text = F.lower(F.regexp_replace(text, f"{SPACE}+", " "))
    for word, digit in NUMBER_WORDS:
        text = F.regexp_replace(text, rf"(?U)\b{word}\b", digit)
    return text


def is_correct(answer: Column, expected: Column) -> Column:
    """All expected tokens stand in the answer."""
    return let(scorer_normalise(answer), lambda own: F.forall(expected, lambda t: F.contains(own, scorer_normalise(t))))


def parse_json_object(raw: Column) -> Column:
    """The first `{` to the last `}` of a reply, code fences dropped, as a VARIANT; null where there is none."""
    text = strip(F.regexp_replace(strip(raw), r"(?m)^```(?:json)?|```$", ""))
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    body = F.when((start > 0) & F.contains(text, F.lit("}")) & (end > start), F.substring(text, start, end - start + 1))
    return F.try_parse_json(body)
