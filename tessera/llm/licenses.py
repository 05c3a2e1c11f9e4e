"""License scan by ordered signature rules.

A text becomes its words (A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`) with one space around each, so a
rule need not care for line ends or punctuation. Rules are regular expressions: the hand-written signatures of texts,
headers and notices in `license_signatures`, and, made from the tables below, for each license its names, versions
and web addresses in the phrasings of tags, notices, names and mentions. A rule runs only
where words stand that each of its matches must hold; these are derived from the expressions. Every rule has a priority
(0 is the strongest). A detection goes if its interval of words lies in a kept one of equal or higher priority, or if it
overlaps one of higher priority; what stays gives labels, intervals and a score. Base phrases always stay.

Defined results: null, empty and wordless texts have no labels and score 0; equal intervals of equal priority keep
the rule that comes first; rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import PLAIN_WORDS, as_bytes, only
from tessera.llm.license_signatures import signatures

#: Fixed phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label stem, name as words, short names, versions (words -> label suffix), web address as words.
FAMILIES = (
    ("mit", r"mit", r"mit|x11 mit|expat", (), r"opensource org licenses mit"),
    ("apache", r"apache(?: software)?", r"apache|asl", ("1 0", "1 1", "2 0", "2"), r"apache org licenses license 2 0"),
    ("gpl", r"(?:gnu )?general public", r"gpl|gnu gpl", ("1", "2", "2 0", "3", "3 0"), r"gnu org licenses gpl"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public", r"lgpl|gnu lgpl", ("2", "2 1", "3", "3 0"), r"gnu org licenses lgpl"),
    ("agpl", r"(?:gnu )?affero general public", r"agpl|gnu agpl", ("1", "3", "3 0"), r"gnu org licenses agpl"),
    ("gfdl", r"(?:gnu )?free documentation", r"gfdl|fdl", ("1 1", "1 2", "1 3"), r"gnu org licenses fdl"),
    ("bsd", r"(?:(?:new|modified|simplified|revised) )?bsd", r"bsd|0bsd", ("2 clause", "3 clause", "4 clause"), r"opensource org licenses bsd"),
    ("mpl", r"mozilla public", r"mpl", ("1 0", "1 1", "2 0"), r"mozilla org mpl"),
    ("epl", r"eclipse public", r"epl", ("1 0", "2 0"), r"eclipse org legal epl"),
    ("edl", r"eclipse distribution", r"edl", ("1 0",), r"eclipse org org documents edl"),
    ("eupl", r"european union public", r"eupl", ("1 0", "1 1", "1 2"), r"ec europa eu idabc eupl"),
    ("cddl", r"common development and distribution", r"cddl", ("1 0", "1 1"), r"opensource org licenses cddl1"),
    ("cpl", r"common public", r"cpl", ("0 5", "1 0"), r"ibm com developerworks library os cpl"),
    ("cpal", r"common public attribution", r"cpal", ("1 0",), r"opensource org licenses cpal"),
    ("artistic", r"artistic", r"artistic", ("1 0", "2 0"), r"perlfoundation org artistic"),
    ("isc", r"isc", r"isc", (), r"opensource org licenses isc"),
    ("zlib", r"zlib(?: libpng)?", r"zlib", (), r"zlib net zlib license"),
    ("boost", r"boost software", r"bsl|boost", ("1 0",), r"boost org license 1 0"),
    ("unlicense", r"unlicense", r"unlicense", (), r"unlicense org"),
    ("wtfpl", r"do what the fuck you want to public", r"wtfpl", ("1", "2"), r"wtfpl net"),
    ("cc-by", r"creative commons attribution", r"cc by", ("1 0", "2 0", "2 5", "3 0", "4 0"), r"creativecommons org licenses by"),
    ("cc-by-sa", r"creative commons attribution share ?alike", r"cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0"), r"creativecommons org licenses by sa"),
    ("cc-by-nc", r"creative commons attribution non ?commercial", r"cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0"), r"creativecommons org licenses by nc"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:s|atives)", r"cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0"), r"creativecommons org licenses by nd"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike", r"cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0"), r"creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:s|atives)", r"cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0"), r"creativecommons org licenses by nc nd"),
    ("cc0", r"creative commons zero|cc0", r"cc0", ("1 0",), r"creativecommons org publicdomain zero"),
    ("odbl", r"open database", r"odbl", ("1 0",), r"opendatacommons org licenses odbl"),
    ("odc-by", r"open data commons attribution", r"odc by", ("1 0",), r"opendatacommons org licenses by"),
    ("pddl", r"public domain dedication and", r"pddl", ("1 0",), r"opendatacommons org licenses pddl"),
    ("psf", r"python(?: software foundation)?", r"psf|python", ("2", "2 0"), r"python org psf license"),
    ("php", r"php", r"php", ("3 0", "3 01"), r"php net license"),
    ("ruby", r"ruby", r"ruby", (), r"ruby lang org license"),
    ("openssl", r"openssl", r"openssl", (), r"openssl org source license"),
    ("postgresql", r"postgresql", r"postgresql", (), r"postgresql org about licence"),
    ("ncsa", r"university of illinois ncsa open source", r"ncsa", (), r"opensource org licenses ncsa"),
    ("osl", r"open software", r"osl", ("1 0", "2 0", "2 1", "3 0"), r"opensource org licenses osl"),
    ("afl", r"academic free", r"afl", ("1 1", "1 2", "2 0", "2 1", "3 0"), r"opensource org licenses afl"),
    ("ofl", r"sil open font", r"ofl", ("1 0", "1 1"), r"scripts sil org ofl"),
    ("ecl", r"educational community", r"ecl", ("1 0", "2 0"), r"opensource org licenses ecl"),
    ("ms-pl", r"microsoft public", r"ms pl", (), r"opensource org licenses ms pl"),
    ("ms-rl", r"microsoft reciprocal", r"ms rl", (), r"opensource org licenses ms rl"),
    ("upl", r"universal permissive", r"upl", ("1 0",), r"oss oracle com licenses upl"),
    ("vim", r"vim", r"vim", (), r"vimhelp org uganda"),
    ("w3c", r"w3c(?: software)?", r"w3c", (), r"w3 org consortium legal"),
    ("bsl", r"business source", r"busl", ("1 0", "1 1"), r"mariadb com bsl11"),
    ("sspl", r"server side public", r"sspl", ("1", "1 0"), r"mongodb com licensing server side public license"),
    ("elastic", r"elastic", r"elastic", ("1 0", "2 0"), r"elastic co licensing elastic license"),
)

#: label, expression; for what is no family.
SINGLE = (
    ("public-domain", r"(?:released into|dedicated to|placed in|in) the public domain"),
    ("all-rights-reserved", r"all rights reserved"),
    ("proprietary", r"(?:proprietary and confidential|proprietary license)"),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d"),
    ("no-warranty", r"(?:without|absolutely no) warranty(?: of any kind)?"),
    ("warranty-disclaimer", r"provided as is without warranty"),
    ("commercial", r"commercial use (?:is )?(?:prohibited|not permitted|forbidden)"),
    ("redistribution", r"(?:may not|do not) redistribute"),
)

SCORES = (1.0, 0.9, 0.8, 0.6, 0.4)


class Rule(NamedTuple):
    label: str
    priority: int
    keys: tuple[frozenset[bytes], ...]  # a match holds a word of each
    pattern: re.Pattern[bytes]


def compiled(expression: str) -> re.Pattern[bytes]:
    """Whole words: a space before and a space ahead."""
    return re.compile(f" (?:{expression})(?= )".encode())


def spelled(expression: str) -> set[str]:
    """All strings of an expression made of characters, `[..]`, `\\d`, `(?:..|..)` and `?`."""

    def choice(i: int) -> tuple[set[str], int]:
        out, i = row(i)
        while i < len(expression) and expression[i] == "|":
            more, i = row(i + 1)
            out |= more
        return out, i

    def row(i: int) -> tuple[set[str], int]:
        out = {""}
        while i < len(expression) and expression[i] not in "|)":
            if expression.startswith("(?:", i):
                item, i = choice(i + 3)
                i += 1
            elif expression[i] == "[":
                end = expression.index("]", i)
                item, i = set(expression[i + 1 : end]), end + 1
            elif expression.startswith(r"\d", i):
                item, i = set("0123456789"), i + 2
            else:
                item, i = {expression[i]}, i + 1
            if expression.startswith("?", i):
                item, i = item | {""}, i + 1
            out = {a + b for a in out for b in item}
        return out, i

    return choice(0)[0]


def key_words(expression: str) -> frozenset[bytes]:
    """Words of which every string of the expression holds at least one: a common one, or else one of each string."""
    strings = [set(x.split()) for x in spelled(expression)]
    longest = lambda words: max(words, key=lambda w: (len(w), w)).encode()
    common = set.intersection(*strings)
    return frozenset([longest(common)] if common else map(longest, strings))


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, the strongest first: tag, text or notice, name with version, name or address, mention."""
    out = []
    word = r"licen[cs]e"
    notice = r"(?:re)?(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?"
    tagged, under, licensed = key_words("spdx"), key_words("under"), frozenset(x.encode() for x in spelled(rf"{word}d?"))
    for label, name, short, versions, address in FAMILIES:
        names, shorts, either = key_words(name), key_words(short), key_words(f"{name}|{short}")
        for v in versions:
            number = re.sub(r" ", "-" if "clause" in v else ".", v)
            number = number if "clause" in v or "." in number else f"{number}.0"
            full = f"{label}-{number}"
            version = rf"(?:v(?:ersion)? ?)?{v}" if "clause" not in v else v
            named = rf"(?:{name})(?: public)? (?:{word} )?{version}(?: (?:{word}|international))?"
            if "clause" in v:
                named = rf"(?:{v} (?:{name})(?: {word})?|(?:{name})(?: {word})? {v})"
            out += [
                Rule(full, 0, (tagged, shorts), compiled(rf"spdx license identifier (?:{short}) {v}")),
                Rule(full, 1, (under, either), compiled(rf"{notice}(?:{named}|(?:{short}) {v})")),
                Rule(full, 2, (names,), compiled(named)),
                Rule(full, 2, (licensed, shorts), compiled(rf"(?:{short}) {version} {word}")),
            ]
        out += [
            Rule(label, 0, (tagged, shorts), compiled(rf"spdx license identifier (?:{short})")),
            Rule(label, 1, (under, licensed, either), compiled(rf"{notice}(?:{name}|{short}) {word}")),
            Rule(label, 3, (licensed, names), compiled(rf"(?:{name}) {word}")),
            Rule(label, 3, (licensed, shorts), compiled(rf"(?:{short}) {word}")),
            Rule(label, 3, (key_words(address),), compiled(rf"(?:www )?{address}")),
            Rule(label, 4, (licensed, shorts), compiled(rf"{word}d? (?:is |under |by )?(?:the )?(?:{short})")),
        ]
    out += [Rule(label, 1, (key_words(expression),), compiled(expression)) for label, expression in signatures()]
    out += [Rule(label, 2, (key_words(expression),), compiled(expression)) for label, expression in SINGLE]
    return tuple(sorted(out, key=lambda r: r.priority))


class Detection(NamedTuple):
    priority: int
    start: int
    end: int
    order: int
    label: str


def resolved(found: list[Detection]) -> list[Detection]:
    """Stronger and longer first; what lies in a kept interval, or overlaps a stronger one, goes.

    Kept intervals of one priority hold none of each other, so in the order of their starts their ends rise too; what
    stronger ones cover is kept as disjoint intervals. Both are searched by halves.
    """
    kept: list[Detection] = []
    covered: list[tuple[int, int]] = []
    for _, group in groupby(sorted(found, key=lambda d: (d.priority, d.start - d.end, d.order, d.start)), key=lambda d: d.priority):
        own: list[tuple[int, int]] = []
        for d in group:
            at = bisect_left(covered, (d.end,)) - 1
            if at >= 0 and covered[at][1] > d.start:
                continue
            at = bisect_right(own, (d.start, float("inf"))) - 1
            if at >= 0 and own[at][1] >= d.end:
                continue
            own.insert(at + 1, (d.start, d.end))
            kept.append(d)
        merged: list[tuple[int, int]] = []
        for start, end in sorted(covered + own):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        covered = merged
    return sorted(kept, key=lambda d: (d.start, d.end))


BASE_PATTERNS = tuple((compiled(phrase), phrase.encode(), label) for phrase, label in BASE)


@cache
def by_word() -> tuple[frozenset[bytes], dict[bytes, tuple[int, ...]]]:
    """All words of keys and of base phrases, and the rules (places in rules()) of which a word is a last key."""
    places: dict[bytes, list[int]] = {}
    for i, r in enumerate(rules()):
        for w in r.keys[-1]:
            places.setdefault(w, []).append(i)
    base = (key_words(phrase) for phrase, _ in BASE)
    return frozenset().union(*base, *(k for r in rules() for k in r.keys)), {w: tuple(p) for w, p in places.items()}


def scan(text: bytes) -> tuple[int, list[tuple[str, int]], list[Detection]]:
    """Words, base places (label, first word) and resolved detections (in words) of a text."""
    words = text.translate(PLAIN_WORDS).split()
    keys, places = by_word()
    here = keys.intersection(words)
    if not here:
        return len(words), [], []
    line = b" " + b" ".join(words) + b" "
    before = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)  # the space before each word, and the last one
    place = lambda at: int(np.searchsorted(before, at))
    base = [(label, place(m.start())) for p, phrase, label in BASE_PATTERNS if phrase in line for m in p.finditer(line)]
    found = []
    for order in sorted({i for w in here for i in places.get(w, ())}):
        r = rules()[order]
        if any(k.isdisjoint(here) for k in r.keys):
            continue
        found += [Detection(r.priority, place(m.start()), place(m.end()), order, r.label) for m in r.pattern.finditer(line)]
    return len(words), base, resolved(found)


COLUMNS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, detections array<struct<label:string,start:long,end:long,priority:int>>"
)
DETECTIONS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32())]))
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", DETECTIONS)]
)


def described(doc: int | None, text: bytes) -> tuple:
    n, base, found = scan(text)
    places = [w for _, w in base]
    names = {label for label, _ in base}
    score = max([SCORES[d.priority] for d in found] + [SCORES[3] for _ in base[:1]], default=0.0)
    return (
        doc, n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(names)),
        ",".join(sorted(names | {d.label for d in found})), score,
        [{"label": d.label, "start": d.start, "end": d.end, "priority": d.priority} for d in found],
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document the columns of COLUMNS; detections are intervals of words, from 0, the end excluded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(d, t) for d, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return only(docs).mapInArrow(run, COLUMNS)
