"""Small fixed tables for what the driver's tables never hold: replies of a verifier, decisions, scored answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OIL = "Each buoy keeps 25 litres of spare lamp oil per winter season. Up to 5 spare litres may be moved on."
ROWING = "Crews row up to 60 miles per watch in calm water. Reports are due within 30 hours."

#: qid, raw reply
REPLIES = (
    (1, '{"claims":[{"claim":"It is 25 litres","supported":true,"source":1,"quote":"25 litres of spare lamp oil","reason":"stated"}]}'),
    (2, '```json\n{"claims":[{"claim":"It is 25 litres","supported":true,"source":1,"quote":"Each buoy ... winter season","reason":""},{"claim":"It is 99 litres","supported":false,"source":null,"quote":"","reason":"absent"}]}\n```'),
    (3, 'Sure: {"claims":[{"claim":"It is 30 litres","supported":true,"source":1,"quote":"30 litres of spare lamp oil","reason":"seen"}]} Done.'),
    (4, '{"claims":[{"claim":"It is 25 litres","supported":true,"source":99,"quote":"25 litres","reason":""}]}'),
    (5, "not json"),
    (6, '{"claims":[]}'),
    (7, '{"answer":1}'),
    (8, "{broken"),
    (9, '{"claims":[{"claim":null,"supported":true,"source":1,"quote":"25 litres"},"words",{"claim":"Text true","supported":"true","source":1,"quote":"25 litres"}]}'),
    (10, '{"claims":[{"claim":"Source true","supported":true,"source":true,"quote":"25 litres"},{"claim":"Source 2.0","supported":true,"source":2.5,"quote":"60 miles"}]}'),
    (11, '{"claims":[{"claim":"Rowing","supported":true,"source":2,"quote":"up to 60 MILES per watch"},{"claim":"Short","supported":true,"source":1,"quote":"5 litres of spare lamp oil"},{"claim":"Rowing too","supported":true,"source":2,"quote":"Reports are due"}]}'),
    (12, '{"claims":["only words"]}'),
)

#: qid, passed, draft, verified, verify_error, k, n
CASES = (
    (1, True, "It is 25 litres [1].", True, None, 1, 1),
    (2, True, "Some.", True, None, 1, 2),
    (3, True, "None.", True, None, 0, 1),
    (4, False, None, True, None, None, None),
    (5, True, " not found. ", True, None, None, None),
    (6, True, "Draft.", True, "no claims", None, None),
    (7, True, "Draft.", False, None, None, None),
    (8, True, "Not found in 2019", True, None, 1, 1),
    (9, None, "Draft.", True, None, 1, 1),
    (10, True, "", True, None, None, None),
)

#: config, type, q, expect, kind, status, answer
RESULTS = (
    ("llm", "answerable", "q1", ["25"], None, "grounded", "It is 25 litres [1]."),
    ("llm", "answerable", "q2", ["3"], None, "grounded", "Up to three miles per watch"),
    ("llm", "answerable", "q3", ["2 hours"], None, "partial", "Within two  hours"),
    ("llm", "answerable", "q4", ["9"], None, "not_found", "Not found in the document."),
    ("llm", "unanswerable", "q5", None, "off-topic", "not_found", "Not found in the document."),
    ("llm", "unanswerable", "q6", None, "near-miss", "grounded", "It is 5."),
    ("none", "answerable", "q1", ["25"], None, "unchecked", "It is 24 litres."),
    ("none", "answerable", "q2", ["3", "watch"], None, "unchecked", "three miles a WATCH"),
    ("none", "unanswerable", "q5", None, "off-topic", "unchecked", "Yes."),
    ("nli", "answerable", "q1", ["25"], None, "ungrounded", "25"),
    ("wide", "answerable", "q1", ["25 ﬁsh"], None, "grounded", "It is\u202f２５ fish."),
    ("wide", "answerable", "q2", ["25"], None, "grounded", "It is 24."),
    ("wide", "answerable", "q3", ["five"], None, "grounded", "ﬁve"),
    ("only", "unanswerable", "q5", None, "off-topic", "unverified", "Yes."),
)


def replies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPLIES, "qid long, raw string")


def retrieved(spark: SparkSession) -> DataFrame:
    """Two chunks for every reply."""
    rows = [(q, r, p, t) for q, _ in REPLIES for r, p, t in ((1, 1, OIL), (2, 3, ROWING))]
    return spark.createDataFrame(rows, "qid long, rank int, page long, text string")


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CASES, "qid long, passed boolean, draft string, verified boolean, verify_error string, k long, n long")


def results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESULTS, "config string, type string, q string, expect array<string>, kind string, status string, answer string")


def question_spec(spark: SparkSession) -> DataFrame:
    from tessera.sources.files import QUESTION_SET

    rows = [
        ("manual.pdf", "note", [("How many days?", ["25"]), ("Who?", ["a", "b"])], [("Which colour?", "off-topic")]),
        ("empty.pdf", None, [], [("Why?", "near-miss")]),
    ]
    return spark.createDataFrame(rows, QUESTION_SET)


#: What the verdicts over the replies must be: qid, claim_no, claim, supported, source_rank, quote, reason.
NONE = "[evidence quote not found in cited source]"
VERDICTS = (
    (1, 0, "It is 25 litres", True, 1, "25 litres of spare lamp oil", "stated"),
    (2, 0, "It is 25 litres", True, 1, "Each buoy ... winter season", ""),
    (2, 1, "It is 99 litres", False, None, "", "absent"),
    (3, 0, "It is 30 litres", False, None, "", f"seen {NONE}"),
    (4, 0, "It is 25 litres", False, None, "", NONE),
    (9, 2, "Text true", False, None, "", ""),
    (10, 0, "Source true", False, None, "", NONE),
    (10, 1, "Source 2.0", False, None, "", NONE),
    (11, 0, "Rowing", True, 2, "up to 60 MILES per watch", ""),
    (11, 1, "Short", True, 1, "5 litres of spare lamp oil", ""),
    (11, 2, "Rowing too", True, 2, "Reports are due", ""),
)
ERRORS = {q: {5: "no JSON object", 8: "no JSON object", 6: "no claims", 7: "no claims", 12: "no usable claims"}.get(q) for q in range(1, 13)}
