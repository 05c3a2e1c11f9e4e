import pytest
from pyspark.sql import functions as F

from tessera.functions import render
from tessera.operators import decision, evaluation, generation, retrieval, verification
from tessera.plans import queries
from tests import fixtures


def test_retries_and_fallback_models():
    calls = []

    def client(model, system, user, json_mode, max_tokens):
        calls.append(model)
        if model == "a":
            raise generation.RateLimited("daily cap", daily=True)
        if len(calls) < 4:
            raise generation.RateLimited("slow down")
        return "fine"

    waits = []
    assert generation.complete(client, ["a", "b"], "s", "u", wait=waits.append) == ("fine", "b")
    assert calls == ["a", "b", "b", "b"] and waits == [1.0, 2.0]


def test_the_last_model_and_lost_connections_give_up():
    def limited(*_):
        raise generation.RateLimited("no")

    tried = []

    def lost(model, *_):
        tried.append(model)
        raise generation.Unreachable("no")

    with pytest.raises(generation.RateLimited):
        generation.complete(limited, ["a"], "s", "u", wait=lambda _: None)
    with pytest.raises(generation.Unreachable):
        generation.complete(lost, ["a", "b"], "s", "u", retries=1, wait=lambda _: None)
    assert tried == ["a", "a"]


def test_no_call_below_the_gate(spark):
    chunks = spark.createDataFrame([("c1", "Staff get 25 days of leave.", 1, "s")], "id string, text string, page long, source string")
    questions = spark.createDataFrame([(1, "days of leave"), (2, "zebra")], "qid long, text string")
    found = retrieval.top_k_hashed(chunks, "id", questions, "qid", 1)
    passed = retrieval.similarity_gate(questions, found, "qid", 0.2).where("passed").select("qid")
    calls = spark.sparkContext.accumulator(0)

    def load():
        def client(model, system, user, json_mode, max_tokens):
            calls.add(1)
            return "It is 25 days 【1】."

        return client

    asked = questions.withColumnRenamed("text", "question").join(passed, "qid")
    contexts = retrieval.context(found.join(chunks, "id"), "qid")
    replies = generation.replies(generation.prompts(asked, contexts, "qid"), "qid", load, generation.STRICT_SYSTEM)
    rows = generation.drafts(replies, "qid").collect()
    assert [(r.qid, r.draft, r.error) for r in rows] == [(1, "It is 25 days [1].", None)] and calls.value == 1


def test_a_failed_call_is_a_row(spark):
    def load():
        def client(*_):
            raise OSError("down")

        return client

    rows = generation.replies(spark.createDataFrame([(1, "p")], "qid long, prompt string"), "qid", load, "s").collect()
    assert rows[0].reply is None and "down" in rows[0].error


def test_llm_verdicts_over_odd_replies(spark):
    claims, errors = verification.claims_of_replies(fixtures.replies(spark), "qid")
    found = verification.llm_verdicts(claims, fixtures.retrieved(spark), "qid").collect()
    got = sorted((r.qid, r.claim_no, r.claim, r.supported, r.source_rank, r.quote, r.reason) for r in found)
    assert got == sorted(fixtures.VERDICTS)
    assert {r.qid: r.verify_error for r in errors.collect()} == fixtures.ERRORS


def test_strict_quotes(spark):
    claims, _ = verification.claims_of_replies(fixtures.replies(spark).where("qid = 11"), "qid")
    found = verification.llm_verdicts(claims, fixtures.retrieved(spark), "qid", strict=True).collect()
    assert {r.claim: r.supported for r in found} == {"Rowing": True, "Short": False, "Rowing too": True}


def nli_case(spark, draft):
    answers = spark.createDataFrame([(1, draft)], "qid long, draft string")
    text = "Staff get 25 days of leave. Meals are paid. Rooms are free. Trains are late."
    retrieved = spark.createDataFrame([(1, 1, text), (1, 2, "Nothing here")], "qid long, rank int, text string")
    return answers, retrieved


def test_nli_with_a_model(spark):
    answers, retrieved = nli_case(spark, "Staff get 25 days [1]. Staff get 99 days [1].")

    def load():
        return lambda pairs: [0.9504 if "25" in claim and "25" in premise else 0.1 for premise, claim in pairs]

    rows = sorted(verification.nli_verdicts(answers, retrieved, "qid", load).collect(), key=lambda r: r.claim_no)
    assert [(r.supported, r.source_rank, r.score) for r in rows] == [(True, 1, 0.95), (False, None, 0.1)]
    assert rows[0].quote == "Staff get 25 days of leave."
    counts = verification.support(verification.nli_verdicts(answers, retrieved, "qid", load), "qid").first()
    assert (counts.k, counts.n, counts.ratio) == (1, 2, 0.5)


def test_nli_without_claims_gives_no_row(spark):
    answers, retrieved = nli_case(spark, "Yes.")
    assert verification.nli_verdicts(answers, retrieved, "qid").count() == 0


@pytest.mark.parametrize(("n", "starts"), [(1, [0]), (2, [0]), (3, [0]), (4, [0, 2]), (5, [0, 2]), (6, [0, 2, 4])])
def test_windows(spark, n, starts):
    s = [f"Sentence {i} is here." for i in range(n)]
    rows = spark.createDataFrame([(1, 1, " ".join(s))], "qid long, rank int, text string")
    found = [r.premise for r in verification.premise_windows(rows, "qid").orderBy("no").collect()]
    want = list(dict.fromkeys([*s, *(" ".join(s[i : i + 3]) for i in starts)]))
    assert found == want


def test_entailment(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5],)], "l array<double>")
    x = df.select(verification.entailment(F.col("l"), 1).alias("x")).first().x
    assert abs(x - 0.6285317192) < 1e-9


def test_every_status(spark):
    rows = {r.qid: r for r in decision.decided(fixtures.cases(spark)).collect()}
    want = ["grounded", "partial", "ungrounded", "not_found", "not_found", "unverified", "unchecked", "grounded", "not_found", "not_found"]
    assert [rows[i].status for i in range(1, 11)] == want
    assert rows[3].answer == decision.UNGROUNDED_MESSAGE and rows[4].answer == decision.NOT_FOUND_MESSAGE and rows[1].answer == "It is 25 litres [1]."


def test_rates(spark):
    rows = {r.config: r for r in evaluation.eval_summary(evaluation.eval_rows(fixtures.results(spark))).collect()}
    llm = rows["llm"]
    assert (llm.answer_rate, llm.abstain_rate, llm.hallucination_rate, llm.grounded_precision) == (0.75, 0.5, 0.5, 1.0)
    assert llm.grounded_precision_all == pytest.approx(2 / 3)
    assert rows["wide"].answer_rate == pytest.approx(2 / 3)  # wide digits, ligatures and thin spaces score like plain ones
    assert rows["none"].grounded_precision is None and rows["only"].answer_rate is None


def test_published_dev_rates(spark):
    """12 answerable questions of which 11 were grounded and right, 10 unanswerable ones not found: 92, 100 and 0 %."""
    rows = [("nli", "answerable", f"q{i}", ["1"], None, "grounded" if i else "ungrounded", "1") for i in range(12)]
    rows += [("nli", "unanswerable", f"u{i}", None, "off-topic", "not_found", "") for i in range(10)]
    df = spark.createDataFrame(rows, fixtures.results(spark).schema)
    r = evaluation.eval_summary(evaluation.eval_rows(df)).first()
    assert (round(r.answer_rate, 2), r.abstain_rate, r.hallucination_rate, r.grounded_precision) == (0.92, 1.0, 0.0, 1.0)


def test_highlights(spark):
    cases = [
        ("Oars <b>up to</b> 60 miles out.", ["up to 60 miles"], "Oars &lt;b&gt;up to&lt;/b&gt; 60 miles out."),
        ("Keep 25 litres of  spare\noil.", ["25 LITRES of spare oil"], "Keep <mark>25 litres of  spare\noil</mark>."),
        ("a b c d", ["b c", "c d", "", "a", None], "<mark>a</mark> <mark>b c</mark> d"),
        ("x < y & 'z'", ["X", "!!"], "<mark>x</mark> &lt; y &amp; &#x27;z&#x27;"),
        ("one two one two", ["two", "one two", "TWO"], "<mark>one two</mark> one two"),
        ("été à é", ["t", "a"], "é<mark>t</mark>é à é"),
        ("nothing", None, "nothing"), (None, ["x"], None), ("", ["x"], ""),
    ]
    df = spark.createDataFrame([(i, t, q) for i, (t, q, _) in enumerate(cases)], "i int, t string, q array<string>")
    found = df.select("i", render.highlight_html(F.col("t"), F.col("q")).alias("x")).orderBy("i").collect()
    assert [r.x for r in found] == [want for *_, want in cases]


def test_badges_and_captions(spark):
    df = spark.createDataFrame([("partial", 1, 2, {"verify": 0.5})], "s string, k int, n int, t map<string,double>")
    r = df.select(render.badge(F.col("s"), F.col("k"), F.col("n")).alias("b"), render.timings(F.col("t")).alias("t"), render.share(F.lit(0.5), F.lit(4)).alias("p")).first()
    assert (r.b.level, r.b.label, r.t, r.p) == ("warning", "Partially grounded - 1/2 claims supported. Check the flagged claims.", "verify 0.50s", "2/4")


def test_highlight_covers_every_document(spark, tmp_path):
    texts = ["One is <here>. Two is here. Three is here. Four is here.", "Alone.", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0), (2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r.html for r in queries.highlight(spark, str(tmp_path)).collect()}
    assert found == {0: "One is &lt;here&gt;. <mark>Two is here</mark>. <mark>Three is here</mark>. Four is here.", 1: "Alone.", 2: "", 3: None}


def test_a_hosted_client_maps_requests_and_errors(monkeypatch):
    import sys
    from types import ModuleType, SimpleNamespace

    sent = []

    class Limited(Exception):
        pass

    class Lost(Exception):
        pass

    class Groq:
        def __init__(self, api_key):
            assert api_key == "k"
            self.chat = SimpleNamespace(completions=SimpleNamespace(create=self.create))

        def create(self, **fields):
            sent.append(fields)
            if fields["model"] == "limited":
                raise Limited("too many tokens per day")
            if fields["model"] == "lost":
                raise Lost("no route")
            return SimpleNamespace(choices=[SimpleNamespace(message=SimpleNamespace(content=None if fields["model"] == "mute" else "fine"))])

    fake = ModuleType("groq")
    fake.Groq, fake.RateLimitError, fake.APIConnectionError = Groq, Limited, Lost
    monkeypatch.setitem(sys.modules, "groq", fake)
    monkeypatch.delenv("GROQ_API_KEY", raising=False)
    with pytest.raises(generation.MissingKey):
        generation.hosted()()
    monkeypatch.setenv("GROQ_API_KEY", "k")
    client = generation.hosted(effort="low")()
    assert client("openai/gpt-oss-20b", "s", "u", True, 9) == "fine" and client("mute", "s", "u", False, 9) == ""
    assert sent[0]["response_format"] == {"type": "json_object"} and sent[0]["reasoning_effort"] == "low" and sent[0]["temperature"] == 0
    assert "response_format" not in sent[1] and "reasoning_effort" not in sent[1] and sent[1]["max_tokens"] == 9
    assert [m["role"] for m in sent[1]["messages"]] == ["system", "user"]
    with pytest.raises(generation.RateLimited) as limit:
        client("limited", "s", "u", False, 9)
    assert limit.value.daily
    with pytest.raises(generation.Unreachable):
        client("lost", "s", "u", False, 9)
    assert generation.complete(client, ["limited", "mute"], "s", "u", wait=lambda _: None) == ("", "mute")


def test_asking_with_scripted_models(spark):
    """Pages and questions to every kind of answer in one call."""
    from tessera.operators import asking, chunking

    pages = spark.createDataFrame([("log", 1, "The lamp burns 25 litres of oil in winter. It is lit at dusk."), ("log", 2, "Crews row 60 miles per watch.")], "source string, page long, text string")
    chunks = chunking.chunk_pages(pages)
    asked = ["lamp litres of oil", "crews row miles", "oil in winter lamp", "lamp lit at dusk", "zebra", "watch crews miles row"]
    questions = spark.createDataFrame(list(enumerate(asked)), "qid long, text string")
    found = retrieval.top_k_hashed(chunks, "id", questions, "qid").join(chunks, "id").cache()
    drafts = {0: "It burns 25 litres of oil [1].", 1: "They row 60 miles [1]. They row 70 miles [1].", 2: "NOT_FOUND", 3: "It is lit at noon [1].", 5: "They row at times."}
    told = {
        0: '{"claims":[{"claim":"25 litres","supported":true,"source":1,"quote":"25 litres of oil","reason":""}]}',
        1: '{"claims":[{"claim":"60","supported":true,"source":1,"quote":"60 miles","reason":""},{"claim":"70","supported":true,"source":1,"quote":"70 miles","reason":""}]}',
        3: '{"claims":[{"claim":"noon","supported":false,"source":null,"quote":"","reason":"dusk"}]}',
        5: "sorry",
    }
    calls = []

    def scripted(name, replies):
        table = spark.createDataFrame([(k, v) for k, v in replies.items()], "qid long, reply string")

        def reply(prompts):
            calls.append((name, sorted(r.qid for r in prompts.collect())))
            return prompts.join(table, "qid", "left")

        return reply

    took = {}
    verify = asking.verify_by_replies(scripted("verify", told), "qid")
    asked_rows = questions.withColumnRenamed("text", "question")
    answers, verdicts = asking.ask(asked_rows, found, "qid", scripted("draft", drafts), verify, timings=took)
    assert {r.qid: (r.status, r.k, r.n, r.verify_error) for r in answers.collect()} == {
        0: ("grounded", 1, 1, None), 1: ("partial", 1, 2, None), 2: ("not_found", None, None, None), 3: ("ungrounded", 0, 1, None),
        4: ("not_found", None, None, None), 5: ("unverified", None, None, "no JSON object"),
    }
    assert calls == [("draft", [0, 1, 2, 3, 5]), ("verify", [0, 1, 3, 5])] and list(took) == ["retrieve", "generate", "verify"]
    sources = {(r.qid, r["rank"]): r.quotes for r in asking.sources_with_quotes(found, verdicts, "qid").collect()}
    assert sources[0, 1] == ["25 litres of oil"] and sources[0, 2] == [] and sources[4, 1] == []
    plain, _ = asking.ask(asked_rows, found, "qid", scripted("draft", drafts))
    assert {r.status for r in plain.collect()} == {"unchecked", "not_found"}
    by_words, _ = asking.ask(asked_rows, found, "qid", scripted("draft", drafts), asking.verify_by_entailment("qid"))
    assert {r.qid: r.status for r in by_words.collect()}[0] == "grounded"
