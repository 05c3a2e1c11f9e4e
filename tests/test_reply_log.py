import os
import uuid
from pathlib import Path

import pytest

from tessera.config import Settings
from tessera.operators import asking, decision, evaluation, generation, reply_log
from tests import fixtures

PROMPTS = "qid long, prompt string, extra string"


def rows_of(spark, prompts):
    return spark.createDataFrame([(k, p, "x") for k, p in enumerate(prompts)], PROMPTS).repartition(3)


def counting(folder, behave=lambda user, model: f"{model} says {user}"):
    """A loader of a client that leaves a file for each call."""

    def load():
        def client(model, system, user, json_mode, max_tokens):
            Path(folder, f"{uuid.uuid4().hex}").write_text(f"{model}|{user}")
            return behave(user, model)

        return client

    return load


def calls(folder):
    return sorted(p.read_text() for p in Path(folder).iterdir())


def run(spark, prompts, load, log, **settings):
    found = reply_log.logged(rows_of(spark, prompts), "qid", load, "s", log, models=("a", "b"), wait=lambda _: None, **settings)
    return {r.qid: (r.reply, r.model, r.error) for r in found.collect()}


def test_no_prompt_is_paid_for_twice(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()
    load, log = counting(made), f"{tmp_path}/log"
    prompts = ["one", "two", "two", None, "", "three"]
    want = {k: (f"a says {p or ''}", "a", None) for k, p in enumerate(prompts)}
    assert run(spark, prompts, load, log) == want and len(calls(made)) == 4
    assert run(spark, prompts, load, log) == want and len(calls(made)) == 4
    assert run(spark, ["four", *prompts], load, log)[0] == ("a says four", "a", None) and len(calls(made)) == 5
    run(spark, ["one"], load, log, max_tokens=9)  # another length is another call
    assert len(calls(made)) == 6 and not list(Path(log, "calls").rglob("*.json"))
    assert reply_log.opened(spark, log).count() == 6
    assert run(spark, [], load, log) == {}


def test_models_and_errors_are_columns_and_failures_are_tried_again(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()

    def behave(user, model):
        if user == "limit" and model == "a":
            raise generation.RateLimited("daily", daily=True)
        if user == "lost" and not os.path.exists(f"{made}.up"):
            raise generation.Unreachable("no route")
        return f"{model}!"

    load, log = counting(made, behave), f"{tmp_path}/log"
    assert run(spark, ["fine", "limit", "lost"], load, log) == {0: ("a!", "a", None), 1: ("b!", "b", None), 2: (None, None, "Unreachable: no route")}
    assert calls(made) == ["a|fine", "a|limit", "a|lost", "a|lost", "a|lost", "b|limit"]
    Path(f"{made}.up").write_text("")
    assert run(spark, ["fine", "limit", "lost"], load, log)[2] == ("a!", "a", None)
    assert len(calls(made)) == 7


def test_a_killed_job_loses_no_reply(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()
    prompts = [f"p{k}" for k in range(30)]

    def dying(user, model):
        if len(os.listdir(made)) == 12:
            os._exit(1)
        return f"{model} says {user}"

    with pytest.raises(Exception):  # noqa: B017  the worker dies
        run(spark, prompts, counting(made, dying), f"{tmp_path}/log", tasks=1, together=1)
    assert len(calls(made)) == 12
    got = run(spark, prompts, counting(made), f"{tmp_path}/log", tasks=2)
    assert {k: r for k, (r, *_) in got.items()} == {k: f"a says {p}" for k, p in enumerate(prompts)}
    assert len(calls(made)) == 31  # the call that died, and each of the 30 once


def test_a_bucket_keeps_the_rate():
    clock = [0.0]
    waited = []

    def wait(seconds):
        waited.append(round(seconds, 6))
        clock[0] += seconds

    bucket = reply_log.TokenBucket(2.0, 3, lambda: clock[0], wait)
    for _ in range(7):
        bucket.take()
    assert waited == [0.5] * 4 and clock[0] == pytest.approx(2.0)
    clock[0] += 100
    for _ in range(3):
        bucket.take()
    assert len(waited) == 4


PAGES = [("log", 1, "The lamp burns 25 litres of oil in winter. It is lit at dusk."), ("log", 2, "Crews row 60 miles per watch.")]


def test_failed_calls_are_no_abstentions(spark, tmp_path):
    """Pages and questions in, answers out, with a client that fails for some: as generator and as verifier."""

    def load():
        def client(model, system, user, json_mode, max_tokens):
            if "crews" in user and not json_mode or "noon" in user:
                raise OSError("down")
            if json_mode:
                return '{"claims":[{"claim":"25 litres","supported":true,"source":1,"quote":"25 litres of oil","reason":""}]}'
            return "It is lit at noon [1]." if "lit at" in user.split("QUESTION:")[1] else "It burns 25 litres of oil [1]."

        return client

    pages = spark.createDataFrame(PAGES, "source string, page long, text string")
    questions = spark.createDataFrame([(0, "lamp litres of oil"), (1, "crews row miles"), (2, "lamp lit at dusk"), (3, "zebra")], "qid long, question string")
    generate, verify = asking.hosted_generate("qid", load, log=f"{tmp_path}/log", models=("m",)), asking.hosted_verify("qid", load, models=("m",))
    took = {}
    answers, verdicts, sources = asking.answered(pages, questions, "qid", generate, verify, timings=took)
    got = {r.qid: r for r in answers.collect()}
    assert {k: (r.status, r.abstained, r.model, r.error) for k, r in got.items()} == {
        0: ("grounded", False, "m", None), 1: ("failed", False, None, "OSError: down"), 2: ("unverified", False, "m", None), 3: ("not_found", True, None, None)
    }
    assert got[1].answer == decision.FAILED_MESSAGE and got[2].verify_error == "OSError: down"
    assert list(took) == ["ingest", "generate", "verify", "retrieve"] or set(took) == {"ingest", "retrieve", "generate", "verify"}
    assert verdicts.count() == 1 and {(r.qid, r["rank"]): r.quotes for r in sources.collect()}[0, 1] == ["25 litres of oil"]


def test_a_reply_that_is_missing_is_an_error(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "qid long, reply string")
    assert {r.qid: (r.model, r.error) for r in asking.with_outcome(rows).collect()} == {1: (None, "no reply"), 2: (None, None)}


def test_rates_leave_failed_calls_out(spark):
    rows = [("c", "answerable", "q1", ["1"], None, "grounded", "1"), ("c", "answerable", "q2", ["1"], None, "failed", None)]
    rows += [("c", "unanswerable", "u1", None, "x", "failed", None), ("c", "unanswerable", "u2", None, "x", "not_found", ""), ("c", "unanswerable", "u3", None, "x", "partial", "y")]
    df = spark.createDataFrame(rows, fixtures.results(spark).schema)
    r = evaluation.eval_summary(evaluation.eval_rows(df)).first()
    assert (r.answer_rate, r.abstain_rate, r.hallucination_rate, r.n_answerable, r.n_unanswerable) == (1.0, 0.5, 0.5, 2, 3)


def test_default_models():
    found = Settings()
    assert found.models[0] == "openai/gpt-oss-120b" and len(found.models) == 3 and found.nli_model.startswith("cross-encoder/")
