"""Questions to answers in one call: retrieval, gate, draft, verification, decision, and the report with its sources.

Models are functions on DataFrames, so a hosted client, a local model and a scripted stand-in are all plugged in alike:
`generate` takes (qid, prompt) and returns at least (qid, reply); a verifier takes the drafts (qid, draft) and the
retrieved chunks and returns (verdicts, errors). Both see only the rows that are left for them: questions that pass
the gate, and drafts that say something.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.config import DEFAULTS
from tessera.functions import render
from tessera.functions import text as T
from tessera.operators import chunking, decision, evaluation, generation, reply_log, retrieval, verification
from tessera.tables import stored, work_dir

Generate = Callable[[DataFrame], DataFrame]
Verify = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def verify_by_replies(reply: Generate, qid: str, strict: bool = False) -> Verify:
    """A verifier that asks a model for JSON verdicts and checks the quotes; `reply` as in `generate`."""

    def verify(drafts: DataFrame, retrieved: DataFrame) -> tuple[DataFrame, DataFrame]:
        contexts = retrieval.context(retrieved, qid, headed=False)
        prompts = verification.verifier_prompts(drafts, contexts, qid)
        found = with_outcome(reply(prompts)).select(qid, F.col("reply").alias("raw"), "error")
        found = stored(found, work_dir(drafts.sparkSession, "verifier"), "replies")
        claims, errors = verification.claims_of_replies(found.where("raw is not null"), qid)
        failed = found.where("raw is null").select(qid, F.col("error").alias("verify_error"))
        return verification.llm_verdicts(claims, retrieved, qid, strict), errors.union(failed)

    return verify


def verify_by_entailment(qid: str, load=None, threshold: float = DEFAULTS.nli_threshold) -> Verify:
    """A verifier by entailment; drafts without a claim are an error."""

    def verify(drafts: DataFrame, retrieved: DataFrame) -> tuple[DataFrame, DataFrame]:
        verdicts = verification.nli_verdicts(drafts, retrieved, qid, load, threshold)
        errors = drafts.select(qid, F.when(F.size(T.split_claims(F.col("draft"))) == 0, "no claims").alias("verify_error"))
        return verdicts, errors

    return verify


def kept(df: DataFrame, folder: str, name: str, rows: dict[str, int] | None) -> DataFrame:
    """A written table. Where a map is given, it takes the number of rows, as they were counted by the write itself."""
    if rows is None:
        return stored(df, folder, name)
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows")), folder, name)
    rows[name] = int(seen.get.get("rows", 0))
    return out


def with_outcome(replies: DataFrame) -> DataFrame:
    """Replies with model and error, whether or not the generator tells them: a null reply is an error in any case."""
    for name in ("model", "error"):
        replies = replies if name in replies.columns else replies.withColumn(name, F.lit(None).cast("string"))
    return replies.withColumn("error", F.coalesce("error", F.when(F.col("reply").isNull(), "no reply")))


def hosted_generate(
    qid: str, load: Callable[[], generation.Client], naive: bool = False, log: str | None = None, models: tuple[str, ...] = DEFAULTS.models, **calls
) -> Generate:
    """A generator by a client, with the models in order; with a log no call is paid for twice."""
    return _hosted(qid, load, generation.NAIVE_SYSTEM if naive else generation.STRICT_SYSTEM, False, generation.ANSWER_TOKENS, log, models, calls)


def hosted_verify(
    qid: str, load: Callable[[], generation.Client], log: str | None = None, models: tuple[str, ...] = DEFAULTS.models, strict: bool = False, **calls
) -> Verify:
    """A verifier by a client's JSON verdicts."""
    return verify_by_replies(_hosted(qid, load, verification.VERIFIER_SYSTEM, True, generation.VERIFY_TOKENS, log, models, calls), qid, strict)


def _hosted(qid, load, system, json_mode, max_tokens, log, models, calls) -> Generate:
    def reply(prompts: DataFrame) -> DataFrame:
        if log:
            return reply_log.logged(prompts, qid, load, system, log, models, json_mode, max_tokens, **calls)
        return generation.replies(prompts, qid, load, system, models, json_mode, max_tokens, **calls)

    return reply


def drafted(questions: DataFrame, gate: DataFrame, retrieved: DataFrame, qid: str, generate: Generate, rows: dict[str, int] | None = None) -> DataFrame:
    """qid, draft, model, error of the questions that pass the gate, written once: replies cost calls."""
    passed = questions.join(gate.where("passed").select(qid), qid)
    prompts = generation.prompts(passed, retrieval.context(retrieved, qid), qid)
    found = with_outcome(generate(prompts)).select(qid, T.clean_answer(F.col("reply")).alias("draft"), "model", "error")
    return kept(found, work_dir(questions.sparkSession, "ask"), "drafts", rows)


def judged(
    questions: DataFrame, gate: DataFrame, drafts: DataFrame, retrieved: DataFrame, qid: str, verify: Verify | None = None, counts: dict[str, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(answers, verdicts) as from `ask`."""
    spark = questions.sparkSession
    rows = questions.join(gate, qid).join(drafts, qid, "left").withColumn("verified", F.lit(verify is not None))
    if verify:
        folder = work_dir(spark, "ask")
        said = drafts.where("error is null").where(~T.is_not_found(F.coalesce("draft", F.lit(""))))
        verdicts, errors = verify(said.select(qid, "draft"), retrieved)
        verdicts, errors = kept(verdicts, folder, "verdicts", counts), kept(errors, folder, "errors", counts)
        rows = rows.join(verification.support(verdicts, qid).select(qid, "k", "n"), qid, "left").join(errors, qid, "left")
    else:
        verdicts = spark.createDataFrame([], "qid string, claim_no int, claim string, supported boolean, source_rank int, quote string, score double, reason string")
        verdicts = verdicts.select(F.col("qid").cast(questions.schema[qid].dataType).alias(qid), *verdicts.columns[1:])
        rows = rows.selectExpr("*", "cast(null as bigint) as k", "cast(null as bigint) as n", "cast(null as string) as verify_error")
    answers = decision.decided(rows)
    return answers.select(qid, "question", "best", "status", "answer", "draft", "abstained", "k", "n", "verify_error", "model", "error"), verdicts


def ask(
    questions: DataFrame, retrieved: DataFrame, qid: str, generate: Generate, verify: Verify | None = None, least: float = DEFAULTS.min_similarity,
    timings: dict[str, float] | None = None, counts: dict[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(answers, verdicts). questions: qid, question; retrieved: qid, rank, id, score, page, source, text.

    Answers: qid, question, best, status, answer, draft, abstained, k, n, verify_error, model (that gave the draft), error (of the
    call for it: status failed), one row a question. Where maps are given, they take the seconds of each stage,
    each of which is run and written here, and the rows of what it wrote: gate, drafts, verdicts, errors.
    """
    took: dict[str, float] = {}

    def timed(stage: str, make):
        began = time.perf_counter()
        made = make()
        took[stage] = time.perf_counter() - began
        return made

    gate = timed("retrieve", lambda: gated(questions, retrieved, qid, least, counts))
    drafts = timed("generate", lambda: drafted(questions, gate, retrieved, qid, generate, counts))
    found = timed("verify", lambda: judged(questions, gate, drafts, retrieved, qid, verify, counts))
    if timings is not None:
        timings |= took if verify else {k: took[k] for k in ("retrieve", "generate")}
    return found


def answered(
    pages: DataFrame, questions: DataFrame, qid: str, generate: Generate, verify: Verify | None = None, k: int = DEFAULTS.top_k, least: float = DEFAULTS.min_similarity,
    timings: dict[str, float] | None = None, counts: dict[str, int] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages (source, page, text) and questions (qid, question) in; (answers, verdicts, sources with their quotes) out.

    Chunks and what is retrieved are written; `ingest` and `retrieve` in the map hold the seconds of chunking, and of the search with
    the gate; the map of counts also takes the rows retrieved.
    """
    took: dict[str, float] = {}
    began = time.perf_counter()
    chunks = chunking.chunk_pages(pages)
    took["ingest"] = time.perf_counter() - began
    began = time.perf_counter()
    found = retrieval.top_k_hashed(chunks, "id", questions.withColumnRenamed("question", "text"), qid, k)
    found = kept(found.join(chunks, "id").select(qid, "rank", "id", "score", "page", "source", "text"), work_dir(pages.sparkSession, "answered"), "retrieved", counts)
    searched = time.perf_counter() - began
    rest: dict[str, float] = {}
    answers, verdicts = ask(questions, found, qid, generate, verify, least, rest, counts)
    if timings is not None:
        timings |= took | rest | {"retrieve": searched + rest["retrieve"]}
    return answers, verdicts, sources_with_quotes(found, verdicts, qid)


def gated(questions: DataFrame, retrieved: DataFrame, qid: str, least: float, counts: dict[str, int] | None = None) -> DataFrame:
    return kept(retrieval.similarity_gate(questions, retrieved, qid, least), work_dir(questions.sparkSession, "ask"), "gate", counts)


def sources_with_quotes(retrieved: DataFrame, verdicts: DataFrame, qid: str) -> DataFrame:
    """Every retrieved source with the quotes of the claims that cite it, none where no claim does."""
    quotes = render.quotes_by_rank(verdicts, qid).withColumnRenamed("source_rank", "rank").withColumn("rank", F.col("rank").cast("int"))
    rows = retrieved.withColumn("rank", F.col("rank").cast("int")).join(quotes, [qid, "rank"], "left")
    return rows.withColumn("quotes", F.coalesce("quotes", F.array().cast("array<string>")))


def run_configurations(
    questions: DataFrame, retrieved: DataFrame, qid: str, generate: Callable[[bool], Generate], verifiers: dict[str, Verify], least: float = DEFAULTS.min_similarity,
    seconds: dict[str, float] | None = None,
) -> DataFrame:
    """The answers of every question under each of the five configurations, with the column config first. Gate and drafts
    are made once for all configurations that share them.

    generate: whether the prompt is the naive one -> a generator; verifiers: by the names that CONFIGS uses. Where a map is given, it
    takes the seconds of each configuration, with the gate and the drafts that it needs; answers are written then.
    """
    clock = time.perf_counter
    began = clock()
    gate = gated(questions, retrieved, qid, least)
    shared, drafts = clock() - began, {}
    took: dict[bool, float] = {}
    for naive in {n for *_, n in evaluation.CONFIGS}:
        began = clock()
        drafts[naive] = drafted(questions, gate, retrieved, qid, generate(naive))
        took[naive] = shared + clock() - began
    folder = work_dir(questions.sparkSession, "configurations")
    runs: list[DataFrame] = []
    for config, verifier, naive in evaluation.CONFIGS:
        began = clock()
        found, _ = judged(questions, gate, drafts[naive], retrieved, qid, verifiers[verifier] if verifier else None)
        name: Column = F.lit(config).alias("config")
        found = found.select(name, *found.columns)
        if seconds is not None:
            found = stored(found, folder, config)
            seconds[config] = took[naive] + clock() - began
        runs.append(found)
    return reduce(DataFrame.union, runs)
