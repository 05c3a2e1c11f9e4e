"""Queries over the driver's tables: a source of `documents` is a file, `benchmark` texts are questions and quotes,
user turns are questions, assistant turns are drafts."""

from __future__ import annotations

import hashlib

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULTS
from tessera.functions import render
from tessera.functions import text as T
from tessera.functions.nfkc import with_nfkc
from tessera.operators import asking, chunking, decision, embedding, entailment, evaluation, generation, learned, reply_log, retrieval, sql, verification
from tessera.operators.graph_index import GraphIndex, recall
from tessera.sources import files, pdf
from tessera.sources.store import Store
from tessera.streaming import registry as stream_of
from tessera.tables import stored, work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _per_document(make):
    """A query with one computed column per document."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", *make(F.col("text")))

    return query


def cited(text):
    return F.concat(text, F.lit(" [1]. Also so [2, 3]."))


def odd_answer(text):
    return F.concat(F.lit("  【 "), F.col("doc_id").cast("string"), F.lit(" 】 \t"), text, F.lit(" [ 2, 3 ] "))


approx_tokens = _per_document(lambda t: [T.approx_tokens(t).alias("tokens")])
clean_block = _per_document(lambda t: [T.clean_block(t).alias("cleaned")])
join_blocks = _per_document(lambda t: [T.join_blocks(F.transform(F.split(t, "\n"), T.clean_block)).alias("joined")])
split_sentences = _per_document(lambda t: [F.posexplode(T.split_sentences(t)).alias("pos", "sentence")])
hard_split = _per_document(lambda t: [F.posexplode(T.hard_split(t, 100)).alias("pos", "piece")])
strip_citations = _per_document(lambda t: [T.strip_citations(cited(t)).alias("stripped")])
clean_answer = _per_document(lambda t: [T.clean_answer(odd_answer(t)).alias("answer")])
normalise_text = _per_document(lambda t: [T.normalise(t).alias("normalised")])
scorer_normalise = _per_document(lambda t: [T.scorer_normalise(F.concat(t, F.lit(" two  Three twenty-five thirty"))).alias("normalised")])
escape_dollars = _per_document(lambda t: [T.escape_dollars(F.concat(F.lit("$60 or $70 "), t)).alias("escaped")])


def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


def is_not_found(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.lit(" not_found. ")).otherwise(F.col("text")).alias("t"))
    return turns.select("conv_id", "turn", T.is_not_found(F.col("t")).alias("not_found"))


def pdf_round_trip(spark, sf_dir):
    """All documents written as PDF files, a page each, and read back from ranges of pages."""
    path = f"{work_dir(spark, 'pdf')}/files"
    pdf.write_pdf(files.pages_of_documents(table(spark, sf_dir, "documents")), path)
    found = pdf.read_pdf(spark, path, rangeBytes=1 << 20).withColumn("page", F.col("label").cast("long"))
    return files.pages_of_blocks(found).select(F.col("page").alias("doc_id"), "text")


def split_claims(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select("conv_id", "turn", F.posexplode(T.split_claims(F.concat("text", F.lit(" So it is said [4].")))).alias("pos", "claim"))


def nfkc_text(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return with_nfkc(turns, folded=F.col("text")).select("conv_id", "turn", "folded")


def chunks_of(spark, sf_dir) -> DataFrame:
    return chunking.chunk_pages(files.pages_of_documents(table(spark, sf_dir, "documents")))


def chunk_pages(spark, sf_dir):
    return chunks_of(spark, sf_dir)


def chunk_stats(spark, sf_dir):
    tokens = T.approx_tokens(F.col("text"))
    return chunks_of(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("n_chunks"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("longest"), F.countDistinct("page").alias("pages")
    )


def document_registry(spark, sf_dir):
    return chunking.document_registry(chunks_of(spark, sf_dir))


def stream_registry(spark, sf_dir):
    """The registry of documents that were streamed in two pieces, with a restart between them."""
    path = work_dir(spark, "stream")
    pages = files.pages_of_documents(table(spark, sf_dir, "documents"))
    sizes = pages.groupBy("source").agg(F.count("*").alias("expected")).withColumnRenamed("source", "named")
    pages = pages.join(sizes, F.col("source").eqNullSafe(F.col("named"))).select("source", "page", "text", "expected")
    for piece in range(2):
        pages.where(F.pmod(F.xxhash64("page"), F.lit(2)) == piece).write.parquet(f"{path}/in/{piece}")
        stream_of.start(spark.readStream.schema(pages.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in"), f"{path}/out")
    return stream_of.registered(spark, f"{path}/out").where("n_chunks > 0").select("source", "n_chunks")


def store_batches(spark, sf_dir):
    """Two overlapping batches in a store, with a write between them that fails; read after reopening."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    path = f"{work_dir(spark, 'store')}/docs"
    store = Store.create(spark, path, "id string, text string, lang string")
    store.add(docs.where("lang = 'en'"))
    failing = docs.withColumn("text", F.when(F.col("lang") == "de", F.raise_error(F.lit("this write fails"))).otherwise(F.col("text")))
    try:
        failing.write.format("tessera_store").mode("append").save(path)
    except PySparkException as e:
        if "this write fails" not in str(e):
            raise
    store.add(docs.withColumn("text", F.lower("text")))
    return Store.open(spark, path).read().select(F.col("id").cast("long").alias("doc_id"), "text", "lang")


def hash_embed(spark, sf_dir):
    return embedding.hash_embed(table(spark, sf_dir, "documents"), "doc_id")


def learned_vectors(spark, sf_dir):
    """Vectors of all documents, learned from them."""
    return learned.learned_vectors(table(spark, sf_dir, "documents"))


def embed_norms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    norms = embedding.hash_embed(docs, "doc_id").groupBy("doc_id").agg(F.max("norm2").alias("norm2"))
    return docs.select("doc_id").join(norms, "doc_id", "left").select("doc_id", F.sqrt(F.coalesce("norm2", F.lit(0)).cast("double")).alias("norm"))


def questions_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


def retrieved_of(spark, sf_dir) -> DataFrame:
    chunks = chunks_of(spark, sf_dir)
    found = retrieval.top_k_hashed(chunks, "id", questions_of(spark, sf_dir), "item_id")
    return found.join(chunks, "id").select("item_id", "rank", "id", "score", "page", "source", "text")


def topk_sparse(spark, sf_dir):
    return retrieved_of(spark, sf_dir).select("item_id", "rank", "id", "page", "source", F.round("score", 6).alias("score"))


def similarity_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("qid"), "text")
    found = retrieval.top_k_hashed(docs, "doc_id", turns, "qid", 1)
    return retrieval.similarity_gate(turns, found, "qid").select("qid", F.round("best", 6).alias("best"), "passed")


def topk_dense(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = retrieval.top_k_dense(rows, "vec_id", rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), "qid")
    return found.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


def indexed_of(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Embeddings, every hundredth of them as questions, and what a written index, reopened, finds for these."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid")
    path = f"{work_dir(spark, 'graph-index')}/index"
    GraphIndex.build(rows, "vec_id", path)
    return rows, asked, GraphIndex.open(spark, path).search(asked, "qid")


def topk_graph(spark, sf_dir):
    found = indexed_of(spark, sf_dir)[2]
    return found.select("qid", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def graph_recall(spark, sf_dir):
    rows, asked, found = indexed_of(spark, sf_dir)
    return recall(found, retrieval.top_k_dense(rows, "vec_id", asked, "qid"), "qid", "vec_id")


def build_context(spark, sf_dir):
    return retrieval.context(retrieved_of(spark, sf_dir), "item_id")


def generator_prompts(spark, sf_dir):
    asked = questions_of(spark, sf_dir).withColumnRenamed("text", "question")
    return generation.prompts(asked, retrieval.context(retrieved_of(spark, sf_dir), "item_id"), "item_id")


def verifier_prompts(spark, sf_dir):
    answers = questions_of(spark, sf_dir).withColumnRenamed("text", "draft")
    return verification.verifier_prompts(answers, retrieval.context(retrieved_of(spark, sf_dir), "item_id", headed=False), "item_id")


def quote_in_text(spark, sf_dir):
    asked = questions_of(spark, sf_dir).withColumnRenamed("text", "quote")
    rows = retrieved_of(spark, sf_dir).join(asked, "item_id")
    return rows.select("item_id", "rank", T.quote_in_text(F.col("quote"), F.col("text")).alias("found"), T.quote_in_text(F.col("quote"), F.col("text"), True).alias("found_strict"))


def premises_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.lit(1).alias("rank"), "text")


def nli_windows(spark, sf_dir):
    return verification.premise_windows(premises_of(spark, sf_dir), "item_id")


def nli_verdicts(spark, sf_dir):
    answers = questions_of(spark, sf_dir).withColumnRenamed("text", "draft")
    return verification.nli_verdicts(answers, retrieved_of(spark, sf_dir), "item_id").drop("reason")


def entailment_fit(spark, sf_dir):
    """(weights, the texts that they were not fitted on): a fifth of the documents by their id's crc32 is held out."""
    docs = table(spark, sf_dir, "documents").withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5)
    return entailment.fitted(docs.where("fold <> 0")), docs.where("fold = 0")


def entailment_held_out(spark, sf_dir):
    """What the fitted score says of pairs made of held-out documents: pairs by class and by what was found."""
    weights, held = entailment_fit(spark, sf_dir)
    found = entailment.judged(entailment.pairs_of(held), weights).groupBy("label", "found").agg(F.count("*").alias("pairs"))
    name = lambda c: F.element_at(F.array(*map(F.lit, entailment.CLASSES)), F.col(c) + 1)
    return found.select(name("label").alias("class"), name("found").alias("found"), "pairs")


def aligned_verdicts(spark, sf_dir):
    """Claims of the benchmark's texts against what was retrieved for them, by the fitted score of entailment."""
    answers = questions_of(spark, sf_dir).withColumnRenamed("text", "draft")
    weights, _ = entailment_fit(spark, sf_dir)
    return verification.nli_verdicts(answers, retrieved_of(spark, sf_dir), "item_id", entailment.load_predictor(weights)).drop("reason")


#: Stand-ins for models: replies of every form, made from the prompts alone, so that SQL can make the same.
START = len("SOURCES:\n[1]\n") + 1


def scripted_drafts(naive: bool = False):
    """A generator that quotes the first source; the strict one also says that it found nothing."""

    def generate(prompts: DataFrame) -> DataFrame:
        prompt = F.col("prompt")
        quote = F.substring(prompt, F.instr(prompt, ")\n") + 2, F.lit(120))
        reply = F.concat(quote, F.lit(" and so on [1]." if naive else " [1]."))
        reply = reply if naive else F.when(F.length(prompt) % 6 == 0, "NOT_FOUND").otherwise(reply)
        return prompts.select("item_id", reply.alias("reply"))

    return generate


def scripted_verdicts(prompts: DataFrame) -> DataFrame:
    """A verifier's replies: no JSON, broken JSON, fences and words around it, and claims with wrong types and sources."""
    quote = F.substring("prompt", START, 60)

    def claim(text, supported, source, own_quote, reason):
        named = {"claim": text, "supported": supported, "source": source, "quote": own_quote, "reason": reason}
        return F.to_json(F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(k) for k, x in named.items()]))

    good = claim(F.concat(F.lit("It says "), F.substring("prompt", START, 30)), True, 1, quote, "stated")
    bad = claim("It is otherwise", False, None, "", "absent")
    far = claim("Far off", True, 99, quote, "")
    half = claim("Half a source", True, 1.5, quote, "seen")
    told = claim("Told as text", "true", 1, quote, "")
    body = lambda *items: F.concat(F.lit('{"claims":['), F.concat_ws(",", *items), F.lit("]}"))
    forms = [
        F.lit("not json"), F.lit("{broken"), F.lit('{"claims":[]}'), F.lit('{"claims":["only words"]}'), F.concat(F.lit("```json\n"), body(good), F.lit("\n```")),
        F.concat(F.lit("Sure: "), body(good, bad, F.lit('"words"')), F.lit(" Done.")), body(far, half), body(good, far), body(told),
    ]
    reply = F.element_at(F.array(*forms), (F.length("prompt") % len(forms) + 1).cast("int"))
    return prompts.select("item_id", reply.alias("reply"))


def asked_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The questions and what was retrieved for them, written once."""
    folder = work_dir(spark, "asked")
    return questions_of(spark, sf_dir).withColumnRenamed("text", "question"), stored(retrieved_of(spark, sf_dir), folder, "retrieved")


def answers_of(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers, verdicts and retrieved chunks with the strict generator and the verifier by replies."""
    questions, found = asked_of(spark, sf_dir)
    answers, verdicts = asking.ask(questions, found, "item_id", scripted_drafts(), asking.verify_by_replies(scripted_verdicts, "item_id"))
    return answers, verdicts, found


def replies_of(spark, sf_dir) -> DataFrame:
    """item_id, raw: the verifier's replies to the drafts."""
    kept = []

    def replying(prompts: DataFrame) -> DataFrame:
        kept.append(scripted_verdicts(prompts))
        return kept[0]

    questions, found = asked_of(spark, sf_dir)
    asking.ask(questions, found, "item_id", scripted_drafts(), asking.verify_by_replies(replying, "item_id"))
    return kept[0].withColumnRenamed("reply", "raw")


def parse_json_object(spark, sf_dir):
    return replies_of(spark, sf_dir).select("item_id", T.parse_json_object(F.col("raw")).isNotNull().alias("parsed"))


def reply_errors(spark, sf_dir):
    return verification.claims_of_replies(replies_of(spark, sf_dir), "item_id")[1]


def llm_verdicts(spark, sf_dir):
    return answers_of(spark, sf_dir)[1].drop("score")


def ask(spark, sf_dir):
    answers = answers_of(spark, sf_dir)[0]
    return answers.select("item_id", F.round("best", 6).alias("best"), "status", "answer", "draft", "abstained", "k", "n", "verify_error")


def failing_client():
    """A scripted client: by the prompt's length the first model is at a limit, no model can be reached, or a request is bad."""

    def client(model: str, system: str, user: str, json_mode: bool, max_tokens: int) -> str:
        case = len(user) % 7
        if case in (0, 2) and model == "first":
            raise generation.RateLimited("slow down", daily=case == 0)
        if case == 1:
            raise generation.Unreachable("no route")
        if case == 3:
            raise ValueError("bad request")
        return f"{model}: {hashlib.md5(user.encode()).hexdigest()}"

    return client


#: Calls of the scripted client: two models, no waiting.
SCRIPTED = {"models": ("first", "second"), "wait": lambda _: None}


def logged_replies(spark, sf_dir):
    """Replies to all prompts by the scripted client; the second run finds them in the log and asks again what failed."""
    prompts = generator_prompts(spark, sf_dir)
    log = f"{work_dir(spark, 'log')}/replies"
    for _ in range(2):
        found = reply_log.logged(prompts, "item_id", failing_client, generation.STRICT_SYSTEM, log, **SCRIPTED)
    return found


def failed_calls(spark, sf_dir):
    """Every question with the scripted client as generator: what fails is a status of its own, with its error."""
    questions, found = asked_of(spark, sf_dir)
    generate = asking.hosted_generate("item_id", failing_client, log=f"{work_dir(spark, 'log')}/replies", **SCRIPTED)
    answers, _ = asking.ask(questions, found, "item_id", generate)
    return answers.select("item_id", "status", "answer", "abstained", "model", "error")


def stage_rows(spark, sf_dir):
    """Documents and questions to answers in one call: the rows of each stage, as they were counted while it ran."""
    counts: dict[str, int] = {}
    questions = questions_of(spark, sf_dir).withColumnRenamed("text", "question")
    pages = files.pages_of_documents(table(spark, sf_dir, "documents"))
    asking.answered(pages, questions, "item_id", scripted_drafts(), asking.verify_by_replies(scripted_verdicts, "item_id"), counts=counts)
    return spark.createDataFrame(list(counts.items()), "stage string, rows long")


#: From questions and what was retrieved to answers in SQL text, with a model as a table function.
ASK_SQL = """
WITH gate AS (SELECT item_id, max(score) AS best FROM asked_retrieved WHERE rank = 1 GROUP BY item_id),
parts AS (SELECT item_id, array_sort(collect_list(struct(rank, concat('[', rank, '] (page ', page, ', ', source, ')\n', text) AS part))) AS xs FROM asked_retrieved GROUP BY item_id),
prompts AS (
  SELECT item_id, concat('SOURCES:\n', array_join(transform(xs, x -> x.part), '\n\n'), '\n\nQUESTION: ', question, '\n\nANSWER:') AS prompt
  FROM parts JOIN asked_questions USING (item_id) JOIN gate USING (item_id) WHERE best >= {least}
),
said AS (SELECT item_id, reply, model, error FROM model_reply(TABLE(prompts)))
SELECT item_id, CASE WHEN NOT coalesce(best >= {least}, false) THEN 'not_found' WHEN error IS NOT NULL THEN 'failed' ELSE 'unchecked' END AS status,
  CASE WHEN NOT coalesce(best >= {least}, false) THEN '{not_found}' WHEN error IS NOT NULL THEN '{failed}' ELSE reply END AS answer,
  NOT coalesce(best >= {least}, false) AS abstained, model, error
FROM asked_questions LEFT JOIN gate USING (item_id) LEFT JOIN said USING (item_id)
"""


def sql_ask(spark, sf_dir):
    """The same answers as `failed_calls`, asked from SQL text."""
    questions, found = asked_of(spark, sf_dir)
    questions.createOrReplaceTempView("asked_questions")
    found.createOrReplaceTempView("asked_retrieved")
    sql.register(spark, client=failing_client, **SCRIPTED)
    return spark.sql(ASK_SQL.format(least=DEFAULTS.min_similarity, not_found=decision.NOT_FOUND_MESSAGE, failed=decision.FAILED_MESSAGE))


def decide_status(spark, sf_dir):
    return config_answers(spark, sf_dir).select("config", "item_id", "status", "answer", "abstained")


def badge(spark, sf_dir):
    found = config_answers(spark, sf_dir).select("config", "item_id", render.badge(F.col("status"), F.col("k"), F.col("n")).alias("b"))
    return found.select("config", "item_id", "b.level", "b.label")


def claim_support(spark, sf_dir):
    return verification.support(answers_of(spark, sf_dir)[1], "item_id")


def verdict_lines(spark, sf_dir):
    _, verdicts, found = answers_of(spark, sf_dir)
    return render.verdict_line(verdicts, found, "item_id")


def quotes_by_rank(spark, sf_dir):
    found = render.quotes_by_rank(answers_of(spark, sf_dir)[1], "item_id")
    return found.select("item_id", "source_rank", F.array_join("quotes", " / ").alias("quotes"))


def sources_with_quotes(spark, sf_dir):
    _, verdicts, found = answers_of(spark, sf_dir)
    rows = asking.sources_with_quotes(found, verdicts, "item_id")
    return rows.select("item_id", "rank", "page", "source", F.size("quotes").alias("n_quotes"), F.array_join("quotes", " / ").alias("quotes"))


def config_answers(spark, sf_dir) -> DataFrame:
    questions, found = asked_of(spark, sf_dir)
    verifiers = {"llm": asking.verify_by_replies(scripted_verdicts, "item_id"), "nli": asking.verify_by_entailment("item_id")}
    return asking.run_configurations(questions, found, "item_id", scripted_drafts, verifiers)


def highlight(spark, sf_dir):
    own = T.split_sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", render.highlight_html(F.col("text"), F.slice(own, 2, 2)).alias("html"))


def specs_of(spark, sf_dir) -> DataFrame:
    """Question sets like those that are read from files: the benchmark's items in four documents, half of them answerable."""
    rows = questions_of(spark, sf_dir).withColumn("document", F.concat(F.lit("set-"), F.col("item_id") % 4, F.lit(".json")))
    even = F.col("item_id") % 8 < 4
    own = lambda keep, *fields: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("item_id", *fields)))), lambda x: x.dropFields("item_id"))
    expect, kind = F.array(F.substring("text", 1, 3), F.lit("two")).alias("expect"), F.when(F.col("item_id") % 3 == 0, "off-topic").otherwise("near-miss").alias("kind")
    q = F.col("text").alias("q")
    return rows.groupBy("document").agg(F.lit(None).cast("string").alias("note"), own(even, q, expect).alias("answerable"), own(~even, q, kind).alias("unanswerable"))


def question_rows(spark, sf_dir):
    rows = files.explode_questions(specs_of(spark, sf_dir))
    return rows.select("document", "type", "no", "q", F.array_join("expect", "|").alias("expect"), "kind")


def eval_results(spark, sf_dir) -> DataFrame:
    """All questions under the five configurations: every other one counts as answerable, by the beginning of its source."""
    results = config_answers(spark, sf_dir)
    odd = F.col("item_id") % 2 == 1
    expect = F.when(~odd, F.array(F.upper(F.substring("question", 1, 2)), F.lit("\uff41"))).alias("expect")  # a full-width a
    kind = F.when(odd, "off-topic").alias("kind")
    type_ = F.when(odd, "unanswerable").otherwise("answerable").alias("type")
    return evaluation.eval_rows(results.select("config", type_, F.col("question").alias("q"), expect, kind, "status", "answer"))


def eval_rows(spark, sf_dir):
    return eval_results(spark, sf_dir)


def eval_summary(spark, sf_dir):
    return evaluation.eval_summary(eval_results(spark, sf_dir))


def eval_markdown(spark, sf_dir):
    return files.markdown_lines(evaluation.eval_summary(eval_results(spark, sf_dir)))


def status_pivot(spark, sf_dir):
    return evaluation.status_pivot(eval_results(spark, sf_dir))


def config_ablation(spark, sf_dir):
    """What each configuration gave: a row for each configuration and status."""
    return config_answers(spark, sf_dir).groupBy("config", "status").agg(F.count("*").alias("questions"), F.sum("k").alias("supported"), F.sum("n").alias("claims"))
