import numpy as np
import pytest

from tessera.operators import generation, sql


def client():
    def call(model, system, user, json_mode, max_tokens):
        if user == "bad":
            raise OSError("down")
        if model == "a" and user == "limit":
            raise generation.RateLimited("today", daily=True)
        return f"{system}/{user}/{json_mode}/{max_tokens}"

    return call


@pytest.fixture(scope="module")
def functions(spark):
    encoder = lambda: lambda texts: np.array([[float(len(t)), 1.0] for t in texts])
    predictor = lambda: lambda pairs: [float(c in p) for p, c in pairs]
    sql.register(spark, client, encoder, predictor, ("a", "b"), lambda _: None)
    rows = [(1, "one", "x"), (2, "bad", "y"), (3, "limit", None), (4, None, "z")]
    spark.createDataFrame(rows, "id long, prompt string, text string").repartition(3).createOrReplaceTempView("asked")


def test_replies_with_models_and_errors(spark, functions):
    got = {r.id: r for r in spark.sql("SELECT * FROM model_reply(TABLE(SELECT id, prompt FROM asked), system => 's', json_mode => true)").collect()}
    assert {k: (r.prompt, r.reply, r.model, r.error) for k, r in got.items()} == {
        1: ("one", "s/one/True/600", "a", None), 2: ("bad", None, None, "OSError: down"), 3: ("limit", "s/limit/True/600", "b", None), 4: (None, "s//True/600", "a", None)
    }
    plain = spark.sql("SELECT reply FROM model_reply(TABLE(asked) PARTITION BY id) WHERE id = 1").first()
    assert plain.reply == f"{generation.STRICT_SYSTEM}/one/False/600"


def test_embeddings_and_entailment(spark, functions):
    got = {r.id: r.embedding for r in spark.sql("SELECT id, embedding FROM text_embedding(TABLE(asked))").collect()}
    assert got[3] == [0.0, 1.0] and got[1] == pytest.approx([0.5**0.5, 0.5**0.5])
    pairs = "SELECT * FROM VALUES (1, 'a lamp is lit', 'lamp'), (2, 'a lamp', 'oar'), (3, NULL, '') AS t(k, premise, claim)"
    assert {r.k: r.p for r in spark.sql(f"SELECT k, p FROM entailment(TABLE({pairs}))").collect()} == {1: 1.0, 2: 0.0, 3: 1.0}


@pytest.mark.parametrize(("text", "message"), [("model_reply(TABLE(SELECT 1 AS id))", "no column prompt"), ("text_embedding(TABLE(SELECT '' AS text, 1 AS embedding))", "already")])
def test_tables_that_do_not_fit(spark, functions, text, message):
    with pytest.raises(Exception, match=message):
        spark.sql(f"SELECT * FROM {text}").collect()
