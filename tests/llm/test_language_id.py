import random
import zlib

import pytest

from tessera.llm import language_id


def test_held_out_accuracy_and_odd_texts(docs, rows):
    found = language_id.language_id(docs).collect()
    assert len(found) == len(rows)
    truth = {r[0]: r for r in rows if r[0] is not None}
    judged = [r for r in found if r.doc_id is not None and r.doc_id < 1000]
    right = [r.lang_pred == truth[r.doc_id][2] for r in judged if r.doc_id >= 40 and r.held_out]
    assert len(right) > 10 and sum(right) / len(right) > 0.95
    for r in found:
        assert 0 <= r.score <= 1
        text = truth[r.doc_id][1] if r.doc_id is not None else "?"
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))


def test_labels_of_the_held_out_fold_are_not_read(spark, docs):
    from pyspark.sql import functions as F

    from tessera.llm.common import held_out

    held = held_out(F.col("doc_id"), 4, 2)
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    pick = lambda df: sorted(((r.doc_id, r.lang_pred, r.score) for r in language_id.language_id(df).collect()), key=repr)
    assert pick(docs) == pick(other)


def test_phrases_are_longest_matches():
    """The vectorised parse against a plain one."""
    samples = [("a", "banana bandana"), ("b", "cabbage patch")]
    parser = language_id.CrossParser(samples)

    def plain(text, sample):
        n = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in sample:
                size += 1
            at += size
            n += 1
        return n

    for text in ("banana", "cab ban", "xyz", "nanaban", "bandanabanana patch"):
        points, starts = language_id.points_of([text])
        codes, starts = parser.letters.codes(points, starts)
        assert parser.phrases(codes, starts)[0].tolist() == [plain(text, s) for _, s in samples], text


def test_no_labels_and_empty_table(spark, no_docs):
    assert language_id.language_id(no_docs).collect() == []
    rows = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.language_id(rows).collect()} == {"und"}


def plain_phrases(text, sample):
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += size
        n += 1
    return n


def scripts():
    """Two languages of the same many letters, in another order, after a Latin and a Cyrillic one."""
    rng = random.Random(3)
    han, hangul = [chr(c) for c in range(0x4E00, 0x4E00 + 600)], [chr(c) for c in range(0xAC00, 0xAC00 + 600)]
    words = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(300))
    return [("en", words("abcdefghij")), ("ko", words(hangul)), ("ru", words("абвгдежзик")), ("zh", words(han))]


@pytest.mark.parametrize("table_bytes", [0, 1 << 19, 1 << 28])
def test_letters_of_many_scripts_have_codes_of_their_own(monkeypatch, table_bytes):
    monkeypatch.setattr(language_id, "TABLE_BYTES", table_bytes, raising=False)
    samples = scripts()
    parser = language_id.CrossParser(samples)
    texts = [*(t[10 + i : 200 + i] for i, (_, t) in enumerate(samples)), "abc 一丁 가각 где αβγ"]
    points, starts = language_id.points_of(texts)
    codes, starts = parser.letters.codes(points, starts)
    assert parser.phrases(codes, starts).tolist() == [[plain_phrases(t.lstrip(), s) for _, s in samples] for t in texts]
    shuffled = [" ".join(random.Random(4).sample(t.split(), 40)) for _, t in samples]
    assert parser.predict(shuffled)[0] == [lang for lang, _ in samples]


def test_every_language_is_learned(spark, docs, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30)]
        rows += [(2 * i, " ".join(words), f"l{i:03}"), (2 * i + 1, " ".join(rng.sample(words, 20)), f"l{i:03}")]
    rows += [(1000, "..", "l000"), (1001, None, "l000")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "LITERALS", 100, raising=False)
    monkeypatch.setattr(language_id, "PASS_LANGUAGES", 150, raising=False)
    samples = language_id.training_sample(df.where("doc_id % 2 = 0"))
    assert len(samples) == 300
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_language(df, samples, ("doc_id",)).collect()}
    whole = language_id.CrossParser(samples).predict([t or "" for _, t, _ in rows])
    assert found == {r[0]: x for r, x in zip(rows, zip(*whole, strict=True), strict=True)}
    assert all(found[i][0] == lang for i, _, lang in rows[:600]) and found[1000] == found[1001] == ("und", 0.0)


def test_repeated_ids_and_very_long_texts_stay_within_the_training_bound(spark):
    rng = random.Random(12)
    words = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(1, words("abcdef", 40), "aa")] * 3000 + [(1, words("abcdef", 40), "aa"), (2, words("uvwxyz", 60_000), "zz"), (4, words("uvwxyz", 50), "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    samples = dict(language_id.training_sample(df))
    assert samples["aa"] == min(rows[0][1], rows[3000][1]) and 200 < len(samples["zz"]) <= language_id.TRAIN_LETTERS
    assert language_id.CrossParser(sorted(samples.items())).predict([words("abcdef", 9), words("uvwxyz", 9)])[0] == ["aa", "zz"]


def test_texts_beyond_one_block_and_ties():
    """A phrase ends at a block's end; languages with equal rates go by name."""
    rng = random.Random(6)
    samples = [("b", "abcdefgh" * 40), ("a", "abcdefgh" * 40), ("c", "hgfedcba" * 40)]
    parser = language_id.CrossParser(sorted(samples))
    text = "".join(rng.choice("abcdefgh") for _ in range(1000)) + "abcdefgh" * 50
    points, starts = language_id.points_of([text])
    codes, starts = parser.letters.codes(points, starts)
    blocks = [text[i : i + language_id.BLOCK] for i in range(0, len(text), language_id.BLOCK)]
    assert parser.phrases(codes, starts)[0].tolist() == [sum(plain_phrases(b, s) for b in blocks) for _, s in sorted(samples)]
    assert parser.predict([text])[0] == ["a"]
