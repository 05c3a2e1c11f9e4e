import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from tessera.llm import token_counts  # noqa: E402
from tessera.llm.queries import tokenizer_path  # noqa: E402

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return lambda text: len(model.encode(text))


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(MODEL)


def slow(counter, text):
    """Merges by looking at all pairs each time."""
    symbols = list(counter.normalise(text)) if text else []
    while pairs := [(counter.ranks[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in counter.ranks]:
        i = min(pairs)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return sum(1 if s in counter.ranks else len(s.encode()) for s in symbols)


def test_counts_are_the_librarys(spark, docs, rows, library):
    got = token_counts.token_counts(docs, MODEL, 30).collect()
    want = [(r[0], len((r[1] or "").encode()), library(r[1] or ""), library(r[1] or "") > 30) for r in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_odd_texts(counter, library):
    rng = random.Random(1)
    signs = "  ▁abetTheing\n\t\ré́日語😀<s></s>_-0123\x00\xa0ﬁ²..,|&"
    for alphabet in (signs, "aeinrst ", "".join(rng.sample(sorted(counter.ranks), 2000))):
        for _ in range(400):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert counter(text) == library(text) == slow(counter, text)
    for text in ("<s>", "<unk></s>", "<0x0A>", "\n", "▁▁ ▁", "﻿a", "a" * 5000, " " * 3000, "ab" * 4000):
        assert counter(text) == library(text)


def test_a_long_text_without_a_space(counter, library):
    rng = random.Random(2)
    text = "".join(rng.choice("etaoin") for _ in range(200_000))
    assert counter(text) == library(text)


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(token_counts, "KNOWN", 8)
    small = token_counts.Counter(MODEL)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(3)) for _ in range(30)) for _ in range(40)]
    assert [small(t) for t in texts] == [library(t) for t in texts]
    assert len(small.known) <= 4 and len(small.older) <= 4


@pytest.mark.parametrize("pieces", [["ab", "▁a", "bc"], ["a.b", "▁a", "▁▁"], ["a", "b"], [], ["a▁b", "▁c"]])
def test_no_piece_spans_two_parts(pieces):
    found = token_counts.parts(pieces)
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("abc.▁\n1") for _ in range(rng.randint(0, 12)))
        cut = found.findall(text)
        assert "".join(cut) == text
        borders = {sum(map(len, cut[:k])) for k in range(1, len(cut))}
        for piece in pieces:
            for i in range(len(text)):
                if text.startswith(piece, i):
                    assert not borders & set(range(i + 1, i + len(piece)))


def test_other_models_are_an_error(tmp_path):
    data = open(MODEL, "rb").read()
    path = tmp_path / "other.model"
    path.write_bytes(data.replace(b"\x18\x02 \x80\xfa\x01", b"\x18\x01 \x80\xfa\x01"))  # model_type 1
    assert path.read_bytes() != data
    with pytest.raises(ValueError, match="byte-pair"):
        token_counts.Counter(str(path))


def test_empty_table(spark, no_docs):
    got = token_counts.token_counts(no_docs, MODEL)
    assert got.collect() == [] and got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
