import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_files
from tessera.llm.common import work_dir

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_round_trip(docs, rows, path):
    tokenizer = Tokenizer.from_file(path)
    found = token_files.token_files(docs, path).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for doc, text, *_ in order:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found), key=lambda x: x[1]) == want


@pytest.mark.parametrize("text", ["It's DON'T l'été", "x<|endoftext|>y", "a\x1cb \x01 c\x85d", "Σίσυφος İstanbul ﬁ Å é", "１２ ½ ² 中文 字", "a b　c", "😀!?...", "don't'll"])
def test_pieces_are_encoded_like_whole_texts(text):
    coder = token_files.WordEncoder(WORDS)
    assert coder.by_piece
    got = np.frombuffer(next(coder.encode([text.encode()])), coder.dtype).tolist()
    assert got == coder.ids(text)


def test_a_full_cache_is_dropped(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 3)
    coder = token_files.WordEncoder(WORDS)
    texts = [f"word{i} and more {i}" for i in range(20)]
    got = [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode([t.encode() for t in texts])]
    assert got == [coder.ids(t) for t in texts]


def test_a_word_is_merged_once_whatever_stands_around_it(monkeypatch):
    coder = token_files.WordEncoder(WORDS)
    merged, word = [], coder.word
    monkeypatch.setattr(coder, "word", lambda w: merged.append(w) or word(w))
    monkeypatch.setattr(token_files, "RUN_BYTES", 50)
    texts = [f"Common, common. (COMMON) common! new{i:c}" for i in range(ord("a"), ord("z"))]
    got = [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode([t.encode() for t in texts])]
    assert got == [coder.ids(t) for t in texts]
    assert len(merged) == len(set(merged)) and "common" in merged


def test_long_pieces_are_not_kept():
    coder = token_files.WordEncoder(WORDS)
    texts = [f"{'long' * 1000}{i} {'字' * 1000}{i} short" for i in range(5)]
    got = [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode([t.encode() for t in texts])]
    assert got == [coder.ids(t) for t in texts]
    assert max(map(len, coder.known)) <= 32 and "short" in coder.known


def test_every_character_up_to_greek_is_encoded_like_in_whole_texts():
    coder = token_files.WordEncoder(WORDS)
    texts = ["", " ", " a  b ", *(f"{chr(c)} ab{chr(c)}C1'{chr(c)}S {chr(c)}\u030c" for c in range(0x400))]
    got = [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode([t.encode() for t in texts])]
    assert got == [coder.ids(t) for t in texts]


def test_files_hold_flat_ids_and_offsets(spark, docs):
    folder = work_dir(spark, "test-tokens")
    manifest = token_files.write_parts(docs, folder, WORDS, 2, parts=3).collect()
    for r in manifest:
        ids, offsets = np.fromfile(f"{r.path}.ids", "<u2"), np.fromfile(f"{r.path}.off", "<u8")
        assert len(ids) == r.n_ids == offsets[-1] and len(offsets) == r.n_docs + 1
        assert (ids[offsets[1:] - 1] == 2).all()


def test_empty_table(no_docs):
    assert token_files.token_files(no_docs, WORDS).collect() == []


def test_a_shared_id_is_cut_into_parts_and_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PIECE_DOCS", 7)
    monkeypatch.setattr(token_files, "PART_BYTES", 1_000)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else 100 + i, "the same text" if i % 2 else f"text number {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = work_dir(spark, "test-tokens")
    manifest = token_files.write_parts(docs, folder, WORDS, 2).collect()
    assert len(manifest) > 4 and max(r.n_docs for r in manifest) < 300 and sum(r.n_docs for r in manifest) == 600
    found = sorted((tuple(r) for r in token_files.token_files(docs, WORDS).collect()), key=lambda r: r[1])
    tokenizer = Tokenizer.from_file(WORDS)
    start, want = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == want
