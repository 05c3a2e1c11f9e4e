import random
from collections import Counter, defaultdict

from tessera.llm import ngram_join
from tests.llm.conftest import frame, sentence


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def expected(rows):
    """(doc_id, set size, least id reachable) by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        ids = [x for x in groups[root(i)] if x is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect())


def test_components(docs, rows):
    assert found(docs) == expected(rows)


def near_copies(n=90, seed=3):
    """One text with a few words changed in each copy: many pairs link, many miss the threshold."""
    rng = random.Random(seed)
    base = sentence(rng, "en", 150).split()
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(1, 9)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(40)}"
        rows.append((i, " ".join(own), "en", "src0"))
    common = sentence(rng, "de", 60)
    rows += [(500 + i, sentence(rng, "de", 12) + " " + common + " " + sentence(rng, "de", rng.randint(2, 14)), "de", "src1") for i in range(60)]
    return rows


def test_a_group_of_near_copies(spark):
    rows = near_copies()
    assert found(frame(spark, rows).repartition(4)) == expected(rows)


def test_prefixes_alone_give_the_same(spark, monkeypatch):
    """Without star links every link must come through the adaptive prefixes."""
    rows = near_copies(60, 5)
    monkeypatch.setattr(ngram_join, "star_links", lambda classes: classes.sparkSession.createDataFrame([], "a long, b long"))
    assert found(frame(spark, rows).repartition(4)) == expected(rows)


def test_the_threshold_is_met_exactly(spark):
    """7 of 8 shingles on either side are 7 of 9: linked; 6 of 8 and 8 are 6 of 10: not."""
    a = [f"a{i}" for i in range(12)]
    rows = [(1, " ".join(a), "en", "s"), (2, " ".join([*a[:11], "x"]), "en", "s"), (3, " ".join([*a[:10], "y", "z"]), "en", "s")]
    assert found(frame(spark, rows)) == expected(rows)


def test_small_blocks_and_segments(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    monkeypatch.setattr(ngram_join, "SEGMENT_TOKENS", 500)
    assert found(docs) == expected(rows)


def test_long_posting_lists_are_cut_into_slices(spark, monkeypatch):
    """A passage in every document: its posting lists hold all of them, in slices of 4."""
    monkeypatch.setattr(ngram_join, "LIST", 4)
    monkeypatch.setattr(ngram_join, "star_links", lambda classes: classes.sparkSession.createDataFrame([], "a long, b long"))
    rows = near_copies(60, 8)
    assert found(frame(spark, rows).repartition(4)) == expected(rows)


def test_links_of_centres_spare_most_comparisons(spark, tmp_path):
    """A group of near copies is one component after the centres' links; those come from prefix posting lists."""
    rng = random.Random(2)
    base = sentence(rng, "en", 200).split()
    rows = []
    for i in range(120):
        own = list(base)
        own[rng.randrange(len(own))] = f"w{i % 11}"
        rows.append((i, " ".join(own), "en", "src0"))
    ngram_join.near_duplicates(frame(spark, rows), f"file://{tmp_path}").collect()
    assert spark.read.parquet(f"file://{tmp_path}/starred").select("label").distinct().count() == 1


def test_words_of_a_polynomials_zero_have_hashes_of_their_own(spark):
    """Two words whose polynomial hashes modulo 2 ** 64 agree for any base, as the parity of set bits picks their letters."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    assert len(set(ngram_join.word_hashes([a.encode(), b.encode()]).tolist())) == 2
    rows = [(i, f"{w} {tail}", "en", "s") for i, (w, tail) in enumerate([(a, "x"), (b, "x"), (a, "y z"), (b, "y z"), (a, "x")])]
    assert found(frame(spark, rows)) == expected(rows)


def test_texts_in_pieces(spark, monkeypatch, docs, rows):
    monkeypatch.setattr(ngram_join, "PIECE_BYTES", 300)
    monkeypatch.setattr(ngram_join, "KNOWN_WORDS", 50)
    texts = [(r[1] or "").encode() for r in rows]
    whole = [len(shingles(r[1])) for r in rows]
    assert [len(s) for s in ngram_join.shingle_sets(texts)] == whole


def test_prefix_lengths_choose_more_matches_for_frequent_hashes():
    import numpy as np

    rare = ngram_join.matches_of(40, np.array([2] * 40))
    frequent = ngram_join.matches_of(40, np.array([2] * 11 + [900] * 29))
    assert rare[0] >= 1 and frequent[0] >= 1 and rare[1] == 40 - 30 + rare[0] and frequent[1] == 10 + frequent[0]
    heavy = ngram_join.matches_of(40, np.array([500] * 40))
    assert heavy[0] > 1


def test_empty_table(no_docs):
    assert ngram_join.near_duplicates(no_docs).collect() == []
