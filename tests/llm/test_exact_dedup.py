import hashlib
import re
from collections import Counter, defaultdict

from tessera.llm import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(doc, keep, len(members), sha) for doc, _ in members]
    return Counter(out)


def test_groups_and_keepers(docs, rows):
    found = exact_dedup.exact_duplicates(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected(rows)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_collisions_are_told_apart_by_bytes(docs, rows):
    """A digest of 3 bits collides all the time; tiny memtables make many runs."""
    found = exact_dedup.exact_duplicates(docs, digest_bits=3, memtable_bytes=20_000).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected(rows)


def test_members_are_cut_into_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMBERS", 3)
    same = spark.createDataFrame([(i, "a b" if i % 2 else "ab ") for i in range(25)], "doc_id long, text string").repartition(3)
    found = exact_dedup.exact_duplicates(same).collect()
    assert {r.group_size for r in found} == {25} and {r.keep_id for r in found} == {0} and sum(r.kept for r in found) == 1
    assert sorted(r.doc_id for r in found) == list(range(25))


def test_segments_follow_the_rows(docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SEGMENT_ROWS", 10)
    found = exact_dedup.exact_duplicates(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected(rows)


def test_a_text_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMBERS", 10)
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one text' ELSE concat('text ', id) END AS text").repartition(8)
    found = exact_dedup.exact_duplicates(rows)
    assert found.where("group_size = 1000 AND keep_id = 0").count() == 1000 and found.where("kept").count() == 2001
    assert "split_by" in found._jdf.queryExecution().executedPlan().toString()


def test_more_digests_than_are_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    found = exact_dedup.exact_duplicates(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected(rows)


def test_empty_table(no_docs):
    assert exact_dedup.exact_duplicates(no_docs).collect() == []
