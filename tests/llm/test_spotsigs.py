import hashlib
import itertools
import random
import zlib

import pytest
from odd_rows import NASTY
from pyspark.sql import functions as F

from isobar.llm.spotsigs import ANCHORS, fingerprints, likeness, near_classes, signatures


def chains(text):
    """The chains of a text by another way: a walk over its words."""
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    stretches, own = [], []
    for word in [*words, None]:
        common = word is None or word in ANCHORS
        if common or zlib.crc32(word.encode()) % 8 == 0:
            stretches.append(own)
            own = []
        if not common:
            own.append(word)
    stretches.append(own)
    stretches = [s for s in stretches if s] or [[w] for w in words]
    return {tuple((a + (b or []))[:2]) for a, b in itertools.zip_longest(stretches, stretches[1:])}


def test_likeness_is_that_of_the_chains(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    result = {r.doc_id: r for r in fingerprints(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    for k, (doc_id, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        r = result[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((r.near_edited, edited), (r.near_next, following)):
            a, b = chains(text), chains(other)
            assert value == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=1e-3)


def test_edits_stay_near_and_others_do_not(spark):
    rows = [r for r in fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.n_chars > 1000]
    near, far = sorted(r.near_edited for r in rows), sorted(r.near_next for r in rows)
    assert near[len(near) // 20] > far[-len(far) // 20] and near[len(near) // 2] > 0.5


def test_no_text_falls_out_of_the_rules(spark):
    """Likeness to the edited text depends on no number of spots: hardly any longer text is far from its own."""
    rows = [r for r in fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect() if r.n_chars > 100]
    assert len(rows) > 9000
    # What is left are texts of a few repeated lines, whose small sets meet many new spots.
    assert sum(r.near_edited < 0.1 for r in rows) < 0.015 * len(rows)
    assert sum(r.near_edited for r in rows) > 0.57 * len(rows)


def test_odd_rows(docs):
    result = fingerprints(docs(NASTY)).collect()
    assert len(result) == len(NASTY)
    by_id = {r.doc_id: r for r in result}
    assert by_id[2].n_chars == 0 and by_id[2].fingerprint == "" and by_id[2].near_edited == 1.0
    assert by_id[1].fingerprint == by_id[5].fingerprint
    assert by_id[8].n_chars == len(dict(NASTY)[8])
    assert fingerprints(docs([])).collect() == []
    assert [r.near_next for r in fingerprints(docs([(1, "the only one")])).collect()] == [1.0]


def test_near_classes_by_brute_force(docs):
    chance = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    rows = []
    for g in range(30):
        base = chance.choices(words, k=chance.choice([12, 80, 200]))
        for _ in range(4):
            text = list(base)
            for _ in range(chance.choice([0, 1, 3])):
                text[chance.randrange(len(text))] = chance.choice(words)
            rows.append((len(rows), " ".join(text)))
    members, pairs = near_classes(docs(rows), 0.75)
    own = {r.doc_id: frozenset(r.s) for r in docs(rows).select("doc_id", signatures(F.col("text")).alias("s")).collect()}
    names = {}
    for i in sorted(own):
        names.setdefault(own[i], i)
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: names[s] for i, s in own.items()}
    expected = {
        (a, b) for (x, a), (y, b) in itertools.combinations(sorted(names.items(), key=lambda e: e[1]), 2)
        if len(x & y) >= 0.75 * len(x | y)
    }
    assert {(r.a, r.b) for r in pairs.collect()} == expected and expected
    members, pairs = near_classes(docs(NASTY))
    assert (5, 1) in {(r.doc_id, r.class_id) for r in members.collect()} and pairs.collect() == []


def test_pruned_likeness(spark):
    table = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([], [1]), ([1], [1, 2, 3, 4])], "a array<int>, b array<int>")
    assert [r[0] for r in table.select(likeness(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0, 0.25]
    assert [r[0] for r in table.select(likeness(F.col("a"), F.col("b"), 0.5)).collect()] == [0.5, 1.0, 0.0, 0.0]
