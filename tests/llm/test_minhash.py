import random
import re
from collections import Counter, defaultdict

from odd_rows import NASTY

from compare import mismatch, views

from isobar.llm import queries, sql
from isobar.llm.components import components
from isobar.llm.minhash import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sets_of(rows):
    out = {}
    for doc_id, text in rows:
        words = WORD.findall(lower(text))
        out[doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def brute_force(rows):
    """doc_id → (shingles, component), with all pairs that share a shingle compared."""
    sets, inverted, shared = sets_of(rows), defaultdict(list), Counter()
    for doc_id, own in sets.items():
        for shingle in own:
            inverted[shingle].append(doc_id)
    for ids in inverted.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                shared[min(a, b), max(a, b)] += 1
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(own), root(i)) for i, own in sets.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_groups_of_copies_by_brute_force(docs):
    chance = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    rows, doc_id = [], 0
    for size in (1, 2, 3, 60, 400):
        base = chance.choices(words, k=120)
        for _ in range(size):
            text = list(base)
            for _ in range(chance.choice([0, 0, 1, 2, 4, 8])):
                text[chance.randrange(120)] = chance.choice(words)
            rows.append((doc_id, " ".join(text)))
            doc_id += 1
    # A passage that many documents share links none of them.
    passage = " ".join(chance.choices(words, k=60))
    rows += [(doc_id + i, passage + " " + " ".join(chance.choices(words, k=70))) for i in range(100)]
    chance.shuffle(rows)
    assert found(near_duplicates(docs(rows))) == brute_force(rows)


def test_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert mismatch(queries.op8_minhash(spark, sf_dir), sql.NEAR_DUPLICATES, views(sf_dir)) is None


def test_odd_rows(docs):
    result = near_duplicates(docs(NASTY)).collect()
    assert len(result) == len(NASTY)
    by_id = {r.doc_id: r for r in result if r.doc_id is not None}
    assert by_id[5].component_id == 1 and not by_id[5].kept and by_id[1].kept
    assert [by_id[i].n_shingles for i in (2, 3, 4, 7)] == [0, 0, 0, 1]
    assert all(by_id[i].component_id == i and by_id[i].kept for i in (2, 3, 4, 6, 7, 8))
    assert all(r.component_id is None and r.kept for r in result if r.doc_id is None)


def test_empty_tables(docs, spark):
    assert near_duplicates(docs([])).collect() == []
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    result = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert result == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
