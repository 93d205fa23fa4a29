import random
import tracemalloc

import numpy as np
from odd_rows import NASTY

from isobar.llm.decontamination import _common, contaminated, decontaminated, inverse_frequencies

BENCHMARK = "item_id long, text string, doc_id long, term long"


def benchmark(spark, rows):
    return spark.createDataFrame([(*r, 5, 6) for r in rows], BENCHMARK)


def test_passages_and_paraphrases_are_found_and_others_left(spark, docs):
    chance = random.Random(6)
    common, rare = ["the", "of", "and", "to"], [f"r{i}" for i in range(6000)]

    def text(n):
        return [chance.choice(common) if chance.random() < 0.4 else chance.choice(rare) for _ in range(n)]

    items = [(i, " ".join(text(chance.choice([15, 40, 90])))) for i in range(60)]
    rows, expected = [], set()
    for i in range(400):
        words = text(chance.choice([20, 300, 1500]))
        if i % 4 == 0:
            item = chance.randrange(60)
            passage = items[item][1].split()
            if i % 8 == 0:  # a paraphrase: some words others, some left out
                for _ in range(len(passage) // 8):
                    passage[chance.randrange(len(passage))] = chance.choice(rare)
                del passage[len(passage) // 2]
            at = chance.randrange(len(words))
            words[at:at] = [w.upper() + "," if i % 3 == 0 else w for w in passage]
            expected.add((i, item))
        rows.append((i, " ".join(words)))
    found = contaminated(docs(rows), benchmark(spark, items)).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert not pairs - expected and len(pairs) >= 0.95 * len(expected)
    kept = {r.doc_id for r in decontaminated(docs(rows), benchmark(spark, items)).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in pairs}


def test_whole_items_of_the_given_table(spark):
    path = "/root/testdata/sf0.01"
    table, items = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    clean = {i.item_id: " ".join(i.text.lower().split()) for i in items.collect()}
    expected = {(d.doc_id, i) for d in table.collect() for i, t in clean.items() if t in " ".join(d.text.lower().split())}
    found = {(r.doc_id, r.item_id) for r in contaminated(table, items).collect()}
    assert expected <= found and len(found) <= len(expected) + 2


def test_odd_rows_and_empty_tables(spark, docs):
    item = "One two three four five six seven eight"
    items = benchmark(spark, [(1, item), (1, item), (2, None), (3, ""), (4, "too short"), (None, item)])
    found = contaminated(docs(NASTY), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (5, 1)} and len(found) == 2
    table = docs(NASTY)
    kept = decontaminated(table, items)
    assert kept.columns == table.columns and kept.count() == len(NASTY) - 3
    assert contaminated(docs([]), items).collect() == []
    assert contaminated(docs(NASTY), benchmark(spark, [])).collect() == []
    assert decontaminated(docs(NASTY), benchmark(spark, [])).count() == len(NASTY)


def test_common_subsequence_by_brute_force():
    chance = random.Random(7)
    for _ in range(200):
        a = np.array([chance.randrange(5) for _ in range(chance.randrange(12))], np.uint64)
        b = np.array([chance.randrange(5) for _ in range(chance.randrange(12))], np.uint64)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert _common(a, b).sum() == best[-1][-1]


def test_paraphrases_of_half_an_item_with_its_answer(spark, docs):
    chance = random.Random(8)
    items, rows = [], []
    for i in range(120):
        n = (6, 12, 16, 20, 33, 50, 64, 66)[i % 8]
        item = [f"i{i}w{k}" for k in range(n)]
        kept = set(range(n - n // 3, n))
        kept.update(chance.sample([k for k in range(n) if k not in kept], -(-n // 2) - len(kept)))
        words = [f"x{chance.randrange(10**6)}" for _ in range(300)]
        at = chance.randrange(300)
        words[at:at] = [w if k in kept else f"y{chance.randrange(10**6)}" for k, w in enumerate(item)]
        items.append((i, " ".join(item)))
        rows.append((i, " ".join(words)))
    found = contaminated(docs(rows), benchmark(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(120)}


def test_every_window_of_a_document_is_looked_at(spark, docs):
    chance = random.Random(9)
    items, rows = [], []
    for i in range(20):
        item = [f"i{i}w{k}" for k in range(64)]
        quoted, whole = item[:32], [f"y{i}n{k}" if k % 4 == 1 else w for k, w in enumerate(item)]
        far = [[f"x{chance.randrange(10**6)}" for _ in range(600)] for _ in range(3)]
        items.append((i, " ".join(item)))
        rows += [(i, " ".join([*far[0], *quoted, *far[1], *whole, *far[2]])), (100 + i, " ".join([*far[0], *quoted, *far[1]]))]
    found = contaminated(docs(rows), benchmark(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(20)}
    assert all(r.common == 0.75 for r in found)


def test_the_driver_gathers_frequencies_in_columns(spark, docs):
    table = docs([(i, " ".join(f"w{j}" for j in range(1000 * i, 1000 * i + 1000))) for i in range(200)])
    tracemalloc.start()
    try:
        idf, common = inverse_frequencies(table)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    seen = idf < np.float32(np.log(201) + 1)
    assert 100_000 < seen.sum() < 200_000 and not common.any()
    # A few numbers for each hashed term; rows of Python objects take a multiple.
    assert most < 16e6
