import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from odd_rows import NASTY

from isobar.llm.packing import place, shard


def check(rows, result, shards=16):
    assert len(result) == len(rows)
    slots = defaultdict(list)
    for r in result:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots


def test_shards_are_even_and_groups_stay_together(docs):
    chance = random.Random(3)
    rows = [(i, "w" * int(chance.paretovariate(1.1) * 20)) for i in range(3000)]
    hot = "copy " * 30
    rows += [(3000 + i, hot) for i in range(1500)] + [(4500 + i, f"small group {i // 10}") for i in range(200)]
    rows = [(i, t[:5000]) for i, t in rows]
    result = shard(docs(rows)).collect()
    check(rows, result)
    texts, sizes, where = dict(rows), Counter(), defaultdict(set)
    for r in result:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        sizes[r.shard] += r.size
        where[texts[r.doc_id]].add(r.shard)
    mean = sum(sizes.values()) / 16
    assert max(sizes.values()) < 1.02 * mean and min(sizes.values()) > 0.98 * mean
    assert len(where[hot]) > 1 and all(len(s) == 1 for t, s in where.items() if t.startswith("small"))


def test_odd_rows(docs):
    rows = [r for r in NASTY]
    result = shard(docs(rows)).collect()
    check(rows, result)
    assert sorted(r.size for r in result if r.doc_id in (2, 3, 4)) == [1, 1, 5]
    assert shard(docs([])).collect() == []


def test_the_largest_dot_product_wins():
    units = np.array([[4.0, 4, 4], [3, 3, 3], [2, 2, 2], [2, 2, 2], [1, 1, 1]])
    chosen = place(units, 2)
    assert sorted(units[chosen == s].sum() for s in (0, 1)) == [18.0, 18.0]
