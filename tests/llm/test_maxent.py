import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import NASTY

from isobar.llm import maxent
from isobar.llm.maxent import lm_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def check(rows, result):
    """Everything but the model's own score, by plain counting. rows: (doc_id, text)"""
    words = [(i, [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for i, t in rows]
    counts = Counter()
    for i, own in words:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(own)
    total, types = sum(counts.values()), len(counts)
    expected = sorted(
        (str(i), len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w), 5))
        for i, w in words
    )
    assert expected == sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in result)


def test_counts_by_brute_force_and_scores_better_than_the_base(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    result = lm_scores(table).collect()
    check([(r.doc_id, r.text) for r in table.collect()], result)
    held = [r for r in result if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in result)


def test_odd_rows(docs):
    result = lm_scores(docs(NASTY)).collect()
    check(NASTY, result)
    assert all(math.isfinite(r.score) and r.score < 0 for r in result)
    assert len({r.score for r in result if r.doc_id in (2, 3, 4)}) == 1
    assert lm_scores(docs([])).collect() == []


def test_without_training_rows(docs):
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = lm_scores(docs([(alone, "two words")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and math.isfinite(row.score)


def test_class_probabilities_sum_to_one():
    weights = np.random.default_rng(1).normal(size=(maxent.FEATURES, maxent.CLASSES)).astype(np.float32)
    logs = maxent._log_softmax(weights, np.arange(0, maxent.CONTEXTS, 977))
    assert np.exp(logs).sum(axis=1) == pytest.approx(1, abs=1e-4)
