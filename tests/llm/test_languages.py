import itertools
import zlib

import numpy as np
import pytest
from odd_rows import NASTY
from pyspark.sql import functions as F

from isobar.llm import languages as module
from isobar.llm.languages import fit, languages, posteriors, word_labels

PATH = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.parametrize("fresh", [[1, 0, 0, 0, 0], [1, 0, 1, 0, 0], [1, 1, 1, 1, 1]])
def test_forward_backward_against_all_labellings(monkeypatch, fresh):
    """Blocks shorter and longer than the chain; potentials of very different sizes."""
    rng = np.random.default_rng(3)
    scores, start, moves = rng.normal(size=(5, 3)) * 30, rng.normal(size=3), rng.normal(size=(3, 3))
    mass, joint = np.zeros((5, 3)), np.zeros((3, 3))
    for y in itertools.product(range(3), repeat=5):
        log = sum(scores[t, y[t]] + (start[y[t]] if fresh[t] else moves[y[t - 1], y[t]]) for t in range(5))
        mass[np.arange(5), y] += np.exp(log - scores.sum())
        for t in range(1, 5):
            if not fresh[t]:
                joint[y[t - 1], y[t]] += np.exp(log - scores.sum())
    expected, joint = mass / mass.sum(axis=1, keepdims=True), joint / mass[0].sum()
    for block in (1, 2, 3, 64):
        monkeypatch.setattr(module, "BLOCK", block)
        both, pairs, began = posteriors(scores, np.array(fresh, bool), start, moves, pairs=True)
        assert both == pytest.approx(expected) and pairs == pytest.approx(joint)
        assert began == pytest.approx(expected[np.array(fresh, bool)].sum(axis=0))
        assert posteriors(scores, np.array(fresh, bool), start, moves) == pytest.approx(expected)


def test_held_out_accuracy(spark):
    table = spark.read.parquet(PATH)
    result = languages(table).join(table.select("doc_id", "lang", "text"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(result) > 2000
    assert sum(r.lang_pred == r.lang for r in result) > 0.98 * len(result)
    assert all(0 <= r.score <= 1 for r in result)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in result)


def test_what_is_held_out_and_other_columns_are_not_used(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    other = table.withColumn("lang", F.when(module.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("en"))
    one = {r.doc_id: (r.lang_pred, r.score) for r in languages(table).collect()}
    assert one == {r.doc_id: (r.lang_pred, r.score) for r in languages(other).collect()}


def test_words_of_code_switched_texts(spark):
    """Halves of held-out documents of two languages: most words have the language of their half."""
    table = spark.read.parquet(PATH)
    model = fit(table)
    rows = table.where(module.held_out(F.col("doc_id"))).where("length(text) > 400").collect()
    by = {lang: [r.text for r in rows if r.lang == lang] for lang in model["labels"]}
    right = total = 0
    for x, y in itertools.permutations(model["labels"], 2):
        for a, b in zip(by[x][:10], by[y][10:20]):
            a, b = " ".join(a.split()[5:35]), " ".join(b.split()[5:35])
            first = len(word_labels(a, model))
            labels = [label for _, label, _ in word_labels(a + " " + b, model)]
            right += sum(label == x for label in labels[:first]) + sum(label == y for label in labels[first:])
            total += len(labels)
    assert right > 0.9 * total
    stay, move = np.diag(model["moves"]).mean(), model["moves"].mean()
    assert stay > move


def test_odd_rows(spark):
    rows = [(i, t, ("en", "de", None)[k % 3], "s") for k, (i, t) in enumerate(NASTY)]
    rows += [(100, "12 34 . ,", "en", "x"), (101, "— …", "de", "x"), (102, "漢字", None, "x"), (103, "³ ½", "de", "x"), (104, "x" * 300_000, "en", "x")]
    schema = "doc_id long, text string, lang string, source string, score double, lang_pred string, held_out string"
    table = spark.createDataFrame([(*r, 0.5, "xx", "no") for r in rows], schema)
    found = sorted(map(tuple, languages(table).collect()), key=repr)
    assert len(found) == len(rows)
    by = {r[0]: r for r in found}
    for i, text, *_ in rows:
        if i is not None and not module.has_letter(text):
            assert by[i][2:] == ("und", 0.0)
        elif i is not None:
            assert by[i][2] in ("en", "de") and 0 < by[i][3] <= 1
    assert languages(table.where("false")).collect() == []
    none = languages(table.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert {r.lang_pred for r in languages(table.withColumn("lang", F.lit("fr"))).collect()} == {"fr", "und"}
