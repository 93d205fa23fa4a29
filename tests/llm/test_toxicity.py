import zlib

from odd_rows import NASTY
from pyspark.sql import functions as F

from isobar.llm.toxicity import held_out, toxicity, windows, without_toxic

LABELS = "doc_id long, quality int, toxic int, text string, score double"


def labels(spark, rows):
    return spark.createDataFrame([(i, 1, t, "x", 0.5) for i, t in rows], LABELS)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    marked = spark.read.parquet(f"{path}/labels.parquet")
    result = toxicity(spark.read.parquet(f"{path}/documents.parquet"), marked).join(marked, "doc_id").where("held_out").collect()
    toxic, rest = [r for r in result if r.toxic], [r for r in result if not r.toxic]
    wins = sum(a.score > b.score for a in toxic for b in rest) / (len(toxic) * len(rest))
    assert wins > 0.85
    assert sum(r.predicted for r in toxic) > 0.6 * len(toxic)
    assert sum(r.predicted for r in rest) < 0.03 * len(rest)


def test_labels_that_are_held_out_are_not_used(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marked = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    other = marked.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r.doc_id: (r.score, r.held_out) for r in toxicity(table, marked).collect()}
    assert one == {r.doc_id: (r.score, r.held_out) for r in toxicity(table, other).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, (_, h) in one.items())


def test_odd_rows_and_missing_labels(spark, docs):
    marked = labels(spark, [(1, 1), (2, 0), (5, None), (None, 1), (6, 0), (6, 1)])
    for some in (marked, labels(spark, [])):
        result = toxicity(docs(NASTY), some).collect()
        assert len(result) == len(NASTY) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in result)
    assert len({r.score for r in toxicity(docs(NASTY), labels(spark, [])).collect()}) == 1
    assert toxicity(docs([]), marked).collect() == []
    table = docs(NASTY)
    assert without_toxic(table, labels(spark, [])).columns == table.columns


def test_windows_hold_the_whole_text():
    text = "Some  words\nand more " * 50 + "unbrokenstretch" * 100
    whole = b" ".join(w.strip() for w in windows(text))
    assert whole.decode() == " ".join(text.lower().split())
    assert windows(None) == windows("") == windows(" \n") == []
