"""From raw documents to token files: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from isobar.llm import decontamination, minhash, mixing, token_files, toxicity
from isobar.llm.queries import tokenizer_spec
from isobar.llm.ship import ship
from isobar.session import settle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance does not find toxic.

    Null and empty texts are scored as texts without any saving. Equal texts stay or go together, and repeated
    rows stay as often as they come. An empty table stays empty; all columns are kept as they are.
    """
    ship(spark)
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id; all rows without an id.

    Documents without words are near to none. Of rows that share an id one stays, that with the least hash over all its columns
    (but maps, which have none), so reruns agree. An empty table stays empty; all columns are kept.
    """
    ship(spark)
    found = minhash.near_duplicates(docs)
    kept = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    # As a struct, a row's own columns clash with none of those used here.
    rows = docs.where("doc_id IS NOT NULL").select(_packed(docs), F.xxhash64(*hashed).alias("order"))
    chosen = rows.join(kept, F.col("row.doc_id") == F.col("id"), "left_semi").groupBy("row.doc_id").agg(
        F.min_by("row", "order").alias("row")
    )
    return chosen.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def _packed(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay. Repeated rows stay or go together. An empty table stays empty; all
    columns are kept as they are.
    """
    ship(spark)
    return decontamination.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; equal rows are taken alike.

    Rows that share id, source and size are taken as often as the most taken of them. Texts without words have no
    size and come with the certain copies of their source. Null ids and sources are ids and sources like others.
    An empty table stays empty; all columns are kept.
    """
    ship(spark)
    copies = mixing.mix(docs).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    rows = docs.select(_packed(docs), mixing.words(F.col("text")).alias("words"))
    same = (
        F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source"))
        & (F.col("words") == F.col("size"))
    )
    taken = rows.join(copies, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return taken.select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of the mix, as reading them gives: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end alone. Rows go by id, null ids first, copies side by side. An empty table
    gives no rows; other columns are ignored.
    """
    ship(spark)
    return token_files.token_files(docs, tokenizer_spec())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: No stage but the fourth can be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
