"""Landed payload documents: where they lie and how they are scanned.

Layout: ``<root>/city_id=<c>/start_date=<d>/end_date=<d>/<files>``. The city and
the range are those of the request, because the response names neither.

Two file forms are read. ``lines`` holds one document per line and splits
inside a file; ``documents`` holds one pretty-printed document per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from isobar.schema import PAYLOAD

CORRUPT = "_corrupt_record"
REQUEST = StructType([
    StructField("city_id", StringType()),
    StructField("start_date", DateType()),
    StructField("end_date", DateType()),
])
LANDED = StructType(
    PAYLOAD.fields + [StructField(CORRUPT, StringType())] + REQUEST.fields
)
FORMS = ("lines", "documents")


def _reader(reader, form: str):
    if form not in FORMS:
        raise ValueError(f"no such form: {form}; there are {FORMS}")
    return (
        reader.schema(LANDED)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", form == "documents")
    )


def _with_landing_time(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_modification_time").alias("landed_at"))


def scan_landing(spark: SparkSession, path: str, form: str = "lines") -> DataFrame:
    return _with_landing_time(_reader(spark.read, form).json(path))


def stream_landing(
    spark: SparkSession, path: str, form: str = "lines", max_files: int | None = None
) -> DataFrame:
    reader = _reader(spark.readStream, form)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _with_landing_time(reader.json(path))


def _parsed(df: DataFrame) -> DataFrame:
    """Documents read as text: parsed like ``scan_landing`` does, with their text and file."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json("document", StructType([*PAYLOAD.fields, StructField(CORRUPT, StringType())]), options)
    # Blank lines are no documents.
    return (
        df.withColumnRenamed("value", "document").where(F.trim("document") != "")
        .withColumn("parsed", parsed).select("*", "parsed.*").drop("parsed")
    )


def _texts(reader, path: str, form: str) -> DataFrame:
    if form not in FORMS:
        raise ValueError(f"no such form: {form}; there are {FORMS}")
    schema = StructType([StructField("value", StringType()), *REQUEST.fields])
    return reader.schema(schema).text(path, wholetext=form == "documents")


def _with_file(df: DataFrame) -> DataFrame:
    return _with_landing_time(df).withColumn("file", F.col("_metadata.file_path"))


def scan_documents(spark: SparkSession, path: str, form: str = "lines") -> DataFrame:
    """``scan_landing`` with two more columns: the document's text, and its file."""
    return _parsed(_with_file(_texts(spark.read, path, form)))


def stream_documents(
    spark: SparkSession, path: str, form: str = "lines", max_files: int | None = None
) -> DataFrame:
    """The same for files as they land."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _parsed(_with_file(_texts(reader, path, form)))


def parse_again(kept: DataFrame) -> DataFrame:
    """Kept documents (city_id, start_date, end_date, file, document, landed_at) as ``scan_documents`` gives them."""
    return _parsed(kept)


def requested(
    docs: DataFrame, start: str, end: str, city_ids: list[str] | None = None
) -> DataFrame:
    """Documents that can hold rows of the request, of the given cities or all.

    The conditions are on directory columns, so other documents are not read.
    Documents in folders whose dates cannot be read may be of any day: they stay,
    to be refused by name.
    """
    chosen = docs.where(
        F.col("start_date").isNull()
        | F.col("end_date").isNull()
        | (F.col("start_date") <= F.lit(end).cast("date"))
        & (F.col("end_date") >= F.lit(start).cast("date"))
    )
    return chosen if city_ids is None else chosen.where(F.col("city_id").isin(city_ids))


def write_landing(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Write (city_id, start_date, end_date, document) as lines.

    ``rebalance`` gathers the documents of one request into few files, but
    splits a request that is too large for one task.
    """
    keys = REQUEST.fieldNames()
    (
        documents.select("document", *keys)
        .hint("rebalance", *keys)
        .write.mode(mode)
        .partitionBy(*keys)
        .text(path)
    )
