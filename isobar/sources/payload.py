"""Payload documents → judged documents → typed hourly and daily rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from isobar.functions.lineage import batch_id_of, ingestion_timestamp
from isobar.schema import DAILY, HOURLY, METADATA, RAW, READINGS, VARIABLES
from isobar.sources.landing import CORRUPT

GRAINS = tuple(VARIABLES)


# --- judging ----------------------------------------------------------------

def _grain_size(grain: str) -> Column:
    return F.size(f"{grain}.time")


def _ragged(grain: str) -> Column:
    """Some variable that is present has another length than ``time``."""
    tests = [
        f"({grain}.{v} is not null and size({grain}.{v}) <> size({grain}.time))"
        for v in VARIABLES[grain]
    ]
    return F.expr(" or ".join(tests))


def _bad_time(grain: str) -> Column:
    return F.exists(
        f"{grain}.time", lambda t: t.isNotNull() & t.try_cast("timestamp_ntz").isNull()
    )


def _first_of(reasons: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in reasons.items()])


def reject_reason() -> Column:
    """Why a document is refused before any row is made of it; NULL if it is not.

    A grain without a ``time`` array is let through here, and fails below.
    """
    known = ["latitude", "longitude", "timezone", "hourly", "daily"]
    empty = F.lit(True)
    for name in known:
        empty = empty & F.col(name).isNull()
    return _first_of({
        "malformed_json": F.col(CORRUPT).isNotNull(),
        "empty_document": empty,
        "unreadable_request": F.col("start_date").isNull() | F.col("end_date").isNull(),
        "unknown_city": F.col("city_name").isNull(),
        **{f"missing_{g}": F.col(g).isNull() for g in GRAINS},
        **{
            f"empty_{g}_time": F.col(f"{g}.time").isNotNull() & (_grain_size(g) == 0)
            for g in GRAINS
        },
    })


def failure_reason() -> Column:
    """Why an accepted document cannot become rows; NULL if it can."""
    return _first_of({
        **{f"no_{g}_time": F.col(f"{g}.time").isNull() for g in GRAINS},
        **{f"ragged_{g}": _ragged(g) for g in GRAINS},
        **{f"bad_{g}_time": _bad_time(g) for g in GRAINS},
    })


def judge(docs: DataFrame) -> DataFrame:
    """Add ``reject_reason`` and, for documents that pass it, ``failure_reason``.

    ``docs`` are enriched: a city that the dimension lacks is a reason, too.
    """
    return docs.withColumn("reject_reason", reject_reason()).withColumn(
        "failure_reason", F.when(F.col("reject_reason").isNull(), failure_reason())
    )


def refused(judged: DataFrame) -> DataFrame:
    """The documents that give no rows, and why; with their file and text where ``scan_documents`` kept them."""
    reason = F.coalesce("reject_reason", "failure_reason")
    kept = [c for c in ("file", "document") if c in judged.columns]
    return judged.select(
        "city_id", "start_date", "end_date", "landed_at", reason.alias("reason"), "batch_id", *kept
    ).where(F.col("reason").isNotNull())


def verdicts(judged: DataFrame) -> DataFrame:
    """How many documents of each request were accepted, refused or failed, and why."""
    return judged.groupBy(
        "city_id",
        F.coalesce("reject_reason", "failure_reason", F.lit("accepted")).alias("verdict"),
    ).agg(F.count(F.lit(1)).alias("documents"))


# --- rows -------------------------------------------------------------------

def enrich(docs: DataFrame, dimension: DataFrame) -> DataFrame:
    """Add ``city_name``. Done on documents, which are few, and not on rows.

    The join has no hint: the planner knows the size of a local relation, as
    ``cities`` is, and of files.
    """
    names = dimension.select("city_id", "city_name")
    return docs.join(names, "city_id", "left")


def stamped(docs: DataFrame, run_ts: datetime) -> DataFrame:
    """Add the lineage of the run: the same values on every row."""
    return docs.withColumn("ingestion_timestamp", ingestion_timestamp(run_ts)).withColumn(
        "batch_id", F.lit(batch_id_of(run_ts))
    )


def _zipped(grain: str) -> Column:
    """The parallel arrays of a grain as one array of typed readings.

    A variable that was not sent counts as an empty array, which zips to NULLs.
    Unequal lengths, which would zip to NULLs as well, have been judged before.
    """
    arrays = [f"coalesce({grain}.{v}, array())" for v in VARIABLES[grain]]
    zipped = F.expr(f"arrays_zip({grain}.time, {', '.join(arrays)})")
    return zipped.cast(ArrayType(READINGS[grain]))


def _usable(readings: Column, on_failure: str) -> Column:
    """The readings of good documents. Refused documents give no rows; failed
    ones stop the job, or give no rows either under ``quarantine``.

    This is a condition inside the generator and not a filter before it: a
    filter would be pushed below and judge every document a second time.
    """
    if on_failure not in ("fail", "quarantine"):
        raise ValueError(f"no such policy: {on_failure}; there are fail and quarantine")
    good = F.col("reject_reason").isNull() & F.col("failure_reason").isNull()
    usable = F.when(good, readings)
    if on_failure == "fail":
        message = F.concat_ws(
            " ", F.lit("Document cannot be read as rows:"), "city_id", "failure_reason"
        )
        usable = F.when(F.col("failure_reason").isNotNull(), F.raise_error(message)).otherwise(
            usable
        )
    return usable


def grain_rows(judged: DataFrame, grain: str, on_failure: str = "fail") -> DataFrame:
    """Rows of one grain in its canonical schema (38 hourly or 28 daily columns).

    ``judged`` holds judged documents with city name and lineage columns.
    """
    rows = judged.select(*METADATA.fieldNames(), F.inline(_usable(_zipped(grain), on_failure)))
    return rows.select(*RAW[grain].fieldNames())


def hourly_rows(judged: DataFrame, on_failure: str = "fail") -> DataFrame:
    return grain_rows(judged, "hourly", on_failure)


def daily_rows(judged: DataFrame, on_failure: str = "fail") -> DataFrame:
    return grain_rows(judged, "daily", on_failure)


def all_rows(judged: DataFrame, on_failure: str = "fail") -> DataFrame:
    """Rows of both grains with a ``grain`` column, from one parse of each document.

    Columns of the other grain are NULL. Written with ``partitionBy("grain")``
    this lands both grains in one job: they appear together or not at all.
    """
    def tagged(grain: str) -> Column:
        def wrap(reading: Column) -> Column:
            sides = [
                (reading if g == grain else F.lit(None).cast(READINGS[g])).alias(g) for g in GRAINS
            ]
            return F.struct(F.lit(grain).alias("grain"), *sides)

        return F.transform(_zipped(grain), wrap)

    both = F.concat(*[tagged(g) for g in GRAINS])
    rows = judged.select(*METADATA.fieldNames(), F.inline(_usable(both, on_failure)))

    names = list(dict.fromkeys(HOURLY.fieldNames() + DAILY.fieldNames()))
    carried = set(METADATA.fieldNames())

    def column(name: str) -> str:
        if name in carried:
            return name
        sides = [f"{g}.{name}" for g in GRAINS if name in READINGS[g].fieldNames()]
        return f"coalesce({', '.join(sides)}) as {name}"

    return rows.selectExpr("grain", *[column(n) for n in names])


def rows_and_refusals(judged: DataFrame, on_failure: str = "quarantine", marks: Column | None = None) -> DataFrame:
    """Rows of both grains and refused documents, told apart by ``kind``, from one parse of each document.

    ``judged`` has the documents' text and file, which a refused document keeps with its reason. Like
    ``all_rows`` this is one generator, so everything a document gives is written by one job. With ``marks``
    a document that gives rows also gives its mark, as ``taken``, in the place of its text.
    """
    reason = F.coalesce("reject_reason", "failure_reason")

    def tagged(kind: str, **sides: Column) -> Column:
        empty = {g: F.lit(None).cast(READINGS[g]) for g in GRAINS} | {n: F.lit(None).cast("string") for n in ("reason", "file", "document")}
        return F.struct(F.lit(kind).alias("kind"), *[v.alias(n) for n, v in (empty | sides).items()])

    def readings(grain: str) -> Column:
        return F.transform(_zipped(grain), lambda r: tagged(grain, **{grain: r}))

    taken = [] if marks is None else [F.array(tagged("taken", document=marks))]
    both = F.concat(*[readings(g) for g in GRAINS], *taken)
    refusal = F.array(tagged("refused", reason=reason, file=F.col("file"), document=F.col("document")))
    given = _usable(both, on_failure)
    rows = judged.select(
        *METADATA.fieldNames(), "start_date", "end_date", "landed_at",
        F.inline(F.when(reason.isNotNull() & _refusable(on_failure), refusal).otherwise(given)),
    )
    names = list(dict.fromkeys(HOURLY.fieldNames() + DAILY.fieldNames()))

    def column(name: str) -> str:
        if name in METADATA.fieldNames():
            return name
        sides = [f"{g}.{name}" for g in GRAINS if name in READINGS[g].fieldNames()]
        return f"coalesce({', '.join(sides)}) as {name}"

    return rows.selectExpr("kind", *[column(n) for n in names], "start_date", "end_date", "landed_at", "reason", "file", "document")


def _refusable(on_failure: str) -> Column:
    """Documents that are refused and not an error of the run."""
    return F.lit(True) if on_failure == "quarantine" else F.col("failure_reason").isNull()


def within(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the requested days, both ends included. A row without a time is
    kept: the not-null check is to find it."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return rows.where(F.col("time").isNull() | F.to_date("time").between(first, last))


def within_requests(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of the days that were asked for of their city; rows without a time stay."""
    asked = requests.select(
        F.col("city_id").alias("asked_city"), F.col("start_date").alias("first"), F.col("end_date").alias("last")
    )
    day = F.to_date("time")
    in_range = F.col("time").isNull() | day.between(F.col("first"), F.col("last"))
    return rows.join(asked, (F.col("city_id") == F.col("asked_city")) & in_range, "left_semi")


def ingest_stats(rows: DataFrame) -> DataFrame:
    """Per city and batch: how many rows came in, and for which days."""
    return rows.groupBy("city_id", "batch_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.to_date(F.min("time")).alias("start_date"),
        F.to_date(F.max("time")).alias("end_date"),
    )
