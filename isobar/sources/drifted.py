"""Parquet files whose column types drift from file to file.

Files written by other tools carry the types their writer inferred: nanosecond
timestamps, one measure as integer here, as double there, and as an all-null
column elsewhere, variables missing. Spark's reader takes one schema for all
files and refuses such a set. So files are put in groups of one schema each, by
their footers; Spark reads every group as it is, with its own pruning and
pushdown, and the groups are cast to the canonical schema and put together.
1.5 stays 1.5 whichever file comes first, and a value that a cast would change
stops the scan with its file and column. Use this once, to bring foreign files
into the raw layer; canonical files need only ``scan_files``. Footers are read by tasks; those of files in
a store that only Spark reads by the driver, a few kilobytes of each.
"""

from __future__ import annotations

import json
import logging
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyarrow import parquet
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from isobar.functions.calendar import utc_wall_clock

log = logging.getLogger(__name__)

#: what Spark reads a column as, by the type in the file's footer
READ_AS = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float": "float", "double": "double", "string": "string", "large_string": "string",
    "date32[day]": "date", "timestamp[ms]": "timestamp_ntz", "timestamp[us]": "timestamp_ntz",
}
#: tails that the driver reads at once, of files that Python workers cannot open
READERS = 16
NANOS = "timestamp[ns"
_NANOS_AS_LONG = "spark.sql.legacy.parquet.nanosAsLong"
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _footers():
    # Returned as an inner function: it is shipped to the tasks by value, and
    # needs nothing but pyarrow there.
    def read(batches):
        import json

        import pyarrow as pa
        import pyarrow.fs
        import pyarrow.parquet

        for batch in batches:
            shapes = []
            for path in batch.column(0).to_pylist():
                uri = path.replace("s3a://", "s3://", 1)
                if uri.startswith("file:/") and not uri.startswith("file://"):
                    uri = "file://" + uri[len("file:"):]
                try:
                    filesystem, name = pyarrow.fs.FileSystem.from_uri(uri)
                    opened = filesystem.open_input_file(name)
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
                    shapes.append(None)  # a store that only Spark reads
                    continue
                with pyarrow.parquet.ParquetFile(opened) as file:
                    shapes.append(json.dumps([[f.name, str(f.type)] for f in file.schema_arrow]))
            yield pa.record_batch([batch.column(0), pa.array(shapes, pa.string())], names=["path", "shape"])

    return read


def _footer(spark: SparkSession, path: str) -> str:
    """The same for one file in a store that only Spark reads: its tail alone, by the file systems that Spark uses."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    length = system.getFileStatus(where).getLen()

    def tail(size: int) -> bytes:
        stream = system.open(where)
        try:
            stream.seek(length - size)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
        finally:
            stream.close()

    # A file ends with its footer, the footer's length and a mark of four bytes.
    ending = tail(min(8, length))
    footer = tail(min(length, 8 + int.from_bytes(ending[:4], "little")))
    shape = parquet.read_schema(pa.BufferReader(b"PAR1" + footer))
    return json.dumps([[f.name, str(f.type)] for f in shape])


def _plain(kind: str) -> str:
    """The type of the values of a dictionary-encoded column, or the type itself."""
    return kind.split("values=", 1)[1].split(",", 1)[0] if kind.startswith("dictionary<") else kind


def _read_type(kind: str) -> str | None:
    """The type to read a column with; None for an all-null one."""
    if kind == "null":
        return None
    if kind.startswith(NANOS):
        return "bigint"
    if kind.startswith("timestamp[") and "tz=" in kind:
        return "timestamp"
    if kind not in READ_AS:
        raise ValueError(f"no way to read a column of type {kind}")
    return READ_AS[kind]


def _lossless(value: Column, same: Column, changed: Column, target: StructField) -> Column:
    """``value`` where it says the same as before, an error with file and column where not."""
    told = F.concat(
        F.lit(f"{target.name} cannot hold "), changed.cast("string"), F.lit(" of "), F.col("_metadata.file_path")
    )
    return F.when(changed.isNull() | same, value).otherwise(F.raise_error(told))


def _cast(source: str, kind: str, target: StructField) -> Column:
    """A column as the canonical type."""
    column, wanted = F.col(f"`{source}`"), target.dataType.simpleString()
    if kind.startswith(NANOS):
        micros = F.floor(column / F.lit(1000).cast("decimal(20,0)")).cast("bigint")
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        return _lossless(F.timestamp_add("MICROSECOND", micros, epoch), column % 1000 == 0, column, target).cast(wanted)
    read = _read_type(kind)
    if read == "timestamp":
        column = utc_wall_clock(column)
    if wanted == "int" and read in (*WHOLE, "float", "double", "decimal(20,0)"):
        return _lossless(column.try_cast("int"), column == column.try_cast("int"), column, target)
    if wanted == "double" and read in ("bigint", "decimal(20,0)"):
        back = column.cast("double").try_cast(read)
        return _lossless(column.cast("double"), column == back, column, target)
    return column.cast(target.dataType)


def scan_drifted(
    spark: SparkSession, directory: str, schema: StructType, glob: str = "*.parquet", others: bool = False
) -> DataFrame:
    """All rows of the files under ``directory`` that match ``glob``, as ``schema``.

    Variables beyond the schema are named in the log; with ``others`` they are kept as
    text in a map column of that name. Nanoseconds are read as integers, by a setting of
    the session that is put back. There is one scan for each different footer.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory).select("path")
        # A fixed number: by size, these few names would be coalesced into one task.
        .repartition(4 * spark.sparkContext.defaultParallelism)
        .mapInArrow(_footers(), "path string, shape string")
    )
    # The driver lists these files for the scans anyway.
    found = files.groupBy("shape").agg(F.collect_list("path").alias("paths")).collect()
    of = {g["shape"]: list(g["paths"]) for g in found}
    with ThreadPoolExecutor(READERS) as readers:
        unread = of.pop(None, [])
        for path, shape in zip(unread, readers.map(lambda p: _footer(spark, p), unread)):
            of.setdefault(shape, []).append(path)
    groups = [{"shape": shape, "paths": sorted(paths)} for shape, paths in sorted(of.items())]
    # A scan keeps the setting under which it was made; other reads of the session are left alone.
    before = spark.conf.get(_NANOS_AS_LONG, None)
    spark.conf.set(_NANOS_AS_LONG, "true")
    try:
        scans = [_scan_group(spark, json.loads(g["shape"]), list(g["paths"]), schema, others) for g in groups]
    finally:
        spark.conf.unset(_NANOS_AS_LONG) if before is None else spark.conf.set(_NANOS_AS_LONG, before)
    if not scans:
        extra = [StructField("others", _OTHERS)] if others else []
        return spark.createDataFrame([], StructType(schema.fields + extra))
    return reduce(DataFrame.unionByName, scans)


_OTHERS = MapType(StringType(), StringType())


def _scan_group(
    spark: SparkSession, shape: list[list[str]], paths: list[str], schema: StructType, others: bool
) -> DataFrame:
    kinds = {name: _plain(kind) for name, kind in shape}
    unknown = sorted(set(kinds) - set(schema.names))
    if unknown:
        log.warning("variables beyond the schema in %s files: %s", len(paths), ", ".join(unknown))
    wanted = [n for n in kinds if n in schema.names or others]
    read = {n: t for n in wanted if (t := _read_type(kinds[n])) is not None}
    rows = spark.read.schema(", ".join(f"`{n}` {t}" for n, t in read.items()) or "none int").parquet(*paths)
    columns = [
        (_cast(f.name, kinds[f.name], f) if f.name in read else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    if others:
        pairs = [x for n in unknown if n in read for x in (F.lit(n), F.col(f"`{n}`").cast("string"))]
        columns.append((F.create_map(*pairs) if pairs else F.lit(None)).cast(_OTHERS).alias("others"))
    return rows.select(*columns)
