"""Layer databases and the ways a table in them comes to be."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from isobar.operators.quality import union
from isobar.schema import LAYERS, LEGACY, RAW, conform
from isobar.sources.raw import find_raw, scan_raw


@dataclass(frozen=True)
class Layers:
    """Databases raw, staging and mart, stored under ``root``, and one named state
    for what a refresh keeps for the next one.

    ``prefix`` keeps several environments apart in one catalog.
    """

    spark: SparkSession
    root: str
    prefix: str = ""

    def create(self) -> Layers:
        for layer in [*LAYERS, "state"]:
            location = f"{self.root}/{layer}"
            self.spark.sql(
                f"CREATE DATABASE IF NOT EXISTS `{self.prefix}{layer}` LOCATION '{location}'"
            )
        return self

    def name(self, table: str) -> str:
        """The catalog name of ``layer.table``."""
        return f"{self.prefix}{table}"

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def path(self, table: str) -> str:
        return f"{self.root}/{table.replace('.', '/')}"

    def listing(self) -> DataFrame:
        """Tables of the three layers with their row counts, by layer and name.

        Rows of a Parquet table are counted from the file footers.
        """
        counts = []
        for layer in LAYERS:
            for entry in self.spark.catalog.listTables(f"{self.prefix}{layer}"):
                if entry.isTemporary:
                    continue
                table = f"{layer}.{entry.name}"
                counts.append(
                    self.table(table).agg(F.count(F.lit(1)).alias("row_count")).select(
                        F.lit(layer).alias("schema_name"),
                        F.lit(entry.name).alias("table_name"),
                        "row_count",
                    )
                )
        if not counts:
            empty = "schema_name string, table_name string, row_count bigint"
            return self.spark.createDataFrame([], empty)
        listed = union(counts).where(F.col("schema_name").isin(LAYERS))
        return listed.orderBy("schema_name", "table_name")


#: snapshots of a table that stay: the one it shows, and those that readers may still be in
KEEP = 3


def _shape(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def _point_at(layers: Layers, table: str, path: str, schema: StructType) -> DataFrame:
    """Let ``layer.table`` show the files in ``path``.

    An existing table of the same columns moves in one catalog change, so at no
    time is there no table. Only a change of columns drops and creates it.
    """
    name = layers.name(table)
    if layers.exists(table) and _shape(layers.table(table).schema) == _shape(schema):
        layers.spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        layers.spark.catalog.refreshTable(name)
    else:
        layers.spark.sql(f"DROP TABLE IF EXISTS {name}")
        layers.spark.catalog.createTable(name, path=path, source="parquet", schema=schema)
    return layers.table(table)


def properties(layers: Layers, table: str) -> dict[str, str]:
    """The properties that ``full_refresh`` has given ``layer.table``."""
    if not layers.exists(table):
        return {}
    return {r.key: r.value for r in layers.spark.sql(f"SHOW TBLPROPERTIES {layers.name(table)}").collect()}


def expire(layers: Layers, table: str, keep: int = KEEP) -> list[str]:
    """Remove all but the ``keep`` newest snapshots of a table, and return their names.

    The names begin with the time they were made. The snapshot that the table shows
    is the newest and always stays.
    """
    if keep < 1:
        raise ValueError("the snapshot that a table shows cannot be removed")
    hadoop = layers.spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(layers.path(table))
    system = folder.getFileSystem(layers.spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in system.listStatus(folder))
    old = [n for n in names if n.startswith("snapshot=")][:-keep]
    for name in old:
        system.delete(hadoop.Path(folder, name), True)
    return old


def full_refresh(
    layers: Layers, df: DataFrame, table: str, notes: dict[str, str] | None = None, keep: int = KEEP
) -> DataFrame:
    """Replace ``layer.table`` by the rows of ``df``.

    The rows go to a new folder, and the table is pointed at it when they are
    complete. Until then readers see the old rows, a failed run changes nothing,
    and ``df`` may read the very table it replaces. The ``keep`` newest folders
    stay as snapshots: a reader that began before the last ``keep - 1`` refreshes
    may lose its files. ``notes`` become properties of the table.
    """
    made = datetime.now(UTC).strftime("%Y%m%dT%H%M%S%f")
    path = f"{layers.path(table)}/snapshot={made}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    shown = _point_at(layers, table, path, df.schema)
    if notes:
        pairs = ", ".join(f"'{k}' = '{v}'" for k, v in notes.items())
        layers.spark.sql(f"ALTER TABLE {layers.name(table)} SET TBLPROPERTIES ({pairs})")
    expire(layers, table, keep)
    return shown


def build_once(layers: Layers, df: DataFrame, table: str) -> DataFrame:
    """Create ``layer.table`` from ``df``, or leave it alone if it is there."""
    if not layers.exists(table):
        full_refresh(layers, df, table)
    return layers.table(table)


def register_raw(layers: Layers, raw_root: str) -> dict[str, DataFrame]:
    """``raw.weather_hourly`` and ``raw.weather_daily`` over the landed files.

    The files already are the table; copying them would only cost their size.
    New batches are found again on every call. Without daily files there is no
    daily table, and the result for it is empty.

    A streamed root has no batch folders, and which of its files count is known
    to the log of its sink alone. No catalog table can show that, so there is
    none, and the result is the scan of the root.
    """
    tables = {}
    for grain, schema in RAW.items():
        table = f"raw.weather_{grain}"
        name, path = layers.name(table), f"{raw_root}/grain={grain}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        if find_raw(layers.spark, grain, schema, path) is None:
            layers.spark.sql(f"DROP TABLE IF EXISTS {name}")
            tables[table] = layers.spark.createDataFrame([], schema)
            continue
        if not _shows(layers, table, path):
            layers.spark.sql(f"DROP TABLE IF EXISTS {name}")
            layers.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet "
                f"PARTITIONED BY (batch_id) LOCATION '{path}'"
            )
        layers.spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
        if layers.spark.sql(f"SHOW PARTITIONS {name}").isEmpty():
            layers.spark.sql(f"DROP TABLE {name}")
            tables[table] = scan_raw(layers.spark, grain, raw_root)
        else:
            tables[table] = layers.table(table).select(*schema.names)
    return tables


def _shows(layers: Layers, table: str, path: str) -> bool:
    """Whether ``layer.table`` is there and lies in ``path``."""
    if not layers.exists(table):
        return False
    told = layers.spark.sql(f"DESCRIBE TABLE EXTENDED {layers.name(table)}").where("col_name = 'Location'").first()
    return told is not None and told.data_type.split(":", 1)[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/")


def legacy_rows(hourly: DataFrame) -> DataFrame:
    """Hourly rows in the fixed types of the older single table. Humidity and
    cloud cover become whole numbers, halves going to the even one."""
    whole = {c: F.rint(F.col(c)) for c in ("relative_humidity_2m", "cloud_cover")}
    return conform(hourly.withColumns(whole), LEGACY)


def create_legacy_table(layers: Layers) -> DataFrame:
    """``raw.weather`` with declared types, empty unless it exists."""
    table = "raw.weather"
    if not layers.exists(table):
        path = layers.path(table)
        layers.spark.createDataFrame([], LEGACY).write.parquet(path)
        _point_at(layers, table, path, LEGACY)
    return layers.table(table)


def append_legacy(layers: Layers, hourly: DataFrame) -> DataFrame:
    create_legacy_table(layers)
    legacy_rows(hourly).write.insertInto(layers.name("raw.weather"))
    return layers.table("raw.weather")
