"""Readers, writers and the keyed upsert over partitioned Parquet.

``TableStore`` maps table names to paths under one root, so that every job uses the same names.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff import schema
from tipoff.functions.exprs import file_date, landed_name, season_label, season_range
from tipoff.operators.games import keep_newest
from tipoff.scratch import discard, stage

# landed text is a fifth as large packed; the fastest level costs little beside the writing of the text
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


# ---- bronze: delimited text ---------------------------------------------------
def read_bronze(
    spark: SparkSession, root: str, columns: T.StructType = schema.BRONZE_GAMES, ingest_date: str | None = None
) -> DataFrame:
    """CSV with header under ``ingest_date=`` directories. The schema is given, never inferred, so ids
    keep their leading zeros; a single day reads only its directory."""
    with_partition = T.StructType([*columns.fields, T.StructField("ingest_date", T.StringType())])
    rows = spark.read.schema(with_partition).option("header", True).option("enforceSchema", False).csv(root)
    return rows if ingest_date is None else rows.where(F.col("ingest_date") == ingest_date)


def read_season_files(spark: SparkSession, paths: Sequence[str], columns: T.StructType) -> DataFrame:
    """Several season files as one frame."""
    return spark.read.schema(columns).option("header", True).csv(list(paths))


def read_delimited(
    spark: SparkSession,
    path: str,
    columns: T.StructType,
    sep: str = ",",
    quote: str = '"',
    header: bool = True,
    recurse: bool = True,
) -> DataFrame:
    return (
        spark.read.schema(columns)
        .options(sep=sep, quote=quote, header=header, recursiveFileLookup=recurse)
        .csv(path)
    )


def land_bronze(df: DataFrame, root: str, ingest_date: str | None = None) -> None:
    """Write rows as CSV by ingest day; landing the same day again replaces it.

    The day is ``ingest_date``, or the column of that name for a load of many days. One day is one folder, so its rows are
    written where they are. Files are packed with gzip.
    """
    dated = _by_partition(df, "ingest_date") if ingest_date is None else df.withColumn("ingest_date", F.lit(ingest_date))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**PACKED).option("header", True).partitionBy(
        "ingest_date"
    ).csv(root)


def backfill(rows: DataFrame, root: str, first: int, last: int) -> list[str]:
    """Write the rows (games, or team or player rows with a ``season``) of the seasons that start in ``first`` to
    ``last`` as one CSV folder per season.

    One job for all seasons and season types; games have their season from the game date. Returns the folders.
    """
    season = season_label(F.col("GAME_DATE")) if "GAME_DATE" in rows.columns else F.col("season")
    labelled = rows.withColumn("season_file", season).where(
        F.array_contains(season_range(first, last), F.col("season_file"))
    )
    # only the folders of these seasons are replaced
    _by_partition(labelled, "season_file").write.mode("overwrite").options(**PACKED).option("header", True).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("season_file").csv(root)
    written = labelled.select("season_file").distinct().collect()
    return [f"{root}/season_file={row[0]}" for row in written]


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def ingest_high_water_mark(files: DataFrame, today: str, name: str = "file_name") -> DataFrame:
    """Newest date in the file names and the next start date: mark + 1 day if before today, else today."""
    mark = files.agg(F.max(file_date(F.col(name))).alias("last_run"))
    now = F.lit(today).cast("date")
    start = F.when(F.col("last_run") < now, F.date_add("last_run", 1)).otherwise(now)
    return mark.withColumn("start_date", start)


def land_named(df: DataFrame, root: str, kind: str, day: str) -> None:
    """Write rows as CSV by season, each in a folder named as its file is: ``games_2025-26_2025_12_01.csv``.

    ``kind`` is games, teams or player_stats, the season comes from ``day`` unless the rows have one. Landing again replaces.
    """
    when = F.lit(day).cast("date")
    season = F.col("season") if "season" in df.columns else season_label(when)
    named = df.withColumn("_file", landed_name(F.lit(kind), season, when))
    _by_partition(named, "_file").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy(
        "_file"
    ).csv(root)


def landed_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_name, bytes, landed) of the CSV files below ``root``, from file metadata; contents are not read.

    What ``land_named`` wrote goes by its folder's name, any other file by its own.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
    folder = F.regexp_extract("path", "/_file=([^/]+)/[^/]+$", 1)
    name = F.when(folder != "", folder).otherwise(F.element_at(F.split("path", "/"), -1))
    return listing.groupBy(name.alias("file_name")).agg(F.sum("length").alias("bytes"), F.max("modificationTime").alias("landed"))


# ---- tables ---------------------------------------------------------------------
class TableStore:
    """Parquet tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _file(self, address: str):
        """(file system, path) of an address."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(address)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        files, path = self._file(self.path(name))
        return files.exists(path)

    def stored_schema(self, name: str) -> T.StructType | None:
        """The schema kept beside the table, or None if the table has none."""
        files, path = self._file(f"{self.root}/_schemas/{name}.json")
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return T.StructType.fromJson(json.loads(text))

    def _keep_schema(self, df: DataFrame, name: str, replace: bool = True) -> None:
        """Keep the table's schema in a small file: partition values are typed by it, not by how they look in a path."""
        files, path = self._file(f"{self.root}/_schemas/{name}.json")
        if replace or not files.exists(path):
            stream = files.create(path, True)
            try:
                stream.write(bytearray(df.schema.json(), "utf-8"))
            finally:
                stream.close()

    def require(self, name: str) -> None:
        if not self.exists(name):
            raise ValueError(f"table {name} does not exist; run the initial load first")

    def read(self, name: str) -> DataFrame:
        """The table with the types it was written with; a table without a stored schema is read as its files say."""
        kept = self.stored_schema(name)
        return (self.spark.read if kept is None else self.spark.read.schema(kept)).parquet(self.path(name))

    def write_partitioned(self, df: DataFrame, name: str, by: str = "SEASON", rebalance: bool = False) -> None:
        """Replace the whole table.

        ``rebalance`` shuffles rows to their partitions first, so that each gets few, even files. Leave it
        off where ``df`` already comes out of a shuffle by the partition column.
        """
        rows = _by_partition(df, by) if rebalance else df
        self._keep_schema(df, name)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(by).parquet(self.path(name))

    def write_full(self, df: DataFrame, name: str) -> None:
        self._keep_schema(df, name)
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self.path(name))

    def append_by_ingestion(self, df: DataFrame, name: str, by: str = "ingestion_date") -> None:
        self._keep_schema(df, name, replace=False)
        df.write.mode("append").option("compression", "snappy").partitionBy(by).parquet(self.path(name))

    def overwrite_partitions(self, df: DataFrame, name: str, by: str = "SEASON") -> None:
        """Replace only the partitions that ``df`` has rows for."""
        self._keep_schema(df, name, replace=False)
        _by_partition(df, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            by
        ).parquet(self.path(name))

    def register(self, name: str, table: str | None = None, partitioned: bool = True) -> str:
        """``CREATE TABLE IF NOT EXISTS`` over the files of ``name``."""
        table = table or name
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} USING parquet LOCATION '{self.path(name)}'")
        if partitioned:
            try:
                self.spark.sql(f"MSCK REPAIR TABLE {table}")
            except AnalysisException:
                self.spark.catalog.refreshTable(table)
        return table

    def merge_upsert(
        self,
        source: DataFrame,
        name: str,
        keys: Sequence[str] = tuple(schema.GAME_KEY),
        by: str = "SEASON",
        newest: Sequence[str] = (),
        unique: bool = False,
        version: str | None = None,
    ) -> DataFrame:
        """Matched rows are replaced, new rows inserted; keys match across partitions. Returns the matched old rows' keys and ``by``.

        Of several source rows with one key the newest wins; ``unique`` says there are none and saves that shuffle. With
        ``version``, a source row older than the row it matches is left out, so late deliveries never replace newer rows;
        of equal versions the source's stays. A null version is older than any.

        The search for matches reads the key columns of row groups in the source's range of keys. Only partitions that hold a
        matched row are rewritten; all other rows are appended, so a merge of new keys writes what it brings. The new content is
        staged first: a path is never overwritten while it is read. A partition that loses its last row is removed. One
        writer at a time; rerunning the same merge after a failure gives the intended table.
        """
        self.require(name)
        keys = list(keys)
        # a source that is staged is not copied; this merge removes what it staged itself
        kept_as_is = unique and getattr(source, "_staged_path", None) is not None
        incoming = own = source if kept_as_is else stage(source if unique else keep_newest(source, keys, newest), f"{name}-merge-source")
        target = self.read(name)
        span = incoming.agg(F.count(F.lit(1)), *[f(k) for k in keys for f in (F.min, F.max)]).first()
        in_range = [F.col(k).between(F.lit(span[2 * i + 1]), F.lit(span[2 * i + 2])) for i, k in enumerate(keys) if span[2 * i + 1] is not None]
        wanted = target.where(reduce(Column.__and__, in_range, F.lit(span[0] > 0)))
        incoming = incoming.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields])
        named = list(dict.fromkeys([*keys, by]))
        old = wanted.select(*named, *([F.col(version).alias("_old")] if version else []))
        if version:
            pairs = old.join(incoming.select(*keys, F.col(version).alias("_new")), keys)
            pairs = pairs.withColumn("_late", F.col("_old").isNotNull() & (F.col("_new").isNull() | (F.col("_new") < F.col("_old"))))
        else:
            pairs = old.join(incoming.select(*keys), keys, "left_semi").withColumn("_late", F.lit(False))
        matched = stage(pairs.select(*named, "_late"), f"{name}-matched")
        late, replaced = matched.where("_late"), matched.where("NOT _late").drop("_late")
        if version:
            incoming = incoming.join(late.select(*keys), keys, "left_anti").select(*target.columns)
        # partition values are few and bound the rewrite; as literals they prune directories at the scan
        values = [row[by] for row in replaced.select(by).distinct().collect()]
        if not values:
            if span[0]:
                self._append(incoming, name, by, moved=bool(version))
            if not kept_as_is:
                discard(own)
            return replaced
        inside = _in(by, values)
        kept = target.where(inside).join(incoming.select(*keys), keys, "left_anti")
        self._rewrite(kept.select(*target.columns).unionByName(incoming.where(inside)), name, by, values)
        others = incoming.where(~F.coalesce(inside, F.lit(False)))
        self._append(others, name, by, moved=bool(version))
        if not kept_as_is:
            discard(own)
        return replaced

    def _append(self, rows: DataFrame, name: str, by: str, moved: bool) -> None:
        """Add rows; those that come out of a shuffle (``moved``) are not moved again."""
        (rows if moved else _by_partition(rows, by)).write.mode("append").partitionBy(by).parquet(self.path(name))

    def delete_keys(self, gone: DataFrame, name: str, keys: Sequence[str], by: str = "SEASON") -> None:
        """Remove the rows with a key in ``gone``; only partitions that hold one are rewritten."""
        target, keys = self.read(name), list(keys)
        found = target.join(gone.select(*keys).distinct(), keys, "left_semi").select(by).distinct()
        values = [row[by] for row in found.collect()]
        if values:
            kept = target.where(_in(by, values)).join(gone.select(*keys), keys, "left_anti")
            self._rewrite(kept.select(*target.columns), name, by, values)

    def _rewrite(self, rows: DataFrame, name: str, by: str, values: list) -> None:
        """Put ``rows`` in the place of the partitions of ``values``; a partition without rows goes."""
        target = self.read(name)
        # where each partition lies, as its name in a path may be written otherwise than its value
        folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
        folders = dict(target.where(_in(by, values)).select(by, folder).distinct().collect())
        merged = stage(rows, f"{name}-merged")
        self.overwrite_partitions(merged, name, by)
        left = {row[by] for row in merged.select(by).distinct().collect()}
        discard(merged)
        for value in values:
            if value not in left and value in folders:
                self._drop_folder(folders[value])

    def _drop_folder(self, address: str) -> None:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(address))
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _in(column: str, values: list):
    known = [v for v in values if v is not None]
    test = F.col(column).isin(known)
    return test | F.col(column).isNull() if len(known) < len(values) else test & F.col(column).isNotNull()


def _by_partition(df: DataFrame, by: str) -> DataFrame:
    """Rows of a partition together, so that each writes few files; AQE splits a large one over several tasks."""
    return df.hint("rebalance", by)


def sql_scan(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """A SQL statement over frames given by name, e.g. ``sql_scan(spark, "SELECT * FROM {games}", games=df)``."""
    return spark.sql(statement, **tables)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a row count taken while it is written; ``observation.get`` after the write, no second pass."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation
