"""Versioned point tables: every change is a commit, and every commit stays readable.

A table is a folder of parquet datasets that are only ever appended to:

    data/    points, under added_by=<commit>/<partition columns>
    files/   one row per data file that a commit added or removed
    events/  one row per commit, rollback or expiry

What a snapshot shows is found in the two small datasets, by joins over `files`. The
points are then one plain parquet scan of the surviving folders: no join or tombstone
touches them, and filters and column pruning reach the files.

Delete and overwrite replace files (copy on write). A commit writes points, then files,
then its one event, and its key is new on every attempt: an attempt that stops half-way
leaves nothing that a reader would see. One writer at a time.
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudmill.operators.clustering import cluster_zorder
from cloudmill.session import path_exists, scratch_path
from cloudmill.sources.delimited import write_csv

Moment = datetime | int | str

_ADDED_BY = "added_by"
_FILE = "__pt_file"
_PATH = "_metadata.file_path"
# Partitions that a task has files open for at once; rows of further ones are sorted by partition.
_OPEN_FILES = 8

_EVENT = T.StructType(
    [
        T.StructField("sequence", T.LongType()),
        T.StructField("event", T.StringType()),  # commit, rollback or expire
        T.StructField("at", T.TimestampType()),
        T.StructField("snapshot_id", T.LongType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("operation", T.StringType()),
        T.StructField("summary", T.MapType(T.StringType(), T.StringType())),
        T.StructField("commit_key", T.StringType()),
    ]
)
_SCHEMA = T.StructType(
    [
        T.StructField("schema", T.StringType()),
        T.StructField("partition_by", T.ArrayType(T.StringType())),
        T.StructField("zorder_bits", T.IntegerType()),
    ]
)


class PointTable:
    """A versioned table at `path`; see the module text for the layout."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        definition = self._log("definition", _SCHEMA).first()
        if definition is None:
            raise ValueError(f"no point table at {self.path}")
        self.schema = T.StructType.fromDDL(definition["schema"])
        self.partition_by = list(definition["partition_by"])
        self.zorder_bits = definition["zorder_bits"]

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        *,
        partition_by=(),
        zorder_bits: int | None = None,
    ) -> "PointTable":
        """Create an empty table. With `zorder_bits`, files are written in z-order."""
        missing = [c for c in partition_by if c not in schema.names]
        if missing:
            raise ValueError(f"partition columns {missing} are not in the schema")
        # Partition columns live in folder names and so come last when read.
        fields = [f for f in schema if f.name not in partition_by]
        fields += [schema[c] for c in partition_by]
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        row = (ddl, list(partition_by), zorder_bits)
        spark.createDataFrame([row], _SCHEMA).coalesce(1).write.mode("errorifexists").parquet(
            f"{path.rstrip('/')}/definition"
        )
        return cls(spark, path)

    @classmethod
    def create_named(
        cls,
        spark: SparkSession,
        name: str,
        schema: T.StructType,
        *,
        location: str | None = None,
        partition_by=(),
        zorder_bits: int | None = None,
    ) -> "PointTable":
        """Create an empty table that the session catalog knows by `name`.

        Without a `location`, it lies in the warehouse. The catalog's entry is the table's
        definition; its description says where the table is.
        """
        if spark.catalog.tableExists(name):
            raise ValueError(f"{name} is in the catalog already")
        if location is None:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            location = f"{warehouse}/{name.replace('.', '/')}.points"
        table = cls.create(spark, location, schema, partition_by=partition_by, zorder_bits=zorder_bits)
        spark.catalog.createTable(
            name, path=f"{table.path}/definition", source="parquet", schema=_SCHEMA, description=table.path
        )
        return table

    @classmethod
    def named(cls, spark: SparkSession, name: str) -> "PointTable":
        """The table that the session catalog knows by `name`."""
        if not spark.catalog.tableExists(name):
            raise ValueError(f"no table {name} in the catalog")
        return cls(spark, spark.catalog.getTable(name).description)

    # ---- reading

    def read(self, snapshot_id: int | None = None, *, as_of: Moment | None = None) -> DataFrame:
        """Points of the current snapshot, of `snapshot_id`, or of the one current at `as_of`.

        Times are datetimes, epoch milliseconds (also as text) or timestamps as text; without
        a zone they are in the session's time zone.
        """
        if snapshot_id is not None and as_of is not None:
            raise ValueError("give a snapshot or a time, not both")
        timeline = self._timeline()
        if as_of is not None:
            snapshot_id = timeline.current_at(self._micros(as_of))
        elif snapshot_id is None:
            snapshot_id = timeline.current
        if snapshot_id is None:
            return self.spark.createDataFrame([], self.schema)
        timeline.require_readable(snapshot_id)
        return self._scan(self._live_files(timeline, snapshot_id))

    def read_appends(self, start: int, end: int | None = None) -> DataFrame:
        """Points added by append commits after snapshot `start`, up to and with `end`."""
        timeline = self._timeline()
        end = timeline.current if end is None else end
        timeline.require_readable(start)
        timeline.require_readable(end)
        line = timeline.line(end)
        if start not in line:
            raise ValueError(f"snapshot {start} is not an ancestor of snapshot {end}")
        fresh = line[: line.index(start)]
        appends = [s for s in fresh if timeline.commits[s].operation == "append"]
        return self._scan(self._files(timeline, appends).filter(F.col("change") == "add"))

    def partitions(self) -> DataFrame:
        """Record and file counts per partition of the current snapshot, from the file log."""
        counts = [
            F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"),
            F.count("*").alias("file_count"),
        ]
        timeline = self._timeline()
        live = self._live_files(timeline, timeline.current)
        if not self.partition_by:
            return live.agg(*counts)
        return (
            live.groupBy(F.struct(*self.partition_by).alias("partition"))
            .agg(*counts)
            .withColumn("spec_id", F.lit(0))
        )

    def history(self) -> DataFrame:
        """Every move of the current-snapshot pointer, oldest first."""
        timeline = self._timeline()
        return (
            self._events()
            .filter(F.col("event") != "expire")
            .orderBy("sequence")
            .select(
                F.col("at").alias("made_current_at"),
                "snapshot_id",
                "parent_id",
                F.col("snapshot_id").isin(timeline.line(timeline.current)).alias(
                    "is_current_ancestor"
                ),
            )
        )

    def snapshots(self) -> DataFrame:
        """Snapshots that can still be read, oldest first."""
        events = self._events()
        expired = events.filter(F.col("event") == "expire").select("snapshot_id")
        return (
            events.filter(F.col("event") == "commit")
            .join(expired, "snapshot_id", "left_anti")
            .orderBy("sequence")
            .select(
                F.col("at").alias("committed_at"),
                "snapshot_id",
                "parent_id",
                "operation",
                F.concat(F.lit(f"{self.path}/files/commit_key="), "commit_key").alias("manifest_list"),
                "summary",
            )
        )

    def current_snapshot(self) -> int | None:
        return self._timeline().current

    def snapshot_at(self, when: Moment) -> int:
        """The snapshot that was current at `when`."""
        return self._timeline().current_at(self._micros(when))

    # ---- changing

    def append(
        self,
        df: DataFrame,
        *,
        zorder_bits: int | None = None,
        gather: bool = True,
        at: datetime | None = None,
    ) -> int:
        """Add rows; returns the new snapshot. `zorder_bits` overrides the table's own.

        Rows are shuffled so that a partition gets few files. Without `gather` each task writes
        the rows that it holds: right for rows of few partitions.
        """
        key = self._new_key()
        return self._commit(key, "append", self._write(df, key, zorder_bits, gather), at)

    def overwrite_partitions(
        self,
        df: DataFrame,
        *,
        zorder_bits: int | None = None,
        gather: bool = True,
        at: datetime | None = None,
    ) -> int:
        """Replace the partitions that occur in `df`; without partitioning, all rows.

        `zorder_bits` and `gather` are as for `append`.
        """
        key = self._new_key()
        added = self._write(df, key, zorder_bits, gather)
        timeline = self._timeline()
        live = self._live_files(timeline, timeline.current)
        if self.partition_by:
            touched = added.select(*self.partition_by).distinct()
            same = reduce(
                lambda a, b: a & b, (live[c].eqNullSafe(touched[c]) for c in self.partition_by)
            )
            live = live.join(touched, same, "left_semi")
        elif added.isEmpty():
            return self._commit(key, "overwrite", added, at)
        return self._commit(key, "overwrite", self._log_files(key, live, "remove"), at)

    def delete_where(self, condition: Column | str, *, at: datetime | None = None) -> int:
        """Delete the rows for which `condition` is true.

        Only files that hold such rows are touched, and those that hold nothing else
        are dropped without being rewritten.
        """
        condition = F.expr(condition) if isinstance(condition, str) else condition
        hit = F.coalesce(condition.cast("boolean"), F.lit(False))
        key = self._new_key()
        timeline = self._timeline()
        live = self._live_files(timeline, timeline.current)
        hits = (
            self._scan(live, with_file=True)
            .filter(hit)
            .groupBy(_FILE)
            .agg(F.count("*").alias("hits"))
            .select(_relative(F.col(_FILE)).alias("file"), "hits")
        )
        # Written once: the rewrite and the log must agree on the files.
        staged = scratch_path(self.spark, "delete")
        live.join(hits, "file").write.parquet(staged)
        touched = self.spark.read.parquet(staged)
        self._log_files(key, touched, "remove")
        mixed = touched.filter(F.col("hits") < F.col("record_count"))
        # A task reads files or parts of them, so that it writes no more files than it reads.
        log = self._write(self._scan(mixed).filter(~hit), key, gather=False)
        return self._commit(key, "delete", log, at)

    def rollback_to(self, snapshot_id: int, *, at: datetime | None = None) -> None:
        """Make an earlier ancestor current again. No data changes."""
        timeline = self._timeline()
        timeline.require_readable(snapshot_id)
        if snapshot_id not in timeline.line(timeline.current):
            raise ValueError(f"snapshot {snapshot_id} is not an ancestor of the current one")
        parent = timeline.commits[snapshot_id].parent_id
        self._add_events(timeline, "rollback", at, [(snapshot_id, parent, None, None, None)])

    def rollback_to_time(self, when: Moment, *, at: datetime | None = None) -> None:
        """Roll back to the latest ancestor committed before `when`."""
        timeline = self._timeline()
        moment = self._micros(when)
        for snapshot in timeline.line(timeline.current):
            if timeline.commits[snapshot].at < moment:
                return self.rollback_to(snapshot, at=at)
        raise ValueError(f"no ancestor of the current snapshot was committed before {when}")

    def expire_snapshots(
        self, older_than: Moment, *, at: datetime | None = None, delete_files: bool = False
    ) -> list[int]:
        """Expire snapshots committed before `older_than`, except the current one.

        `delete_files` also removes the data files no readable snapshot shows.
        """
        timeline = self._timeline()
        moment = self._micros(older_than)
        doomed = [
            s
            for s in timeline.readable
            if timeline.commits[s].at < moment and s != timeline.current
        ]
        if doomed:
            self._add_events(timeline, "expire", at, [(s, None, None, None, None) for s in doomed])
        if delete_files:
            self._delete_unreachable()
        return doomed

    def unreachable_files(self) -> DataFrame:
        """Data files that no readable snapshot shows."""
        timeline = self._timeline()
        added = self._files(timeline, list(timeline.commits)).filter(F.col("change") == "add")
        shown = [self._live_files(timeline, s).select("file") for s in timeline.readable]
        if not shown:
            return added
        return added.join(reduce(DataFrame.union, shown), "file", "left_anti")

    def export_insights(self, folder: str, *, single_file: bool = True) -> None:
        """Write history, snapshots and partitions as CSV below `folder`."""
        write_csv(self.history(), f"{folder}/history", single_file=single_file)
        write_csv(
            self.snapshots().select("committed_at", "snapshot_id", "parent_id", "operation"),
            f"{folder}/snapshots",
            single_file=single_file,
        )
        partitions = self.partitions()
        if self.partition_by:
            partitions = partitions.select("partition.*", "record_count", "file_count", "spec_id")
        write_csv(partitions, f"{folder}/partitions", single_file=single_file)

    # ---- files

    def _scan(self, files: DataFrame, *, with_file: bool = False) -> DataFrame:
        """Parquet scan of exactly these data files.

        A folder all of whose files are wanted is given as a folder, so that the scan
        names few paths; only paths, never points, pass through the driver.
        """
        logged = self._log("files", self._file_schema()).filter(F.col("change") == "add")
        in_folder = logged.groupBy("folder").agg(F.count("*").alias("in_folder"))
        wanted = files.groupBy("folder").agg(F.count("*").alias("wanted"))
        folders = wanted.join(in_folder, "folder")
        whole = folders.filter(F.col("wanted") == F.col("in_folder"))
        partial = folders.filter(F.col("wanted") < F.col("in_folder"))
        chosen = whole.select(F.col("folder").alias("path")).union(
            files.join(partial, "folder", "left_semi").select("file")
        )
        root = f"{self.path}/data"
        paths = [f"{root}/{r['path']}" for r in chosen.collect()]
        if not paths:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumn(_FILE, F.lit("")) if with_file else empty
        points = self.spark.read.schema(self.schema).option("basePath", root).parquet(*sorted(paths))
        columns = [F.col(f"`{c}`") for c in self.schema.names]
        if with_file:
            columns.append(F.col(_PATH).alias(_FILE))
        return points.select(*columns)

    def _arranged(self, df: DataFrame, zorder_bits: int | None, gather: bool) -> DataFrame:
        """The rows of `df` as they are to be written."""
        names = self.schema.names
        if set(df.columns) != set(names):
            raise ValueError(f"columns {df.columns} do not match the table's {names}")
        rows = df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema])
        bits = zorder_bits or self.zorder_bits
        if bits:
            # Read three times (extent, bounds, rows): whatever `df` takes is done once.
            staged = scratch_path(self.spark, "zorder")
            rows.write.parquet(staged)
            copy = self.spark.read.schema(rows.schema).parquet(staged)
            return cluster_zorder(copy, bits, within=self.partition_by, in_files=True)
        if self.partition_by and gather:
            # Few files per partition; adaptive execution splits the partitions that are big.
            return rows.hint("rebalance", *self.partition_by)
        return rows

    def _write(
        self, df: DataFrame, key: str, zorder_bits: int | None = None, gather: bool = True
    ) -> DataFrame:
        """Write `df` as data of commit `key` and log its files; returns the log rows."""
        rows = self._arranged(df, zorder_bits, gather)
        writer = rows.write.mode("errorifexists")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        folder = f"{self.path}/data/{_ADDED_BY}={key}"
        with _open_files(self.spark, 0 if gather or zorder_bits or self.zorder_bits else _OPEN_FILES):
            writer.parquet(folder)
        written = self.spark.read.schema(self.schema).option("basePath", folder).parquet(folder)
        # Counting reads no column but the partition's: row counts come from file footers.
        added = (
            written.select(*self.partition_by, F.col(_PATH).alias("file"))
            .groupBy(*self.partition_by, "file")
            .agg(F.count("*").alias("record_count"))
            .withColumn("file", _relative(F.col("file")))
            .select(
                "file",
                F.regexp_replace("file", "/[^/]*$", "").alias("folder"),
                "record_count",
                *self.partition_by,
            )
        )
        return self._log_files(key, added, "add")

    def _log_files(self, key: str, rows: DataFrame, change: str) -> DataFrame:
        """Add rows to the file log of commit `key`; returns all its rows."""
        schema = T.StructType(self._file_schema().fields[:-1])
        target = f"{self.path}/files/commit_key={key}"
        rows.withColumn("change", F.lit(change)).select(*schema.names).write.mode(
            "append"
        ).parquet(target)
        return self.spark.read.schema(schema).parquet(target)

    def _live_files(self, timeline: "_Timeline", snapshot_id: int | None) -> DataFrame:
        log = self._files(timeline, timeline.line(snapshot_id))
        removed = log.filter(F.col("change") == "remove").select("file")
        return log.filter(F.col("change") == "add").join(removed, "file", "left_anti")

    def _files(self, timeline: "_Timeline", snapshots: list[int]) -> DataFrame:
        keys = [timeline.commits[s].commit_key for s in snapshots]
        return self._log("files", self._file_schema()).filter(F.col("commit_key").isin(keys))

    def _file_schema(self) -> T.StructType:
        fields = [
            T.StructField("change", T.StringType()),
            T.StructField("file", T.StringType()),
            T.StructField("folder", T.StringType()),
            T.StructField("record_count", T.LongType()),
        ]
        fields += [self.schema[c] for c in self.partition_by]
        return T.StructType([*fields, T.StructField("commit_key", T.StringType())])

    def _delete_unreachable(self) -> None:
        paths = [r["file"] for r in self.unreachable_files().select("file").collect()]
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for relative in paths:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{relative}")
            path.getFileSystem(conf).delete(path, False)

    # ---- events

    def _commit(self, key: str, operation: str, files: DataFrame, at: datetime | None) -> int:
        counts = {
            r["change"]: r
            for r in files.groupBy("change")
            .agg(F.count("*").alias("files"), F.sum("record_count").alias("records"))
            .collect()
        }
        summary = {}
        for change, word in (("add", "added"), ("remove", "deleted")):
            found = counts.get(change)
            summary[f"{word}-data-files"] = str(found["files"] if found else 0)
            summary[f"{word}-records"] = str(found["records"] if found else 0)
        timeline = self._timeline()
        snapshot_id = max(timeline.commits, default=0) + 1
        row = (snapshot_id, timeline.current, operation, summary, key)
        self._add_events(timeline, "commit", at, [row])
        return snapshot_id

    def _add_events(self, timeline: "_Timeline", event: str, at, rows: list[tuple]) -> None:
        at = at or datetime.now(timezone.utc)
        events = [
            F.struct(
                *[
                    _literal(v).cast(f.dataType).alias(f.name)
                    for v, f in zip((timeline.length + i, event, at, *row), _EVENT)
                ]
            )
            for i, row in enumerate(rows)
        ]
        self.spark.range(0, 1, 1, 1).select(F.inline(F.array(*events))).write.mode(
            "append"
        ).parquet(f"{self.path}/events")

    def _events(self) -> DataFrame:
        return self._log("events", _EVENT)

    def _timeline(self) -> "_Timeline":
        events = self._events().drop("summary").withColumn("at", F.unix_micros("at"))
        return _Timeline(events.collect())

    def _micros(self, when: Moment) -> int:
        """Microseconds since the epoch; times without a zone are in the session's zone."""
        if isinstance(when, int) or isinstance(when, str) and when.isdigit():
            return int(when) * 1000
        if isinstance(when, datetime):
            if when.tzinfo:
                return (when - datetime.fromtimestamp(0, timezone.utc)) // timedelta(microseconds=1)
            when = when.isoformat()
        micros = self.spark.range(1).select(F.unix_micros(F.lit(when).try_cast("timestamp"))).first()[0]
        if micros is None:
            raise ValueError(f"not a time: {when}")
        return micros

    def _log(self, name: str, schema: T.StructType) -> DataFrame:
        path = f"{self.path}/{name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    @staticmethod
    def _new_key() -> str:
        return uuid.uuid4().hex


class _Timeline:
    """The events of a table: one small row per commit, rollback or expiry."""

    def __init__(self, events: list[Row]):
        events = sorted(events, key=lambda e: e.sequence)
        self.length = len(events)
        self.commits = {e.snapshot_id: e for e in events if e.event == "commit"}
        self.moves = [e for e in events if e.event != "expire"]
        expired = {e.snapshot_id for e in events if e.event == "expire"}
        self.readable = [s for s in self.commits if s not in expired]
        self.current = self.moves[-1].snapshot_id if self.moves else None

    def current_at(self, moment: int) -> int:
        past = [e.snapshot_id for e in self.moves if e.at <= moment]
        if not past:
            raise ValueError(f"the table had no snapshot at {moment} microseconds after the epoch")
        return past[-1]

    def line(self, snapshot_id: int | None) -> list[int]:
        """The snapshot and all it builds on, newest first."""
        line = []
        while snapshot_id is not None:
            line.append(snapshot_id)
            snapshot_id = self.commits[snapshot_id].parent_id
        return line

    def require_readable(self, snapshot_id: int) -> None:
        if snapshot_id not in self.readable:
            raise ValueError(f"snapshot {snapshot_id} does not exist or has expired")


@contextmanager
def _open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Writes inside keep up to `most` partitions' files open in a task (0: one at a time).

    Spark sorts the rows of a task by partition for one file at a time, and spills them where
    they are many. What the session has set for itself stays.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    if not most or spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name)


def _literal(value) -> Column:
    if isinstance(value, dict):
        return F.create_map(*[F.lit(v) for pair in value.items() for v in pair])
    return F.lit(value)


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of the tables in the session catalog."""
    return spark.sql("SHOW TABLES").select("tableName")


def drop_table(spark: SparkSession, name: str) -> None:
    """Take a named table out of the session catalog, if it is there; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def _relative(path: Column) -> Column:
    """A file's path below data/. The metadata column gives it percent-encoded."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.concat(F.lit(f"{_ADDED_BY}="), F.substring_index(decoded, f"/{_ADDED_BY}=", -1))
