"""Time series: scans, per-point limits, shapes, casts, and last-write-wins storage in hash buckets."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import local_name, parsed_time, stream_handle, strict_number

SCHEMA = T.StructType().add("point_uri", "string").add("ts", "timestamp").add("value", "string")
EMPTY = T.StructType().add("time", "timestamp").add("value", "string").add("id", "string")


def moment(value) -> datetime | None:
    """A bound: ISO text or datetime, naive meaning UTC; empty means none."""
    if not value:
        return None
    at = datetime.fromisoformat(value.replace("Z", "+00:00")) if isinstance(value, str) else value
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at


def ranged(series: DataFrame, start=None, end=None) -> DataFrame:
    """Both bounds inclusive. The comparison reaches the scan."""
    for bound, keep in ((start, lambda c, x: c >= x), (end, lambda c, x: c <= x)):
        at = moment(bound)
        if at is not None:
            series = series.where(keep(F.col("ts"), F.lit(at)))
    return series


def limited(series: DataFrame, limit: int | None, order: str = "asc", key: str = "point_uri") -> DataFrame:
    """The first ``limit`` rows of every point by time (0 or None: all)."""
    if not limit:
        return series
    by = Window.partitionBy(key).orderBy(F.col("ts").desc() if order == "desc" else F.col("ts").asc())
    return series.withColumn("_place", F.row_number().over(by)).where(F.col("_place") <= limit).drop("_place")


def cast_values(rows: DataFrame, kind: str | None, value: str = "value") -> DataFrame:
    """Numbers if every non-null value is one, else the text unchanged. One pass decides."""
    to = {"float": "double", "int": "bigint"}.get(kind or "str")
    if to is None:
        return rows
    number = strict_number(F.col(value), to)
    bad = rows.agg(F.count_if(F.col(value).isNotNull() & number.isNull())).first()[0]
    return rows if bad else rows.withColumn(value, number)


def wide_names(uris: list[str]) -> dict[str, str]:
    """Local names, or the whole URI where two points share one."""
    short = {u: (u.split("#")[1] if u.count("#") == 1 else u.split("/")[-1]) for u in uris}
    often = [n for n in short.values() if list(short.values()).count(n) > 1]
    return {u: u if n in often else n for u, n in short.items()}


def wide(rows: DataFrame, uris: list[str]) -> DataFrame:
    """One row for each time and one column for each point, with the columns known beforehand."""
    names = wide_names(uris)
    out = rows.groupBy(F.col("ts").alias("time")).pivot("point_uri", uris).agg(F.min("value")) if uris else rows.select(F.col("ts").alias("time")).distinct()
    return out.select("time", *[F.col(f"`{u}`").alias(names[u]) for u in uris]).orderBy("time")


def last_write_wins(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Of rows with the same point and time, the one that came last. Combines on the map side."""
    return rows.groupBy("point_uri", "ts").agg(F.max_by("value", order).alias("value"))


def info(series: DataFrame, point: str) -> DataFrame:
    return series.where(F.col("point_uri") == point).agg(F.count("*").alias("row_count"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))


def latest(series: DataFrame) -> DataFrame:
    return series.groupBy("point_uri").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


def handles(uris: DataFrame) -> DataFrame:
    return uris.select(stream_handle(F.col("uri")).alias("handle"), "uri").distinct()


class SeriesStore:
    """Samples below ``path``, in buckets by a hash of the point, or in memory of the session without one.

    A write merges into the buckets it touches and no others: they are rewritten through dynamic partition overwrite.
    There is one writer at a time. Buckets that lose their last row are rewritten as empty by removing their folder.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self._frame = spark.createDataFrame([], SCHEMA)
        self.streams: dict[str, str] = {}

    def _bucket(self):
        return F.pmod(F.xxhash64("point_uri"), F.lit(self.buckets)).cast("int")

    def frame(self) -> DataFrame:
        if not self.path:
            return self._frame
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path).select(*SCHEMA.names)
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def scan(self, point: str, start=None, end=None, limit: int | None = None, order: str = "asc") -> DataFrame:
        rows = ranged(self.frame().where(F.col("point_uri") == self.resolve(point)), start, end).orderBy(F.col("ts").desc() if order == "desc" else F.col("ts"))
        return rows.limit(limit) if limit else rows

    def merge(self, new: DataFrame, replace: bool = False) -> int:
        """Upsert ``point_uri, ts, value`` (and ``seq``, a later row winning); ``replace`` drops the points' old rows first."""
        if "seq" not in new.columns:
            new = new.withColumn("seq", F.monotonically_increasing_id())
        new = new.select("point_uri", "ts", F.col("value").cast("string").alias("value"), "seq").cache()
        n = new.count()
        old = self.frame()
        if self.path:
            touched = [r.b for r in new.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as there are buckets
            old = old.where(self._bucket().isin(touched)) if touched else old.limit(0)
        if replace:
            old = old.join(new.select("point_uri").distinct(), "point_uri", "left_anti")
        merged = last_write_wins(old.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(new))
        if self.path:
            merged.withColumn("bucket", self._bucket()).repartition("bucket").sortWithinPartitions("point_uri", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        else:
            self._frame = merged
        new.unpersist()
        return n

    def upsert(self, point: str, rows) -> int:
        return self.merge(self._rows(point, rows))

    def replace(self, point: str, rows) -> int:
        self.delete(point)
        return self.upsert(point, rows) if rows else 0

    def delete(self, point: str) -> None:
        if not self.path:
            self._frame = self._frame.where(F.col("point_uri") != point)
            return
        b = self.spark.range(1).select(F.lit(point).alias("point_uri")).select(self._bucket()).first()[0]
        left = self.frame().where((self._bucket() == b) & (F.col("point_uri") != point)).withColumn("bucket", F.lit(b))
        if left.isEmpty():
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        else:
            left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def _rows(self, point: str, rows) -> DataFrame:
        data = [(point, moment(t), None if v is None else str(v), i) for i, (t, v) in enumerate(rows)]
        return self.spark.createDataFrame(data, T.StructType([*SCHEMA.fields[:3], T.StructField("seq", T.LongType())]))

    def ensure_handle(self, uri: str, handle: str | None = None) -> str:
        import hashlib

        self.streams[uri] = handle or self.streams.get(uri) or hashlib.sha1(uri.encode()).hexdigest()[:10]
        return self.streams[uri]

    def resolve(self, handle: str) -> str:
        return next((u for u, h in self.streams.items() if h == handle), handle)



__all__ = ["EMPTY", "SCHEMA", "SeriesStore", "cast_values", "handles", "info", "last_write_wins", "latest", "limited", "local_name", "moment", "parsed_time", "ranged", "wide"]
