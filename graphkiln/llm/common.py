"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters other than these six ASCII white-space characters.
WHITE = r"[\x20\x09-\x0D]+"
#: Up to so many bytes, as measured by ``measured``, are broadcast; beyond it, the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Keys of more rows than this are joined apart from the others.
HOT = 10_000

_written: list[tuple[SparkSession, str]] = []


def words(text: Column) -> Column:
    """The words of a text in order; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filter_after(df: DataFrame, condition: Column) -> DataFrame:
    """``df`` filtered on columns that are computed once; a plain filter would be pushed below the projections and compute them again.

    A row number, which isn't deterministic, keeps the filter in place.
    """
    marked = df.withColumn("_mark", F.monotonically_increasing_id())
    return marked.filter((F.col("_mark") >= 0) & condition).drop("_mark")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    while name in df.columns:
        name = f"_{name}"
    return name


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``; a local one only where that is unset and all runs in one JVM."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="graphkiln-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    The files are removed by ``discard`` or ``tidy``, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` returned, once all that is made from it is written as well."""
    _written.remove((df.sparkSession, df._written_at))
    _delete(df.sparkSession, df._written_at)


def written() -> int:
    """A mark for ``tidy``: how many tables are written."""
    return len(_written)


def tidy(mark: int, *needed: DataFrame) -> None:
    """Remove the tables written since ``mark`` but for those ``needed`` still, which ``materialize`` returned."""
    keep = {df._written_at for df in needed}
    since, _written[mark:] = _written[mark:], [x for x in _written[mark:] if x[1] in keep]
    for spark, path in since:
        if path not in keep:
            _delete(spark, path)


def release() -> None:
    """Remove what ``materialize`` wrote."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # noqa: BLE001  the session may be over
            continue


def _width(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in memory."""
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.ArrayType, T.StructType, T.StringType, T.BinaryType)):
            inner = F.aggregate(value, F.lit(0).cast("long"), lambda s, x: s + _width(x, kind.elementType))
        else:
            inner = F.size(value).cast("long") * 8
        return F.lit(24).cast("long") + F.greatest(F.coalesce(inner, F.lit(0).cast("long")), F.lit(0).cast("long"))
    if isinstance(kind, T.StructType):
        return total([_width(value[f.name], f.dataType) for f in kind.fields])
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(16).cast("long") + F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    return F.lit(8).cast("long")


def measured(df: DataFrame) -> int:
    """About the bytes that ``df`` takes in memory."""
    row = total([_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]) + 16
    return df.agg(F.sum(row).alias("n")).first()["n"] or 0


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """``df`` hinted for broadcast if it is at most ``BROADCAST_BYTES`` big; it should be a written table, as it is read to be measured."""
    return F.broadcast(df) if measured(df) <= BROADCAST_BYTES else df


def attach(rows: DataFrame, table: DataFrame, key: str, count: str, name: str) -> DataFrame:
    """``rows`` left-joined on ``key`` with ``table`` (written, one row a key), whose column ``count`` says how many rows have the key.

    Keys of more than ``HOT`` rows are few, so their rows meet the table where they are; the join of the others has no large key.
    """
    hot = materialize(table.filter(F.col(count) > HOT), f"{name}-hot")
    if not hot.limit(1).count() or measured(hot) > BROADCAST_BYTES:
        return rows.join(table, key, "left")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` sorted by the columns ``order`` into partitions numbered ``_part``, written.

    Together the columns must be unique but for repeated rows, so that a group of any size is spread.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return materialize(df.repartitionByRange(parts, *[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()), name)


def running(df: DataFrame, order: list[str], sums: dict[str, Column], name: str, group: list[str] = ()) -> DataFrame:
    """``df`` plus, for each of ``sums``, its sum over the rows up to this one in ``order`` (within ``group``, the first of ``order``).

    Sums are made within the partitions of a range sort; only one row a partition and group at its ends is carried on.
    """
    group = list(group)
    rows = ranged(df.select("*", *[v.alias(n) for n, v in sums.items()]), order, name)
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_part", *group).agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    ends = ends.select("_part", *group, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    kept = [c for c in rows.columns if c not in sums and c != "_part"]
    out = rows.select("_part", *kept, *[F.sum(n).over(within).alias(n) for n in sums]).join(ends, ["_part", *group])
    return out.select(*kept, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def following(df: DataFrame, group: list[str], order: list[str], value: str, to: str, name: str, back: bool = False) -> DataFrame:
    """``df`` plus ``to``: the ``value`` of the next (``back``: previous) row of the ``group`` in ``order``; null at its end.

    Like ``running``, by a range sort with the partitions' ends carried on, so a group of any size is spread. The rows of
    ``group`` and ``order`` must be unique.
    """
    rows = ranged(df, [*group, *order], name)
    within = Window.partitionBy("_part", *group).orderBy(*order)
    pick = F.max_by if back else F.min_by
    ends = rows.groupBy("_part", *group).agg(pick(value, F.struct(*order)).alias("_end"))
    step = F.lag if back else F.lead
    ends = ends.withColumn("_end", step("_end").over(Window.partitionBy(*group).orderBy("_part")))
    out = rows.withColumn(to, step(value).over(within)).join(ends, ["_part", *group])
    return out.withColumn(to, F.coalesce(to, "_end")).drop("_part", "_end")
