"""Shared helpers: ASCII lower-casing, row keys, range buckets, scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWEST = -(2 ** 63)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.  Pure ASCII strings take the fast ``lower``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128-bit key of (doc_id, text); only rows equal in both share it."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"),
                                  F.coalesce(F.col(text), F.lit("")))))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(n))


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, partition_by: str | None = None, release: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the
    lineage, and a lost executor costs one task, not the table.  ``release``: the
    shuffle files of the write go as soon as it is over, as nothing reads them again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write.option("compression", "zstd")
    before = spark.conf.get(RELEASE, "false")
    try:
        if release:
            spark.conf.set(RELEASE, "true")
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    finally:
        if release:
            spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place ``idx`` (from 0) in the order of their ``group`` and the group's ``total``.

    A range-partitioned sort by group and order; rows are numbered inside their partition and moved on by the counts
    of the partitions before, so a large group is many tasks.  Fully equal rows are told apart by a hash of their number."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = written(rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())), f"{name}-rows", release=True)
    keys = [F.col(group), *order, F.col("_tie")]
    laid = written(base.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie").withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}),
        f"{name}-sorted", release=True)
    spans = laid.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    spans = written(spans.select(
        group, "_part", (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_move"),
        F.sum("_n").over(whole).alias("total")), f"{name}-spans")
    return laid.join(spans, [group, "_part"]).withColumn("idx", F.col("_at") + F.col("_move")).drop("_part", "_at", "_move")


def drop_written(df: DataFrame, part: str = "") -> None:
    """Delete the folders of a table of ``written`` that no later step reads; ``part``: only those whose path holds it."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles() if part in f}):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)


def range_starts(df: DataFrame, col: str, buckets: int) -> list[int]:
    """Start values of at most ``buckets`` ranges of near-equal row counts.

    Each start is a value of the column and the first is its minimum, so the
    first row of a range is the row that holds its start.  The list is as long
    as the number of ranges, never as the data.  Nulls count as the least long."""
    v = F.coalesce(F.col(col).cast("long"), F.lit(LOWEST))
    cuts = [k / buckets for k in range(1, buckets)] or [0.5]
    row = df.select(v.alias("v")).agg(F.min("v").alias("lo"),
                                      F.percentile_approx("v", cuts, 20 * buckets).alias("q")).first()
    if row is None or row["lo"] is None:
        return []
    return sorted({row["lo"], *row["q"]})


def range_bucket(col: str, starts: list[int]) -> Column:
    """Index of the last start not above the value: a binary search in a literal array."""
    v = F.coalesce(F.col(col).cast("long"), F.lit(LOWEST))
    n = len(starts)
    if n < 2:
        return F.lit(0)
    arr = F.array(*[F.lit(int(s)) for s in starts])
    steps, k = [], 1 << (n.bit_length() - 1)
    while k:
        steps.append(k)
        k >>= 1
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, s: F.when((at + s < n) & (F.get(arr, at + s) <= v), at + s).otherwise(at))


def repeated(df: DataFrame, copies: str, name: str, step: int = 4096) -> DataFrame:
    """Each row as often as ``copies`` says, numbered from 1 in ``name``; no array is longer than
    ``step`` or copies / step."""
    n = F.col(copies).cast("long")
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / step).cast("long"))))
    first = F.col("_block") * step
    return blocks.withColumn(name, F.explode(F.sequence(first + 1, F.least(n, first + step)))).drop("_block")


def hash_share(h: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return F.shiftrightunsigned(h, 11) / float(2 ** 53)


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct ``row``, so that no name of theirs meets one of ours; ``select("row.*")`` undoes it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def keep_by_key(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``row_key`` stands in ``kept``; of fully equal (doc_id, text) rows one stays.
    All columns of ``docs`` come back unchanged, whatever their names."""
    some = (docs.select(row_key().alias("row_key"), whole_row(docs))
            .join(kept.select("row_key").distinct(), "row_key", "left_semi"))
    first = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    return some.select("row", first.alias("n")).where("n = 1").select("row.*")
