"""Tables in the folder that the driver and all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata import storage

#: Rows of a few numbers each that every executor can hold.
BROADCAST_ROWS = 1_000_000
#: Keys with more than this part of all rows are dealt over salts; by counting, there are fewer such keys than this.
HOT_KEYS = 1000

#: Least and largest group in bytes of text; a group takes a worker about 16 times its size, so larger ones are made where executors have more memory for each core.
GROUP_BYTES = (2 << 20, 64 << 20)
GROUP_MEMORY = 16
GROUPS_GROW_FROM = 2 << 30
#: What a row counts beside its text, and what one task should read.
ROW_BYTES = 64
TASK_BYTES = 64 << 20
MOST_GROUPS = 1 << 30
BATCH_SETTING, DEFAULT_BATCH, TEXT_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"

_WRITTEN: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, which is remembered for ``release``."""
    path = storage.new_path(spark, label)
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends there, and lost executors don't lose it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def paths_since(mark: int) -> list[str]:
    """The paths made after the first ``mark`` ones; ``paths_since(0)`` has them all."""
    return _WRITTEN[mark:]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete these paths."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts: fewer of them to an Arrow batch than by default, unless the session has its own number."""
    if spark.conf.get(BATCH_SETTING) == DEFAULT_BATCH:
        spark.conf.set(BATCH_SETTING, TEXT_BATCH)


def small_or_plain(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has ``rows`` narrow rows at most, by a count; beyond that the plain table, which joins by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_bytes(docs: DataFrame) -> int:
    """Bytes of the texts, and ``ROW_BYTES`` a row: counted, as neither stored sizes nor the optimizer's estimates tell how much there is to hold."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return ROW_BYTES * rows + (size or 0)


def core_memory(spark: SparkSession) -> int:
    """Bytes of an executor for each of its cores; 0 where the session doesn't say."""
    conf = spark.sparkContext.getConf()
    bytes_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    return bytes_of(conf.get("spark.executor.memory", "0b")) // int(conf.get("spark.executor.cores", "1"))


def group_size(total: int, memory: int = 0) -> int:
    """Bytes for each group of documents whose groups all send to all hash ranges: it grows with the root of the input, so that the number of messages grows no faster than the input, up to what a task can hold."""
    most = max(GROUP_BYTES[1], memory // GROUP_MEMORY)
    return int(min(most, max(GROUP_BYTES[0], GROUP_BYTES[0] * math.sqrt(total / GROUPS_GROW_FROM))))


def groups_for(total: int, bytes_each: int, least: int = 1) -> int:
    """How many groups of about ``bytes_each`` the input makes."""
    groups = max(least, math.ceil(total / bytes_each))
    if groups > MOST_GROUPS:
        raise ValueError(f"{groups} groups of {bytes_each} bytes; pass larger ones")
    return groups


def deal(docs: DataFrame, groups: int, group_bytes: int) -> DataFrame:
    """The rows with their group ``g``, by a hash of doc_id and text. Rows that are repeated until they would fill a quarter of a group are dealt by their place in the input too."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    least = max(1, group_bytes // 4)
    many = docs.groupBy(F.xxhash64("doc_id", "text").alias("row_hash")).agg(F.count("*").alias("n"), F.sum(size).alias("size")).where((F.col("n") > 1) & (F.col("size") > least))
    many = written(many.select("row_hash", F.ceil(F.col("size") / least).alias("salts")), "repeated")
    mark = F.xxhash64("doc_id", "text")
    if many.limit(1).count():
        marked = docs.select(F.struct("*").alias("row"), mark.alias("row_hash")).join(small_or_plain(many), "row_hash", "left")
        salt = F.when(F.col("salts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("salts"))).otherwise(0)
        dealt = marked.select("row", F.xxhash64("row_hash", salt).alias("row_hash"))
        return dealt.select("row.*", F.pmod("row_hash", F.lit(groups)).cast("int").alias("g"))
    return docs.withColumn("g", F.pmod(mark, F.lit(groups)).cast("int"))


def spread_join(rows: DataFrame, table: DataFrame, key: str, salt_by: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with a written ``table`` that has one row a key, and in ``times`` how many of ``rows`` have it. Keys with over 1 / HOT_KEYS of all rows are dealt over salts on both sides, by ``salt_by`` (a number that differs among rows of one key)."""
    spark = rows.sparkSession
    total = table.agg(F.sum("times")).first()[0] or 0
    least = total // HOT_KEYS + 1
    hot = table.where(F.col("times") > least).select(key, F.ceil(F.col("times") / least).alias("salts"))
    found = hot.collect()  # fewer than HOT_KEYS rows of two columns
    plain = table.drop("times")
    if not found:
        return rows.join(plain, key, how)
    hot = F.broadcast(spark.createDataFrame(found, hot.schema))
    salted = rows.join(hot, key, "left").withColumn("salt", F.pmod(salt_by, F.coalesce("salts", F.lit(1))))
    dealt = plain.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1)))
    return salted.drop("salts").join(dealt.drop("salts"), [key, "salt"], how).drop("salt")
