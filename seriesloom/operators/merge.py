"""Upserts, deletes and high-water marks over parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.schema import HIGH_WATER_KEY, LOCATION
from seriesloom.session import CODEC, FREES_SHUFFLES, OPEN_FILES, held_conf, materialize, remove_path


def unique_rows(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch itself; a key that occurs twice fails the job that reads it."""
    rest = [c for c in source.columns if c not in keys]
    if not rest:
        rest, source = ["_one"], source.withColumn("_one", F.lit(1))
    once = source.groupBy(*keys).agg(
        F.count("*").alias("_copies"), *[F.first(c).alias(c) for c in rest]
    )
    message = F.concat(F.lit("duplicate key in batch: "), F.to_json(F.struct(*keys)))
    guarded = F.when(F.col("_copies") > 1, F.raise_error(message)).otherwise(F.col(rest[0]))
    return once.withColumn(rest[0], guarded).select(*[c for c in source.columns if c != "_one"])


def refuse_copies(source: DataFrame, keys: Sequence[str]) -> None:
    """Fails if a key occurs twice. Only the keys are shuffled, where ``unique_rows`` sends and sorts whole rows."""
    message = F.concat(F.lit("duplicate key in batch: "), F.to_json(F.struct(*keys)))
    copies = source.groupBy(*keys).agg(F.count("*").alias("_copies")).where("_copies > 1")
    with held_conf(source.sparkSession, FREES_SHUFFLES):
        copies.select(F.raise_error(message).alias("_copy")).collect()  # no row, or the error


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Rows of ``source`` replace ``update_columns`` of equal keys and are added otherwise.

    With a small batch the joins broadcast it and the table streams through without a shuffle. The
    size decides at run time; a large batch falls back to a sort-merge join on the unique key.
    ``unique`` says that no key of the source occurs twice.
    """
    keys, columns = list(keys), target.columns
    rest = [c for c in columns if c not in keys]
    source = source.select(*columns) if unique else unique_rows(source.select(*columns), keys)
    if update_columns is None or set(update_columns) >= set(rest):
        kept = target.join(source.select(*keys), keys, "left_anti")
        return kept.unionByName(source)
    news = source.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in update_columns], F.lit(True).alias("_matched")
    )
    changed = (
        target.join(news, keys, "left")
        .withColumns(
            {c: F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in update_columns}
        )
        .select(*columns)
    )
    added = source.join(target.select(*keys), keys, "left_anti").select(*columns)
    return changed.unionByName(added)


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("timestamp", "yyyy-MM"))


def upsert_table(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: Sequence[str],
    partition_by: Sequence[str],
    update_columns: Sequence[str] | None = None,
    stored: bool = False,
) -> None:
    """Upsert into a partitioned parquet table. Only the partitions the batch touches are read and
    rewritten; files are staged and swapped at commit, so a failed job leaves the table as it was.

    ``stored`` says that the source is read from a table: then its keys are checked first, and its rows are neither
    cached nor shuffled for that.
    """
    partition_by = list(partition_by)
    if not set(partition_by) <= {*keys, "month"}:
        raise ValueError("partition columns must be part of the key, or the month of its timestamp")
    if stored:
        refuse_copies(source, keys)
    if not table_exists(spark, path):
        _overwrite_partitions(source if stored else unique_rows(source, keys), path, partition_by)
        return
    source = source if stored else source.persist()  # read for its partitions, its keys and its rows
    try:
        target = spark.read.schema(source.schema).parquet(path)
        touched = source.select(*partition_by).distinct()
        affected = target.join(touched, partition_by, "left_semi").select(*source.columns)
        _overwrite_partitions(upsert(affected, source, keys, update_columns, stored), path, partition_by)
    finally:
        if not stored:
            source.unpersist()


def delete_from_table(spark: SparkSession, path: str, condition: Column, partition_by: Sequence[str]) -> None:
    """Delete the rows that meet the condition. Only partitions that hold such rows are rewritten; one that
    loses all its rows loses its folder."""
    table = spark.read.parquet(path)
    found = materialize(
        table.groupBy(*partition_by).agg(
            F.count_if(condition).alias("_gone"),
            F.count("*").alias("_all"),
            F.min("_metadata.file_path").alias("_file"),
        ).where("_gone > 0")
    )
    kept = found.where("_gone < _all").select(*partition_by)
    rest = delete_where(table.join(kept, list(partition_by), "left_semi"), condition)
    _overwrite_partitions(materialize(rest.select(*table.columns)), path, list(partition_by))
    for row in found.where("_gone = _all").select("_file").collect():  # one file name for each emptied partition
        remove_path(spark, row["_file"].rpartition("/")[0])


def _overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    with held_conf(df.sparkSession, FREES_SHUFFLES | OPEN_FILES):
        (
            df.write.mode("overwrite")
            .options(partitionOverwriteMode="dynamic", compression=CODEC)
            .partitionBy(*partition_by)
            .parquet(path)
        )


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def marks_of(features: DataFrame, data_type: str, update_date) -> DataFrame:
    """The newest timestamp of each location as rows of the mark table."""
    return features.groupBy(*LOCATION).agg(F.max("timestamp").alias("timestamp")).select(
        *LOCATION,
        F.lit(data_type).alias("data_type"),
        "timestamp",
        F.lit(update_date).cast("timestamp_ntz").alias("update_date"),
    )


def advance_marks(marks: DataFrame, features: DataFrame, data_type: str, update_date) -> DataFrame:
    return upsert(marks, marks_of(features, data_type, update_date), HIGH_WATER_KEY)


def since_mark(features: DataFrame, marks: DataFrame, data_type: str) -> DataFrame:
    """Rows newer than their location's mark; all rows of a location without one."""
    known = marks.where(F.col("data_type") == data_type).select(*LOCATION, F.col("timestamp").alias("_mark"))
    return (
        features.join(known, LOCATION, "left")
        .where(F.col("_mark").isNull() | (F.col("timestamp") > F.col("_mark")))
        .drop("_mark")
    )
