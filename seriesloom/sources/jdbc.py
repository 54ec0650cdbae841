"""Relational databases through Spark's JDBC source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The supported database kinds with their JDBC address forms.
ADDRESS = {
    "postgresql": "jdbc:postgresql://{host}{port}/{database}",
    "mysql": "jdbc:mysql://{host}{port}/{database}",
    "oracle": "jdbc:oracle:thin:@//{host}{port}/{database}",
    "mssql": "jdbc:sqlserver://{host}{port};databaseName={database}",
    "sqlite": "jdbc:sqlite:{database}",
}


def jdbc_url(kind: str, host: str = "", database: str | None = None, port: int | str | None = None) -> str:
    """User and password are options of the reader and never part of the address."""
    if kind not in ADDRESS:
        raise NotImplementedError(f"unsupported database kind {kind!r}")
    return ADDRESS[kind].format(host=host, port=f":{port}" if port else "", database=database or "")


def read_options(
    url: str,
    table: str,
    user: str | None = None,
    password: str | None = None,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a read; with a partition column it is split over many connections."""
    if partition_column and not (bounds and partitions):
        raise ValueError("a partition column needs bounds and a number of partitions")
    options = {"url": url, "dbtable": table, "fetchsize": fetch_size, "user": user, "password": password}
    if partition_column:
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": bounds[0],
            "upperBound": bounds[1],
            "numPartitions": partitions,
        }
    return {k: str(v) for k, v in options.items() if v is not None}


def read_table(spark: SparkSession, **kwargs) -> DataFrame:
    return spark.read.format("jdbc").options(**read_options(**kwargs)).load()


def write_table(df: DataFrame, url: str, table: str, batch_size: int = 1000, mode: str = "append", **options) -> None:
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=str(batch_size), **options).save()
