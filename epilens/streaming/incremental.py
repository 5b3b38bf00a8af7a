"""The worldwide totals by date, kept up to date as case files arrive.

Case files are published once a day, and each repeats the history of its
regions (counts are cumulative snapshots, sometimes corrected). So the rows
are kept by key -- case type, country, region, date -- and a newer file
replaces a row instead of adding to it.

The folder is a Structured Streaming file source: each micro-batch reads only
the new files and cleans them under the schema contract. ``foreachBatch``
writes the next version of the kept rows (old rows without a newer one, plus
the batch) to a folder named by the batch number, so a batch that is tried
again overwrites its own unfinished version and never the one it reads.
Readers take the newest version that Spark has marked complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import CONFIRMED, drop_null_rows, parse_date_column
from ..operators.timeseries import totals_by_date

# Explicit schema of the case CSV (a stream cannot infer one per batch).
CASE_CSV_SCHEMA = T.StructType(
    [
        T.StructField("Case_Type", T.StringType()),
        T.StructField("Cases", T.LongType()),
        T.StructField("Date", T.StringType()),
        T.StructField("Combined_Key", T.StringType()),
        T.StructField("Province_State", T.StringType()),
        T.StructField("iso3", T.StringType()),
        T.StructField("Population_Count", T.LongType()),
    ]
)


KEYS = ["Case_Type", "iso3", "Province_State", "Date"]
_STATE = [*KEYS, "Cases", "published"]


def case_file_stream(
    spark: SparkSession, folder: str, schema: T.StructType = CASE_CSV_SCHEMA, files_per_batch: int | None = None
) -> DataFrame:
    """Case rows with ``published``: modification time and path of their file."""
    reader = spark.readStream.schema(schema).option("header", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    published = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path"))
    return reader.csv(folder).withColumn("published", published)


def keyed_rows(cases: DataFrame, case_type: str = CONFIRMED) -> DataFrame:
    """Clean rows of one case type with their key. Rows of one key in one
    file are regions that the file does not tell apart: they are summed."""
    rows = parse_date_column(cases.where(F.col("Case_Type") == case_type))
    rows = drop_null_rows(rows, ["Case_Type", "Cases", "iso3", "Population_Count", "Date"])
    rows = rows.groupBy(*KEYS, "published").agg(F.sum("Cases").alias("Cases"))
    return rows.select(*_STATE)


def newest(rows: DataFrame) -> DataFrame:
    """One row per key: the one published last."""
    best = rows.groupBy(*KEYS).agg(F.max(F.struct("published", "Cases")).alias("_r"))
    return best.select(*KEYS, F.col("_r.Cases").alias("Cases"), F.col("_r.published").alias("published"))


def _folder(spark: SparkSession, path: str):
    """Hadoop file system and path object of a URI."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions under ``path``."""
    fs, root = _folder(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n.removeprefix("v")) for n in done if n.startswith("v"))


def update_case_rows(stream: DataFrame, table_path: str, checkpoint_path: str, case_type: str = CONFIRMED) -> str:
    """Fold everything available now into the kept rows, then stop."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = keyed_rows(batch, case_type)
        before = [v for v in _versions(spark, table_path) if v < number]
        if before:
            rows = rows.unionByName(spark.read.parquet(f"{table_path}/v{before[-1]}"))
        newest(rows).write.mode("overwrite").parquet(f"{table_path}/v{number}")
        for old in before[:-1]:  # the version before this one stays for its readers
            _folder(spark, table_path)[0].delete(_folder(spark, f"{table_path}/v{old}")[1], True)

    query = (
        stream.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return table_path


def totals_from_rows(spark: SparkSession, table_path: str) -> DataFrame:
    """AG4 over the newest complete version of the kept rows."""
    rows = spark.read.parquet(f"{table_path}/v{_versions(spark, table_path)[-1]}")
    return totals_by_date(rows, "Cases", "Date", "Number_Of_Cases")
