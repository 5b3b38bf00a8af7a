"""File scans, temp views and SQL entry (SR1-SR4, SK1).

Paths are any Hadoop URI (``s3a://``, ``abfss://``, ``hdfs://``, ``file:``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Option names the CSV reader understands (Spark documentation). An unknown
# key is silently ignored by Spark -- ``delimeter`` falls back to a comma --
# so we reject it instead.
CSV_OPTIONS = frozenset(
    {
        "charset", "chartoescapequoteescaping", "codec", "columnnameofcorruptrecord", "comment", "compression",
        "dateformat", "delimiter", "emptyvalue", "enabledatetimeparsingfallback", "encoding", "enforceschema",
        "escape", "escapequotes", "extension", "header", "ignorecorruptfiles", "ignoreleadingwhitespace",
        "ignoremissingfiles", "ignoretrailingwhitespace", "inferschema", "linesep", "locale", "maxcharspercolumn",
        "maxcolumns", "mode", "modifiedafter", "modifiedbefore", "multiline", "nanvalue", "negativeinf", "nullvalue",
        "pathglobfilter", "positiveinf", "preferdate", "quote", "quoteall", "recursivefilelookup", "samplingratio",
        "sep", "singlevariantcolumn", "timeformat", "timestampformat", "timestampntzformat", "timezone",
        "unescapedquotehandling",
    }
)


class UnknownOptionError(ValueError):
    pass


def check_csv_options(options: dict[str, object]) -> dict[str, str]:
    bad = sorted(k for k in options if k.lower() not in CSV_OPTIONS)
    if bad:
        raise UnknownOptionError(f"unknown CSV option(s) {bad}; Spark would ignore them silently")
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    header: bool = True,
    infer_schema: bool = True,
    delimiter: str = ",",
    schema=None,
    **options,
) -> DataFrame:
    """CSV with a header line. ``infer_schema`` costs one extra pass over the
    files; on large inputs pass an explicit ``schema`` instead."""
    opts = check_csv_options({"header": header, "delimiter": delimiter, **options})
    reader = spark.read.options(**opts)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", str(infer_schema).lower())
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, *, delimiter: str = ",", header: bool = True) -> str:
    """Write with one file per partition (no coalesce to one writer)."""
    df.write.mode("errorifexists").options(**check_csv_options({"header": header, "delimiter": delimiter})).csv(path)
    return path


def read_parquet(
    spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None
) -> DataFrame:
    """Parquet relation over the files that are there now: every call lists
    them anew. Column selection prunes the scan's ReadSchema. A given
    ``schema`` saves the job that reads the footers."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Name a DataFrame for SQL, replacing an older view of that name."""
    df.createOrReplaceTempView(name)
    return df


def sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)
