"""Schema listing and the schema contract (SC1-SC3)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import COUNTRY_CODE

# Families accepted for a contract entry: inference may give int where the
# contract says bigint, so numeric columns are checked by family.
_FAMILIES: dict[str, tuple[type, ...]] = {
    "string": (T.StringType,),
    "integral": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "numeric": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType),
    "date": (T.DateType,),
    "date_or_string": (T.DateType, T.StringType),
}

# Column contracts of the reference's inputs (after selection).
CASE_CONTRACT = {
    "Case_Type": "string",
    "Cases": "integral",
    "iso3": "string",
    "Population_Count": "integral",
    "Date": "date_or_string",
}
CLEAN_CASE_CONTRACT = {**CASE_CONTRACT, "Date": "date"}
INDICATOR_CONTRACT = {COUNTRY_CODE: "string"}


class SchemaContractError(ValueError):
    pass


def schema_mismatches(df: DataFrame, contract: Mapping[str, str]) -> list[str]:
    """Every problem at once: missing columns and wrong type families.
    Lookup is case-insensitive, like Spark's resolution."""
    fields = {f.name.lower(): f for f in df.schema.fields}
    problems = []
    for name, family in contract.items():
        field = fields.get(name.lower())
        if field is None:
            problems.append(f"missing column {name!r}")
        elif not isinstance(field.dataType, _FAMILIES[family]):
            problems.append(f"column {name!r} is {field.dataType.simpleString()}, expected {family}")
    return problems


def assert_schema(df: DataFrame, contract: Mapping[str, str]) -> DataFrame:
    problems = schema_mismatches(df, contract)
    if problems:
        raise SchemaContractError("; ".join(problems))
    return df


def cast_to(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast named columns (e.g. after a CSV round trip narrowed bigint to int)."""
    return df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def column_listing(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df.columns`` / ``printSchema`` as rows: (ordinal, column_name,
    data_type, nullable). Reads only the schema, runs no job on the data."""
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    schema = "ordinal int, column_name string, data_type string, nullable boolean"
    return spark.createDataFrame(rows, schema)


def column_listing_of_rows(df: DataFrame) -> DataFrame:
    """The listing with the number of values (not null) that each column holds,
    from one pass over the rows: (ordinal, column_name, data_type, nullable,
    n_values). An inferred type says little about a column without values."""
    counts = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"n{i}") for i, f in enumerate(df.schema.fields)])
    rows = [
        F.struct(
            F.lit(i + 1).alias("ordinal"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(f.nullable).alias("nullable"),
            F.col(f"n{i}").alias("n_values"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*rows)))


def unique_key_check(df: DataFrame, key: str, value_cols: list[str]) -> DataFrame:
    """One row per key, or fail at run time (lazily, inside the job).

    A repeated code in an indicator table would multiply rows in the join;
    the check costs one aggregate on the key, which the following join on
    the same key reuses as its partitioning.
    """
    q = [F.col(f"`{c}`") for c in value_cols]
    agg = df.groupBy(F.col(f"`{key}`").alias(key)).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(n) for c, n in zip(q, value_cols)]
    )
    ok: Column = F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate key in indicator: "), F.col(f"`{key}`")))
    return agg.where(ok.isNull()).drop("_n")
