"""Plan inspection: the reference's ``explain()`` plus checks used in tests."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def executed_plan_text(df: DataFrame) -> str:
    """The final adaptive plan after running the query once (noop sink)."""
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def has_python_udf(df: DataFrame) -> bool:
    text = plan_text(df, "extended")
    return any(tok in text for tok in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"))
