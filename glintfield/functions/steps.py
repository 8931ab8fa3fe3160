"""Chains of named scalar formulas in portable SQL.

A step is a dict of column name -> SQL expression over the columns of the steps before it. Steps become
one projection each, so a value that several formulas use is computed once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = dict[str, str]
DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")


def doubles(text: str) -> str:
    """Literals with a point are DOUBLE in either engine, not DECIMAL."""
    return DECIMAL.sub(r"\1e0", text)


def apply_steps(df: DataFrame, steps: list[Step]) -> DataFrame:
    for step in steps:
        df = df.withColumns({name: F.expr(doubles(text)) for name, text in step.items()})
    return df


def steps_sql(source: str, steps: list[Step], final: str) -> str:
    """The same chain as nested common table expressions over `source` (a SELECT)."""
    parts = [f"s0 AS ({doubles(source)})"]
    for k, step in enumerate(steps):
        parts.append(f"s{k + 1} AS (SELECT *, " + ", ".join(f"{doubles(text)} AS {name}" for name, text in step.items()) + f" FROM s{k})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT {doubles(final)} FROM s{len(steps)}"
