"""Numbers as text, as Python writes them, and base pairs for human readers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def python_rounded(column: str) -> Column:
    """str(round(v, 3)): halves by the exact binary value, exponents as Python writes them. For text exports only."""

    @F.pandas_udf("string")
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else str(round(float(v), 3)))

    return rounded(column)


def human_bp(bp: Column, sep: str = " ", allowed_decimals: int = 0) -> Column:
    """125000 as '125 kb': the largest unit that bp, less allowed_decimals zeros, is a multiple of."""
    shown = lambda v: F.regexp_replace(F.regexp_replace(F.format_number(v, 6), ",", ""), r"\.?0+$", "")
    out = F.when(bp == 0, F.lit(f"0{sep}b"))
    for power, unit in ((9, "Gb"), (6, "Mb"), (3, "kb")):
        out = out.when(bp % F.lit(10 ** (power - allowed_decimals)) == 0, F.concat(shown(bp / F.lit(10.0**power)), F.lit(sep + unit)))
    return out.otherwise(F.concat(bp.cast("string"), F.lit(f"{sep}b")))


def rotate(values: Column, by: Column | int) -> Column:
    """An array turned right by `by` places; negative turns left."""
    n = F.size(values)
    by = F.pmod(by if isinstance(by, Column) else F.lit(by), n)
    return F.when(n == 0, values).otherwise(F.concat(F.slice(values, n - by + 1, by), F.slice(values, F.lit(1), n - by)))
