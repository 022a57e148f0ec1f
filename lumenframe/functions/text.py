"""Column functions on text: strip, labels, and exact decimal formatting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that the labels are stripped of.
_STRIP = r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$"


def strip(c: Column) -> Column:
    """All white space off both ends (trim takes spaces only)."""
    return F.regexp_replace(c, _STRIP, "")


def filled(c: Column) -> Column:
    """Null where empty."""
    return F.nullif(c, F.lit(""))


def fixed(c: Column, digits: int) -> Column:
    """The exact binary value to so many decimals, half to even on ties only; format_string rounds the shortest decimal."""

    @F.pandas_udf("string")
    def render(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}")

    return render(c)


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
