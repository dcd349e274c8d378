"""Looking at plans: what a query shuffles, scans and runs in Python."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def operators(df: DataFrame) -> Counter:
    """How often each physical operator stands in the plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return Counter(m[1] for line in text.splitlines() if (m := re.match(r"[\s:+*()\d-]*([A-Z]\w+)", line)))


def pushed_filters(df: DataFrame) -> list[str]:
    """Filters that reach the scans."""
    return re.findall(r"PushedFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())


def read_columns(df: DataFrame) -> list[str]:
    """Columns that the scans read."""
    return re.findall(r"ReadSchema: struct<([^>]*)>", df._jdf.queryExecution().executedPlan().toString())
