"""Normal forms of keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_key(c: Column) -> Column:
    """Lower case without surrounding white space of any kind (tabs and line ends too)."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
