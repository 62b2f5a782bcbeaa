"""Names of attributes as sources spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attribute_key(name: Column) -> Column:
    """The name without letter case, separators and trailing marks: 'Contract No:' and 'contract_no' agree. Null stays null."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]+", ""))
