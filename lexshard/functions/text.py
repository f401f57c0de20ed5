"""Terms of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters and digits of any script.
TOKEN = r"[\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    """The terms of a text, lower-cased, with repetitions; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
