"""Unicode normalisation.

Spark has no NFKC function. Rows whose characters are all unchanged by NFKC skip Python: the
Arrow UDF gets null for them and the JVM keeps the original string.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters outside this class may change (or combine with a neighbour) under NFKC.
MAY_CHANGE = r"[^\x00-\x7FÀ-ÿ–—‘-”、。「-』ぁ-ゔァ-ヺー一-鿿가-힣]"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _nfkc_lower(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).lower())


def nfkc(c: Column) -> Column:
    """NFKC form; null stays null."""
    return F.coalesce(_nfkc(F.when(c.rlike(MAY_CHANGE), c)), c)


def nfkc_lower(c: Column) -> Column:
    """NFKC form in lower case; null stays null."""
    return F.coalesce(_nfkc_lower(F.when(c.rlike(MAY_CHANGE), c)), F.lower(c))
