"""Column builders for text, identifiers and small parsers. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: characters trimmed from the ends of identifiers and cells
BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """``c`` without outer white space of any kind."""
    return F.btrim(c, F.lit(BLANKS))


def id_key(c: Column) -> Column:
    """Comparison form of an identifier: outer blanks and case ignored; null for null or blank."""
    return F.nullif(F.upper(strip(c)), F.lit(""))


def text_or_blank(c: Column) -> Column:
    """Null and blank are the same: the trimmed text, or ''."""
    return F.coalesce(strip(c), F.lit(""))


def month_of(ts: Column) -> Column:
    """YYYY-MM of a zone-less timestamp (no session time zone is involved)."""
    return F.substring(ts.cast("string"), 1, 7)
