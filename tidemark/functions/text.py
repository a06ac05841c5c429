"""String clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency signs stripped from numbers, the thousand-separator rule, and the
# magnitude letters.
CURRENCY = "€$£¥₽₪₹₩₺"
THOUSANDS = r"(?<=\d)[,_](?=\d{3}\b)"
MAGNITUDES = (("k", "e3"), ("m", "e6"), ("b", "e9"))
_BLANKS = " \t\n\r\f\u000b"

# A number, then an exponent or one magnitude letter, then perhaps a percent sign.  Keeps
# Java-only spellings such as 1d, 1f or 0x1p3 out.
_NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+(?![kKmMbB]))?)([kKmMbB]?) *(%?)$"


def numeric_like(c: Column) -> Column:
    """Decorated number to DOUBLE: ``$1,234``, ``12k``, ``5%``; anything else is null.

    Each step refers to the one before only a few times, so the expression stays small.
    """
    s = F.translate(F.btrim(c.cast("string"), F.lit(_BLANKS)), CURRENCY, "")
    s = F.ltrim(F.regexp_replace(s, THOUSANDS, ""))
    powers = F.create_map(*[F.lit(v) for pair in MAGNITUDES for v in pair])
    suffix = F.lower(F.regexp_extract(s, _NUMBER, 2))
    number = F.concat(F.regexp_extract(s, _NUMBER, 1), F.coalesce(powers[suffix], F.lit(""))).try_cast("double")
    share = F.when(F.regexp_extract(s, _NUMBER, 3) == "%", number / 100.0).otherwise(number)
    endless = F.regexp_extract(F.lower(s), r"^([+-]?)inf(inity)?$", 0)
    return F.coalesce(share, F.when(endless.startswith("-"), F.lit(float("-inf")))
                      .when(endless != "", F.lit(float("inf"))))


def sanitize_name(name: Column) -> Column:
    return F.replace(F.regexp_replace(name, "[^0-9a-zA-Z_]+", "_"), F.lit("__"), F.lit("_"))


def storage_key(filename: Column, unique: Column, prefix: str = "uploads/") -> Column:
    """Safe object key: prefix, unique part, cleaned stem, extension as given."""
    extension = F.regexp_extract(filename, r"(\.[^.]*)$", 1)
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    safe = F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_")
    safe = F.regexp_replace(safe, "^[._-]+|[._-]+$", "")
    return F.concat(F.lit(prefix), unique, F.lit("_"),
                    F.when(safe == "", F.lit("file")).otherwise(safe), extension)
