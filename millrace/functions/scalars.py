"""The scalar computations of the bundled programs, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column | str) -> Column:
    """Array of what white space separates, without empty strings."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column | str) -> Column:
    """Array of what blanks, tabs, line ends and form feeds separate, without empty strings."""
    return F.filter(F.split(text, "[ \t\n\r\f]+"), lambda w: w != "")


def parse_vector(line: Column | str) -> Column:
    return F.transform(F.split(line, " "), lambda x: x.cast("double"))


def format_vector(vector: Column | str) -> Column:
    return F.array_join(F.transform(vector, lambda x: x.cast("string")), " ")


def distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def round2(x: Column | str) -> Column:
    """To two decimals, halves upwards."""
    return F.floor((F.col(x) if isinstance(x, str) else x) * 100 + 0.5) / 100


def field_hash(*columns: str) -> Column:
    """One hash of some fields by their text, 0 to 2^60 - 1: the first 15 hexadecimal digits of the MD5 of the fields
    with a vertical line between them. Null fields are empty text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
