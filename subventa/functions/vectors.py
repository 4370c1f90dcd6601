"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cache keys hash this many leading dimensions (fixed values).
KEY_DIMS = 32
KEY_CHARS = 24


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalise(vector: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    v = as_doubles(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    # array_repeat evaluates the norm once per row, a lambda would once per element.
    return F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: F.when(n == 0, x).otherwise(x / n))


def quantised_key(vector: Column) -> Column:
    """Short key shared by vectors that agree after 8-bit quantisation."""
    bytes_hex = F.transform(
        F.slice(as_doubles(vector), 1, KEY_DIMS),
        lambda x: F.lpad(
            F.hex(F.floor(F.pmod(((x + 1.0) * 32767).cast("bigint"), F.lit(65536)) / 256).cast("bigint")), 2, "0"
        ),
    )
    return F.left(F.sha2(F.unhex(F.array_join(bytes_hex, "")), 256), F.lit(KEY_CHARS))
