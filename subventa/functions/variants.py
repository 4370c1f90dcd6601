"""JSON kinds of variant values: what a typed parse would silently turn into null or text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind_of(document: Column, path: str) -> Column:
    """STRING, BIGINT, ARRAY<...>, OBJECT<...>, VOID for a JSON null; null if nothing is there."""
    return F.schema_of_variant(F.try_variant_get(document, path, "variant"))


def elements(document: Column, path: str) -> Column:
    return F.try_variant_get(document, path, "array<variant>")


def no_text(document: Column, path: str, required: bool = False, nullable: bool = False) -> Column:
    """True unless a text stands there, or nothing where it may be missing, or null where that is allowed."""
    kind = kind_of(document, path)
    allowed = ["STRING", "VOID"] if nullable else ["STRING"]
    return F.coalesce(~kind.isin(*allowed), F.lit(required))


def no_text_list(document: Column, path: str) -> Column:
    """True unless a list of texts stands there or nothing."""
    kind = kind_of(document, path)
    texts = F.coalesce(F.forall(elements(document, path), lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))
    return kind.isNotNull() & ~(kind.startswith("ARRAY<") & texts)


def no_record_list(document: Column, path: str, broken) -> Column:
    """True unless a list of records stands there of which none is `broken`, or nothing."""
    kind = kind_of(document, path)
    bad = F.exists(elements(document, path), lambda x: ~F.schema_of_variant(x).startswith("OBJECT") | broken(x))
    return kind.isNotNull() & (~kind.startswith("ARRAY<") | F.coalesce(bad, F.lit(True)))
