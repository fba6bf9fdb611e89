"""Loosely typed records as VARIANT: the type of each value is its own, as in JSON.

``typed`` gives the columns that rules, health and deduplication work on: a
value whose type its field does not allow is null in its column and stands in
``loose`` as text. ``untyped`` is the way back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import FIELDS, ID, KINDS


def _number(kind: Column) -> Column:
    """Whether ``schema_of_variant`` tells of a number; truth values count as 1 and 0."""
    return kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")


def _allowed(field: str, kind: Column) -> Column:
    if field not in KINDS:
        return kind == "STRING"
    # an integer is told from a fraction by BIGINT: a number with a decimal point is DECIMAL or DOUBLE
    return _number(kind) if KINDS[field] == "double" else kind.isin("BIGINT", "BOOLEAN")


def _text(part: Column, kind: Column) -> Column:
    return F.when(kind == "STRING", F.try_variant_get(part, "$", "string")).otherwise(F.to_json(part))


def _value(field: str, part: Column, kind: Column) -> Column:
    if field not in KINDS:
        return F.try_variant_get(part, "$", "string")
    number = F.try_variant_get(part, "$", KINDS[field])
    return F.when(kind == "BOOLEAN", F.try_variant_get(part, "$", "boolean").cast(KINDS[field])).otherwise(number)


def typed(rows: DataFrame, record: str = "record") -> DataFrame:
    """Replace the VARIANT column ``record`` by a record's columns but ``pos``, which stays the caller's.

    Members that a record does not have are ignored, members that it lacks and
    JSON nulls are null, as are all members of what is no object. An id of any
    type becomes text. Columns of the input that clash with a record's are
    replaced.
    """
    names = (ID, *FIELDS)
    kept = [c for c in rows.columns if c.lower() not in {*names, "loose", record.lower()}]
    parts = rows.select(*kept, *[F.try_variant_get(record, f"$.{f}", "variant").alias(f"_part_{f}") for f in names])
    kinds = parts.select("*", *[F.nullif(F.schema_of_variant(f"_part_{f}"), F.lit("VOID")).alias(f"_kind_{f}") for f in names])
    part, kind = (lambda f: F.col(f"_part_{f}")), (lambda f: F.col(f"_kind_{f}"))
    odd = [F.when(kind(f).isNotNull() & ~_allowed(f, kind(f)), F.struct(F.lit(f).alias("key"), _text(part(f), kind(f)).alias("value"))) for f in FIELDS]
    return kinds.select(
        *kept,
        F.when(kind(ID).isNotNull(), _text(part(ID), kind(ID))).alias(ID),
        *[F.when(_allowed(f, kind(f)), _value(f, part(f), kind(f))).alias(f) for f in FIELDS],
        F.map_from_entries(F.filter(F.array(*odd), lambda x: x.isNotNull())).alias("loose"),
    )


def untyped(records: DataFrame, record: str = "record") -> DataFrame:
    """Replace a record's columns but ``pos`` by a VARIANT object.

    What stands in ``loose`` goes back under its field: as a string where the
    field is a number's, else as the JSON value that it reads as.
    """
    names = (ID, *FIELDS)
    loose = lambda f: F.element_at("loose", f)
    back = {f: loose(f).cast("variant") if f in KINDS else F.try_parse_json(loose(f)) for f in FIELDS}
    members = [F.col(ID).cast("variant").alias(ID), *[F.coalesce(F.col(f).cast("variant"), back[f]).alias(f) for f in FIELDS]]
    return records.select(*[c for c in records.columns if c not in (*names, "loose", record)], F.to_variant_object(F.struct(*members)).alias(record))
