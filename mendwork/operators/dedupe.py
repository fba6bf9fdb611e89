"""Deduplication of a page's records by an order-dependent fold.

Records of one key are folded in page order: the fuller of the accumulated
record and the next one wins (the accumulated one on a tie) and takes the
other's values where it has none. Groups are records of one page and key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.memo import memo
from ..functions.normalize import let
from ..functions.urls import canonical
from .schema import FIELDS, ID, KINDS, RECORD


@memo
def dedupe_key(absent_url: bool = False) -> Column:
    """The strongest key of a record: id, canonical address, or a hash of name and address.

    The hash is only reached without a canonical address; the address then
    reads None, or is empty if the record has no such field (``absent_url``).
    """
    name = F.regexp_replace(F.lower(F.trim(F.coalesce("product_name", F.lit("")))), r"(?U)\s+", " ")
    seed = lambda n: F.concat(n, F.lit("|"), F.coalesce("product_url", F.lit("" if absent_url else "None")))
    hashed = lambda n: F.when(n != "", F.concat(F.lit("hash:"), F.substring(F.sha1(seed(n).cast("binary")), 1, 16)))
    return F.coalesce(
        F.when(F.col(ID) != "", F.concat(F.lit("id:"), F.col(ID))),
        let(canonical("product_url"), lambda link: F.when(link != "", F.concat(F.lit("url:"), link))),
        let(name, hashed),
    )


def present(field: str, record: Column | None = None) -> Column:
    """Whether a record's field has a value, of whatever type."""
    get = (lambda n: record[n]) if record is not None else F.col
    value = get(field).isNotNull() if field in KINDS else F.coalesce(get(field) != "", F.lit(False))
    return value | F.coalesce(F.element_at(get("loose"), field) != "", F.lit(False))


def filled(record: Column | None = None) -> Column:
    """Number of required fields that have a value."""
    return reduce(Column.__add__, [present(f, record).cast("int") for f in FIELDS])


def _merge(winner: Column, other: Column) -> Column:
    columns = [winner["pos"].alias("pos")]
    for f in (ID, *FIELDS):
        mine, yours = winner[f], other[f]
        # an own empty text stays unless the other record has something
        value = F.coalesce(mine, yours) if f in KINDS else F.when(mine != "", mine).when(yours != "", yours).otherwise(mine)
        columns.append(F.when(F.element_at(winner["loose"], f).isNull(), value).otherwise(mine).alias(f))
    taken = F.map_filter(other["loose"], lambda k, v: ~F.map_contains_key(winner["loose"], k) & ~reduce(lambda c, f: c.when(k == f, present(f, winner)), FIELDS, F.when(F.lit(False), F.lit(True))).otherwise(F.lit(False)))
    return F.struct(*columns, F.map_concat(winner["loose"], taken).alias("loose"))


@memo
def _fold() -> Column:
    """A group's records, merged in the order of their places."""
    own = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD])
    return F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col("pos").alias("at"), own.alias("r"))), lambda x, y: x["at"] - y["at"]),
        F.lit(None).cast(T.StructType(list(RECORD))),
        lambda a, x: F.when(a.isNull(), x["r"]).when(filled(x["r"]) > filled(a), _merge(x["r"], a)).otherwise(_merge(a, x["r"])),
    )


def dedupe(records: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(unique records by page, report by page).

    Unique records stand in the order of their first occurrence and have new
    consecutive places ``pos``. Records without a key are dropped and counted.
    Empty input gives no rows in both.
    """
    rows = records.withColumn("_key", dedupe_key())
    fold = _fold()
    # dealt by page once: groups and places are both within a page
    groups = rows.repartition(*keys).groupBy(*keys, "_key").agg(F.min("pos").alias("_first"), fold.alias("_r"), F.count("_key").alias("_n")).where("_n > 0")
    place = F.row_number().over(_by(keys, "_first")) - 1
    unique = groups.select(*keys, place.alias("pos"), *[F.col("_r")[n].alias(n) for n in RECORD.names[1:]])
    by_kind = F.split_part("_key", F.lit(":"), F.lit(1))
    report = rows.groupBy(*keys).agg(
        F.count("*").alias("input_count"),
        F.countDistinct("_key").alias("output_count"),
        F.count_if(F.col("_key").isNull()).alias("dropped_no_key"),
        *[F.count_if(by_kind == k).alias(f"_{k}") for k in ("id", "url", "hash")],
    )
    kinds = F.map_filter(F.create_map(*[x for k in ("id", "url", "hash") for x in (F.lit(k), F.col(f"_{k}"))]), lambda _, n: n > 0)
    merged = F.col("input_count") - F.col("dropped_no_key") - F.col("output_count")
    return unique, report.select(*keys, "input_count", "output_count", "dropped_no_key", merged.alias("merged_duplicates"), kinds.alias("keys_by_kind"))


def _by(keys: list[str], order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(order)
