"""JSON of any shape as rows: nested items with pointers, canonical forms, groups of equal content.

Values are variants: parsed once, objects with their keys in order, so equal
content has one text.  A text with a duplicate key, or that is no JSON, is
refused as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The variant of a JSON text; null where it is none or has a key twice."""
    return F.try_parse_json(text)


def canonical(value: Column) -> Column:
    """The text of a variant: keys in code-point order, no spaces."""
    return F.to_json(value)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def items(value: Column, pointer: Column) -> Column:
    """Array of (pointer, value): the objects of a list, each with its place, or one object as it is; anything else has none."""
    listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v, i: F.struct(F.concat(pointer, F.lit("/"), i.cast("string")).alias("pointer"), v.alias("value")))
    return F.when(_is(value, "ARRAY"), F.filter(listed, lambda x: _is(x["value"], "OBJECT"))).when(_is(value, "OBJECT"), F.array(F.struct(pointer.alias("pointer"), value.alias("value"))))


def nested_items(rows: DataFrame, value: str, levels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row for each item at the end of a path of levels: the kept columns, pointer_k and value_k of every level k.

    A level is a key, or several with slashes; at each end may stand one object
    or a list of them.  Rows without an item at some level have none.
    """
    pointer, current, told = F.lit(""), F.col(value), []
    for k, level in enumerate(levels):
        at = F.try_variant_get(current, "$." + level.replace("/", "."), "variant")
        rows = rows.select(*keep, *told, F.explode(items(at, F.concat(pointer, F.lit("/" + level)))).alias("_item"))
        rows = rows.select(*keep, *told, F.col("_item.pointer").alias(f"pointer_{k}"), F.col("_item.value").alias(f"value_{k}"))
        told += [f"pointer_{k}", f"value_{k}"]
        pointer, current = F.col(f"pointer_{k}"), F.col(f"value_{k}")
    return rows


def equal_content(rows: DataFrame, parts: dict[str, Column], *more: Column) -> DataFrame:
    """Rows grouped by the canonical text of some parts: content, sha256, members and further aggregates."""
    content = F.concat_ws("\n", *[F.concat(F.lit(f"{name}="), F.coalesce(canonical(value), F.lit("null"))) for name, value in parts.items()])
    return rows.withColumn("content", content).groupBy("content").agg(F.count(F.lit(1)).alias("members"), *more).withColumn("sha256", F.sha2("content", 256))
