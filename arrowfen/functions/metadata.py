"""Typed predicates over metadata, as columns.

Equality is typed: an integer never equals a float. Comparisons coerce numbers
to doubles and are false for anything else. A missing key satisfies only
``ne``. Metadata is a struct (or the table's own columns), whose field types
are known, or a VARIANT, whose values carry their types.
"""

from __future__ import annotations

import json
import numbers
import operator
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequestError

INTEGERS, FLOATS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType, T.DecimalType)
KINDS = {bool: T.BooleanType, int: INTEGERS, float: FLOATS, str: T.StringType}
#: How schema_of_variant names the types of values that equal a literal of each kind.
VARIANT_KINDS = {bool: "BOOLEAN", int: "BIGINT", float: "DECIMAL.*|DOUBLE|FLOAT", str: "STRING"}
SQL_KINDS = {bool: "boolean", int: "bigint", float: "double", str: "string"}
ORDER = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


class Filter:
    """A conjunction of conditions; empty, it holds for every row."""

    def __init__(self, conditions: tuple = ()) -> None:
        self.conditions = tuple(conditions)

    def _with(self, field: str, op: str, value: Any) -> Filter:
        return Filter((*self.conditions, (field, op, value)))

    def eq(self, field: str, value: Any) -> Filter:
        return self._with(field, "eq", value)

    def ne(self, field: str, value: Any) -> Filter:
        return self._with(field, "ne", value)

    def gt(self, field: str, value: float) -> Filter:
        return self._with(field, "gt", value)

    def gte(self, field: str, value: float) -> Filter:
        return self._with(field, "gte", value)

    def lt(self, field: str, value: float) -> Filter:
        return self._with(field, "lt", value)

    def lte(self, field: str, value: float) -> Filter:
        return self._with(field, "lte", value)

    def is_in(self, field: str, values: Iterable[Any]) -> Filter:
        return self._with(field, "in", tuple(values))

    def is_empty(self) -> bool:
        return not self.conditions

    def column(self, df: DataFrame, metadata: str | None = None) -> Column:
        """The predicate over ``df``: fields of the column ``metadata``, or ``df``'s own columns."""
        return reduce(operator.and_, [_condition(df, metadata, *c) for c in self.conditions], F.lit(True))


def _condition(df: DataFrame, metadata: str | None, field: str, op: str, value: Any) -> Column:
    kind = df.schema[metadata].dataType if metadata else df.schema
    if isinstance(kind, T.VariantType):
        at = lambda as_: F.try_variant_get(F.col(metadata), f"$.{field}", as_)
        shown = F.schema_of_variant(F.try_variant_get(F.col(metadata), f"$.{field}", "variant"))
        test = lambda v: shown.rlike(f"^({VARIANT_KINDS[type(v)]})$") & (at(SQL_KINDS[type(v)]) == F.lit(v))
        number = F.when(shown.rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"), at("double"))
    else:
        if field not in kind.names:
            return F.lit(op == "ne")
        own, col = kind[field].dataType, F.col(f"{metadata}.{field}" if metadata else field)
        test = lambda v: (col == F.lit(v)) if isinstance(own, KINDS[type(v)]) else F.lit(False)
        number = col.cast("double") if isinstance(own, (*INTEGERS, *FLOATS)) else None
    values = value if op == "in" else (value,)
    if any(type(v) not in KINDS for v in values):
        raise InvalidRequestError(f"{op} doesn't take {value!r}")
    if op == "eq":
        return F.coalesce(test(value), F.lit(False))
    if op == "ne":
        return ~F.coalesce(test(value), F.lit(False))
    if op == "in":
        return reduce(operator.or_, [F.coalesce(test(v), F.lit(False)) for v in values], F.lit(False))
    if number is None or type(value) not in (int, float):
        return F.lit(False)
    return F.coalesce(ORDER[op](number, F.lit(float(value))) & ~F.isnan(number), F.lit(False))


def scalars_of(variant: Column, field: str, kind: type) -> Column:
    """The value of a field of a VARIANT, if it has exactly this kind; else null."""
    shown = F.schema_of_variant(F.try_variant_get(variant, f"$.{field}", "variant"))
    return F.when(shown.rlike(f"^({VARIANT_KINDS[kind]})$"), F.try_variant_get(variant, f"$.{field}", SQL_KINDS[kind]))


def flat_json(json: Column) -> Column:
    """A JSON object's scalar fields as a map of JSON texts; arrays and objects are dropped."""
    return F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: v.isNull() | ~v.rlike(r"^\s*[\[{]"))


def metadata_value(value: Any) -> Any:
    """A value as metadata hold it: a string, whole number, float, boolean, null, or an array of such values."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, numbers.Integral):
        if not -(1 << 63) <= value < 1 << 63:
            raise InvalidRequestError(f"{value} has more than 64 bits")
        return int(value)
    if isinstance(value, numbers.Real):
        return float(value)
    if isinstance(value, (list, tuple)):
        return [metadata_value(v) for v in value]
    raise InvalidRequestError(f"metadata don't take {type(value).__name__}")


def metadata(*pairs: tuple[str, Any], **fields: Any) -> dict[str, Any]:
    """Metadata of (key, value) pairs and keywords; a later key replaces an earlier one."""
    return {str(k): metadata_value(v) for k, v in (*pairs, *fields.items())}


def metadata_json(values: dict[str, Any]) -> str:
    """Metadata as JSON; an array or null inside an array becomes null."""
    inner = lambda v: [None if isinstance(x, list) else x for x in v] if isinstance(v, list) else v
    return json.dumps({k: inner(metadata_value(v)) for k, v in values.items()}, ensure_ascii=False)


def json_arrays(variant: Column, field: str) -> Column:
    """An array field of a VARIANT as JSON texts, elements that are no scalars as null."""
    items = F.try_variant_get(variant, f"$.{field}", "array<variant>")
    return F.transform(items, lambda x: F.when(~F.schema_of_variant(x).rlike("^(ARRAY|OBJECT|VOID)"), F.to_json(x)))
