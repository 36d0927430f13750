"""Typed metadata predicates, compiled to Column expressions before any job starts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("id", "text", "number", "bool", "keyword", "keywords")
NUMBER_OPERATORS = ("eq", "gt", "gte", "lt", "lte", "between")
LIST_OPERATORS = ("or", "and")


def check_schema(schema: Mapping[str, str]) -> None:
    for name, kind in schema.items():
        if kind not in KINDS:
            raise TypeError(f"field {name!r} has the unknown kind {kind!r}")
    if list(schema.values()).count("id") != 1:
        raise ValueError("a schema needs one field of kind id")
    if list(schema.values()).count("text") > 1:
        raise ValueError("a schema has one field of kind text at most")


def _fits(kind: str, t: T.DataType) -> bool:
    return {
        "id": isinstance(t, (T.StringType, T.IntegralType)),
        "text": isinstance(t, T.StringType),
        "number": isinstance(t, (T.NumericType, T.BooleanType)),
        "bool": isinstance(t, T.BooleanType),
        "keyword": isinstance(t, T.StringType),
        "keywords": isinstance(t, T.ArrayType),
    }[kind]


def check_collection(docs: DataFrame, schema: Mapping[str, str]) -> None:
    """Types are compared without a job; one aggregate then looks for missing values."""
    check_schema(schema)
    if missing := set(schema) - set(docs.columns):
        raise ValueError(f"missing fields: {sorted(missing)}")
    if extra := set(docs.columns) - set(schema):
        raise ValueError(f"fields that the schema lacks: {sorted(extra)}")
    for name, kind in schema.items():
        if not _fits(kind, docs.schema[name].dataType):
            raise TypeError(f"field {name!r} is no {kind}: {docs.schema[name].dataType.simpleString()}")
    nulls = docs.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in schema)).first().asDict()
    if bad := [c for c, n in nulls.items() if n]:
        raise ValueError(f"missing values in {bad}")


def _listed(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]


def predicate(schema: Mapping[str, str], name: str, clause: str, value: Any, operator: str | None = None) -> Column:
    """One condition; clause is "must" or "must not"."""
    if clause not in ("must", "must not"):
        raise ValueError(f"unknown clause {clause!r}")
    if name not in schema:
        raise ValueError(f"unknown field {name!r}")
    kind, c = schema[name], F.col(name)
    if operator is not None and operator not in (NUMBER_OPERATORS if kind == "number" else LIST_OPERATORS if kind == "keywords" else ()):
        raise ValueError(f"operator {operator!r} does not apply to {name!r} ({kind})")
    if kind == "number":
        plain = {"eq": c.__eq__, "gt": c.__gt__, "gte": c.__ge__, "lt": c.__lt__, "lte": c.__le__}
        out = c.between(*value) if operator == "between" else plain[operator or "eq"](F.lit(value))
    elif kind == "bool":
        out = c == F.lit(bool(value))
    elif kind in ("keyword", "id"):
        out = c.isin(_listed(value))
    elif kind == "keywords":
        wanted = F.array(*(F.lit(v) for v in _listed(value)))
        if operator == "and":
            out = F.size(F.array_except(wanted, c)) == 0
        else:
            out = F.arrays_overlap(c, wanted)
    else:
        raise ValueError(f"fields of kind {kind!r} cannot be filtered")
    return ~F.coalesce(out, F.lit(False)) if clause == "must not" else out


def parse_filters(filters: Mapping[str, Any], schema: Mapping[str, str], clause: str = "must") -> list[tuple[str, str, Any, str | None]]:
    """(field, clause, value, operator) of each entry; (operator, value) pairs are read for numbers and keyword lists."""
    out = []
    for name, value in filters.items():
        known = NUMBER_OPERATORS if schema.get(name) == "number" else LIST_OPERATORS if schema.get(name) == "keywords" else ()
        pair = isinstance(value, tuple) and len(value) == 2 and (isinstance(value[0], str) and (value[0] in known or schema.get(name) == "number"))
        out.append((name, clause, value[1], value[0]) if pair else (name, clause, value, None))
    return out


def conditions(query: Mapping[str, Any], schema: Mapping[str, str]) -> list[tuple[str, str, Any, str | None]]:
    """(field, clause, value, operator) of a query's `where`, `where_not` and bare fields."""
    rest = {k: v for k, v in query.items() if k not in ("text", "where", "where_not")}
    return parse_filters(query.get("where") or {}, schema) + parse_filters(query.get("where_not") or {}, schema, "must not") + parse_filters(rest, schema)


def compile_query(query: Mapping[str, Any], schema: Mapping[str, str]) -> tuple[str | None, Column | None]:
    """(text, condition) of a query: `where`, `where_not` and bare fields are joined by and; without any, no condition."""
    parts = [predicate(schema, name, clause, value, operator) for name, clause, value, operator in conditions(query, schema)]
    return query.get("text"), reduce(Column.__and__, parts) if parts else None


def filter_documents(docs: DataFrame, schema: Mapping[str, str], filters: Mapping[str, Any]) -> DataFrame:
    _, condition = compile_query(filters, schema)
    return docs if condition is None else docs.where(condition)


def check_keyword(docs: DataFrame, name: str, value: Any) -> None:
    """Strict mode: a keyword value that no document has is an error."""
    known = docs.where(F.col(name).isin(_listed(value))).select(name).distinct().count()
    if known < len(set(_listed(value))):
        raise ValueError(f"{name!r} has no value {value!r} in this collection")
