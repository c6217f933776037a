"""Typed metadata filters as dictionaries, compiled to column expressions (never to a UDF)."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGIC = {"$and": "AND", "$or": "OR", "$not": "NOT"}
# Fixed value: the operators in the order in which a single-operator filter looks for them.
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "contains", "icontains")


def _yes(c: Column) -> Column:
    """A comparison with a missing field is false, not unknown, so that NOT of it is true."""
    return F.coalesce(c, F.lit(False))


def _condition(col: Column, op: str, v: Any) -> Column:
    if op == "eq":
        return col.eqNullSafe(F.lit(v))
    if op == "ne":
        return ~col.eqNullSafe(F.lit(v))
    if op in ("gt", "gte", "lt", "lte"):
        return _yes({"gt": col > v, "gte": col >= v, "lt": col < v, "lte": col <= v}[op])
    if op in ("in", "nin"):
        if not isinstance(v, (list, tuple, set)):
            return F.lit(op == "nin")
        hit = _yes(col.isin([x for x in v if x is not None]))
        hit = hit | col.isNull() if None in v else hit
        return ~hit if op == "nin" else hit
    text = col.cast("string")
    if op == "contains":
        return _yes(F.contains(text, F.lit(v)))
    return _yes(F.contains(F.lower(text), F.lit(str(v).lower())))


def compile_filter(spec: dict | None, column=F.col, first_only: bool = False, keys: set[str] | None = None, strict: bool = False) -> Column:
    """Column that is true for the rows a filter matches.

    ``spec`` maps fields to a value (equal), a list (one of), "*" (any value) or a dictionary of
    ``OPERATORS``; AND, OR and NOT (or $and, $or, $not) take lists of filters, NOT matches if none does. An
    empty filter matches all rows, an empty OR none. Several operators of one field all hold;
    ``first_only`` keeps just the first of ``OPERATORS``, as the simplest evaluators do. ``keys`` restricts the
    fields that may be named; ``strict`` refuses a field with range and other operators together. Unknown operators and malformed lists raise ValueError when compiling.
    """
    parts: list[Column] = []
    seen: set[str] = set()
    for name, value in (spec or {}).items():
        name = LOGIC.get(name, name)
        if name in seen:
            continue
        seen.add(name)
        if name in ("AND", "OR", "NOT"):
            if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
                raise ValueError(f"{name} takes a list of filters")
            subs = [compile_filter(x, column, first_only, keys, strict) for x in value]
            if name == "OR":
                parts.append(reduce(lambda a, b: a | b, subs, F.lit(False)))
            else:
                parts += [~s for s in subs] if name == "NOT" else subs
            continue
        if keys is not None and name not in keys or not re.fullmatch(r"[A-Za-z_][\w.]*", name):
            raise ValueError(f"no such field: {name}")
        col = column(name)
        if isinstance(value, dict):
            bad = set(value) - set(OPERATORS)
            if bad or not value:
                raise ValueError(f"unknown operators: {sorted(bad)}")
            ops = [op for op in OPERATORS if op in value]
            if strict and {"gt", "gte", "lt", "lte"} & set(ops) and not set(ops) <= {"gt", "gte", "lt", "lte"}:
                raise ValueError(f"{name}: range operators do not mix with others")
            parts += [_condition(col, op, value[op]) for op in (ops[:1] if first_only else ops)]
        elif isinstance(value, (list, tuple)):
            parts.append(_condition(col, "in", value))
        elif value == "*":
            parts.append(F.lit(True))
        else:
            parts.append(_condition(col, "eq", value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def payload_field(payload: str = "payload", kind: str = "string"):
    """Field accessor for a JSON text column; members that do not cast to ``kind`` are missing."""
    return lambda name: F.get_json_object(payload, f"$.{name}").try_cast(kind)


def not_expired(expiry: Column, today: dt.date | str) -> Column:
    """Rows that have not expired on ``today``; a missing or malformed day never expires."""
    day = F.when(expiry.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(expiry, "yyyy-MM-dd"))
    return F.coalesce(day >= F.lit(str(today)).cast("date"), F.lit(True))


def check_search(top_k: Any, threshold: Any = None) -> None:
    """Raise ValueError unless top_k is a whole number of at least 0 and threshold lies in 0 to 1."""
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 0:
        raise ValueError("top_k must be a whole number, 0 or more")
    if threshold is not None and not (isinstance(threshold, (int, float)) and 0 <= threshold <= 1):
        raise ValueError("threshold must lie between 0 and 1")


def identity_scope(user_id: str | None = None, agent_id: str | None = None, run_id: str | None = None) -> dict[str, str]:
    """Filter by identity: at least one id, trimmed, without inner white space."""
    out = {}
    for name, v in (("user_id", user_id), ("agent_id", agent_id), ("run_id", run_id)):
        if v is None:
            continue
        if not v.strip() or re.search(r"\s", v.strip()):
            raise ValueError(f"{name} must be a word")
        out[name] = v.strip()
    if not out:
        raise ValueError("one of user_id, agent_id, run_id is needed")
    return out
