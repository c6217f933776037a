"""Dates and relative times in text, resolved to half-open intervals by native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()

_M = "(" + "|".join(MONTHS) + ")"
_Y = "((?:19|20)[0-9]{2})"


def _date(y: Column, m: Column, d: Column) -> Column:
    """A calendar day or null (never a rolled-over one)."""
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def _number(month: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(month)).cast("string")


# Forms of a date, in the order in which they are looked for, with their precision and the
# groups of year, month and day.
FORMS = (
    (rf"(?<![0-9A-Za-z_]){_Y}-([0-9]{{2}})-([0-9]{{2}})(?=T|[^0-9A-Za-z_]|$)", "day", 1, 2, 3),
    (rf"{_Y}年([0-9]{{1,2}})月([0-9]{{1,2}})日", "day", 1, 2, 3),
    (rf"(?i)\b{_M}\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+{_Y}\b", "day", 3, 1, 2),
    (rf"(?i)\b([0-9]{{1,2}})(?:st|nd|rd|th)?\s+{_M},?\s+{_Y}\b", "day", 3, 2, 1),
    (rf"(?i)\b{_M}\s+{_Y}\b", "month", 2, 1, None),
    (rf"\b{_Y}-([0-9]{{2}})\b", "month", 1, 2, None),
    (rf"{_Y}年([0-9]{{1,2}})月", "month", 1, 2, None),
    (rf"(?<![0-9A-Za-z_]){_Y}(?=年|[^0-9A-Za-z_]|$)", "year", 1, None, None),
)


def with_absolute(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name`` = struct(start, precision) of the first date form in a text column.

    A form that names no real day has a precision but no start; a text without any form has neither. Each step is a
    column of its own, so that the generated code stays small.
    """
    form, parts = f"_{name}_form", f"_{name}_parts"
    code = None
    for n, (p, *_) in enumerate(FORMS):
        hit = F.col(text).rlike(p)
        code = F.when(hit, n) if code is None else code.when(hit, n)
    take = None
    for n, (p, _, *groups) in enumerate(FORMS):
        found = F.array(*[F.lit("1") if g is None else F.regexp_extract(text, p, g) for g in groups])
        take = F.when(F.col(form) == n, found) if take is None else take.when(F.col(form) == n, found)
    precision = F.element_at(F.array(*[F.lit(f[1]) for f in FORMS]), F.col(form) + 1)
    y, m, d = (F.col(parts)[k] for k in range(3))
    month = F.coalesce(F.nullif(_number(m), F.lit("0")), m)
    out = df.withColumn(form, code).withColumn(parts, take)
    out = out.withColumn(name, F.struct(_date(y, month, d).alias("start"), F.when(F.col(form).isNotNull(), precision).alias("precision")))
    return out.drop(form, parts)


def interval_end(start: Column, precision: Column) -> Column:
    """First day after the interval that begins at ``start``."""
    return (
        F.when(precision == "year", F.add_months(start, 12))
        .when(precision == "month", F.add_months(start, 1))
        .when(precision == "week", F.date_add(start, 7))
        .otherwise(F.date_add(start, 1))
    )


def with_resolution(df: DataFrame, expression: str, anchor: str, into: str) -> DataFrame:
    """Adds ``into`` = struct(start, end_exclusive, precision, resolution) of a time expression column.

    ``anchor`` is the text that dates the source ("1 March 2024"); relative expressions resolve
    against it if it names a day. A range of years, an unknown expression or a missing anchor is
    ``unresolved``, an anchor that only orders messages gives ``ordering``.
    """
    df = with_absolute(with_absolute(df.withColumn("_x", F.lower(F.trim(expression))), expression, "_exact"), anchor, "_base")
    df = df.withColumn("_day", F.when(F.col("_base.precision") == "day", F.col("_base.start")))
    text, day, exact = F.col("_x"), F.col("_day"), F.col("_exact")
    part = "(?: (?:morning|afternoon|evening|night))?"
    num = lambda p: F.regexp_extract(text, p, 1).try_cast("int")
    shift = (
        F.when(text.rlike(f"^yesterday{part}$|^昨天(?:上午|下午|晚上)?$"), -1)
        .when(text.rlike(f"^today{part}$|^今天(?:上午|下午|晚上)?$"), 0)
        .when(text.rlike(f"^tomorrow{part}$|^明天(?:上午|下午|晚上)?$"), 1)
        .when(text.rlike("^[0-9]{1,3} days? ago$|^[0-9]{1,3}天前$"), -num("^([0-9]{1,3})"))
        .when(text.rlike("^in [0-9]{1,3} days?$|^[0-9]{1,3}天后$"), num("([0-9]{1,3})"))
    )
    which, name = F.regexp_extract(text, "^(last|this|next) ", 1), F.regexp_extract(text, "^(?:last|this|next) (.*)$", 1)
    now = F.weekday(day)
    gap = F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), name).cast("int") - 1 - now
    gap = F.when((which == "last") & (gap >= 0), gap - 7).when((which == "next") & (gap <= 0), gap + 7).otherwise(gap)
    shift = shift.when(name.isin(WEEKDAYS), gap)
    zh = F.create_map(*[F.lit(x) for k, v in {"上周": "last week", "本周": "this week", "下周": "next week", "上个月": "last month", "这个月": "this month", "下个月": "next month", "去年": "last year", "今年": "this year", "明年": "next year"}.items() for x in (k, v)])
    period = F.coalesce(F.try_element_at(zh, text), text)
    step = F.when(period.startswith("last "), -1).when(period.startswith("next "), 1).otherwise(0)
    unit = F.regexp_extract(period, "^(?:last|this|next) (week|month|year)$", 1)
    moved = (
        F.when(unit == "year", F.add_months(F.trunc(day, "year"), 12 * step))
        .when(unit == "month", F.add_months(F.trunc(day, "month"), step))
        .when(unit == "week", F.date_add(F.trunc(day, "week"), 7 * step))
    )
    years = text.rlike(r"\b(?:between|through|until|or|to)\b|至|到") & text.rlike(r"\b(?:19|20)[0-9]{2}\b")
    order = F.coalesce(F.col(anchor), F.lit("")).rlike("(?i)synthetic ordering")
    df = df.withColumn("_shift", shift).withColumn("_moved", moved).withColumn("_unit", unit).withColumn("_years", years).withColumn("_order", order)
    relative = F.coalesce(F.date_add("_day", F.col("_shift")), F.col("_moved"))
    start = F.when(F.col("_years"), None).when(exact["precision"].isNotNull() & exact["start"].isNotNull(), exact["start"]).when(F.col("_order"), None).otherwise(relative)
    kind = F.when(exact["start"].isNotNull(), exact["precision"]).when(F.col("_shift").isNotNull(), "day").otherwise(F.col("_unit"))
    df = df.withColumn("_start", start).withColumn("_kind", kind)
    done = F.col("_start").isNotNull()
    waits = F.col("_order") & ~F.col("_years") & (F.col("_x") != "")
    out = F.struct(
        F.col("_start").alias("start"), F.when(done, interval_end(F.col("_start"), F.col("_kind"))).alias("end_exclusive"),
        F.when(done, F.col("_kind")).otherwise("unknown").alias("precision"),
        F.when(done, "resolved").when(waits, "ordering").otherwise("unresolved").alias("resolution"),
    )
    return df.withColumn(into, out).drop("_x", "_exact", "_base", "_day", "_shift", "_moved", "_unit", "_years", "_order", "_start", "_kind")
