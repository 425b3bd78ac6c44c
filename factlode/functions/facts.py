"""Typed facts from statements: closed properties, values in one unit, and their comparison.

A fact is a struct (property, subject, value_num, value_str, value_bool, unit, value_type, raw). What no pattern matches gives no
fact; a unit is never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of one property, factors of units, words for truth values, types with other spellings.
PROPERTIES = {
    "timeout": "timeout", "time-out": "timeout",
    "latency": "latency", "maximum latency": "latency", "max latency": "latency", "response time": "latency",
    "acceptance threshold": "latency", "threshold": "latency",
    "retries": "retries", "retry count": "retries", "maximum retries": "retries", "max retries": "retries",
    "attempts": "retries", "maximum attempts": "retries",
}
DURATIONS = {
    "ms": 1, "msec": 1, "millisecond": 1, "milliseconds": 1,
    "s": 1000, "sec": 1000, "second": 1000, "seconds": 1000,
    "min": 60000, "minute": 60000, "minutes": 60000,
}
TRUTH = {
    "true": True, "yes": True, "enabled": True, "on": True, "mandatory": True,
    "false": False, "no": False, "disabled": False, "off": False, "optional": False,
}
TYPES = {"int": "integer", "int4": "integer", "bool": "boolean", "float": "decimal", "double": "decimal", "numeric": "decimal"}
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}

# Patterns of the fact families.
DURATION = (
    r"(?i)\b(timeout|time-out|latency|maximum latency|max latency|response time|acceptance threshold|threshold)\b"
    r"(?:\s+(?:is|of|=|:)?\s*|\s+(?:must|shall)?\s*(?:be|answer|complete|respond)?\s*(?:within)?\s+)"
    r"(\d+(?:\.\d+)?)\s*(ms|msec|milliseconds?|s|sec|seconds?|min|minutes?)?\b"
)
COUNT = r"(?i)\b(?:(maximum|max)\s+)?(retries|retry count|attempts)\b\s*(?:is|of|=|:)?\s*(\d+)\b"
RETRIED = r"(?i)\bretried\s+(\d+|one|two|three|four|five)\s+times?\b"
ENDPOINT = r"\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/[A-Za-z0-9_\-./{}]*)"
CONFIG = r"(?<![\w.])([a-z][a-z0-9_-]*(?:\.[a-z0-9_-]+)+)\s*=\s*([A-Za-z0-9._\-]+)"
FIELD_TYPE = r"(?i)\b(?:column|field)\s+([A-Za-z_][A-Za-z0-9_]*)\s+(?:is|has type|type)\s+([A-Za-z]+(?:\(\d+(?:,\s*\d+)?\))?)"
OBLIGATION = r"(?i)\b([a-z][a-z0-9_.-]{2,})\s+(?:is|must be)\s+(enabled|disabled|true|false|on|off|mandatory|optional)\b"

_FACT = "struct<property:string,subject:string,value_num:double,value_str:string,value_bool:boolean,unit:string,value_type:string,raw:string>"


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def normalize_property(name: Column) -> Column:
    """One name for a property's spellings."""
    clean = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    return F.coalesce(F.try_element_at(_map(PROPERTIES), clean), clean)


def normalize_path(path: Column) -> Column:
    """An API path with single slashes and none at its end."""
    clean = F.regexp_replace(F.trim(path), "/{2,}", "/")
    return F.regexp_replace(clean, "(?<=.)/$", "")


def normalize_type(name: Column) -> Column:
    """A data type's usual spelling; parameters stay."""
    clean = F.lower(F.trim(name))
    base, rest = F.regexp_extract(clean, r"^([a-z]+)(\(.*\))?$", 1), F.regexp_extract(clean, r"^([a-z]+)(\(.*\))?$", 2)
    return F.when(base == "", clean).otherwise(F.concat(F.coalesce(F.try_element_at(_map(TYPES), base), base), rest))


def _fact(prop: Column, kind: Column, raw: Column, subject=None, num=None, text=None, flag=None, unit=None) -> Column:
    none = lambda t: F.lit(None).cast(t)
    return F.struct(
        prop.alias("property"), (none("string") if subject is None else subject).alias("subject"), (none("double") if num is None else num.cast("double")).alias("value_num"),
        (none("string") if text is None else text).alias("value_str"), (none("boolean") if flag is None else flag).alias("value_bool"),
        (F.lit("") if unit is None else unit).alias("unit"), kind.alias("value_type"), raw.alias("raw"),
    )


def _groups(text: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in range(1, n + 1)]


def literal(raw: Column) -> dict[str, Column]:
    """Type and value of a bare literal: boolean, integer, decimal or identifier."""
    truth = F.try_element_at(_map(TRUTH), F.lower(raw))
    number = raw.rlike(r"^-?\d+$") | raw.rlike(r"^-?\d+\.\d+$")
    return {
        "kind": F.when(truth.isNotNull(), "boolean").when(raw.rlike(r"^-?\d+$"), "integer").when(number, "decimal").otherwise("identifier"),
        "num": F.when(truth.isNull() & number, raw.try_cast("double")),
        "flag": truth,
        "text": F.when(truth.isNull() & ~number, raw),
    }


def facts(statement: Column) -> Column:
    """All facts of a statement, family by family, in order of appearance."""
    s = F.coalesce(statement, F.lit(""))
    out = []
    for pattern, n, build in (
        (DURATION, 3, _duration), (COUNT, 3, lambda m, p, v: _fact(normalize_property(p), F.lit("count"), v, num=v.try_cast("double"))),
        (RETRIED, 1, lambda v: _fact(F.lit("retries"), F.lit("count"), v, num=F.coalesce(F.try_element_at(_map(NUMBERS), F.lower(v)).cast("double"), v.try_cast("double")))),
        (ENDPOINT, 2, lambda m, p: _fact(F.lit("http-method"), F.lit("http-method"), F.concat_ws(" ", m, p), subject=normalize_path(p), text=m)),
        (CONFIG, 2, _config), (FIELD_TYPE, 2, lambda f, t: _fact(F.lit("data-type"), F.lit("data-type"), t, subject=F.lower(f), text=normalize_type(t))),
        (OBLIGATION, 2, lambda n, v: F.when(~F.lower(n).isin("it", "this", "that"), _fact(F.lit("boolean-obligation"), F.lit("boolean"), v, subject=F.lower(n), flag=F.try_element_at(_map(TRUTH), F.lower(v))))),
    ):
        groups = _groups(s, pattern, n)
        index = F.transform(groups[0], lambda _, i: i)
        out.append(_each(index, groups, build))
    return F.filter(F.concat(*out), lambda f: f.isNotNull())


def _each(index: Column, groups: list[Column], build) -> Column:
    return F.transform(index, lambda i: build(*[F.get(g, i) for g in groups]).cast(_FACT))


def _duration(prop: Column, number: Column, unit: Column) -> Column:
    with_unit = unit != ""
    factor = F.try_element_at(_map(DURATIONS), F.lower(unit))
    value = F.when(with_unit, number.cast("double") * factor).otherwise(number.cast("double"))
    return _fact(normalize_property(prop), F.when(with_unit, "duration").otherwise("integer"), F.concat_ws(" ", number, F.when(with_unit, unit)), num=value, unit=F.when(with_unit, "ms").otherwise(""))


def _config(key: Column, raw: Column) -> Column:
    v = literal(raw)
    return _fact(F.lit("configuration-value"), v["kind"], raw, subject=F.lower(key), num=v["num"], text=v["text"], flag=v["flag"])


def compare(a: str, b: str) -> Column:
    """'equal', 'different' or 'not-comparable' for the fact columns of two aliases."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    bare = x("value_type").isin("integer", "count") & y("value_type").isin("integer", "count")
    same_kind = (x("value_type") == y("value_type")) | bare
    equal = x("value_num").eqNullSafe(y("value_num")) & x("value_str").eqNullSafe(y("value_str")) & x("value_bool").eqNullSafe(y("value_bool"))
    return F.when((x("property") != y("property")) | ~same_kind | (x("unit") != y("unit")), "not-comparable").when(equal, "equal").otherwise("different")
