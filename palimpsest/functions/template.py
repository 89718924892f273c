"""Text templates compiled to a Column: ``{key:spec}`` with width, alignment and precision."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that stand for a character (fixed values).
STATIC = {"LF": "\n", "NL": "\n", "NEWLINE": "\n", "SPACE": " ", "TAB": "\t", "CR": "\r", "NUL": "\0"}
_SPEC = re.compile(r"^(?:(?P<fill>.)?(?P<align>[<>^]))?(?P<width>[0-9]+)?(?:\.(?P<precision>[0-9]+))?$")


def fields(template: str) -> list[tuple[str, str, str]]:
    """(literal before, key, spec) of every field; a last one with an empty key holds the rest."""
    out, literal, i = [], [], 0
    while i < len(template):
        c = template[i]
        if template[i : i + 2] in ("{{", "}}"):
            literal.append(c)
            i += 2
        elif c == "{":
            end = template.find("}", i)
            if end < 0:
                raise ValueError("unmatched { in template")
            key, _, spec = template[i + 1 : end].partition(":")
            if not key or "!" in key or "{" in key:
                raise ValueError(f"bad field {template[i : end + 1]!r}")
            out.append(("".join(literal), key, spec))
            literal, i = [], end + 1
        elif c == "}":
            raise ValueError("unmatched } in template")
        else:
            literal.append(c)
            i += 1
    return [*out, ("".join(literal), "", "")]


def keys(template: str) -> list[str]:
    """Columns that a template needs, so that others are never computed."""
    return list(dict.fromkeys(k for _, k, _ in fields(template) if k and k not in STATIC))


def formatted(value: Column, spec: str, numeric: bool) -> Column:
    """A value under a format spec; width counts code points and never cuts."""
    m = _SPEC.match(spec)
    if not m:
        raise ValueError(f"bad format spec {spec!r}")
    text = value.cast("string")
    if m["precision"] is not None:
        if numeric:
            raise ValueError("a precision is for text only")
        text = F.left(text, F.lit(int(m["precision"])))
    if not m["width"]:
        return text
    width, fill = int(m["width"]), m["fill"] or " "
    missing = F.greatest(F.lit(width) - F.length(text), F.lit(0))
    align = m["align"] or (">" if numeric else "<")
    pad = lambda n: F.repeat(F.lit(fill), n)
    if align == "<":
        return F.concat(text, pad(missing))
    if align == ">":
        return F.concat(pad(missing), text)
    left = F.floor(missing / 2).cast("int")
    return F.concat(pad(left), text, pad(missing - left))


def compiled(template: str, values: Mapping[str, Column], numeric: frozenset[str] = frozenset()) -> Column:
    """One string Column for a whole template."""
    out = []
    for literal, key, spec in fields(template):
        if literal:
            out.append(F.lit(literal))
        if key in STATIC:
            out.append(F.lit(STATIC[key]))
        elif key:
            if key not in values:
                raise ValueError(f"unknown key {key!r}")
            out.append(formatted(F.coalesce(values[key].cast("string"), F.lit("")) if not spec else values[key], spec, key in numeric))
    return F.concat(*out) if out else F.lit("")


def rendered(rows: DataFrame, template: str) -> DataFrame:
    """``line`` for each row; columns are the keys, numbers align right."""
    wanted = keys(template)
    numbers = frozenset(f.name for f in rows.schema.fields if f.dataType.typeName() in ("integer", "long", "short", "byte", "double", "float", "decimal"))
    return rows.select(compiled(template, {k: F.col(f"`{k}`") for k in wanted}, numbers).alias("line"))


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object per row, in column order, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def placeholders(text: str, values: Mapping[str, str]) -> str:
    """{name} and {name:format} in archive names; {{ and }} are literal braces."""
    out = []
    for literal, key, spec in fields(text):
        out.append(literal)
        if key:
            if key not in values:
                raise ValueError(f"unknown placeholder {key!r}")
            value = values[key]
            out.append(value.strftime(spec or "%Y-%m-%dT%H:%M:%S") if hasattr(value, "strftime") else str(value))
    return "".join(out)
