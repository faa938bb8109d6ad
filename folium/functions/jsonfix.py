"""Finding and mending JSON in model output."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def list_slice(c: Column) -> Column:
    """From the first [ to the last ], or else the whole text."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)\[.*\]", 0), F.lit("")), c)


def parse_list(c: Column) -> Column:
    """The JSON of a text answer as a variant; null if it doesn't parse."""
    return F.try_parse_json(list_slice(c))


def parse_fenced(c: Column) -> Column:
    """The JSON of a fenced block; without one, of the bracketed part. A fence that doesn't parse gives null."""
    block = F.regexp_extract(c, r"(?s)```json\s*(.*?)\s*```", 1)
    return F.when(c.contains("```json"), F.try_parse_json(block)).otherwise(parse_list(c))


def completion_list(c: Column) -> Column:
    """The bracketed list after a closing think tag, if every element has a name and a list of texts."""
    text = F.nullif(F.regexp_extract(c, r"(?s)</think>[^\[]*(\[.*\])", 1), F.lit(""))
    rows = F.from_json(text, "array<struct<name:string,affiliations:array<string>>>")
    shape = F.schema_of_variant(F.try_parse_json(text))
    good = shape.rlike(r"^ARRAY<OBJECT<affiliations: ARRAY<(STRING|VOID)>, name: STRING>>$|^ARRAY<VOID>$")
    return F.when(good, rows)


def truncated(text: str) -> bool:
    """Whether a list's text lacks its end or its beginning: brackets and braces outside strings must match at every place."""
    t = text.strip()
    if not (t.startswith("[") and t.endswith("]")):
        return True
    depth = {"[": 0, "{": 0}
    for sign in _outside_strings(t):
        if sign in depth:
            depth[sign] += 1
            continue
        opened = "[" if sign == "]" else "{"
        depth[opened] -= 1
        if depth[opened] < 0:
            return True
    return any(depth.values())


def _outside_strings(t: str):
    """Brackets and braces outside strings; a backslash takes the next sign with it, outside strings too."""
    inside = skip = False
    for ch in t:
        if skip:
            skip = False
        elif ch == "\\":
            skip = True
        elif ch == '"':
            inside = not inside
        elif not inside and ch in "[]{}":
            yield ch


def escape_strays(t: str) -> str:
    """Escapes raw line ends inside strings, and quotes that can't end one since no sign of JSON follows."""
    out, inside, i = [], False, 0
    while i < len(t):
        ch = t[i]
        if inside and ch == "\\":
            out.append(t[i : i + 2])
            i += 2
            continue
        if ch == '"':
            rest = t[i + 1 :].lstrip()
            if inside and rest and rest[0] not in ",:}]":
                out.append('\\"')
            else:
                inside = not inside
                out.append(ch)
        elif inside and ch in "\n\r":
            out.append("\\n" if ch == "\n" else "\\r")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


_BAD_ESCAPE = re.compile(r'\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})')
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def mend(text: str | None) -> tuple[str | None, str | None]:
    """(valid JSON text, None) or (None, reason): the first of several repairs that parses.

    The text as it is, strictly and then with raw control characters allowed; the same of the text
    with stray quotes and line ends escaped; that text with bad escapes mended, with control
    characters blanked, and with both, strictly.
    """
    if text is None:
        return None, "missing"
    if truncated(text):
        return None, "truncated"
    clean = escape_strays(text)
    slashes = lambda t: _BAD_ESCAPE.sub(r"\\\\", t)
    blanks = lambda t: _CONTROL.sub(" ", t)
    tries = [(text, True), (text, False)]
    tries += [(clean, True), (clean, False)] if clean != text else []
    tries += [(slashes(clean), True), (blanks(clean), True), (blanks(slashes(clean)), True)]
    reason = "unparsed"
    for t, strict in tries:
        try:
            return json.dumps(json.loads(t, strict=strict), ensure_ascii=False), None
        except ValueError as e:
            reason = str(e)
    return None, reason


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())]))
def repair(s: pd.Series) -> pd.DataFrame:
    """Repaired text, ready for try_parse_json, or why there is none."""
    return pd.DataFrame([mend(x) for x in s], columns=["json", "error"])
