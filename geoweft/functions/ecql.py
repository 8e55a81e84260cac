"""ECQL filters and expressions as Spark SQL.

Most of the language is SQL already; what differs is rewritten outside string literals: ``<>`` and
``!=``, ``LIKE``, ``IN``, ``BETWEEN``, ``IS NULL``, arithmetic and AND/OR/NOT stay, ``INCLUDE`` and
``EXCLUDE`` become constants, ``BBOX(geom, ...)`` and ``DWITHIN`` become comparisons on x and y,
``BEFORE``, ``AFTER`` and ``DURING`` become comparisons of times, and ``strConcat``-like function names are mapped.
"""

from __future__ import annotations

import re

# Function names that differ.
FUNCTIONS = {"strConcat": "concat", "strToUpperCase": "upper", "strToLowerCase": "lower", "strTrim": "trim", "strLength": "length", "strReplace": "regexp_replace", "strSubstring": "substring", "parseDouble": "double", "parseInt": "int", "abs_2": "abs", "ceil": "ceil", "floor": "floor", "if_then_else": "if", "isNull": "isnull", "pow": "power", "toDegrees": "degrees", "toRadians": "radians"}
_NUMBER = r"\s*(-?[\d.]+(?:[eE][-+]?\d+)?)\s*"


def to_sql(text: str, x: str = "x", y: str = "y") -> str:
    parts = re.split(r"('(?:[^']|'')*')", text)
    out = []
    for i, p in enumerate(parts):
        if i % 2:
            out.append(p)
            continue
        p = re.sub(r"\bINCLUDE\b", "true", p, flags=re.I)
        p = re.sub(r"\bEXCLUDE\b", "false", p, flags=re.I)
        p = re.sub(rf"\bBBOX\s*\(\s*\w+\s*,{_NUMBER},{_NUMBER},{_NUMBER},{_NUMBER}\)", lambda m: f"({x} BETWEEN {m[1]} AND {m[3]} AND {y} BETWEEN {m[2]} AND {m[4]})", p, flags=re.I)
        p = re.sub(rf"\bDWITHIN\s*\(\s*\w+\s*,\s*POINT\s*\({_NUMBER}\s+{_NUMBER}\)\s*,{_NUMBER}(?:,\s*\w+\s*)?\)", lambda m: f"(hypot({x} - {m[1]}, {y} - {m[2]}) <= {m[3]})", p, flags=re.I)
        p = re.sub(r"\b(\w+)\s+BEFORE\s+([\d:TZ-]+)", r"\1 < timestamp'\2'", p, flags=re.I)
        p = re.sub(r"\b(\w+)\s+AFTER\s+([\d:TZ-]+)", r"\1 > timestamp'\2'", p, flags=re.I)
        p = re.sub(r"\b(\w+)\s+DURING\s+([\d:TZ-]+)/([\d:TZ-]+)", r"(\1 > timestamp'\2' AND \1 < timestamp'\3')", p, flags=re.I)
        for old, new in FUNCTIONS.items():
            p = re.sub(rf"\b{old}\s*\(", f"{new}(", p)
        out.append(re.sub(r'"(\w+)"', r"`\1`", p))
    return "".join(out)
