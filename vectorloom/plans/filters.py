"""Row filters of change capture: comparisons joined by AND, as a Column.

``a IS [NOT] NULL``, ``a = x``, ``a != x`` or ``a <> x``; x is a 'text', a number, true or false. A missing column
counts as null, and a comparison with null is false.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectorloom.errors import InvalidArgument

_TERM = re.compile(
    r"""\s*(?P<col>[A-Za-z_][A-Za-z0-9_.]*)\s*(?:
        (?P<null>IS\s+(?P<not>NOT\s+)?NULL)
      | (?P<op>=|!=|<>)\s*(?:'(?P<text>(?:[^']|'')*)'|(?P<bool>true|false)\b|(?P<num>[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[-+]?[0-9]+)?))
    )\s*""",
    re.IGNORECASE | re.VERBOSE,
)
_AND = re.compile(r"AND\b", re.IGNORECASE)


def parse(text: str) -> list[tuple[str, str, object]]:
    """(column, operator, literal) of each term; operators are ``null``, ``not null``, ``=`` and ``!=``."""
    terms, at = [], 0
    while True:
        m = _TERM.match(text, at)
        if not m:
            raise InvalidArgument(f"can't read the filter at {text[at:]!r}")
        if m["null"]:
            terms.append((m["col"], "not null" if m["not"] else "null", None))
        else:
            value = m["text"].replace("''", "'") if m["text"] is not None else m["bool"].lower() == "true" if m["bool"] else float(m["num"])
            terms.append((m["col"], "=" if m["op"] == "=" else "!=", value))
        at = m.end()
        if at == len(text):
            return terms
        joint = _AND.match(text, at)
        if not joint:
            raise InvalidArgument(f"expected AND at {text[at:]!r}")
        at = joint.end()


def _equal(col: Column, value: object, kind: str) -> Column:
    if isinstance(value, str):
        return col == value if kind == "string" else F.lit(False)
    if isinstance(value, bool):
        if kind == "boolean":
            return col == value
        return F.lower(col).isin("t", "true") == value if kind == "string" else F.lit(False)
    if kind == "boolean":
        return F.lit(False)
    return col.cast("string").try_cast("double") == value


def predicate(text: str, types: dict[str, str], column=F.col) -> Column:
    """The filter as a Column that is never null; ``types`` has each present column's Spark type."""
    out = F.lit(True)
    for name, op, value in parse(text):
        kind = types.get(name)
        col = column(name) if kind else F.lit(None).cast("string")
        if op in ("null", "not null"):
            term = col.isNull() if op == "null" else col.isNotNull()
        else:
            equal = _equal(col, value, kind or "string")
            known = F.coalesce(equal, F.lit(False))
            term = known if op == "=" else col.isNotNull() & ~known
        out = out & term
    return out
