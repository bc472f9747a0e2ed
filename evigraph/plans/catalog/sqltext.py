"""SQL fragments shared by the comparison queries."""

from ...functions.text import STOP_WORDS, WHITESPACE

SPACE = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def norm(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({x}), '[a-z0-9]+'), ' ')"


def tokens(x: str) -> str:
    return (f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-zA-Z0-9_-]+')), "
            f"lambda t: length(t) > 1 and not list_contains([{_STOP}], t))")


def l2(a: str, b: str) -> str:
    return (f"list_sum(list_transform(list_zip({a}, {b}), "
            f"lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))")


def dot(a: str, b: str) -> str:
    return (f"list_sum(list_transform(list_zip({a}, {b}), "
            f"lambda p: p[1]::DOUBLE * p[2]::DOUBLE))")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    """An inline table ``(VALUES …) AS t(columns)``."""
    def cell(v):
        if v is None:
            return "NULL"
        return quoted(v) if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({columns})"
