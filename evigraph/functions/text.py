"""Scalar text functions as column expressions (no Python in the row path)."""

from __future__ import annotations

import json
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that Unicode-aware stripping removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Words that carry no evidence when a question is compared with a text.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "how", "in", "is", "it", "of", "on", "or", "that", "the", "this",
    "to", "was", "what", "when", "where", "which", "with",
]


def strip(c) -> Column:
    """Strip Unicode white space on both ends; ``trim`` alone only knows the ASCII space."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def or_empty(c) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def normalize(c) -> Column:
    """Lower-case ASCII alphanumeric tokens joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), " ")


def important_tokens(c) -> Column:
    """Distinct lower-case tokens longer than one character that are not stop words."""
    found = F.array_distinct(
        F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z0-9_-]+"), 0)
    )
    kept = F.array_except(found, F.array(*[F.lit(w) for w in STOP_WORDS]))
    return F.filter(kept, lambda t: F.length(t) > 1)


def name_key(c) -> Column:
    """Trimmed lower-case name with '-' and ' ' written as '_'."""
    return F.translate(F.lower(strip(c)), "- ", "__")


def normalize_list(c) -> Column:
    """Normalised, distinct, sorted names of an array column; NULL becomes empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(
        F.array_distinct(F.transform(F.coalesce(c, empty), name_key))
    )


def source_stem(c) -> Column:
    """Path separators to '_' and the last extension removed."""
    return F.regexp_replace(F.translate(c, "\\/", "__"), r"\.[^.]*$", "")


def file_name(c) -> Column:
    flat = F.regexp_replace(F.translate(c, "\\", "/"), "/+$", "")
    return F.element_at(F.split(flat, "/"), -1)


def extension(c) -> Column:
    """Lower-cased extension with its dot, or '' (a leading dot is part of the name)."""
    return F.lower(F.regexp_extract(file_name(c), r"^.+(\.[^./]+)$", 1))


def sha256(c) -> Column:
    return F.sha2(c, 256)


def json_or_default(c, schema: str, default: Column) -> Column:
    """Decode JSON text; blank or malformed text gives ``default``."""
    return F.coalesce(F.when(~is_blank(c), F.from_json(c, schema)), default)


def age_seconds(ts: Column, as_of: Column) -> Column:
    """Seconds from ``ts`` to ``as_of`` with sub-second precision."""
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(1_000_000.0)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once.

    A lambda that names an outer expression evaluates it again for every element; inside
    ``body`` the value is a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def matching_rules(text: Column, needles: list[str], words: bool = False) -> Column:
    """Positions of the needles that occur in ``text``, in rising order.

    Needles match as substrings, with ``words`` only where no letter, digit or ``_`` stands on
    either side. One automaton over all needles reads each text once, so the cost does not
    depend on how many there are.
    """
    places: dict[str, list[int]] = {}
    for n, needle in enumerate(needles):
        places.setdefault(needle, []).append(n)
    empty = places.pop("", [])

    def stands_alone(value: str, end: int, size: int) -> bool:
        before, behind = value[end - size:end - size + 1], value[end + 1:end + 2]
        return not (before.isalnum() or before == "_" or behind.isalnum() or behind == "_")

    @F.pandas_udf("array<int>")
    def find(texts: pd.Series) -> pd.Series:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for needle, numbers in places.items():
            machine.add_word(needle, (len(needle), numbers))
        machine.make_automaton()
        out = []
        for value in texts:
            found = set() if value is None else set(empty)
            if value and places:
                for end, (size, numbers) in machine.iter(value):
                    if not words or stands_alone(" " + value, end + 1, size):
                        found.update(numbers)
            out.append(sorted(found))
        return pd.Series(out, dtype=object)

    return find(text)


def matching_names(text: Column, pairs: list[tuple[str, str]], words: bool = False) -> Column:
    """Sorted distinct names of the (name, needle) pairs whose needle is in ``text``."""
    if not pairs:
        return F.array().cast("array<string>")
    names = _constant_list([name for name, _ in pairs], "array<string>")
    hits = matching_rules(text, [needle for _, needle in pairs], words)
    return F.array_sort(F.array_distinct(F.transform(hits, lambda n: F.get(names, n))))


def _constant_list(values: list, kind: str) -> Column:
    """One literal that the optimizer folds, instead of one for each value."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def leading_literal(pattern: str) -> str:
    """Text that every match of ``pattern`` starts with, or '' when that is not plain.

    Searching for it first keeps the regular expression away from most texts.
    """
    if re.search(r"[(]\?[a-zA-Z]", pattern) or "|" in re.sub(r"\([^()]*\)", "", pattern):
        return ""
    found = re.match(r"(?:\\b)?([A-Za-z0-9 _-]+)", pattern)
    if not found:
        return ""
    rest = pattern[found.end():]
    return found.group(1)[:-1] if rest[:1] in ("?", "*", "{") else found.group(1)


# --- HTML -------------------------------------------------------------------

_SKIPPED = r"(?is)<(script|style|svg|noscript)(?=[\s/>]).*?(?:</\1\s*>|\z)"
_COMMENT_OR_TAG = r"(?s)<!--.*?(?:-->|\z)|<[!?/a-zA-Z][^>]*+>"
_MAIN = r"(?is)<main(?=[\s/>])[^>]*>(.*?)(?:</main\s*>|\z)"

# Names allowed without a closing semicolon come from the HTML5 table of the standard library.
_NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
_BARE = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))


# Code points 128-159 are read as Windows-1252, as browsers do.
_WINDOWS = {
    str(n): bytes([n]).decode("cp1252")
    for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
}


def _constant_map(entries: dict[str, str]) -> Column:
    """One literal that the optimizer folds, instead of thousands of key and value literals."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _code_point(digits: Column, base: int) -> Column:
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    # more digits than any code point has are out of range whatever they say
    n = F.when(F.length(plain) <= 8, F.conv(plain, base, 10).cast("long")).otherwise(F.lit(0x110000))
    bad = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    windows = _constant_map(_WINDOWS)[n.cast("string")]
    return (F.when(bad, F.lit("\ufffd"))
            .when(windows.isNotNull(), windows)
            .otherwise(wide))


def unescape_html(c: Column) -> Column:
    """Decode character references in one left-to-right pass."""
    names = _constant_map(_NAMED)
    bare_names = _constant_map({k: html5[k] for k in _BARE})

    def decode(part: Column) -> Column:
        named = F.regexp_extract(part, "^&([a-zA-Z][a-zA-Z0-9]*);", 1)
        bare = F.regexp_extract(part, "^&(" + "|".join(_BARE) + ")", 1)
        dec = F.regexp_extract(part, "^&#([0-9]+);?", 1)
        hexa = F.regexp_extract(part, "^&#[xX]([0-9a-fA-F]+);?", 1)
        rest = F.regexp_replace(part, "^&#?[a-zA-Z0-9]+;?", "")
        value = names[named]
        return (
            F.when(~part.startswith("&"), part)
            .when(dec != "", F.concat(_code_point(dec, 10),
                                      F.regexp_replace(part, "^&#[0-9]+;?", "")))
            .when(hexa != "", F.concat(_code_point(hexa, 16),
                                       F.regexp_replace(part, "^&#[xX][0-9a-fA-F]+;?", "")))
            .when((named != "") & value.isNotNull(), F.concat(value, rest))
            .when(bare != "", F.concat(bare_names[bare], F.substr(part, F.length(bare) + 2)))
            .otherwise(part)
        )

    split = F.split(c, "(?=&)")
    decoded = F.array_join(F.transform(split, decode), "")
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def _text_nodes(html: Column) -> Column:
    nodes = F.transform(
        F.split(html, _COMMENT_OR_TAG),
        lambda t: strip(F.regexp_replace(unescape_html(t), r"(?U)[\s\x1c-\x1f]+", " ")),
    )
    return F.filter(nodes, lambda t: t != "")


def html_main_text(html: Column) -> Column:
    """Readable text: one line per text node, from ``<main>`` when it has any text."""
    body = F.regexp_replace(html, _SKIPPED, "")
    bare = F.regexp_replace(body, r"(?s)<!--.*?(?:-->|\z)", "<!---->")
    # A '<' that opens nothing is a text node of its own.
    bare = F.regexp_replace(bare, r"<(?![!?/a-zA-Z])", "<!---->&lt;<!---->")
    mains = F.regexp_extract_all(bare, F.lit(_MAIN), 1)
    main_nodes = F.flatten(F.transform(mains, _text_nodes))
    nodes = F.when(F.size(main_nodes) > 0, main_nodes).otherwise(_text_nodes(bare))
    return F.array_join(nodes, "\n")
