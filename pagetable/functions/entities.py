"""HTML character references decoded with Catalyst expressions (no Python worker)."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from pagetable.functions.strings import let

# The names browsers still accept without the closing semicolon, longest first so that the
# alternation finds the longest one.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_NUMERIC = r"#[0-9]+;?|#[xX][0-9a-fA-F]+;?"

_TEXT_REF = rf"&(?:{_NUMERIC}|[A-Za-z][A-Za-z0-9]*;|(?:{_BARE}))"
# Inside attribute values a bare name followed by "=" or a letter is left alone (query strings).
_ATTR_REF = rf"&(?:{_NUMERIC}|[A-Za-z][A-Za-z0-9]*;|(?:{_BARE})(?![=A-Za-z0-9]))"

# Code points 0x80-0x9F are read as Windows-1252.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_C1_AS_1252 = "".join(
    bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)
)
# Control and non-character code points decode to nothing.
_DROPPED = r"[\x01-\x08\x0B\x0E-\x1F\x7F\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]"


def _named(name: Column) -> Column:
    """Value of an entity name given with its semicolon; null when unknown."""
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    return (
        F.when(name == "amp;", "&")
        .when(name == "lt;", "<")
        .when(name == "gt;", ">")
        .when(name == "quot;", '"')
        .when(name == "nbsp;", "\xa0")
        .otherwise(F.try_element_at(table, name))
    )


def _numeric(digits: Column, base: int) -> Column:
    # Eight digits or more are out of range whatever they are.
    significant = F.regexp_replace(digits, "^0+", "")
    code = F.when(F.length(significant) > 8, F.lit(0x110000)).otherwise(
        F.conv(significant, base, 10).cast("long")
    )

    def to_char(c: Column) -> Column:
        bad = c.isNull() | (c == 0) | (c > 0x10FFFF) | c.between(0xD800, 0xDFFF)
        raw = F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
        shown = F.regexp_replace(F.translate(raw, _C1, _C1_AS_1252), _DROPPED, "")
        return F.when(bad, "\ufffd").otherwise(shown)

    return let(code, to_char)


def _decode_one(ref: Column, bare_prefix: bool) -> Column:
    body = F.substr(ref, F.lit(2))
    number = F.regexp_replace(ref, "[&#xX;]", "")
    # Bare names mean the same as the name with its semicolon.
    named = _named(F.concat(F.rtrim(body, F.lit(";")), F.lit(";")))
    if bare_prefix:
        longest = let(
            F.regexp_extract(body, f"^(?:{_BARE})", 0),
            lambda name: F.when(
                name != "",
                F.concat(
                    _named(F.concat(name, F.lit(";"))), F.substr(body, F.length(name) + 1)
                ),
            ),
        )
        named = F.coalesce(named, longest)
    return (
        F.when(ref.rlike("^&#[xX]"), _numeric(number, 16))
        .when(ref.startswith("&#"), _numeric(number, 10))
        .otherwise(F.coalesce(named, ref))
    )


def _decode(col: Column, pattern: str, bare_prefix: bool) -> Column:
    refs = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        F.split(col, pattern, -1),
        refs,
        lambda gap, ref: F.concat(gap, F.coalesce(_decode_one(ref, bare_prefix), F.lit(""))),
    )
    return F.when(col.contains("&"), F.array_join(pieces, "")).otherwise(col)


def decode_text(col: Column) -> Column:
    """Decode character references as in element text."""
    return _decode(col, _TEXT_REF, bare_prefix=True)


def decode_attribute(col: Column) -> Column:
    """Decode character references as in attribute values."""
    return _decode(col, _ATTR_REF, bare_prefix=False)
