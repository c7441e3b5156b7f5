"""The HTML token grammar, written once and used by both the JVM and the node job.

Only syntax shared by ``java.util.regex`` and Python's ``re`` is used, so a page is cut into the
same tokens on either side. Loops are possessive: they run without backtracking or recursion.
"""

from __future__ import annotations

_S = r" \t\n\f\r"
_END = r"(?![\s\S])"

# Inside a tag: blanks, slashes, and name[=value] pairs.
ATTRIBUTES = (
    rf"(?:[{_S}/]++|[^{_S}/>][^{_S}/>=]*+"
    rf"(?:[{_S}]*+=[{_S}]*+(?:\"[^\"]*+\"|'[^']*+'|[^{_S}>\"'][^{_S}>]*+)?+)?+)*+"
)
# One attribute: name, then double-quoted, single-quoted or bare value.
ATTRIBUTE = (
    rf"([^{_S}/>][^{_S}/>=]*+)"
    rf"(?:[{_S}]*+=[{_S}]*+(?:\"([^\"]*+)\"|'([^']*+)'|([^{_S}>\"'][^{_S}>]*+))?+)?+"
)

COMMENT = rf"!--(?:-?>|(?:[^-]++|-(?!-!?>))*+(?:--!?>|{_END}))"
BOGUS = rf"[!?/][^>]*+(?:>|{_END})"
TAG = rf"(/?)([A-Za-z][^{_S}/>]*+)({ATTRIBUTES})>"
# A tag that never closes swallows the rest of the page.
CUT_OFF = r"/?[A-Za-z][\s\S]*+"


def raw_element(names: str, content: str = "") -> str:
    """An element whose content is not markup. Two groups in it: name and attributes, then
    the content when ``content`` asks for a group by being ``"("``."""
    close = ")" if content else ""
    return (
        rf"({names})(?=[{_S}/>])({ATTRIBUTES})(?<!/)>"
        rf"{content}(?:[^<]++|<(?!/\1[{_S}/>]))*+{close}(?:</\1[^>]*+>|{_END})"
    )


# Elements whose content is read as plain characters.
RAW_TEXT = "script|style|xmp|iframe|noembed|noframes"
RAW_DECODED = "title|textarea"
_RAW_ALL = f"{RAW_TEXT}|{RAW_DECODED}"

# Python side: every token of a page. Groups: raw name, raw attributes, raw content,
# closing slash, tag name, tag attributes.
TOKENS = (
    rf"(?ai)<(?:{COMMENT}|{raw_element(_RAW_ALL, '(')}|{TAG}|{CUT_OFF}|{BOGUS})|[^<]++|<"
)

# JVM side: attribute text of each <a> tag is group 3; other tokens are stepped over.
ANCHORS = (
    rf"(?i)<(?:{COMMENT}|{raw_element(_RAW_ALL)}|a(?=[{_S}/>])({ATTRIBUTES})>"
    rf"|/?[A-Za-z][^{_S}/>]*+{ATTRIBUTES}>|{CUT_OFF}|{BOGUS})"
)
# JVM side: the first href of an attribute text; groups 1-3 by quoting style.
HREF = (
    rf"(?i)^(?:[{_S}/]++|(?!href(?:[{_S}/=]|$))[^{_S}/>][^{_S}/>=]*+"
    rf"(?:[{_S}]*+=[{_S}]*+(?:\"[^\"]*+\"|'[^']*+'|[^{_S}>\"'][^{_S}>]*+)?+)?+)*+"
    rf"href[{_S}]*+=[{_S}]*+(?:\"([^\"]*+)\"|'([^']*+)'|([^{_S}>\"'][^{_S}>]*+))"
)
# JVM side: steps over tokens up to the first title; group 3 is its start tag with its content.
_TITLE_OPEN = rf"<title(?=[{_S}/>]){ATTRIBUTES}"
FIRST_TITLE = (
    rf"(?i)^(?:[^<]++|<(?!title[{_S}/>])(?:{COMMENT}"
    rf"|{raw_element(_RAW_ALL.replace('title|', ''))}"
    rf"|/?[A-Za-z][^{_S}/>]*+{ATTRIBUTES}>|{CUT_OFF}|{BOGUS})?+)*+"
    rf"({_TITLE_OPEN}(?:(?<=/)>|(?<!/)>(?:[^<]++|<(?!/title[{_S}/>]))*+))"
)
TITLE_OPEN = rf"(?i)^{_TITLE_OPEN}>"

# Zones: what kinds of ancestor (or self) a node has, one bit each.
ZONE_RAW = 1  # script, style, template, ruby marks: never part of a parent's text
ZONE_DROP = 2  # page furniture left out of clean text
ZONE_BOILER = 4  # furniture by class name, below the body
ZONE_BODY = 8
ZONE_HIDDEN = 16  # inside an element with the hidden attribute
ZONE_UNSEEN = 32  # never rendered as text
ZONE_PRE = 64  # white space is kept

# Which elements and classes open each zone.
TAG_ZONES = {
    ZONE_RAW: ("script", "style", "template", "rt", "rp"),
    ZONE_DROP: ("script", "style", "nav", "footer", "header", "aside", "noscript"),
    ZONE_BODY: ("body",),
    ZONE_UNSEEN: ("script", "style", "noscript", "template"),
    ZONE_PRE: ("pre", "textarea"),
}
BOILER_CLASSES = frozenset((
    "sidebar", "menu", "nav", "footer", "header", "ad", "advertisement",
    "social-share", "comments", "related-posts",
))
