"""HTML as Column expressions: comments, raw elements, nested and unclosed furniture, entities, links."""

from __future__ import annotations

import html as _html
import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from tidemark.functions.text import text_of

#: Elements whose text is not shown, page furniture, and elements that close what is open within them.
RAW = ("script", "style", "noscript", "template")
FURNITURE = ("nav", "header", "footer")
CONTAINERS = ("html", "body", "main", "article", "section", "aside", "div", "table", "ul", "ol", "form")
#: A tag with quoted attributes that may hold ``>``, or what is left of one at the end.
_TAG = r"""<[/!?]?[a-zA-Z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>|<[/!?]?[a-zA-Z][^>]*+(?:>|\z)"""


def _table() -> dict[str, str]:
    """Named references that end in a semicolon, and numbers that stand for characters of an old code page."""
    named = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    return named | {f"#{i}": _html.unescape(f"&#{i};") for i in (0, *range(128, 160))}


def unescaped(text: Column) -> Column:
    """Character references as characters, in one pass: ``&amp;lt;`` becomes ``&lt;``. What has no semicolon or is not known stays."""
    table = F.from_json(F.lit(json.dumps(_table())), "map<string,string>")
    parts = F.split(text_of(text), "&")

    def read(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        digits = F.when(F.lower(F.substring(name, 1, 2)) == "#x", F.conv(F.substring(name, 3, 6), 16, 10)).when(F.substring(name, 1, 1) == "#", F.substring(name, 2, 7))
        number = digits.cast("int")
        known = F.coalesce(table[F.when(number.isNotNull(), F.concat(F.lit("#"), number.cast("string"))).otherwise(name)])
        plain = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.when(plain, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).when(number.isNotNull(), "�")
        found = F.coalesce(known, char)
        return F.when((name != "") & found.isNotNull(), F.concat(found, F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), part))

    rest = F.transform(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), read)
    return F.when(F.instr(text_of(text), "&") == 0, text_of(text)).otherwise(F.concat(F.element_at(parts, 1), F.array_join(rest, "")))


def _bare(html: Column) -> Column:
    """Without comments and raw elements, whichever begins first; one that is not closed goes on to the end."""
    return F.regexp_replace(text_of(html), r"(?is)<!--.*?(?:-->|\z)|<(" + "|".join(RAW) + r")\b.*?(?:</\1\s*>|\z)", " ")


def shown(html: Column) -> Column:
    """The markup outside page furniture.

    One pass over the container tags with the stack of those that are open: a closing tag closes what was opened within its element and not
    closed, and is ignored where its element is not open. Furniture that nothing closes lasts to the end.
    """
    names = "|".join((*FURNITURE, *CONTAINERS))
    parts = F.split(_bare(html), rf"(?i)(?=</?(?:{names})\b)")
    state = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, part: Column) -> Column:
        name = F.lower(F.regexp_extract(part, rf"(?i)^</?({names})\b", 1))
        closes = F.substring(part, 1, 2) == "</"
        at = F.size(a["open"]) - F.array_position(F.reverse(a["open"]), name) + 1  # the innermost one of that name
        held = F.array_contains(a["open"], name)
        then = F.when(name == "", a["open"]).when(~closes, F.concat(a["open"], F.array(name))).when(held, F.slice(a["open"], F.lit(1), at.cast("int") - 1)).otherwise(a["open"])
        visible = ~F.arrays_overlap(then, F.array(*map(F.lit, FURNITURE)))
        return F.struct(then.alias("open"), F.when(visible, F.concat(a["out"], F.array(part))).otherwise(a["out"]).alias("out"))

    return F.array_join(F.aggregate(parts, state, step)["out"], " ")


def _words(markup: Column, between: str = " ") -> Column:
    """The text of ``markup``: tags off, references read, blanks squeezed."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(markup, _TAG, between)), r"[\s ]+", " "))


def visible_text(html: Column, chars: int = 5000) -> Column:
    """A page's text without scripts, styles, comments and page furniture, references decoded; null is empty."""
    return F.substring(_words(shown(html)), 1, chars)


def article_text(html: Column, least: int = 40, chars: int = 800) -> Column:
    """The paragraphs of more than ``least`` characters outside page furniture, joined and truncated; a paragraph ends where it is closed or
    the next one or a container begins or ends."""
    stops = "|".join((*FURNITURE, *CONTAINERS, "p"))
    parts = F.split(shown(html), r"(?i)<p\b(?=[^>]*>)")
    bodies = F.transform(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), lambda p: _words(F.split(F.regexp_replace(p, r"^[^>]*>", ""), rf"(?i)</?(?:{stops})\b", 2)[0]))
    return F.substring(F.array_join(F.filter(bodies, lambda p: F.length(p) > least), " "), 1, chars)


def links(html: Column) -> Column:
    """The ``href`` of every anchor in order, in any quotes or none, references decoded; those in comments and scripts are none."""
    tags = F.regexp_extract_all(_bare(html), F.lit(r"(?is)<a\s[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>"), F.lit(0))
    pattern = r"""(?is)[\s"']href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    one = lambda t: F.concat(*(F.regexp_extract(t, pattern, i) for i in (1, 2, 3)))
    return F.filter(F.transform(tags, lambda t: F.trim(unescaped(one(t)))), lambda h: h != "")
