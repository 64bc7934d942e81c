"""Field and link extraction from stored HTML pages."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A piece of a page: a comment, a script or style element, a tag, text, or a lone bracket.
PIECES = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z][^>]*>|<[!?][^>]*>|[^<]+|<"
#: A piece of text: a character reference, text without any, or a lone ampersand.
REFERENCES = r"(?s)&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});|[^&]+|&"


def _character(number: Column) -> Column:
    """The character of a code point; NULL where there is none."""
    usable = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number < 0x110000))
    return F.when(usable, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def decoded(text: Column) -> Column:
    """Text with its character references replaced, each once: decimal, hexadecimal and named ones."""
    named = F.create_map(*[F.lit(x) for name, code in sorted({**name2codepoint, "apos": 39}.items()) for x in (name, chr(code))])

    def one(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(2), F.length(piece) - 2)
        number = F.when(inner.rlike("^#[0-9]"), F.substr(inner, F.lit(2)).cast("long")).otherwise(F.conv(F.substr(inner, F.lit(3)), 16, 10).cast("long"))
        char = F.when(F.startswith(inner, F.lit("#")), _character(number)).otherwise(F.try_element_at(named, inner))
        return F.when(F.startswith(piece, F.lit("&")) & (F.length(piece) > 1), F.coalesce(char, piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(REFERENCES), 0)
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def text_of(markup: Column) -> Column:
    """The text of a piece of markup: comments, scripts, styles and tags removed, references decoded."""
    bare = F.regexp_replace(markup, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", "")
    return decoded(bare)


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, references decoded; NULL if it has none by that name."""
    pattern = rf"(?is)^<[^>]*?\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
    values = [F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]
    return F.when(tag.rlike(pattern), decoded(F.concat(*values)))


def _opens(piece: Column, tag: str) -> Column:
    return piece.rlike(rf"(?i)^<{tag}[\s/>]")


def _closes(piece: Column, tag: str) -> Column:
    return piece.rlike(rf"(?i)^</{tag}[\s>]")


def _spans(pieces: Column, tag: str, starts: Callable[[Column], Column]) -> Column:
    """``(first, last)`` places of the outermost ``tag`` elements whose opening tag ``starts`` holds for.

    A fold over the pieces counts the elements of that name that are open; an element ends where its own closing
    tag stands. Elements that are never closed are none.
    """
    spans = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("first"), spans.alias("spans"))

    def step(state: Column, at: Column) -> Column:
        piece, inside = at["piece"], state["open"] > 0
        more = F.when(_opens(piece, tag) & (inside | starts(piece)), 1).when(inside & _closes(piece, tag), -1).otherwise(0)
        now = state["open"] + more
        ends = inside & (now == 0)
        return F.struct(
            now.alias("open"),
            F.when(~inside & (now == 1), at["i"]).otherwise(state["first"]).alias("first"),
            F.when(ends, F.concat(state["spans"], F.array(F.struct(state["first"].alias("first"), at["i"].alias("last"))))).otherwise(state["spans"]).alias("spans"),
        )

    # text has no part in the counting
    placed = F.filter(F.transform(pieces, lambda p, i: F.struct(i.alias("i"), p.alias("piece"))), lambda x: _opens(x["piece"], tag) | _closes(x["piece"], tag))
    return F.aggregate(placed, start, step, lambda state: state["spans"])


def _has_class(piece: Column, css_class: str | None, part: bool = False) -> Column:
    if not css_class:
        return F.lit(True)
    value = F.coalesce(_attribute(piece, "class"), F.lit(""))
    return F.contains(value, F.lit(css_class)) if part else F.array_contains(F.split(value, r"\s+"), css_class)


def elements(html: Column, tag: str, css_class: str | None = None, part: bool = False) -> Column:
    """The markup between the tags of every outermost ``tag`` element (with a class, or a class that has
    ``css_class`` as a part), in page order."""
    pieces = F.regexp_extract_all(html, F.lit(PIECES), 0)
    inner = lambda all_, s: F.array_join(F.slice(all_, s["first"] + 2, s["last"] - s["first"] - 1), "")
    # bound once by a one-element array, so that a page is cut once
    return F.transform(
        F.array(pieces), lambda all_: F.transform(_spans(all_, tag, lambda p: _has_class(p, css_class, part)), lambda s: inner(all_, s))
    )[0]


def first_text(html: Column, tag: str, css_class: str | None = None, part: bool = False) -> Column:
    """Text of the first ``tag`` element (optionally with a class); NULL if there is none.

    The element ends at its own closing tag, whatever elements of its name it holds.
    """
    return F.transform(F.array(F.get(elements(html, tag, css_class, part), F.lit(0))), text_of)[0]


def first_attribute(html: Column, tag: str, css_class: str | None, name: str, part: bool = False) -> Column:
    """An attribute of the first ``tag`` (optionally with a class) that has it; NULL if none has."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>"), 0)
    values = F.transform(F.filter(tags, lambda t: _has_class(t, css_class, part)), lambda t: _attribute(t, name))
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def links(html: Column) -> Column:
    """Array of all link targets, in page order."""
    return F.regexp_extract_all(html, F.lit('<a [^>]*href="([^"]*)"'), 1)


def links_with_class(html: Column, css_class: str) -> Column:
    """Targets of anchors that carry a class (related topics, say)."""
    anchors = F.regexp_extract_all(html, F.lit(rf'(<a [^>]*class="[^"]*{css_class}[^"]*"[^>]*>)'), 1)
    return F.transform(anchors, lambda a: F.regexp_extract(a, 'href="([^"]*)"', 1))


def next_page(html: Column) -> Column:
    """Target of the only ``rel="next"`` anchor; NULL when there is none or more than one."""
    anchors = F.regexp_extract_all(html, F.lit(r'(<a [^>]*rel="[^"]*next[^"]*"[^>]*>)'), 1)
    return F.when(F.size(anchors) == 1, F.regexp_extract(F.get(anchors, F.lit(0)), 'href="([^"]*)"', 1))


def without_query(url: Column) -> Column:
    """The URL up to its question mark."""
    return F.get(F.split(url, r"\?"), F.lit(0))


def page_items(
    pages: DataFrame, key: str, html: str, item: tuple[str, str], fields: Mapping[str, tuple[str, str, str]]
) -> DataFrame:
    """One row per item element of every page.

    ``item`` is ``(tag, class)``; ``fields`` maps a column to ``(tag, class, attribute)`` where
    the attribute ``text`` asks for the element's text. A class is met by any that has it as a part, an empty one
    by any element. Items within an item belong to it; the first element of a field counts.
    """
    found = pages.select(F.col(key).cast("bigint").alias(key), F.posexplode(elements(F.col(html), *item, part=True)).alias("position", "__item"))
    body = F.col("__item")
    made = [
        (first_text(body, tag, css, part=True) if attribute == "text" else first_attribute(body, tag, css, attribute, part=True)).alias(name)
        for name, (tag, css, attribute) in fields.items()
    ]
    return found.select(key, "position", *made)
