"""HTML columns, all JVM-side and shuffle-free.

A heuristic page scorer is not reproduced: the main text is the ``<article>`` (or
``<main>``) block, else the blocks with a fair share of the text, else the body.
"""

from __future__ import annotations

from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.binding import let
from docweave.functions.text import collapse

# Comments, scripts and styles are removed first and in one pass, so that markup quoted
# inside a script never counts as markup.
NOISE = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
)
# Elements that hold no main text.
CHROME_IN_PAGE = ("nav", "header", "footer")
CHROME_IN_MAIN = ("nav", "header", "footer", "aside", "form", "button")
TAG = r"(?s)<[a-zA-Z/!?][^>]*>"
BLOCK_EDGE = r"(?i)</?(?:div|section|table|td|body|html|head)\b[^>]*>"
# A page without article or main keeps the blocks with at least this share (percent) of the
# longest one's text; if they hold less than that share of the page's text, it keeps the page.
BLOCK_PERCENT = 25
PAGE_PERCENT = 80
# A page is cut in front of every opening anchor; a piece is a link if the anchor has an href, and
# its text ends at the closing tag or with the piece.
ANCHOR_CUT = r"(?i)(?=<a\s)"
ANCHOR_OPEN = r"(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)[^>]*>"
ANCHOR_TEXT = ANCHOR_OPEN + r"(.*?)(?:</a\s*>.*)?\z"
NAMED = r"^([a-zA-Z][a-zA-Z0-9]*);"
# Names that pages use most; they come first in the table. No character reference stands for the break.
COMMON = ("amp", "nbsp", "lt", "gt", "quot", "apos", "mdash", "ndash", "hellip", "rsquo", "lsquo", "rdquo", "ldquo", "copy")
SIDE_BREAK = "\x01"
NUMBERED = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});?"


def entity_table() -> dict[str, str]:
    """Names of character references that end in a semicolon, from the standard library's table."""
    return {name[:-1]: chars for name, chars in entities.html5.items() if name.endswith(";")}


def bare_entity_table() -> dict[str, str]:
    """Names that count without a semicolon too."""
    return {name: chars for name, chars in entities.html5.items() if not name.endswith(";")}


def number_table() -> dict[int, str]:
    """Numbers 128 to 159 name the characters of Windows-1252, where it has one."""
    return {n: char for n in range(128, 160) if (char := bytes([n]).decode("cp1252", "ignore"))}


def chrome_pattern(names: tuple[str, ...]) -> str:
    return "(?is)" + "|".join(rf"<{name}\b.*?</{name}\s*>" for name in names)


def _lookup(table: dict[str, str], name: Column) -> Column:
    """The entry of a fixed table. Its two sides are one literal each, so the plan holds no more than
    two strings, which the optimizer folds into one map; a map is searched from the front."""
    first = sorted(table, key=lambda name: COMMON.index(name) if name in COMMON else len(COMMON))
    keys, values = (F.split(F.lit(SIDE_BREAK.join(side)), SIDE_BREAK) for side in (first, [table[name] for name in first]))
    return F.try_element_at(F.map_from_arrays(keys, values), name)


def decode_entities(text: Column) -> Column:
    """Character references to characters, each decoded once; unknown ones stay as they are.

    Old names count without a semicolon, the longest that fits; numbers outside Unicode stay.
    """
    bare = "^(" + "|".join(sorted(bare_entity_table(), key=lambda name: (-len(name), name))) + ")"
    windows = {str(n): char for n, char in number_table().items()}

    def read(part: Column) -> Column:
        number = F.regexp_extract(part, NUMBERED, 1)
        code = F.when(number.rlike("^#[xX]"), F.conv(F.substring(number, 3, 8), 16, 10).cast("int")).when(
            number != "", F.substring(number, 2, 8).cast("int")
        )
        return F.struct(
            part.alias("part"),
            F.regexp_extract(part, NAMED, 1).alias("name"),
            code.alias("code"),
            F.length(F.regexp_extract(part, NUMBERED, 0)).alias("digits"),
        )

    def decoded(item: Column, position: Column) -> Column:
        code, rest = item["code"], lambda n: F.substr(item["part"], n + F.lit(1))
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        plain = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        number = F.when(code.between(128, 159), F.coalesce(_lookup(windows, code.cast("string")), plain)).otherwise(plain)
        return F.when(position == 0, item["part"]).otherwise(
            F.coalesce(
                F.concat(F.when(item["name"] != "", _lookup(entity_table(), item["name"])), rest(F.length(item["name"]) + F.lit(1))),
                F.concat(number, rest(item["digits"])),
                # the long alternation is tried on what is neither a closed name nor a number
                let(
                    F.regexp_extract(item["part"], bare, 1),
                    lambda name: F.concat(F.when(name != "", _lookup(bare_entity_table(), name)), rest(F.length(name))),
                ),
                F.concat(F.lit("&"), item["part"]),
            )
        )

    pieces = F.transform(F.split(text, "&"), read)
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def without_noise(html: Column) -> Column:
    return F.regexp_replace(html, NOISE, " ")


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, TAG, " ")


def without_chrome(quiet: Column, names: tuple[str, ...]) -> Column:
    return F.regexp_replace(quiet, chrome_pattern(names), " ")


def element(html: Column, name: str) -> Column:
    """What lies inside the outermost elements of a name, blank-joined; empty when none is closed.

    Opening and closing tags are paired by depth, so text between two such elements is left out and
    elements inside one another count once. A closing tag without an opening one is passed over; an
    element that is never closed ends with the last closing tag of its name.
    """
    closed = F.regexp_extract(html, rf"(?is)^(.*)</{name}\s*>", 1)
    pieces = F.split(closed, rf"(?i)(?=<{name}\b[^>]*>|</{name}\s*>)")

    def step(state: Column, piece: Column) -> Column:
        opens, closes = piece.rlike(rf"(?i)^<{name}\b"), piece.rlike(rf"(?i)^</{name}\b")
        depth = F.when(opens, state["depth"] + 1).when(closes, F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        inside = lambda depth: F.when(
            depth > 0, F.concat(state["kept"], F.array(F.regexp_replace(piece, rf"(?i)^</?{name}\b[^>]*>", "")))
        ).otherwise(state["kept"])
        return let(depth, lambda depth: F.struct(depth.alias("depth"), inside(depth).alias("kept")))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))
    return let(pieces, lambda pieces: F.array_join(F.aggregate(pieces, start, step, lambda s: s["kept"]), " "))


def main_blocks(html: Column) -> Column:
    """The pieces between block tags that hold a fair share of the text, in order, or all of it."""
    sized = F.transform(
        F.split(html, BLOCK_EDGE), lambda b: F.struct(F.length(collapse(without_tags(b))).alias("n"), b.alias("html"))
    )
    total = lambda blocks: F.aggregate(blocks, F.lit(0), lambda sum, b: sum + b["n"])

    def chosen(blocks: Column) -> Column:
        most = F.array_max(F.transform(blocks, lambda b: b["n"]))
        return let(most, lambda most: F.filter(blocks, lambda b: 100 * b["n"] >= BLOCK_PERCENT * most))

    def picked(blocks: Column) -> Column:
        joined = lambda kept: F.array_join(F.transform(kept, lambda b: b["html"]), " ")
        enough = lambda kept: 100 * total(kept) >= PAGE_PERCENT * total(blocks)
        return let(chosen(blocks), lambda kept: F.when(enough(kept), joined(kept)).otherwise(joined(blocks)))

    return let(sized, picked)


def raw_title(quiet: Column) -> Column:
    return F.regexp_extract(quiet, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)


def anchors(quiet: Column) -> Column:
    """``array<struct<href, anchor>>`` in page order; anchor text is lower-cased."""

    def parts(piece: Column) -> Column:
        href = F.regexp_replace(F.regexp_extract(piece, ANCHOR_OPEN, 1), "^[\"']|[\"']$", "")
        inner = F.regexp_replace(F.regexp_extract(piece, ANCHOR_TEXT, 2), TAG, "")
        return F.struct(
            F.trim(decode_entities(href)).alias("href"),
            F.lower(collapse(decode_entities(inner))).alias("anchor"),
        )

    return F.transform(F.filter(F.split(quiet, ANCHOR_CUT), lambda piece: piece.rlike(ANCHOR_OPEN)), parts)
