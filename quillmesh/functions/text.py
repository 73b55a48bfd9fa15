"""Markdown text as column expressions: no Python runs on the executors.

Regular expressions are Java's; `(?d)` makes the newline the only line end and
`(?U)` makes \\s and letters Unicode, which is what the rules are defined by.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

# What headers, code, links, headings and tokens are. The rules are defined by these patterns.
FRONT = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*\r?\n?"
SPACE = r"\s\x1c-\x1f"
FENCE = rf"(?mdU)^[{SPACE}&&[^\n]]{{0,3}}(?:```|~~~)[^\n]*"
INLINE = r"`[^`\n]+`"
WIKILINK = r"\[\[([^\[\]#|]+?)(?:#([^\[\]|]*?))?(?:\|([^\[\]]*?))?\]\]"
MDLINK = r"\[([^\[\]]*)\]\(([^()]+)\)"
HEADING = rf"(?mdU)^#{{1,6}}[{SPACE}&&[^\n]]+[^\n]+$"
HEADER_PARTS = rf"(?sU)\A(#{{1,6}})[{SPACE}]+(.+)\z"
H1_H2 = rf"(?sU)\A(#{{1,2}})[{SPACE}]+(.+)\z"
ISO_DATE = r"\A\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}\n?\z"
WORDS = r"[\p{L}\p{N}]+"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def once(c: Column) -> Column:
    """c, evaluated once a row however often it is referred to: the optimiser doesn't copy expressions out of a generator."""
    return F.explode(F.array(c))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A[{SPACE}]+|[{SPACE}]+\z", "")


def newlines(c: Column) -> Column:
    """Carriage returns, alone or before a newline, as newlines."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def front_block(content: Column) -> Column:
    """The text between the header's fences; null without such a block."""
    return F.when(content.rlike(FRONT), F.regexp_extract(content, FRONT, 1))


def after_front(content: Column) -> Column:
    return F.substr(content, F.length(F.regexp_extract(content, FRONT, 0)) + 1)


def _blank(text: Column, pattern: str, between=lambda part, i: part) -> Column:
    """Text with every match replaced by as many spaces; `between` maps what stands between matches, by its place."""
    spaces = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
    parts = F.transform(F.split(text, pattern, -1), between)
    return F.array_join(F.zip_with(parts, F.array_append(spaces, F.lit("")), lambda p, s: F.concat(p, s)), "")


def mask_code(body: Column) -> Column:
    """Code blanked with spaces, every character and line in its place: fence lines, what stands between an odd fence and the next (or the end), and inline spans elsewhere."""
    inside = lambda p: F.regexp_replace(p, r"[^\n]", " ")
    return _blank(body, FENCE, lambda p, i: F.when(i % 2 == 1, inside(p)).otherwise(_blank(p, INLINE)))


def split_lines(text: Column) -> Column:
    """Lines at every Unicode line end; a last one without text is none."""
    whole = F.when(F.substring(text, -1, 1).rlike(LINE_ENDS), F.regexp_replace(text, rf"(?:{LINE_ENDS})\z", "")).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(whole, LINE_ENDS, -1))


def count_lines(text: Column) -> Column:
    return F.size(split_lines(text))


def headers(masked: Column) -> Column:
    """Level 1 and 2 headings: array of (level, text, line)."""
    numbered = F.transform(split_lines(masked), lambda x, i: F.struct(x.alias("x"), (i + 1).cast("int").alias("line")))
    marked = F.filter(numbered, lambda n: n["x"].startswith("#"))
    found = F.transform(marked, lambda n: F.struct(F.length(F.regexp_extract(n["x"], H1_H2, 1)).alias("level"), strip(F.regexp_extract(n["x"], H1_H2, 2)).alias("text"), n["line"].alias("line")))
    return F.filter(found, lambda h: h["level"] > 0)


def wikilinks(masked: Column) -> Column:
    """Array of (raw, target, section, alias); section and alias are null where absent, not where empty."""
    part = lambda raw, k: strip(F.regexp_extract(raw, WIKILINK, k))
    return F.transform(
        F.regexp_extract_all(masked, F.lit(WIKILINK), F.lit(0)),
        lambda raw: F.struct(
            raw.alias("raw"),
            part(raw, 1).alias("target"),
            F.when(raw.rlike(r"\A\[\[[^\[\]#|]+#"), part(raw, 2)).alias("section"),
            F.when(F.instr(raw, "|") > 0, part(raw, 3)).alias("alias"),
        ),
    )


def mdlinks(masked: Column) -> Column:
    """Array of (text, target, path, is_external); links to an anchor alone are left out."""
    raws = F.regexp_extract_all(masked, F.lit(MDLINK), F.lit(0))
    pairs = F.transform(raws, lambda raw: F.struct(F.regexp_extract(raw, MDLINK, 1).alias("text"), strip(F.regexp_extract(raw, MDLINK, 2)).alias("target")))
    full = F.transform(pairs, lambda m: F.struct(m["text"].alias("text"), m["target"].alias("target"), F.substring_index(m["target"], "#", 1).alias("path")))
    kept = F.filter(full, lambda m: m["path"] != "")
    return F.transform(kept, lambda m: F.struct(m["text"].alias("text"), m["target"].alias("target"), m["path"].alias("path"), m["path"].rlike(r"\A(?:https?|ftp)://").alias("is_external")))


def net_lines(body: Column) -> Column:
    """Lines with something on them."""
    return F.size(F.filter(F.split(body, "\n", -1), lambda x: strip(x) != ""))


def tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)), lambda t: F.length(t) >= 2)


def normal_path(absolute: Column) -> Column:
    """A path without `.`, empty parts and `..`."""
    folded = F.aggregate(
        F.split(absolute, "/"),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def glob_regex(pattern: str) -> str:
    """A file-name pattern as a Java expression over the whole path; a star crosses slashes."""
    return rf"\A(?:{fnmatch.translate(pattern).removesuffix(r"\Z").removesuffix(r"\z")})\z"


def excluded(rel_path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | rel_path.rlike(glob_regex(p))
    return out
