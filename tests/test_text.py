"""Column functions against plain Python views of the same definitions."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions import text as T


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_front_matter_block(spark):
    cases = {
        "---\na: 1\n---\nbody": ("a: 1", "body"),
        "---\n---\n": (None, "---\n---\n"),  # an empty block needs two line ends
        "---\n\n---\nx": ("", "x"),
        "---\na: 1\n---more": ("a: 1", "more"),  # the closing fence needs no line end
        "﻿---\na: 1\n---\n": (None, "﻿---\na: 1\n---\n"),
        "--- \r\na: 1\r\n---\t\r\nb": ("a: 1", "b"),
        "none": (None, "none"),
    }
    assert column(spark, list(cases), T.front_block) == [b for b, _ in cases.values()]
    assert column(spark, list(cases), T.after_front) == [a for _, a in cases.values()]


def python_mask(text):
    out, inside = [], False
    for line in text.split("\n"):
        fence = len(line) - len(line.lstrip()) < 4 and line.strip()[:3] in ("```", "~~~")
        if fence or inside:
            out.append(" " * len(line))
        else:
            out.append(re.sub(r"`[^`\n]+`", lambda m: " " * len(m[0]), line))
        inside ^= fence
    return "\n".join(out)


def test_mask_keeps_every_place(spark):
    cases = ["a `b` c", "x\n```\n[[no]]\n```\n[[yes]]", "~~~\na\n```\nb `c`", "    ```\nno fence", "```py\nopen to the end", "", "`a` ``b`` `", "\t```\nx\n```"]
    assert column(spark, cases, T.mask_code) == [python_mask(c) for c in cases]


def test_mask_on_generated_text(spark):
    texts = []

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet="`~ab \n\t#[", max_size=40))
    def gather(t):
        texts.append(t)

    gather()
    assert column(spark, texts, T.mask_code) == [python_mask(t) for t in texts]


def test_headers_and_line_ends(spark):
    got = column(spark, ["# One\ntext\n##  Two ## \n### no\n#no\r## Three # Four", ""], T.headers)
    assert [(h["level"], h["text"], h["line"]) for h in got[0]] == [(1, "One", 1), (2, "Two ##", 3), (2, "Three", 6), (1, "Four", 7)]
    assert got[1] == []
    assert column(spark, ["", "a", "a\n", "a\nb", "a\r\n\r\n"], T.count_lines) == [0, 1, 1, 2, 2]


def test_wikilinks_tell_absent_from_empty(spark):
    (got,) = column(spark, ["[[ a ]] [[b#s|t]] [[c#]] [[d|]] [[e[f]] [[]] [[g]"], T.wikilinks)
    assert [(x["target"], x["section"], x["alias"]) for x in got] == [("a", None, None), ("b", "s", "t"), ("c", "", None), ("d", None, "")]


def test_markdown_links(spark):
    (got,) = column(spark, ["![i](p.png) [t]( a.md#x ) [u](#top) [w](https://x.org/y#z) [m](mailto:x) [p](a(b).md)"], T.mdlinks)
    assert [(x["text"], x["target"], x["path"], x["is_external"]) for x in got] == [("i", "p.png", "p.png", False), ("t", "a.md#x", "a.md", False), ("w", "https://x.org/y#z", "https://x.org/y", True), ("m", "mailto:x", "mailto:x", False)]


def test_tokens_and_net_lines(spark):
    assert column(spark, ["Één a_b C3 x ÄÖ, 12"], T.tokens) == [["één", "c3", "äö", "12"]]
    assert column(spark, ["a\n \n\x1c\nb\n"], T.net_lines) == [2]


def test_paths_and_globs(spark):
    assert column(spark, ["/a/./b/../c//d", "/../x", "/"], T.normal_path) == ["/a/c/d", "/x", "/"]
    names = ["src/a/data/x.md", ".hid/a.md", "a.md", "b{1}.md", "a/b.md"]
    assert column(spark, names, lambda c: T.excluded(c, ["src/**/data/**", ".hid/*"])) == [True, True, False, False, False]
    assert column(spark, names, lambda c: T.excluded(c, ["b{1}.md"])) == [False, False, False, True, False]
    assert column(spark, names, lambda c: T.excluded(c, ["[!a].md"])) == [False] * 5


def test_iso_dates(spark):
    assert column(spark, ["2026-05-01", "2026-5-1", "2026-05-01\n", "x2026-05-01", "2026-99-99"], lambda c: c.rlike(T.ISO_DATE)) == [True, False, True, False, True]
