"""Each rule with a row that triggers it and rows that don't."""

from pyspark.sql import functions as F

from quillmesh.corpus import kb_paths
from quillmesh.operators import files, links, rules
from quillmesh.sources.config import Hygiene, Manifest, Profile, Root, Split, TypeRules
from quillmesh.sources.tree import with_names

PROFILE = Profile(("created",), {"Decision": TypeRules(("type", "status", "created"), ("tags",), ("adr", "ADR"), {"status": ("proposé", "actif")}), "Entry": TypeRules(("type",))})
GOOD = "---\ntype: Decision\nstatus: actif\ncreated: 2026-05-01\n---\n"


def check(spark, content, path="a.md", manifest=None, others=()):
    m = manifest or Manifest((Root("/r"),), {"index": "index.md", "log": "log.md"}, profile=PROFILE, hygiene=Hygiene("warn", "warn", "off", "warn"), external_refs=frozenset({"ext"}))
    rows = [(0, "/r", path, content, None), *((0, "/r", p, GOOD, None) for p in others)]
    kb = with_names(spark.createDataFrame(rows, "root_ord int, root string, rel_path string, content string, read_error string"))
    found = rules.diagnostics(files.parsed(kb), m, links.stem_index(kb), kb_paths(kb))
    return [(r["code"], r["message"]) for r in rules.ordered(found.where(F.col("file") == path)).collect()]


def codes(*args, **more):
    return [c for c, _ in check(*args, **more)]


CASES = [
    ("no header", ["F001"]),
    ("---\n- a\n---\n", ["F001"]),
    ("---\na: [\n---\n", ["F001"]),
    ("---\ntype: 2026-13-45\n---\n", ["F001"]),
    ("---\na: 1\n---\n", ["F002"]),
    ('---\ntype: " "\n---\n', ["F002"]),
    ("---\ntype:\n---\n", ["F101"]),
    (GOOD, []),
    ("---\ntype: decision\nstatus: actif\ncreated: 2026-05-01\n---\n", []),
    ("---\ntype: Adr\nstatus: actif\ncreated: 2026-05-01\n---\n", ["F106"]),
    ("---\ntype: Memo\nx: 1\n---\n", ["F101"]),
    ("---\ntype: Decision\n---\n", ["F102", "F102"]),
    (GOOD.replace("actif", "open"), ["F105"]),
    (GOOD.replace("actif", "[actif, 1]"), ["F105"]),
    (GOOD.replace("actif", "[]"), []),
    (GOOD.replace("2026-05-01", "05/2026"), ["S102"]),
    (GOOD.replace("2026-05-01", ""), []),
    (GOOD.replace("status", "zeta: 1\nalpha: 2\nstatus"), ["F201", "F201"]),
    (GOOD + "[[only]] [[nope]] [[ext]] `[[code]]`", ["L001"]),
    (GOOD + "[x](b.md) [y](sub/../b.md#q) [z](no.md) [w](http://no.md) [v](/only.md) [u](#a)", ["L002"]),
]


def test_rules_in_order(spark):
    """All cases at once, each in a folder of its own."""
    m = Manifest((Root("/r"),), {"index": "index.md", "log": "log.md"}, profile=PROFILE, hygiene=Hygiene("warn", "warn", "off", "warn"), external_refs=frozenset({"ext"}))
    rows = [(0, "/r", f"d{i:02}/a.md", text, None) for i, (text, _) in enumerate(CASES)] + [(0, "/r", f"d{len(CASES) - 1:02}/b.md", GOOD, None), (0, "/r", "only.md", GOOD, None)]
    kb = with_names(spark.createDataFrame(rows, "root_ord int, root string, rel_path string, content string, read_error string"))
    found = rules.ordered(rules.diagnostics(files.parsed(kb), m, links.stem_index(kb), kb_paths(kb))).collect()
    for i, (text, expected) in enumerate(CASES):
        assert [r["code"] for r in found if r["file"] == f"d{i:02}/a.md"] == expected, text


def test_messages(spark):
    assert check(spark, GOOD.replace("actif", "open")) == [("F105", "value outside vocabulary: `status=open` (allowed: ['proposé', 'actif'])")]
    assert [m for _, m in check(spark, GOOD.replace("status", "zeta: 1\nalpha: 2\nstatus"))] == ["unknown field in frontmatter: `alpha`", "unknown field in frontmatter: `zeta`"]


def test_ambiguous_links_and_text_order(spark):
    assert check(spark, GOOD + "[[c]] [[gone]] [[c]]", others=["x/c.md", "y/c.md"]) == [("L003", "ambiguous wikilink: [[c]]"), ("L001", "broken wikilink: [[gone]]"), ("L003", "ambiguous wikilink: [[c]]")]


def test_reserved_files(spark):
    assert codes(spark, GOOD, "index.md") == ["R001"]
    assert codes(spark, "---\nokf_version: 1\n---\n", "index.md") == []
    assert codes(spark, "---\nokf_version: 1\n---\n", "sub/index.md") == ["R001"]
    assert codes(spark, "text", "index.md") == []
    assert codes(spark, "# x\n## 2026-05-01\n## Then\n```\n## code\n```\n### y", "sub/log.md") == ["R002"]
    assert codes(spark, "text", "INDEX.md") == ["F001"]  # dispatch goes by exact names


def test_missing_reserved_and_levels(spark):
    m = Manifest((Root("/r"), Root("/s")), {"index": "index.md", "log": "log.md"}, hygiene=Hygiene("off", "off", "error", "off"))
    kb = with_names(spark.createDataFrame([(0, "/r", "index.md", "[[no]]", None)], "root_ord int, root string, rel_path string, content string, read_error string"))
    found = rules.ordered(rules.diagnostics(files.parsed(kb), m, links.stem_index(kb), kb_paths(kb))).collect()
    assert [(r["severity"], r["message"]) for r in found] == [("error", f"reserved file missing in {p}") for p in ("/r: log.md", "/s: index.md", "/s: log.md")]


def test_no_types_declared(spark):
    m = Manifest((Root("/r"),), {"index": "index.md", "log": "log.md"}, profile=Profile())
    assert codes(spark, GOOD, manifest=m) == ["F101"]


def split_manifest(**more):
    return Manifest((Root("/r"),), {"index": "index.md", "log": "log.md"}, hygiene=Hygiene("off", "error", split=Split(**more)))


def test_split_candidates_and_gates(spark):
    apart = GOOD + "# A\n" + " ".join(f"alpha{i}" for i in range(30)) + "\n# B\n" + " ".join(f"beta{i}" for i in range(30))
    assert check(spark, apart, manifest=split_manifest()) == [("S202", "S202 — split candidate (2 cohesion clusters)")]
    assert codes(spark, apart, manifest=split_manifest(min_lines=4)) == []
    assert codes(spark, apart, manifest=split_manifest(exempt_types=("Decision",))) == []
    assert codes(spark, apart, manifest=split_manifest(exempt_paths=("a*",))) == []
    assert codes(spark, GOOD + "# A\n" + "one " * 30, manifest=split_manifest()) == []
