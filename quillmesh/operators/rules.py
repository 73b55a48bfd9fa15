"""The rules: each gives findings; enabled ones are united in one plan.

A rule that looks at one file alone is a column, an array of findings; a link
rule gives claims, which one join with what exists settles.

A diagnostic is code, tier, severity, file, message; `root_ord`, `parts`,
`rule_ord` and `pos` order them as the checks run: by file, then core, profile
(in a file's declared order), links, structure, unknown fields.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import cohesion, links
from quillmesh.operators.files import fm_text, has_key
from quillmesh.sources.config import Hygiene, Manifest, Profile, Root

PUBLIC = ["code", "tier", "severity", "file", "message"]
ORDER = ["root_ord", "parts", "rule_ord", "pos"]

RULES = ("F001", "F002", "R001", "R002", "F101", "F106", "F102", "F105", "S102", "L001", "L003", "L002", "S202", "F201", "R201")


EMPTY = "root_ord int, parts array<string>, rule_ord int, pos int, code string, tier string, severity string, file string, message string"
FINDING = "struct<rule_ord: int, pos: int, code: string, tier: string, severity: string, message: string>"


def _finding(code: str, message: Column, tier: str, severity: str = "error", pos: Column | None = None) -> Column:
    at = F.lit(0) if pos is None else pos.cast("int")
    return F.struct(F.lit(RULES.index(code)).alias("rule_ord"), at.alias("pos"), F.lit(code).alias("code"), F.lit(tier).alias("tier"), F.lit(severity).alias("severity"), message.alias("message"))


def _none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def _if(condition: Column, finding: Column) -> Column:
    return F.when(condition, F.array(finding)).otherwise(_none())


def _each(values: Column, finding) -> Column:
    """A finding for each value (and its place); none for null."""
    return F.coalesce(F.transform(values, finding), _none())


def severity_of(level: str) -> str:
    return {"warn": "warning", "error": "error"}[level]


def kind_of(reserved: dict[str, str]) -> Column:
    """index, log or concept, by exact name."""
    index, log = reserved.get("index", "index.md"), reserved.get("log", "log.md")
    return F.when(F.col("name") == index, "index").when(F.col("name") == log, "log").otherwise("concept")


def with_kind(rows: DataFrame, reserved: dict[str, str]) -> DataFrame:
    """Adds kind, and core_ok: a concept whose header and type later stages look at."""
    rows = rows.withColumn("kind", kind_of(reserved))
    return rows.withColumn("core_ok", (F.col("kind") == "concept") & F.col("fm").isNotNull() & ~type_is_missing())


def type_is_missing() -> Column:
    return F.col("fm").isNotNull() & (~has_key("type") | (T.strip(fm_text("type")) == ""))


def f001() -> Column:
    return _if((F.col("kind") == "concept") & F.col("fm").isNull(), _finding("F001", F.lit("frontmatter absent or unparsable"), "core"))


def f002() -> Column:
    return _if((F.col("kind") == "concept") & type_is_missing(), _finding("F002", F.lit("`type` field absent or empty"), "core"))


def r001(roots: Sequence[Root]) -> Column:
    """A header in an index file; one of the top of any root may give the version."""
    at_root = F.concat_ws("/", "root", F.when(F.col("dir") != "", F.col("dir"))).isin([r.path.rstrip("/") for r in roots])
    extra = F.size(F.array_except("fm.keys", F.array(F.lit("okf_version")))) > 0
    bad = (F.col("kind") == "index") & F.col("fm").isNotNull() & (~at_root | extra)
    return _if(bad, _finding("R001", F.lit("frontmatter forbidden in index.md (only `okf_version` allowed at root)"), "core"))


def r002() -> Column:
    headings = F.when(F.col("kind") == "log", F.filter(T.headers(F.col("masked")), lambda h: (h["level"] == 2) & ~h["text"].rlike(T.ISO_DATE)))
    return _each(headings, lambda h, i: _finding("R002", F.concat(F.lit("non-ISO date heading in log.md: `"), h["text"], F.lit("`")), "core", pos=i))


def _map(d: dict, kind: str) -> Column:
    if not d:
        return F.from_json(F.lit("{}"), f"map<string, {kind}>")
    return F.create_map(*(x for k, v in d.items() for x in (F.lit(k), v)))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def with_type(rows: DataFrame, profile: Profile) -> DataFrame:
    """Adds type_text, type_key (null: undeclared) and by_alias: an exact key, else the first key or else alias equal but for case."""
    folded: dict[str, str] = {}
    aliases: dict[str, str] = {}
    for k, rules in profile.types.items():
        folded.setdefault(k.lower(), k)
        for a in rules.aliases:
            aliases.setdefault(a.lower(), k)
    text = F.coalesce(fm_text("type"), F.lit(""))
    exact = F.when(text.isin(list(profile.types)), text) if profile.types else F.lit(None).cast("string")
    look = lambda d: F.try_element_at(_map({k: F.lit(v) for k, v in d.items()}, "string"), F.lower(text))
    by_key = F.coalesce(exact, look(folded))
    return rows.withColumn("type_text", text).withColumn("type_key", F.coalesce(by_key, look(aliases))).withColumn("by_alias", by_key.isNull() & look(aliases).isNotNull())


def f101() -> Column:
    return _if(F.col("core_ok") & F.col("type_key").isNull(), _finding("F101", F.concat(F.lit("`type` value not in declared types: `"), F.col("type_text"), F.lit("`")), "profile"))


def f106() -> Column:
    return _if(F.col("core_ok") & F.col("by_alias"), _finding("F106", F.concat(F.lit("non-normalised `type` spelling: `"), F.col("type_text"), F.lit("` → use `"), F.col("type_key"), F.lit("`")), "profile"))


def _typed(values: Column) -> Column:
    return F.when(F.col("core_ok") & F.col("type_key").isNotNull(), values)


def f102(profile: Profile) -> Column:
    required = _map({k: _strings([f for f in r.required if f != "type"]) for k, r in profile.types.items()}, "array<string>")
    missing = F.filter(F.try_element_at(required, F.col("type_key")), lambda f: ~F.array_contains(F.col("fm.keys"), f))
    return _each(_typed(missing), lambda f, i: _finding("F102", F.concat(F.lit("missing required field: `"), f, F.lit("`")), "profile", pos=i))


def f105(profile: Profile) -> Column:
    entry = lambda p, allowed: F.struct(F.lit(p).alias("p"), _strings(allowed).alias("allowed"), F.lit(str(list(allowed))).alias("shown"))
    kind = "array<struct<p: string, allowed: array<string>, shown: string>>"
    vocabularies = _map({k: F.array(*(entry(p, a) for p, a in r.values.items())).cast(kind) for k, r in profile.types.items()}, kind)
    bad = F.filter(
        F.try_element_at(vocabularies, F.col("type_key")),
        lambda v: F.array_contains(F.col("fm.keys"), v["p"]) & F.exists(F.try_element_at(F.col("fm.elements"), v["p"]), lambda e: ~e["is_str"] | ~F.array_contains(v["allowed"], e["s"])),
    )
    message = lambda v: F.concat(F.lit("value outside vocabulary: `"), v["p"], F.lit("="), F.try_element_at(F.col("fm.texts"), v["p"]), F.lit("` (allowed: "), v["shown"], F.lit(")"))
    return _each(_typed(bad), lambda v, i: _finding("F105", message(v), "profile", pos=i))


def s102(profile: Profile) -> Column:
    value = lambda f: F.try_element_at(F.col("fm.texts"), f)
    bad = F.filter(_strings(profile.date_fields), lambda f: F.array_contains(F.col("fm.truthy"), f) & ~value(f).rlike(T.ISO_DATE))
    return _each(_typed(bad), lambda f, i: _finding("S102", F.concat(F.lit("incorrectly formatted date: `"), f, F.lit("="), value(f), F.lit("` (expected YYYY-MM-DD)")), "profile", pos=i))


def f201(profile: Profile, level: str) -> Column:
    known = _map({k: _strings(sorted({*r.required, *r.optional, "type"})) for k, r in profile.types.items()}, "array<string>")
    unknown = F.array_sort(F.array_except("fm.keys", F.try_element_at(known, F.col("type_key"))))
    return _each(_typed(unknown), lambda f, i: _finding("F201", F.concat(F.lit("unknown field in frontmatter: `"), f, F.lit("`")), "hygiene", severity_of(level), i))


def s202(hygiene: Hygiene) -> Column:
    """Cheap gates first; only what passes them is cut into sections."""
    cfg = hygiene.split
    gate = F.col("core_ok") & (T.net_lines(F.col("body")) > cfg.min_lines)
    if cfg.exempt_types:
        gate = gate & (F.col("fm").isNull() | ~F.coalesce(fm_text("type"), F.lit("")).isin(list(cfg.exempt_types)))
    if cfg.exempt_paths:
        gate = gate & ~T.excluded(F.col("rel_path"), list(cfg.exempt_paths))
    return cohesion.clusters(F.when(gate, F.col("masked")), cfg.tau)


def split_finding(hygiene: Hygiene) -> Column:
    return _if(F.col("_clusters") > 1, _finding("S202", F.concat(F.lit("S202 — split candidate ("), F.col("_clusters").cast("string"), F.lit(" cohesion clusters)")), "hygiene", severity_of(hygiene.split_candidates)))


# What a link refers to, as keys of one relation: stems and absolute paths.
_STEM, _PATH = "s", "p"


def wikilink_claims(level: str) -> Column:
    """A claim for each wikilink: its message is the target until the lookup tells what it is."""
    claim = lambda x, i: F.struct(_finding("L001", x["target"], "hygiene", severity_of(level), i * 2).alias("x"), F.concat(F.lit(_STEM), x["target"]).alias("key"))
    return _claims(T.wikilinks(F.col("masked")), claim)


def mdlink_claims(level: str) -> Column:
    """A claim for each internal Markdown link."""
    numbered = F.transform(T.mdlinks(F.col("masked")), lambda x, i: F.struct(x.alias("link"), i.alias("i")))
    inner = F.filter(numbered, lambda n: ~n["link"]["is_external"])
    claim = lambda n: F.struct(_finding("L002", n["link"]["target"], "hygiene", severity_of(level), n["i"]).alias("x"), F.concat(F.lit(_PATH), links.link_path(n["link"]["path"])).alias("key"))
    return _claims(inner, claim)


def _claims(values: Column, claim) -> Column:
    return F.coalesce(F.transform(F.when(F.col("core_ok"), values), claim), F.array().cast(f"array<struct<x: {FINDING}, key: string>>"))


def settled(claims: DataFrame, known: DataFrame, manifest: Manifest, probe: links.Probe | None = None) -> DataFrame:
    """The findings among claims (x and key; null: it stands): unknown targets are broken, stems of several files ambiguous.

    Paths outside all roots are looked up by `probe`, else they count as missing.
    Claims that stand have scattered keys, which nothing bears, so that no key of theirs is hot.
    """
    key = F.coalesce("key", F.concat(F.lit("-"), F.xxhash64("rel_path", "x.rule_ord", "x.pos").cast("string")))
    found = claims.withColumn("_key", key).join(known.withColumnRenamed("key", "_key"), "_key", "left")
    stem, target, n = F.col("key").startswith(_STEM), F.col("x.message"), F.coalesce("n", F.lit(0))
    refs = sorted(manifest.external_refs)
    external = F.lower(target).isin(refs) if refs else F.lit(False)
    many = stem & (n > 1)
    broken = F.col("key").isNotNull() & (n == 0) & ~(stem & external)
    if probe is not None:
        elsewhere = links.outside(F.substr("key", F.lit(2)), [r.path for r in manifest.roots])
        found = found.withColumn("_else", probe(F.when(broken & ~stem, elsewhere)))
        broken = broken & ~F.col("_else")
    kept = found.where(F.col("key").isNull() | broken | many)
    shown = lambda what: F.concat(F.lit(f"{what} wikilink: [["), target, F.lit("]]"))
    message = F.when(F.col("key").isNull(), target).when(~stem, F.concat(F.lit("broken markdown link: "), target)).when(many, shown("ambiguous")).otherwise(shown("broken"))
    ambiguous = F.coalesce(many, F.lit(False))
    return kept.select(
        "root_ord",
        F.split("rel_path", "/").alias("parts"),
        "x.rule_ord",
        (F.col("x.pos") + ambiguous.cast("int")).alias("pos"),
        F.when(ambiguous, "L003").otherwise(F.col("x.code")).alias("code"),
        "x.tier",
        "x.severity",
        F.col("rel_path").alias("file"),
        message.alias("message"),
    )


def r201(paths: DataFrame, roots: Sequence[Root], reserved: dict[str, str], level: str) -> DataFrame:
    """A row for each root and reserved file that isn't there."""
    spark = paths.sparkSession
    wanted = spark.createDataFrame([(n, r.path, f, k) for n, r in enumerate(roots) for k, f in enumerate(reserved.values())], "root_ord int, root string, rel_path string, k int")
    there = paths.select("path").distinct()
    missing = wanted.join(there, T.normal_path(F.concat_ws("/", "root", "rel_path")) == F.col("path"), "left_anti")
    finding = _finding("R201", F.concat(F.lit("reserved file missing in "), F.col("root"), F.lit(": "), F.col("rel_path")), "hygiene", severity_of(level), F.col("root_ord") * 1000 + F.col("k"))
    found = missing.select("rel_path", finding.alias("x"))
    return found.select(F.lit(1 << 30).alias("root_ord"), F.array().cast("array<string>").alias("parts"), "x.rule_ord", "x.pos", "x.code", "x.tier", "x.severity", F.col("rel_path").alias("file"), "x.message")


def diagnostics(rows: DataFrame, manifest: Manifest, index: DataFrame, paths: DataFrame | None, *, with_r201: bool = True, only: Collection[str] = RULES, probe: links.Probe | None = None) -> DataFrame:
    """All enabled rules (of `only`) over parsed rows, in one pass over them.

    Rules that look at one file, cohesion included, are columns; links become
    claims that one join with stems and paths settles. A rule that is off adds
    nothing to the plan.
    """
    rows = with_kind(rows, manifest.reserved)
    h, profile = manifest.hygiene, manifest.profile
    local = {"F001": f001, "F002": f002, "R001": lambda: r001(manifest.roots), "R002": r002}
    if profile is not None:
        if {"F101", "F106", "F102", "F105", "S102", "F201"} & {*only}:
            rows = with_type(rows, profile)
        local |= {"F101": f101, "F106": f106, "F102": lambda: f102(profile), "F105": lambda: f105(profile), "S102": lambda: s102(profile)}
        if h is not None and h.unknown_fields != "off":
            local["F201"] = lambda: f201(profile, h.unknown_fields)
    if h is not None and {"L001", "L003", "L002", "S202"} & {*only}:
        rows = rows.select(*(c for c in rows.columns if c != "masked"), T.once(F.col("masked")).alias("masked"))
    if h is not None and h.split_candidates != "off" and "S202" in only:
        rows = rows.withColumn("_clusters", s202(h))
        local["S202"] = lambda: split_finding(h)
    stands = [F.transform(F.concat(*found), lambda x: F.struct(x.alias("x"), F.lit(None).cast("string").alias("key")))] if (found := [f() for code, f in local.items() if code in only]) else []
    claims, known = [], []
    if h is not None and h.broken_links != "off":
        if {"L001", "L003"} & {*only}:
            claims.append(wikilink_claims(h.broken_links))
            known.append(index.select(F.concat(F.lit(_STEM), "stem").alias("key"), "n"))
        if "L002" in only and paths is not None:
            claims.append(mdlink_claims(h.broken_links))
            known.append(paths.select(F.concat(F.lit(_PATH), T.normal_path(F.col("path"))).alias("key"), F.lit(1).cast("long").alias("n")).distinct())
    every = [*stands, *claims]
    out = []
    if every:
        exploded = rows.select("root_ord", "rel_path", F.explode(F.concat(*every)).alias("_claim")).select("root_ord", "rel_path", "_claim.*")
        if known:
            out.append(settled(exploded, reduce(DataFrame.unionByName, known), manifest, probe).where(F.col("code").isin(list(only))))
        else:
            out.append(exploded.select("root_ord", F.split("rel_path", "/").alias("parts"), "x.rule_ord", "x.pos", "x.code", "x.tier", "x.severity", F.col("rel_path").alias("file"), "x.message"))
    if h is not None and h.reserved_files != "off" and with_r201 and paths is not None and "R201" in only:
        out.append(r201(paths, manifest.roots, manifest.reserved, h.reserved_files))
    if not out:
        return rows.sparkSession.createDataFrame([], EMPTY)
    return reduce(DataFrame.unionByName, out)


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(*ORDER)
