"""The registered queries over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.corpus import MANIFEST, corpus_sql, kb_files, kb_paths
from quillmesh.functions import text as T
from quillmesh.operators import cohesion, files, links, listing, rules, stats
from quillmesh.plans import audit, validate
from quillmesh.shipping import spread
from quillmesh.sources.config import Manifest, Root

_ROOTS = ["/kb/src1", "/kb/src", "/kb"]
_EXCLUDE = ["src1/**", "*/de/*7.md", "**/d1?.md"]
HYGIENE = MANIFEST.hygiene
_DIAGNOSTIC = ["code", "tier", "severity", "file", "message"]


def _read(spark, d, name) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def _parsed(spark, d) -> DataFrame:
    return files.parsed(kb_files(spark, d))


def _kinds(spark, d) -> DataFrame:
    return rules.with_kind(_parsed(spark, d), MANIFEST.reserved)


def _concepts(spark, d) -> DataFrame:
    return _kinds(spark, d).where("core_ok")


def _typed(spark, d) -> DataFrame:
    return rules.with_type(_concepts(spark, d), MANIFEST.profile)


def _wiki(spark, d, rows=None) -> DataFrame:
    kb = kb_files(spark, d)
    return links.resolve_wikilinks(links.wikilinks(files.parsed(kb) if rows is None else rows), links.stem_index(kb))


def _md(spark, d, rows=None) -> DataFrame:
    kb = kb_files(spark, d)
    return links.resolve_mdlinks(links.mdlinks(files.parsed(kb) if rows is None else rows), kb_paths(kb))


def _public(found: DataFrame) -> DataFrame:
    return found.select(*_DIAGNOSTIC)


def _all(spark, d, only=rules.RULES) -> DataFrame:
    kb = kb_files(spark, d)
    return rules.diagnostics(files.parsed(kb), MANIFEST, links.stem_index(kb), kb_paths(kb), only=only)


def _talks(spark, d) -> DataFrame:
    """Conversations as documents: a heading and a text for each turn."""
    t = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return t.select(F.col("conv_id").alias("doc"), F.array_join(F.transform("x", lambda s: F.concat(F.lit("# Turn\n"), F.coalesce(s["text"], F.lit("")))), "\n").alias("masked"))


def _merged(spark, d) -> DataFrame:
    return cohesion.merged(_talks(spark, d))


def _reserved(rows: DataFrame) -> DataFrame:
    return files.metrics(rows, list(MANIFEST.reserved.values()))


def okf_status_counts(spark, d):
    rows = _reserved(_parsed(spark, d)).where("not is_reserved")
    return rows.groupBy("okf_status").agg(F.count("*").alias("n"))


def frontmatter_split(spark, d):
    return kb_files(spark, d).select("rel_path", T.front_block(F.col("content")).alias("block"), F.length(T.after_front(F.col("content"))).cast("long").alias("body_chars"))


def excluded_paths(spark, d):
    return kb_files(spark, d).where(T.excluded(F.col("rel_path"), _EXCLUDE)).select("rel_path")


def target_filter(spark, d):
    return kb_files(spark, d).where((F.col("rel_path") == "src1") | F.col("rel_path").startswith("src1/")).select("rel_path")


def root_assignment(spark, d):
    paths = kb_files(spark, d).select(F.concat_ws("/", "root", "rel_path").alias("path"))
    return files.assign_root(paths, _ROOTS)


def mask_code(spark, d):
    return _parsed(spark, d).select("rel_path", "masked")


def mask_code_lines(spark, d):
    return _parsed(spark, d).select("rel_path", F.length("masked").cast("long").alias("chars"), F.length(F.regexp_replace("masked", r"\s", "")).cast("long").alias("marks"))


def headers_h1h2(spark, d):
    return _parsed(spark, d).select("rel_path", F.explode(T.headers(F.col("masked"))).alias("h")).groupBy("rel_path").agg(F.count("*").alias("n"), F.count_if(F.col("h.level") == 1).alias("h1"), F.max("h.line").cast("long").alias("last_line"))


def headers(spark, d):
    found = _parsed(spark, d).select("rel_path", F.explode(T.headers(F.col("masked"))).alias("h"))
    return found.select("rel_path", F.col("h.level").cast("long").alias("level"), F.col("h.text").alias("title"), F.col("h.line").cast("long").alias("line"))


def wikilinks_extract(spark, d):
    return links.wikilinks(_parsed(spark, d)).select("rel_path", F.col("pos").cast("long").alias("pos"), "raw", "target", "section", "alias")


def mdlinks_extract(spark, d):
    return links.mdlinks(_parsed(spark, d)).select("rel_path", F.col("pos").cast("long").alias("pos"), "text", "target", "is_external", "means")


def file_metrics(spark, d):
    return _reserved(_parsed(spark, d)).select("rel_path", F.col("depth").cast("long").alias("depth"), F.col("lines").cast("long").alias("lines"), F.col("chars").cast("long").alias("chars"))


def reserved_labels(spark, d):
    return kb_files(spark, d).withColumn("is_reserved", files.is_reserved(list(MANIFEST.reserved.values()))).groupBy("is_reserved").agg(F.count("*").alias("n"))


def net_lines(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.net_lines(F.coalesce("text", F.lit(""))).cast("long").alias("n"))


def tokens(spark, d):
    t = _read(spark, d, "documents").select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("distinct_n"), F.array_max("t").alias("last_token"), F.array_join("t", " ").alias("joined"))


def sections(spark, d):
    s = cohesion.sections(_parsed(spark, d).select(F.col("rel_path").alias("doc"), "masked"))
    return s.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("n_tokens"), F.max("line").cast("long").alias("last_line"))


def section_rows(spark, d):
    s = cohesion.sections(_parsed(spark, d).select(F.col("rel_path").alias("doc"), "masked"))
    return s.select("doc", F.col("idx").cast("long").alias("idx"), "title", F.col("level").cast("long").alias("level"), F.col("line").cast("long").alias("line"), "body", F.array_join("tokens", " ").alias("joined"))


def merged_sections(spark, d):
    m = cohesion.merged_rows(_merged(spark, d))
    return m.select(F.col("doc").alias("conv_id"), F.col("sec").cast("long").alias("sec"), F.size("tokens").cast("long").alias("n_tokens"), "title", F.array_join("tokens", " ").alias("joined"))


def stem_index(spark, d):
    return links.stem_index(kb_files(spark, d))


def wikilink_resolution(spark, d):
    return _wiki(spark, d).groupBy("rel_path").agg(F.count("*").alias("total"), F.count_if("broken").alias("broken"), F.count_if("ambiguous").alias("ambiguous"))


def wikilink_targets(spark, d):
    return _wiki(spark, d).select("rel_path", F.col("pos").cast("long").alias("pos"), "target", "resolved_path", "broken", "ambiguous")


def mdlink_resolution(spark, d):
    return _md(spark, d).select("rel_path", "target", "is_external", "broken")


def type_resolution(spark, d):
    return _typed(spark, d).select("rel_path", "type_text", "type_key", "by_alias")


def target_selection(spark, d):
    """Files of overlapping targets under overlapping roots: once for each target, under the first root that holds them."""
    outer = kb_files(spark, d).select("root_ord", "root", "rel_path", F.lit(False).alias("is_dir"), "content", "read_error")
    inner = outer.where(F.col("rel_path").startswith("src1/")).select(F.lit(0).alias("root_ord"), F.lit("/kb/src1").alias("root"), F.substring("rel_path", 6, 1 << 30).alias("rel_path"), "is_dir", "content", "read_error")
    roots = (Root("/kb/src1", ("en/*7.md",)), Root("/kb", ("src2/*",)))
    entries = inner.unionByName(outer.withColumn("root_ord", F.lit(1)))
    rows = validate.selected(entries, Manifest(roots, MANIFEST.reserved), ["/kb/src1", "/kb/src1/en", "/kb"])
    return rows.select(F.col("root_ord").cast("long").alias("root_ord"), "rel_path", "stem")


def union_index(spark, d):
    """The stem index over bundles, one for each source."""
    kb = kb_files(spark, d)
    bundles = kb.select(F.substring_index("rel_path", "/", 1).alias("root_ord"), F.regexp_replace("rel_path", r"\A[^/]*/", "").alias("rel_path"), "stem")
    return links.stem_index(bundles)


def file_reports(spark, d):
    kb = kb_files(spark, d)
    parsed, index, paths = files.parsed(kb), links.stem_index(kb), kb_paths(kb)
    wiki, md = links.resolve_wikilinks(links.wikilinks(parsed), index), links.resolve_mdlinks(links.mdlinks(parsed), paths)
    r = audit.file_reports(parsed, wiki, md, rules.diagnostics(parsed, MANIFEST, index, paths, with_r201=False), MANIFEST.reserved)
    joined = lambda name, f: F.array_join(F.transform(name, f), " ")
    return r.select(
        "rel_path",
        *(F.col(c).cast("long").alias(c) for c in ("depth", "lines", "chars")),
        "is_reserved",
        "okf_status",
        joined("wikilinks", lambda x: F.concat(x["raw"], F.when(x["broken"], "!").otherwise(""), F.when(x["ambiguous"], "?").otherwise(""))).alias("wikilinks"),
        joined("markdown_links", lambda x: F.concat(x["target"], F.when(x["broken"], "!").otherwise(""))).alias("markdown_links"),
        F.array_join(F.array_sort(F.transform("diagnostics", lambda x: F.concat_ws(" ", x["code"], x["message"]))), "; ").alias("diagnostics"),
        "split_candidate",
    )


def _rule(code):
    def run(spark, d):
        return _public(_all(spark, d, {code}))

    return run


def tf(spark, d):
    return cohesion.terms(_merged(spark, d)).select(F.col("doc").alias("conv_id"), F.col("sec").cast("long").alias("sec"), "term", "tf")


def df(spark, d):
    return cohesion.terms(_merged(spark, d)).groupBy("doc", "term").agg(F.count("*").alias("df")).withColumnRenamed("doc", "conv_id")


def tfidf_weights(spark, d):
    return cohesion.weights(_merged(spark, d)).select(F.col("doc").alias("conv_id"), F.col("sec").cast("long").alias("sec"), "term", F.round("w", 6).alias("w"))


def cosine_edges(spark, d):
    e = cohesion.edges(_merged(spark, d))
    return e.select(F.col("doc").alias("conv_id"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "sim")


def components(spark, d):
    c = cohesion.components(_merged(spark, d), 0.03)
    return c.groupBy("doc").agg(F.count("*").alias("sections"), F.count_distinct("component").alias("clusters")).withColumnRenamed("doc", "conv_id")


def section_components(spark, d):
    c = cohesion.components(_merged(spark, d), 0.03)
    return c.select(F.col("doc").alias("conv_id"), F.col("sec").cast("long").alias("sec"), F.col("component").cast("long").alias("component"))


def split_candidates(spark, d):
    return cohesion.cluster_counts(_talks(spark, d), 0.15).where("clusters > 1").withColumnRenamed("doc", "conv_id")


def corpus_stats(spark, d):
    return stats.corpus_stats(_reserved(_parsed(spark, d)))


def link_counts(spark, d):
    return stats.link_counts(_wiki(spark, d), _md(spark, d))


def diagnostics_all(spark, d):
    return _public(_all(spark, d))


def diagnostics_summary(spark, d):
    return stats.diagnostics_summary(_all(spark, d))


def root_counts(spark, d):
    kb = kb_files(spark, d)
    assigned = files.assign_root(kb.select(F.concat_ws("/", "root", "rel_path").alias("path")), _ROOTS)
    return stats.root_counts(assigned, _ROOTS).select("root", "file_count")


def vault_rollup(spark, d):
    rows = _reserved(_parsed(spark, d)).withColumn("bundle", F.substring_index("rel_path", "/", 1))
    return rows.rollup("bundle").agg(F.count("*").alias("files"), F.sum("lines").cast("long").alias("lines"), F.count_if("is_reserved").alias("reserved")).select(F.coalesce("bundle", F.lit("(all)")).alias("bundle"), "files", "lines", "reserved")


def gate_exit_code(spark, d):
    return stats.exit_code(_all(spark, d)).select(F.col("exit_code").cast("long").alias("exit_code"), "errors", "warnings")


def dir_listing(spark, d):
    return listing.directories(kb_files(spark, d)).select("dir", "parent")


def listing_text(spark, d):
    return listing.listings(_parsed(spark, d), MANIFEST.reserved).select("dir", "expected")


def changed_indexes(spark, d):
    kb = kb_files(spark, d)
    now = kb.where("name = 'index.md'")
    return listing.changed(listing.listings(files.parsed(kb), MANIFEST.reserved), now).select("dir")


def yaml_general(spark, d):
    return _parsed(spark, d).where("fm is not null").select("rel_path", "fm.json")


def unified_diff(spark, d):
    kb = kb_files(spark, d)
    c = listing.changed(listing.listings(files.parsed(kb), MANIFEST.reserved), kb.where("name = 'index.md'"))
    return c.select("dir", listing.unified_diff("content", "expected", F.concat_ws("/", "dir", F.lit("index.md"))).alias("diff"))


QUERIES = {
    "okf_status_counts": okf_status_counts,
    "frontmatter_split": frontmatter_split,
    "excluded_paths": excluded_paths,
    "target_filter": target_filter,
    "root_assignment": root_assignment,
    "mask_code": mask_code,
    "mask_code_lines": mask_code_lines,
    "headers": headers,
    "headers_h1h2": headers_h1h2,
    "wikilinks_extract": wikilinks_extract,
    "mdlinks_extract": mdlinks_extract,
    "file_metrics": file_metrics,
    "reserved_labels": reserved_labels,
    "net_lines": net_lines,
    "tokens": tokens,
    "sections": sections,
    "section_rows": section_rows,
    "merged_sections": merged_sections,
    "target_selection": target_selection,
    "union_index": union_index,
    "file_reports": file_reports,
    "wikilink_targets": wikilink_targets,
    "stem_index": stem_index,
    "wikilink_resolution": wikilink_resolution,
    "mdlink_resolution": mdlink_resolution,
    "type_resolution": type_resolution,
    **{f"rule_{code}": _rule(code) for code in rules.RULES},
    "tf": tf,
    "df": df,
    "tfidf_weights": tfidf_weights,
    "cosine_edges": cosine_edges,
    "components": components,
    "section_components": section_components,
    "split_candidates": split_candidates,
    "corpus_stats": corpus_stats,
    "link_counts": link_counts,
    "diagnostics_all": diagnostics_all,
    "diagnostics_summary": diagnostics_summary,
    "root_counts": root_counts,
    "vault_rollup": vault_rollup,
    "gate_exit_code": gate_exit_code,
    "dir_listing": dir_listing,
    "listing_text": listing_text,
    "changed_indexes": changed_indexes,
    "yaml_general": yaml_general,
    "unified_diff": unified_diff,
}


# The SQL. Common tables first; a query takes those it names.

_KB = corpus_sql("//")
_PATH = "regexp_replace(rel_path, '/[^/]*$', '')"
_FM = r"'(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*\r?\n?'"
_COMMON = {
    "kb": _KB,
    "named": f"SELECT *, split_part(rel_path, '/', -1) AS name, {_PATH} AS dir, regexp_replace(split_part(rel_path, '/', -1), '\\.md$', '') AS stem FROM kb",
    "fm": rf"SELECT *, regexp_matches(content, {_FM}) AS has_fm, regexp_extract(content, {_FM}, 1) AS block, regexp_extract(content, {_FM}, 0) AS whole FROM named",
    "parsed": r"""SELECT *, CASE WHEN has_fm THEN substr(content, length(whole) + 1) ELSE content END AS body,
        CASE WHEN has_fm THEN trim(regexp_extract(block, '(?m)^type: ?(.*)$', 1), '"') END AS type_text,
        CASE WHEN has_fm THEN list_transform(str_split(block, chr(10)), lambda x: split_part(x, ':', 1)) END AS keys,
        CASE WHEN has_fm AND regexp_matches(block, '(?m)^created:') THEN regexp_extract(block, '(?m)^created: (.*)$', 1) END AS created,
        CASE WHEN has_fm AND regexp_matches(block, '(?m)^status:') THEN regexp_extract(block, '(?m)^status: (.*)$', 1) END AS status,
        CASE WHEN has_fm AND regexp_matches(block, '(?m)^title:') THEN regexp_extract(block, '(?m)^title: (.*)$', 1) END AS title,
        CASE WHEN has_fm AND regexp_matches(block, '(?m)^description:') THEN regexp_extract(block, '(?m)^description: (.*)$', 1) END AS description
        FROM fm""",
    # The corpus has one fence, at the end of each file, and one inline span.
    "safe": r"SELECT *, regexp_replace(regexp_replace(body, '(?s)\n```\n.*\n```\n$', chr(10)), '`[^`\n]+`', '', 'g') AS masked FROM parsed",
    "blank": r"""SELECT rel_path, array_to_string(list_transform(list_zip(regexp_split_to_array(b, '`[^`\n]+`'), regexp_extract_all(b, '`[^`\n]+`')), lambda z: z[1] || repeat(' ', coalesce(length(z[2]), 0))), '') || regexp_replace(f, '[^\n]', ' ', 'g') AS masked
        FROM (SELECT rel_path, regexp_extract(body, '(?s)\n(```\n.*\n```\n)$', 1) AS f, substr(body, 1, length(body) - length(regexp_extract(body, '(?s)\n(```\n.*\n```\n)$', 1))) AS b FROM parsed)""",
    "concept": "SELECT * FROM safe WHERE name NOT IN ('index.md', 'log.md')",
    "fine": "SELECT * FROM concept WHERE has_fm AND type_text <> ''",
    "typed": "SELECT *, CASE WHEN lower(type_text) IN ('decision', 'adr') THEN 'Decision' WHEN lower(type_text) = 'journal' THEN 'Journal' END AS type_key, lower(type_text) = 'adr' AS by_alias FROM fine",
    "stems": "SELECT stem, count(*) AS n, min(rel_path) AS low FROM named GROUP BY stem",
    "wl0": r"SELECT rel_path, name, has_fm, type_text, unnest(regexp_extract_all(masked, '\[\[([^\[\]#|]+?)(?:#([^\[\]|]*?))?(?:\|([^\[\]]*?))?\]\]', 0)) AS raw, generate_subscripts(regexp_extract_all(masked, '\[\[([^\[\]#|]+?)(?:#([^\[\]|]*?))?(?:\|([^\[\]]*?))?\]\]', 0), 1) - 1 AS pos FROM safe",
    "wl": r"""SELECT *, trim(regexp_extract(raw, '^\[\[([^\[\]#|]+)', 1)) AS target,
        CASE WHEN raw LIKE '%#%' THEN trim(regexp_extract(raw, '#([^|\]]*)', 1)) END AS section,
        CASE WHEN contains(raw, '|') THEN trim(regexp_extract(raw, '\|([^\]]*)', 1)) END AS alias FROM wl0""",
    "wr": "SELECT wl.*, coalesce(n, 0) = 0 AS broken, coalesce(n, 0) > 1 AS ambiguous FROM wl LEFT JOIN stems ON wl.target = stems.stem",
    "ml0": r"SELECT rel_path, name, dir, has_fm, type_text, unnest(regexp_extract_all(masked, '\[([^\[\]]*)\]\(([^()]+)\)', 0)) AS raw FROM safe",
    "ml1": r"SELECT *, regexp_extract(raw, '^\[([^\[\]]*)\]', 1) AS text, trim(regexp_extract(raw, '\(([^()]+)\)$', 1)) AS target FROM ml0",
    "ml": r"""SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY CASE text WHEN 'next' THEN 0 WHEN 'up' THEN 1 ELSE 2 END) - 1 AS pos, regexp_matches(target, '^(https?|ftp)://') AS is_external,
        CASE WHEN NOT regexp_matches(target, '^(https?|ftp)://') THEN '/kb/' || CASE WHEN target LIKE '../%' THEN regexp_replace(dir, '/[^/]*$', '') || '/' || replace(substr(target, 4), '/./', '/') ELSE dir || '/' || split_part(target, '#', 1) END END AS means
        FROM ml1 WHERE split_part(target, '#', 1) <> ''""",
    "mr": "SELECT ml.*, NOT is_external AND means NOT IN (SELECT '/kb/' || rel_path FROM kb) AS broken FROM ml",
    "turns": "SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS idx FROM conversations",
    "turn_tokens": r"SELECT conv_id, idx, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) >= 2) AS toks FROM (SELECT conv_id, idx, text FROM turns UNION ALL SELECT DISTINCT conv_id, 0, '' FROM turns)",
    "summed": "SELECT *, len(toks) AS n, sum(len(toks)) OVER (PARTITION BY conv_id ORDER BY idx) AS cum FROM turn_tokens",
    "headed": "SELECT *, min(CASE WHEN cum >= 20 THEN idx END) OVER (PARTITION BY conv_id) AS head FROM summed",
    "grouped": "SELECT *, sum(CASE WHEN head IS NOT NULL AND idx > head AND n >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx) AS sec FROM headed",
    "merged": "SELECT conv_id, sec, flatten(list(toks ORDER BY idx)) AS toks, CASE WHEN coalesce(CASE WHEN sec = 0 THEN max(head) END, CASE WHEN sec = 0 THEN max(idx) ELSE min(idx) END) > 0 THEN 'Turn' END AS title FROM grouped GROUP BY conv_id, sec",
    "tf": "SELECT conv_id, sec, term, count(*) AS tf FROM (SELECT conv_id, sec, unnest(toks) AS term FROM merged) GROUP BY ALL",
    "dfs": "SELECT conv_id, term, count(*) AS df FROM tf GROUP BY ALL",
    "sizes": "SELECT conv_id, count(*) AS n FROM merged GROUP BY conv_id",
    "w": "SELECT tf.conv_id, sec, tf.term, tf * ln(n / df) AS w FROM tf JOIN dfs USING (conv_id, term) JOIN sizes USING (conv_id) WHERE df < n",
    "norms": "SELECT conv_id, sec, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL",
    "dots": "SELECT a.conv_id, a.sec AS a, b.sec AS b, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.term = b.term AND a.sec < b.sec GROUP BY ALL",
    "edges": "SELECT d.conv_id, a, b, round(dot / (x.norm * y.norm), 6) AS sim FROM dots d JOIN norms x ON d.conv_id = x.conv_id AND d.a = x.sec JOIN norms y ON d.conv_id = y.conv_id AND d.b = y.sec",
    "diag": None,
}


def _sql(select: str, *names: str) -> str:
    """A query over common tables, each with those it reads."""
    order = list(_COMMON)
    need: set[str] = set()

    def take(n: str) -> None:
        if n in need:
            return
        need.add(n)
        for m in order:
            if m != n and f" {m} " in f" {_COMMON[n]} ".replace("\n", " ").replace(",", " ,").replace(")", " ) "):
                take(m)

    for n in names:
        take(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_COMMON[n]})" for n in order if n in need) + " " + select


def _diag(code: str, tier: str, severity: str, message: str, source: str) -> str:
    return f"SELECT '{code}' AS code, '{tier}' AS tier, '{severity}' AS severity, rel_path AS file, {message} AS message FROM {source}"


_RULE_SQL = {
    "rule_F001": (_diag("F001", "core", "error", "'frontmatter absent or unparsable'", "concept WHERE NOT has_fm"), "concept"),
    "rule_F002": (_diag("F002", "core", "error", "'`type` field absent or empty'", "concept WHERE has_fm AND type_text = ''"), "concept"),
    "rule_R001": (_diag("R001", "core", "error", "'frontmatter forbidden in index.md (only `okf_version` allowed at root)'", "safe WHERE name = 'index.md' AND has_fm"), "safe"),
    "rule_R002": (_diag("R002", "core", "error", "'non-ISO date heading in log.md: `' || h || '`'", r"(SELECT rel_path, trim(unnest(regexp_extract_all(masked, '(?m)^##[ \t]+(.+)$', 1))) AS h FROM safe WHERE name = 'log.md')"), "safe"),
    "rule_F101": (_diag("F101", "profile", "error", "'`type` value not in declared types: `' || type_text || '`'", "typed WHERE type_key IS NULL"), "typed"),
    "rule_F106": (_diag("F106", "profile", "error", "'non-normalised `type` spelling: `' || type_text || '` → use `' || type_key || '`'", "typed WHERE by_alias"), "typed"),
    "rule_F102": (
        _diag("F102", "profile", "error", "'missing required field: `' || f || '`'", "(SELECT rel_path, unnest(list_filter(CASE type_key WHEN 'Decision' THEN ['status', 'created'] WHEN 'Journal' THEN ['created'] END, lambda x: NOT list_contains(keys, x))) AS f FROM typed)"),
        "typed",
    ),
    "rule_F105": (_diag("F105", "profile", "error", "'value outside vocabulary: `status=' || status || '` (allowed: [''open'', ''closed''])'", "typed WHERE type_key = 'Decision' AND status NOT IN ('open', 'closed')"), "typed"),
    "rule_S102": (_diag("S102", "profile", "error", "'incorrectly formatted date: `created=' || created || '` (expected YYYY-MM-DD)'", r"typed WHERE type_key IS NOT NULL AND NOT regexp_matches(created, '^\d{4}-\d{2}-\d{2}$')"), "typed"),
    "rule_L001": (_diag("L001", "hygiene", "warning", "'broken wikilink: [[' || target || ']]'", "wr WHERE name NOT IN ('index.md', 'log.md') AND has_fm AND type_text <> '' AND broken AND lower(target) <> 'gone2'"), "wr"),
    "rule_L003": (_diag("L003", "hygiene", "warning", "'ambiguous wikilink: [[' || target || ']]'", "wr WHERE name NOT IN ('index.md', 'log.md') AND has_fm AND type_text <> '' AND ambiguous"), "wr"),
    "rule_L002": (_diag("L002", "hygiene", "warning", "'broken markdown link: ' || target", "mr WHERE name NOT IN ('index.md', 'log.md') AND has_fm AND type_text <> '' AND broken"), "mr"),
    "rule_F201": (
        _diag("F201", "hygiene", "warning", "'unknown field in frontmatter: `' || f || '`'", "(SELECT rel_path, unnest(list_filter(keys, lambda x: NOT list_contains(CASE type_key WHEN 'Decision' THEN ['type', 'status', 'created', 'title', 'tags'] ELSE ['type', 'created', 'title', 'description'] END, x))) AS f FROM typed WHERE type_key IS NOT NULL)"),
        "typed",
    ),
    "rule_R201": ("SELECT 'R201' AS code, 'hygiene' AS tier, 'error' AS severity, f AS file, 'reserved file missing in /kb: ' || f AS message FROM (SELECT unnest(['index.md', 'log.md']) AS f) WHERE f NOT IN (SELECT rel_path FROM kb)", "kb"),
}
# S202 over the corpus: sections from heading lines, then the same algebra as for conversations; components by label propagation.
_COMMON |= {
    "lines": r"SELECT rel_path AS conv_id, unnest(str_split(masked, chr(10))) AS line, generate_subscripts(str_split(masked, chr(10)), 1) AS i FROM fine WHERE len(list_filter(str_split(body, chr(10)), lambda x: trim(x) <> '')) > 8",
    "cut": r"SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s+.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS idx, regexp_matches(line, '^#{1,6}\s+.+$') AS is_head FROM lines",
    "k_tokens": r"SELECT conv_id, idx, list_filter(regexp_extract_all(lower(coalesce(string_agg(CASE WHEN NOT is_head THEN line END, chr(10) ORDER BY i), '')), '[\p{L}\p{N}]+'), lambda x: length(x) >= 2) AS toks FROM (SELECT conv_id, idx, line, is_head, i FROM cut UNION ALL SELECT DISTINCT conv_id, 0, '', FALSE, 0 FROM cut) GROUP BY conv_id, idx",
    "k_summed": "SELECT *, len(toks) AS n, sum(len(toks)) OVER (PARTITION BY conv_id ORDER BY idx) AS cum FROM k_tokens",
    "k_headed": "SELECT *, min(CASE WHEN cum >= 20 THEN idx END) OVER (PARTITION BY conv_id) AS head FROM k_summed",
    "k_grouped": "SELECT *, sum(CASE WHEN head IS NOT NULL AND idx > head AND n >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx) AS sec FROM k_headed",
    "k_merged": "SELECT conv_id, sec, flatten(list(toks ORDER BY idx)) AS toks FROM k_grouped GROUP BY conv_id, sec",
}
ORACLES = {
    "okf_status_counts": _sql("SELECT CASE WHEN NOT has_fm THEN 'non_conformant' WHEN type_text <> '' THEN 'conformant' ELSE 'partial' END AS okf_status, count(*) AS n FROM parsed WHERE name NOT IN ('index.md', 'log.md') GROUP BY 1", "parsed"),
    "frontmatter_split": _sql("SELECT rel_path, CASE WHEN has_fm THEN block END AS block, length(content) - CASE WHEN has_fm THEN length(whole) ELSE 0 END AS body_chars FROM fm", "fm"),
    "excluded_paths": _sql("SELECT rel_path FROM kb WHERE rel_path LIKE 'src1/%' OR rel_path LIKE '%/de/%7.md' OR rel_path LIKE '%/d1_.md'", "kb"),
    "target_filter": _sql("SELECT rel_path FROM kb WHERE rel_path LIKE 'src1/%'", "kb"),
    "root_assignment": _sql("SELECT '/kb/' || rel_path AS path, CASE WHEN rel_path LIKE 'src1/%' THEN 0 ELSE 2 END AS root_ord, CASE WHEN rel_path LIKE 'src1/%' THEN '/kb/src1' ELSE '/kb' END AS root FROM kb", "kb"),
    "mask_code_lines": _sql(r"SELECT rel_path, length(body) AS chars, length(regexp_replace(regexp_replace(regexp_replace(body, '(?s)\n```\n.*\n```\n$', ''), '`[^`\n]+`', '', 'g'), '[ \t\n\r\f\v]', '', 'g')) AS marks FROM parsed", "parsed"),
    "headers_h1h2": _sql(
        r"SELECT rel_path, count(*) AS n, count(*) FILTER (line LIKE '# %') AS h1, max(i) AS last_line FROM (SELECT rel_path, unnest(str_split(masked, chr(10))) AS line, generate_subscripts(str_split(masked, chr(10)), 1) AS i FROM safe) WHERE regexp_matches(line, '^#{1,2}\s+.+$') GROUP BY rel_path", "safe"
    ),
    "wikilinks_extract": _sql("SELECT rel_path, pos, raw, target, section, alias FROM wl", "wl"),
    "mdlinks_extract": _sql("SELECT rel_path, pos, text, target, is_external, means FROM ml", "ml"),
    "file_metrics": _sql("SELECT rel_path, length(rel_path) - length(replace(rel_path, '/', '')) AS depth, length(content) - length(replace(content, chr(10), '')) AS lines, length(content) AS chars FROM kb", "kb"),
    "reserved_labels": _sql("SELECT name IN ('index.md', 'log.md') AS is_reserved, count(*) AS n FROM named GROUP BY 1", "named"),
    "net_lines": "SELECT doc_id, len(list_filter(str_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS n FROM documents",
    "tokens": r"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS distinct_n, list_max(t) AS last_token, array_to_string(t, ' ') AS joined FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), lambda x: length(x) >= 2) AS t FROM documents)",
    "sections": _sql(
        r"SELECT doc, count(DISTINCT idx) AS n, sum(len(list_filter(regexp_extract_all(lower(CASE WHEN is_head THEN '' ELSE line END), '[\p{L}\p{N}]+'), lambda x: length(x) >= 2))) AS n_tokens, max(CASE WHEN is_head THEN i ELSE 1 END) AS last_line FROM (SELECT *, sum(is_head::INT) OVER (PARTITION BY doc ORDER BY i) AS idx FROM (SELECT *, regexp_matches(line, '^#{1,6}\s+.+$') AS is_head FROM (SELECT rel_path AS doc, unnest(str_split(masked, chr(10))) AS line, generate_subscripts(str_split(masked, chr(10)), 1) AS i FROM safe) UNION ALL SELECT rel_path, '', 0, FALSE FROM safe)) GROUP BY doc",
        "safe",
    ),
    "merged_sections": _sql("SELECT conv_id, sec, len(toks) AS n_tokens, title, array_to_string(toks, ' ') AS joined FROM merged", "merged"),
    "mask_code": _sql("SELECT rel_path, masked FROM blank", "blank"),
    "headers": _sql(
        r"SELECT rel_path, length(regexp_extract(line, '^#+')) AS level, trim(regexp_replace(line, '^#+', '')) AS title, i AS line FROM (SELECT rel_path, unnest(str_split(masked, chr(10))) AS line, generate_subscripts(str_split(masked, chr(10)), 1) AS i FROM blank) WHERE regexp_matches(line, '^#{1,2}\s+.+$')", "blank"
    ),
    "section_rows": _sql(
        r"""SELECT doc, idx, title, level, line, body, array_to_string(list_filter(regexp_extract_all(lower(body), '[\p{L}\p{N}]+'), lambda x: length(x) >= 2), ' ') AS joined FROM (
            SELECT doc, idx, max(CASE WHEN h THEN trim(regexp_replace(x, '^#+', '')) END) AS title, max(CASE WHEN h THEN length(regexp_extract(x, '^#+')) END) AS level, coalesce(max(CASE WHEN h THEN i END), 1) AS line,
                regexp_replace(coalesce(string_agg(CASE WHEN NOT h THEN x END, chr(10) ORDER BY i), ''), '^\n+|\n+$', '', 'g') AS body
            FROM (SELECT *, sum(h::INT) OVER (PARTITION BY doc ORDER BY i) AS idx FROM (SELECT *, regexp_matches(x, '^#{1,6}\s+.+$') AS h FROM (
                SELECT rel_path AS doc, unnest(str_split(masked, chr(10))) AS x, generate_subscripts(str_split(masked, chr(10)), 1) AS i FROM blank) UNION ALL SELECT rel_path, NULL, 0, FALSE FROM blank)) GROUP BY doc, idx)""",
        "blank",
    ),
    "wikilink_targets": _sql("SELECT rel_path, pos, target, first_path AS resolved_path, broken, ambiguous FROM wr LEFT JOIN (SELECT stem, arg_min(rel_path, str_split(rel_path, '/')) AS first_path FROM named GROUP BY stem) f ON wr.target = f.stem", "wr", "named"),
    "target_selection": _sql(
        "SELECT 0 AS root_ord, substr(rel_path, 6) AS rel_path, stem FROM named WHERE rel_path LIKE 'src1/%' AND NOT regexp_matches(rel_path, '^src1/en/.*7[.]md$')"
        " UNION ALL SELECT 0, substr(rel_path, 6), stem FROM named WHERE rel_path LIKE 'src1/en/%' AND NOT regexp_matches(rel_path, '^src1/en/.*7[.]md$')"
        " UNION ALL SELECT CASE WHEN rel_path LIKE 'src1/%' THEN 0 ELSE 1 END, CASE WHEN rel_path LIKE 'src1/%' THEN substr(rel_path, 6) ELSE rel_path END, stem FROM named WHERE rel_path NOT LIKE 'src2/%'",
        "named",
    ),
    "union_index": _sql("SELECT stem, count(*) AS n, arg_min(regexp_replace(rel_path, '^[^/]*/', ''), str_split(rel_path, '/')) AS first_path FROM named GROUP BY stem", "named"),
    "yaml_general": _sql("SELECT rel_path, '{' || string_agg('\"' || split_part(x, ': ', 1) || '\": \"' || trim(split_part(x, ': ', 2), '\"') || '\"', ', ' ORDER BY i) || '}' AS json FROM (SELECT rel_path, unnest(str_split(block, chr(10))) AS x, generate_subscripts(str_split(block, chr(10)), 1) AS i FROM fm WHERE has_fm) GROUP BY rel_path", "fm"),
    "stem_index": _sql("SELECT stem, count(*) AS n, arg_min(rel_path, str_split(rel_path, '/')) AS first_path FROM named GROUP BY stem", "named"),
    "wikilink_resolution": _sql("SELECT rel_path, count(*) AS total, count(*) FILTER (broken) AS broken, count(*) FILTER (ambiguous) AS ambiguous FROM wr GROUP BY rel_path", "wr"),
    "mdlink_resolution": _sql("SELECT rel_path, target, is_external, broken FROM mr", "mr"),
    "type_resolution": _sql("SELECT rel_path, type_text, type_key, by_alias FROM typed", "typed"),
    **{k: _sql(q, t) for k, (q, t) in _RULE_SQL.items()},
    "tf": _sql("SELECT conv_id, sec, term, tf FROM tf", "tf"),
    "df": _sql("SELECT conv_id, term, df FROM dfs", "dfs"),
    "tfidf_weights": _sql("SELECT conv_id, sec, term, round(w, 6) AS w FROM w", "w"),
    "cosine_edges": _sql("SELECT conv_id, a, b, sim FROM edges", "edges"),
    "corpus_stats": _sql(
        "SELECT count(*) AS total_files, count(*) FILTER (NOT r) AS total_concept_files, count(*) FILTER (r) AS total_reserved_files, sum(length(content) - length(replace(content, chr(10), '')))::BIGINT AS total_lines, sum(length(content))::BIGINT AS total_chars, count(*) FILTER (NOT r AND has_fm AND type_text <> '') AS conformant, count(*) FILTER (NOT r AND has_fm AND type_text = '') AS partial, count(*) FILTER (NOT r AND NOT has_fm) AS non_conformant FROM (SELECT *, name IN ('index.md', 'log.md') AS r FROM parsed)",
        "parsed",
    ),
    "link_counts": _sql("SELECT * FROM (SELECT count(*) AS total_wikilinks, count(*) FILTER (broken) AS broken_wikilinks, count(*) FILTER (ambiguous) AS ambiguous_wikilinks FROM wr), (SELECT count(*) AS total_markdown_links, count(*) FILTER (broken) AS broken_markdown_links FROM mr)", "wr", "mr"),
    "root_counts": _sql("SELECT '/kb/src1' AS root, count(*) FILTER (rel_path LIKE 'src1/%') AS file_count FROM kb UNION ALL SELECT '/kb/src', 0 UNION ALL SELECT '/kb', count(*) FILTER (rel_path NOT LIKE 'src1/%') FROM kb", "kb"),
    "vault_rollup": _sql("SELECT coalesce(bundle, '(all)') AS bundle, count(*) AS files, sum(n)::BIGINT AS lines, count(*) FILTER (r) AS reserved FROM (SELECT split_part(rel_path, '/', 1) AS bundle, length(content) - length(replace(content, chr(10), '')) AS n, name IN ('index.md', 'log.md') AS r FROM named) GROUP BY ROLLUP (bundle)", "named"),
    "dir_listing": _sql("SELECT DISTINCT array_to_string(p[1:k], '/') AS dir, CASE WHEN k > 0 THEN array_to_string(p[1:k - 1], '/') END AS parent FROM (SELECT str_split(dir, '/') AS p FROM named), (SELECT unnest([0, 1, 2, 3]) AS k)", "named"),
}
_DIRS = "SELECT DISTINCT array_to_string(p[1:k], '/') AS dir, CASE WHEN k > 0 THEN array_to_string(p[1:k - 1], '/') END AS parent, CASE WHEN k > 0 THEN p[k] END AS own FROM (SELECT str_split(dir, '/') AS p FROM named), (SELECT unnest([0, 1, 2, 3]) AS k)"
_COMMON["dirs"] = _DIRS
_COMMON["listed"] = """SELECT dirs.dir, coalesce(t, '') AS expected FROM dirs LEFT JOIN (SELECT dir, string_agg(line, chr(10) ORDER BY k, low, nm, line) || chr(10) AS t FROM (
    SELECT parent AS dir, 0 AS k, lower(own) AS low, own AS nm, '- [' || own || '/](' || own || '/index.md)' AS line FROM dirs WHERE parent IS NOT NULL
    UNION ALL SELECT dir, 1, lower(name), name, '- [' || coalesce(title, stem) || '](' || name || ')' || coalesce(' — ' || description, '') FROM parsed WHERE name NOT IN ('index.md', 'log.md')) GROUP BY dir) x ON dirs.dir = x.dir"""
ORACLES |= {
    "listing_text": _sql("SELECT dir, expected FROM listed", "named", "parsed", "dirs", "listed"),
    "changed_indexes": _sql("SELECT dir FROM listed LEFT JOIN (SELECT dir, content FROM named WHERE name = 'index.md') c USING (dir) WHERE expected <> coalesce(content, '')", "named", "parsed", "dirs", "listed"),
}


def _clusters(merged: str, tau: float) -> str:
    """Components by labels that go down along edges (no more steps than sections)."""
    k = {n: _COMMON[n].replace(" merged", f" {merged}") for n in ("tf", "dfs", "sizes", "w", "norms", "dots", "edges")}
    body = ", ".join(f"{n} AS ({q})" for n, q in k.items())
    return f"""{body}, nodes AS (SELECT conv_id, sec FROM {merged}),
    twoway AS (SELECT conv_id, a, b FROM edges WHERE sim > {tau} UNION SELECT conv_id, b, a FROM edges WHERE sim > {tau}),
    reach(conv_id, sec, label) AS (SELECT conv_id, sec, sec FROM nodes UNION SELECT r.conv_id, twoway.b, r.label FROM reach r JOIN twoway ON r.conv_id = twoway.conv_id AND r.sec = twoway.a),
    comp AS (SELECT conv_id, sec, min(label) AS component FROM reach GROUP BY conv_id, sec)"""


def _talk_clusters(select: str, tau: float) -> str:
    return _sql("", "merged").rstrip() + ", " + _clusters("merged", tau) + " " + select


ORACLES |= {
    "components": _talk_clusters("SELECT conv_id, count(*) AS sections, count(DISTINCT component) AS clusters FROM comp GROUP BY conv_id", 0.03),
    "section_components": _talk_clusters("SELECT conv_id, sec, component FROM comp", 0.03),
    "split_candidates": _talk_clusters("SELECT conv_id, count(DISTINCT component) AS clusters FROM comp GROUP BY conv_id HAVING count(DISTINCT component) > 1", 0.15),
    "rule_S202": _sql("", "fine", "lines", "cut", "k_tokens", "k_summed", "k_headed", "k_grouped", "k_merged").rstrip()
    + ", "
    + _clusters("k_merged", HYGIENE.split.tau)
    + " SELECT 'S202' AS code, 'hygiene' AS tier, 'warning' AS severity, conv_id AS file, 'S202 — split candidate (' || count(DISTINCT component) || ' cohesion clusters)' AS message FROM comp GROUP BY conv_id HAVING count(DISTINCT component) > 1",
}
_EVERY = " UNION ALL ".join(f"({q})" for q, _ in _RULE_SQL.values())
_S202 = ORACLES["rule_S202"]
_EVERY_SQL = f"SELECT * FROM ({_sql(_EVERY, 'wr', 'mr', 'typed')}) UNION ALL SELECT * FROM ({_S202})"
ORACLES |= {
    "diagnostics_all": _EVERY_SQL,
    "diagnostics_summary": f"WITH every AS ({_EVERY_SQL}), zero AS (SELECT unnest(['severity', 'severity', 'tier', 'tier', 'tier']) AS kind, unnest(['error', 'warning', 'core', 'profile', 'hygiene']) AS value, 0 AS one) SELECT kind, value, sum(one)::BIGINT AS n FROM (SELECT 'severity' AS kind, severity AS value, 1 AS one FROM every UNION ALL SELECT 'tier', tier, 1 FROM every UNION ALL SELECT 'code', code, 1 FROM every UNION ALL SELECT * FROM zero) GROUP BY kind, value",
    "gate_exit_code": f"WITH every AS ({_EVERY_SQL}) SELECT max(CASE WHEN severity = 'error' THEN 1 ELSE 0 END)::BIGINT AS exit_code, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM every",
}
ORACLES["file_reports"] = _sql(
    f"""SELECT rel_path, length(rel_path) - length(replace(rel_path, '/', '')) AS depth, length(content) - length(replace(content, chr(10), '')) AS lines, length(content) AS chars, name IN ('index.md', 'log.md') AS is_reserved,
        CASE WHEN NOT has_fm THEN 'non_conformant' WHEN type_text <> '' THEN 'conformant' ELSE 'partial' END AS okf_status, coalesce(w.t, '') AS wikilinks, coalesce(m.t, '') AS markdown_links, coalesce(e.t, '') AS diagnostics, coalesce(e.split, FALSE) AS split_candidate
    FROM parsed
    LEFT JOIN (SELECT rel_path, string_agg(raw || CASE WHEN broken THEN '!' ELSE '' END || CASE WHEN ambiguous THEN '?' ELSE '' END, ' ' ORDER BY pos) AS t FROM wr GROUP BY rel_path) w USING (rel_path)
    LEFT JOIN (SELECT rel_path, string_agg(target || CASE WHEN broken THEN '!' ELSE '' END, ' ' ORDER BY pos) AS t FROM mr GROUP BY rel_path) m USING (rel_path)
    LEFT JOIN (SELECT file AS rel_path, string_agg(code || ' ' || message, '; ' ORDER BY code || ' ' || message) AS t, bool_or(code = 'S202') AS split FROM ({_EVERY_SQL}) WHERE code <> 'R201' GROUP BY file) e USING (rel_path)""",
    "parsed",
    "wr",
    "mr",
)
