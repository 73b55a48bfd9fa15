"""The report: an inventory of files with links, status, diagnostics and totals."""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import files, links, rules, stats
from quillmesh.sources.config import DEFAULT_RESERVED, Manifest, Root
from quillmesh.sources.tree import as_files, as_paths, exists, read_tree


def file_reports(parsed: DataFrame, wiki: DataFrame, md: DataFrame, found: DataFrame, reserved: dict[str, str]) -> DataFrame:
    """A row for each file, with its links and diagnostics as arrays of structs."""
    key = ["root_ord", "rel_path"]
    rows = files.metrics(parsed, list(reserved.values())).select(*key, "depth", "lines", "chars", "is_reserved", "okf_status", F.col("fm.json").alias("frontmatter"))

    def gathered(df: DataFrame, name: str, order: list[str], columns: list[str]) -> DataFrame:
        return df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias("_x")).select(*key, F.transform("_x", lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias(name))

    w = gathered(wiki, "wikilinks", ["pos"], ["raw", "target", "alias", "section", "resolved_path", "broken", "ambiguous"])
    m = gathered(md, "markdown_links", ["pos"], ["text", "target", "is_external", "broken"])
    d = gathered(found.withColumnRenamed("file", "rel_path").withColumn("file", F.col("rel_path")), "diagnostics", ["rule_ord", "pos"], rules.PUBLIC)
    out = rows.join(w, key, "left").join(m, key, "left").join(d, key, "left")
    for name, of in (("wikilinks", w), ("markdown_links", m), ("diagnostics", d)):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(of.schema[name].dataType)))
    return out.withColumn("split_candidate", F.exists("diagnostics", lambda x: x["code"] == "S202"))


@dataclass
class Audit:
    """A report: its totals, and the files' rows as JSON texts, in order."""

    head: dict
    lines: DataFrame  # order keys and line

    def files(self) -> Iterator[dict]:
        """The files' reports, a partition at a time."""
        for r in self.lines.orderBy("root_ord", "parts").select("line").toLocalIterator():
            f = json.loads(r["line"])
            f["frontmatter"] = None if f["frontmatter"] is None else json.loads(f["frontmatter"])
            yield f

    def as_dict(self) -> dict:
        return {**self.head, "files": list(self.files())}

    def dump(self, out: TextIO) -> None:
        """The report as JSON; no more than a partition of the files' rows is held."""
        out.write(json.dumps(self.head, indent=2, ensure_ascii=False)[:-2] + ',\n  "files": [')
        for n, f in enumerate(self.files()):
            out.write((",\n    " if n else "\n    ") + json.dumps(f, ensure_ascii=False))
        out.write("]\n}")


def run_audit(spark: SparkSession, roots: list[Root], vault_roots: list[str] | None = None, manifest: Manifest | None = None, target: str | None = None, index: DataFrame | None = None) -> Audit:
    """The audit report. The stem index comes from vault_roots without exclusions; missing reserved files are not its matter.

    Without a manifest only the core rules are checked.
    """
    places = vault_roots or [r.path for r in roots]
    entries = read_tree(spark, [r.path for r in roots])
    rows = as_files(entries, tuple(roots))
    every = as_files(read_tree(spark, places, contents=False), ()) if index is None or vault_roots else rows
    if target is not None:
        t = os.path.realpath(target)
        path = F.concat_ws("/", "root", "rel_path")
        rows = rows.where((path == t) | path.startswith(t.rstrip("/") + "/"))
    reserved = manifest.reserved if manifest else DEFAULT_RESERVED
    parsed = files.parsed(rows).persist()
    stems = links.stem_index(every) if index is None else index
    paths, places_read = as_paths(entries), [r.path for r in roots]
    wiki, md = links.resolve_wikilinks(links.wikilinks(parsed), stems), links.resolve_mdlinks(links.mdlinks(parsed), paths, places_read, exists)
    bare = manifest or Manifest(roots=tuple(roots), reserved=reserved)
    found = rules.diagnostics(parsed, bare, stems, paths, with_r201=False, probe=exists).persist()
    reports = file_reports(parsed, wiki, md, found, reserved).withColumnRenamed("rel_path", "path").persist()
    whole = F.to_json(F.struct("path", *(c for c in reports.columns if c not in ("root_ord", "path"))), {"ignoreNullFields": "false"})
    totals = stats.corpus_stats(files.metrics(parsed, list(reserved.values()))).first().asDict()
    by_status = {s: totals.pop(s) for s in stats.STATUSES}
    summary: dict = {"by_severity": dict.fromkeys(stats.SEVERITIES, 0), "by_tier": dict.fromkeys(stats.TIERS, 0), "by_code": {}}
    for r in stats.diagnostics_summary(found).collect():  # a row for each severity, tier and code
        summary[f"by_{r['kind']}"][r["value"]] = r["n"]
    counts = {r["root"]: r["file_count"] for r in stats.root_counts(parsed, [r.path for r in roots]).collect()}
    head = {
        "generated_at": datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S"),
        "bundle_paths": [r.path for r in roots],
        "vault_paths": places,
        "roots": [{"path": r.path, "file_count": counts[r.path]} for r in roots],
        "stats": {**totals, "by_okf_status": by_status, **stats.link_counts(wiki, md).first().asDict(), "split_candidates": reports.where("split_candidate").count(), "vault_total_files": every.count()},
        "diagnostics_summary": summary,
    }
    return Audit(head, reports.select("root_ord", F.split("path", "/").alias("parts"), whole.alias("line")))


def roll_up(heads: list[dict]) -> dict:
    """The sums of bundles' statistics."""
    names = ("total_files", "total_concept_files", "total_wikilinks", "broken_wikilinks", "total_markdown_links", "broken_markdown_links", "split_candidates")
    out: dict = {n: sum(h["stats"][n] for h in heads) for n in names}
    out["by_okf_status"] = {s: sum(h["stats"]["by_okf_status"].get(s, 0) for h in heads) for s in stats.STATUSES}
    return out


def write_report(dump: Callable[[TextIO], None], suffix: str = "audit", folder: str = ".quillmesh") -> str:
    """Writes a report under the first free version of today's name."""
    os.makedirs(folder, exist_ok=True)
    today, v = datetime.date.today().isoformat(), 1
    while os.path.exists(at := os.path.join(folder, f"{today}_{suffix}_v{v}.json")):
        v += 1
    with open(at, "w", encoding="utf-8") as f:
        dump(f)
    return at


def dump_all(audits: list[Audit], out: TextIO) -> None:
    """The reports of a vault's bundles as one JSON object."""
    out.write('{"reports": [')
    for n, a in enumerate(audits):
        out.write(",\n" if n else "\n")
        a.dump(out)
    out.write("\n]}")
