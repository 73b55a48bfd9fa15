"""Command line: audit, validate and index. Exit codes: 0 fine, 1 errors found, 2 configuration."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from quillmesh.operators import links
from quillmesh.plans import audit, index, validate
from quillmesh.sources.config import Bundle, Manifest, ManifestError, Root, Vault, VaultError, load_manifest, load_vault
from quillmesh.sources.tree import as_files, read_tree

DEFAULT_MANIFEST = "okf-base.yaml"
ICONS = {"error": "❌", "warning": "⚠️"}

#: What the summary of an audit shows: a label, and the statistics it is made of.
SUMMARY = (
    ("files", ("total_files", "total_concept_files")),
    ("status", ("by_okf_status",)),
    ("wikilinks (broken)", ("total_wikilinks", "broken_wikilinks")),
    ("markdown links (broken)", ("total_markdown_links", "broken_markdown_links")),
    ("to split", ("split_candidates",)),
)


class UsageError(ValueError):
    """Options that don't go together."""


def session() -> SparkSession:
    spark = SparkSession.builder.appName("quillmesh").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def note(text: str) -> None:
    print(text, file=sys.stderr)


def bundles(vault: Vault) -> Iterator[tuple[str, Bundle, Manifest | None]]:
    """Each bundle with its name and manifest; None, and a note, where that can't be used."""
    for b in vault.bundles:
        name = os.path.basename(b.path)
        try:
            yield name, b, load_manifest(b.manifest)
        except ManifestError as e:
            note(f"{name} left out, its manifest can't be used: {e}")
            yield name, b, None


def union_index(spark: SparkSession, vault: Vault) -> DataFrame:
    """The stem index over all bundles; a manifest's exclusions hold where its root is the bundle's folder."""
    excludes: dict[str, tuple[str, ...]] = {}
    for b in vault.bundles:
        try:
            excludes |= {r.path: r.exclude for r in load_manifest(b.manifest).roots if r.exclude}
        except ManifestError:
            continue
    paths = [b.path for b in vault.bundles]
    return links.stem_index(as_files(read_tree(spark, paths, contents=False), tuple(Root(p, excludes.get(p, ())) for p in paths)))


def the_vault(args: argparse.Namespace) -> Vault | None:
    """The vault file named by --vault; a folder is none."""
    return load_vault(args.vault) if args.vault and args.vault.lower().endswith(".json") else None


def show(value) -> str:
    return " ".join(f"{k}={v}" for k, v in value.items()) if isinstance(value, dict) else str(value)


def print_summary(stats: dict, title: str = "", diagnostics: dict | None = None) -> None:
    lines = [(label, " / ".join(show(stats[n]) for n in names)) for label, names in SUMMARY]
    lines += [(k.replace("_", " "), show(diagnostics[k])) for k in ("by_severity", "by_tier")] if diagnostics else []
    if title:
        print(f"\n[{title}]")
    for label, text in lines:
        print(f"{label:>24}  {text}")


def say(rows: Iterable[dict], bundle: str = "") -> Counter:
    """Prints diagnostics as they come, and counts them by severity."""
    seen: Counter = Counter()
    for r in rows:
        seen[r["severity"]] += 1
        print(f"{ICONS[r['severity']]} [{r['code']}] {f'[{bundle}] ' if bundle else ''}{r['file']} — {r['message']}")
    return seen


def as_json(rows: Iterable[dict]) -> Counter:
    """Prints diagnostics as one JSON array as they come, and counts them by severity."""
    seen: Counter = Counter()
    print("[", end="")
    for r in rows:
        print("," if seen.total() else "", json.dumps(r, indent=2, ensure_ascii=False), sep="\n" if seen.total() else "", end="")
        seen[r["severity"]] += 1
    print("]")
    return seen


def cmd_validate(spark: SparkSession, args: argparse.Namespace) -> int:
    vault = the_vault(args)
    stems = union_index(spark, vault) if vault else None
    if not vault or args.manifest:
        done = validate.run_validate(spark, load_manifest(args.manifest or DEFAULT_MANIFEST), args.targets or None, stems)
        seen = as_json(done.stream()) if args.json else say(done.stream())
        if not args.json:
            print(f"{seen['error']} error(s), {seen['warning']} warning(s)" if seen else "✅ no findings")
        return int(seen["error"] > 0)
    if args.targets:
        raise UsageError("targets need --manifest: a vault alone doesn't say which bundle's rules they are under")
    codes = [0]

    def every() -> Iterator[dict]:
        for name, _, manifest in bundles(vault):
            if manifest is None:
                codes.append(2)
                continue
            found = validate.run_validate(spark, manifest, index=stems).stream()
            if args.json:
                yield from found
            else:
                codes.append(int(say(found, name)["error"] > 0))

    if args.json:
        codes.append(int(as_json(every())["error"] > 0))
    else:
        list(every())
        if not max(codes):
            print("✅ no errors")
    return max(codes)


def cmd_audit(spark: SparkSession, args: argparse.Namespace) -> int:
    vault = the_vault(args)
    stems = union_index(spark, vault) if vault else None
    places = [b.path for b in vault.bundles] if vault else None
    if vault and not args.manifest and not args.bundle:
        done = []
        for name, _, manifest in bundles(vault):
            if manifest is not None:
                done.append(audit.run_audit(spark, list(manifest.roots), places, manifest, index=stems))
                print_summary(done[-1].head["stats"], name, done[-1].head["diagnostics_summary"])
        if done:
            print_summary(audit.roll_up([a.head for a in done]), "vault")
        dump, suffix = partial(audit.dump_all, done) if done else None, "vault_audit"
    else:
        manifest = load_manifest(args.manifest) if args.manifest else None
        if manifest is None and not (args.bundle and args.vault):
            raise UsageError("an audit needs --manifest, a vault file, or --bundle with --vault")
        if manifest and args.bundle:
            note("--bundle only narrows the manifest's roots")
        roots = list(manifest.roots) if manifest else [Root(os.path.realpath(args.bundle))]
        if not manifest:
            places = places or [os.path.realpath(args.vault)]
        report = audit.run_audit(spark, roots, places, manifest, args.bundle if manifest else None, stems)
        print_summary(report.head["stats"], diagnostics=report.head["diagnostics_summary"])
        for r in report.head["roots"] if len(roots) > 1 else ():
            print(f"{r['file_count']:>24}  files under {r['path']}")
        dump, suffix = report.dump, "audit"
    if not args.apply:
        print("nothing written; --apply writes the report")
    elif dump:
        print(f"report: {audit.write_report(dump, suffix)}")
    return 0


def index_one(spark: SparkSession, manifest: Manifest, apply: bool) -> None:
    n = 0
    for r in index.run_index(spark, manifest).toLocalIterator():
        n += 1
        print(f"written: {index.write(r)}" if apply else f"--- {r['path']}\n{r['diff'] or '(empty)'}")
    if not n:
        print("all listings are up to date")
    elif not apply:
        print(f"{n} listing(s) differ; --apply writes them")


def cmd_index(spark: SparkSession, args: argparse.Namespace) -> int:
    vault = None if args.manifest else the_vault(args)
    if vault:
        for name, _, manifest in bundles(vault):
            if manifest is not None:
                print(f"\n[{name}]")
                index_one(spark, manifest, args.apply)
        return 0
    if not args.manifest:
        raise UsageError("listings need --manifest or a vault file")
    index_one(spark, load_manifest(args.manifest), args.apply)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillmesh", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, run in (("audit", cmd_audit), ("validate", cmd_validate), ("index", cmd_index)):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--manifest")
        p.add_argument("--vault")
        if name == "audit":
            p.add_argument("--bundle")
        if name == "validate":
            p.add_argument("--json", action="store_true")
            p.add_argument("targets", nargs="*")
        else:
            p.add_argument("--apply", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(spark or session(), args)
    except (ManifestError, VaultError, validate.TargetError, UsageError) as e:
        note(f"{type(e).__name__}: {e}")
        return 2
