"""The three commands over real trees."""

import json

import pytest

from quillmesh.cli import main
from quillmesh.plans import audit, validate
from quillmesh.sources.config import Root, load_manifest
from quillmesh.sources import tree
from quillmesh.sources.tree import read_tree

MANIFEST = """okf_version: "0.1"
base:
  name: kb
  roots: [{path: notes, exclude_patterns: ["skip/*"]}]
  reserved_files: {index: index.md, log: log.md}
profile:
  date_fields: [created]
  types:
    Note: {required: [type, created], optional: [title, description], aliases: [n]}
hygiene: {broken_links: warn, reserved_files: error, unknown_fields: warn}
"""
NOTE = "---\ntype: Note\ncreated: 2026-05-01\ntitle: Tït\ndescription: about\n---\n# H\n[[two]] [r](sub/two.md)\n"


@pytest.fixture
def kb(tmp_path):
    root = tmp_path / "notes"
    for name, text in {"one.md": NOTE, "sub/two.md": NOTE.replace("[[two]]", "[[gone]]").replace("sub/", ""), ".hid/e.md": "", "skip/x.md": "bad", "index.md": "", "log.md": "## 2026-01-02\n", "pic.png": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    (root / "latin.md").write_bytes(b"\xff\xfe")
    (tmp_path / "okf-base.yaml").write_text(MANIFEST)
    return tmp_path


def test_tree_lists_hidden_empty_and_unreadable(spark, kb):
    rows = {r["rel_path"]: r for r in read_tree(spark, [str(kb / "notes")]).collect()}
    assert rows[".hid/e.md"]["content"] == "" and rows["latin.md"]["content"] is None and "UnicodeDecodeError" in rows["latin.md"]["read_error"] and rows["sub"]["is_dir"]


def test_tree_batches_are_bounded_by_bytes(kb, monkeypatch):
    monkeypatch.setattr(tree, "BATCH_BYTES", 1)
    reader = tree.TreeReader({"roots": str(kb / "notes")})
    batches = [b for s in reader.partitions() for b in reader.read(s)]
    rows = [r for b in batches for r in b.to_pylist()]
    assert max(sum(bool(r["content"]) for r in b.to_pylist()) for b in batches) == 1
    assert {r["rel_path"] for r in rows} >= {"one.md", "sub/two.md", ".hid/e.md", "latin.md", "pic.png", "sub"} and len(rows) == len({r["rel_path"] for r in rows})
    assert list(reader.read(tree.Slice([])))[0].num_rows == 0


def test_validate(spark, kb, capsys):
    (kb / "notes/latin.md").unlink()
    (kb / "notes/.hid/e.md").unlink()
    assert main(["validate", "--manifest", str(kb / "okf-base.yaml")], spark) == 0
    out = capsys.readouterr().out
    assert "⚠️ [L001] sub/two.md — broken wikilink: [[gone]]" in out and "0 error(s), 1 warning(s)" in out
    assert main(["validate", "--manifest", str(kb / "okf-base.yaml"), "--json", str(kb / "notes/skip/x.md")], spark) == 1
    assert [(d["code"], d["file"]) for d in json.loads(capsys.readouterr().out)] == [("F001", "skip/x.md")]
    (kb / "notes/log.md").unlink()
    assert main(["validate", "--manifest", str(kb / "okf-base.yaml"), str(kb / "notes/sub")], spark) == 1
    assert "reserved file missing" in capsys.readouterr().out
    assert main(["validate", "--manifest", str(kb / "none.yaml")], spark) == 2
    assert main(["validate", "--manifest", str(kb / "okf-base.yaml"), "/elsewhere"], spark) == 2


def test_audit_agrees_with_validate(spark, kb):
    m = load_manifest(kb / "okf-base.yaml")
    report = audit.run_audit(spark, list(m.roots), manifest=m).as_dict()
    flat = sorted((d["code"], d["file"], d["message"]) for f in report["files"] for d in f["diagnostics"])
    rows = validate.run_validate(spark, m).rows()
    assert flat == sorted((d["code"], d["file"], d["message"]) for d in rows if d["code"] != "R201")
    s = report["stats"]
    assert s["total_files"] == 6 and s["total_reserved_files"] == 2 and sum(s["by_okf_status"].values()) == s["total_concept_files"] == 4
    assert sum(report["diagnostics_summary"]["by_severity"].values()) == len(flat) == sum(report["diagnostics_summary"]["by_code"].values())
    two = next(f for f in report["files"] if f["path"] == "sub/two.md")
    assert two["frontmatter"]["created"] == "2026-05-01" and two["wikilinks"][0]["broken"] and not two["markdown_links"][0]["broken"]


def test_audit_modes(spark, kb, capsys, monkeypatch):
    monkeypatch.chdir(kb)
    assert main(["audit"], spark) == 2
    assert main(["audit", "--bundle", str(kb / "notes"), "--vault", str(kb)], spark) == 0
    (kb / "v.json").write_text(json.dumps({"okf_vault_version": "0.1", "name": "v", "bundles": [{"path": "."}]}))
    assert main(["audit", "--vault", str(kb / "v.json"), "--apply"], spark) == 0
    assert "[vault]" in capsys.readouterr().out
    (written,) = kb.glob(".quillmesh/*_vault_audit_v1.json")
    (one,) = json.loads(written.read_text())["reports"]
    assert one["stats"]["total_files"] == len(one["files"]) > 0 and [f["path"] for f in one["files"]] == sorted(f["path"] for f in one["files"])
    assert main(["validate", "--vault", str(kb / "v.json")], spark) == 1
    assert f"[{kb.name}]" in capsys.readouterr().out


def test_index_is_idempotent(spark, kb, capsys):
    (kb / "notes/latin.md").unlink()
    args = ["index", "--manifest", str(kb / "okf-base.yaml")]
    assert main(args, spark) == 0
    assert "--apply writes" in capsys.readouterr().out
    assert main([*args, "--apply"], spark) == 0
    assert (kb / "notes/index.md").read_text() == "- [.hid/](.hid/index.md)\n- [sub/](sub/index.md)\n- [Tït](one.md) — about\n"
    capsys.readouterr()
    assert main(args, spark) == 0
    assert "up to date" in capsys.readouterr().out


def test_index_needs_a_manifest_and_skips_bad_bundles(spark, kb, capsys, monkeypatch):
    monkeypatch.chdir(kb)
    assert main(["index"], spark) == 2 and main(["index", "--vault", str(kb)], spark) == 2
    (kb / "bad").mkdir()
    (kb / "bad/okf-base.yaml").write_text("base: 1")
    (kb / "notes/latin.md").unlink()
    (kb / "v.json").write_text(json.dumps({"okf_vault_version": "0.1", "bundles": [{"path": "bad"}, {"path": "."}]}))
    assert main(["index", "--vault", str(kb / "v.json"), "--apply"], spark) == 0
    assert "bad left out" in capsys.readouterr().err and (kb / "notes/sub/index.md").exists()
    assert main(["validate", "--json", "--vault", str(kb / "v.json")], spark) == 2
    json.loads(capsys.readouterr().out)


def test_overlapping_roots_and_targets_repeat_findings(spark, kb, capsys):
    bad = "no header"
    (kb / "notes/sub/skip").mkdir(parents=True)
    (kb / "notes/sub/skip/y.md").write_text(bad)
    (kb / "notes/sub/index.md").write_text("---\nokf_version: 1\n---\n")
    (kb / "two.yaml").write_text(MANIFEST.replace("roots: [", "roots: [{path: notes/sub, exclude_patterns: [\"skip/*\"]}, "))
    m = load_manifest(kb / "two.yaml")
    rows = validate.run_validate(spark, m).rows()
    # sub comes first: it holds its files under both roots; the outer one has no exclusion that fits.
    assert [r["file"] for r in rows if r["code"] == "F001" and "y.md" in r["file"]] == ["skip/y.md"]
    assert [r["file"] for r in rows if r["code"] == "L001"] == ["two.md", "two.md"]
    assert not [r for r in rows if r["code"] == "R001"]  # the top of any root may give the version
    twice = [str(kb / "notes/skip/x.md")] * 2
    assert [r["code"] for r in validate.run_validate(spark, m, twice).rows()] == ["F001", "F001", "R201"]


def test_links_to_files_outside_all_roots(spark, kb):
    (kb / "outside.md").write_text("x")
    (kb / "notes/out.md").write_text(NOTE.replace("(sub/two.md)", "(../outside.md) [n](../gone.md)"))
    m = load_manifest(kb / "okf-base.yaml")
    rows = validate.run_validate(spark, m, [str(kb / "notes/out.md")]).rows()
    assert [r["message"] for r in rows if r["code"] == "L002"] == ["broken markdown link: ../gone.md"]
    (out,) = (f for f in audit.run_audit(spark, list(m.roots), manifest=m).files() if f["path"] == "out.md")
    assert [x["broken"] for x in out["markdown_links"]] == [False, True]


def test_audit_without_manifest_checks_the_core_rules(spark, kb):
    (kb / "notes/one.md").write_text("no header")
    report = audit.run_audit(spark, [Root(str(kb / "notes"))]).as_dict()
    assert "F001" in report["diagnostics_summary"]["by_code"]


def test_streaming_revalidation(spark, kb, tmp_path):
    from quillmesh.operators import links
    from quillmesh.sources.tree import as_files
    from quillmesh.streaming.revalidate import revalidate

    m = load_manifest(kb / "okf-base.yaml")
    rows = as_files(read_tree(spark, [str(kb / "notes")]), m.roots)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    q = revalidate(stream, m, links.stem_index(rows), lambda d, n: seen.extend(r["code"] for r in d.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert "L001" in seen and "F001" in seen
