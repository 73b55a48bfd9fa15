import json

import pytest

from quillmesh.sources.config import ManifestError, VaultError, load_manifest, load_vault, parse_manifest


def base(**more):
    return {"okf_version": "0.1", "base": {"name": "b", "roots": [{"path": "notes"}], "reserved_files": {"index": "index.md", "log": "log.md"}}} | more


def test_minimal(tmp_path):
    m = parse_manifest(base(), tmp_path)
    assert m.roots[0].path == str((tmp_path / "notes").resolve()) and m.profile is None and m.hygiene is None


#: Where in a manifest, what may stand there, and what may not.
TEXTS = ([[], ["a", "b"]], [None, "a", [1], {"a": 1}])
SCHEMA = [
    ("base", [], [None, [], {}]),
    ("base.roots", [[{"path": "a"}, {"path": "/b"}]], [None, [], {"path": "a"}, ["a"], [{}], [{"path": None}]]),
    ("base.roots.0.exclude_patterns", *TEXTS),
    ("base.reserved_files", [{"index": "i", "log": "l", "x": "y"}], [None, [], {"log": "l"}]),
    ("base.link_resolution", [None, {}, {"external_refs": None}], []),
    ("profile", [{}], [None, []]),
    ("profile.date_fields", *TEXTS),
    ("profile.types", [{}], [None, []]),
    ("profile.types.T", [{}], [None, [], {1: ["a"]}]),
    ("profile.types.T.required", *TEXTS),
    ("profile.types.T.optional", *TEXTS),
    ("profile.types.T.aliases", *TEXTS),
    ("profile.types.T", [{"optional": ["a"], "a_values": ["x"]}], [{"a_values": ["x"]}, {"optional": ["a"], "a_values": None}, {"required": ["a"], "optional": ["a"]}]),
    ("hygiene", [{}], [None, []]),
    *((f"hygiene.{k}", ["off", "warn", "error", True, False], [None, "", "WARN", 1, ["off"]]) for k in ("broken_links", "split_candidates", "reserved_files", "unknown_fields")),
    ("hygiene.split", [None, {}], [[], 3]),
    ("hygiene.split.min_lines", [0, 9], [None, -3, 2.0, False]),
    ("hygiene.split.tau", [0.3, 0.999], [None, 1.0, 0.0, 2, -1, "0.3", True]),
    ("hygiene.split.exempt_types", *TEXTS),
    ("hygiene.split.exempt_paths", *TEXTS),
]


def with_value(path, value):
    raw = base()
    at, keys = raw, [int(k) if k.isdigit() else k for k in path.split(".")]
    for k in keys[:-1]:
        at = at[k] if isinstance(k, int) else at.setdefault(k, {})
    at[keys[-1]] = value
    return raw


@pytest.mark.parametrize("path, good, bad", SCHEMA)
def test_schema(path, good, bad):
    for v in good:
        parse_manifest(with_value(path, v))
    for v in bad:
        with pytest.raises(ManifestError):
            parse_manifest(with_value(path, v))


def test_levels_that_yaml_reads_as_booleans():
    h = parse_manifest(base(hygiene={"broken_links": False, "unknown_fields": True})).hygiene
    assert (h.broken_links, h.unknown_fields, h.split_candidates) == ("off", "warn", "off")


def test_external_refs_are_folded():
    raw = base()
    raw["base"]["link_resolution"] = {"external_refs": ["Foo", 3, "bar"]}
    assert parse_manifest(raw).external_refs == {"foo", "bar"}


def test_files(tmp_path):
    with pytest.raises(ManifestError):
        load_manifest(tmp_path / "none.yaml")
    (tmp_path / "bad.yaml").write_text("a: [")
    with pytest.raises(ManifestError):
        load_manifest(tmp_path / "bad.yaml")
    for raw in ("[", "[]", "{}", '{"bundles": []}', '{"bundles": [{"path": "gone"}]}'):
        (tmp_path / "v.json").write_text(raw)
        with pytest.raises(VaultError):
            load_vault(tmp_path / "v.json")
    (tmp_path / "one").mkdir()
    (tmp_path / "one/okf-base.yaml").write_text("x: 1")
    (tmp_path / "v.json").write_text(json.dumps({"okf_vault_version": "0.1", "name": "v", "bundles": [{"path": "one"}]}))
    assert load_vault(tmp_path / "v.json").bundles[0].path == str((tmp_path / "one").resolve())
