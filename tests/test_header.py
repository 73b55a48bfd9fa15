import json

from quillmesh.functions.header import parse_block


def test_yaml_values():
    p = parse_block("type: yes\nwhen: 2026-05-01\nodd: 2026-5-1\ntags: [a, 1, true]\nnone:\n012: x\n")
    assert dict(p["texts"]) == {"type": "True", "when": "2026-05-01", "odd": "2026-5-1", "tags": "['a', 1, True]", "none": "None", "10": "x"}
    assert p["truthy"] == ["type", "when", "odd", "tags", "10"]
    assert [e["is_str"] for e in dict(p["elements"])["tags"]] == [True, False, False]
    assert json.loads(p["json"])["when"] == "2026-05-01"


def test_what_is_no_header():
    for block in ("", "just text", "- a\n- b", "a: [", "when: 2026-13-45"):
        assert parse_block(block) is None


def test_last_of_repeated_keys():
    assert dict(parse_block("a: 1\na: 2")["texts"]) == {"a": "2"}
