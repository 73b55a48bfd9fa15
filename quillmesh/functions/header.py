"""Header blocks (YAML) as typed projections, in one Arrow-batched function.

YAML has types that SQL lacks, and the rules ask about Python's view of a value
(its text, its truth, whether it is a string), so the parser projects each
header once to: the keys, each value's text, the keys with true values, and the
elements of each value with a string flag.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_SQL = "struct<keys: array<string>, texts: map<string, string>, truthy: array<string>, elements: map<string, array<struct<is_str: boolean, s: string>>>, json: string>"
_TYPE = pa.struct(
    [
        ("keys", pa.list_(pa.string())),
        ("texts", pa.map_(pa.string(), pa.string())),
        ("truthy", pa.list_(pa.string())),
        ("elements", pa.map_(pa.string(), pa.list_(pa.struct([("is_str", pa.bool_()), ("s", pa.string())])))),
        ("json", pa.string()),
    ]
)


class HeaderLoader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """YAML with timestamps as their ISO text and mapping keys as text."""

    def iso_timestamp(self, node):
        return self.construct_yaml_timestamp(node).isoformat()

    def text_keys(self, node):
        out: dict = {}
        yield out
        out.update((k.isoformat() if hasattr(k, "isoformat") else str(k), v) for k, v in self.construct_mapping(node).items())


HeaderLoader.add_constructor("tag:yaml.org,2002:timestamp", HeaderLoader.iso_timestamp)
HeaderLoader.add_constructor("tag:yaml.org,2002:map", HeaderLoader.text_keys)


@lru_cache(maxsize=4096)
def parse_block(block: str) -> dict | None:
    """The projections of a block; None if it isn't a mapping or can't be read (an impossible date included)."""
    try:
        safe = yaml.load(block, Loader=HeaderLoader)
    except (yaml.YAMLError, ValueError):
        return None
    if not isinstance(safe, dict):
        return None
    return {
        "keys": list(safe),
        "texts": [(k, str(v)) for k, v in safe.items()],
        "truthy": [k for k, v in safe.items() if v],
        "elements": [(k, [{"is_str": isinstance(x, str), "s": str(x)} for x in (v if isinstance(v, list) else [v])]) for k, v in safe.items()],
        "json": json.dumps(safe, ensure_ascii=False, default=str),
    }


def parse_header(blocks: pa.Array) -> pa.Array:
    return pa.array([None if b is None else parse_block(b) for b in blocks.to_pylist()], _TYPE)


def header(block: Column) -> Column:
    """The projections of a block column; null where it isn't a readable mapping."""
    return F.arrow_udf(parse_header, HEADER_SQL)(block)
