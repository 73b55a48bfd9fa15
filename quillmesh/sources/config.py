"""Manifests (YAML) and vaults (JSON), parsed and checked on the driver."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

KNOWN_VERSION = "0.1"
LEVELS = ("off", "warn", "error")
DEFAULT_TAU = 0.15
DEFAULT_RESERVED = {"index": "index.md", "log": "log.md"}


class ManifestError(ValueError):
    """A manifest that can't be used."""


class VaultError(ValueError):
    """A vault file that can't be used."""


@dataclass(frozen=True)
class Root:
    path: str
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class TypeRules:
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    values: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Profile:
    date_fields: tuple[str, ...] = ()
    types: dict[str, TypeRules] = field(default_factory=dict)


@dataclass(frozen=True)
class Split:
    min_lines: int = 0
    exempt_types: tuple[str, ...] = ()
    exempt_paths: tuple[str, ...] = ()
    tau: float = DEFAULT_TAU


@dataclass(frozen=True)
class Hygiene:
    broken_links: str = "warn"
    split_candidates: str = "off"
    reserved_files: str = "off"
    unknown_fields: str = "off"
    split: Split = Split()


@dataclass(frozen=True)
class Manifest:
    roots: tuple[Root, ...]
    reserved: dict[str, str]
    name: str = ""
    version: str | None = None
    external_refs: frozenset[str] = frozenset()
    profile: Profile | None = None
    hygiene: Hygiene | None = None


@dataclass(frozen=True)
class Bundle:
    path: str
    manifest: str


@dataclass(frozen=True)
class Vault:
    name: str
    bundles: tuple[Bundle, ...]
    version: str | None = None


def _need(ok: bool, message: str, kind=ManifestError) -> None:
    if not ok:
        raise kind(message)


def _texts(holder: dict, key: str, where: str) -> tuple[str, ...]:
    v = holder.get(key, [])
    _need(isinstance(v, list) and all(isinstance(x, str) for x in v), f"{where}.{key} must be a list of strings")
    return tuple(v)


def _mapping(v: Any, where: str) -> dict:
    _need(isinstance(v, dict), f"{where} must be a mapping")
    return v


def _type_rules(name: str, raw: Any) -> TypeRules:
    where = f"profile.types.{name}"
    raw = _mapping(raw, where)
    _need(all(isinstance(k, str) for k in raw), f"{where}: keys must be strings")
    required, optional, aliases = (_texts(raw, k, where) for k in ("required", "optional", "aliases"))
    both = sorted({*required} & {*optional})
    _need(not both, f"{where}: required and optional both list {', '.join(both)}")
    values = {}
    for key in raw:
        prop = key.removesuffix("_values")
        if prop != key:
            _need(prop in (*required, *optional), f"{where}.{key}: {prop} is neither required nor optional")
            values[prop] = _texts(raw, key, where)
    return TypeRules(required, optional, aliases, values)


def _profile(raw: Any) -> Profile:
    raw = _mapping(raw, "profile")
    types = _mapping(raw.get("types", {}), "profile.types")
    return Profile(_texts(raw, "date_fields", "profile"), {str(k): _type_rules(str(k), v) for k, v in types.items()})


def _split(raw: Any) -> Split:
    raw = _mapping(raw, "hygiene.split")
    lines, tau = raw.get("min_lines", 0), raw.get("tau", DEFAULT_TAU)
    _need(isinstance(lines, int) and not isinstance(lines, bool) and lines >= 0, "hygiene.split.min_lines must be an integer from 0")
    _need(isinstance(tau, (int, float)) and not isinstance(tau, bool) and 0 < tau < 1, "hygiene.split.tau must be a number between 0 and 1")
    return Split(lines, _texts(raw, "exempt_types", "hygiene.split"), _texts(raw, "exempt_paths", "hygiene.split"), float(tau))


def _level(raw: dict, key: str, default: str) -> str:
    v = raw.get(key, default)
    v = {False: "off", True: "warn"}[v] if isinstance(v, bool) else v  # YAML reads off and on as booleans
    _need(isinstance(v, str) and v in LEVELS, f"hygiene.{key} must be one of {', '.join(LEVELS)}")
    return v


def _hygiene(raw: Any) -> Hygiene:
    raw = _mapping(raw, "hygiene")
    defaults = Hygiene()
    levels = {k: _level(raw, k, getattr(defaults, k)) for k in ("broken_links", "split_candidates", "reserved_files", "unknown_fields")}
    return Hygiene(**levels, split=Split() if raw.get("split") is None else _split(raw["split"]))


def _root(raw: Any, i: int, home: Path) -> Root:
    raw = _mapping(raw, f"base.roots[{i}]")
    path = raw.get("path")
    _need(isinstance(path, str), f"base.roots[{i}].path must be a string")
    return Root(path if Path(path).is_absolute() else str((home / path).resolve()), _texts(raw, "exclude_patterns", f"base.roots[{i}]"))


def parse_manifest(raw: Any, home: str | Path = ".") -> Manifest:
    """A manifest from its YAML value; relative roots are under home."""
    raw = _mapping(raw, "the manifest")
    base = _mapping(raw.get("base"), "base")
    roots = base.get("roots")
    _need(isinstance(roots, list) and bool(roots), "base.roots must be a list with a root at least")
    reserved = _mapping(base.get("reserved_files"), "base.reserved_files")
    _need({"index", "log"} <= {*reserved}, "base.reserved_files must name index and log")
    links = base.get("link_resolution")
    refs = links.get("external_refs") if isinstance(links, dict) else None
    version = raw.get("okf_version")
    if version is not None and str(version) != KNOWN_VERSION:
        print(f"warning: manifest version {version} is not {KNOWN_VERSION}", file=sys.stderr)
    return Manifest(
        roots=tuple(_root(r, i, Path(home)) for i, r in enumerate(roots)),
        reserved={str(k): str(v) for k, v in reserved.items()},
        name=str(base.get("name", "")),
        version=None if version is None else str(version),
        external_refs=frozenset(r.lower() for r in refs if isinstance(r, str)) if isinstance(refs, list) else frozenset(),
        profile=_profile(raw["profile"]) if "profile" in raw else None,
        hygiene=_hygiene(raw["hygiene"]) if "hygiene" in raw else None,
    )


def load_manifest(path: str | Path) -> Manifest:
    path = Path(path)
    _need(path.is_file(), f"no manifest at {path}")
    try:
        raw = yaml.safe_load(path.read_text("utf-8"))
    except (yaml.YAMLError, ValueError) as e:
        raise ManifestError(f"{path}: {e}") from e
    return parse_manifest(raw, path.resolve().parent)


def load_vault(path: str | Path) -> Vault:
    """A vault: bundles, each a folder with a manifest of its own."""
    path = Path(path)
    _need(path.is_file(), f"no vault at {path}", VaultError)
    try:
        raw = json.loads(path.read_text("utf-8"))
    except ValueError as e:
        raise VaultError(f"{path}: {e}") from e
    _need(isinstance(raw, dict), "a vault must be an object", VaultError)
    version = raw.get("okf_vault_version")
    if version is None or str(version) != KNOWN_VERSION:
        print(f"warning: vault version {version} is not {KNOWN_VERSION}", file=sys.stderr)
    entries = raw.get("bundles")
    _need(isinstance(entries, list) and bool(entries), "bundles must be a list with a bundle at least", VaultError)
    out = []
    for i, e in enumerate(entries):
        _need(isinstance(e, dict) and isinstance(e.get("path"), str), f"bundles[{i}].path must be a string", VaultError)
        at = Path(e["path"])
        at = (at if at.is_absolute() else path.resolve().parent / at).resolve()
        _need(at.is_dir(), f"bundles[{i}]: no folder {at}", VaultError)
        name = e.get("manifest", "okf-base.yaml")
        _need(isinstance(name, str), f"bundles[{i}].manifest must be a string", VaultError)
        _need((at / name).is_file(), f"bundles[{i}]: no manifest {at / name}", VaultError)
        out.append(Bundle(str(at), str(at / name)))
    return Vault(str(raw.get("name", "")), tuple(out), None if version is None else str(version))
