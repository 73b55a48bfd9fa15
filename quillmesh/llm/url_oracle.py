"""The URL filter again in plain Python and DuckDB SQL, for tests and as the query's SQL.

The trees are grown from the labelled table by sorting and summing in Python;
the SQL computes the features of the pages and walks those trees.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import pairwise

from quillmesh.llm import url_filter as U


def parts(url: str | None) -> tuple[str, str, str]:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    address, _, _ = rest.partition("#")
    before, _, query = address.partition("?")
    host, slash, path = before.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path, query


def features(url: str | None) -> tuple[dict[str, float], str]:
    """The features that one URL alone has, and its suffix."""
    u, (host, path, query) = url or "", parts(url)
    n = max(1, len(u))
    digits, letters = sum(c in "0123456789" for c in u), sum(c.isascii() and c.isalpha() for c in u)
    shares = [u.count(c) / n for c in dict.fromkeys(u)]
    return {
        "url_length": len(u),
        "host_length": len(host),
        "path_length": len(path),
        "depth": path.count("/"),
        "labels": len(host.split(".")) if host else 0,
        "digit_ratio": round(digits / n, 6),
        "symbol_ratio": round((len(u) - digits - letters) / n, 6),
        "entropy": round(-sum(p * math.log2(p) for p in shares), 6),
        "parameters": 1 + query.count("&") + query.count(";") if query else 0,
        "hyphens": host.count("-"),
        "longest_label": max(map(len, host.split("."))),
    }, host.rsplit(".", 1)[-1]


def leaf(tree, row: dict[str, float]) -> float:
    while not isinstance(tree, float):
        name, edge, low, high = tree
        tree = low if row[name] <= edge else high
    return tree


def train(labelled: list[tuple[str, int]]) -> tuple[float, float, list, dict[str, tuple[int, int]]]:
    """Base, rate of blocks, trees, and rows and blocks of each suffix."""
    known = [(*features(u), y) for u, y in labelled]
    rate = (sum(y for *_, y in known) + 1) / (len(known) + 2)
    suffixes: dict[str, tuple[int, int]] = {}
    for _, s, y in known:
        n, k = suffixes.get(s, (0, 0))
        suffixes[s] = (n + 1, k + y)
    rows = [r | {"suffix_rate": round((suffixes[s][1] - y + U.PRIOR * rate) / (suffixes[s][0] - 1 + U.PRIOR), 6), "suffix_count": round(math.log2(suffixes[s][0]), 6)} for r, s, y in known]
    edges = {f: sorted({sorted(r[f] for r in rows)[math.ceil(i / U.BINS * len(rows)) - 1] for i in range(1, U.BINS)}) for f in U.FEATURES}
    base = math.log(rate / (1 - rate))
    total, trees = [base] * len(rows), []

    def grow(at: list[int], depth: int):
        g, h = sum(pull[i] for i in at) / 1e6, sum(curve[i] for i in at) / 1e6
        best = (1e-6, None, None)
        for f in U.FEATURES if depth else ():
            for edge in edges[f]:
                low = [i for i in at if rows[i][f] <= edge]
                if min(len(low), len(at) - len(low)) >= U.LEAF:
                    gl, hl = sum(pull[i] for i in low) / 1e6, sum(curve[i] for i in low) / 1e6
                    gain = gl * gl / (hl + U.RIDGE) + (g - gl) ** 2 / (h - hl + U.RIDGE) - g * g / (h + U.RIDGE)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, edge)
        _, f, edge = best
        if f is None:
            return round(-U.RATE * g / (h + U.RIDGE), 9)
        return (f, float(edge), grow([i for i in at if rows[i][f] <= edge], depth - 1), grow([i for i in at if rows[i][f] > edge], depth - 1))

    for _ in range(U.ROUNDS):
        p = [1 / (1 + math.exp(-t)) for t in total]
        pull = [math.floor((q - k[-1]) * 1e6 + 0.5) if q >= k[-1] else -math.floor((k[-1] - q) * 1e6 + 0.5) for q, k in zip(p, known)]
        curve = [math.floor(q * (1 - q) * 1e6 + 0.5) for q in p]
        trees.append(grow(list(range(len(rows))), U.DEPTH))
        total = [t + leaf(trees[-1], r) for t, r in zip(total, rows)]
    return base, rate, trees, suffixes


def tree_sql(t) -> str:
    return repr(t) if isinstance(t, float) else f"CASE WHEN {t[0]} <= {t[1]!r} THEN {tree_sql(t[2])} ELSE {tree_sql(t[3])} END"


@lru_cache(maxsize=1)
def sql() -> str:
    base, rate, trees, suffixes = train([U.example_url(i) for i in range(U.EXAMPLES)])
    rules = sorted(U.RULES, key=lambda r: -len(r[1] + r[2]))
    assert all(len(a[1] + a[2]) > len(b[1] + b[2]) or a[1] != b[1] for a, b in pairwise(rules))
    fits = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    known = ", ".join(f"('{s}', {n}, {k})" for s, (n, k) in sorted(suffixes.items()))
    return f"""WITH whole AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    cut AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query, greatest(length(u), 1) AS n FROM whole),
    counted AS (SELECT *, length(regexp_replace(u, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(u, '[^A-Za-z]', '', 'g')) AS letters, split_part(host, '.', -1) AS suffix FROM cut),
    known(suffix, k_rows, k_blocked) AS (VALUES {known}),
    featured AS (SELECT page_id, host, path, length(u) AS url_length, length(host) AS host_length, length(path) AS path_length, length(path) - length(replace(path, '/', '')) AS depth,
        CASE WHEN host = '' THEN 0 ELSE len(str_split(host, '.')) END AS labels, round(digits / n, 6) AS digit_ratio, round((length(u) - digits - letters) / n, 6) AS symbol_ratio,
        round(coalesce(list_sum(list_transform(list_distinct(list_filter(str_split(u, ''), lambda c: c <> '')), lambda c: -(length(u) - length(replace(u, c, ''))) / n * log2((length(u) - length(replace(u, c, ''))) / n))), 0), 6) AS entropy,
        CASE WHEN query = '' THEN 0 ELSE length(query) - length(replace(replace(query, '&', ''), ';', '')) + 1 END AS parameters, length(host) - length(replace(host, '-', '')) AS hyphens, list_max(list_transform(str_split(host, '.'), lambda x: length(x))) AS longest_label,
        round((coalesce(k_blocked, 0) + {U.PRIOR} * {rate!r}) / (coalesce(k_rows, 0) + {U.PRIOR}), 6) AS suffix_rate, round(log2(greatest(coalesce(k_rows, 0), 1)), 6) AS suffix_count
        FROM counted LEFT JOIN known USING (suffix)),
    scored AS (SELECT *, round(1 / (1 + exp(-({base!r} + {" + ".join(map(tree_sql, trees))}))), 6) AS score FROM featured)
    SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(2)}, CASE WHEN score > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, score FROM scored"""
