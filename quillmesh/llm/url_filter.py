"""URL filters: rules first, then gradient-boosted trees on lexical features.

Everything is a DataFrame expression. The features of a URL (lengths, depth,
digit ratio, entropy, parameter counts, statistics of its suffix) are columns;
a boosting round sums gradients by tree node, feature and bin in one
aggregation, from which the driver picks the splits; a fitted model is again a
column, so scoring is one pass without a shuffle but for the join with the
suffix statistics.

Trees are fitted on at most about LABELLED labelled rows, picked by their
hash; everything else covers all rows. Sums are of integers (gradients in
millionths), so the model doesn't depend on how rows are partitioned.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, table

#: Labelled URLs that a model is fitted on, in expectation.
LABELLED = 20_000
ROUNDS = 6
DEPTH = 3
BINS = 16
RATE = 0.5
#: Added to the sum of second derivatives of a leaf.
RIDGE = 1.0
#: Rows that a leaf holds at least.
LEAF = 4
#: Rows of the overall rate that a suffix's rate is mixed with.
PRIOR = 20
_MILLION = 1_000_000

FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "symbol_ratio", "entropy", "parameters", "hyphens", "longest_label", "suffix_rate", "suffix_count")

#: (verdict, host, path): the rules that the query judges by.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Parts that the labelled table's invented URLs are made of, on reserved names.
WORDS = ("garden", "museum", "history", "travel", "school", "harbour", "letters", "physics", "kitchen", "railway", "forest", "music", "novels", "council", "weather", "planets")
LURES = ("casino", "pills", "bets", "loans", "prize", "cheap", "replica", "lucky", "spam", "farm", "meds", "clicks")
SUFFIXES = ("com", "net", "org", "test")
TOPICS = ("en", "fr", "de", "es", "docs", "news")
EXAMPLES = 1_600


def example_url(i: int) -> tuple[str, int]:
    """The i-th labelled URL and its label (1: block).

    No one feature tells the classes apart: allowed hosts are hyphenated too,
    allowed paths deep or numbered, and allowed queries long, but not in the
    combinations that blocked ones have.
    """
    r = random.Random(1_000_003 * i + 17)
    pick, number = r.choice, lambda n: str(r.randrange(10 ** (n - 1), 10**n))
    y = int(r.random() < 0.4)
    suffix = pick(SUFFIXES if y else SUFFIXES[:3]) if r.random() < 0.7 else pick(SUFFIXES[2:] if y else SUFFIXES[:2])
    top = r.choices(("", "www.", "m.", "blog."), (5, 2, 1, 2))[0]
    tail = r.choices(("", "/", ".html", "?page=2&ref=x", "?utm_source=feed", "#top"), (3, 1, 1, 1, 1, 1))[0]
    kind = r.random()
    if y:
        if kind < 0.5:  # a hyphenated lure before a numbered page
            host, path = f"{pick(LURES)}-{pick(LURES)}", f"/{pick(TOPICS)}/{number(r.randrange(1, 5))}{tail}"
        elif kind < 0.7:  # made-up names: digits among letters
            host, path = "".join(r.choices("abcdefghkmnpqrstvwxyz23456789", k=r.randrange(9, 16))), f"/{number(r.randrange(4, 10))}/{pick(TOPICS)}{tail}"
        elif kind < 0.85:  # a plain host with tracking parameters
            host, path = pick(WORDS), "/go?" + "&".join(f"{c}={number(r.randrange(3, 9))}" for c in r.sample("abcdefguvw", r.randrange(4, 7)))
        else:  # a deep path of numbers
            host, path = pick(WORDS), "".join(f"/{number(r.randrange(1, 4))}" for _ in range(r.randrange(5, 9)))
    elif kind < 0.5:  # a plain host with a numbered page
        host, path = pick(WORDS) + r.choice(("", "", pick(WORDS))), f"/{pick(TOPICS)}/{number(r.randrange(1, 5))}{tail}"
    elif kind < 0.7:  # a hyphenated host with a titled page
        host, path = f"{pick(WORDS)}-{pick(WORDS)}", f"/{pick(WORDS)}/{'-'.join(r.choices(WORDS, k=r.randrange(2, 6)))}"
    elif kind < 0.8:  # an archive: a numbered host, and pages with long numbers
        host, path = pick(WORDS) + number(r.randrange(1, 3)), f"/{pick(TOPICS)}/{number(r.randrange(6, 10))}{tail}"
    elif kind < 0.9:  # a search: parameters of words
        host, path = pick(WORDS), "/find?" + "&".join(f"{c}={pick(WORDS)}" for c in r.sample("abcdefguvw", r.randrange(3, 6)))
    else:  # a deep path of words
        host, path = pick(WORDS), "".join(f"/{pick(WORDS)}" for _ in range(r.randrange(4, 8))) + f"/{number(1)}"
    return f"{pick(('http', 'https'))}://{top}{host}.example.{suffix}{path}", y


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path and query of a URL; all empty for null or without `://`."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    return df.withColumns(
        {
            "host": F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _UPPER.lower()),
            "path": F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1),
            "query": F.regexp_extract(rest, r"\A[^?#]*\?([^#]*)", 1),
        }
    )


def rule_column(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's string and verdict (null: none fits), from host and path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _count(c, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def with_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features as doubles, and suffix (the host's last label), to rows with a URL's parts."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    times = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.transform(F.array_distinct(F.filter(F.split(u, ""), lambda c: c != "")), lambda c: -times(c) * F.log2(times(c))), F.lit(0.0), lambda a, b: a + b)
    digits = _count(u, "0123456789")
    columns = {
        "url_length": F.length(u),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": _count(F.col("path"), "/"),
        "labels": F.when(F.col("host") == "", 0).otherwise(_count(F.col("host"), ".") + 1),
        "digit_ratio": F.round(digits / n, 6),
        "symbol_ratio": F.round((F.length(u) - digits - F.length(F.regexp_replace(u, "[^A-Za-z]", ""))) / n, 6),
        "entropy": F.round(entropy, 6),
        "parameters": F.when(F.col("query") == "", 0).otherwise(_count(F.col("query"), "&;") + 1),
        "hyphens": _count(F.col("host"), "-"),
        "longest_label": F.array_max(F.transform(F.split("host", r"\."), F.length)),
    }
    return df.withColumns({**{k: c.cast("double") for k, c in columns.items()}, "suffix": F.substring_index("host", ".", -1)})


@dataclass
class Model:
    """Boosted trees. A tree is a leaf's value, or (feature, threshold, below, above) with below for values up to the threshold."""

    base: float = 0.0
    rate: float = 0.5
    trees: list = field(default_factory=list)
    suffixes: DataFrame | None = None

    def score(self) -> Column:
        """Probability of a block, from the feature columns."""
        total = " + ".join([_number(self.base), *map(_tree, self.trees)])
        return F.expr(f"1D / (1D + exp(-({total})))")


# Trees are SQL text: one call to the JVM for an expression, however many nodes it has.
def _number(x: float) -> str:
    return f"{float(x)!r}D"


def _tree(t) -> str:
    if isinstance(t, float):
        return _number(t)
    name, at, low, high = t
    return f"CASE WHEN `{name}` <= {_number(at)} THEN {_tree(low)} ELSE {_tree(high)} END"


def _leaf_id(t, at: int = 1) -> str:
    """The number of the leaf a row falls in: the root is 1, children of k are 2k and 2k + 1."""
    if isinstance(t, float):
        return str(at)
    name, cut_at, low, high = t
    return f"CASE WHEN `{name}` <= {_number(cut_at)} THEN {_leaf_id(low, 2 * at)} ELSE {_leaf_id(high, 2 * at + 1)} END"


def _grow(t, splits: dict, at: int = 1):
    if isinstance(t, float):
        return splits.get(at, t)
    return (*t[:2], _grow(t[2], splits, 2 * at), _grow(t[3], splits, 2 * at + 1))


def _set_leaves(t, value: dict, at: int = 1):
    if isinstance(t, float):
        return value.get(at, 0.0)
    return (*t[:2], _set_leaves(t[2], value, 2 * at), _set_leaves(t[3], value, 2 * at + 1))


def fit(labelled: DataFrame, key: str = "url", bound: int = LABELLED, rounds: int = ROUNDS, depth: int = DEPTH) -> Model:
    """Fits trees on rows with the lexical features, suffix and a 0/1 column y (1: block; null rows are left out).

    Without rows, or with one class only, the model is the smoothed share of blocks alone.
    """
    known = labelled.where("y is not null")
    total, blocked = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    rate = (blocked + 1) / (total + 2)
    model = Model(math.log(rate / (1 - rate)), rate)
    if total in (blocked, 0) or not blocked:
        return model
    pick = F.pmod(F.xxhash64(F.lit(11), F.coalesce(F.col(key), F.lit(""))), F.lit(_MILLION)) < int(_MILLION * min(1.0, bound / total))
    # About `bound` rows: in one partition the rounds below have no shuffle.
    rows = cut(known.where(pick).select("y", "suffix", *FEATURES[:-2]).coalesce(1)).coalesce(1)
    model.suffixes = cut(rows.groupBy("suffix").agg(F.count("*").alias("_rows"), F.sum("y").alias("_blocked")))
    own = rows.join(F.broadcast(model.suffixes), "suffix").withColumn("suffix_rate", F.round((F.col("_blocked") - F.col("y") + PRIOR * rate) / (F.col("_rows") - 1 + PRIOR), 6)).withColumn("suffix_count", F.round(F.log2(F.col("_rows").cast("double")), 6))
    marks = own.agg(*(F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 100 * bound).alias(f) for f in FEATURES)).first()
    if marks[0] is None:
        return model
    edges = {f: sorted(set(marks[f])) for f in FEATURES}
    bins = (" + ".join(["0", *(f"CAST(`{f}` > {_number(e)} AS INT)" for e in edges[f])]) for f in FEATURES)
    own = cut(own.select("y", *FEATURES, F.expr(f"array({', '.join(bins)})").alias("_bins"))).coalesce(1)
    for _ in range(rounds):
        pulls = own.withColumn("_p", model.score()).selectExpr("*", f"CAST(round((_p - y) * {_MILLION}) AS BIGINT) AS _g", f"CAST(round(_p * (1 - _p) * {_MILLION}) AS BIGINT) AS _h")
        tree, sums = 0.0, {}
        for level in range(depth):
            cells = (
                pulls.selectExpr(f"{_leaf_id(tree)} AS _at", "_g", "_h", "posexplode(_bins) AS (_f, _b)")
                .groupBy("_at", "_f", "_b")
                .agg(F.expr("sum(_g) AS g"), F.expr("sum(_h) AS h"), F.expr("count(*) AS n"))
                .collect()
            )  # at most 2^depth * features * bins rows
            splits, new = _best(cells, edges)
            sums |= new
            if not splits:
                break
            tree = _grow(tree, splits)
        model.trees.append(_set_leaves(tree, {k: round(-RATE * g / (h + RIDGE), 9) for k, (g, h) in sums.items()}))
    return model


def _best(cells: list, edges: dict) -> tuple[dict, dict]:
    """The best split of each node, and the sums of the nodes and of the children they split into."""
    nodes: dict = {}
    for c in cells:
        nodes.setdefault(c["_at"], {}).setdefault(c["_f"], {})[c["_b"]] = (c["g"] / _MILLION, c["h"] / _MILLION, c["n"])
    splits, sums = {}, {}
    for at, by in sorted(nodes.items()):
        g, h, n = (sum(x[i] for x in by[0].values()) for i in range(3))
        sums[at] = (g, h)
        best = (1e-6,)
        for f, name in enumerate(FEATURES):
            gl = hl = nl = 0
            for b in range(len(edges[name])):
                if b in by[f]:
                    gl, hl, nl = gl + by[f][b][0], hl + by[f][b][1], nl + by[f][b][2]
                if min(nl, n - nl) < LEAF:
                    continue
                gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
                if gain > best[0] + 1e-9:
                    best = (gain, name, edges[name][b], gl, hl)
        if len(best) > 1:
            _, name, edge, gl, hl = best
            splits[at] = (name, float(edge), 0.0, 0.0)
            sums[2 * at], sums[2 * at + 1] = (gl, hl), (g - gl, h - hl)
    return splits, sums


def with_score(df: DataFrame, model: Model) -> DataFrame:
    """Adds score, the probability of a block, to rows with features and suffix."""
    if model.suffixes is None:
        return df.withColumn("score", F.lit(float(model.rate)))
    joined = df.join(model.suffixes, "suffix", "left")  # as many rows as labelled suffixes; Spark broadcasts it if it is small
    n = F.coalesce("_rows", F.lit(0))
    joined = joined.withColumn("suffix_rate", F.round((F.coalesce("_blocked", F.lit(0)) + PRIOR * model.rate) / (n + PRIOR), 6)).withColumn("suffix_count", F.round(F.log2(F.greatest(n, F.lit(1)).cast("double")), 6))
    return joined.withColumn("score", model.score()).drop("_rows", "_blocked")


def labelled_urls(spark, n: int = EXAMPLES) -> DataFrame:
    """The labelled table: url and y, as literal rows, so that no Python worker is needed."""
    rows = ", ".join(f"('{u}', {y})" for u, y in map(example_url, range(n)))
    return spark.sql(f"SELECT url, y FROM VALUES {rows} AS t(url, y)")


def judge(df: DataFrame, labels: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict (allow or block) and score to df.

    labels: rows with a URL column of the same name and y (1: block). The longest
    fitting rule's verdict stands; of rules that tie, which name the same host
    and path, the last one given. Where none fits, a score over one half blocks.
    Null, empty and very long URLs are judged whole, like any other; repeated
    rows stay; other columns keep their names and values, whatever they are
    called, but for those added, which are replaced. An empty df gives no rows.
    """
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "score")]
    plain = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{url}`").alias("url"))
    name, verdict = rule_column(rules)
    decided = with_parts(plain).withColumn("rule", name).withColumn("verdict", verdict)
    model = fit(with_features(with_parts(labels.select(F.col(f"`{url}`").alias("url"), "y"))))
    scored = with_score(with_features(decided), model)
    final = F.coalesce("verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select(*(F.col(f"row.`{c}`") for c in kept), "host", "path", "rule", final.alias("verdict"), F.round("score", 6).alias("score"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL, judged."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), labelled_urls(spark)).drop("url")


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLES: dict[str, str] = {}  # url_oracle has it
