import math
import random

from quillmesh.operators import cohesion


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc int, masked string")


def loop_merge(sizes, floor):
    """Sections under the floor join the previous one, the first the next, one at a time."""
    groups = [[i] for i in range(len(sizes))]
    total = lambda g: sum(sizes[i] for i in g)
    while len(groups) > 1 and (small := next((k for k, g in enumerate(groups) if total(g) < floor), None)) is not None:
        other = small - 1 if small else 1
        a, b = sorted((small, other))
        groups[a : b + 1] = [groups[a] + groups[b]]
    return groups


def test_sections(spark):
    rows = cohesion.sections(docs(spark, ["pre\n# One\nbody a b\n\n## Two \nmore", ""])).orderBy("doc", "idx").collect()
    assert [(r["doc"], r["title"], r["level"], r["line"], r["body"]) for r in rows] == [(0, None, None, 1, "pre"), (0, "One", 1, 2, "body a b"), (0, "Two", 2, 5, "more"), (1, None, None, 1, "")]


def test_merge_is_the_loop(spark):
    rng = random.Random(3)
    cases = [[rng.choice([0, 1, 3, 6, 25]) for _ in range(rng.randrange(1, 7))] for _ in range(80)]
    texts = ["\n# H\n".join(" ".join(["word"] * n) for n in c) for c in cases]
    got = cohesion.merged_rows(cohesion.merged(docs(spark, texts), 6)).collect()
    for d, sizes in enumerate(cases):
        mine = [len(r["tokens"]) for r in sorted((r for r in got if r["doc"] == d), key=lambda r: r["sec"])]
        assert mine == [sum(sizes[i] for i in g) for g in loop_merge(sizes, 6)], sizes


def test_weights_edges_components(spark):
    a, b = "red green blue " * 10, "one two three " * 10
    texts = ["# A\n" + a + "\n# B\n" + b + "\n# C\n" + a, "# A\n" + a + "\n# B\n" + a, "# A\n" + a, ""]
    merged = cohesion.merged(docs(spark, texts))
    w = cohesion.weights(merged)
    assert {round(r["w"], 9) for r in w.where("doc = 0 and term = 'red'").collect()} == {round(10 * math.log(1.5), 9)}
    e = cohesion.edges(merged).collect()
    assert [(r["doc"], r["a"], r["b"], r["sim"]) for r in e] == [(0, 0, 2, 1.0)]
    clusters = {r["doc"]: r["clusters"] for r in cohesion.cluster_counts(docs(spark, texts), 0.15).collect()}
    assert clusters == {0: 2, 1: 2, 2: 1, 3: 1}  # two sections share only terms that weigh nothing


def test_components_partition_sections(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = ["\n# H\n".join(" ".join(rng.choices(words, k=25)) for _ in range(6)) for _ in range(5)]
    merged = cohesion.merged(docs(spark, texts))
    pairs = cohesion.edges(merged)
    got = {(r["doc"], r["sec"]): r["component"] for r in cohesion.components(merged, 0.3).collect()}
    assert set(got) == {(r["doc"], r["sec"]) for r in cohesion.merged_rows(merged).select("doc", "sec").collect()}
    for r in pairs.collect():
        if r["sim"] > 0.3:
            assert got[r["doc"], r["a"]] == got[r["doc"], r["b"]]
    assert all(c <= s for (_, s), c in got.items())
