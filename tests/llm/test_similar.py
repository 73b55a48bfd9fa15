"""The pipeline's near duplicates against brute force over the exact shingle sets."""

import numpy as np
import pytest
from conftest import SF

from quillmesh.llm import minhash, simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))


def kept_by_brute_force(docs):
    """Ids that stay: the smallest of each component."""
    ids = sorted(docs)
    sets = {i: shingles(docs[i]) for i in ids}
    first = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if first[i] != first[j] and alike(sets[i], sets[j]):
                low, high = sorted((first[i], first[j]))
                first = {k: low if c == high else c for k, c in first.items()}
    return sorted(set(first.values()))


def kept(spark, docs):
    return sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")).collect())


def test_pairs_near_the_limit(spark):
    """Isolated pairs of a similarity from 0.7 to 0.9."""
    rng = np.random.default_rng(5)
    docs = {}
    for p in range(200):
        words = [f"p{p}w{k}" for k in range(300)]
        other = list(words)
        for at in rng.choice(60, size=3 + p % 8, replace=False):
            other[5 * at] = f"x{p}y{at}"
        docs[2 * p], docs[2 * p + 1] = " ".join(words), " ".join(other)
    want = kept_by_brute_force(docs)
    assert 210 < len(want) < 390
    assert kept(spark, docs) == want


@pytest.mark.parametrize("most", [1, 8])
def test_table_and_a_large_group(spark, most, monkeypatch):
    monkeypatch.setattr(minhash, "COLD", most)
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    docs = {r["doc_id"]: r["text"] or "" for r in rows}
    rng = np.random.default_rng(6)
    base = [f"b{k}" for k in range(150)]
    for i in range(60):
        words = list(base)
        for at in rng.choice(150, size=int(rng.integers(1, 9)), replace=False):
            words[at] = f"z{i}v{at}"
        docs[10_000_000 + i] = " ".join(words)
    assert kept(spark, docs) == kept_by_brute_force(docs)


def test_repeated_lines_and_short_texts(spark):
    """What texts share counts once, however often it is repeated; few shingles are compared as exactly as many."""
    line = " ".join(f"l{k}" for k in range(15))
    docs = {i: " ".join([" ".join(f"d{i}w{k}" for k in range(60)), *[line] * 20]) for i in range(20)}
    for i in range(100, 160, 2):  # 7 of 9 shingles: 0.778
        words = [f"s{i}w{k}" for k in range(12)]
        docs[i], docs[i + 1] = " ".join(words), " ".join([*words[:11], f"x{i}"])
        assert len(shingles(docs[i]) & shingles(docs[i + 1])) == 7 and len(shingles(docs[i]) | shingles(docs[i + 1])) == 9
    assert kept(spark, docs) == sorted(docs)


def test_ids_repeated_with_other_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    for rows, want in (
        ([(3, a), (5, a), (5, b)], [(3, a), (5, b)]),
        ([(7, a), (7, b), (9, b)], [(7, a), (9, b)]),
        ([(3, a), (5, a), (5, a), (None, a), (6, c), (6, c)], [(None, a), (3, a), (6, c)]),
        ([(5, a), (5, b), (5, c), (5, c)], [(5, a), (5, b), (5, c)]),
    ):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = [tuple(r) for r in simhash.keep_one(docs).collect()]
        assert sorted(got, key=lambda r: (r[0] or -1, r[1])) == want


def test_large_keys_that_several_groups_share(spark, monkeypatch):
    """Sets that share keys with the smallest one but aren't similar to it are still compared with each other."""
    monkeypatch.setattr(minhash, "COLD", 2)
    monkeypatch.setattr(minhash, "CHUNK", 7)
    rng, docs = np.random.default_rng(8), {}
    core = [f"c{k}" for k in range(160)]
    for g in range(12):  # groups at about 0.7 of each other; within each about 0.85 and up
        own = [f"g{g}w{k}" for k in range(40)]
        for i in range(6):
            words = core + list(own)
            for at in rng.choice(200, size=int(rng.integers(0, 4)), replace=False):
                words[at] = f"x{g}i{i}v{at}"
            docs[100 * g + i] = " ".join(words)
    assert kept(spark, docs) == kept_by_brute_force(docs)


def test_groups_that_share_nodes_are_joined_by_few_links(spark, monkeypatch):
    """Sets below the limit that share groups of many blocks: what joins the groups grows with the sets, not with the blocks of each."""
    links, inner = [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda edges: links.append(edges.distinct().count()) or inner(edges))
    core = [f"c{k}" for k in range(94)]
    docs = {i: " ".join([*core, *(f"d{i}w{k}" for k in range(15))]) for i in range(300)}
    for i in range(40):  # a chain within the group
        docs[1000 + i] = " ".join([*core, *(f"d{i}w{k}" for k in range(12))])
    assert kept(spark, docs) == kept_by_brute_force(docs) == list(range(300))
    assert len(links) == 3  # pairs, groups, the rest of the pairs
    assert max(links) <= 3 * len(docs)
