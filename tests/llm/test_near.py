"""The steps by which near duplicates find their candidates: fingerprints, blocks, Hamming distance."""

import numpy as np
import pytest

from quillmesh.llm import near, simhash

WORDS = near.BODY + near.HEAD


def sets_at(rng, shared, a, b, n):
    """n pairs of sets that share `shared` hashes and have a and b of their own."""
    for h in rng.integers(1 << 64, size=(n, shared + a + b), dtype=np.uint64):
        yield np.unique(h[: shared + a]), np.unique(np.concatenate([h[:shared], h[shared + a :]]))


def test_wide_fingerprints_bit_by_bit():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(1 << 64, size=n, dtype=np.uint64)) for n in (1, 2, 5, 63, 64, 65, 300)]
    got = simhash.wide_fingerprints(sets, 3)
    for s, row in zip(sets, got):
        for j, word in enumerate(row.tolist()):
            hashes = []
            for h in s.tolist():
                h = h * int(simhash._ODD[j]) % (1 << 64)
                h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 % (1 << 64)
                hashes.append(h ^ h >> 32)
            assert word == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(s))


@pytest.mark.parametrize("shared,a,b", [(4, 0, 1), (8, 1, 1), (12, 1, 2), (40, 5, 5), (300, 37, 38)])
def test_pairs_at_the_limit_agree_in_a_block_and_are_near(shared, a, b):
    pairs = list(sets_at(np.random.default_rng(2), shared, a, b, 500))
    x, y = (simhash.wide_fingerprints([p[i] for p in pairs], WORDS) for i in (0, 1))
    kx, ky = near.block_keys(x), near.block_keys(y)
    found = (kx == ky).any(axis=1)
    if shared + a <= near.SHORT:
        found |= (kx >> near.LESS == ky >> near.LESS).any(axis=1)
    apart = np.bitwise_count(x[:, near.BODY :] ^ y[:, near.BODY :]).sum(axis=1)
    assert (found & (apart <= near.FAR)).sum() >= 499
    apart = np.bitwise_count(x[1:, near.BODY :] ^ y[:-1, near.BODY :]).sum(axis=1)
    assert shared < 10 or (apart > near.FAR).all()  # unrelated


@pytest.mark.parametrize("wide", [1000, 3])
def test_chains_against_brute_force(wide, monkeypatch):
    monkeypatch.setattr(near, "WIDE", wide)
    monkeypatch.setattr(near, "PAIRS", 50)
    rng = np.random.default_rng(3)
    centres = rng.integers(1 << 64, size=(8, near.HEAD), dtype=np.uint64)
    x = centres[rng.integers(8, size=300)]
    for row in x:
        for bit in rng.choice(64 * near.HEAD, size=int(rng.integers(0, 70)), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    keys, sizes = np.sort(rng.integers(12, size=300)).astype(np.uint16), rng.integers(90, 130, size=300)
    want = list(range(300))
    for i in range(300):
        for j in range(i):
            far = sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(x[i], x[j]))
            if keys[i] == keys[j] and far <= near.FAR and 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j]) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    assert 20 < len(set(want)) < 280
    assert near.near_chains(keys, x, sizes).tolist() == want


def test_candidates_are_those_that_blocks_and_distance_bring_together(spark):
    """keep_one's candidates: only near copies share a group, and each has one."""
    base = {g: [f"g{g}w{k}" for k in range(60)] for g in range(30)}
    docs = [(2 * g, " ".join(w)) for g, w in base.items()] + [(2 * g + 1, " ".join([*w[:58], "x", "y"])) for g, w in base.items()]
    nodes = near._sketches(spark.createDataFrame(docs, "doc_id long, text string"), 5)
    of = {r["node"]: r["doc_id"] // 2 for r in nodes.collect()}
    groups = {}
    for r in near._blocks(nodes).groupBy("bin").applyInArrow(near._groups, "key long, node long, size long").collect():
        groups.setdefault(r["key"], set()).add(r["node"])
    assert {frozenset(of[n] for n in g) for g in groups.values()} == {frozenset([g]) for g in base}
    assert all(len(g) == 2 for g in groups.values())
