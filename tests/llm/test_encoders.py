"""Operators that work text by text, against brute force, libraries and round trips; no Spark."""

import base64
import io
import random
import re
import struct

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
import xxhash
import zstandard
from tokenizers import Tokenizer

from quillmesh.llm import byte_bpe, crf, mpeg_audio, packing, pii, quality, simhash, token_store, word_tokens

ODD = ["", " ", "a  b   c ", "a \n \nb", "x\n\n bar", "a\x1cb \x1d c\x85\x85 d\xa0 e\x00f", "don't 'RE 12 ３４ é́ 漢字 🎉🎉 　 x", "a" * 3000, "\t\t x", "<|endoftext|>x <|startoftext|>", "İstanbul ΣΑΣ ǅ ﬁ ¼ ª"]
RANDOM = random.Random(4)
ODD += ["".join(RANDOM.choice(" \n\tab.'s1é漢\x1c\xa0ABCthe\0") for _ in range(RANDOM.randrange(60))) for _ in range(400)]


def test_byte_bpe_is_tiktoken():
    path = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    peer = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine, words = byte_bpe.ByteBPE(path, public.PATTERN), byte_bpe.Vocabulary(path)
    for t, ids in zip(ODD, mine.encode(ODD)):
        got = np.frombuffer(ids, "<u4")
        assert got.tolist() == peer.encode_ordinary(t), t
        assert words.decode(got).tobytes() == t.encode()
    for w in [b"aaaa", b"abababab", b" hahahaha"]:
        assert mine.replay([w]) == [mine._alone(w)]


def test_word_encoder_is_the_library():
    path = public.path("word_bpe_49k.json")
    peer = Tokenizer.from_file(path)
    mine = word_tokens.WordEncoder(path)
    cases = [*ODD, "a <|endoftext|> b", "a<|ENDOFTEXT|>b", "x<|startoftext|>y's", "<|endoftext|", "é <|endoftext|>\n\n<|startoftext|>É"]
    for _ in range(2):  # again from memory
        for t, ids in zip(cases, mine.encode(cases)):
            assert np.frombuffer(ids, "<u4").tolist() == peer.encode(t, add_special_tokens=False).ids, t


def test_word_encoder_takes_a_word_once():
    class Counted(dict):
        n = 0

        def get(self, *a):
            Counted.n += 1
            return super().get(*a)

    mine = word_tokens.WordEncoder(public.path("word_bpe_49k.json"))
    mine.words = Counted()
    mine.encode(["the cat, the hat\n" * 500, "a hat the " * 500, ""])
    assert Counted.n <= 6  # the, cat,, hat, a and perhaps an empty word


def test_word_encoder_starts_afresh(monkeypatch):
    path = public.path("word_bpe_49k.json")
    peer, mine = Tokenizer.from_file(path), word_tokens.WordEncoder(path)
    monkeypatch.setattr(word_tokens, "MEMO", 0)
    monkeypatch.setattr(word_tokens, "MEMO_PARTS", 0)
    learn, asked = mine._learn_parts, []
    monkeypatch.setattr(mine, "_learn_parts", lambda parts: (asked.extend(parts), learn(parts)))
    for texts in (["often often once"], ["often, new"], ODD, ["often! once", "", "x"]):
        for t, ids in zip(texts, mine.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == peer.encode(t, add_special_tokens=False).ids, t
        if texts[0] == "often, new":  # the parts that these words need are kept
            assert asked.count("often") == 1 and asked.count("new") == 1
    assert mine.encode([]) == [] and mine.encode(["", " \n"]) == [b"", b""]


def test_words_of_a_batch():
    space = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for texts in (ODD, [t for t in space if t[1] not in "\x1c\x1d\x1e\x1f"], ["", " x\x1cy  z "], []):
        assert [[w for w in ws if w] for ws in word_tokens.batch_words(texts).to_pylist()] == [word_tokens.split_words(t) for t in texts]
    assert word_tokens.batch_words([" x\x1cy  z "]).to_pylist() == [["x\x1cy", "z"]]


def fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    cases = [*ODD, "One two  three\tfour ÉÉ ONE two three", "a b c " * 50, "\x0b\x0c"]
    for k in (1, 3, 5):
        got = simhash.fingerprint_words([simhash.shingle_hashes(t, k) for t in cases])
        assert got.tolist() == [fingerprint(t, k) for t in cases]


def test_seekable_files():
    docs = [(5, b"\1\0\0\0" * 9), (7, b""), (None, b"\2\0\0\0"), (-3, np.arange(5000, dtype="<u4").tobytes())]
    sink = io.BytesIO()
    sink.close, close = (lambda: None), sink.close
    w = token_store.StoreWriter(sink)
    for k, ids in docs:
        w.add(k, ids)
    w.close()
    raw = sink.getvalue()
    r = token_store.StoreReader(io.BytesIO(raw))
    assert r.keys == [k for k, _ in docs] and [r.read(i) for i in range(len(r))] == [d for _, d in docs]
    assert list(r.find([-3, 99])) == [(-3, docs[3][1])]
    frames = int(r.offsets[-1])
    out, rest = b"", raw[:frames]
    while rest:  # any decoder reads the frames
        d = zstandard.ZstdDecompressor().decompressobj()
        out += d.decompress(rest)
        rest = d.unused_data
    assert out == b"".join(d for _, d in docs)
    bad = bytearray(raw)
    bad[8] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_store.StoreReader(io.BytesIO(bytes(bad))).read(0)
    with pytest.raises(ValueError):
        token_store.StoreReader(io.BytesIO(raw[:-1] + b"\0"))
    close()


def test_packing_plans():
    rng = np.random.default_rng(1)
    for n, cap in ((0, 64), (1, 64), (500, 64), (3000, 2048)):
        lengths = np.minimum(np.exp(rng.normal(np.log(cap) - 1.3, 1, n)).astype(int) + 1, cap)
        values, counts = np.unique(lengths, return_counts=True)
        hist = dict(zip(values.tolist(), counts.tolist()))
        runs, used = packing.plan(hist, cap)
        seen, filled = {}, {}
        for length, first, k, seq, at in runs:
            seen.setdefault(length, []).append((first, k))
            for q in range(seq, seq + k):
                filled.setdefault(q, []).append((at, length))
        for length, k in hist.items():
            nxt = 0
            for first, m in sorted(seen[length]):
                assert first == nxt
                nxt += m
            assert nxt == k
        assert sorted(filled) == list(range(used))
        for parts in filled.values():
            at = 0
            for a, length in sorted(parts):
                assert a == at
                at += length
            assert at <= cap
        assert used <= -(-int(lengths.sum()) // cap) * 1.01 + 1
    with pytest.raises(ValueError):
        packing.plan({65: 1}, 64)


def test_nnls():
    rng = np.random.default_rng(2)
    a, x = rng.random((12, 8)), np.array([1.0, 0, 2, 0, 0, 3, 0, 0.5])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    assert set(packing.patterns(4, 3)) == {(4,), (3, 1), (2, 2), (2, 1, 1)}


def test_mpeg_round_trip_and_facts():
    for text in (b"", b"abc", bytes(range(1, 200)) * 20, b"x" * 576):
        p = mpeg_audio.pad(text)
        assert len(p) % 576 == 0 and p and p.startswith(text)
        m = mpeg_audio.parse(data := mpeg_audio.write(p, {"bytes": str(len(text))}))
        n = len(p) // 576
        assert mpeg_audio.payload(data, m) == p
        assert (m.version, m.layer, m.sample_rate, m.samples, m.checked, m.failed, m.table, m.table_frames) == ("2", 3, 16000, 576 * n, n, 0, "Info", n)
        assert m.seconds == 576 * n / 16000 and m.frame_at(576 * n - 1) == m.offsets[-1] and m.tags["TXXX:bytes"] == str(len(text))


def frame(head, size, side=b"", crc=None):
    return (head + (b"" if crc is None else crc) + side).ljust(size, b"\0")


def test_mpeg_in_the_wild():
    head = b"\xff\xfb\x90\xc0"  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz, mono: 417 bytes
    padded = b"\xff\xfb\x92\xc0"
    low = b"\xff\xfb\x50\xc0"  # 64 kbit/s: 208 bytes
    h = mpeg_audio.header(head)
    assert (h.size, h.samples, h.side, h.protected) == (417, 1152, 17, False) and mpeg_audio.header(padded).size == 418
    frames = [frame(head, 417), frame(padded, 418), frame(low, 208), frame(head, 417)]
    apart = b"ID3\x04\0\0\0\0\0\x0bTIT2\0\0\0\1\0\0\3" + b"junk\xff\xfb" + frames[0] + frames[1] + b"\xff\xfe noise " + frames[2] + frames[3] + b"TAG" + b"Song".ljust(125, b"\0")
    m = mpeg_audio.parse(apart)
    assert len(m.offsets) == 4 and m.samples == 4 * 1152 and m.resyncs == 2 and bin(m.bitrates).count("1") == 2 and m.tags["ID3v1:title"] == "Song"
    side = bytes(17)
    protected = b"\xff\xfa\x90\xc0"
    good = mpeg_audio.crc16(protected[2:] + side).to_bytes(2, "big")
    m = mpeg_audio.parse(frame(protected, 417, side, good) + frame(protected, 417, side, b"\0\0"))
    assert (m.checked, m.failed) == (2, 1)
    xing = frame(head, 417, bytes(17) + b"Xing" + struct.pack(">III", 7, 2, 834) + bytes(100))
    m = mpeg_audio.parse(xing + frames[0] + frames[0] + frames[0][:50])
    assert (m.table, m.table_frames, m.table_bytes, len(m.toc), len(m.offsets), m.truncated) == ("Xing", 2, 834, 100, 2, True)
    vbri = frame(head, 417, bytes(32) + b"VBRI" + struct.pack(">HHH", 1, 0, 75) + struct.pack(">IIHHHH", 999, 3, 2, 1, 2, 1) + b"\1\0\2\0")
    assert mpeg_audio.parse(vbri + frames[0]).toc == [256, 512]
    for junk in (b"", b"no audio", b"\xff" * 50, b"ID3"):
        assert mpeg_audio.parse(junk).offsets == []


def brute_crf(u, t):
    import itertools

    n, s = u.shape
    scores = {p: sum(u[i, p[i]] for i in range(n)) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(s), repeat=n)}
    top = max(scores.values())
    z = sum(np.exp(v - top) for v in scores.values())
    marginal = np.zeros((n, s))
    for p, v in scores.items():
        for i, x in enumerate(p):
            marginal[i, x] += np.exp(v - top) / z
    return marginal, max(scores, key=scores.get), top + np.log(z)


def test_crf_against_all_paths():
    rng = np.random.default_rng(0)
    lengths, t = np.array([3, 1, 5, 2]), rng.normal(size=(3, 3))
    u = rng.normal(size=(11, 3))
    layout = crf.Layout(lengths)
    marginal, pairs, z = crf.forward_backward(u, t, layout)
    best = crf.viterbi(u, t, layout)
    start, total = 0, 0
    for n in lengths:
        m, p, lz = brute_crf(u[start : start + n], t)
        assert np.allclose(marginal[start : start + n], m) and best[start : start + n].tolist() == list(p)
        start, total = start + n, total + lz
    assert np.isclose(z, total) and np.isclose(pairs.sum(), (lengths - 1).sum())
    assert len(crf.viterbi(np.zeros((0, 3)), t, crf.Layout(np.zeros(0, int)))) == 0


BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (13 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((k, *m.span()))
    return out


def test_pii_base_spans():
    texts = ["".join(RANDOM.choice("ab.@-+01234 5678\n9()1.1.é") for _ in range(RANDOM.randrange(90))) for _ in range(4000)]
    texts += ["x@y.zz@w.vv", "a@b@c.d", "4111 1111-1111 1111", "001.02.3.255 1.2.3.4.5.6.7.8", "9" * 9000, "+1 (202) 555-0143 4111111111111111"]
    for t, (base, added) in zip(texts, pii.find(texts, pii.default_field())):
        assert base == brute_base(t), t
        assert not any(a < y and x < b for _, a, b in added for _, x, y in base)


def test_pii_field():
    f = pii.default_field()
    assert f.plain_is_other
    found = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in pii.find([t], f)[0][1]]
    assert found('re token = "08813ad77930c5f691325605b62c9dfd1b407297" eau') == [("secret", "08813ad77930c5f691325605b62c9dfd1b407297")]
    assert found("de la 4652511922028857 et") == [("card", "4652511922028857")]
    for clean in ("Licensed under CC BY-NC 4.0.", "the GNU General Public License, version 3.", "on 2024-05-17 at 10:30, 12.5 kg", ""):
        assert found(clean) == []
    t = "mail a@b.cc or +1 (202) 555-0143."
    base, added = pii.find([t], f)[0]
    assert pii.mask(t, base + added) == "mail <EMAIL> or <PHONE>."
    assert pii.mask("abcdef", [(0, 1, 4), (1, 2, 5)]) == "a<EMAIL>f"


def test_quality_field():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abdeilmnorst") for _ in range(rng.randrange(2, 8)))
    prose = lambda: "\n".join(" ".join([word().capitalize(), *(word() for _ in range(rng.randrange(5, 30)))]) + "." for _ in range(rng.randrange(1, 6)))
    junk = lambda: "\n".join(" ".join(word().upper() + "!!" for _ in range(20)) for _ in range(rng.randrange(1, 5)))
    good, bad = [prose() for _ in range(120)], [junk() for _ in range(60)]
    f = quality.train(good[:80] + bad[:40], [1] * 80 + [0] * 40)
    assert (f.score(good[80:]) >= 0.3).all() and (f.score(bad[40:]) < 0.3).all()
    edge = f.score(["", "\n\n", "x" * 200000])
    assert ((edge >= 0) & (edge <= 1)).all()
    assert quality.train([], []).score(["a"]).tolist() == [0.5]
    assert quality.train(["a", "b"], [1, 1]).score(["c"]) == pytest.approx(0.75)
    assert f.score([]).tolist() == []
