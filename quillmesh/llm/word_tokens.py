"""Ids of the `tokenizers` library's word-level BPE, each distinct word encoded once per Python worker.

The tokenizer file drops white space and never joins what it parts, so a
text's ids are those of its words, one after the other. Most words repeat: Arrow
parts a batch of texts into words and numbers the distinct ones, so that only
these become Python strings. A worker remembers the ids of up to MEMO bytes of
words and MEMO_PARTS of their parts, when full starts afresh with those that the
batch at hand repeats or needs, and forgets them when another stage comes, so
memory is bounded and results don't depend on it.

A word of letters from ASCII and Latin-1 is lower-cased and parted here (for
those characters the file's normaliser and pattern come to just that) and the
library's BPE model encodes each distinct part; any other word goes through
the library's whole tokenizer.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Collection, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillmesh.llm.common import remember

#: Bytes of words with their ids, and of parts of words, that a worker remembers; ENTRY is what each takes besides its characters and ids.
MEMO = 96 << 20
MEMO_PARTS = 48 << 20
ENTRY = 180
#: Bytes of text in a batch.
BATCH = 4 << 20
#: Longer words are encoded each time they occur.
MEMO_CHARS = 64
#: Words given to the library's model as one text.
GROUP = 64
#: Such texts encoded in one call: what the library gives back takes some 100 bytes an id.
AT_ONCE = 8

#: White space as Unicode's White_Space property has it; str.split() and Arrow also part at U+001C to U+001F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ONLY_PYTHON = "\x1c\x1d\x1e\x1f"

#: Words that are parted here, and the parts of their lower-cased forms.
_PLAIN = re.compile("[!-~\xc0-\xff]+")
_PARTS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+| |[0-9]|'(?:[stmd]|re|ve|ll)|[^ a-z0-9\xdf-\xf6\xf8-\xff]+")
#: Ends a word among ids; no id has these bytes.
_END = b"\xff\xff\xff\xff"

_encoders: dict[str, WordEncoder] = {}
#: What the worker's encoders are remembered as.
MEMO_NAME = "words"


def split_words(text: str) -> list[str]:
    if any(c in text for c in _ONLY_PYTHON):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def batch_words(texts: list[str]) -> pa.ListArray:
    """Each text's words, as split_words() has them but for empty ones at its ends."""
    if any(c in t for t in texts for c in _ONLY_PYTHON):
        return pa.array(map(split_words, texts), pa.list_(pa.large_string()))
    return pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level BPE: visible Latin-1 characters for themselves, the others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers, for texts in batches."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # Their strings in a text are their ids; such a text goes through the library whole. Some are looked for in lower-cased text.
        self.added = [(t.content.lower(), True) if t.normalized else (t.content, False) for t in self.whole.get_added_tokens_decoder().values()]
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.whole.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word part
        self.last[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.symbols = str.maketrans({i: s for i, s in enumerate(byte_symbols())})
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {" ": _END}
        self.held = self.held_parts = 0

    def _learn_parts(self, parts: list[str]) -> None:
        as_bytes = [p if p.isascii() else p.encode().decode("latin-1").translate(self.symbols) for p in parts]
        groups = [" ".join(as_bytes[i : i + GROUP]) for i in range(0, len(parts), GROUP)]
        found = (self.model.encode_batch_fast(groups[i : i + AT_ONCE], add_special_tokens=False) for i in range(0, len(groups), AT_ONCE))
        ids = np.fromiter(chain.from_iterable(e.ids for e in chain.from_iterable(found)), dtype="<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(parts):
            raise ValueError("the tokenizer's model doesn't end each word part with a last symbol of its own")
        raw, start = ids.tobytes(), 0
        for p, end in zip(parts, ends.tolist()):
            self.parts[p] = raw[start:end]
            start = end
        self.held_parts += _size(parts, [raw])

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        plain, other = [], []
        for w in words:
            (plain if _PLAIN.fullmatch(w) else other).append(w)
        got = {}
        if plain:
            parts = _PARTS.findall(" ".join(plain).lower())
            needed = {*parts, " "}
            if self.held_parts > MEMO_PARTS:
                self.parts = {p: self.parts[p] for p in needed if p in self.parts}
                self.held_parts = _size(self.parts, self.parts.values())
            if new := [p for p in needed if p not in self.parts]:
                self._learn_parts(new)
            got.update(zip(plain, b"".join(map(self.parts.__getitem__, parts)).split(_END)))
        if other:
            found = self.whole.encode_batch_fast(other, add_special_tokens=False)
            got.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(other, found))
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids; an empty text has none."""
        special = [i for i, t in enumerate(texts) if any(a in (t.lower() if low else t) for a, low in self.added)]
        if special:
            out = self.encode(["" if i in special else t for i, t in enumerate(texts)])
            for i in special:
                out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
            return out
        listed = batch_words(texts)
        coded = listed.values.dictionary_encode()
        if not len(coded):
            return [b""] * len(texts)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.words.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        got = self._learn([words[i] for i in missing])
        for i in missing:
            found[i] = got[words[i]]
        if self.held > MEMO:
            often = np.flatnonzero(np.bincount(coded.indices) > 1).tolist()
            self.words, self.held, got = {}, 0, {words[i]: found[i] for i in often}
        short = {w: ids for w, ids in got.items() if len(w) <= MEMO_CHARS}
        self.words.update(short)
        self.held += _size(short, short.values())
        joined = pa.array(found, pa.large_binary()).take(coded.indices)
        _, offsets, raw = joined.buffers()
        if raw is None:
            return [b""] * len(texts)
        ends = np.frombuffer(offsets, "<i8")[np.asarray(listed.offsets)].tolist()
        raw = memoryview(raw)
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]


def _size(words: Collection[str], ids: Iterable[bytes]) -> int:
    """About what they take in a memo."""
    return sum(map(len, words)) + sum(map(len, ids)) + ENTRY * len(words)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
    if path not in _encoders:
        gc.set_threshold(500_000, 20, 100)  # millions of strings live on in the memo; none is part of a cycle
        _encoders[path] = WordEncoder(path)
    remember(MEMO_NAME, _encoders.clear)
    return _encoders[path]
