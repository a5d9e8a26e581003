"""Byte-level BPE encoding and decoding by segment trees over adjacent pair ranks.

A word's leaves are its adjacent pairs, each with the rank of its merge and its
place; inner nodes hold the least of their children, so the root yields the leftmost
pair of lowest rank.  A merge changes three leaves at most, and each change climbs
one path.  It ends when the root holds no mergeable pair.

Words of up to MAX_BATCHED bytes go through trees of many words at once, one NumPy
row each; longer ones through a tree of their own.  Words that came before are
remembered per Python worker, within a bound.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import beside, slices

#: Fixed value: how byte-level tokenizers of this kind cut a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_BATCHED = 64
#: Words remembered by a worker, and characters worked on at once.
MEMORY = 400_000
SLICE_CHARS = 1_500_000
NONE = np.int64(1) << 60


def byte_letters() -> dict[str, int]:
    """The letters by which tokenizer files write bytes: printable bytes are themselves, others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """One vocabulary: ids, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.byte_id = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self._words = regex.compile(WORD_PATTERN)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._memory: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they don't merge."""
        keys = left << 20 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], NONE)

    def _batch(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Words of 2 to leaves + 1 bytes, all at once; packed ids of each."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        ids = np.full((n, leaves + 1), -1, np.int64)
        inside = np.arange(leaves + 1) < lengths[:, None]
        ids[inside] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        final = ids.copy()
        places = np.arange(leaves, dtype=np.int64)
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        pair = inside[:, 1:]
        rank = np.full((n, leaves), NONE, np.int64)
        rank[pair] = self.ranks(ids[:, :-1][pair], ids[:, 1:][pair])
        tree[:, leaves:] = np.where(rank < NONE, rank * leaves + places, NONE)
        level = leaves // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        end = leaves + 1
        following = np.where(np.arange(leaves + 1) + 1 < lengths[:, None], np.arange(leaves + 1) + 1, end)
        before = np.tile(np.arange(leaves + 2) - 1, (n, 1))
        rows = np.arange(n)
        while True:
            best = tree[:, 1]
            live = best < NONE
            if not live.all():
                done = rows[~live]
                final[done] = ids[~live]
                if not live.any():
                    break
                rows, ids, tree, following, before, best = rows[live], ids[live], tree[live], following[live], before[live], best[live]
            r = np.arange(len(rows))
            at, new = best % leaves, self.merged[best // leaves]
            gone = following[r, at]
            after, prior = following[r, gone], before[r, at]
            ids[r, at], ids[r, gone] = new, -1
            following[r, at] = after
            before[r, after] = at
            has_after, has_prior = after < end, prior >= 0
            to_after = self.ranks(new, ids[r, np.where(has_after, after, 0)])
            to_prior = self.ranks(ids[r, np.where(has_prior, prior, 0)], new)
            tree[r, leaves + at] = np.where(has_after & (to_after < NONE), to_after * leaves + at, NONE)
            dead = gone < leaves
            tree[r[dead], leaves + gone[dead]] = NONE
            tree[r[has_prior], leaves + prior[has_prior]] = np.where(to_prior < NONE, to_prior * leaves + prior, NONE)[has_prior]
            touched = [leaves + at, leaves + np.where(dead, gone, at), leaves + np.where(has_prior, prior, at)]
            while touched[0][0] > 1:
                touched = [t >> 1 for t in touched]
                for t in touched:
                    tree[r, t] = np.minimum(tree[r, 2 * t], tree[r, 2 * t + 1])
        flat = final[final >= 0].astype("<u4").tobytes()
        ends = np.cumsum((final >= 0).sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _single(self, word: bytes) -> bytes:
        """One long word, by a tree of its own: logarithmic work for each merge."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)]
        leaves = 1 << max(1, (len(ids) - 1).bit_length())
        none, rank_of, merged = (1 << 62), self._rank_of, self.merged.tolist()
        first = self.ranks(ids[:-1], ids[1:])
        level = np.full(leaves, none, np.int64)
        level[: len(first)] = np.where(first < NONE, first * leaves + np.arange(len(first)), none)
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            levels.append(level)
        tree = [none, *np.concatenate(levels[::-1]).tolist()]
        ids, n = ids.tolist(), len(ids)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(place: int, value: int) -> None:
            node = leaves + place
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], leaves)
            gone = following[at]
            after, prior, new = following[gone], before[at], merged[rank]
            ids[at], ids[gone] = new, -1
            following[at] = after
            put(gone, none)
            if after < n:
                before[after] = at
                k = rank_of.get(new << 20 | ids[after])
                put(at, none if k is None else k * leaves + at)
            else:
                put(at, none)
            if prior >= 0:
                k = rank_of.get(ids[prior] << 20 | new)
                put(prior, none if k is None else k * leaves + prior)
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[bytes] = [b""] * len(raw)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            groups.setdefault(0 if len(w) < 2 else 1 << max(1, (len(w) - 2).bit_length()), []).append(i)
        for leaves, members in groups.items():
            if leaves == 0:
                for i in members:
                    out[i] = self.byte_id[np.frombuffer(raw[i], np.uint8)].astype("<u4").tobytes()
            elif leaves > MAX_BATCHED:
                for i in members:
                    out[i] = self._single(raw[i])
            else:
                step = max(1, 400_000 // leaves)
                for s in range(0, len(members), step):
                    some = members[s : s + step]
                    for i, ids in zip(some, self._batch([raw[i] for i in some], leaves), strict=True):
                        out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for a, b in slices(texts, SLICE_CHARS):
            out += self._encode(texts[a:b])
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts = [self._cut.split(t) if self._cut and any(s in t for s in self.special) else [t] for t in texts]
        words = [[w for k, part in enumerate(ps) for w in ([part] if k % 2 else self._words.findall(part))] if len(ps) > 1 else self._words.findall(ps[0]) for ps in parts]
        memory = self._memory
        new = [w for w in set(chain.from_iterable(words)) if w not in memory]
        if len(memory) + len(new) > MEMORY:
            memory.clear()
            new = list(set(chain.from_iterable(words)))
        plain = [w for w in new if w not in self.special]
        memory.update(zip(plain, self.encode_words(plain), strict=True))
        memory.update((w, np.array([self.special[w]], "<u4").tobytes()) for w in new if w in self.special)
        return [b"".join(map(memory.__getitem__, ws)) for ws in words]

    def decode(self, ids: bytes) -> bytes:
        """The text of packed ids in UTF-8; bytes that form no character become U+FFFD."""
        raw = b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode("utf-8")
        return raw


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    A null text is empty; an empty text has no ids.  Rows with null or repeated ids
    are encoded each by itself.  Other columns aren't read.  tokenizer_path is a file
    that each machine has.
    """

    def work(texts: list[str]) -> dict:
        bpe = load(tokenizer_path)
        ids = bpe.encode(texts)
        return {"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [sha256(x).hexdigest() for x in ids], "decoded_sha256": [sha256(bpe.decode(x)).hexdigest() for x in ids]}

    return beside(docs, ["doc_id"], "text", work, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids and the decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for b in batches:
            ids = bpe.encode([t or "" for t in b.column(1).to_pylist()])
            arrays = [b.column(0), pa.array([np.frombuffer(x, "<u4").astype("int64") for x in ids], pa.list_(pa.int64())), pa.array([bpe.decode(x).decode() for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<long>, decoded string")
