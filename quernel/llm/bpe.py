"""Byte-level BPE encoding and decoding.

Merges of one pre-token are found with a segment tree over the ranks of adjacent pairs: the root holds the
lowest rank and, among equals, the leftmost place; a merge changes three leaves, each in logarithmic time, and
the work ends when the root holds no rank. Short pre-tokens are merged many at a time, in a matrix with a tree per row. Tokenizers are read from a vocabulary file, never trained here.

Edge cases. A null text is the empty text: no ids. A text of any length is encoded whole; a pre-token of n bytes
takes O(n log n) steps. Repeated rows are encoded each on its own. Extra columns pass through; one that has an
output's name gives way to the output. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import giving_way, in_small_batches, slices

#: The split pattern of byte-level BPE vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens kept by a worker with their ids: two generations of so many at most, none over LONG bytes.
CACHE, LONG = 300_000, 64


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTree:
    """Minimum segment tree over the ranks of adjacent pairs of one sequence: `at[1]` is the root, a key is rank and place."""

    def __init__(self, keys: list[int], none: int):
        n = 1
        while n < len(keys):
            n *= 2
        self.n = n
        self.at = at = [none] * n + keys + [none] * (n - len(keys))
        for i in range(n - 1, 0, -1):
            a, b = at[2 * i], at[2 * i + 1]
            at[i] = a if a <= b else b

    def put(self, i: int, key: int) -> None:
        at = self.at
        i += self.n
        if at[i] == key:
            return
        at[i] = key
        while i > 1:
            other = at[i ^ 1]
            if other < key:
                key = other
            i >>= 1
            if at[i] == key:
                return
            at[i] = key


#: Key of a pair that doesn't merge; rows of a matrix of trees.
NONE, ROWS = 1 << 62, 8192


class Bpe:
    """A byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_symbols()
        raw = lambda token: bytes(of[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()], default=-1) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in self.special else raw(token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = [vocab[c] for c, b in sorted(of.items(), key=lambda x: x[1])]
        #: rank of each pair of ids that merges, and what it becomes; a pair is one integer
        self.rank: dict[int, int] = {}
        self.becomes: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 32 | vocab[b]] = rank
            self.becomes.append(vocab[a + b])
        self._first = np.array(self.first, np.int64)
        order = sorted(self.rank)
        self._pairs = np.array(order + [np.iinfo(np.int64).max], np.int64)
        self._ranks = np.array([self.rank[k] for k in order] + [-1], np.int64)
        self._becomes = np.array(self.becomes, np.int64)
        self.split = regex.compile(SPLIT)
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.shown = [b"%d" % i for i in range(len(self.bytes_of))]

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        first, rank, becomes = self.first, self.rank.get, self.becomes
        ids = [first[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        bits = n.bit_length()
        mask, none = (1 << bits) - 1, 1 << 62
        keys = [none if (r := rank(a << 32 | b)) is None else r << bits | i for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
        tree = PairTree(keys, none)
        at, put = tree.at, tree.put
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while (root := at[1]) != none:
            i = root & mask
            j = after[i]
            k = after[j]
            ids[i] = new = becomes[root >> bits]
            ids[j] = -1
            after[i] = k
            if k < n:
                before[k] = i
                put(j, none)
                r = rank(new << 32 | ids[k])
                put(i, none if r is None else r << bits | i)
            else:
                put(i, none)
            if (h := before[i]) >= 0:
                r = rank(ids[h] << 32 | new)
                put(h, none if r is None else r << bits | h)
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens, packed. Those of like length share a matrix of trees, a row each: every round takes the
        root of each row, merges there, and updates the three leaves' paths in all rows at once."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(max(1, 1 << (len(w) - 2).bit_length()) if len(w) > 2 else 1, []).append(k)
        for size, places in by_size.items():
            if size > LONG:
                for k in places:
                    out[k] = np.array(self.merge(words[k]), "<i4").tobytes()
                continue
            for at in range(0, len(places), ROWS):
                part = places[at : at + ROWS]
                for k, packed in zip(part, self._merged([words[k] for k in part], size), strict=True):
                    out[k] = packed
        return out

    def _keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
        """Rank and place of each pair; NONE where the pair doesn't merge or a side is missing."""
        pair = left << 32 | right
        at = np.searchsorted(self._pairs, pair)
        known = (self._pairs[at] == pair) & (left >= 0) & (right >= 0)
        return np.where(known, self._ranks[at] << bits | place, NONE)

    def _merged(self, words: list[bytes], size: int) -> list[bytes]:
        n, width, bits = len(words), size + 2, size.bit_length()
        length = np.fromiter(map(len, words), np.int64, n)
        ids = self._first[np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)]
        ids[np.arange(width) >= length[:, None]] = -1
        after, before = np.tile(np.arange(1, width + 1), (n, 1)), np.tile(np.arange(-1, width - 1), (n, 1))
        tree = np.full((n, 2 * size), NONE, np.int64)
        tree[:, size:] = self._keys(ids[:, :size], ids[:, 1 : size + 1], np.arange(size), bits)
        level = size // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2

        def put(rows: np.ndarray, place: np.ndarray, key) -> None:
            at = place + size
            tree[rows, at] = key
            for _ in range(bits - 1):
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            root = tree[rows, 1]
            i = root & (1 << bits) - 1
            new = self._becomes[root >> bits]
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], ids[rows, j] = new, -1
            after[rows, i], before[rows, k] = k, i
            inside = j < size  # the last place of a full row is no pair's left side
            put(rows[inside], j[inside], NONE)
            put(rows, i, self._keys(new, ids[rows, k], i, bits))
            h = before[rows, i]
            left = h >= 0
            put(rows[left], h[left], self._keys(ids[rows[left], h[left]], new[left], h[left], bits))
            rows = rows[tree[rows, 1] != NONE]
        there = ids >= 0
        flat = ids[there].astype("<i4").tobytes()
        ends = (np.cumsum(there.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The whole ids of each text as little-endian 32-bit integers."""
        split = [[part if k % 2 else self.split.findall(part) for k, part in enumerate(self.specials.split(t) if self.specials else [t])] for t in texts]
        fresh = {w for parts in split for words in parts[::2] for w in words}
        fresh = [w for w in fresh if w not in self.young]
        if len(self.young) + len(fresh) > CACHE:
            self.old, self.young = self.young, {}
        own = {w: got for w in fresh if (got := self.old.get(w))}
        fresh = [w for w in fresh if w not in own]
        own |= zip(fresh, self.merge_many([w.encode() for w in fresh]), strict=True)
        self.young |= {w: got for w, got in own.items() if len(w) <= LONG}
        young, old = self.young.get, self.old.get
        out = []
        for parts in split:
            found = []
            for k, part in enumerate(parts):
                if k % 2:
                    found.append(self.special[part].to_bytes(4, "little"))
                    continue
                got = list(map(young, part))
                if None in got:
                    got = [x or own.get(w) or old(w) for x, w in zip(got, part, strict=True)]
                found += got
            out.append(b"".join(found))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def rest(self) -> None:
        """Between tasks a worker keeps half of what it remembers, as other work may need the memory."""
        self.old = {}

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """A worker reads a vocabulary once."""
    return Bpe(path)


def _added(df: DataFrame, names: list[tuple[str, T.DataType]], drop: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in drop] + [T.StructField(n, t) for n, t in names])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the column `ids` (array of int) with each text's tokens."""
    df = giving_way(df, [ids], text)
    schema = _added(df, [(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for whole in batches:
            for batch in slices(whole, text):
                found = [np.frombuffer(x, "<i4") for x in bpe.encode_all([x or "" for x in batch.column(text).to_pylist()])]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                flat = np.concatenate([np.zeros(0, "<i4"), *found])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=[*batch.schema.names, ids])
        bpe.rest()

    return in_small_batches(df).mapInArrow(run, schema)


def count(df: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Adds the number of each text's tokens; the ids don't leave the worker."""
    df = giving_way(df, [name], text)
    schema = _added(df, [(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for whole in batches:
            for batch in slices(whole, text):
                n = [len(x) // 4 for x in bpe.encode_all([x or "" for x in batch.column(text).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, name])
        bpe.rest()

    return in_small_batches(df).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the column `text` with the text that the ids stand for; null ids are no ids, bytes that aren't UTF-8 become U+FFFD."""
    df = giving_way(df, [text], ids)
    schema = _added(df, [(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for whole in batches:
            for batch in slices(whole, ids):
                found = [bpe.decode(x or ()).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, text])

    return in_small_batches(df).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: n_tokens, ids_sha256 (of the decimal ids, joined by commas) and
    decoded_sha256 (of the decoded text in UTF-8) take the text's place, so that ids needn't leave the worker."""
    kinds = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    df = giving_way(df, [n for n, _ in kinds], text)
    schema = _added(df, kinds, (text,))
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for whole in batches:
            for batch in slices(whole, text):
                n, first, second = [], [], []
                for packed in bpe.encode_all([x or "" for x in batch.column(text).to_pylist()]):
                    ids = np.frombuffer(packed, "<i4").tolist()
                    n.append(len(ids))
                    first.append(sha(b",".join(map(bpe.shown.__getitem__, ids))))
                    second.append(sha(bpe.decode(ids).decode("utf-8", "replace").encode()))
                columns = [batch.column(c) for c in kept] + [pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        bpe.rest()

    return in_small_batches(df).mapInArrow(run, schema)
