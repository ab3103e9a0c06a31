"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of WINDOW consecutive benchmark words (an item of fewer words is one window). Words are 64-bit hashes in
arrays. A block is BLOCK adjacent words: a shift table, indexed by the block's hash, says how far the search may jump when the
block ends the current frame (blocks that share a place share the smaller jump, which is safe). A block with shift 0
selects the bucket of patterns that end with it; in a bucket patterns lie by the hash of the whole window, and direct
comparison, of hashes and then of the words' own bytes, confirms each. Patterns of one length share one pair of tables, so
short items don't shorten the jumps of long ones. Texts are searched in stretches, many at a time.

The patterns are held by each worker, some seven bytes of tables for a byte of benchmark text. Their size is checked: up to
PATTERN_BYTES of benchmark text goes in one pass over the texts. A larger benchmark is dealt by hash over as many passes as it takes.
Each pass is a job of its own, which holds its own share of the items and no other, on the driver as in the workers, and writes what it hits;
a group-by on the row unites the passes. No item is left out at any size.

Edge cases. A null or empty text has no words: it is never hit. Null benchmark texts give no window, and an item with a
null id counts for hits but isn't listed. Repeated documents give repeated rows; repeated items count once by id. An
empty benchmark hits nothing. Texts of any length are searched whole; one beyond PIECE goes through the hashing in pieces. Extra
columns pass through; one with an output's name gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, giving_way, in_small_batches, slices, stored

WINDOW, BLOCK = 13, 2
#: Benchmark text that one pass holds.
PATTERN_BYTES = 16 << 20
#: Bytes that are hashed at a time, and window ends of a stretch that one cursor searches.
PIECE, STRETCH = 1 << 20, 128
#: Words are runs of letters, digits and bytes beyond ASCII; all else separates. A-Z become a-z.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_P = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of _P and of its inverse modulo 2**64, enough for a piece."""
    if not _POWERS:
        for base in (_P, pow(_P, -1, 1 << 64)):
            _POWERS.append(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(PIECE, base, np.uint64)))))
    return _POWERS


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a piece, which has PIECE bytes at most or is one word of that many or more."""
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], a != 32, [False])).view(np.int8)))
    start, end = edges[::2], edges[1::2]
    if len(start) == 1 and end[0] - start[0] >= PIECE:
        return np.array([xxhash.xxh3_64_intdigest(data[start[0] : end[0]])], np.uint64), start, end
    power, inverse = _powers()
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(a * power[: len(a)], dtype=np.uint64)))
    return _mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start, end


class Words:
    """The words of a text as hashes, and its bytes, A-Z lower-cased and separators as spaces."""

    def __init__(self, text: bytes):
        self.data = data = text.translate(WORD_BYTES)
        place = np.int32 if len(data) < 1 << 31 else np.int64
        parts, at = [], 0
        while at < len(data):
            to = len(data)
            if to - at > PIECE:  # up to the last word that ends in the piece; a longer word is a piece of its own
                to = data.rfind(b" ", at, at + PIECE) + 1 or data.find(b" ", at + PIECE) + 1 or to
            h, s, e = _hashed(data[at:to])
            parts.append((h, (s + at).astype(place), (e + at).astype(place)))
            at = to
        kinds = (np.uint64, place, place)
        self.hash, self.start, self.end = (np.concatenate([np.zeros(0, k), *x], dtype=k, casting="unsafe") for k, x in zip(kinds, zip(*parts, strict=True) if parts else ((),) * 3, strict=True))

    def __len__(self) -> int:
        return len(self.hash)

    def shown(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[at] : self.end[at + n - 1]].split())


def _blocks(h: np.ndarray, size: int) -> np.ndarray:
    """At each end the hash of the block of `size` words before it; the first ends, which have none, hold 0."""
    out = np.zeros(len(h) + 1, np.uint64)
    got = h[: len(h) - size + 1].copy()
    for i in range(1, size):
        got = _mixed(got * np.uint64(_P) + h[i : len(h) - size + 1 + i])
    out[size:] = got
    return out


def _window(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(first), np.uint64)
    for i in range(size):
        total = _mixed(total * np.uint64(_P) + h[first + i])
    return total


class WuManber:
    """Tables for windows of `length` words: those that begin at the places `first` of `text`, each of an item."""

    def __init__(self, length: int, text: Words, first: np.ndarray, item: np.ndarray):
        self.length, self.block, self.text = length, min(BLOCK, length), text
        m, b = length, self.block
        ends = _blocks(text.hash, b)
        bits = max(10, min(26, int(8 * len(first) + 1).bit_length()))
        self.mask, self.most = np.uint64((1 << bits) - 1), m - b + 1
        self.shift = np.full(1 << bits, self.most, np.uint8)
        for end in range(b, m + 1):  # the last are the smallest
            self.shift[ends[first + end] & self.mask] = m - end
        key = self._keys(ends[first + m], _window(text.hash, first, m))
        order = np.lexsort((item, key))
        self.key, self.first, self.item = key[order], first[order].astype(np.int32), item[order].astype(np.int32)
        same = (self.key[1:] == self.key[:-1]) & (self.item[1:] == self.item[:-1])
        for i in range(m):
            same &= text.hash[self.first[1:] + i] == text.hash[self.first[:-1] + i]
        kept = np.concatenate(([True], ~same)) if len(first) else np.zeros(0, bool)
        self.key, self.first, self.item = self.key[kept], self.first[kept], self.item[kept]

    @staticmethod
    def _keys(suffix: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Buckets by the last block, and in a bucket by the window."""
        return (suffix & ~np.uint64((1 << 32) - 1)) | (whole >> np.uint64(32))

    def jump(self, block: np.ndarray) -> np.ndarray:
        return self.shift[block & self.mask]

    def search(self, texts: list[Words]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, item) of each occurrence."""
        m = self.length
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        h = np.concatenate([np.zeros(0, np.uint64), *(t.hash for t in texts)])
        which = np.repeat(np.arange(len(texts)), np.maximum(0, -(-(sizes - m + 1) // STRETCH)))
        none = np.zeros(0, np.int64)
        if not len(which) or not len(self.key):
            return none, none, none
        ends = _blocks(h, self.block)
        number = np.arange(len(which)) - np.searchsorted(which, which)
        at = begin[which] + m + number * STRETCH
        limit = np.minimum(at + STRETCH, begin[which + 1] + 1)
        found = []
        while len(at):
            jump = self.jump(ends[at])
            if not jump.all():
                found.append(at[jump == 0])
                jump = np.maximum(jump, 1)
            at = at + jump
            left = at < limit
            at, limit = at[left], limit[left]
        end = np.concatenate([none, *found])
        key = self._keys(ends[end], _window(h, end - m, m))
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        count = high - low
        end, low = np.repeat(end, count), np.repeat(low, count)
        pattern = low + np.arange(len(low)) - np.repeat(np.cumsum(count) - count, count)
        right = np.ones(len(end), bool)
        for i in range(m):
            right &= h[end - m + i] == self.text.hash[self.first[pattern] + i]
        end, pattern = end[right], pattern[right]
        text = np.searchsorted(begin, end - m, "right") - 1
        first = end - m - begin[text]
        # equal hashes are as good as equal words, yet the words themselves decide
        places, back = np.unique(np.stack([text, first, self.first[pattern]], axis=1), axis=0, return_inverse=True)
        fine = np.array([texts[t].shown(a, m) == self.text.shown(p, m) for t, a, p in places.tolist()], bool)
        right = fine[back.reshape(-1)] if len(places) else np.zeros(0, bool)
        return text[right], first[right], self.item[pattern[right]]


class Benchmark:
    """Tables of all items, one pair for each length of a window, and the items' names."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        names = {name: i for i, name in enumerate(dict.fromkeys(n for n, _ in items))}
        self.names = list(names)
        text = Words(b" ".join((t or "").encode() for _, t in items))
        # items are joined by a space: an item's words are those that begin inside it
        ends = np.cumsum([len((t or "").encode()) + 1 for _, t in items])
        begin = np.concatenate(([0], np.searchsorted(text.start, ends))).astype(np.int64)
        size = np.diff(begin)
        self.tables = []
        for m in range(1, window + 1):
            own = np.flatnonzero(size == m if m < window else size >= window)
            if len(own):
                count = size[own] - m + 1
                first = np.repeat(begin[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                of = np.array([names[items[i][0]] for i in own.tolist()], np.int64)
                self.tables.append(WuManber(m, text, first, np.repeat(of, count)))

    def search(self, texts: list[Words]) -> list[tuple[list[int], list[str]]]:
        """For each text the stretches of words that occurrences cover (start, end, start, end, ...) and the names of their items, as strings, sorted."""
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        found: list[set] = [set() for _ in texts]
        for table in self.tables:
            for t, a, i in zip(*(x.tolist() for x in table.search(texts)), strict=True):
                spans[t].append((a, a + table.length))
                found[t].add(i)
        return [(united(s), sorted(n for i in f if (n := self.names[i]) is not None)) for s, f in zip(spans, found, strict=True)]


def united(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


#: The tables that this worker built last, by a digest of their items: its next tasks search with them too.
_built: dict[str, Benchmark] = {}


def _tables(name: str, items: list[tuple[str | None, str | None]], window: int) -> Benchmark:
    if name not in _built:
        _built.clear()
        _built[name] = Benchmark(items, window)
    return _built[name]


_HITS = [("hit_spans", T.ArrayType(T.LongType())), ("item_ids", T.ArrayType(T.StringType()))]
_MORE = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]


def _digest(n: list[int], spans: list[list[int]], ids: list[list[str]]) -> list[pa.Array]:
    hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
    sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
    flag = [h > 0 and 20 * h >= m for h, m in zip(hit, n, strict=True)]
    return [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array(flag, pa.bool_())]


def _arrays(spans: list, ids: list) -> list[pa.Array]:
    return [pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))]


def _pass(df: DataFrame, items: list, text: str, window: int, kept: list[str], whole: bool) -> DataFrame:
    """The columns `kept` and what these items hit; with `whole` every row and all outputs, else only rows that are hit."""
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in (_HITS + _MORE if whole else _HITS)])
    name = hashlib.sha256(repr((window, items)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _tables(name, items, window)
        for batch in batches:
            for part in slices(batch, text, PIECE):
                words = [Words(x) for x in as_bytes(part.column(text))]
                spans, ids = map(list, zip(*bench.search(words), strict=True))
                columns = [*(part.column(c) for c in kept), *_arrays(spans, ids)]
                if whole:
                    columns += _digest([len(w) for w in words], spans, ids)
                out = pa.RecordBatch.from_arrays(columns, names=schema.names)
                yield out if whole else out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    return in_small_batches(df).mapInArrow(run, schema)


def contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES, keep_text: bool = True) -> DataFrame:
    """Adds to each row n_words, n_hit (words inside any occurrence), hit_spans (word intervals, flattened start and
    end), item_ids (sorted as strings), n_items, items_sha256 and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    df = giving_way(df, [n for n, _ in _HITS + _MORE], text)
    kept = [c for c in df.columns if (keep_text or c != text)]
    bench = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("body")).where("body is not null")
    total = bench.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    passes = max(1, -(-total // pattern_bytes))
    if passes == 1:
        return _pass(df, [tuple(r) for r in bench.collect()], text, window, kept, True)
    # the rows get numbers that stay the same in all passes
    row = next(n for n in ("_row", *(f"_row{i}" for i in range(len(df.columns)))) if n not in df.columns)
    df = stored(df.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    hits = None
    for k in range(passes):
        share = bench.where(F.pmod(F.xxhash64("item", "body"), F.lit(passes)) == k)
        own = stored(_pass(df.select(row, text), [tuple(r) for r in share.collect()], text, window, [row], False), f"decontaminate-{k}")
        hits = own if hits is None else hits.unionByName(own)
    hits = hits.groupBy(row).agg(F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
    both = df.join(hits, row, "left").select(*df.columns, "hit_spans", "item_ids")
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in _HITS + _MORE])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, PIECE):
                n = [len(x.translate(WORD_BYTES).split()) for x in as_bytes(part.column(text))]
                spans = [united([*zip(x[::2], x[1::2], strict=True)]) if x else [] for x in part.column("hit_spans").to_pylist()]
                ids = [sorted(x or ()) for x in part.column("item_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *_arrays(spans, ids), *_digest(n, spans, ids)], names=schema.names)

    return in_small_batches(both).mapInArrow(finish, schema)
