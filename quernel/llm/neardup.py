"""MinHash near-duplicates by a multi-index Hamming join.

1. Words of each text give a set of hashed shingles; equal sets are one class, represented by its smallest id.
2. A class's signature has `hashes` minima of `BITS` bits. Two sets at the wanted similarity differ in so many places of
   the signature only with a chance below MISS; that number is the distance threshold.
3. Signatures are split into chunks. By the pigeonhole principle, a pair within the threshold has a chunk with one
   error at most. So each chunk is indexed with every single place left out: a pair within the threshold always meets
   under some key. No key has a cap: members of a key are dealt into blocks, and blocks meet in pairs of bounded size.
4. Within a block pair, signatures within the threshold are joined by union-find, and only a spanning forest leaves the
   task. Its components are loose families: all true links lie inside one.
5. In a family of REPRESENTED members or more, each is compared on full sets with a representative, the member that meets the most
   others in the index. Those linked with it are one component, and are compared with none but those that aren't.
6. What is left to compare is dealt into block pairs, again with full shingle sets. Sets of a link differ in size by the similarity at
   most, so a family falls into bands of sizes, and only neighbouring bands meet: very long members don't meet short ones.
   Each task counts all intersections exactly, as a product of incidence matrices over the shingles that at least two of its
   members have, and again only a spanning forest of confirmed links leaves the task. Its components are the result.

Nothing about all documents comes to the driver. Groups of copies collapse before anything is dealt.

Edge cases. A null or empty text has no words and an empty set: it is linked with nothing. Fewer words than a shingle
has make one shingle, the whole sequence. Texts of any length count whole; one text's set must fit a worker. Rows without an id take no part: their component is null and they are kept.
Rows that repeat an id stand each for their own text; copies of a row share a component. Ties go to the smaller id. An
empty table gives no rows. Extra columns are ignored here, whatever their names; `deduplicated` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.operators.components import components

from .common import as_bytes, in_small_batches, slices, stored

#: Bits of a minimum, places of a chunk, and the chance that a link at the very threshold stays outside the distance.
BITS, CHUNK, MISS = 16, 4, 1e-7
#: Members of a block of one key; least and most members of a block of a family, and bytes of its sets.
KEY_BLOCK, LEAST_BLOCK, MOST_BLOCK, BLOCK_BYTES = 1024, 128, 1024, 16 << 20
WORDS_KEPT = 300_000
#: Rows of a matrix of links that are worked on at a time.
ROWS = 256
#: Members of a family that has a representative, at least.
REPRESENTED = 64


def signature_size(similarity: float) -> int:
    """The fewest hashes, in whole chunks, at which a link at `similarity` misses the distance threshold with a chance below MISS.

    With chunks of CHUNK places and one error allowed in each, the threshold is two errors a chunk less one.
    """
    for k in range(CHUNK, 256, CHUNK):
        d, p = 2 * (k // CHUNK) - 1, 1 - similarity
        if sum(comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(d + 1, k + 1)) < MISS:
            return k
    raise ValueError("this similarity needs too long signatures")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Texts to sorted arrays of 64-bit shingle hashes. Words' hashes are remembered, in bounded number."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # on bytes: A-Z alone change, ASCII white space alone separates
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        ids = list(map(known.get, words))
        if None in ids:
            if len(known) > WORDS_KEPT:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            ids = [known.get(w) or xxhash.xxh3_64_intdigest(w) for w in words]
        h = np.array(ids, np.uint64)
        size = min(self.size, len(h))
        total = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            total = _mixed(total * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : len(h) - size + 1 + i])
        return np.unique(total)


def signature(found: np.ndarray, hashes: int) -> np.ndarray:
    """The low BITS of each minimum; sets of any size go by parts."""
    seeds = _mixed(np.arange(1, hashes + 1, dtype=np.uint64))
    least = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, _mixed(found[at : at + 4096, None] ^ seeds[None, :]).min(axis=0))
    return (_mixed(least) & np.uint64((1 << BITS) - 1)).astype("<u2")


def _keys(sig: np.ndarray) -> np.ndarray:
    """For each place of each signature, the key of its chunk with that place left out."""
    n, k = sig.shape
    s = sig.astype(np.int64).reshape(n, k // CHUNK, CHUNK)
    out = np.empty((n, k // CHUNK, CHUNK), np.int64)
    for left in range(CHUNK):
        key = np.zeros((n, k // CHUNK), np.int64)
        for i in range(CHUNK):
            if i != left:
                key = key << BITS | s[:, :, i]
        out[:, :, left] = key
    place = np.arange(k, dtype=np.int64).reshape(1, k // CHUNK, CHUNK)
    return (place << 3 * BITS | out).reshape(n, k)


def _forest(linked: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of a symmetric matrix: its smallest node, and each of its others."""
    label = nodes.copy()
    most = np.iinfo(np.int64).max
    while True:
        near = [np.where(linked[at : at + ROWS], label[None, :], most).min(axis=1) for at in range(0, len(label), ROWS)]
        low = np.minimum(label, np.concatenate(near))
        if (low == label).all():
            break
        label = low
    other = label != nodes
    return label[other], nodes[other]


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys; batches come sorted, and a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            if b > a:
                key = tuple(c[a] for c in columns)
                if held and key != last:
                    yield pa.Table.from_batches(held)
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _paired(members: DataFrame, group: str, blocks: str, node: str) -> DataFrame:
    """Deals each group's members into its number of blocks, and each block to every pair of blocks that has it."""
    dealt = members.withColumn("_mine", F.pmod(F.xxhash64(node), F.col(blocks)).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    pair = F.struct(F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j"))
    return dealt.withColumn("pair", F.xxhash64(group, pair)).drop("_mine", "_other")


def _forests(members: DataFrame, test) -> DataFrame:
    """Runs `test` (a table of one block pair to the matrix of its links) on every block pair; gives edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["pair"]):
            if table.num_rows > 1:
                a, b = _forest(test(table), table.column("node").to_numpy())
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return members.repartition("pair").sortWithinPartitions("pair").mapInArrow(run, "a long, b long")


def _mark(text: str) -> Column:
    """Tells texts apart, byte by byte."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def classes(df: DataFrame, key: str, text: str, shingle: int, hashes: int) -> DataFrame:
    """(key, mark of the text, n_shingles, digest, sig) of every row; digest and sig are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for whole in batches:
            for batch in slices(whole, text):
                sets = [shingles(x) for x in as_bytes(batch.column(text))]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sigs = [signature(s, hashes).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("_mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "mark", "n_shingles", "digest", "sig"])

    return in_small_batches(df).select(key, text, _mark(text).alias("_mark")).mapInArrow(run, "id long, mark binary, n_shingles long, digest binary, sig binary")


def _within(hashes: int):
    most = 2 * (hashes // CHUNK) - 1

    def test(table: pa.Table) -> np.ndarray:
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, hashes)
        apart = np.zeros((len(sig), len(sig)), np.uint8)
        for i in range(hashes):
            apart += sig[:, i, None] != sig[None, :, i]
        return apart <= most

    return test


def _similar(num: int, den: int):
    def test(table: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        rows = np.repeat(np.arange(len(sets)), sizes)
        found, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        rows, column = rows[shared], column[shared]
        name = np.cumsum(count > 1) - 1
        column = name[column]
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        width = max(1, (32 << 20) // (4 * len(sets)))
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, (low, low + width))
            part = np.zeros((len(sets), min(width, int(column[b - 1]) - low + 1) if b > a else 1), np.float32)
            part[rows[a:b], column[a:b] - low] = 1
            both += part @ part.T
        linked = np.empty(both.shape, bool)
        for at in range(0, len(sets), ROWS):  # whole numbers of 64 bits for a few rows at a time
            joint = np.rint(both[at : at + ROWS]).astype(np.int64)
            linked[at : at + ROWS] = den * joint >= num * (sizes[at : at + ROWS, None] + sizes[None, :] - joint)
        return linked

    return test


def _represented(family: DataFrame, degrees: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, rep): the members of large families that are linked with their representative, and that itself."""
    large = family.groupBy("label").agg(F.count("*").alias("c")).where(F.col("c") >= REPRESENTED).select("label")
    found = family.select("node", "label").join(large, "label").join(degrees, "node").groupBy("label").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("rep"))
    found = found.join(sets.select(F.col("node").alias("rep"), F.col("shingles").alias("of_rep")), "rep")
    asked = family.select("node", "label").join(sets, "node").join(found, "label").select("node", "rep", "shingles", "of_rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, held, rep = [], b"", np.zeros(0, np.uint64)
            for i in range(batch.num_rows):
                raw = batch.column("of_rep")[i].as_py()
                if raw != held:
                    held, rep = raw, np.frombuffer(raw, "<u8")
                own = np.frombuffer(batch.column("shingles")[i].as_py(), "<u8")
                joint = len(np.intersect1d(own, rep, assume_unique=True)) if min(len(own), len(rep)) * den >= max(len(own), len(rep)) * num else 0
                kept.append(den * joint >= num * (len(own) + len(rep) - joint))
            yield batch.select(["node", "rep"]).filter(pa.array(kept, pa.bool_()))

    return stored(asked.mapInArrow(run, "node long, rep long"), "neardup-inside")


def _left_to_test(family: DataFrame, inside: DataFrame, num: int, den: int) -> DataFrame:
    """(pair, node): the block pairs that together hold every pair of a family that may be a link, but for those of two members
    that are linked with the representative."""
    width = log(den / num) * (1 + 1e-9) if num < den else 1e-9
    rows = family.select("node", "label", "n", F.floor(F.log(F.col("n").cast("double")) / width).alias("band")).join(inside.select("node", F.lit(True).alias("_in")), "node", "left")
    rows = rows.withColumn("_in", F.coalesce("_in", F.lit(False)))
    # a group is two neighbouring bands, or one without neighbours
    order = Window.partitionBy("label").orderBy("band")
    bands = rows.groupBy("label", "band").agg(F.count("*").alias("_n")).select("label", "band", (F.lead("band").over(order) == F.col("band") + 1).alias("next"), (F.lag("band").over(order) == F.col("band") - 1).alias("last"))
    groups = F.array_compact(F.array(F.when(F.col("next"), F.col("band")), F.when(F.col("last"), F.col("band") - 1), F.when(~F.coalesce("next", F.lit(False)) & ~F.coalesce("last", F.lit(False)), F.col("band"))))
    rows = rows.join(bands.select("label", "band", F.explode(groups).alias("g")), ["label", "band"])
    sizes = rows.groupBy("label", "g").agg(F.count_if("_in").alias("ins"), F.count_if(~F.col("_in")).alias("outs"), F.max("n").alias("most")).where("outs > 0 and ins + outs > 1")
    c = F.col("ins") + F.col("outs")
    block = F.greatest(F.least(F.greatest(c / 16, F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK), F.lit(BLOCK_BYTES) / (8 * F.col("most"))), F.lit(1.0))
    sizes = sizes.select("label", "g", F.ceil(F.col("ins") / block).cast("int").alias("ins"), F.ceil(F.col("outs") / block).cast("int").alias("outs"))
    # blocks of members outside have numbers from 0, of those inside from -1 down; a pair of blocks has one outside at least
    rows, h = rows.join(sizes, ["label", "g"]), F.xxhash64("node")
    rows = rows.withColumn("_mine", F.when(F.col("_in"), -1 - F.pmod(h, F.col("ins"))).otherwise(F.pmod(h, F.col("outs"))).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.when(F.col("_in"), 0).otherwise(-F.col("ins")), F.col("outs") - 1)))
    return rows.select(F.xxhash64("label", "g", F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias("pair"), "node")


def _linked(df: DataFrame, key: str, text: str, shingle: int, num: int, den: int, null_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, mark, n_shingles, digest, sig) of every row, and (digest, component_id, label) of every class, where label names its
    component. With `null_ids`, rows without an id take part in the links."""
    hashes = signature_size(num / den)
    rows = stored(classes(df, key, text, shingle, hashes), "neardup-rows")
    one = rows.where("digest is not null" if null_ids else "id is not null and digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    # where texts that differ share their smallest id, all but one get a node of their own, and so do those without an id
    one = stored(one, "neardup-one")
    clash = one.groupBy("id").agg(F.min("digest").alias("lead"), F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("cid"), "lead")
    one = one.join(clash, one["id"] == clash["cid"], "left").select("digest", "id", "sig", "n", F.when(F.col("id").isNull() | F.col("lead").isNotNull() & (F.col("lead") != F.col("digest")), -F.shiftrightunsigned(F.xxhash64("digest"), 1) - 1).otherwise(F.col("id")).alias("node"))
    one = stored(one, "neardup-classes")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, hashes)
                node = np.repeat(batch.column("node").to_numpy(), hashes)
                yield pa.RecordBatch.from_arrays([pa.array(_keys(sig).reshape(-1)), pa.array(node)], names=["key", "node"])

    keys = one.select("node", "sig").mapInArrow(index, "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", "c", F.ceil(F.col("c") / KEY_BLOCK).alias("blocks"))
    members = keys.join(shared, "key")
    members = stored(members, "neardup-members")
    members = members.join(one.select("node", "sig"), "node")
    loose = components(_forests(_paired(members, "key", "blocks", "node").select("pair", "node", "sig"), _within(hashes)))
    family = loose.join(one.select("node", "id", "digest", "n"), "node")
    family = stored(family, "neardup-family")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for whole in batches:
            for batch in slices(whole, text):
                sets = [shingles(x).tobytes() for x in as_bytes(batch.column(text))]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["id", "digest", "shingles"])

    # the sets of family members are made anew from their texts, so that no set of any other document is kept
    texts = in_small_batches(df).select(F.col(key).cast("long").alias(key), text)
    wanted = texts.join(family.select(F.col("id").alias(key)).distinct(), key, "left_semi")
    made = wanted.mapInArrow(full, "id long, digest binary, shingles binary").join(family.select("node", "id", "digest"), ["id", "digest"])
    if null_ids:
        unnamed = texts.where(F.col(key).isNull()).distinct().mapInArrow(full, "id long, digest binary, shingles binary")
        made = made.unionByName(unnamed.join(family.where("id is null").select("node", "digest"), "digest"), allowMissingColumns=True)
    sets = made.groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = stored(sets, "neardup-sets")
    inside = _represented(family, members.groupBy("node").agg(F.sum("c").alias("met")), sets, num, den)
    tested = _left_to_test(family, inside, num, den).join(sets, "node")
    links = components(_forests(tested, _similar(num, den)).unionByName(inside.where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))))
    named = links.join(one.select("node", "id", "digest"), "node")
    lead = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = named.join(lead, "label").select("digest", "component_id", "label")
    done = one.select("digest", "id", "node").join(named, "digest", "left").select("digest", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("label", "node").alias("label"))
    # a table of its own, so that nothing but the join below rests on its dealing: a class with very many copies can be split
    return rows, stored(done, "neardup-done")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest id reachable by links) and kept (whether that is its own id).
    Two sets are linked if den * intersection >= num * union."""
    rows, done = _linked(df, key, text, shingle, num, den)
    alone = rows.where("id is null or digest is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = rows.where("id is not null and digest is not null").join(done, "digest").select("id", "n_shingles", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of one document of each group, the one with the smallest id; rows that repeat an id go down to one row,
    and rows without an id stay."""
    found = near_duplicates(df, key, text, shingle, num, den).where("kept").select(key).where(F.col(key).isNotNull()).distinct()
    named = df.where(F.col(key).isNotNull()).join(found, key, "left_semi")
    # of rows that repeat an id the least stays, whatever order they come in
    order = F.struct(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.MapType)])
    one = named.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("_row")).select("_row.*")
    return one.unionByName(df.where(F.col(key).isNull()))


def deduplicated_rows(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of one document of each group, decided by id and text: texts that differ under one id are documents of their
    own. The one with the smallest id stays; equal rows, and those of one id whose texts are in one group, go down to one.
    Rows without an id are linked like others and never displace or give way to one with an id: of a group's, one stays.
    Those with an empty text all stay."""
    rows, done = _linked(df, key, text, shingle, num, den, null_ids=True)
    named = F.col("id").isNotNull()
    best = rows.where("digest is not null").join(done, "digest").groupBy("label", named.alias("named")).agg(F.min(F.struct("id", "mark")).alias("_best"))
    empty = rows.where(named & F.col("digest").isNull()).groupBy("id").agg(F.min("mark").alias("mark"))
    won = best.select("_best.id", "_best.mark").unionByName(empty).select(F.col("id").alias("_id"), F.col("mark").alias("_mark"))
    won = stored(won, "neardup-won")
    # of rows with equal id and text the least stays, whatever order they come in
    order = F.struct(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.MapType)])
    least = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("_row")
    marked = df.withColumns({"_id": F.col(key).cast("long"), "_mark": _mark(text)})
    with_id = marked.where("_id is not null").join(won, ["_id", "_mark"], "left_semi").groupBy("_id", "_mark").agg(least)
    without = marked.where("_id is null").join(won.where("_id is null").select("_mark"), "_mark", "left_semi").groupBy("_mark").agg(least)
    blank = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return with_id.select("_row.*").unionByName(without.select("_row.*")).unionByName(df.where(F.col(key).isNull() & blank))
