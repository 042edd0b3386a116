"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

A document's set has its distinct five-word shingles. Its signature has CHUNKS x WIDTH symbols of 16 bits, the
minima of as many hashes. By pigeonhole, of two signatures with fewer than 2 x CHUNKS different symbols some chunk
differs in one symbol at most; so a document is filed under each chunk with each one of its symbols left out, and
all pairs under that distance, the threshold that is guaranteed, meet in a bucket. Many pairs beyond it meet too; those up
to MOST_DIFFERENT symbols are taken as well. Links are confirmed on the full sets.

Documents of equal sets are one class, joined to its smallest id; only such representatives are filed. In a bucket,
first every member is compared with its smallest. Buckets in which members of different components are left then
compare all of those by signature, in blocks; what is near goes on as one row for each document and block of others,
and is confirmed where that block's full sets are. So no pair is a row of its own unless it is a link.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import forget, in_arrow, redealt, texts, written

CHUNKS, WIDTH = 14, 5
SYMBOLS = CHUNKS * WIDTH
#: Signatures of similar sets differ in a quarter of the symbols; so many is five standard deviations more.
MOST_DIFFERENT = 36
#: The least likeness that the chunks, MOST_DIFFERENT and compared()'s size filter are made for.
LEAST_PERCENT = 75
#: Members of a bucket that a task compares at once; larger buckets are cut into blocks, and pairs of blocks dealt out.
LARGE = 5000
#: Documents whose full sets a task holds at once.
HELD = 5000
#: Edges of a round in a file, about.
FILE_EDGES = 1_000_000
#: Texts are hashed in groups of at most so many, and of about so many bytes; a longer text is a group of its own.
GROUP, GROUP_BYTES = 500, 2_000_000
_MIX = np.random.default_rng(20240229)
_A = _MIX.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _MIX.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(column: pa.Array, words: int = 5):
    """For each text the sorted distinct 64-bit hashes of its shingles; none for a null text or one without words."""
    ends = np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)), dtype="i8")]
    at = 0
    while at < len(column):
        start, at = at, max(at + 1, min(at + GROUP, int(np.searchsorted(ends, ends[at] + GROUP_BYTES, "right")) - 1))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.slice(start, at - start), "")))
        flat, bounds = lists.flatten(), np.asarray(lists.offsets).astype("i8")
        bounds = bounds - bounds[0]
        code = flat.dictionary_encode()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in code.dictionary.to_pylist()), np.uint64, len(code.dictionary))
        empty = np.asarray(pc.equal(flat, ""))
        h = hashes[np.asarray(code.indices)]
        if empty.any():
            bounds = bounds - np.r_[0, np.cumsum(empty)][bounds]
            h = h[~empty]
        with np.errstate(over="ignore"):
            s = h.copy()
            rolled = s[: max(0, len(h) - words + 1)].copy()
            for k in range(1, words):
                rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(rolled)]
            rolled = _mixed(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                yield np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=b - a)], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """The SYMBOLS 16-bit symbols of a set that isn't empty."""
    low = np.full(SYMBOLS, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 2048):
            low = np.minimum(low, (s[at : at + 2048, None] * _A + _B).min(axis=0))
        return (_mixed(low) >> np.uint64(48)).astype("<u2")


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """64-bit keys of n signatures, n x SYMBOLS: key k is chunk k // WIDTH without its symbol k % WIDTH."""
    n = len(sigs)
    parts = sigs.reshape(n, CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((n, CHUNKS, WIDTH), np.uint64)
    with np.errstate(over="ignore"):
        for skip in range(WIDTH):
            packed = np.zeros((n, CHUNKS), np.uint64)
            for k in (k for k in range(WIDTH) if k != skip):
                packed = (packed << np.uint64(16)) | parts[:, :, k]
            salt = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(skip + 1)
            out[:, :, skip] = _mixed(packed + salt * np.uint64(0x9E3779B97F4A7C15))
    return out.reshape(n, SYMBOLS)


def small(b: pa.RecordBatch, rows: int = GROUP):
    """The batch b in parts, so that what is made of a part stays small."""
    return (b.slice(k, rows) for k in range(0, len(b), rows))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (a digest of the set) and sig of every document."""

    def run(batches):
        for b in batches:
            n, digests, sigs = [], [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "class", "sig"])

    return in_arrow(texts(docs), run, "doc_id bigint, n_shingles bigint, class binary, sig binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """(id, items): the sorted hashes of each document's set."""

    def run(batches):
        for b in batches:
            for part in small(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1))], pa.binary())], ["id", "items"])

    return in_arrow(docs, run, "id bigint, items binary")


def filed(reps: DataFrame) -> DataFrame:
    """(key, id) of each representative under each of its keys."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.slice(at, 2000)
                ids = np.asarray(part.column(0))
                keys = chunk_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(len(part), SYMBOLS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view("i8")), pa.array(np.repeat(ids, SYMBOLS))], ["key", "id"])

    return in_arrow(reps.select("id", "sig"), run, "key bigint, id bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every end of edges (a, b): the smallest id that it reaches. Stars are contracted until they stay.

    Rounds are written in about a file for FILE_EDGES edges, not one for each partition.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, last = written(e, "edges"), None
    while True:
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == last:
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
        last = n, total
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(redealt(low, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        small = large.join(redealt(low, "u"), "u").select(ends.alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        old, e = e, written(small.coalesce(max(1, -(-2 * n // FILE_EDGES))), "edges")
        forget(old)


def near(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most MOST_DIFFERENT symbols."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(len(b), SYMBOLS) for k in (2, 3))
            yield b.filter(pa.array((x != y).sum(axis=1) <= MOST_DIFFERENT)).select(["a", "b"])

    pairs = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return in_arrow(pairs.select("a", "b", "sig_a", "sig_b"), run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    side = lambda k: sets.select(F.col("id").alias(k), F.col("items").alias(f"items_{k}"))
    return in_arrow(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "items_a", "items_b"), run, "a bigint, b bigint")


def block_of(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks))


def compared(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, id, others): members of a bucket of another component than id's, of near signatures and like sizes.

    rows: key, n (of the bucket), comp, id, sig, size. others are of one block of block_of(). A pair is found under the
    first chunk alone that brings it together. A task streams slices of buckets; it holds one, of 2 * LARGE members at most, about.
    """

    def run(batches):
        slice_, members = None, []

        def found():
            if len(members) < 2:
                return
            comp, ids, size, part, home = (np.array([m[k] for m in members], "i8") for k in (0, 1, 3, 4, 5))
            sig = np.frombuffer(b"".join(m[2] for m in members), "<u2").reshape(len(members), SYMBOLS)
            own = int(np.flatnonzero(chunk_keys(sig[:1])[0].view("i8") == slice_[0])[0])
            chunk, skip = divmod(own, WIDTH)
            within = slice_[1] == slice_[2]
            for at in range(0, len(members), 256):
                i = slice(at, at + 256)
                for to in range(at, len(members), 256):
                    j = slice(to, to + 256)
                    if comp[i].min() == comp[j].max() and comp[i].max() == comp[j].min():
                        continue
                    ok = (comp[i, None] != comp[None, j]) & (4 * np.minimum(size[i, None], size[None, j]) >= 3 * np.maximum(size[i, None], size[None, j]))
                    if not within:
                        ok &= part[i, None] != part[None, j]
                    if at == to:
                        ok = np.triu(ok, 1)
                    x, y = np.nonzero(ok)
                    for k in range(0, len(x), 65536):
                        a, b = at + x[k : k + 65536], to + y[k : k + 65536]
                        by_chunk = (sig[a] != sig[b]).reshape(len(a), CHUNKS, WIDTH).sum(axis=2)
                        keep = (by_chunk.sum(axis=1) <= MOST_DIFFERENT) & ((by_chunk <= 1).argmax(axis=1) == chunk)
                        if skip:
                            keep &= by_chunk[:, chunk] == 1
                        for one, other, block in zip(ids[a[keep]].tolist(), ids[b[keep]].tolist(), home[b[keep]].tolist(), strict=True):
                            near[one, block].append(other)

        def batch():
            cols = ([k[1] for k in near], [k[0] for k in near], list(near.values()))
            near.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], ["block", "id", "others"])

        near: dict = defaultdict(list)
        for b in batches:
            for key, low, high, *m in zip(*(b.column(x).to_pylist() for x in range(9)), strict=True):
                if (key, low, high) != slice_:
                    found()
                    if len(near) >= 20_000:
                        yield batch()
                    slice_, members = (key, low, high), []
                members.append(m)
        found()
        if near:
            yield batch()

    n = F.ceil(F.col("n") / LARGE).cast("int")
    part = F.pmod(F.xxhash64("id"), n).cast("int")
    d = rows.withColumn("part", part).withColumn("to", F.explode(F.sequence(F.lit(0), n - 1)))
    d = d.select("key", F.least("part", "to").alias("low"), F.greatest("part", "to").alias("high"), "comp", "id", "sig", "size", "part", block_of("id", blocks).alias("home"))
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by count: work grows faster than bytes
    d = d.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high", "comp")
    near = in_arrow(d, run, "block bigint, id bigint, others array<bigint>")
    return near.groupBy("block", "id").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))


def confirmed_blocks(near: DataFrame, sets: DataFrame, blocks: int, percent: int) -> DataFrame:
    """The links (a, b) among near (block, id, others). A task holds the full sets of one block, others stream by."""

    def run(batches):
        key, held = None, {}
        for b in batches:
            links: tuple[list, list] = ([], [])
            for block, one, items, others in zip(*(b.column(x).to_pylist() for x in (0, 1, 3, 4)), strict=True):
                if block != key:
                    key, held = block, defaultdict(list)
                mine = np.frombuffer(items, np.uint64)
                if others is None:
                    held[one].append(mine)
                    continue
                ids, lists = zip(*[(y, x) for y in others for x in held[y]], strict=True)
                size = np.fromiter(map(len, lists), "i8", len(lists))
                every = np.concatenate(lists)
                at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
                common = np.add.reduceat(mine[at] == every, np.cumsum(size) - size)
                for k in np.flatnonzero(100 * common >= percent * (len(mine) + size - common)):
                    links[0].append(one)
                    links[1].append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(links[0], pa.int64()), pa.array(links[1], pa.int64())], ["a", "b"])

    some = sets.select(block_of("id", blocks).alias("block"), "id", F.lit(0).alias("kind"), "items", F.lit(None).cast("array<bigint>").alias("others"))
    ask = near.join(sets, "id").select("block", "id", F.lit(1).alias("kind"), "items", "others")
    d = some.unionByName(ask).repartition("block").sortWithinPartitions("block", "kind")
    return in_arrow(d.select("block", "id", "kind", "items", "others"), run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Texts are taken whole; A-Z count as a-z; words are runs without ASCII white space. A text of one to four words
    has its whole sequence as its one shingle. A null or empty text, or one of white space, is linked with nothing
    and is its own component. Rows with the same doc_id are one document with the links of each. A null doc_id has
    no links: component_id null, kept true. An empty table gives no rows; other columns are ignored.

    The signatures' chunks, MOST_DIFFERENT and the sizes compared are made for percent of LEAST_PERCENT and more; less is an error.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent is {percent}; links under {LEAST_PERCENT} percent would be lost")
    d = written(described(docs), "sets")
    some = d.where("doc_id is not null and class is not null")
    classes = written(some.groupBy("class").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "classes")
    copies = some.join(classes.select("class", "id"), "class").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct()
    sigs = classes.select("id", "sig")
    keys = written(filed(sigs), "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    buckets = written(keys.join(shared, "key"), "buckets")
    forget(keys)
    members = buckets.select(F.col("id").alias("doc_id")).distinct()
    sets = written(full_sets(texts(docs).join(members, "doc_id", "left_semi")), "full-sets")
    pairs = buckets.select(F.col("first").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    seen = components(confirmed(near(pairs, sigs), sets, percent).unionByName(copies))
    rows = buckets.select("key", "id", "n").join(seen, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    several = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    rows = rows.join(several, "key", "left_semi").join(classes.select("id", "sig", F.col("n_shingles").alias("size")), "id")
    blocks = max(1, -(-sets.count() // HELD))
    near_ = written(compared(rows, blocks), "near")
    found = confirmed_blocks(near_, sets, blocks, percent)
    first, seen = seen, components(found.unionByName(seen.select(F.col("id").alias("a"), F.col("comp").alias("b"))))
    for read in (classes, buckets, sets, near_, first):  # the result reads d and seen alone
        forget(read)
    out = d.select("doc_id", "n_shingles").join(seen.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with one document of each component, the smallest doc_id, once; rows with a null doc_id all stay.

    Of a doc_id with several texts the one of the least hash stays; rows that agree in doc_id and text are interchangeable.
    """
    found = near_duplicates(docs, percent)
    rows = found.where("doc_id is not null").groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    gone, several = rows.where("not kept").select("doc_id"), rows.where("kept and n > 1").select("doc_id")
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("one__")
    firsts = docs.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(one).select("one__.*")
    return rest.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(firsts)
