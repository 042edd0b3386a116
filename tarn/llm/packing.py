"""Best-fit packing by patterns: non-negative least squares over a histogram of lengths.

Only numbers that the sequence length bounds reach the driver: how many pieces have each length. The plan says
how many sequences of each content there are; pieces find their place by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import in_arrow, ranked, texts, written
from tarn.llm.tokens import default_path, encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
ORDER = "file__ string, row__ bigint"


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False, order: tuple[Column, Column] | None = None) -> DataFrame:
    """A row per piece of every text: its token ids and then end_id, cut into runs of capacity.

    A null or empty text is one piece of one id. Repeated rows stay repeated. Null doc_ids are kept.
    with_ids adds the ids themselves (array<int>). order, a string and a whole number, is what pack() is to follow.
    """
    path = tokenizer or default_path()
    schema = f"{PIECES}, {ORDER}" + (", ids array<int>" if with_ids else "")
    file, row = order or (F.lit(""), F.lit(0))

    def run(batches):
        enc = encoder(path)
        tail = np.asarray([end_id], "<u4").tobytes()
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc_id, raw, *places in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw += tail
                for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    values = (doc_id, p, at // 4, len(part) // 4, zlib.crc32(part), *places)
                    for c, v in zip(cols, (*values, np.frombuffer(part, "<u4").astype("i4")) if with_ids else values, strict=True):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names)

    return in_arrow(texts(docs, file.cast("string").alias("file__"), row.cast("bigint").alias("row__")), run, schema)


def patterns(lengths: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Contents of one to four pieces that fill a sequence, or nearly: the largest length that fits comes last."""
    have = sorted(int(x) for x in lengths)
    floor = lambda room: have[k - 1] if (k := bisect_left(have, room + 1)) else 0
    found = {(x,) for x in have}
    coarse = have[:: max(1, len(have) // 48)]
    for a in have:
        if b := floor(capacity - a):
            found.add(tuple(sorted((a, b), reverse=True)))
        for b in coarse:
            if a + b < capacity and (c := floor(capacity - a - b)):
                found.add(tuple(sorted((a, b, c), reverse=True)))
    few = have[:: max(1, len(have) // 16)]
    for a in coarse:
        for b in few:
            for c in few:
                if a + b + c < capacity and (d := floor(capacity - a - b - c)):
                    found.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(found, reverse=True)


def nnls(found: list[tuple[int, ...]], counts: dict[int, int], capacity: int, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns with least squares |Ax - counts|^2 + a small price on unfilled room.

    Accelerated projected gradient; A has at most four entries a column, so a step costs a pass over the patterns.
    """
    row = {n: k for k, n in enumerate(sorted(counts))}
    r = np.array([row[n] for p in found for n in p])
    c = np.repeat(np.arange(len(found)), [len(p) for p in found])
    h = np.array([counts[n] for n in sorted(counts)], float)
    scale = max(1.0, h.max(initial=1.0))
    h = h / scale
    room = np.array([1 - sum(p) / capacity for p in found])
    price = 0.02 * h.mean() * room
    norm = np.ones(len(found))
    for _ in range(30):  # the largest singular value
        y = np.bincount(r, norm[c], len(h))
        z = np.bincount(c, y[r], len(found))
        top = np.linalg.norm(z)
        norm = z / top
    x = prev = np.zeros(len(found))
    t = 1.0
    for _ in range(steps):
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = x + (t - 1) / t2 * (x - prev)
        miss = np.bincount(r, v[c], len(h)) - h
        prev, x, t = x, np.maximum(0, v - (np.bincount(c, miss[r], len(found)) + price) / (1.05 * top)), t2
    return x * scale


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, pieces)...]) for every piece of counts: rounded patterns, then best fit for the rest."""
    counts = {int(n): int(k) for n, k in counts.items() if k}
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    if full := counts.pop(capacity, 0):
        groups.append((full, [(capacity, 1)]))
    if counts:
        found = patterns(np.array(sorted(counts)), capacity)
        x = nnls(found, counts, capacity)
        left = dict(counts)
        for k in sorted(range(len(found)), key=lambda k: (capacity - sum(found[k]), -x[k])):
            need: dict[int, int] = defaultdict(int)
            for n in found[k]:
                need[n] += 1
            if sum(found[k]) < 0.998 * capacity:  # not full enough to be final: the rest does better
                continue
            if (times := min(int(x[k] + 0.5), *(left[n] // m for n, m in need.items()))) > 0:
                groups.append((times, sorted(need.items(), reverse=True)))
                for n, m in need.items():
                    left[n] -= times * m
        groups += best_fit(left, capacity)
    return groups


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, on counts: equal sequences are handled together."""
    open_: dict[int, list[tuple[int, list]]] = defaultdict(list)  # room -> (sequences, content)
    rooms: list[int] = []

    def put(room: int, n: int, content: list) -> None:
        if n:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((n, content))

    for length in sorted((n for n, k in counts.items() if k), reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                n, rest = divmod(left, each)
                put(capacity - each * length, n, [(length, each)])
                if rest:
                    put(capacity - rest * length, 1, [(length, rest)])
                break
            room = rooms[k]
            n, content = open_[room].pop()
            if not open_[room]:
                rooms.pop(k)
            each = room // length
            m = min(n, left // each)
            put(room, n - m - (m < n and 0 < left - m * each < each), content)
            put(room - each * length, m, [*content, (length, each)])
            left -= m * each
            if m < n and 0 < left < each:
                put(room - left * length, 1, [*content, (length, left)])
                left = 0
    return [g for room in rooms for g in open_[room]]


def places(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs in order of rank: first rank, pieces of it in a sequence, group, its sequences, first offset."""
    runs: dict[int, list] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    for group, (n, content) in enumerate(groups):
        at = 0
        for length, each in content:
            runs[length].append((rank[length], each, group, n, at))
            rank[length] += n * each
            at += length * each
    return {k: tuple(np.array(v, "i8").T) for k, v in runs.items()}


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """parts (of pieces(), each of at most capacity) with sequence_id and offset; every piece once, sequences without gaps.

    Equal lengths are interchangeable to the plan: they are placed in the order given to pieces(), then by doc_id.
    A content's sequences have ids spread evenly over all ids, so ids ascend, about, with that order. parts is
    read several times: pass a table. An empty one gives no rows. Rows that agree in doc_id, piece and ids are
    interchangeable: which gets which place is open, everything else is deterministic.
    """
    parts = ranked(parts, ["length"], ["file__", "row__", "doc_id", "piece", "ids_crc32"], "ranked-pieces")
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most capacity rows
    found = parts.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    schema = PIECES + ", sequence_id bigint, offset bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(k)) for k in ("length", "rank__"))
            seq, at = np.zeros(len(rank), "i8"), np.zeros(len(rank), "i8")
            for n in np.unique(length):
                here = np.flatnonzero(length == n)
                first, each, group, size, offset = found.value[int(n)]
                k = np.searchsorted(first, rank[here], "right") - 1
                q, j = np.divmod(rank[here] - first[k], each[k])
                share = np.fromiter((((2 * x + 1) << 35) // m for x, m in zip(q.tolist(), size[k].tolist(), strict=True)), "i8", len(q))
                seq[here], at[here] = (share << 24) + group[k], offset[k] + j * n
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names[:5]), pa.array(seq), pa.array(at)], names)

    return in_arrow(parts.select(*names[:5], "rank__"), run, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, order: tuple[Column, Column] | None = None) -> DataFrame:
    """All texts of docs as placed pieces."""
    return pack(written(pieces(docs, capacity, tokenizer, end_id, order=order), "pieces"), capacity)
