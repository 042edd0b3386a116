"""Line deduplication by pairwise alignment.

A line that several documents share names the first of them as partner of each other one, so a rare line, of two
documents, names their pair, and pairs grow with the lines however common a line is. A later document's shared lines are
aligned with those of each partner by patience: lines that it has once are anchors, the longest sequence of them that is
ascending in both is kept, and lines beside an aligned one that continue the match join it. Then all occurrences of the
lines in both documents are taken, and each run whose lines follow one another in the partner in the same order is
aligned too, wherever it stands there and however often it is repeated. Runs are judged pair by pair: those of a pair's
aligned lines with enough words are deleted from the later document; short lines that many documents share by chance
stay, also where lines of several partners happen to stand side by side.

A common line's first holder may not be the document that a block comes from, so blocks are shared as such too: each line
begins and ends a shortest block with enough words, whose hash follows from its lines alone. A block that any earlier
document has is deleted, whoever holds its lines first: unbroken blocks are found exactly, without pairs. So there are
three rows a line at most.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import WORD_BREAK, in_arrow, let, redealt, written

KEY = "doc_id bigint, same bigint"
LINE = {"doc_id": pa.int64(), "same": pa.int64(), "h": pa.int64(), "g": pa.int32(), "words": pa.int32(), "span": pa.int32(), "places": pa.list_(pa.int32())}


def keyed(docs: DataFrame) -> DataFrame:
    """docs with text__ (null: empty), and same__, which tells texts of one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("text__", text).withColumn("same__", F.xxhash64(text))


def blocks(words: list[int], least_words: int) -> set[tuple[int, int]]:
    """(start, end) of the shortest blocks of several lines with least_words that begin or end at each line, if any."""
    found, start, total = set(), 0, 0
    for end, n in enumerate(words, 1):
        total += n
        while total >= least_words:  # the first end at which a block from start has enough
            found.add((start, end))
            total -= words[start]
            start += 1
        if start and total + words[start - 1] >= least_words:  # the last start for a block to end here
            found.add((start - 1, end))
    return {(x, y) for x, y in found if y - x > 1}


def lines(docs: DataFrame, least_words: int) -> DataFrame:
    """doc_id, same, two hashes, words, span and places of every different line with a word, and block, of a document with a doc_id.

    A line's span is 1, a block's its number of lines. Places are numbered over the lines with words, so blank lines
    between two lines don't part them.
    """
    d = keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).where("doc_id is not null")
    bare = F.transform(F.split("text__", "\n"), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    every = F.transform(bare, lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), F.when(x == "", 0).otherwise(F.size(F.split(x, WORD_BREAK))).alias("words")))

    def run(batches):
        for b in batches:
            ids, same, every = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            ends = every.offsets.to_pylist()
            every = every.values
            h, g, words = (every.field(k).to_pylist() for k in range(3))
            out = []
            for k, doc_id in enumerate(ids):
                own: dict = {}
                mine = [(h[x], g[x], words[x], 1) for x in range(ends[k], ends[k + 1]) if words[x]]
                for place, line in enumerate(mine):
                    own.setdefault(line, []).append(place)
                raw = b"".join(struct.pack("<qi", *line[:2]) for line in mine)
                for start, end in sorted(blocks([line[2] for line in mine], least_words)):
                    part = raw[12 * start : 12 * end]
                    hashes = struct.unpack("<qi", struct.pack("<QI", xxhash.xxh64_intdigest(part), xxhash.xxh32_intdigest(part)))
                    own.setdefault((*hashes, sum(line[2] for line in mine[start:end]), end - start), []).append(start)
                out += [(doc_id, same[k], *line, places) for line, places in own.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), LINE.values(), strict=True)], list(LINE))

    return in_arrow(d.select("doc_id", F.col("same__").alias("same"), every.alias("every")), run, f"{KEY}, h bigint, g int, words int, span int, places array<int>")


def ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of pairs (sorted by their first) that ascends in the second, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[pile], at[pile] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(pairs: list[tuple[int, int]]) -> set[int]:
    """First members of pairs (place here, place there) that a patience alignment matches."""
    pairs = sorted(pairs)
    here, there = Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
    kept = ascending([p for p in pairs if here[p[0]] == 1 and there[p[1]] == 1]) or ascending(pairs)[:1]
    matches, every, found = dict(kept), set(pairs), []
    spots = sorted(matches)
    for step in (1, -1):  # on from each match, as far as the next one
        for x in spots if step == 1 else reversed(spots):
            y = matches[x]
            while (x + step, y + step) in every and x + step not in matches:
                x, y = x + step, y + step
                matches[x] = y
                found.append(x)
    return set(matches)


def runs(hit: set[int], at: dict, least_words: int) -> set[int]:
    """The places of hit in runs of neighbours with least_words; at has words and places there by place here."""
    found, run, words = set(), [], 0
    for x in sorted(hit):
        if run and x != run[-1] + 1:
            run, words = [], 0
        run.append(x)
        words += at[x][0]
        if words >= least_words:
            found.update(run)
            run = run[-1:]  # the rest is in found; the run goes on
    return found


def in_order(at: dict, least_words: int) -> set[int]:
    """Places of runs of least_words and more whose lines stand in the partner in the same order.

    at has words and all (ascending) places in the partner of each shared line by its place here. Lines of a run
    follow one another here. Each place looks for words on both sides, and back from the end of any run that holds it,
    a walk that has enough covers it; a walk ends with enough words, so work grows with the lines.
    """
    found: set[int] = set()
    for x in at:
        for step in (1, -1):
            y, words, last = x, 0, None
            while words < least_words and y in at:
                n, there = at[y]
                if last is None:
                    last = there[0] if step == 1 else there[-1]
                else:
                    k = bisect_right(there, last) if step == 1 else bisect_left(there, last) - 1
                    if not 0 <= k < len(there):
                        break
                    last = there[k]
                words += n
                y += step
            if words >= least_words:
                found.update(range(x, y, step))
    return found


def deleted(mine: list, least_words: int) -> set[int]:
    """Places to delete of a document with shared lines and blocks (words, span, places, partner..., places there)."""
    pairs: dict = defaultdict(dict)
    for n, span, places, a, a_same, there in mine:
        if span == 1:
            pairs[a, a_same].update((x, (n, there)) for x in places)
    gone: set[int] = set()
    for at in pairs.values():
        if sum(n for n, _ in at.values()) >= least_words:
            hit = aligned([(x, there[0]) for x, (_, there) in at.items()])
            gone |= runs(hit, at, least_words) | in_order(at, least_words)
    gone.update(y for _, span, places, *_ in mine if span > 1 for x in places for y in range(x, x + span))
    return gone


def deletions(all_lines: DataFrame, least_words: int) -> DataFrame:
    """doc_id, same and places: the lines with words to delete from each later document."""
    first = F.min(F.struct("doc_id", "same", "places")).alias("first")
    last = F.max(F.struct("doc_id", "same")).alias("last")
    shared = all_lines.groupBy("h", "g").agg(first, last).where("first.doc_id <> last.doc_id or first.same <> last.same")
    shared = shared.select("h", "g", F.col("first.doc_id").alias("a"), F.col("first.same").alias("a_same"), F.col("first.places").alias("a_places"))
    rows = all_lines.join(redealt(shared, "h", "g"), ["h", "g"]).where("a <> doc_id or a_same <> same").select("doc_id", "same", "words", "span", "places", "a", "a_same", "a_places")

    def run(batches):
        key, mine, out = None, [], []

        def close():
            if gone := deleted(mine, least_words):
                out.append((*key, sorted(gone)))

        def batch():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))], ["doc_id", "same", "places"])

        for b in batches:
            for doc_id, same, *rest in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                if (doc_id, same) != key:
                    if key:
                        close()
                    key, mine = (doc_id, same), []
                mine.append(rest)
            if len(out) >= 5000:
                yield batch()
        if key:
            close()
        if out:
            yield batch()

    return in_arrow(rows.repartition("doc_id", "same").sortWithinPartitions("doc_id", "same"), run, f"{KEY}, places array<int>")


def without_shared_lines(docs: DataFrame, least_words: int = 20) -> DataFrame:
    """docs with new texts and the columns n_lines and n_removed (bigint).

    Of aligned lines, runs of at least least_words words are deleted from the later document: the larger doc_id,
    or, of one doc_id with several texts, the larger hash of the text. Lines are compared without white space around
    them; blank lines neither end a run nor count for it, and go with a run that they are inside of. Rows that agree in
    doc_id and text are one document, so they lose the same lines and not each other's. Rows with a null doc_id stay as
    they are; a null text becomes empty. All other columns stay; n_lines and n_removed are replaced. A document all of
    whose lines go has an empty text.
    """
    found = written(lines(docs, least_words), "lines")
    gone = deletions(found, least_words).withColumnRenamed("doc_id", "doc_id__").withColumnRenamed("same", "same___")
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    d = keyed(docs.select(*own)).join(gone, (F.col("doc_id") == F.col("doc_id__")) & (F.col("same__") == F.col("same___")), "left")
    d = d.withColumn("l__", F.split("text__", "\n"))
    with_words = F.filter(F.sequence(F.lit(0), F.size("l__") - 1), lambda i: F.get("l__", i).rlike(r"[^\x20\x09-\x0D]"))
    inside = lambda at, x, k: F.when(F.get("places", k + 1) == x + 1, F.sequence(F.get(at, x), F.get(at, x + 1) - 1)).otherwise(F.array(F.get(at, x)))
    gone = let(with_words, lambda at: F.flatten(F.transform("places", lambda x, k: inside(at, x, k))))
    d = d.withColumn("gone__", F.when(F.col("places").isNotNull(), gone))
    d = d.withColumn("n_lines", F.when(F.col("text__") == "", 0).otherwise(F.size("l__")).cast("bigint")).withColumn("n_removed", F.coalesce(F.size("gone__"), F.lit(0)).cast("bigint"))
    d = d.withColumn("stay__", F.when(F.col("places").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("l__") - 1), F.col("gone__"))))
    text = F.when(F.col("places").isNull(), F.col("text__")).otherwise(F.array_join(F.transform("stay__", lambda i: F.get("l__", i)), "\n"))
    return d.withColumn("text", text).select(*own, "n_lines", "n_removed")
