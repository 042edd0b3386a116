"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_planning import words_of

from tarn.llm import chat, common, fingerprint, linededup, mixing, neardup, packing, quality, sharding, tokens, toxicity, warc

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
NEAR = LOREM.replace("upsilon", "phi")
DOCS = [
    (1, LOREM, "en", "a"),
    (2, NEAR, "en", "a"),
    (3, LOREM, "de", "b"),
    (4, None, None, None),
    (5, "", "en", "b"),
    (6, " \n\t ", "en", "b"),
    (7, "two words", "fr", None),
    (7, "two words", "fr", None),
    (None, LOREM, "en", "a"),
    (8, "Two  words", "en", "c"),
    (9, "x " * 3000 + "end", "en", "c"),
    (10, "\n".join(["one two three four five six seven eight nine ten eleven"] * 3 + [LOREM]), "en", "c"),
]
EXTRA = ", component_id string, shard string, slot string, position string, score string, n_words string, length string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, *["clash"] * 7) for d in DOCS], "doc_id bigint, text string, lang string, source string" + EXTRA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(1, 11)] + [(3, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_near_duplicates(docs, empty):
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs).collect()), key=str)
    sets = [(i, words_of(t or "")) for i, t, *_ in DOCS]
    comp = {i: i for i, _ in sets if i is not None}
    for i, a in sets * 3:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                comp[i] = comp[j] = min(comp[i], comp[j])
    want = sorted(((i, len(s), comp.get(i), i is None or comp[i] == i) for i, s in sets), key=str)
    assert got == want
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in [*{i for i in comp if comp[i] == i}, None])
    assert neardup.near_duplicates(empty).collect() == []


def test_near_duplicates_refuses_percents_that_lose_links(docs):
    for operator in (neardup.near_duplicates, neardup.without_near_duplicates):
        with pytest.raises(ValueError, match="74"):
            operator(docs, percent=74)


def test_near_duplicates_find_all_links_of_a_query_set(spark):
    """Rows whose id is divisible by 50 against all rows, by brute force: every link is within a component."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    component = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    sets = {r.doc_id: words_of(r.text or "") for r in docs.collect()}
    holders = defaultdict(list)
    for i in (i for i in sets if i % 50 == 0):
        for x in sets[i]:
            holders[x].append(i)
    links = found = 0
    for j, s in sets.items():
        for i, n in Counter(i for x in s for i in holders.get(x, ())).items():
            if i != j and 100 * n >= 75 * (len(s) + len(sets[i]) - n):
                links += 1
                found += component[i] == component[j]
    assert links > 20 and found == links


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LARGE", 4)
    monkeypatch.setattr(neardup, "HELD", 3)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(30):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 5), replace=False):
            w[k] = f"z{rng.integers(1000)}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    sets = [words_of(t) for t in texts]
    comp = list(range(30))
    for _ in range(30):
        for i in range(30):
            for j in range(30):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert got == dict(enumerate(comp))


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, capacity=64).collect()
    e = tokens.encoder(tokens.default_path())
    want = Counter()
    for i, t, *_ in DOCS:
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, p, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for p, at in enumerate(range(0, len(ids), 64)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= -(-sum(r.length for r in rows) // 64) + 2
    assert packing.pack_documents(empty).collect() == []
    one = packing.pieces(docs.where("doc_id = 7"), with_ids=True).collect()
    assert [len(r.ids) for r in one] == [r.length for r in one]


def test_chat(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "system", "be kind"), *[(1, k, "user" if k % 2 else "assistant", f"turn {k} " + "word " * 30) for k in range(1, 9)], (2, 0, "user", odd), (2, 1, "assistant", odd), (3, 0, None, None), (3, 0, "assistant", "a\\n<|"), (3, 0, "assistant", "a\\n<|"), (None, None, "user", "x"), (4, 0, "assistant", "long " * 500)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, window string")
    formatted = chat.windows(df, budget=120, history_tokens=40, history_turns=1)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: 0) if conv != 3 else [("", ""), ("assistant", "a\\n<|"), ("assistant", "a\\n<|")]
        said = "".join(x for r, x in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.loss_chars) == (len(turns), len(said))
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    w = [r for r in formatted.collect() if r.conv_id == 1]
    assert len(w) > 2 and all(chat.parsed(r.text)[0][0] == "system" for r in w)
    assert [chat.parsed(r.text)[1][1][:6] for r in w[1:]] != [] and all(r.repeated >= 1 for r in w[1:])
    assert chat.read_back(chat.windows(df.limit(0))).collect() == []


def test_chat_windows_keep_to_the_budget(spark):
    rng = np.random.default_rng(8)
    odd = ["<|im_end|>", "<|", "\\", "plain words", "é漢", "\n", " "]
    rows = []
    for conv in range(40):
        rows += [(conv, 0, "system", "be kind <|im_start|>")] if conv % 2 else []
        rows += [(conv, k, "assistant" if k % 2 else "user", " ".join(rng.choice(odd, rng.integers(0, 30)))) for k in range(1, int(rng.integers(2, 30)))]
    rows += [(100, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(3000)] + [(101, 0, "user", "long " * 3000), (101, 1, "assistant", "short")]
    rows += [(None, k % 2, "user", f"none {k}") for k in range(5)] * 2
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = chat.windows(df, budget=256, history_tokens=100).collect()
    e = tokens.encoder(tokens.default_path())
    several = 0
    for w in windows:
        own = len(chat.parsed(w.text)) - w.repeated
        several += own > 1
        assert own >= 1 and (own == 1 or len(e.tokenizer.encode(w.text, add_special_tokens=False).ids) <= 256)
    assert several > 50
    got = chat.read_back(chat.windows(df, budget=256, history_tokens=100)).collect()
    assert Counter((r.conv_id, r.n_turns) for r in got) == Counter({**{(c, n): 1 for c, n in Counter(r[0] for r in rows if r[0] is not None).items()}, (None, 1): 10})


def test_warc(spark):
    pages = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\n", None), (None, "u", "same"), (4, "http://d", "é" * 5000), (5, "http://e", ""), (6, "x", "only")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, bundle string")
    folder = common.new_path(spark, "warc-test")
    index = warc.write_bundles(df, folder, frame_bytes=500)
    got = {r.page_id: r for r in warc.read_bundles(index, folder).collect()}
    assert len(got) == len(pages)
    groups = defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    for i, url, html in pages:
        raw = (html or "").encode()
        top = max((x for x in groups[html or ""] if x is not None), default=None)
        r = got[i]
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == top else ("revisit", top))
    for e in index.collect():  # single records, by the index
        head, body = warc.read_record(folder, e)
        assert warc.page_id_of(head["WARC-Record-ID"]) == e.page_id
        if head["WARC-Type"] == "response":
            assert body == (next(h for i, _, h in pages if i == e.page_id) or "").encode()
    assert warc.bundle_and_read(df.limit(0)).collect() == []


def test_warc_attempts_leave_the_index_true(spark):
    html = [f"page {k} " * (k % 50) for k in range(400)] + ["é" * 300_000] * 3
    df = spark.createDataFrame([(k, f"u{k}", h) for k, h in enumerate(html)] + [(7, "u7", html[7])], "page_id bigint, url string, html string")
    folder = common.new_path(spark, "warc-test")
    first, second = (warc.write_bundles(df, folder, frame_bytes=4000) for _ in range(2))  # a second attempt of each task, same folder
    key = lambda r: (r.page_id, r.payload_digest, r.record_type, r.refers_to or -1)
    want = sorted(key(r) for r in warc.read_bundles(first, folder).collect())
    assert len(want) == 404 and want == sorted(key(r) for r in warc.read_bundles(second, folder).collect())
    places = lambda i: sorted((r.bundle.split("-")[1], r.frame, r.frame_at, r.record_at, r.page_id) for r in i.collect())
    assert places(first) == places(second)  # the same bytes under another name
    assert warc.forget_unnamed(second, folder) > 0 == warc.forget_unnamed(second, folder)
    assert want == sorted(key(r) for r in warc.read_bundles(second, folder).collect())
    assert Counter(r.page_id for r in warc.read_bundles(second, folder).collect())[7] == 2


def test_toxicity(spark, docs, empty):
    clean = [(i, "the cat sat on the mat and looked at the quiet sea again number%d" % i, 0) for i in range(100, 220)]
    bad = [(i, "you are such a worthless moron and everyone here knows it number%d" % i, 1) for i in range(300, 380)]
    rows = [*clean, *bad]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (301, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == y and 0 <= got[i].score <= 1
    model = toxicity.learn(d, lab)
    odd = spark.createDataFrame([(1, "what a m0ron you are, w0rthless"), (2, None), (3, ""), (4, "the sea " * 5000)], "doc_id bigint, text string")
    s = {r.doc_id: r.score for r in toxicity.scores(odd, model).collect()}
    assert s[1] >= 0.5 > s[2] == s[3] == s[4]
    none = toxicity.toxicity(docs, lab.limit(0)).collect()
    assert len(none) == len(DOCS) and {r.predicted for r in none} == {0}
    assert toxicity.toxicity(empty, lab).collect() == []
    kept = toxicity.without_toxic(d, lab)
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in clean}


def test_toxicity_holds_out_of_the_sample(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    assert len(rows) > 300 and sum(r.toxic == r.predicted for r in rows) >= 0.98 * len(rows)


def test_line_dedup(spark, docs, empty):
    passage = "this is a long passage of many words that somebody copied from one text to the next without a change at all"
    rows = [(1, f"head one\n{passage}\nshort\ntail"), (2, f"own\nshort\n{passage}\nshort\nend"), (3, "short"), (4, None), (None, passage), (5, f"{passage}\n{passage}"), (6, f"  {passage} \nown words here"), (2, f"own\nshort\n{passage}\nshort\nend")]
    got = linededup.without_shared_lines(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, n_removed string"), least_words=20).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].text == rows[0][1] and by[1].n_removed == 0
    assert by[2].text == "own\nshort\nend" and by[2].n_removed == 2  # the line behind goes with the block
    assert by[3].text == "short" and by[4].text == "" and by[None].text == passage
    assert by[6].text == "own words here"
    assert by[5].n_removed >= 1
    assert linededup.without_shared_lines(empty).collect() == []
    assert linededup.without_shared_lines(docs).count() == len(DOCS)


def test_rare_toxic_terms_are_learned_behind_many_common_ones(spark):
    letters = "abcdefghij"
    common = " ".join("".join(letters[int(c)] for c in f"{k:05d}") + "q" for k in range(30_000))  # and their stems: over 50,000 terms
    rows = [(i, common + (" zzyzxian" if i < 5 else ""), 1) for i in range(7)] + [(100 + i, common, 0) for i in range(120)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.learn(d, lab, folds=1_000_003)
    assert [t.text for t in model.terms] == ["zzyzxian"]


def left(spark, *texts):
    """What line deduplication leaves of texts, the earliest first."""
    rows = linededup.without_shared_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


def passage(name, lines=5, words=11):
    return "\n".join(" ".join(f"{name}{k}x{w}" for w in range(words)) for k in range(lines))


def test_line_dedup_deletes_each_occurrence(spark):
    p = passage("p")
    a = "\n".join([p, passage("own"), p])
    assert left(spark, a, a) == [a, ""]
    assert left(spark, f"{p}\n{p}", f"{p}\n{p}", f"my own\n{p}\nin between\n{p}") == [f"{p}\n{p}", "", "my own\nin between"]
    gapped = p.replace("\n", "\nonly here\n")  # the partner has lines in between
    assert left(spark, f"{gapped}\n{gapped}", f"{p}\nnew\n{p}")[1] == "new"


def test_line_dedup_runs_go_on_behind_blank_lines(spark):
    p = passage("p", lines=6, words=9)
    verse = p.replace("\n", "\n\n \n")
    got = left(spark, f"{verse}\n", f"own\n\n{verse}\n\nend", f"{verse}\n", p, "a\n\nb\n")
    assert got == [f"{verse}\n", "own\n\n\nend", "", "", "a\n\nb\n"]
    docs = spark.createDataFrame([(1, f"{verse}\n"), (2, f"own\n\n{verse}\n\nend")], "doc_id bigint, text string")
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in linededup.without_shared_lines(docs).collect()} == {1: (17, 0), 2: (20, 16)}


def test_line_dedup_deletes_blocks_in_another_order(spark):
    p, q = passage("p"), passage("q")
    assert left(spark, f"{q}\n{p}", f"{p}\n{q}", f"own\n{p}\n{q}\nend") == [f"{q}\n{p}", "", "own\nend"]
    one, two = passage("p", 2, 6), passage("q", 2, 6)  # only together, as the second document has them, they are long enough
    assert left(spark, f"{two}\nbetween\n{one}", f"mine\n{one}\n{two}", f"own\n{one}\n{two}\nend") == [f"{two}\nbetween\n{one}", f"mine\n{one}\n{two}", "own\nend"]


def test_line_dedup_deletes_what_brute_force_finds(spark):
    rng = np.random.default_rng(11)
    pool = [" ".join(f"l{k}w{w}" for w in range(rng.integers(1, 9))) for k in range(14)]
    texts = [[pool[k] for k in rng.integers(0, 14, rng.integers(1, 25))] for _ in range(40)]
    got = left(spark, *["\n".join(x) for x in texts])
    for i, t in enumerate(texts):
        held = {tuple(x[s:e]) for x in texts[:i] for s in range(len(x)) for e in range(s + 1, len(x) + 1)}
        gone = {x for s in range(len(t)) for e in range(s + 1, len(t) + 1) if tuple(t[s:e]) in held and sum(len(y.split()) for y in t[s:e]) >= 20 for x in range(s, e)}
        stay = iter(t)
        assert all(line in stay for line in got[i].split("\n") if line)  # lines go, the rest stays in order
        kept, whole = Counter(got[i].split("\n")), Counter(t)
        assert all(whole[x] - kept[x] >= n for x, n in Counter(t[x] for x in gone).items())


def test_line_dedup_judges_each_pair(spark):
    block = [" ".join(f"b{k}x{w}" for w in range(8)) for k in range(4)]
    scattered = ["\n".join(["one a", block[0], "one b", block[2]]), "\n".join(["two a", block[3], "two b", block[1]])]
    holder, later = "\n".join(["five", *block]), "\n".join(["nine", *block, "nine end"])
    assert left(spark, *scattered, holder, later) == [*scattered, holder, "nine\nnine end"]
    singles = [f"own {k}\n{x}\nmore {k}" for k, x in enumerate(block)]
    mosaic = "\n".join(block)  # of four documents, none of which has two of its lines
    assert left(spark, *singles, mosaic) == [*singles, mosaic]
    assert left(spark, *singles, mosaic, f"x\n{mosaic}") == [*singles, mosaic, "x"]


def test_line_dedup_is_between_brute_forces(spark):
    """All that is unbroken in some earlier document goes; nothing goes that no earlier document has in order."""
    rng = np.random.default_rng(12)
    pool = [" ".join(f"m{k}w{w}" for w in range(rng.integers(2, 10))) for k in range(25)]
    texts = []
    for k in range(60):
        t = [pool[x] if rng.random() < 0.7 else f"line {k} {x} of its own" for x in rng.integers(0, 25, rng.integers(1, 18))]
        for _ in range(rng.integers(0, 3) if texts else 0):  # a block of an earlier one, whole or with a line put in between
            old = texts[rng.integers(len(texts))]
            s = rng.integers(len(old))
            t += old[s : s + 5] if rng.random() < 0.7 else [*old[s : s + 2], "between", *old[s + 2 : s + 5]]
        texts.append(t)
    got = left(spark, *["\n".join(x) for x in texts])

    def subsequence(run, text):
        rest = iter(text)
        return all(line in rest for line in run)

    for i, t in enumerate(texts):
        least, most = set(), set()
        for s in range(len(t)):
            for e in range(s + 1, len(t) + 1):
                if sum(len(x.split()) for x in t[s:e]) >= 20 and any(subsequence(t[s:e], x) for x in texts[:i]):
                    most |= set(range(s, e))
                    if any(t[s:e] == x[k : k + e - s] for x in texts[:i] for k in range(len(x))):
                        least |= set(range(s, e))
        kept, whole = Counter(x for x in got[i].split("\n") if x), Counter(t)
        gone = whole - kept
        assert not kept - whole
        assert all(gone[x] >= n for x, n in Counter(t[k] for k in least).items()), i
        assert not gone - Counter(t[k] for k in most), i


def test_mixing(spark, docs, empty):
    got = mixing.mixed(docs, block_rows=2).collect()
    assert sorted(r.position for r in got) == list(range(len(DOCS)))
    assert Counter(r.source_key for r in got) == Counter(s or "" for *_, s in DOCS)
    big = spark.createDataFrame([(i, "s" + str(min(i % 7, 3))) for i in range(700)], "doc_id bigint, source string")
    rows = sorted(mixing.mixed(big, {"s0": 1.0, "s1": 2.0, "s2": 3.0, "s3": 4.0}, block_rows=5).collect(), key=lambda r: r.position)
    ends = min(next(k for k in range(len(rows), 0, -1) if rows[k - 1].source == s) for s in ("s0", "s1", "s2", "s3"))
    had = Counter()
    for k, r in enumerate(rows[:ends]):
        had[r.source] += 1
        if (k + 1) % 5 == 0:
            for s, w in (("s0", 0.1), ("s1", 0.2), ("s2", 0.3), ("s3", 0.4)):
                assert abs(had[s] / 5 - w * (k + 1) / 5) < 1
    by_row = sorted(mixing.mixed(big).collect(), key=lambda r: r.position)  # blocks of one row
    share = {s: n**0.7 / sum(x**0.7 for x in Counter(r.source for r in rows).values()) for s, n in Counter(r.source for r in rows).items()}
    had = Counter()
    for k, r in enumerate(by_row[:600], 1):
        had[r.source] += 1
        assert r.slot == r.position == k - 1 and (max(had.values()) >= 100 or all(abs(had[s] - w * k) < 1 for s, w in share.items()))
    assert mixing.mixed(empty).collect() == []
    joined = mixing.mixed(docs, blocks=3).collect()
    assert sorted(r.position for r in joined) == list(range(len(DOCS)))
    kept = mixing.in_mixed_order(docs)
    assert kept.columns == docs.columns and kept.count() == len(DOCS)
    odd = ['a"\\b', "line\nbreak", "é😀\u2028", "", None, "  "]
    rows = mixing.mixed(spark.createDataFrame([(k, odd[k % 6]) for k in range(60)], "doc_id bigint, source string")).collect()
    assert Counter(r.source for r in rows) == Counter(odd * 10) and sorted(r.position for r in rows) == list(range(60))
    plan = mixing.mixed(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Python" not in plan and "Arrow" not in plan


def base_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, empty, labels):
    more = ["a|b # c\n\n$ %", "one two three one two three one", "w " * 60, " ".join(f"v{k}" for k in range(80)), "é 1\x0b2\x0c3\r4"]
    d = docs.unionByName(spark.createDataFrame([(100 + k, t, "en", "a", *["x"] * 7) for k, t in enumerate(more)], docs.schema))
    got = quality.quality(d, labels).collect()
    rows = [(i, t) for i, t, *_ in DOCS] + [(100 + k, t) for k, t in enumerate(more)]
    counts = lambda r: (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    assert Counter(counts(r) for r in got) == Counter((i, *base_counts(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.ratio_sum >= -250_000 * r.n_ngrams)
    assert quality.quality(empty, labels).collect() == []
    assert {r.ratio_sum for r in quality.quality(docs, labels.limit(0)).collect()} == {0}


def test_quality_ratio_is_brute_forces(spark):
    import xxhash

    texts = ["the cat sat", "the dog!! ran!!", "cat cat", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lab = spark.createDataFrame([(0, 1), (2, 1)], "doc_id bigint, quality int")
    grams = []
    for t in texts:
        w = re.findall(r"[^\W]+|[^\w\s]+", t)
        h1 = [xxhash.xxh64_intdigest(x, seed=42) for x in w]
        h2 = [xxhash.xxh64_intdigest(y, seed=xxhash.xxh64_intdigest(x, seed=42)) for x, y in zip(w, w[1:], strict=False)]
        grams.append([(1, x % 65536) for x in h1] + [(2, x % 65536) for x in h2])
    raw, good = Counter(g for x in grams for g in x), Counter(g for k in (0, 2) for g in grams[k])
    n, m = (Counter() for _ in range(2))
    for g, c in raw.items():
        n[g[0]] += c
        m[g[0]] += good[g]
    ratio = {g: round(np.log((good[g] + 1000 * c / n[g[0]]) / (m[g[0]] + 1000) / (c / n[g[0]])) * 1e6) for g, c in raw.items()}
    got = {r.doc_id: (r.n_ngrams, r.ratio_sum) for r in quality.quality(d, lab).collect()}
    assert got == {k: (len(x), sum(ratio[g] for g in x)) for k, x in enumerate(grams)}


def test_sharding(spark, docs, empty, tmp_path):
    got = sharding.sharded(docs, shards=5).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(DOCS) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(5))
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t, *_ in DOCS)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sharding.sharded(empty).collect() == [] and len(sharding.sharded(docs, shards=40).collect()) == len(DOCS)
    sharding.write_shards(docs, str(tmp_path / "shards"), shards=3, files=1)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(r.doc_id for r in back.collect()) == Counter(i for i, *_ in DOCS)


def test_hilbert_is_the_published_transform(spark):
    rng = np.random.default_rng(4)
    points = [tuple(map(int, p)) for p in [*rng.integers(0, 1024, (300, 3)), (0, 0, 0), (1023, 1023, 1023)]]
    d = spark.createDataFrame(points, "a bigint, b bigint, c bigint")
    got = d.select("a", "b", "c", sharding.hilbert([d.a, d.b, d.c], 10).alias("at")).collect()
    assert all(r.at == sharding.hilbert_index((r.a, r.b, r.c), 10) for r in got)


def test_sharding_follows_the_curve(spark):
    rng = np.random.default_rng(6)
    langs = [None, "de", "en"]
    rows = [(int(i), "w" * int(rng.integers(0, 60)), langs[rng.integers(3)], f"s{rng.integers(30):02d}") for i in rng.integers(0, 60, 200)]
    rows += rows[:5]  # ties
    got = sorted(sharding.sharded(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), shards=7).collect(), key=lambda r: (r.shard, r.slot))
    spread = lambda values: {v: k * 1024 // len(values) for k, v in enumerate(sorted(values, key=lambda v: (v is not None, v)))}
    source, lang = spread({s for *_, s in rows}), spread(set(langs))
    place = defaultdict(lambda: 1 << 30)
    for _, t, g, s in rows:
        cell = source[s], lang[g], int(np.floor(np.log2(len(t) + 16) * 32))
        place[t] = min(place[t], sharding.hilbert_index(cell, 10))
    assert [place["w" * (r.size - 16)] for r in got] == sorted(place[t] for _, t, *_ in rows)
    runs = [(r.size, r.text_crc32) for k, r in enumerate(got) if not k or got[k - 1].text_crc32 != r.text_crc32]
    assert len(runs) == len(set(runs))  # equal texts are neighbours, whatever their source
    for k, r in enumerate(got[1:], 1):
        assert got[k - 1].text_crc32 != r.text_crc32 or got[k - 1].doc_id <= r.doc_id


def test_fingerprints(spark, docs, empty):
    got = fingerprint.edit_sensitivity(docs).collect()
    order = sorted({(i, t or "") for i, t, *_ in DOCS}, key=lambda d: (d[0] is not None, d[0] or 0))
    following = {d: order[(k + 1) % len(order)][1] for k, d in enumerate(order)}
    sha = Counter()
    for i, t, *_ in DOCS:
        t = t or ""
        n = len(t) // 2
        sha[i, len(t), hashlib.sha256((t[: len(t) - n] + following[i, t][:n]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sha
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[3].fingerprint == by[None].fingerprint != by[2].fingerprint
    assert by[4].fingerprint == "" and by[4].near_edited == 1.0 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert by[1].near_next > 0.5 > by[9].near_next and by[9].near_edited > 0
    assert fingerprint.edit_sensitivity(empty).collect() == []
    plain = fingerprint.fingerprinted(docs).collect()
    assert {(r.doc_id, r.fingerprint) for r in plain} == {(r.doc_id, r.fingerprint) for r in got}


def test_fingerprint_follows_order(spark):
    words = [f"word{k}" for k in range(300)]
    swapped = words[150:] + words[:150]
    shuffled = sorted(words)
    d = spark.createDataFrame([(" ".join(words), " ".join(words[:-5]), " ".join(swapped), " ".join(shuffled[::-1]))], "a string, b string, c string, d string")
    d = d.select(*[fingerprint.fingerprint(d[c]).alias(c) for c in "abcd"])
    near = d.select(*[fingerprint.likeness("a", c).alias(c) for c in "abcd"]).first()
    assert near.a == 1.0 > near.b > near.c > near.d


def brute_fingerprint(text):
    """Order MinHash of a long text in plain Python."""
    import xxhash

    m64 = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hash_int = lambda v, seed: xxhash.xxh64_intdigest((v & m64).to_bytes(8, "little"), seed=seed)
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    w = [y for x in w for y in (re.findall(r"\S{0,5}?[aeiouAEIOU0-9\x80-\U0010ffff]|\S{1,6}", x) if len(x) > 12 else [x])]
    packed = []
    for i, x in enumerate(w):
        h = xxhash.xxh64_intdigest(x, seed=42)
        if i + 1 < len(w):
            h = xxhash.xxh64_intdigest(w[i + 1], seed=h)
        packed.append(((h & ~fingerprint.PLACE) & m64) | i)
    packed = sorted(signed(x) for x in packed)
    seen, values = Counter(), []
    for x in packed:
        high, place = x >> fingerprint.PLACE_BITS, x & fingerprint.PLACE
        h = hash_int(high, 42)
        h = xxhash.xxh64_intdigest(seen[high].to_bytes(4, "little"), seed=h)
        seen[high] += 1
        values.append(signed(((h & ~fingerprint.PLACE) & m64) | place))
    buckets = defaultdict(list)
    for v in sorted(values):
        if len(buckets[v >> 58]) < fingerprint.TUPLE:
            buckets[v >> 58].append(v)
    out = ["0" * 8] * fingerprint.BUCKETS
    for b, vs in buckets.items():
        h = 42
        for v in sorted(vs, key=lambda v: v & fingerprint.PLACE):
            h = hash_int(v >> fingerprint.PLACE_BITS, h)
        out[b + fingerprint.BUCKETS // 2] = f"{max(1, h & 0xFFFFFFFF):08X}"
    return "".join(out)


def test_fingerprint_is_brute_forces(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, k, 400)) for k in (5, 50, 5000)]
    texts += ["one", "two words", "short short\ttext\n short text", "".join(map(chr, rng.integers(33, 127, 90))) + " é漢字xxxxxxxxxxxxxxxxé", "abcdefghijkl abcdefghijklm"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in d.select(fingerprint.fingerprint(d.text)).collect()]
    assert got == [brute_fingerprint(t) for t in texts]


def test_likeness_does_not_depend_on_lengths(spark):
    rng = np.random.default_rng(9)
    long = " ".join(f"w{x}" for x in rng.integers(0, 5000, 100))
    unbroken = "".join(map(chr, rng.integers(0x4E00, 0x9000, 400))) + "\U0001f600"
    cut = unbroken[:200] + "x" + unbroken[201:]
    rows = [(long[:257], long[:255]), (long[:400], long[:200]), (unbroken, cut), (unbroken[:257], unbroken[:255]), ("two words", "two  words"), (long[:300], unbroken), ("", "")]
    d = spark.createDataFrame(rows, "a string, b string").select(*[fingerprint.fingerprint(F.col(c)).alias(c) for c in "ab"])
    near = [r[0] for r in d.select(fingerprint.likeness("a", "b")).collect()]
    assert min(near[0], near[2], near[3]) > 0.8 and min(near[1], near[4]) > 0.4 and near[5] < 0.3 and near[6] == 1.0
    docs = spark.createDataFrame([(1, long[:300]), (2, long[300:360]), (3, "end")], "doc_id bigint, text string")
    assert {r.doc_id: r.near_edited for r in fingerprint.edit_sensitivity(docs).collect()}[1] > 0.3
