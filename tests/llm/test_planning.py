"""Parts that need no Spark: packing plans, schedules, the curve, alignment, automata, escapes, bundles."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import chat, linededup, mixing, neardup, packing, sharding, tokens, toxicity, warc


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=12))
def test_plan_packs_every_piece_once(counts):
    groups = packing.plan(counts, 64)
    used = Counter()
    for n, content in groups:
        assert n > 0 and sum(a * b for a, b in content) <= 64
        for length, each in content:
            used[length] += n * each
    assert used == Counter({k: v for k, v in counts.items() if v})


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    counts = Counter(np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1).tolist())
    least = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert sum(n for n, _ in packing.plan(counts, 2048)) <= least * 1.005 + 2


def test_nnls_repeats_exact_patterns():
    found = packing.patterns(np.array([600, 1448]), 2048)
    x = dict(zip(found, packing.nnls(found, {600: 50, 1448: 50}, 2048), strict=True))
    assert x[(1448, 600)] == pytest.approx(50, rel=0.05)


def brute_schedule(blocks, weights):
    """Slot by slot, looking at every source: (source, block), until the first source ends."""
    total = sum(Fraction(w) for w in weights.values())
    share = {s: Fraction(w) / total for s, w in weights.items()}
    had, out = dict.fromkeys(weights, 0), []
    while all(had[s] < n for s, n in blocks.items()):
        t = len(out)
        due = {s: ((had[s] + 1) / share[s], str(s)) for s in weights if math.floor(had[s] / share[s]) <= t}
        s = min(due, key=due.get)
        assert math.ceil(due[s][0]) > t  # in time
        out.append((s, had[s]))
        had[s] += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.tuples(st.integers(1, 60), st.one_of(st.integers(1, 60), st.floats(1e-4, 1e3))), min_size=1, max_size=7))
def test_schedule_is_fair(sources):
    blocks, weights = {s: n for s, (n, _) in sources.items()}, {s: w for s, (_, w) in sources.items()}
    got = mixing.schedule(blocks, weights)
    want = brute_schedule(blocks, weights)
    assert got[: len(want)] == want
    assert Counter(s for s, _ in got) == blocks and all([b for x, b in got if x == s] == list(range(n)) for s, n in blocks.items())
    share = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
    had = Counter()
    for t, (s, _) in enumerate(want, 1):
        had[s] += 1
        assert all(abs(had[s] - share[s] * t) < 1 for s in blocks)


def test_long_schedules_keep_to_uneven_weights():
    weights = {f"s{k}": w for k, w in enumerate((0.50017, 0.00017, 0.29979, 0.1, 0.03333, 0.06654))}
    share = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
    had = Counter()
    for t, (s, _) in enumerate(mixing.schedule(dict.fromkeys(weights, 8000), weights)[:12_000], 1):
        had[s] += 1
        assert all(abs(had[s] - share[s] * t) < 1 for s in weights)


def test_sources_that_end_leave_their_slots_to_the_rest():
    blocks = {"a": 1000, "b": 7, "c": 500, "": 31}
    weights = {"a": 1.0, "b": 1.0, "c": 5.0, "": 0.1}
    got = mixing.schedule(blocks, weights)
    assert Counter(s for s, _ in got) == blocks
    ends = sorted(max(t for t, (x, _) in enumerate(got) if x == s) for s in blocks)
    rest = [s for s, _ in got[ends[0] + 1 : ends[1] + 1]]
    left = {s: weights[s] for s in weights if s in rest}
    for s, w in left.items():
        assert abs(rest.count(s) - len(rest) * w / sum(left.values())) < 2
    many = mixing.schedule(dict.fromkeys(range(20_000), 2), dict.fromkeys(range(20_000), 0.1))
    assert len(many) == 40_000


def test_whole_weights_are_exact():
    assert mixing.whole_weights({"a": 0.5, "b": 3, "c": 0.75}) == {"a": 2, "b": 12, "c": 3}
    w = mixing.whole_weights({"a": 1e-9, "b": 3.0})
    assert Fraction(w["a"], w["b"]) == Fraction(1e-9) / 3
    with pytest.raises(ValueError, match="over 0"):
        mixing.whole_weights({"a": 0.0})


def test_curve_visits_neighbours():
    cells = sorted(((a, b, c) for a in range(8) for b in range(8) for c in range(8)), key=lambda p: sharding.hilbert_index(p, 3))
    assert [sharding.hilbert_index(p, 3) for p in cells] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(cells, cells[1:], strict=False))


def test_ascending_is_a_longest_one():
    random.seed(2)
    for _ in range(200):
        pairs = [(k, random.randrange(12)) for k in range(random.randrange(9))]
        best = max((m.bit_count() for m in range(1 << len(pairs)) if all(a < b for a, b in zip(*(lambda y: (y, y[1:]))([p[1] for k, p in enumerate(pairs) if m >> k & 1]), strict=False))), default=0)
        got = linededup.ascending(pairs)
        assert len(got) == best and all(a[1] < b[1] for a, b in zip(got, got[1:], strict=False))


def test_alignment_goes_on_beside_matches():
    assert linededup.aligned([(0, 5), (1, 6), (1, 9), (2, 7), (4, 1)]) == {0, 1, 2}
    assert linededup.aligned([(3, 3)]) == {3}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 25), max_size=14))
def test_blocks_are_the_shortest_at_each_line(words):
    want = set()
    for x in range(len(words)):
        ends = [e for e in range(x + 1, len(words) + 1) if sum(words[x:e]) >= 20]
        starts = [s for s in range(x + 1) if sum(words[s : x + 1]) >= 20]
        want |= {(x, min(ends))} if ends else set()
        want |= {(max(starts), x + 1)} if starts else set()
    assert linededup.blocks(words, 20) == {(s, e) for s, e in want if e - s > 1}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=3, max_size=9), min_size=1, max_size=4, unique=True), st.text("abc", min_size=1, max_size=10))
def test_automaton_is_levenshtein(terms, word):
    lexicon = toxicity.Lexicon([toxicity.Term(t, False, 1.0, toxicity.edits_for(len(t))) for t in terms])
    near = [e for t in terms if (e := edits(t, word)) <= toxicity.edits_for(len(t))]
    got = lexicon.match(word)
    assert (got[1] if got else None) == min(near, default=None)


def test_stems_match_beginnings():
    lexicon = toxicity.Lexicon([toxicity.Term("lowei", True, 1.0, 1)])
    assert lexicon.match("loweischaft") == (0, 0) and lexicon.match("lovei") == (0, 1) and lexicon.match("lo") is None


def brute_score(text, m, reach):
    """The model's score with every word against every term."""
    words, each = text.lower().split(), []
    for k, w in enumerate(words):
        c = toxicity.cleaned(w)
        if not c:
            continue
        near = [(min(edits(t.text, c[:n]) for n in range(len(c) + 1)) if t.stem else edits(t.text, c), -t.weight, t) for t in m.terms]
        near = [x for x in near if x[0] <= x[2].edits]
        if near:
            e, _, t = min(near, key=lambda x: x[:2])
            each.append(t.weight * toxicity.DECAY[e] * toxicity.context(words, k, reach, m.contexts))
    x = (math.log1p(sum(each)), max(each, default=0.0), min(5.0, 100 * sum(each) / max(20, len(words))))
    return 1 / (1 + math.exp(-(m.bias + sum(a * b for a, b in zip(m.coef, x, strict=True)))))


def test_scores_are_brute_forces():
    rng = random.Random(5)
    terms = [toxicity.Term("moron", False, 3.0, 1), toxicity.Term("worthless", False, 4.0, 2), toxicity.Term("idio", True, 2.5, 0), toxicity.Term("clowns", True, 3.5, 1)]
    m = toxicity.Model(terms, -3.0, (1.0, 0.5, 0.3), (1.0, 0.5, 0.4, 0.1))
    pool = ["moron", "m0ron", "mormon", "worthles", "wrthls", '"worthless"', "idiotic", "idio", "clownssss", "klowns", "sea", "cat", "said", "“quoted", "word”", "123", "..."]
    scanner = toxicity.Scanner(terms, 4)
    for _ in range(300):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 40)))
        assert m.score(toxicity.features(*scanner.hits(text), m.terms, m.contexts)) == pytest.approx(brute_score(text, m, 4))


def test_contexts_are_learned():
    plain, quoted = (0, 0, 0), (0, 0, 1)
    seen = [(1, 9, [plain])] * 300 + [(0, 9, [quoted])] * 300 + [(0, 9, [])] * 400
    w = toxicity.context_weights(seen)
    assert w[0] == 1.0 and w[1] < 0.1 and w[2:] == pytest.approx(toxicity.PLAIN_QUOTED_TOLD[2:])
    seen = [(1, 9, [plain]), (1, 9, [quoted])] * 300 + [(0, 9, [])] * 400
    assert toxicity.context_weights(seen)[1] > 0.9
    assert toxicity.context_weights([(1, 9, []), (0, 9, [plain])]) == toxicity.PLAIN_QUOTED_TOLD


def test_context_tells_quotation_from_abuse():
    plain = "you are a moron and a clown".split()
    quoted = 'he said "moron" is a rude word'.split()
    assert toxicity.context(plain, 3, 8) == 1.0 > toxicity.context(quoted, 2, 8)
    assert toxicity.cleaned("!!m0r0n,") == "moron" and toxicity.cleaned("stuuuupid") == "stupid" and toxicity.cleaned("123") == ""


@given(st.text(alphabet="<|im_start>\\\n ab"), st.text(alphabet="<|im_end>\\\n ab"))
def test_turns_read_back(role, text):
    whole, begin, end = chat.marked(role, text)
    assert chat.unescape(whole[begin:end]) == text
    assert [x[:2] for x in chat.parsed(whole + chat.marked("r", "<|im_end|>")[0])] == [(role, text), ("r", "<|im_end|>")]


@given(st.one_of(st.none(), st.text()), st.binary(max_size=50), st.one_of(st.none(), st.integers(-5, 5)))
def test_records_read_back(url, payload, page_id):
    data = warc.record(page_id, url, "D", payload, len(payload), (None,))
    head, body, stop = warc.parse(data)
    assert (warc.url_of(head), body, stop) == (url, payload, len(data))
    assert warc.page_id_of(head["WARC-Record-ID"]) == page_id and warc.page_id_of(head["WARC-Refers-To"]) is None


def words_of(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAbé \n\t\x0b ", max_size=40)), max_size=6))
def test_shingle_sets_match_brute_force(texts):
    got = list(neardup.shingle_sets(pa.array(texts, pa.string())))
    want = [words_of(t or "") for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i, a in enumerate(want):
        for j, b in enumerate(want):
            assert len(np.intersect1d(got[i], got[j])) == len(a & b)


def test_pigeonhole_finds_every_near_signature():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (200, neardup.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for row in b:  # one symbol less than two for each chunk
        row[rng.choice(neardup.SYMBOLS, 2 * neardup.CHUNKS - 1, replace=False)] ^= 1
    assert (neardup.chunk_keys(a) == neardup.chunk_keys(b)).any(axis=1).all()


ODD = ["a<|endoftext|>b c", "x y z\tq\n\nw", "don. it's 're re, ., .. ,", "", None, "ΑΣ ΣΑΣ İ", "<|startoftext|> hi", "ﬁx ªb ǅx ŉa ß, SS.", "שׁ א", "a" * 70 + ". " + "B" * 80, "A\nB\tC\r\nd", "É. é, É 12a3|b"]


def test_control_strings_are_the_tokenizers():
    e = tokens.encoder(tokens.default_path())
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|", "|>", " ", " ", "foo", "BAR", "É", "é", "漢", "\n", ".", ","]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want


def test_turns_cost_their_formatted_ids():
    e = tokens.encoder(tokens.default_path())
    rng = random.Random(4)
    parts = ["<|im_end|>", "<|", "|", "!", "foo", "BAR", " ", " ", "\n", "\t", "\\", "é", "漢", ".", ""]
    turns = [(rng.choice(["user", "assistant", "a\nb", ""]), "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))) for _ in range(2000)]
    want = [len(e.tokenizer.encode(chat.marked(r, t)[0], add_special_tokens=False).ids) for r, t in turns]
    assert chat.costs(e, *map(list, zip(*turns, strict=True))) == want


def test_tokens_are_the_tokenizers():
    e = tokens.encoder(tokens.default_path())
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(ODD)] == want
