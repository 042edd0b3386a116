"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Terms and their weights are learned from a bounded sample of labelled rows: whole words, and stems that many
words begin with. The terms form a trie; its product with the Levenshtein automata of all terms is made into a
deterministic automaton as words need it, so a word is matched in one walk, misspelled or not. Each match is
weighed by its context: a window of words around it tells quotation and report from abuse; what a quoted or reported
match weighs is learned too.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import forget, in_arrow, texts, written

#: Signs that stand for letters, and the letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
MARKS = "\"'`“”„«»‘’.,;:!?()[]{}<>*_-~…"
QUOTES_OPEN, QUOTES_CLOSE = "\"“„«‘", "\"”“»’"
#: Words that announce a report of what someone said.
REPORTING = frozenset("said says say wrote writes quote quoted quotes quoting called reported reports term word phrase example termed dijo dice palabra cita dit mot citation sagte wort zitat".split())
#: Weight of a match in plain speech, between quotation marks, by a reporting word, and both, before any is seen.
PLAIN_QUOTED_TOLD = (1.0, 0.35, 0.6, 0.21)
#: What is learned of a context counts as much as this once so many matches are in it.
CONTEXT_MATCHES = 20
#: Weight of a match by its edits.
DECAY = (1.0, 0.8, 0.6)
#: Words, and states, that a Python worker keeps at most.
KEPT_WORDS, KEPT_STATES = 200_000, 40_000
RUN = re.compile(r"(.)\1{2,}")


def edits_for(length: int) -> int:
    """Edits allowed in a term: none under five letters, one up to eight, then two."""
    return 0 if length < 5 else 1 if length < 9 else 2


def cleaned(word: str) -> str:
    """A word of lower case without marks around it; signs for letters replaced, long runs of a letter cut to one."""
    word = word.strip(MARKS)
    if not word.isalpha():
        if not any(c.isalpha() for c in word):
            return ""
        word = "".join(c for c in word.translate(LEET) if c.isalpha())
    return RUN.sub(r"\1", word)


@dataclass
class Term:
    text: str
    stem: bool
    weight: float
    edits: int


@dataclass
class Lexicon:
    """Terms in a trie, and the automaton of all words within their edits, made as needed."""

    terms: list[Term]
    trie: list[dict] = field(default_factory=list)
    ends: list[list[int]] = field(default_factory=list)
    most: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.trie, self.ends, self.most = [{}], [[]], [0]
        for k, t in enumerate(self.terms):
            node = 0
            self.most[0] = max(self.most[0], t.edits)
            for c in t.text:
                if c not in self.trie[node]:
                    self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.trie[node][c]
                self.most[node] = max(self.most[node], t.edits)
            self.ends[node].append(k)
        self._reset()

    def _reset(self):
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.at_end: list[tuple | None] = []
        self.as_stem: list[tuple | None] = []
        self.start = self._state({(0, 0)})
        self.dead = self._state(set())

    def _state(self, found: set[tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        todo = list(found)
        while todo:  # letters of a term that the word leaves out
            node, e = todo.pop()
            if best.get(node, 99) <= e or e > self.most[node]:
                continue
            best[node] = e
            if e < self.most[node]:
                todo += [(n, e + 1) for n in self.trie[node].values()]
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            hits = [(e, -self.terms[k].weight, k) for node, e in key for k in self.ends[node] if e <= self.terms[k].edits]
            self.at_end.append(min(hits, default=None))
            self.as_stem.append(min((h for h in hits if self.terms[h[2]].stem), default=None))
        return self.ids[key]

    def _step(self, s: int, c: str) -> int:
        found = set()
        for node, e in self.sets[s]:
            if c in self.trie[node]:
                found.add((self.trie[node][c], e))
            if e < self.most[node]:
                found.add((node, e + 1))
                found.update((n, e + 1) for n in self.trie[node].values())
        self.steps[s][c] = t = self._state(found)
        return t

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best term within its edits of the word, or of the word's beginning for a stem."""
        if len(self.sets) > KEPT_STATES:
            self._reset()
        s, best = self.start, None
        for c in word:
            s = self.steps[s].get(c, -1) if c in self.steps[s] else self._step(s, c)
            if s == self.dead:
                break
            if (h := self.as_stem[s]) and (best is None or h < best):
                best = h
        else:
            if (h := self.at_end[s]) and (best is None or h < best):
                best = h
        return (best[2], best[0]) if best else None


@dataclass
class Model:
    terms: list[Term]
    bias: float = -3.0
    coef: tuple[float, ...] = (0.0, 0.0, 0.0)
    contexts: tuple[float, ...] = PLAIN_QUOTED_TOLD

    def score(self, x: tuple[float, ...]) -> float:
        z = self.bias + sum(a * b for a, b in zip(self.coef, x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def context_of(words: list[str], at: int, reach: int) -> int:
    """Which context a match is in: 0 plain, 1 between quotation marks, 2 by a reporting word, 3 both."""
    before, after = words[max(0, at - reach) : at + 1], words[at : at + reach + 1]
    opened = any(w[0] in QUOTES_OPEN for w in before if w)
    closed = any(w.rstrip(".,;:!?")[-1:] in QUOTES_CLOSE and w.rstrip(".,;:!?")[-1:] for w in after)
    told = any(w.strip(MARKS) in REPORTING for w in (*before[:-1], *after[1:]))
    return (1 if opened and closed else 0) + (2 if told else 0)


def context(words: list[str], at: int, reach: int, weights: tuple[float, ...] = PLAIN_QUOTED_TOLD) -> float:
    """1 for a match in plain speech; less between quotation marks or by a reporting word."""
    return weights[context_of(words, at, reach)]


def context_weights(seen: list[tuple]) -> tuple[float, ...]:
    """The contexts' weights by the log odds that a match in them is in a toxic text, against those of plain ones.

    seen: (y, words, hits) of the sample's rows. Few matches leave a weight near that of PLAIN_QUOTED_TOLD.
    """
    rows = [sum(y == k for y, *_ in seen) for k in (0, 1)]
    n = Counter((y, c) for y, _, hits in seen for _, _, c in hits)
    odds = [math.log((n[1, c] + 0.5) / (n[0, c] + 0.5)) - math.log(rows[1] / rows[0]) for c in range(4)]
    if odds[0] <= 0:
        return PLAIN_QUOTED_TOLD
    many = lambda c: n[0, c] + n[1, c]
    learned = (CONTEXT_MATCHES * w + many(c) * min(1.0, max(0.0, odds[c] / odds[0])) for c, w in enumerate(PLAIN_QUOTED_TOLD))
    return (1.0, *[x / (CONTEXT_MATCHES + many(c)) for c, x in enumerate(learned)][1:])


class Scanner:
    """hits(text): words of the text and (term, edits, context_of) of each match."""

    def __init__(self, terms: list[Term], reach: int):
        self.lexicon, self.reach, self.clear = Lexicon(terms), reach, set()

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int, int]]]:
        words = (text or "").lower().split()
        found = {}
        for w in set(words) - self.clear:
            if (c := cleaned(w)) and (m := self.lexicon.match(c)):
                found[w] = m
            elif len(w) < 64:
                self.clear.add(w)
        if len(self.clear) > KEPT_WORDS:
            self.clear.clear()
        if not found:
            return len(words), []
        return len(words), [(*found[w], context_of(words, k, self.reach)) for k, w in enumerate(words) if w in found]


def features(n_words: int, hits: list[tuple[int, int, int]], terms: list[Term], contexts: tuple[float, ...]) -> tuple[float, float, float]:
    each = [terms[t].weight * DECAY[e] * contexts[c] for t, e, c in hits]
    return math.log1p(sum(each)), max(each, default=0.0), min(5.0, 100 * sum(each) / max(20, n_words))


def labelled(docs: DataFrame, labels: DataFrame, rows: int, folds: int) -> DataFrame:
    """doc_id, text and y (0 or 1) of at most rows labelled documents of the learning folds, the first by a hash of doc_id."""
    y = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null")
    y = y.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return texts(docs).join(F.broadcast(y), "doc_id").where("text is not null")  # at most rows


def stems_of(words: set[str], shortest: int, longest: int) -> set[str]:
    return {w[:n] + "*" for w in words for n in range(shortest, min(longest, len(w) - 1) + 1)}


def learn(docs: DataFrame, labels: DataFrame, rows: int = 20_000, folds: int = 5, support: int = 5, reach: int = 8) -> Model:
    """The model of at most rows labelled documents (the documented bound) whose crc32(doc_id) mod folds isn't 0.

    A term is a word, or a stem of four to eight letters with more words, that at least support toxic rows hold and
    e**3 times as many of them, in proportion, as of the others. All such terms of the sample are taken, so their
    number is bounded by rows alone. With no labelled row of either kind the model has no terms and gives each text the
    same low score.
    """
    sample = written(labelled(docs, labels, rows, folds), "toxicity-sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        forget(sample)
        return Model([])

    def counted(batches):
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = {c for w in set(t.lower().split()) if (c := cleaned(w)) and len(c) >= 3}
                n[y == 1].update(words | stems_of(words, 4, 8))
        terms = list(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in n)], ["term", "outs", "ins"])

    counts = in_arrow(sample.where("y in (0, 1)").select("text", "y"), counted, "term string, outs bigint, ins bigint")
    counts = counts.groupBy("term").agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins"))
    odd = F.log((F.col("ins") + 0.5) / (toxic + 1)) - F.log((F.col("outs") + 0.5) / (other + 1))
    found = counts.where((F.col("ins") >= support) & (odd >= 3 - 1e-9)).collect()  # of the sample's terms
    ins = {r.term: r.ins for r in found}
    odds = {r.term: math.log((r.ins + 0.5) / (toxic + 1)) - math.log((r.outs + 0.5) / (other + 1)) for r in found}
    strong = sorted(t for t in ins if odds[t] >= 3)
    longer, words = defaultdict(list), defaultdict(list)  # strong stems of one letter more, and strong words, of a stem
    for t in strong:
        if t[-1] == "*":
            longer[t[:-2]].append(t)
        else:
            for n in range(4, min(8, len(t)) + 1):
                words[t[:n]].append(t)
    chosen: dict[str, Term] = {}
    covered: set[str] = set()
    is_covered = lambda t: any(t[:n] in covered for n in range(4, min(8, len(t)) + 1))
    for t in sorted((t for t in strong if t[-1] == "*"), key=lambda t: (len(t), t)):  # shortest stems first
        stem = t[:-1]
        if is_covered(stem):
            continue
        covered.add(stem)
        while more := [x for x in longer[stem] if ins[x] >= 0.95 * ins[stem + "*"]]:
            stem = more[0][:-1]
        whole = [x for x in words[stem] if ins[x] >= 0.9 * ins[stem + "*"]]
        term = whole[0] if whole else stem
        chosen[term] = Term(term, not whole, odds[term if whole else stem + "*"], edits_for(len(term)))
    for t in strong:
        if t[-1] != "*" and not is_covered(t):
            chosen[t] = Term(t, False, odds[t], edits_for(len(t)))
    terms = sorted(chosen.values(), key=lambda t: (-t.weight, t.text))

    def scan(batches):
        scanner = Scanner(terms, reach)
        for b in batches:
            rows_ = [(y, *scanner.hits(t)) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            found = [{"y": y, "words": n, "term": [h[0] for h in hits], "edits": [h[1] for h in hits], "ctx": [h[2] for h in hits]} for y, n, hits in rows_]
            numbers = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pylist(found, pa.schema([("y", pa.int32()), ("words", pa.int64()), ("term", numbers), ("edits", numbers), ("ctx", numbers)]))

    scanned = in_arrow(sample.select("text", "y"), scan, "y int, words bigint, term array<int>, edits array<int>, ctx array<int>")
    seen = [(r.y, r.words, list(zip(r.term, r.edits, r.ctx, strict=True))) for r in scanned.collect()]  # at most rows rows
    forget(sample)
    near = (Counter(), Counter())
    for y, _, hits in seen:
        near[y].update({(t, e) for t, e, _ in hits if e})
    for t, e in sorted({*near[0], *near[1]}, reverse=True):  # edits that clean rows have too
        if near[0][t, e] >= 3 and (near[1][t, e] + 0.5) / toxic < 4 * (near[0][t, e] + 0.5) / other:
            terms[t].edits = min(terms[t].edits, e - 1)
    seen = [(y, n, [h for h in hits if h[1] <= terms[h[0]].edits]) for y, n, hits in seen]
    contexts = context_weights(seen)
    return fitted(np.array([features(n, hits, terms, contexts) for _, n, hits in seen]), np.array([y for y, *_ in seen], float), terms, contexts)


def fitted(x: np.ndarray, y: np.ndarray, terms: list[Term], contexts: tuple[float, ...] = PLAIN_QUOTED_TOLD, ridge: float = 1.0) -> Model:
    """Logistic regression by Newton's method, coefficients not negative: a match never speaks for a text."""
    x1 = np.c_[np.ones(len(x)), x]
    w, used = np.zeros(4), np.ones(4, bool)
    for _ in range(4):
        w[~used] = 0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            a = x1[:, used]
            grad = a.T @ (p - y) + ridge * w[used]
            w[used] -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(used.sum()), grad)
        if (w[1:] >= 0).all():
            break
        used[1:] &= w[1:] >= 0
    return Model(terms, float(w[0]), tuple(float(v) for v in w[1:]), contexts)


def scores(docs: DataFrame, model: Model, reach: int = 8) -> DataFrame:
    """doc_id and score of every whole text; a null or empty text scores as one without matches. Rows stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the terms of a bounded sample

    def run(batches):
        m = shared.value
        scanner = Scanner(m.terms, reach)
        for b in batches:
            out = [m.score(features(*scanner.hits(t), m.terms, m.contexts)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return in_arrow(texts(docs), run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null doc_id counts as an empty one for the fold."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    return scores(docs, learn(docs, labels, folds=folds, **options)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """docs without the documents that score threshold or more; columns as they were."""
    model = learn(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        scanner = Scanner(m.terms, 8)
        for b in batches:
            keep = [m.score(features(*scanner.hits(t), m.terms, m.contexts)) < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return in_arrow(docs, run, docs.schema)
