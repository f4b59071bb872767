"""Toxicity: Levenshtein automata over a lexicon trie, with context windows.

Fitting.  A bounded sample of labelled rows (at most `rows`, those with the
smallest hash of their id) is read once for the lexicon: of every word start and
whole word (of words over 64 letters: the whole only) the toxic and other rows that
hold it are counted, those that toxic rows hold beyond chance (binomial tail under
1e-6, four in five rows toxic) are kept, all of them, and of a chain of word starts
that the same rows hold the longest stands for all.  Inflected forms that are too rare each are pooled
by their stem: a start of five letters counts as a feature of its own in texts that begin two words with it.
The toxic rows without a hit are then read again, against all others: among these few a rarer term
stands out, at the same bound.  A last reading of the sample counts how often exact hits,
misspelled hits and quoted hits of each term stand in toxic and other rows; from
these counts follow the terms' weights.  Nothing but texts and their labels is
used.

Scoring.  The trie of the lexicon and the Levenshtein automaton of one edit (in whole
words of five letters or more and word starts of six or more; two swapped neighbours
are one edit) are run together as one automaton whose
subsets are built when they are first needed, and anew when there are too many; most
words leave it after a few letters.  A hit between quotation marks, with a word of reporting within six words,
counts as quotation and weighs less.  A document's score is the chance that one of
its hits is abuse: 1 - product of (1 - weight) ** (1 + log2(n)) for n hits of a kind.

Edge cases: null and empty texts have no hits and get the base rate of rows without
hits; labels without a value or a document are left out, the larger of several labels
of a document counts; without any toxic row the lexicon is empty; repeated rows are
scored each; other columns pass through, and names that clash are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .textscan import SPACED, grams, slices, word_hashes, word_spans

WORD = re.compile(r"\w+")
#: The bound of the sample.
ROWS = 12_000
#: Letters of words that have starts; words around a hit; letters of whole words and of word starts that may be misspelled.
STARTS, WINDOW, WHOLE, START = 64, 6, 5, 6
CHANCE, PURITY = 1e-6, 0.8
#: Readings of the sample for terms; each but the first looks at what the terms so far don't explain.
ROUNDS = 4
#: Letters of a stem that counts only where a text begins several words with it, and how many.
STEM, REPEAT = 5, 2
#: Subsets of the automaton that a worker holds.
SUBSETS = 200_000
#: Weights before anything is counted (as toxic and other rows): exact, misspelled, misspelled word start, quoted.
PRIOR = {"exact": (1.0, 0.25), "near": (1.8, 0.2), "near_start": (1.0, 0.6), "quoted": (1.0, 3.0)}
#: Words of reporting, and quotation marks.
REPORTING = frozenset(
    "said says say saying called calls calling quote quoted quotes wrote writes word words term insult insulted slur "
    "reported reports shouted dit appelé mot sagte nannte wort dijo llamó palabra".split()
)
MARKS = "\"'“”„«»‘’"


def _word_starts(text: str) -> set[str]:
    """Whole words as "=word", their starts of 3 letters or more, and starts of STEM letters or more that REPEAT words have as "+start"."""
    found, begun = set(), Counter()
    for w, n in Counter(WORD.findall(text.lower())).items():
        found.add("=" + w)
        if len(w) <= STARTS:
            begun.update({w[:k]: n for k in range(3, len(w))})
    found.update(begun)
    found.update("+" + w for w, n in begun.items() if n >= REPEAT and len(w) >= STEM)
    return found


def _count_features(model):
    """Rows (term, toxic, other) over the rows that the model so far doesn't explain: toxic ones without a hit, and all others.
    An empty term counts the rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, other = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not label or not model.value.terms or not model.value.hits(text or ""):
                    (toxic if label else other).update(_word_starts(text or "") | {""})
            everything = list(toxic | other)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(everything, pa.string()),
                    pa.array([toxic[w] for w in everything], pa.int64()),
                    pa.array([other[w] for w in everything], pa.int64()),
                ],
                names=["term", "toxic", "other"],
            )

    return run


def _log_tail(k: int, n: int, p: float) -> float:
    """Log of the chance of k or more of n at rate p."""
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k, n + 1)
    ]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def _beyond_chance(rate: float):
    """The rows (term, toxic, other) whose toxic rows are more than chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield batch.filter(pa.array([_log_tail(t, t + o, rate) < math.log(CHANCE) for t, o in counts], pa.bool_()))

    return run


def choose_terms(counts: list[tuple[str, int, int]]) -> list[str]:
    """Terms ("=word", a word start, or "+start" for a stem that must be repeated) from the features beyond chance.

    Forms of a stem that are too rare to be told from chance are told by the stem, which pools them."""
    single = _longest([x for x in counts if x[0][0] != "+"])
    rows = {w: t for w, t, _ in counts}

    def told(stem: str) -> bool:
        """Whether a term of its own stands in nearly all rows of a stem."""
        own = (t for t in single if t.lstrip("=").startswith(stem) or (t[0] != "=" and stem.startswith(t)))
        return any(rows[t] >= 0.97 * rows["+" + stem] for t in own)

    return single + ["+" + w for w in _longest([(w[1:], t, o) for w, t, o in counts if w[0] == "+"]) if not told(w)]


def _longest(counts: list[tuple[str, int, int]]) -> list[str]:
    good = {w: (t, o) for w, t, o in counts}
    children: dict[str, list[str]] = {}
    for w in good:
        parent = w.lstrip("=")[:-1]
        children.setdefault(parent, []).append(w)
    terms = []
    for w in sorted(good, key=lambda x: (len(x.lstrip("=")), x)):
        start = w[1:] if w[0] == "=" else w
        starts = [start[:k] for k in range(3, len(start) + (w[0] == "="))]
        if any(s in good for s in starts):
            continue  # a shorter start stands for it
        while True:  # down the chain, while one child has nearly all of its rows
            heir = max(children.get(w, []) if w[0] != "=" else [], key=lambda x: (good[x][0], x), default=None)
            if heir is None or good[heir][0] < 0.97 * good[w][0]:
                break
            w = heir
        terms.append(w)
    return list(dict.fromkeys(terms))


class Automaton:
    """The lexicon's trie and the Levenshtein automaton of one edit, run together.

    A state is a set of (trie node, edits, letter that must come next, of a swap); subsets get numbers when first met."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.words: list[int | None] = [None]  # the term that ends here as a whole word
        self.starts: list[int | None] = [None]  # ... as a word start
        self.may_err: list[bool] = [False]  # some term through this node allows an edit
        self.errs = [len(t) > WHOLE if t[0] == "=" else len(t) >= START and t[0] != "+" for t in terms]
        self.is_start = [t[0] != "=" for t in terms]
        for number, term in enumerate(terms):
            node = 0
            self.may_err[0] |= self.errs[number]
            for c in term.lstrip("=+"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.words.append(None)
                    self.starts.append(None)
                    self.may_err.append(False)
                node = self.children[node][c]
                self.may_err[node] |= self.errs[number]
            (self.starts if self.is_start[number] else self.words)[node] = number
        self._begin()

    def _begin(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.at_once: list[tuple[int, int] | None] = []
        self.dead = self._number(frozenset())
        self.first = self._number(self._closed({(0, 0, "")}))

    def _closed(self, states: set[tuple[int, int, str]]) -> frozenset:
        """With all that skipping a letter of the term reaches."""
        out = set(states)
        for node, edits, _ in states:
            if edits == 0:
                out.update((child, 1, "") for child in self.children[node].values() if self.may_err[child])
        return frozenset(out)

    def _best(self, states: frozenset, at: list[int | None]) -> tuple[int, int] | None:
        """(edits, term) of the nearest term that ends in one of the states."""
        found = [(edits, at[node]) for node, edits, wait in states if not wait and at[node] is not None and (edits == 0 or self.errs[at[node]])]
        return min(found, default=None)

    def _number(self, states: frozenset) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.ends.append(self._best(states, self.words))
            self.at_once.append(self._best(states, self.starts))
        return self.numbers[states]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits, wait in self.sets[state]:
            if wait:
                if c == wait:
                    out.add((node, 1, ""))
                continue
            if (child := self.children[node].get(c)) is not None:
                out.add((child, edits, ""))
            if edits == 0 and self.may_err[node]:
                out.add((node, 1, ""))
                for letter, child in self.children[node].items():
                    if self.may_err[child]:
                        out.add((child, 1, ""))
                        if (after := self.children[child].get(c)) is not None and letter != c:
                            out.add((after, 1, letter))
        self.moves[state][c] = to = self._number(self._closed(out))
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) or None."""
        if len(self.sets) > SUBSETS:
            self._begin()
        state, begun = self.first, None
        for c in word:
            state = self.moves[state].get(c, -1) if c in self.moves[state] else self._move(state, c)
            if state == self.dead:
                return begun
            if (x := self.at_once[state]) is not None and (begun is None or x < begun):
                begun = x
        return min((x for x in (begun, self.ends[state]) if x is not None), default=None)


@dataclass
class Model:
    terms: list[str]
    weights: dict[tuple[int, str], float] = field(default_factory=dict)
    base: float = 0.0

    def __post_init__(self) -> None:
        self.automaton, self.known = Automaton(self.terms), {}

    def __reduce__(self):
        return Model, (self.terms, self.weights, self.base)

    def hits(self, text: str) -> Counter:
        """How often every (term, exact, near or quoted) stands in a text."""
        low = text.lower()
        words, known, match = WORD.findall(low), self.known, self.automaton.match
        if len(known) > 500_000:
            known.clear()
        wanted = set()
        for w in set(words):
            if w not in known:
                known[w] = match(w)
            if known[w] is not None:
                wanted.add(w)
        found: Counter = Counter()
        if wanted:
            spans = [(m.start(), m.end()) for m in WORD.finditer(low)]
            for i, w in enumerate(words):
                if w in wanted:
                    edits, term = known[w]
                    misspelled = "near_start" if self.automaton.is_start[term] else "near"
                    kind = "quoted" if self._quoted(low, words, spans, i) else misspelled if edits else "exact"
                    found[term, kind] += 1
        stems = {term for term, _ in found if self.terms[term][0] == "+"}
        alone = {t for t in stems if sum(n for (term, _), n in found.items() if term == t) < REPEAT}
        return Counter({key: n for key, n in found.items() if key[0] not in alone}) if alone else found

    @staticmethod
    def _quoted(low: str, words: list[str], spans: list[tuple[int, int]], i: int) -> bool:
        first, last = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        before, after = low[spans[first][0] : spans[i][0]], low[spans[i][1] : spans[last - 1][1] + 1]
        marks = any(m in before for m in MARKS) and any(m in after for m in MARKS)
        return marks and not REPORTING.isdisjoint(words[first:last])

    def score(self, text: str) -> float:
        clean = 1.0 - self.base
        for key, n in self.hits(text).items():
            weight = self.weights.get(key, _weight(key[1], 0, 0))
            clean *= (1.0 - max(0.0, 2.0 * weight - 1.0)) ** (1.0 + math.log2(n))  # even odds say nothing
        return 1.0 - clean


def _weight(kind: str, toxic: int, other: int) -> float:
    a, b = PRIOR[kind]
    return (toxic + a) / (toxic + other + a + b)


def _count_hits(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, other = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else other).update(set(model.value.hits(text or "")) or {(-1, "none")})
            keys = list(toxic | other)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()),
                    pa.array([toxic[k] for k in keys], pa.int64()), pa.array([other[k] for k in keys], pa.int64()),
                ],
                names=["term", "kind", "toxic", "other"],
            )

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least and the largest hash of 5-word runs (texts of fewer words: of the first word)."""
    for batch in batches:
        low, high = [], []
        for i, j, data, offsets in slices(batch.column(0)):
            starts, ends, row = word_spans(data, offsets, SPACED)
            hashes = word_hashes(data, starts, ends)
            bounds = np.searchsorted(row, np.arange(j - i + 1))
            for r in range(j - i):
                own = hashes[bounds[r] : bounds[r + 1]]
                own = (grams(own, 5) if len(own) >= 5 else own).view(np.int64)
                low.append(int(own.min()) if len(own) else 0)
                high.append(int(own.max()) if len(own) else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["text", "label", "low", "high"])


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """text and label of at most `rows` labelled documents outside the held-out third."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (key % 3 != 1))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded: 12 bytes a row
    rows_of = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    # Of copies and near copies one stays (the least text): else their common words would look like terms.
    told = rows_of.mapInArrow(_ends, "text string, label int, low long, high long")
    for end in ("low", "high"):
        told = told.groupBy("label", end).agg(F.min(F.struct("text", "low", "high")).alias("least")).select("label", "least.*")
    return told.select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """The lexicon and its weights; what reaches the driver is bounded by the sample."""
    spark = docs.sparkSession
    chosen = stored(sample(docs, labels, rows), "toxicity-sample").repartition(max(4, spark.sparkContext.defaultParallelism))
    terms: list[str] = []
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(Model(terms))
        features = chosen.mapInArrow(_count_features(shared), "term string, toxic long, other long")
        features = stored(features.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "toxicity-features")
        rows = features.where("term = ''").first()
        toxic, other = (rows["toxic"], rows["other"]) if rows else (0, 0)
        likely = features.where((F.col("term") != "") & (F.col("toxic") >= 3) & (F.col("toxic") >= PURITY * (F.col("toxic") + F.col("other"))))
        rate = min(0.999, toxic / max(1, toxic + other))
        best = likely.mapInArrow(_beyond_chance(rate), likely.schema).collect() if toxic else []
        more = [t for t in choose_terms(sorted(tuple(r) for r in best)) if t not in terms]
        if not more:
            break
        terms += more
    terms.sort(key=lambda t: t[0] == "+")  # a term of its own is preferred to a stem
    model = Model(terms)
    counted = chosen.mapInArrow(_count_hits(spark.sparkContext.broadcast(model)), "term long, kind string, toxic long, other long")
    for r in counted.groupBy("term", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).collect():
        if r["term"] < 0:
            model.base = min(0.4, (r["toxic"] + 0.5) / (r["toxic"] + r["other"] + 1.0))
        else:
            model.weights[r["term"], r["kind"]] = _weight(r["kind"], r["toxic"], r["other"])
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.get_field_index("text")
            scores = [model.value.score(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [c for k, c in enumerate(batch.columns) if k != text] + [pa.array(scores, pa.float64())],
                names=[n for n in batch.schema.names if n != "text"] + ["score"],
            )

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs without text, with score and predicted."""
    rest = [f for f in docs.schema if f.name not in ("text", "score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in rest], T.StructField("score", T.DoubleType())])
    df = docs.select(*[F.col(f"`{f.name}`") for f in rest], "text").mapInArrow(_score(shared), schema)
    return df.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
