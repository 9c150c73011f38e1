"""Operator 8: toxicity by Levenshtein automata over a lexicon trie, weighed by context.

The lexicon is learned: words that stand in far more toxic than other documents of a
bounded sample of the labelled ones (SAMPLE rows of each label, texts of at most
SAMPLE_BYTES bytes), counted by Spark. Its terms form a trie. A word runs through the
automaton that is the product of that trie and the Levenshtein automaton of at most EDITS
edits; states are sets of (trie node, edits) and are made when first reached, so a word costs
one look-up a letter and most words fail after two or three. Words of at least FUZZY[0] and
stems of at least FUZZY[1] letters match with one edit, shorter ones exactly. What a misspelled match is worth is learned for each
term from the documents of the sample that have one, so terms near to harmless words
weigh little.

Each match is weighed by its window of CONTEXT words to either side and by whether it stands
between the two marks of a quotation. A cue is a word to the left, a word to the right or
the quotation; its weight is the log odds of its documents among those with matches, drawn
towards a prior (PRIORS: quotations and words of report speak against abuse, words of address
for it; other words start at 0). A match counts 2 / (1 + exp(-sum of its cues)) times, so from
0 for what is plainly reported to 2. A logistic model of the sums gives the score.

Defined cases: null and empty texts have no match and get the score of a text without any;
if a label has no row to learn from the score is the share of the other (0 without any
labelled row); rows with null labels teach nothing, and where a document has several labels
any toxic one counts; of rows that share an id so many learn as the bound of the sample
admits, in order of hash; a quotation mark without a partner in its line opens nothing;
repeated rows are rows of their own; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hash_sample, id_bucket, keep_rows, table, text_steps

SAMPLE = 4_000
SAMPLE_BYTES = 20_000
SUPPORT = 4
EDITS = 1
FUZZY = (3, 6)
#: Letters of a stem.
STEM = (4, 8)
CONTEXT = 6
CACHE = 250_000
HELD_OUT, FOLDS = 0, 5
#: Standard errors by which log odds are lowered before a word is a term.
SURE = 1.64
#: What a misspelled match is worth, as a share of the term, before the sample says more.
NEAR = 0.5

#: Words; the line end, within which quotations close; and quotation marks, an apostrophe being one only at the edge of a word.
_TOKEN = re.compile(r"[^\W_]+|\n|[\"“”„«»]|(?<![^\W_])['‘’‚]|['‘’](?![^\W_])")
#: Closing marks by opening ones.
_CLOSES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "'": "'", "‘": "’", "‚": "‘’", "”": "”", "’": "’"}
_MARKS = {"\n", *_CLOSES}
QUOTED = "quoted"
#: Words of report and of address in the languages of the corpus.
_REPORT = "said says say wrote writes called calls quote quotes told tells sagte sagt schrieb nannte zitat dit disait écrit appelé citation dijo dice escribió llamó cita".split()
_ADDRESS = "you your youre u du dich dein ihr tu te ton vous tú tus usted".split()
#: Weights of cues before the sample says more; a word is a cue with < before it to the left of a match, with > to the right.
PRIORS = {QUOTED: -2.0, **{f"<{w}": -1.0 for w in _REPORT}, **{c + w: 0.5 for w in _ADDRESS for c in "<>"}}


class Automaton:
    """Matches a word against terms (term, whole) with at most EDITS edits; a term that is not whole, a stem, need only match its beginning.

    match(word) gives (number of the term, edits) or None; the best match has fewest edits,
    then is a whole word, then is the longest, then the first.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[-1, -1]]  # the stem and the word that end at a node
        self.fuzzy: list[bool] = [False]  # whether a term that allows edits lies at or below
        self.terms = terms
        for k, (term, whole) in enumerate(terms):
            node, path = 0, [0]
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([-1, -1])
                    self.fuzzy.append(False)
                node = self.children[node][c]
                path.append(node)
            self.ends[node][whole] = k
            if self._bends(k):
                for n in path:
                    self.fuzzy[n] = True
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[list[tuple[int, int, int, int] | None]] = []  # by state: the best stem and the best word
        self.start = self._state(self._closed({(0, 0)}))

    def _bends(self, k: int) -> bool:
        term, whole = self.terms[k]
        return len(term) >= FUZZY[not whole]

    def _closed(self, s: set[tuple[int, int]]) -> frozenset:
        """With the nodes that are reached by leaving letters of a term out."""
        todo = list(s)
        while todo:
            node, e = todo.pop()
            if e < EDITS:
                for child in self.children[node].values():
                    if self.fuzzy[child] and (child, e + 1) not in s:
                        s.add((child, e + 1))
                        todo.append((child, e + 1))
        return frozenset(s)

    def _state(self, s: frozenset) -> int:
        if s not in self.states:
            self.states[s] = len(self.sets)
            self.sets.append(s)
            self.next.append({})
            ends = [[(e, not whole, -len(self.terms[k][0]), k) for n, e in s if (k := self.ends[n][whole]) >= 0 and (e == 0 or self._bends(k))] for whole in (0, 1)]
            self.accepts.append([min(x, default=None) for x in ends])
        return self.states[s]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            child = self.children[node].get(c)
            if child is not None and (e == 0 or self.fuzzy[child]):
                out.add((child, e))
            if e < EDITS and self.fuzzy[node]:
                out.add((node, e + 1))  # a letter too many
                out.update((x, e + 1) for x in self.children[node].values() if self.fuzzy[x])  # another letter
        return self._state(self._closed(out))

    def match(self, word: str) -> tuple[int, int] | None:
        state, best = self.start, None
        for c in word:
            nxt = self.next[state].get(c)
            if nxt is None:
                nxt = self._step(state, c)
                if len(self.sets) < CACHE:
                    self.next[state][c] = nxt
            state = nxt
            stem = self.accepts[state][0]
            if stem and (best is None or stem < best):
                best = stem
            if not self.sets[state]:
                break
        else:
            end = self.accepts[state][1]
            if end and (best is None or end < best):
                best = end
        return best and (best[3], best[0])


def quotations(tokens: list[str]) -> list[bool]:
    """For each token whether it stands between the two marks of a quotation within one line."""
    inside = [False] * len(tokens)
    opened: tuple[int, str] | None = None
    for i, t in enumerate(tokens):
        if t == "\n":
            opened = None
        elif opened and t in _CLOSES[opened[1]]:
            inside[opened[0] : i] = [True] * (i - opened[0])
            opened = None
        elif not opened and t in _CLOSES:
            opened = i, t
    return inside


FEATURES = ("abuse", "quoted", "share", "strongest")


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    #: By term: what a whole match is worth, and a misspelled one.
    weights: list[tuple[float, float]] = field(default_factory=list)
    cues: dict[str, float] = field(default_factory=dict)
    coef: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    bias: float = -math.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        if math.isinf(self.bias):
            return np.full(len(x), float(self.bias > 0))
        return 1 / (1 + np.exp(-np.clip(x @ self.coef + self.bias, -30, 30)))


class Reader:
    """Finds the matches of texts with one automaton, and remembers the words it has met, CACHE at most."""

    def __init__(self, model: Model):
        self.automaton, self.model, self.known = Automaton(model.terms), model, {}

    def matches(self, text: str) -> tuple[int, list[tuple[int, int, set[str]]]]:
        """The number of words, and (term, edits, cues) of every match."""
        tokens = _TOKEN.findall(text.lower())
        known = self.known
        new = set(tokens).difference(known)
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = set(tokens)
            match = self.automaton.match
            for w in new:
                known[w] = None if w in _MARKS else match(w)
        found = [i for i, w in enumerate(tokens) if known[w] is not None]
        if not found:
            return len(tokens), []
        inside = quotations(tokens)
        words = [i for i, w in enumerate(tokens) if w not in _MARKS]
        place = {i: n for n, i in enumerate(words)}
        out = []
        for i in found:
            n = place[i]
            cues = {f"<{tokens[j]}" for j in words[max(0, n - CONTEXT) : n]} | {f">{tokens[j]}" for j in words[n + 1 : n + 1 + CONTEXT]}
            out.append((*known[tokens[i]], cues | {QUOTED} if inside[i] else cues))
        return len(words), out

    def features(self, text: str) -> list[float]:
        words, found = self.matches(text)
        abuse = quoted = strongest = 0.0
        weight, cue = self.model.weights, self.model.cues
        for term, edits, cues in found:
            w = weight[term][min(edits, 1)]
            quoted += w * (QUOTED in cues)
            w *= 2 / (1 + math.exp(-max(-30.0, sum(sorted(cue[c] for c in cues if c in cue)))))
            abuse += w
            strongest = max(strongest, w)
        return [math.log1p(abuse), math.log1p(quoted), math.log1p(100 * abuse / max(1, words)), strongest]


def units(text: Column) -> Column:
    """The distinct words of a text, each with a closing $, and their beginnings."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: F.length(w) >= 3))
    least, most = STEM
    starts = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.lit(most), F.length(w)))), lambda n: F.substr(w, F.lit(1), n))))
    return F.array_union(F.transform(words, lambda w: F.concat(w, F.lit("$"))), F.filter(starts, lambda s: F.length(s) >= least))


def lexicon(sample: DataFrame, toxic: int, clean: int) -> list[tuple[str, bool, float]]:
    """(term, whole, weight) of a sample (text, toxic) with so many rows of either label; a bounded sample has a bounded number of words.

    Of a word and its stems, and of stems one of which begins the other, the surest is taken, then the longest.
    """
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((b + 0.5) / (clean - b + 0.5))
    sure = odds - SURE * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    counted = sample.select("toxic", F.explode(units(F.col("text"))).alias("u")).groupBy("u").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    out: list[tuple[str, bool, float]] = []
    stems, begun = set(), set()  # the stems taken, and all beginnings of the terms taken
    for r in counted.where(a >= SUPPORT).withColumn("w", sure).where("w >= 1").orderBy(F.desc("w"), F.desc(F.length("u")), "u").collect():
        term, whole = (r.u[:-1], True) if r.u.endswith("$") else (r.u, False)
        starts = {term[:n] for n in range(STEM[0], len(term) + 1)}
        if stems.isdisjoint(starts) and (whole or term not in begun):
            out.append((term, whole, float(r.w)))
            begun |= starts
            if not whole:
                stems.add(term)
    return out


def drawn(prior: float, a: float, b: float, c: float, d: float) -> float:
    """Log odds of a against b as compared with c against d, drawn towards a prior of variance 1."""
    odds = math.log((a + 0.5) / (b + 0.5)) - math.log((c + 0.5) / (d + 0.5))
    sure = 1 / (1 / (a + 0.5) + 1 / (b + 0.5))
    return (prior + odds * sure) / (1 + sure)


def contexts(sample: DataFrame, model: Model) -> tuple[dict[int, tuple[int, int]], dict[str, float]]:
    """For the number of each term the (toxic, clean) documents of a sample (text, toxic) that misspell it, and the weights of cues.

    A cue is weighed against what its terms say without it: the documents that have a term and the
    cue are compared with as many that have the term, so it is no cue to stand beside a sure term.
    """
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for b in (s for batch in batches for s in text_steps(batch)):
            terms, marks, label = [], [], []
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                own = {(term, c) for term, edits, cues in reader.matches(t or "")[1] for c in (*cues, "", *("~" * edits))}
                terms += [t for t, _ in own]
                marks += [c for _, c in own]
                label += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(marks, pa.string()), pa.array(label, pa.int32())], names=["term", "mark", "toxic"])

    a, b = F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)
    counted = cut(sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "term int, mark string, toxic int").groupBy("term", "mark").agg(a.alias("a"), b.alias("b")))
    near = {r.term: (r.a, r.b) for r in counted.where("mark = '~'").collect()}  # a row for each term
    each = counted.where("mark = ''").select("term", (F.col("a") / (F.col("a") + F.col("b"))).alias("_share"))
    cues = counted.where("mark not in ('', '~')").join(each, "term").groupBy("mark")
    n = F.col("a") + F.col("b")
    sums = cues.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(n * F.col("_share")).alias("c"), F.sum(n * (1 - F.col("_share"))).alias("d")).where(n >= SUPPORT)
    weights = {r.mark: drawn(PRIORS.get(r.mark, 0.0), r.a, r.b, r.c, r.d) for r in sums.collect()}  # of a bounded sample
    return near, {c: w for c, w in weights.items() if c in PRIORS or abs(w) > 1e-3}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Coefficients and bias by Newton steps."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.diag([*[1.0] * x.shape[1], 1e-6]) + 1e-9 * np.eye(z.shape[1])
        step = np.linalg.solve(h, z.T @ (p - y) + ridge * len(x) * np.r_[w[:-1], 0])
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def read(docs: DataFrame, model: Model) -> DataFrame:
    """docs with features array<double> in place of text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for b in (s for batch in batches for s in text_steps(batch)):
            x = [reader.features(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(x, pa.list_(pa.float64()))], names=[*others, "features"])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "features array<double>"]))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, toxic), by the rows that are not held out."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (id_bucket("doc_id", FOLDS) != HELD_OUT))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}
    if len(there) < 2:
        return Model(bias=math.inf if there.get(1) else -math.inf)
    picked = hash_sample(own, ("doc_id",), "toxic", {k: (n, SAMPLE) for k, n in there.items()}, "toxicity", most=3 * SAMPLE)
    rows = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # 3 * SAMPLE rows at most
    sample = cut(rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(3 * SAMPLE).select("text", "toxic").distinct())
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model(bias=math.inf if n.get(1) else -math.inf)
    found = lexicon(sample, n[1], n[0])
    model = Model([(t, whole) for t, whole, _ in found], [(w, NEAR * w) for *_, w in found], dict(PRIORS))
    near, cues = contexts(sample, model)
    model.weights = [(w, min(w, max(0.0, drawn(NEAR * w, *near.get(k, (0, 0)), n[1], n[0])))) for k, (w, _) in enumerate(model.weights)]
    model.cues |= cues
    rows = read(sample, model).collect()  # a few numbers for each row of the sample
    x, y = np.array([r.features for r in rows]), np.array([r.toxic for r in rows], float)
    share = y.mean(), there[1] / (there[0] + there[1])
    keep = np.ones(len(FEATURES), bool)
    while True:  # more or stronger matches never make a text less toxic
        coef, bias = logistic(x * keep, y)
        wrong = (coef < 0) & keep & (np.array(FEATURES) != "quoted")
        if not wrong.any():
            break
        keep &= ~wrong
    model.coef = coef * keep
    model.bias = bias - math.log(share[0] / (1 - share[0])) + math.log(share[1] / (1 - share[1]))  # the sample has more of the rarer label
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, features) for docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        reader = Reader(m)
        for b in (s for batch in batches for s in text_steps(batch)):
            x = [reader.features(t or "") for t in b.column("text").to_pylist()]
            s = m.score(np.array(x).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "score", "predicted", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, features array<double>")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted to be toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def judge() -> Callable[[list[str]], np.ndarray]:
        m, reader = sent.value, Reader(sent.value)
        return lambda texts: m.score(np.array([reader.features(t) for t in texts]).reshape(-1, len(FEATURES))) < 0.5

    return keep_rows(docs, judge)


def op8_levenshtein_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(id_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
