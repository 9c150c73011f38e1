"""Operator 5: language ID by averaged hashed subword embeddings and a linear softmax.

Subwords are the runs of 1 to 3 letters of the lower-cased text, with the edges of words
as a letter of their own, hashed to BUCKETS embeddings. The mean of a text's embeddings
goes through a linear softmax; both are trained by stochastic gradient descent in numpy
on a bounded sample (SAMPLE rows in all or EACH of every language, whichever is more,
dealt evenly over the languages, texts of at most SAMPLE_BYTES bytes). A fifth of the
sample is kept from training, and everything about certainty is fitted on it:

- the temperature, and the power of the number of subwords by which a longer text is surer,
  on whole texts and on pieces of them of a few words and letters;
- familiarity: the mean log frequency of a text's subwords in the language that has each
  most often, as a number of standard deviations below what is usual at its length. Its
  limit lies below the held-back texts and above the same texts as they look to a model
  that never saw their language (each language left out in turn).

Text from elsewhere has other subwords than the sample, in the languages it knows too. So a text that is not familiar is judged by the words
that its language uses everywhere: those with a share of COMMON or more of the language's words, in NEEDED of its texts or more. If the
language is the one predicted they occur at the rate they have in the sample, else at the rate that relatives have, which is
taken to be CARRY of it (and half of what another known language has), and in a long text CLOSE of it at most. The two likelihood ratios, and
FOREIGN_LETTER for each letter beyond ASCII that the language does not use, give the odds that the text is in it; with the softmax they
also say which language it is.

The score is the probability of the language times that of a text in it, the larger of the two. A prediction is
rejected if its score is below CERTAIN, so foreign languages, noise and code go, not
only texts without letters.

Prediction reads every text whole, in tasks that hold the model (a fixed size for up to DIM
languages, and one row of DIM numbers for each further one) and about STEP_BYTES of text at
a time.

Defined cases: texts that are null or hold no letter are `und` with score 0 and rejected;
if nothing can be learned (no labelled text) every text is `und`; if there is one language, the
limit of familiarity is BELOW standard deviations below the held-back texts; equal scores go to
the language that sorts first; repeated rows are rows of their own; null ids are hashed as the null
string, which is not held out; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, id_bucket, keep_rows, steps, table, text_steps

BUCKETS = 1 << 16
DIM = 16
ORDERS = (1, 2, 3)
SAMPLE, EACH = 4_000, 20
SAMPLE_BYTES = 20_000
EPOCHS = 6
RATE = 0.5
CERTAIN = 0.5
#: Pieces of texts on which the temperature is fitted: so many words, and so many letters of a word.
PIECES, LETTERS = (1, 2, 4, 8, 16), (1, 2, 4)
#: Share of subwords of no known language that makes one standard deviation at least: names, numbers, quotations.
STRANGE = 0.04
#: Weight of a subword that no text of a language has, a whole text being 1.
RARE = 1e-3
TEMPERATURES = np.geomspace(1e-3, 1e3, 121)
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)
#: The limit of familiarity lies BELOW standard deviations under all but KNOWN of the held-back texts, but not beyond halfway to FOREIGN of those of left-out languages (the others may be mislabelled).
KNOWN, FOREIGN, BELOW = 0.002, 0.75, 0.5
#: Shares of a language's words and of its texts that make a word common, and of its texts that make a letter its own.
COMMON, NEEDED, LETTER = 0.0025, 0.03, 0.05
#: Rates of common words in other languages, as parts of their rate; what the second ratio is granted; the log odds of a foreign letter.
CARRY, CLOSE, GRANTED, FOREIGN_LETTER = 0.2, 0.45, 2.5, -3.0
HELD_OUT, FOLDS = 2, 4
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all subwords of the texts, one text after the other, and how many each text has."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("".join(f"\0{t}\0" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.r_[0, np.cumsum([len(t) + 2 for t in low])]
    letter = letters()[code]
    sym = code * letter
    for n in ORDERS:
        m = max(0, len(code) - n + 1)
        ok = letter[:m] if n == 1 else letter[:m] | letter[1 : m + 1] if n == 2 else letter[1 : m + 1]
        for k in range(2, n - 1):
            ok = ok & letter[k : k + m]
        at = np.nonzero(ok)[0]
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= sym[at + k]
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(16)
        yield h, np.diff(np.searchsorted(at, edge))


@dataclass
class Model:
    languages: list[str]
    #: By bucket: what a subword adds to the logits, or its embedding if `head` makes logits of the mean; last, its log frequency.
    rows: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 1), np.float32))
    head: np.ndarray | None = None
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    power: float = 0.0
    #: By language.
    usual: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Variance of the familiarity between texts, and of a single subword's.
    spread: tuple[float, float] = (1.0, 1.0)
    limit: float = -math.inf
    slope: float = 1.0
    #: By common word of any language and by language, what it adds to both log likelihood ratios; what any word does; the languages' letters.
    common: dict[str, np.ndarray] = field(default_factory=dict)
    missed: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    letters: list[frozenset[str]] = field(default_factory=list)

    def means(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The means of `rows` over the subwords of each text, and the number of subwords (0: no letter)."""
        n, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), self.rows.shape[1]))
        for b, k in subwords(texts):
            some = np.nonzero(k)[0]
            if some.size:
                out[some] += np.add.reduceat(self.rows[b], np.cumsum(k[some]) - k[some], axis=0)
            n += k
        return out / np.maximum(n, 1)[:, None], n

    def logits(self, mean: np.ndarray) -> np.ndarray:
        return (mean[:, :-1] if self.head is None else mean[:, :-1] @ self.head.T) + self.bias

    def familiarity(self, mean: np.ndarray, n: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Standard deviations from what is usual for the language of each text."""
        return (mean[:, -1] - self.usual[language]) / np.sqrt(self.spread[0] + self.spread[1] / np.maximum(n, 1))

    def evidence(self, text: str) -> np.ndarray:
        """For each language the log odds, by its common words and its letters, that a text is in it."""
        low = text.lower()
        found = WORD.findall(low)
        ratios = len(found) * self.missed
        for w in found:
            if w in self.common:
                ratios = ratios + self.common[w]
        marked = [] if low.isascii() else [c for c in low if c.isalpha() and not c.isascii()]
        odd = np.array([sum(c not in own for c in marked) for own in self.letters])
        return np.minimum(ratios[:, 0], ratios[:, 1] + GRANTED) + FOREIGN_LETTER * odd

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1: unknown) and the score."""
        if not self.languages:
            return np.full(len(texts), -1), np.zeros(len(texts))
        mean, n = self.means(texts)
        p = softmax(self.logits(mean) * (np.maximum(n, 1) ** self.power / self.temperature)[:, None])
        best = p.argmax(1)
        known = 1 / (1 + np.exp(-np.clip(self.slope * (self.familiarity(mean, n, best) - self.limit), -30, 30)))
        own = p[np.arange(len(p)), best]
        for i in np.nonzero((n > 0) & (own * known < CERTAIN))[0].tolist():
            odds = self.evidence(texts[i])
            by_words = softmax((np.log(p[i] + 1e-300) + odds)[None])[0]
            k = int(by_words.argmax())
            score = by_words[k] / (1 + math.exp(-min(30.0, max(-30.0, odds[k]))))
            if score > own[i] * known[i]:
                best[i], own[i], known[i] = k, score, 1.0
        return np.where(n > 0, best, -1), np.where(n > 0, own * known, 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def frequencies(feats: list[tuple[np.ndarray, np.ndarray, int]], y: np.ndarray, languages: int) -> np.ndarray:
    """(BUCKETS, languages): log frequencies of subwords by language, of texts (buckets, shares of the text's subwords, their number)."""
    total = np.full((BUCKETS, languages), RARE)
    for (b, c, _), k in zip(feats, y, strict=True):
        total[b, k] += c
    return np.log(total / total.sum(0))


WORD = re.compile(r"[^\W\d_]+")


def common_words(model: Model, sample: list[tuple[str, str]]) -> None:
    """Counts the common words and the letters of each language."""
    n = len(model.languages)
    words, texts, letters = [Counter() for _ in range(n)], [Counter() for _ in range(n)], [Counter() for _ in range(n)]
    many = [0] * n
    for t, y in sample:
        k = model.languages.index(y)
        own = Counter(WORD.findall(t.lower()))
        words[k].update(own)
        texts[k].update(own.keys())
        letters[k].update(c for c in set(t.lower()) if not c.isascii())
        many[k] += 1
    total = [sum(w.values()) for w in words]
    share = [{w: c / total[k] for w, c in words[k].items() if c >= COMMON * total[k] and texts[k][w] >= NEEDED * many[k]} for k in range(n)]
    model.missed = np.zeros((n, 2))
    for k in range(n):
        chance = {w: (min(f, max(CARRY * f, *(0.5 * share[j].get(w, 0.0) for j in range(n) if j != k), 0.0)), CLOSE * f) for w, f in share[k].items()}
        left = 1 - min(0.99, sum(share[k].values()))
        for i in range(2):
            model.missed[k, i] = math.log(left / (1 - min(0.99, sum(c[i] for c in chance.values()))))
        for w, f in share[k].items():
            own = model.common.setdefault(w, np.zeros((n, 2)))
            own[k] = [math.log(f / c) for c in chance[w]] - model.missed[k]
    model.letters = [frozenset(c for c, m in letters[k].items() if m >= LETTER * many[k]) for k in range(n)]


def train(sample: list[tuple[str, str]]) -> Model:
    """A model of a sample of (text, language)."""
    sample = [(t, y) for t, y in sample if any(map(str.isalpha, t))]
    model = Model(sorted({y for _, y in sample}))
    if not model.languages:
        return model
    rng = np.random.default_rng(0)
    y = np.array([model.languages.index(x) for _, x in sample])
    feats = []
    for t, _ in sample:
        b, c = np.unique(np.concatenate([b for b, _ in subwords([t])]), return_counts=True)
        feats.append((b, (c / c.sum()).astype(np.float32), int(c.sum())))
    order = rng.permutation(len(sample))
    fit, check = (order[len(order) // 5 :], order[: len(order) // 5]) if len(order) >= 50 else (order, order)
    emb, w, bias = descend(feats, y, fit, len(model.languages), rng)
    log = frequencies([feats[i] for i in fit], y[fit], len(model.languages))
    body = emb @ w.T if len(model.languages) <= DIM else emb
    model.head = None if len(model.languages) <= DIM else w
    model.rows, model.bias = np.c_[body, log.max(1)].astype(np.float32), bias.astype(float)
    common_words(model, sample)
    certainty(model, [sample[i][0] for i in check], y[check], rng)
    left_out(model, [feats[i] for i in check], y[check], log)
    return model


def descend(feats: list[tuple[np.ndarray, np.ndarray, int]], y: np.ndarray, fit: np.ndarray, languages: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, weights and bias after EPOCHS of stochastic gradient descent on the texts `fit`."""
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((languages, DIM), np.float32), np.zeros(languages, np.float32)
    batch, total, seen = 16, EPOCHS * max(len(fit), 4000), 0
    while seen < total:
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            rate = RATE * (1 - min(seen, total) / total)
            seen += len(rows)
            b = np.concatenate([feats[i][0] for i in rows])
            c = np.concatenate([feats[i][1] for i in rows])[:, None]
            n = np.array([len(feats[i][0]) for i in rows])
            h = np.add.reduceat(emb[b] * c, np.cumsum(n) - n, axis=0)
            g = softmax(h @ w.T + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            back = g @ w
            w -= rate * (g.T @ h)
            bias -= rate * 0.1 * g.mean(0)
            np.add.at(emb, b, -rate * c * np.repeat(back, n, axis=0) * 8)
    return emb, w, bias


def certainty(model: Model, texts: list[str], y: np.ndarray, rng: np.random.Generator) -> None:
    """Fits temperature and power on texts and on pieces of them."""
    own, of = list(texts), list(y)
    for t, k in zip(texts, y, strict=True):
        words = t.split()
        cuts = [words[int(rng.integers(len(words)))][:n] for n in LETTERS]
        for n in PIECES:
            at = int(rng.integers(max(1, len(words) - n + 1)))
            cuts.append(" ".join(words[at : at + n]))
        for piece in cuts:
            if any(map(str.isalpha, piece)):
                own.append(piece)
                of.append(k)
    parts = [model.means(own[s]) for s in steps([len(t) for t in own])]
    z, n, of = model.logits(np.concatenate([m for m, _ in parts])), np.concatenate([k for _, k in parts]), np.array(of)
    loss = {}
    for power in POWERS:
        scaled = z * (n**power)[:, None]
        for t in TEMPERATURES:
            loss[power, t] = -np.log(softmax(scaled / t)[np.arange(len(of)), of] + 1e-12).mean()
    model.power, model.temperature = map(float, min(loss, key=loss.get))


def left_out(model: Model, feats: list[tuple[np.ndarray, np.ndarray, int]], y: np.ndarray, log: np.ndarray) -> None:
    """Fits what is usual, and the limit between held-back texts and those of a language left out."""
    best = log.max(1)
    mean = np.array([c @ best[b] for b, c, _ in feats])
    inner = np.array([c @ best[b] ** 2 for b, c, _ in feats]) - mean**2
    n = np.array([k for *_, k in feats])
    model.usual = np.array([np.median(mean[y == k]) if (y == k).any() else np.median(mean) for k in range(log.shape[1])])
    single = float(inner.mean()) + 1e-6
    between = float(np.mean(np.maximum(0, (mean - model.usual[y]) ** 2 - single / n)))
    model.spread = (max(between, (STRANGE * float(model.usual.mean() - log.min())) ** 2), single)
    scale = np.sqrt(model.spread[0] + model.spread[1] / n)
    known = float(np.quantile((mean - model.usual[y]) / scale, KNOWN))
    foreign = []
    for k in range(log.shape[1]) if log.shape[1] > 1 else ():
        rest = np.delete(log, k, axis=1)
        for i in np.nonzero(y == k)[0]:
            b, c, _ = feats[i]
            by = c @ rest[b]  # what the text looks like to the other languages
            usual = np.delete(model.usual, k)[int(by.argmax())]
            foreign.append((float(c @ rest[b].max(1)) - usual) / scale[i])
    other = float(np.quantile(foreign, FOREIGN)) if foreign else -math.inf
    model.limit = known - min(BELOW, max(0.0, known - other) / 2)
    model.slope = math.log(999) / max(known - model.limit, 1.0)


def learn(docs: DataFrame) -> Model:
    """A model of docs (doc_id, text, lang), by the labelled rows that are not held out."""
    own = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (id_bucket("doc_id", FOLDS).isNull() | (id_bucket("doc_id", FOLDS) != HELD_OUT)))
    own = own.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "lang", "text")
    there = own.groupBy("lang").count().collect()  # a row for each language
    if not there:
        return Model([])
    each = max(SAMPLE / len(there), EACH)
    rows = hash_sample(own, ("doc_id", "text"), "lang", {r.lang: (r["count"], each) for r in there}, "langid", most=int(2 * each * len(there))).collect()
    return train(sorted((r.text, r.lang) for r in rows))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.languages, UNKNOWN], object)
        for b in (s for batch in batches for s in text_steps(batch)):
            best, p = m.predict([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(p), pa.array((best < 0) | (p < CERTAIN))], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language is unknown or uncertain."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))
    return keep_rows(docs, lambda: lambda texts: sent.value.predict(texts)[1] >= CERTAIN)


def op5_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", F.coalesce(id_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
