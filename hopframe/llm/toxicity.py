"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

Words are compared by the subsequences of three and four characters they share
within a span of six, each weighed by 0.6 to the number of skipped characters, so an
insult with inserted, left-out or parted characters keeps most of its kernel
with the plain one.  Words are normalized by their length.  The SVM is trained
on sentences of labelled documents, as bags of words: a sentence scores as its
worst word.  First, each toxic sentence puts forward the word whose subsequences
toxic sentences hold most in excess of clean ones; it is an example if it
exceeds the worst words of 99 in 100 clean sentences, whatever the number of
sentences.  Later rounds add the worst word of each toxic document, where the
model agrees, and the worst words of clean ones as counter-examples.  The kernel
does not cross words, so an insult of several innocent words is not seen.  With
Nystroem features the decision is linear in the subsequences; it is folded into
one table over all subsequences, which scores a distinct word in about a
microsecond.  A logistic curve over a document's worst word gives the score.

Whole texts are scored: every distinct word, and runs of single characters
joined.  Words beyond 24 characters are scored in overlapping pieces.

Bounds of the fit: ``docs_per_class`` labelled documents of each class and
``sentences_per_doc`` sentences of each, of at most ``sentence_chars``; of their
distinct words the SVM sees the EXAMPLES most frequent examples, COUNTERS drawn
clean words and in each round the EXAMPLES worst clean ones.  The
bounded sample is fitted in one task of an executor, in an order of its own, so
that a retry gives the same model; only the model comes to the driver.

Nulls: null and empty texts have no word and the curve's lowest score.  A
document whose labels differ counts as toxic.  Without both classes all
scores are 0.  Documents that share an id share its label, and the fit sees one
of them.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm._sample import sample_per_class

DOCS_PER_CLASS = 2000
SENTENCES_PER_DOC = 40
SENTENCE_CHARS = 300
LANDMARKS = 400
SPAN, DECAY = 5, 0.6
SYMBOLS = 64
LONGEST = 24
CUT = 0.7
EXAMPLES, COUNTERS = 4_000, 8_000
SHRINK = 3.0  # sentences' worth of weight that a subsequence must outdo to count as telling
CLEAN_SHARE = 0.99

# Offsets of the further characters of a subsequence, and its weight: three characters, and four.
PATTERNS = [((j, k), DECAY ** (k - 2)) for k in range(2, SPAN + 1) for j in range(1, k)]
PATTERNS += [((i, j, k), DECAY ** (k - 3)) for k in range(3, SPAN + 1) for j in range(2, k) for i in range(1, j)]
SLOTS = SYMBOLS**3  # of each kind; four characters share slots by a hash


def symbol_table() -> np.ndarray:
    """Small numbers for characters: letters, the two word ends, digits, and the rest by remainder."""
    table = (30 + np.arange(0x110000) % (SYMBOLS - 30)).astype(np.int64)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord("^")], table[ord("$")] = 27, 28
    table[ord("0") : ord("9") + 1] = 29
    return table


SYMBOL_OF = symbol_table().astype(np.uint8)


class Words:
    """Codes of the subsequences of words of one length."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols

    def codes(self, words: list[str]):
        """(codes, weight) of each way to pick three or four characters within the span; rows are words."""
        flat = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        s = self.symbols[flat].reshape(len(words), -1).astype(np.int64)
        width = s.shape[1]
        for offsets, weight in PATTERNS:
            last = offsets[-1]
            if width > last:
                code = s[:, : width - last]
                for o in offsets:
                    code = code * SYMBOLS + s[:, o : width - last + o]
                yield (code if len(offsets) == 2 else SLOTS + ((code * 40503) >> 6) % SLOTS), weight


def length_norm(n: int) -> float:
    """The norm of a word of n characters whose subsequences all differ; any positive function keeps a kernel a kernel."""
    return float(np.sqrt(sum(max(0, n + 2 - offsets[-1]) * w * w for offsets, w in PATTERNS))) or 1.0


NOT_WORD = re.compile(r"[\W_]+")
SPACED = re.compile(r"(?<!\S)\S(?:[ .\-_*]\S){3,}(?!\S)")


def plain(token: str) -> str:
    return NOT_WORD.sub("", token)


def tokens_of(text: str) -> set[str]:
    """Distinct raw tokens, and runs of parted single characters joined."""
    low = text.lower()
    found = set(low.split())
    found.update(NOT_WORD.sub("", m.group()) for m in SPACED.finditer(low))
    return found


def pieces(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


class Model:
    """A table over subsequences, a bias and a logistic curve."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, middle: float):
        self.table, self.bias, self.slope, self.middle = table, bias, slope, middle
        self.words = Words(SYMBOL_OF)
        self.seen: dict[str, float] = {}

    def margins(self, words: list[str]) -> np.ndarray:
        """Signed distance of each plain word."""
        out = np.full(len(words), -9.0)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, rows in by_length.items():
            if 2 <= n <= LONGEST:
                for at in range(0, len(rows), 20_000):
                    some = rows[at : at + 20_000]
                    total = sum(self.table[codes].sum(axis=1) * weight for codes, weight in self.words.codes([words[i] for i in some]))
                    out[some] = total / length_norm(n) + self.bias
            elif n > LONGEST:
                for i in rows:
                    out[i] = max(self.margins(pieces(words[i])))
        return out

    def text_margins(self, texts: list[str | None]) -> np.ndarray:
        """The worst word of each text; -9 without words."""
        sets = [tokens_of(t) if t else () for t in texts]
        new = list({t for s in sets for t in s if t not in self.seen})
        if len(self.seen) > 1_500_000:  # a memory bound: words are scored again, not skipped
            self.seen = {}
            new = list({t for s in sets for t in s})
        self.seen.update(zip(new, self.margins([plain(t) for t in new]).tolist(), strict=True))
        return np.array([max((self.seen[t] for t in s), default=-9.0) for s in sets])

    def scores(self, margins: np.ndarray) -> np.ndarray:
        if not self.slope:  # nothing was learned
            return np.zeros(len(margins))
        return 1 / (1 + np.exp(-np.clip(self.slope * (margins - self.middle), -500, 500)))


def _kernel(words: list[str], maker: Words, columns: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark; ``columns`` numbers the landmarks' subsequences, the last stands for all others."""
    out = np.zeros((len(words), features.shape[1]), dtype=np.float32)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, rows in by_length.items():
        for at in range(0, len(rows), 200):
            some = rows[at : at + 200]
            for codes, weight in maker.codes([words[i] for i in some]):
                out[some] += features[columns[codes]].sum(axis=1) * weight
        out[rows] /= length_norm(n)
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 25) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        active = y * (x @ w) < 1
        square, target = ridge.copy(), np.zeros(x.shape[1])
        rows = np.flatnonzero(active)
        for at in range(0, len(rows), 2000):
            some = rows[at : at + 2000]
            xa = x[some].astype(np.float64)
            weighed = xa * cost[some][:, None]
            square += weighed.T @ xa
            target += weighed.T @ y[some]
        new = np.linalg.solve(square, target)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def fit(bags: list[tuple[int, list[str]]], odds_of_all: float | None = None, rounds: int = 4, seed: int = 7) -> Model:
    """Train on (label, sentences) of documents.

    A sentence counts once however many documents copy it, and as clean if a
    clean document holds it.  ``odds_of_all`` are the toxic to the clean
    documents where the sample was drawn; the curve is moved to them.
    """
    nothing = Model(np.zeros(2 * SLOTS, dtype=np.float32), 0.0, 0.0, 0.0)
    labels = np.array([label for label, _ in bags])
    if not len(bags) or labels.min() == labels.max():
        return nothing
    label_of: dict[str, int] = {}
    for label, sentences in bags:
        for s in sentences:
            label_of[s] = min(label, label_of.get(s, 1))
    one: dict[str, str] = {}  # a word is held once, however many sentences have it
    held = {s: tuple({one.setdefault(p, p) for t in tokens_of(s) if len(w := plain(t)) >= 2 for p in pieces(w)}) for s in label_of}
    docs = [(label, sorted(set().union(*(held[s] for s in sentences)))) for label, sentences in bags if sentences]
    docs = [d for d in docs if d[1]]
    words_in: list[Counter] = [Counter(), Counter()]
    for s, label in label_of.items():
        words_in[label].update(held[s])
    clean = sorted(words_in[0])
    every = sorted(words_in[0] | words_in[1])
    rng = np.random.default_rng(seed)
    first = _evidence(words_in)
    margin = dict(zip(every, first.margins(every).tolist(), strict=True))
    worst_of = {s: max(sorted(words), key=margin.__getitem__) for s, words in held.items() if words}
    usual = [margin[w] for s, w in worst_of.items() if not label_of[s]]
    floor = max(0.0, float(np.quantile(usual, CLEAN_SHARE))) if usual else 0.0
    examples = Counter(w for s, w in worst_of.items() if label_of[s] and margin[w] > floor)
    # Insults with one strange character are examples too, of less weight.
    for w in sorted(w for w, k in examples.items() if k >= 2):
        for at in range(2, len(w) - 1):
            examples.setdefault(w[:at] + chr(int(rng.integers(ord("a"), ord("z") + 1))) + w[at:], 1)
    counter = set(rng.choice(clean, size=min(len(clean), COUNTERS), replace=False).tolist()) if clean else set()
    maker = Words(SYMBOL_OF)
    model = None
    for _ in range(rounds):
        positive = [w for w in sorted(examples, key=lambda w: (-examples[w], w)) if words_in[0][w] * 20 <= words_in[1][w]]
        negative = sorted(counter - set(positive))
        if not positive or not negative:
            break
        model = _train(positive[:EXAMPLES], negative, examples, maker, rng)
        margin = dict(zip(every, model.margins(every).tolist(), strict=True))
        # The worst word of a toxic sentence or document joins the examples only if the model agrees.
        found = Counter(max(words, key=margin.__getitem__) for label, words in docs if label)
        examples = examples | Counter({w: k for w, k in found.items() if margin[w] > 0.5})
        hard = sorted((w for w in clean if margin[w] > -0.9), key=margin.__getitem__, reverse=True)[:EXAMPLES]
        counter.update(hard)
    if model is None:
        return nothing
    worst = np.array([max(margin[w] for w in words) for _, words in docs])
    model.slope, model.middle = _curve(worst, np.array([label for label, _ in docs]))
    if odds_of_all:
        model.middle += float(np.log(labels.sum() / (1 - labels).sum() / odds_of_all)) / model.slope
    return model


def _evidence(words_in: list[Counter]) -> Model:
    """Squared log ratio, with its sign, of each subsequence in toxic to clean sentences; rare ones are drawn to 0."""
    maker = Words(SYMBOL_OF)
    sums = []
    for counts in words_in:
        total = np.zeros(2 * SLOTS)
        by_length: dict[int, list[str]] = {}
        for w in sorted(counts):
            by_length.setdefault(len(w), []).append(w)
        for words in by_length.values():
            for at in range(0, len(words), 20_000):
                some = words[at : at + 20_000]
                times = np.array([counts[w] for w in some], dtype=np.float64)
                for codes, _ in maker.codes(some):
                    total += np.bincount(codes.ravel(), weights=np.repeat(times, codes.shape[1]), minlength=2 * SLOTS)
        sums.append(total)
    expected = sums[0] * (sums[1].sum() / max(1.0, sums[0].sum()))
    ratio = np.log((sums[1] + SHRINK) / (expected + SHRINK))
    return Model((np.sign(ratio) * ratio**2).astype(np.float32), 0.0, 1.0, 0.0)


def _train(positive: list[str], negative: list[str], examples: Counter, maker: Words, rng: np.random.Generator) -> Model:
    """One SVM over Nystroem features, folded into a table over subsequences."""
    half = LANDMARKS // 2
    marks = positive[: half // 2] + [positive[i] for i in np.linspace(half // 2, len(positive) - 1, half // 2).astype(int) if half // 2 < len(positive)]
    marks = list(dict.fromkeys(marks)) + rng.choice(negative, size=min(half, len(negative)), replace=False).tolist()
    used = sorted({int(c) for w in marks for codes, _ in maker.codes([w]) for c in np.unique(codes)})
    columns = np.full(2 * SLOTS, len(used), dtype=np.int32)
    columns[used] = np.arange(len(used))
    features = np.zeros((len(used) + 1, len(marks)), dtype=np.float32)
    for i, w in enumerate(marks):
        for codes, weight in maker.codes([w]):
            np.add.at(features[:, i], columns[codes[0]], weight / length_norm(len(w)))
    features[-1] = 0
    values, vectors = np.linalg.eigh(_kernel(marks, maker, columns, features).astype(np.float64))
    root = vectors @ np.diag(np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0.0)) @ vectors.T
    x = _kernel(positive + negative, maker, columns, features) @ root.astype(np.float32)
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    cost = np.array([20.0 * min(10, examples[w]) for w in positive] + [8.0] * len(negative))
    weights = _svm(x, y, cost)
    table = np.zeros(2 * SLOTS, dtype=np.float32)
    table[used] = (features[:-1] @ (root @ weights[:-1])).astype(np.float32)
    return Model(table, float(weights[-1]), 1.0, 0.0)


def _curve(margin: np.ndarray, label: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Logistic curve over worst words, targets softened by Platt's rule."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(float(w[0]), 1e-3)
    return slope, -float(w[1]) / slope


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", docs_per_class: int = DOCS_PER_CLASS) -> Model:
    """Fit on a bounded sample of the labelled documents given."""
    marked = labels.groupBy(key).agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    known = marked.join(docs.select(key).distinct(), key, "left_semi")
    number = dict(known.groupBy("toxic").count().collect())  # two rows
    chosen = sample_per_class(known, "toxic", key, docs_per_class)
    sentences = F.filter(F.split(F.col(text), r"[.!?\n]+"), lambda s: F.trim(s) != "")
    cut = F.flatten(F.transform(sentences, lambda s: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(s) - 1) / SENTENCE_CHARS).cast("int")),
        lambda i: F.substring(s, i * SENTENCE_CHARS + 1, F.lit(SENTENCE_CHARS)),
    )))
    some = F.slice(F.array_sort(F.transform(cut, lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s")))), 1, SENTENCES_PER_DOC)
    sampled = docs.where(F.col(text).isNotNull()).join(F.broadcast(chosen), key).select(key, "toxic", some.alias("s"))
    # One row of each id, so that a much repeated id leaves the sample bounded.
    rows = sampled.groupBy(key, "toxic").agg(F.max("s").alias("s")).select("toxic", F.transform("s", lambda s: s["s"]).alias("s"))
    odds_of_all = number.get(1, 0) / number[0] if number.get(0) else None

    def run(batches):
        bags = [bag for batch in batches for bag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        model = fit(sorted(bags), odds_of_all)
        values = [model.table.tobytes(), model.bias, model.slope, model.middle]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["subsequences", "bias", "slope", "middle"])

    fitted = rows.repartition(1).mapInArrow(run, "subsequences binary, bias double, slope double, middle double").head()
    if fitted is None:
        return fit([])
    return Model(np.frombuffer(fitted["subsequences"], dtype=np.float32), fitted["bias"], fitted["slope"], fitted["middle"])


def add_scores(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score of each whole text; a column that has the score's name is replaced."""
    if column == text:
        raise ValueError(f"the score would replace the text column {text!r}")
    docs = docs.drop(column)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text)
    table, rest = model.table, (model.bias, model.slope, model.middle)

    def run(batches):
        judge = Model(table, *rest)
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                margins = judge.text_margins(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(judge.scores(margins))], [*part.schema.names, column])

    return docs.mapInArrow(run, f"{fields}, `{column}` double")
