"""Quality grades by ordinal regression with a cumulative logit link.

P(grade > j) = sigmoid(s(x) - t_j): one weight vector over hashed features of
the whole text, and ordered thresholds.  Features are the presence of hashed
words, the shares of hashed word shapes (classes of the first, the last two
characters, capitals, length), and binned figures of the text: share of distinct words, of
distinct lines, mean word length.  The expected grade is the sum of P(grade >
j); the tail probability P(grade >= best) selects.

The fit uses at most ``docs_per_grade`` documents of each grade, one row of
each id, in one task of an executor; only the model comes to the driver.
Thresholds are kept in order by summing positive steps.

Nulls: a null or empty text has only its figures' bins.  Rows without a grade are not learned
from.  Without two grades every document has the mean grade 0 and tail 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopframe.llm._sample import sample_per_class
from hopframe.llm._text import Tokens, pack, row_chunks, space_words, text_buffers, unpack

WORD_BITS, SHAPE_BITS = 18, 12
FIGURES = 3 * 16
SHARES = 15  # a shape's share counts in steps of 1/15
DOCS_PER_GRADE = 2500
SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS) + FIGURES


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Graded ratings of the labels: 0 bad, 1 good but toxic, 2 good."""
    return F.when(F.col(quality) == 1, F.when(F.col(toxic) == 1, 1).otherwise(2)).when(F.col(quality) == 0, 0).cast("int")


def _classes() -> np.ndarray:
    kinds = np.full(256, 3, dtype=np.int64)
    for first, last, kind in (("a", "z", 0), ("A", "Z", 1), ("0", "9", 2)):
        kinds[ord(first) : ord(last) + 1] = kind
    for i, c in enumerate("!?.,;:#*$%&|<>@/-_()'\"="):
        kinds[ord(c)] = 4 + i
    kinds[128:] = 0
    return kinds


def features(raw: np.ndarray, offsets: np.ndarray):
    """For each text: indices and values of its features."""
    plain = np.arange(256, dtype=np.uint8)
    kinds = _classes()
    for a, b in row_chunks(offsets, 1 << 20):
        bounds = offsets[a : b + 1]
        t = Tokens(raw[bounds[0] : bounds[-1]], bounds - bounds[0], space_words(), plain)
        words = t.hashes()
        data = t.bytes
        kind = kinds[data] if len(data) else np.zeros(0, dtype=np.int64)
        capitals = np.concatenate([[0], np.cumsum(kind == 1)])
        ends, starts = t.ends, t.starts
        length = ends - starts
        shape = kind[starts] * 31 + kind[ends - 1] if len(starts) else np.zeros(0, dtype=np.int64)
        if len(starts):
            shape = (shape * 31 + kind[np.maximum(ends - 2, starts)]) * 5 + np.minimum(4, (capitals[ends] - capitals[starts]) * 4 // length)
            shape = (shape * 7 + np.minimum(6, length // 4)) * 2654435761 % (1 << 32) >> (32 - SHAPE_BITS)
        slots = (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        for r in range(b - a):
            mine = slice(t.first[r], t.first[r + 1])
            n = t.first[r + 1] - t.first[r]
            distinct = np.unique(words[mine])
            lines = bytes(data[bounds[r] - bounds[0] : bounds[r + 1] - bounds[0]]).split(b"\n")
            figures = [
                len(distinct) * 15 // n if n else 0,
                len(set(lines)) * 15 // len(lines),
                min(15, int(length[mine].mean())) if n else 0,
            ]
            shapes, times = np.unique(shape[mine], return_counts=True)
            yield (
                np.concatenate([np.unique(slots[mine]), (1 << WORD_BITS) + shapes, (1 << WORD_BITS) + (1 << SHAPE_BITS) + np.arange(3) * 16 + figures]),
                np.concatenate([np.full(len(np.unique(slots[mine])), SHARES), np.maximum(1, times * SHARES // max(1, n)), np.full(3, SHARES)]),
            )


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold."""
        if not len(self.thresholds):
            return np.zeros(1)
        s = float((self.weights[index] * value).sum()) / SHARES
        return 1 / (1 + np.exp(-np.clip(s - self.thresholds, -500, 500)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], shares: dict[int, float], steps: int = 150, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Adam on the mean log-likelihood, the sampled grades weighed to their ``shares`` of all; words seen in fewer than four texts stay at zero."""
    grades = np.array([g for g, _, _ in rows], dtype=np.int64)
    top = int(grades.max()) if len(rows) else 0
    if top < 1 or grades.min() == top:
        return Model(np.zeros(SIZE, dtype=np.float32), np.zeros(0))
    index = np.concatenate([i for _, i, _ in rows])
    value = np.concatenate([v for _, _, v in rows]).astype(np.float64) / SHARES
    owner = np.repeat(np.arange(len(rows)), [len(i) for _, i, _ in rows])
    often = np.bincount(index, minlength=SIZE) >= 4
    keep = often[index]
    index, value, owner = index[keep], value[keep], owner[keep]
    w, steps_up, first = np.zeros(SIZE), np.zeros(top - 1), -0.5
    moments = [np.zeros(SIZE + top), np.zeros(SIZE + top)]
    drawn = np.bincount(grades, minlength=top + 1) / len(rows)
    balance = (np.array([shares.get(g, 0.0) for g in range(top + 1)]) / np.maximum(drawn, 1e-12))[grades]
    for step in range(1, steps + 1):
        t = first + np.concatenate([[0.0], np.cumsum(np.exp(steps_up))])
        s = np.bincount(owner, w[index] * value, minlength=len(rows))
        upper = np.concatenate([t, [np.inf]])[grades]
        lower = np.concatenate([[-np.inf], t])[grades]
        fu, fl = _sigmoid(upper - s), _sigmoid(lower - s)
        mass = np.maximum(fu - fl, 1e-12)
        du, dl = fu * (1 - fu) / mass * balance / len(rows), fl * (1 - fl) / mass * balance / len(rows)
        gw = np.bincount(index, (du - dl)[owner] * value, minlength=SIZE) + decay * w
        gt = np.array([-(du[grades == j].sum()) + dl[grades == j + 1].sum() for j in range(top)])
        later = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([gw, [later[0]], later[1:] * np.exp(steps_up)])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.999 * moments[1] + 0.001 * g * g
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
        w -= move[:SIZE]
        first -= move[SIZE]
        steps_up -= move[SIZE + 1 :]
    return Model(w.astype(np.float32), first + np.concatenate([[0.0], np.cumsum(np.exp(steps_up))]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", docs_per_grade: int = DOCS_PER_GRADE) -> Model:
    """``labels`` holds (id, grade); of rows with several grades the lowest counts."""
    graded = labels.where("grade is not null").groupBy(key).agg(F.min("grade").alias("grade"))
    chosen = sample_per_class(graded.join(docs.select(key).distinct(), key, "left_semi"), "grade", key, docs_per_grade)
    # One row of each id, so that a much repeated id leaves the sample bounded: the least text, found by its digest.
    sampled = docs.join(F.broadcast(chosen), key).select(key, "grade", F.struct(F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"), F.col(text).alias("text")).alias("__row"))
    rows = sampled.groupBy(key, "grade").agg(F.min("__row").alias("__row")).select(F.col(key).cast("string").alias("id"), "grade", "__row.text")
    numbers = dict(graded.groupBy("grade").count().collect())  # one row per grade
    shares = {g: n / sum(numbers.values()) for g, n in numbers.items()}

    def run(batches):
        found = []
        for batch in batches:
            got = [(pack(i), pack(v)) for i, v in features(*text_buffers(batch.column(2)))]
            found += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), got, strict=True)
        found.sort(key=lambda r: r[0])
        model = fit([(g, unpack(i).astype(np.int64), unpack(v).astype(np.int64)) for _, g, (i, v) in found], shares)
        values = [model.weights.tobytes(), model.thresholds.astype(np.float64).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["weights", "thresholds"])

    fitted = rows.repartition(1).mapInArrow(run, "weights binary, thresholds binary").head()
    if fitted is None:
        return fit([], {})
    return Model(np.frombuffer(fitted["weights"], dtype=np.float32), np.frombuffer(fitted["thresholds"], dtype=np.float64))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", cut: float = 0.5) -> DataFrame:
    """The kept columns with expected_grade, tail (probability of the best grade) and selected."""
    kept = docs.select(*keep, F.col(text).alias("__text"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    weights, thresholds = model.weights, model.thresholds

    def run(batches):
        own = Model(weights, thresholds)
        for batch in batches:
            tails = [own.tails(*x) for x in features(*text_buffers(batch.column(batch.num_columns - 1)))]
            grade, tail = [float(x.sum()) for x in tails], [float(x[-1]) for x in tails]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(grade, pa.float64()), pa.array(tail, pa.float64()), pa.array([x >= cut for x in tail], pa.bool_())],
                [*keep, "expected_grade", "tail", "selected"],
            )

    return kept.mapInArrow(run, f"{columns}, expected_grade double, tail double, selected boolean")
