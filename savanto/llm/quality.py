"""Quality scores by Naive Bayes support vectors.

A text is the set of its n-grams: of its lower-case words (one and two), and of the shapes of its words (one to
three), which keep case, digits and marks and tell when a word repeats the one before. N-grams are hashed to
``Training.buckets`` indicators. Each indicator is scaled by its log-count ratio: the logarithm of how much
oftener it stands in good texts than in others. On these rows, brought to length one, a linear model with hinge
loss is fitted by dual coordinate descent and drawn towards its mean weight. A sigmoid, fitted on labelled
rows that the model has not seen, turns its output into a score.

At most ``Training.rows`` labelled rows are used, taken in hash order of their ids; they are the only sample,
and the fit is one task over their indicators. Scoring is one pass over whole texts and exchanges nothing.

Null and empty texts, like very long ones, get a score like any other. Labels that are null are not used; of
labels that repeat an id the largest counts; rows that repeat an id are scored each. If either label is missing
in a part, all scores are the share of good rows that was found (0 without any). Columns named like the results are replaced, all
others are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savanto.llm.common import slices, whole_text
from savanto.session import written


@dataclass(frozen=True)
class Training:
    """Bounds and parameters of the fit."""

    rows: int = 8_000
    #: Indicators, as a power of two, and texts that must have one for it to count.
    bits: int = 18
    least_texts: int = 2
    #: Added to the counts of each class; cost of an error; rounds over the rows; pull away from the mean weight.
    smoothing: float = 1.0
    cost: float = 10.0
    rounds: int = 20
    own: float = 0.5
    threshold: float = 0.7


#: Words that one worker remembers.
KNOWN_WORDS = 1 << 18
#: Hash of the shape of a word that repeats the one before.
AGAIN = np.uint64(xxhash.xxh3_64_intdigest(b"shape of a repeated word"))

_known: dict[str, tuple[int, int]] = {}
_CLASSES = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+", re.DOTALL))


def shape(word: str) -> str:
    """Runs of letters as ``A`` (capitals), ``Aa`` or ``a``, of digits as ``0``; a mark that repeats stands there twice."""
    letters = _CLASSES[0].sub(lambda m: "a" if (s := m[0]).islower() else "A" if s.isupper() and len(s) > 1 else "Aa", word)
    return _CLASSES[2].sub(r"\1\1", _CLASSES[1].sub("0", letters))


def _hashes(word: str) -> tuple[int, int]:
    found = _known.get(word)
    if found is None:
        if len(_known) >= KNOWN_WORDS:
            _known.clear()
        found = _known[word] = (xxhash.xxh3_64_intdigest("w" + word.lower()), xxhash.xxh3_64_intdigest("s" + shape(word)))
    return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def indicators(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct buckets of each text one after another, and where those of each text end."""
    lists = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(lists.flatten())
    words = coded.dictionary.to_pylist()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    at = coded.indices.to_numpy(zero_copy_only=False)
    filled = np.array([w != "" for w in words], bool)[at] if words else np.empty(0, bool)
    doc, at = doc[filled], at[filled]
    of_word = np.array([_hashes(w) for w in words], np.uint64).reshape(len(words), 2)
    word, form = of_word[at, 0], of_word[at, 1]
    next_to = doc[1:] == doc[:-1]
    form[1:][next_to & (at[1:] == at[:-1])] = AGAIN
    odd = np.uint64(0x9E3779B97F4A7C15)
    two = lambda h: _mix(h[:-1] * odd + h[1:])
    forms = two(form)
    within = doc[2:] == doc[:-2]
    parts = [
        (doc, _mix(word)), (doc[1:][next_to], two(word)[next_to]), (doc, _mix(form)), (doc[1:][next_to], forms[next_to]),
        (doc[2:][within], _mix(forms[:-1] * odd + form[2:])[within]),
    ]
    keys = np.unique(np.concatenate([(d.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits)) for d, h in parts]))
    ends = np.searchsorted(keys, np.arange(1, len(texts) + 1, dtype=np.uint64) << np.uint64(bits))
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64), ends


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, training: Training) -> np.ndarray:
    """Of each indicator; zero for those that too few texts have."""
    size = 1 << training.bits
    count = lambda which: np.bincount(np.concatenate([np.empty(0, np.int64), *[rows[i] for i in np.flatnonzero(which)]]), minlength=size)
    of_good, of_bad = count(good), count(~good)
    p, q = of_good + training.smoothing, of_bad + training.smoothing
    return np.where(of_good + of_bad >= training.least_texts, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def _scaled(row: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    values = ratios[row]
    return values / max(float(np.sqrt(values @ values)), 1e-12)


def support_vectors(rows: list[np.ndarray], good: np.ndarray, ratios: np.ndarray, training: Training) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators and the bias, by dual coordinate descent on the hinge loss."""
    x = [_scaled(r, ratios) for r in rows]
    y = np.where(good, 1.0, -1.0)
    # errors of the rarer class cost more, so that both classes weigh the same
    cost = training.cost * np.where(good, len(good) / (2 * good.sum()), len(good) / (2 * (~good).sum()))
    length = np.array([v @ v + 1.0 for v in x])
    w, bias, dual = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(1)
    for _ in range(training.rounds):
        largest = 0.0
        for i in order.permutation(len(rows)).tolist():
            gradient = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            moved = min(max(dual[i] - gradient / length[i], 0.0), cost[i]) - dual[i]
            if moved:
                dual[i] += moved
                w[rows[i]] += moved * y[i] * x[i]
                bias += moved * y[i]
                largest = max(largest, abs(moved))
        if largest < 1e-3:
            break
    mean = np.abs(w).mean()
    return training.own * w + (1 - training.own) * mean, bias


def sigmoid_of(outputs: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """``a, b`` with ``1 / (1 + exp(-(a * output + b)))`` nearest to the labels, smoothed, by Newton's method."""
    n_good, n_bad = good.sum(), (~good).sum()
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    scale = max(float(np.abs(outputs).max()), 1e-9)
    z = np.column_stack([outputs / scale, np.ones(len(outputs))])
    at = np.zeros(2)
    loss = lambda t: float(np.sum(np.logaddexp(0, z @ t) - target * (z @ t)) + 1e-6 * t @ t)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(z @ at)))
        gradient = z.T @ (p - target) + 2e-6 * at
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 2e-6 * np.eye(2), gradient)
        size = 1.0
        while loss(at - size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(at[0], 0.0) / scale, at[1]


@dataclass(frozen=True)
class Model:
    """What :func:`fit` learned: a weight for each indicator with its ratio in it; without them every score is ``prior``."""

    prior: float
    training: Training
    weights: np.ndarray | None = None
    ratios: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        keys, ends = indicators(texts, self.training.bits)
        text = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))
        # added up in the order of a text's own indicators, so that equal texts have equal scores
        sums = lambda of: np.bincount(text, of[keys].astype(np.float64), len(texts))
        output = sums(self.weights * self.ratios) / np.maximum(np.sqrt(sums(self.ratios**2)), 1e-12) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * output + self.offset, -500, 500)))


def _fitted(training: Training):
    """The one row of a model from the rows of indicators."""

    def run(rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(b, "<u4").astype(np.int64) for b in rows.column("indicators").to_pylist()]
        good = rows.column("label").to_numpy() == 1
        seen = rows.column("part").to_numpy() < 8
        pick = lambda which: [sets[i] for i in np.flatnonzero(which)]
        ratios = log_count_ratios(pick(seen), good[seen], training)
        weights, bias = support_vectors(pick(seen), good[seen], ratios, training)
        outputs = np.array([weights[s] @ _scaled(s, ratios) + bias for s in pick(~seen)])
        slope, offset = sigmoid_of(outputs, good[~seen])
        return pa.table({"weights": [weights.astype("<f4").tobytes()], "ratios": [ratios.astype("<f4").tobytes()], "bias": [bias], "slope": [slope], "offset": [offset]})

    return run


def fit(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:  # noqa: B008
    """Learn from the rows of ``labels`` (``doc_id``, ``quality``) that ``docs`` has."""
    one_each = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = one_each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, ends = indicators(part.column("text"), training.bits)
                sets = [s.astype("<u4").tobytes() for s in np.split(keys, ends[:-1])] if part.num_rows else []
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), part.column("label"), part.column("part")], ["indicators", "label", "part"])

    # at most training.rows rows of two numbers
    sample = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.select("text", "label", F.pmod(F.xxhash64("text", F.lit(7)), F.lit(10)).alias("part"))
    rows = written(sample.mapInArrow(run, "indicators binary, label int, part bigint"), "quality-indicators")
    counts = {(r["seen"], r["label"]): r["n"] for r in rows.groupBy((F.col("part") < 8).alias("seen"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, good = sum(counts.values()), sum(v for (_, label), v in counts.items() if label == 1)
    prior = good / n if n else 0.0
    if any((seen, label) not in counts for seen in (True, False) for label in (0, 1)):
        return Model(prior, training)
    kinds = "weights binary, ratios binary, bias double, slope double, offset double"
    found = written(rows.groupBy().applyInArrow(_fitted(training), kinds), "quality-model").first()
    return Model(prior, training, np.frombuffer(found["weights"], "<f4"), np.frombuffer(found["ratios"], "<f4"), found["bias"], found["slope"], found["offset"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
    kept = docs.drop("score", "predicted")
    if model.weights is None:
        out = kept.withColumn("score", F.lit(float(model.prior)))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
            done = [shared.value.scores(part.column("text")) for part in slices(rows)]
            return pd.Series(np.concatenate(done) if done else np.empty(0))

        out = kept.withColumn("score", scored(whole_text(kept["text"])))
    return out.withColumn("predicted", (F.col("score") >= model.training.threshold).cast("int"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's labels may not be learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
