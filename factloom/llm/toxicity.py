"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight for each word, shared by the ordered thresholds. The output is the
expected severity, the sum of k times P(grade = k). The model is fit on a bounded sample of labelled rows
(``sample_rows``, the first by the hash of their id, then the id); what is scored is every document, whole. Its features
are the words that tell grade 0 from the others at a false-discovery rate, by exact tail probabilities: a rule that means
the same on ten rows and on thousands. There are as many grades as the labels have values.

Null texts are empty and score by the thresholds alone; very long ones count each word once; rows that repeat get equal
scores; of grades that tie the lesser is reported; rows with a null label are no examples; without examples of two
grades, as in an empty table, nothing is rejected. ``clean`` passes all columns on; ``score`` replaces columns of the
names expected_severity, p_toxic and grade, in any case of letters, and passes the others on. Of rows of ``docs`` that share
a labelled id the greatest text is the example; a row of ``labels`` that repeats is one example.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_of, written

WORDS = re.compile(r"\w+")
SCORES = "expected_severity double, p_toxic double, grade int"


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thetas: tuple[float, ...] = (20.0, 21.0)

    def probabilities(self, score: float) -> list[float]:
        cumulative = [0.0, *(1 / (1 + np.exp(-np.clip(t - score, -40, 40))) for t in self.thetas), 1.0]
        return [b - a for a, b in zip(cumulative, cumulative[1:])]

    def score(self, text: str) -> float:
        return sum(self.weights[w] for w in sorted(self.weights.keys() & words_of(text)))


def words_of(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def fit(cells: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], grades: np.ndarray, n_grades: int, l2: float = 0.1, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the negative log-likelihood; Adam on all rows, thresholds kept in order.

    ``cells`` are the rows and columns of the ones of a sparse matrix of ``shape``.
    """
    (row, column), (n, f) = cells, shape
    share = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n
    theta = np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1))
    params = np.concatenate([np.zeros(f), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        gaps = np.exp(params[f + 1 :])
        theta = params[f] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(row, params[column], n)
        cum = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(theta[None] - s[:, None], -40, 40))), np.ones((n, 1))], axis=1)
        slope = cum * (1 - cum)
        rows = np.arange(n)
        p = np.maximum(cum[rows, grades + 1] - cum[rows, grades], 1e-9)
        upper, lower = slope[rows, grades + 1] / p, slope[rows, grades] / p
        by_theta = np.array([lower[grades == k + 1].sum() - upper[grades == k].sum() for k in range(n_grades - 1)])
        by_word = np.bincount(column, (upper - lower)[row], f)
        g = np.concatenate([by_word + l2 * params[:f], [by_theta.sum()], [gaps[j] * by_theta[j + 1 :].sum() for j in range(n_grades - 2)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:f], params[f] + np.concatenate([[0], np.cumsum(np.exp(params[f + 1 :]))])


def tails(seen: np.ndarray, hits: np.ndarray, positive: int, n: int) -> np.ndarray:
    """Two-sided probabilities that ``hits`` of the ``seen`` rows with a word are among the ``positive`` of ``n`` by chance:
    twice the lesser tail of the hypergeometric distribution, at most 1."""
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    choose = lambda a, b: log[a] - log[b] - log[a - b]
    out = np.empty(len(seen))
    for i, (k, h) in enumerate(zip(seen.tolist(), hits.tolist())):
        x = np.arange(max(0, k - (n - positive)), min(k, positive) + 1)
        p = np.exp(choose(positive, x) + choose(n - positive, k - x) - choose(n, k))
        out[i] = min(1.0, 2 * min(p[x >= h].sum(), p[x <= h].sum()))
    return out


def discoveries(p: np.ndarray, times: np.ndarray, rate: float) -> np.ndarray:
    """Which probabilities, each of ``times`` words, are discoveries at a false-discovery rate (Benjamini and Hochberg)."""
    order = np.argsort(p, kind="stable")
    fits = p[order] * times.sum() <= rate * np.cumsum(times[order])
    return p <= p[order][fits].max() if fits.any() else np.zeros(len(p), bool)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 8000, rate: float = 0.01) -> Model:
    """A model from ``labels`` (doc_id, ``label``: ordered grades, 0 for none), fit on at most ``sample_rows`` labelled
    rows that have a document. Its features are all words of theirs that are discoveries at the false-discovery ``rate``,
    however many they are. The driver gets counts of words by how often they occur, and the selected words only.
    """
    sample = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("__id"), "__id", "label").limit(sample_rows)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([sorted(words_of(t)) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], ["label", "words"])

    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    texts = texts.groupBy("__id", "label").agg(F.max("text").alias("text"))  # no more rows than the sample has
    rows = written(texts.select("label", "text").mapInArrow(lean(split), "label int, words array<string>"), "examples")
    of = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, positive = sum(of.values()), sum(k for g, k in of.items() if g > 0)
    if not positive or positive == n:
        return Model()
    counts = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("label") > 0).alias("hits"))
    counts = written(counts, "counts")
    cells = counts.groupBy("seen", "hits").agg(F.count(F.lit(1)).alias("words")).toPandas()  # at most sample_rows squared, most words are rare
    found = discoveries(tails(cells["seen"].to_numpy(), cells["hits"].to_numpy(), positive, n), cells["words"].to_numpy(), rate)
    if not found.any():
        return Model()
    chosen = counts.join(F.broadcast(counts.sparkSession.createDataFrame(cells[found][["seen", "hits"]])), ["seen", "hits"], "left_semi")
    vocabulary = sorted(r["word"] for r in chosen.select("word").collect())  # of the sample
    place = {w: i for i, w in enumerate(vocabulary)}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = pa.array([[place[w] for w in x if w in place] for x in b.column("words").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("label"), at], ["label", "at"])

    kept = rows.mapInArrow(lean(pick), "label int, at array<int>").collect()  # at most sample_rows
    ones = np.array([(i, k) for i, r in enumerate(kept) for k in r["at"]], np.int64).reshape(-1, 2)
    order = {g: k for k, g in enumerate(sorted(of))}
    weights, thetas = fit((ones[:, 0], ones[:, 1]), (len(kept), len(vocabulary)), np.array([order[r["label"]] for r in kept]), len(order))
    return Model(dict(zip(vocabulary, weights.tolist())), tuple(thetas.tolist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with expected_severity, p_toxic (probability of any grade above 0) and the likeliest grade."""
    names = [f.name for f in docs.schema.fields if f.name.lower() not in ("expected_severity", "p_toxic", "grade")]
    some = docs.select(*names)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields] + [SCORES])
    keys = model.weights.keys()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                found = keys & words_of(t or "")
                p = model.probabilities(sum(model.weights[w] for w in sorted(found)))
                out.append((float(sum(k * q for k, q in enumerate(p))), float(1 - p[0]), int(np.argmax(p))))
            more = list(zip(*out)) or [(), (), ()]
            arrays = [b.column(i) for i in range(b.num_columns)] + [pa.array(more[0], pa.float64()), pa.array(more[1], pa.float64()), pa.array(more[2], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, "expected_severity", "p_toxic", "grade"])

    return some.mapInArrow(each, schema)


def clean(docs: DataFrame, model: Model, below: float) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose probability of any grade above 0 is under ``below``."""
    weights = model.weights
    keys = weights.keys()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = (sum(weights[w] for w in sorted(keys & words_of(t or ""))) for t in b.column("text").to_pylist())
            yield b.filter(pa.array([1 - model.probabilities(s)[0] < below for s in scores], pa.bool_()))

    return docs.mapInArrow(lean(each), docs.schema)
