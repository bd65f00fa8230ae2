"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled 1; every other text (without label, or not vouched for) is unlabelled web text, a mixture in which a share pi is
positive.  The class prior pi is estimated from the two samples, and a linear model minimises
pi R+(1) + max(0, Ru(0) - pi R+(0)): where the estimated risk on negatives would fall below zero, the step undoes it instead.

Features are taken from whole texts by whole-batch byte arithmetic: shares of byte pairs (hashed), shares of character classes, and rates such as
capitals, distinct words and distinct lines.  A first model is fitted on at most ``sample`` rows of each of the two sorts, those with the smallest
hash of doc_id and text; the prior and the final weights come from all rows.  Scoring covers every row.

A null or empty text has all-zero features and gets the model's score for them; documents without labels are unlabelled; several labels of a doc_id count as 1 only if all
are 1; repeated rows are scored each.  Without any positive or unlabelled rows the score is the prior 0.5.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import release, slices

PAIRS = 512
#: Standard errors added to a ratio of heads, since the least of many is too low.
MARGIN = 0.5
_CLASSES = np.zeros((256, 9), np.float32)
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = [_b < 128 and _c.islower(), _b < 128 and _c.isupper(), _b < 128 and _c.isdigit(), _b == 32, _b == 10, _c in ".,;:'\"-?", _c in "!#$%&*@^~+=<>", _c in "|[]{}()\\/_`", _b > 127]
RATES = 9
WIDTH = PAIRS + 9 + RATES


def features(texts: pa.Array) -> np.ndarray:
    """A row of shares and rates for each text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, text in enumerate(pc.fill_null(texts, "").to_pylist()):
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            continue
        b = np.frombuffer(raw, np.uint8)
        single = np.bincount(b, minlength=256).astype(np.float32)
        n = len(b)
        if n > 1:
            pair = (b[:-1].astype(np.uint16) << np.uint16(8)) | b[1:]
            hashed = (pair * np.uint16(40503)) >> np.uint16(7)
            out[i, :PAIRS] = np.sqrt(np.bincount(hashed, minlength=PAIRS).astype(np.float32) / (n - 1))
        out[i, PAIRS : PAIRS + 9] = np.log1p(300 * (single @ _CLASSES / n))  # small shares of odd characters tell most
        words, lines = raw.split(), raw.split(b"\n")
        k = max(1, len(words))
        again = sum(map(eq, words, words[1:])) / k  # stuttered words
        tails = sum(w[-3:-2] == w[-1:] for w in words) / k  # word ends that swing back, as in babble and keyboard runs
        out[i, PAIRS + 9 :] = [np.log1p(len(words)) / 10, len(set(words)) / k, len(set(lines)) / len(lines), n / k / 20, *np.log1p([300 * again, 300 * tails, 300 * sum(map(bytes.isupper, words)) / k, 300 * sum(len(w) == 1 for w in words) / k]), np.log1p(max(map(len, lines))) / 10]
    return out


class Model:
    """A standardised linear model with a logistic output."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.mean, self.scale, self.weights, self.bias, self.prior = mean, scale, weights, bias, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Descent:
    """Adam on the non-negative risk with the logistic loss; ``weights`` is the mean of the second half's weights."""

    def __init__(self, positives: np.ndarray, prior: float, rate: float, decay: float, steps: int, start: np.ndarray | None = None, seed: int = 7, batch: int = 512):
        self.p, self.prior, self.rate, self.decay, self.steps, self.batch = positives, prior, rate, decay, steps, batch
        self.w = np.zeros(positives.shape[1]) if start is None else start.copy()
        self.m, self.v, self.t = 0.0, 0.0, 0
        self.total, self.n = 0.0, 0
        self.rng = np.random.default_rng(seed)

    def step(self, u: np.ndarray) -> None:
        """One step on a batch of unlabelled rows and as many positives."""
        p, w = self.p[self.rng.integers(0, len(self.p), self.batch)], self.w
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        positive = p.T @ (sp - 1) / len(p) * self.prior
        # risk on negatives, as unlabelled less positives: log loss of calling them 0
        negative = u.T @ su / len(u) - self.prior * (p.T @ sp) / len(p)
        risk = -np.log(1 - np.clip(su, 0, 1 - 1e-9)).mean() + self.prior * np.log(1 - np.clip(sp, 0, 1 - 1e-9)).mean()
        g = (positive + negative if risk >= 0 else -negative) + self.decay * np.r_[w[:-1], 0]
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        self.w = w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        if self.t > self.steps // 2:
            self.total, self.n = self.total + self.w, self.n + 1

    @property
    def weights(self) -> np.ndarray:
        return self.total / self.n if self.n else self.w


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.c_[x, np.ones(len(x), np.float32)]


def descend(xp: np.ndarray, xu: np.ndarray, prior: float, epochs: int, rate: float, decay: float, batch: int = 512) -> np.ndarray:
    """Weights, the bias last, after some passes over unlabelled rows that are all at hand."""
    rng = np.random.default_rng(7)
    epochs = max(epochs, -(-800 // -(-len(xu) // batch)))  # few rows need as many steps
    run, au = Descent(with_bias(xp), prior, rate, decay, epochs * -(-len(xu) // batch), batch=batch), with_bias(xu)
    for _ in range(epochs):
        pu = rng.permutation(len(au))
        for i in range(0, len(au), batch):
            run.step(au[pu[i : i + batch]])
    return run.weights


QUANTILES = np.linspace(0.01, 0.8, 80)


def class_prior(p_scores: np.ndarray, above: np.ndarray, n_unlabelled: int) -> float:
    """The share of positives among the unlabelled: the least ratio of unlabelled to positive mass above any score.

    Above a score that only positives reach, the ratio is pi; elsewhere it is larger.  Heads hold a fifth of the positives at least, so that
    a small one can't win by chance.  ``above``: how many unlabelled rows score at least each of the positives' :data:`QUANTILES`.
    """
    best = 1.0
    for cut, n in zip(np.quantile(p_scores, QUANTILES), above, strict=True):
        hp, hu = (p_scores >= cut).mean(), n / n_unlabelled
        error = np.sqrt((1 - hp) / (hp * len(p_scores)) + (1 - hu) / (max(hu, 1e-9) * n_unlabelled))
        best = min(best, hu / hp * (1 + MARGIN * error))
    return float(np.clip(best, 0.05, 0.99))


def scaled(xp: np.ndarray, xu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of both samples together."""
    n = len(xp) + len(xu)
    mean = (xp.sum(0, np.float64) + xu.sum(0, np.float64)) / n
    return mean, np.sqrt((((xp - mean) ** 2).sum(0) + ((xu - mean) ** 2).sum(0)) / n) + 1e-3


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = 10_000) -> Model:
    """Fit on documents that aren't held out.

    ``sample`` bounds the trusted positives and the unlabelled rows that a first model is made from.  What is then learned of unlabelled text is learned from all rows: the class
    prior from the scores of every text, and the weights by a further descent over every text, in which each task goes on from the first model over its own
    rows and the tasks' weights are averaged by their rows.
    """
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(~held_out(F.col("doc_id")))
    own = docs.select("doc_id", "text").filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).withColumn("draw", F.xxhash64("doc_id", "text", F.lit(11)))
    mine = own.select("doc_id", "draw").join(trusted, "doc_id", "left").withColumn("positive", F.coalesce(F.col("quality") == 1, F.lit(False)))
    # Half of the positives also stand for the positives among unlabelled text, so that it stays what it was before anyone labelled it.  Equal rows are drawn once.
    half = F.pmod("draw", F.lit(2))
    sorts = F.col("positive") & (half == 0), ~F.col("positive") | (half == 1)
    drawn = [mine.filter(c).select("draw").distinct().orderBy("draw").limit(sample).select("draw", F.lit(i).alias("sort")) for i, c in enumerate(sorts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            x = features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["draw", "sort", "x"])  # half precision halves what the driver holds
        release()

    picked = own.join(F.broadcast(drawn[0].union(drawn[1])), "draw").select("draw", "sort", "text").mapInArrow(run, "draw bigint, sort int, x binary")  # 2 x sample numbers
    rows = picked.dropDuplicates(["draw"]).toArrow()  # 2 x sample rows of WIDTH halves
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(-1, WIDTH)
    sort, draws = np.array(rows.column("sort").to_pylist(), np.int64), np.array(rows.column("draw").to_pylist(), np.int64)
    del rows
    order = np.argsort(draws, kind="stable")  # the rows come in any order; the fit doesn't depend on it
    x, sort = x[order], sort[order]
    xp, xu = (x[sort == i].astype(np.float32) for i in (0, 1))
    model = fit(xp, xu, own.select("text"))
    release()
    return model


def fit(xp: np.ndarray, xu: np.ndarray, texts: DataFrame) -> Model:
    """A first model tells the two samples apart; with the prior that it gives over all ``texts``, the risk is minimised on the samples, then over all texts."""
    if not len(xp) or not len(xu):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)
    mean, scale = scaled(xp, xu)
    zp, zu = (((x - mean) / scale).astype(np.float32) for x in (xp, xu))
    half_p, half_u = len(zp) // 2, len(zu) // 2
    w = descend(zp[:half_p] if half_p else zp, zu[:half_u] if half_u else zu, 0.5, 6, 0.01, 1e-3)
    scores = with_bias(zp[half_p:]) @ w
    above, n = counted_above(texts, mean, scale, w, np.quantile(scores, QUANTILES))
    prior = class_prior(scores, above, n)
    w = onwards(texts, mean, scale, descend(zp, zu, prior, 24, 0.01, 3e-3), zp, prior)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def counted_above(texts: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all texts score at least each cut, and how many there are; tasks send counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(cuts), np.int64), 0
        for b in slices(batches):
            s = with_bias((features(b.column(0)) - mean) / scale) @ w
            counts += (s[:, None] >= cuts[None]).sum(0)
            n += len(s)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, len(cuts)), pa.int32()), "n": pa.array([n, *counts.tolist()], pa.int64())})
        release()

    found = {r.i: r.n for r in texts.mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return np.array([found[i] for i in range(len(cuts))]), found[-1]


def onwards(texts: DataFrame, mean: np.ndarray, scale: np.ndarray, start: np.ndarray, positives: np.ndarray, prior: float, rate: float = 0.0005, batch: int = 512) -> np.ndarray:
    """The weights after a descent from ``start`` over all texts: every task's own, averaged by rows.  Sums are made in Spark, a number for each weight comes back."""
    sent = positives.astype(np.float16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, n = Descent(with_bias(sent.astype(np.float32)), prior, rate, 3e-3, 0, start, batch=batch), np.zeros((0, len(start)), np.float32), 0
        for b in slices(batches):
            x = ((features(b.column(0)) - mean) / scale).astype(np.float32)
            n += len(x)
            held = np.concatenate([held, with_bias(x)])
            while len(held) >= batch:
                own.step(held[:batch])
                held = held[batch:]
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(start)), pa.int32()), "w": pa.array(own.weights * n), "n": pa.array(np.full(len(start), n, np.int64))})
        release()

    sums = texts.mapInArrow(run, "i int, w double, n bigint").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).collect()
    return np.round([r.w for r in sorted(sums, key=lambda r: r.i)], 9)  # tasks' sums come in any order


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",), only: bool = False) -> DataFrame:
    """``keep`` columns with score and predicted of every row; ``only``: just ``keep``, of the rows predicted 1."""
    narrow = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = model.score(features(b.column(b.num_columns - 1))).astype(np.float64)
            if only:
                yield b.select(list(range(b.num_columns - 1))).filter(pa.array(s >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])
        release()

    return narrow.mapInArrow(run, kept if only else f"{kept}, score double, predicted int")
