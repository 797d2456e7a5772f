"""Quality classifier by co-training of two views, calibrated and combined.

One classifier sees the text's content (shares of ASCII characters and of other bytes, word lengths, repeated
words, and which of the words that tell good from bad labelled rows occur), the other its page metadata (source,
language, length). Both are logistic regressions trained here. A row is good if its quality label is 1 and it is
not labelled toxic. In each round every view labels all unlabelled rows it is confident about for the other view,
in one distributed pass per Newton step: tasks add up gradients, the driver gets one sum per weight. Pseudo-labels
of a class weigh at most half as much as that class does among the labelled rows, however many they are, so that a
larger corpus does not drown the labels. A view that is sure of one class only teaches nothing. Before each round and at
the end each view is calibrated (Platt) on the log-odds of labelled rows in fits that left them out; in the end the
calibrated log-odds are added. A document is kept if it is more likely good than not.

At most ``SAMPLE`` labelled rows are used, those with the smallest hash of doc_id; unlabelled rows all are.
Sums are of integers, so the result depends neither on partitions nor on the order of rows.

Null or empty text, null source, language or length are values of their own; repeated rows get equal scores;
extra columns are ignored; an empty table gives an empty result. Very long texts are read whole, their views have a
fixed size. Without labels of both kinds every document is kept with score 0.5. Rows whose quality label is null are
unlabelled, a null toxic label counts as not toxic; if an id is labelled twice, bad counts, and if several rows have a
labelled id, the one with the least view is learned from.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.llm.common import stored

SAMPLE = 6000
ROUNDS = 3
STEPS = 3  # Newton steps of a round, each a pass over the unlabelled rows
FOLDS = 3
SURE_GOOD, SURE_BAD = 0.4, 0.1  # confident: a class is at most this part as likely as it is at large
PSEUDO = 0.5  # weight of a pseudo-label; all of a class together weigh at most this part of its labels
THRESHOLD = 0.5
LEXICON = 64  # words of the text view
LEXICON_ROWS, LEXICON_LEAST, LEXICON_RATIO = 0.005, 5, 15  # share of labelled rows and number of rows a word is in, least ratio
SOURCES, LANGS = 256, 64
META_DIMS = SOURCES + LANGS + 3
BASE_DIMS = 128 + 3 + 8
RIDGE = 3.0
GRID, FINE = 2.0**10, 2.0**16  # steps of standardised values, and of weights and residuals
LEAST_CURVE = 0.02  # of a pseudo-label, so that steps stay short where all are sure already
COARSE = 2.0**4  # steps of the grid that are one step in a curvature
CHUNK = 1024
_PLAIN = np.array([chr(i).isalnum() or chr(i).isspace() or chr(i) in ".,;:'\"?()-" for i in range(128)])

_LETTERS = np.array([i for i in range(33, 127) if chr(i).isalnum()])
_EDGE = b".,;:!?\"'()[]{}"


# ---- views ---------------------------------------------------------------------------------------------------
def vocabulary(words: list[bytes]) -> set[bytes]:
    """Distinct words without the marks around them, ASCII letters in lower case."""
    return {w.lower().strip(_EDGE) for w in set(words)}


def text_view(text: str | None, lexicon: dict[bytes, int]) -> np.ndarray:
    data = (text or "").encode("utf-8", "replace")
    out = np.zeros(BASE_DIMS + len(lexicon), np.float32)
    if not data:
        out[BASE_DIMS - 1] = 1
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[:128] = np.sqrt(counts[:128] / len(data))
    out[128:131] = np.sqrt([counts[128:192].sum() / len(data), counts[192:224].sum() / len(data), counts[224:].sum() / len(data)])
    words = data.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    out[131] = sum(map(bytes.__eq__, words, words[1:])) / n
    out[132] = len(set(words)) / n
    out[133] = min(2.0, (len(data) / n) / 10)
    out[134] = (lengths > 20).sum() / n
    out[135] = counts[65:91].sum() / max(1, counts[65:91].sum() + counts[97:123].sum())
    out[136] = np.sqrt(counts[:128][~_PLAIN].sum() / len(data))
    out[137] = counts[33:127][~np.isin(np.arange(33, 127), _LETTERS)].sum() / len(data)
    if lexicon:
        out[[BASE_DIMS + lexicon[w] for w in vocabulary(words) & lexicon.keys()]] = 1
    return out


def meta_view(source, lang, n_chars) -> np.ndarray:
    """Bucket of the source, bucket of the language, size, and 1 if the size is not known."""
    bucket = lambda value, n: zlib.crc32(repr(value).encode()) % n
    known = n_chars is not None and n_chars == n_chars and n_chars is not pd.NA
    size = math.log1p(max(0.0, float(n_chars))) / 10 if known else 0.0
    return np.array([bucket(source, SOURCES), bucket(lang, LANGS), size, 0.0 if known else 1.0], np.float32)


def spread(meta: np.ndarray) -> np.ndarray:
    """One column per bucket."""
    out = np.zeros((len(meta), META_DIMS), np.float32)
    at = np.arange(len(meta))
    out[at, meta[:, 0].astype(int)] = 1
    out[at, SOURCES + meta[:, 1].astype(int)] = 1
    out[:, -3], out[:, -2], out[:, -1] = meta[:, 2], meta[:, 2] ** 2, meta[:, 3]
    return out


def views(batch: pd.DataFrame, lexicon: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    text = np.stack([text_view(t, lexicon) for t in batch["text"]])
    meta = np.stack([meta_view(*r) for r in zip(batch["source"], batch["lang"], batch["n_chars"].astype(object))])
    return text, meta


def packed(text: np.ndarray, meta: np.ndarray) -> list[bytes]:
    return [np.concatenate(r).astype("<f4").tobytes() for r in zip(text, meta)]


def unpacked(rows) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(map(bytes, rows)), "<f4").reshape(len(rows), -1)
    return x[:, :-4], spread(x[:, -4:])


# ---- models --------------------------------------------------------------------------------------------------
@dataclass
class Scale:
    """Standardises columns; values are whole steps of a grid, so that sums of products are exact."""

    mean: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Scale:
        x = x.astype(np.float64)
        return cls(x.mean(axis=0), x.std(axis=0) + 1e-3)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.rint(np.clip((x.astype(np.float64) - self.mean) / self.width, -10, 10) * GRID)


@dataclass
class Logistic:
    weights: np.ndarray  # of the standardised columns, then the bias
    slope: float = 1.0  # calibration
    shift: float = 0.0

    def odds(self, z: np.ndarray) -> np.ndarray:
        # Whole numbers below 2**53: a row's value does not depend on the batch it comes in.
        return np.clip(z @ np.rint(self.weights[:-1] * FINE) / (GRID * FINE) + self.weights[-1], -30, 30)

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return self.slope * self.odds(z) + self.shift


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def ridge_of(size: int, ridge: float) -> np.ndarray:
    return np.append(np.full(size - 1, ridge), 1e-6)


def slopes(model: Logistic, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log-likelihood."""
    x = np.hstack([z / GRID, np.ones((len(z), 1))])
    p = sigmoid(model.odds(z))
    return x.T @ (y - p), (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x


def fit(z: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> Logistic:
    """Ridge logistic regression by Newton steps."""
    model = Logistic(np.zeros(z.shape[1] + 1))
    penalty = ridge_of(z.shape[1] + 1, ridge)
    for _ in range(steps):
        rise, curve = slopes(model, z, y)
        step = np.linalg.solve(curve + np.diag(penalty), rise - penalty * model.weights)
        model.weights = model.weights + step
        if abs(step).max() < 1e-4:
            break
    return model


def calibrate(model: Logistic, odds: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling: a logistic regression of the labels on log-odds of rows the model was not fitted on."""
    scale = Scale.of(odds[:, None])
    one = fit(scale(odds[:, None]), y, ridge=0.1)
    model.slope = float(one.weights[0] / scale.width[0])
    model.shift = float(one.weights[1] - one.weights[0] * scale.mean[0] / scale.width[0])


# ---- co-training ---------------------------------------------------------------------------------------------
@dataclass
class Fit:
    """Models of both views, learned from the labelled rows of ``mask``."""

    mask: np.ndarray
    share: float  # of good rows
    models: list[Logistic]
    teachers: list[Logistic] = field(default_factory=list)
    each: list[tuple[float, float]] = field(default_factory=list)  # by view: weight of a good and of a bad pseudo-label

    def sure(self, v: int, z: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The rows that the other view tells view ``v`` are good, and those it says are bad."""
        p = sigmoid(self.teachers[1 - v].calibrated(z[1 - v]))
        return 1 - p <= SURE_GOOD * (1 - self.share), p <= SURE_BAD * self.share


def census(z: tuple[np.ndarray, np.ndarray], fits: list[Fit]) -> np.ndarray:
    """Numbers of good and bad pseudo-labels by fit and view."""
    return np.array([part.sum() for f in fits for v in (0, 1) for part in f.sure(v, z)], np.int64)


def tally(z: tuple[np.ndarray, np.ndarray], fits: list[Fit], curved: bool) -> np.ndarray:
    """Whole-number sums over unlabelled rows: the gradient of every fit and view and, if ``curved``, the curvature
    (upper triangle) of the first fit's views.

    Weights are relative to the larger of both classes, values are rounded per row; sums stay below 2**63 up to 2**33 rows.
    """
    out = []
    for k, f in enumerate(fits):
        for v in (0, 1):
            good, bad = f.sure(v, z)
            weight = (good * f.each[v][0] + bad * f.each[v][1]) / (max(f.each[v]) or 1.0)
            q = sigmoid(f.models[v].odds(z[v]))
            rest = np.rint((good - q) * weight * FINE)
            out += [rest @ z[v], [rest.sum()]]
            if curved and k == 0:
                some = weight > 0
                x = np.hstack([np.rint(z[v][some] / COARSE), np.full((some.sum(), 1), GRID / COARSE)])
                curve = np.rint(np.maximum(q * (1 - q), LEAST_CURVE)[some] * weight[some] * 2**12)
                out.append(((x * curve[:, None]).T @ x)[np.triu_indices(x.shape[1])])
    return np.concatenate(out).astype(np.int64)


def bent(sums: np.ndarray, size: int, top: float) -> np.ndarray:
    """The symmetric matrix behind a sum of upper triangles."""
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = sums * (top / ((GRID / COARSE) ** 2 * 2**12))
    return out + np.triu(out, 1).T


def update(model: Logistic, z: np.ndarray, y: np.ndarray, sums: np.ndarray, top: float, curve: np.ndarray) -> float:
    """One Newton step on labels and pseudo-labels; returns the largest change. The pseudo-labels' curvature is that
    of the whole fit at the start of the round, so a step costs sums of one number per weight."""
    rise, own = slopes(model, z, y)
    penalty = ridge_of(len(rise), RIDGE)
    rise += top * np.append(sums[:-1] / (FINE * GRID), sums[-1] / FINE) - penalty * model.weights
    step = np.linalg.solve(own + curve + np.diag(penalty), rise)
    step /= max(1.0, abs(step).max())
    model.weights = model.weights + step
    return float(abs(step).max())


def settle(fits: list[Fit], labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray) -> None:
    """Calibrate each view on the log-odds of rows by fits that left them out, as far as there are such fits.

    So a view that has only learned its rows by heart is sure of nothing and teaches nothing.
    """
    for v, z in enumerate(labelled):
        odds = fits[0].models[v].odds(z)
        for f in fits[1:]:
            odds[~f.mask] = f.models[v].odds(z[~f.mask])
        for f in fits:
            calibrate(f.models[v], odds, y)


class Pool:
    """The unlabelled rows: sums of a function of their views over all of them."""

    def __init__(self, z: tuple[np.ndarray, np.ndarray]):
        self.z = z

    def total(self, of: Callable[[tuple[np.ndarray, np.ndarray]], np.ndarray], size: int) -> np.ndarray:
        return of(self.z)


class StoredPool(Pool):
    """A table of packed views: tasks add up, Spark adds their sums, the driver gets ``size`` numbers."""

    def __init__(self, rows: DataFrame, scales: list[Scale]):
        self.rows, self.scales = rows, scales

    def total(self, of: Callable[[tuple[np.ndarray, np.ndarray]], np.ndarray], size: int) -> np.ndarray:
        scales = self.scales

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros(size, np.int64)
            for batch in batches:
                for at in range(0, len(batch), CHUNK):
                    parts = unpacked(batch["view"].iloc[at : at + CHUNK])
                    sums += of(tuple(s(part) for s, part in zip(scales, parts)))
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"slot": at, "n": sums[at]})

        found = self.rows.mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most ``size`` rows
        out = np.zeros(size, np.int64)
        out[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
        return out


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, masks: list[np.ndarray], pool: Pool, rounds: int = ROUNDS, steps: int = STEPS) -> list[Fit]:
    """One fit per mask of labelled rows, taught by all rows of ``pool``."""
    fits = [Fit(m, float(y[m].mean()), [fit(z[m], y[m]) for z in labelled]) for m in masks]
    dims = [z.shape[1] + 1 for z in labelled]
    for _ in range(rounds):
        settle(fits, labelled, y)
        light = [Fit(np.empty(0), f.share, f.models, [replace(m) for m in f.models]) for f in fits]  # what tasks need
        numbers = pool.total(lambda z: census(z, light), 4 * len(fits)).reshape(-1, 2, 2)
        for f, small, by_view in zip(fits, light, numbers):
            n = f.mask.sum()
            small.each = [tuple(PSEUDO * min(1.0, n * c / m) if pair.all() else 0.0 for c, m in zip((f.share, 1 - f.share), pair)) for pair in by_view]
        curves: list[np.ndarray] = []
        for k in range(steps):
            curved = k == 0
            sizes = [n for i in range(len(fits)) for d in dims for n in ([d, d * (d + 1) // 2] if curved and i == 0 else [d])]
            sums = iter(np.split(pool.total(lambda z: tally(z, light, curved), sum(sizes)), np.cumsum(sizes)[:-1]))
            moved = 0.0
            for i, (f, small) in enumerate(zip(fits, light)):
                for v in (0, 1):
                    top, rise = max(small.each[v]), next(sums)
                    if curved and i == 0:
                        curves.append(bent(next(sums), dims[v], top))
                    moved = max(moved, update(f.models[v], labelled[v][f.mask], y[f.mask], rise, top, curves[v]))
            if moved < 0.01:
                break
    settle(fits, labelled, y)
    return fits


# ---- training ------------------------------------------------------------------------------------------------
@dataclass
class Classifier:
    lexicon: dict[bytes, int]
    scales: list[Scale]
    models: list[Logistic]
    prior: float  # log-odds of a good row
    threshold: float

    def scores(self, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, meta = views(batch, self.lexicon)
        a, b = (m.calibrated(s(x)) for m, s, x in zip(self.models, self.scales, (text, spread(meta))))
        return sigmoid(a), sigmoid(b), sigmoid(np.clip(a + b - self.prior, -30, 30))


def known_labels(labels: DataFrame) -> DataFrame:
    """(_id, _y): 1 if good, 0 if of bad quality or toxic."""
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False)) if "toxic" in labels.columns else F.lit(False)
    good = ((F.col("quality") == 1) & ~toxic).cast("int")
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return some.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(good).alias("_y"))


def telling_words(picked: DataFrame, rows: int, good: int) -> dict[bytes, int]:
    """The words whose presence in labelled rows goes with the label most: by the log-likelihood ratio."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, y in zip(batch["text"], batch["_y"]):
                found = [w for w in vocabulary((text or "").encode("utf-8", "replace").split()) if w and len(w) <= 40]
                yield pd.DataFrame({"word": found, "y": np.full(len(found), y)})

    n, g = F.count("*").cast("double"), F.sum("y").cast("double")
    counts = picked.mapInPandas(run, "word binary, y int").groupBy("word").agg(n.alias("n"), g.alias("g")).where(F.col("n") >= max(LEXICON_LEAST, LEXICON_ROWS * rows))
    n, g = F.col("n"), F.col("g")
    part = lambda seen, base, share: F.when(seen > 0, seen * F.log(seen / (base * share))).otherwise(0.0)
    share = good / rows
    ratio = part(g, n, share) + part(n - g, n, 1 - share) + part(good - g, rows - n, share) + part(rows - good - (n - g), rows - n, 1 - share)
    top = counts.withColumn("ratio", F.round(2 * ratio, 6)).where(F.col("ratio") >= LEXICON_RATIO).orderBy(F.desc("ratio"), "word").limit(LEXICON).collect()
    return {bytes(r["word"]): i for i, r in enumerate(top)}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> Classifier | None:
    """Fit on at most ``sample`` labelled rows and on all unlabelled ones; None if there are not both kinds of labels."""
    known = known_labels(labels)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    some = F.broadcast(known.orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(sample))  # at most ``sample`` rows
    picked = columns.join(some, F.col("doc_id") == F.col("_id"))
    counts = {r["_y"]: r["n"] for r in picked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    lexicon = telling_words(picked, sum(counts.values()), counts[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["doc_id"].astype("Int64"), "y": batch["_y"].astype("Int64"), "view": packed(*views(batch, lexicon))})

    schema = "id long, y long, view binary"
    rows = picked.mapInPandas(run, schema).groupBy("id", "y").agg(F.min("view").alias("view")).toPandas().sort_values("id")  # a row per id
    raw, y, ids = unpacked(rows["view"]), rows["y"].to_numpy().astype(np.float64), rows["id"].to_numpy()
    scales = [Scale.of(x) for x in raw]
    labelled = tuple(s(x) for s, x in zip(scales, raw))
    fold = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FOLDS)
    folds = [k for k in range(FOLDS) if len(set(y[fold != k])) == 2]  # else a fold keeps the odds of the whole fit
    # Views, not texts, are shuffled, by the same plan at every size. Rows without id match none and are dealt out by view.
    rest = columns.withColumn("_y", F.lit(None).cast("int")).mapInPandas(run, schema).drop("y")
    rest = rest.withColumn("deal", F.when(F.col("id").isNull(), F.xxhash64("view")).otherwise(F.lit(0).cast("long")))
    ids_known = known.select(F.col("_id").alias("id"), F.lit(0).cast("long").alias("deal")).hint("merge")
    same = F.coalesce(rest["id"], F.lit(0).cast("long")) == ids_known["id"]
    pool = stored(rest.join(ids_known, same & (rest["deal"] == ids_known["deal"]), "left_anti").select("view"), "quality-pool")
    fits = co_train(labelled, y, [np.ones(len(y), bool)] + [fold != k for k in folds], StoredPool(pool, scales))
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    return Classifier(lexicon, scales, fits[0].models, float(np.log(share / (1 - share))), threshold)


def score(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            n = len(batch)
            a, b, c = model.scores(batch) if model else (np.full(n, 0.5),) * 3
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "p_text": a, "p_meta": b, "score": c, "keep": c >= (model.threshold if model else 0.0)})

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    return columns.mapInPandas(run, "doc_id long, p_text double, p_meta double, score double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows the classifier rejects; a row is judged where it is read, nothing is shuffled."""
    model = train(docs, labels, sample)
    schema = docs.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[model.scores(batch)[2] >= model.threshold]

    return docs if model is None else docs.mapInPandas(run, schema)
