"""Document quality by co-training: one classifier on what the text holds, one on the page's metadata.

Both start from the labelled documents. In each round, either view labels the unlabelled documents that it
is most sure of, and the other view learns from them. All unlabelled documents take part: they are scored where
they stand, the surest are those beyond a global quantile, and a fit gathers sums for its Newton steps only. At the end each view is calibrated on labelled
documents that neither has learnt from, and the calibrated views together score every document.

Defined results: null and empty texts count as texts without words; null languages and sources are values of
their own; repeated rows keep a row each; an empty table gives an empty result; without labels of both kinds
every score is the share of good ones (1 without any), so that nothing is rejected. Extra columns are not touched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, kept, parts, slices, worker_cache
from tessera.llm.linear import fit_logistic, sigmoid, summed

LANG_SLOTS, SOURCE_SLOTS = 8, 32
#: Unlabelled rows in a partition of the table that the rounds go over.
ROWS_IN_PARTITION = 20_000


def _squash(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -5, 5)


def text_features(text: str) -> list[float]:
    """Measures of the whole text: kinds of characters, repetition of words, pairs and lines, lengths of words and lines."""
    data = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    upper, lower, digit, wide = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum(), kinds[128:].sum()
    space, total = kinds[9:14].sum() + kinds[32], max(1.0, float(len(data)))
    signs = total - upper - lower - digit - wide - space
    words = text.split()
    n = max(1, len(words))
    seen = Counter(words)
    most = max(seen.values(), default=0) / n
    twice = sum(map(str.__eq__, words, words[1:])) / n
    lines = [line for line in text.split("\n") if line.strip()]
    m = max(1, len(lines))
    return [
        np.log1p(len(words)),
        len(seen) / n**0.8,
        most,
        twice,
        1 - len(set(lines)) / m,
        np.log1p(len(words) / m),
        upper / max(1.0, upper + lower),
        digit / total,
        signs / total,
        wide / total,
        (kinds[35] + kinds[36] + kinds[37] + kinds[38] + kinds[42]) / n,
        kinds[33] / n,
        kinds[124] / n,
        (kinds[44] + kinds[46]) / n,
        (total - space) / n / 10,
        float(len(words) < 20),
    ]


def metadata_features(lang, source, n_chars) -> list[float]:
    """What is known of a document without its text: language, source (hashed into a fixed number of slots) and length."""
    slot = lambda value, n: xxhash.xxh3_64_intdigest(str(value)) % n
    languages, sources = np.zeros(LANG_SLOTS), np.zeros(SOURCE_SLOTS)
    languages[slot(lang, LANG_SLOTS)] = sources[slot(source, SOURCE_SLOTS)] = 1
    size = np.log1p(max(0.0, float(n_chars))) if n_chars is not None and n_chars == n_chars else 0.0
    return [size, *languages, *sources]


@dataclass
class View:
    """A classifier on one view: standardised features, their squares for the numeric ones, a constant."""

    centre: np.ndarray
    scale: np.ndarray
    squares: int
    beta: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = _squash((x - self.centre) / self.scale)
        return np.concatenate([z, z[:, : self.squares] ** 2, np.ones((len(z), 1))], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.beta


@dataclass
class Model:
    views: tuple[View, View] | None
    calibration: tuple[np.ndarray, np.ndarray] | None
    combination: np.ndarray | None
    share: float

    def chance(self, xs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return sigmoid(self._joined(xs) @ self.combination)

    def _joined(self, xs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        calibrated = [np.stack([v.margin(x), np.ones(len(x))], 1) @ c for v, x, c in zip(self.views, xs, self.calibration, strict=True)]
        return np.stack([*np.clip(calibrated, -8, 8), np.ones(len(xs[0]))], 1)


Views = tuple[np.ndarray, np.ndarray]
#: The views of a round, and for each the margins up to and from which it gives labels.
Round = tuple[tuple[View, View], tuple[tuple[float, float], tuple[float, float]]]


def _given(history: list[Round], xs: Views, k: int) -> np.ndarray:
    """What the other view has given view ``k``: 0, 1 or NaN for each row; the first round that gave one counts."""
    out = np.full(len(xs[0]), np.nan)
    for views, cuts in history:
        margin = views[1 - k].margin(xs[1 - k])
        out = np.where(~np.isnan(out), out, np.where(margin <= cuts[1 - k][0], 0.0, np.where(margin >= cuts[1 - k][1], 1.0, np.nan)))
    return out


def _chosen(history: list[Round], xs: Views) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each view the rows that it has been given, and their labels."""
    for k in (0, 1):
        y = _given(history, xs, k)
        yield xs[k][~np.isnan(y)], y[~np.isnan(y)]


def _moments(pairs) -> np.ndarray:
    """Number, sums and sums of squares of the rows of both views, end to end."""
    return np.concatenate([part for x, _ in pairs for part in ([len(x)], x.sum(0), (x**2).sum(0))])


def _newton(views: tuple[View, View], pairs) -> np.ndarray:
    """Slope and curvature of the logistic loss of both views, end to end."""
    out = []
    for view, (x, y) in zip(views, pairs, strict=True):
        z = view.expand(x)
        p = sigmoid(z @ view.beta)
        out += [z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()]
    return np.concatenate(out)


class Held:
    """Unlabelled rows in memory."""

    def __init__(self, xs: Views):
        self.xs = xs

    def total(self, f: Callable[[Views], np.ndarray]) -> np.ndarray:
        return f(self.xs)

    def ends(self, views: tuple[View, View], share: float) -> list[tuple[float, float]] | None:
        """For each view the margin up to which the lowest ``share`` of the rows lie, and that from which the highest do."""
        most = max(1, int(share * len(self.xs[0])))
        margins = [np.sort(v.margin(x)) for v, x in zip(views, self.xs, strict=True)]
        return [(m[most - 1], m[-most]) for m in margins] if len(margins[0]) else None


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Views]:
    for batch in parts(batches, 10_000):
        if batch.num_rows:
            yield tuple(batch.column(k).flatten().to_numpy().reshape(batch.num_rows, -1) for k in (0, 1))


class Spread:
    """Unlabelled rows (content, metadata) in a table; of any number, only sums and quantiles reach the driver."""

    def __init__(self, table: DataFrame):
        self.table = table

    def total(self, f: Callable[[Views], np.ndarray]) -> np.ndarray | int:
        found = summed(self.table, lambda batch: sum(f(xs) for xs in _unpacked(iter([batch]))))
        return 0 if found is None else found

    def ends(self, views: tuple[View, View], share: float) -> list[tuple[float, float]] | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for xs in _unpacked(batches):
                yield pa.record_batch([pa.array(v.margin(x)) for v, x in zip(views, xs, strict=True)], ["a", "b"])

        margins = self.table.mapInArrow(run, "a double, b double")
        got = margins.agg(*(F.percentile_approx(sign * F.col(c), share, 10_000) for c in "ab" for sign in (1, -1))).first()
        return None if got[0] is None else [(got[0], -got[1]), (got[2], -got[3])]


def _fitted(labelled: Views, y: np.ndarray, rows: Held | Spread, history: list[Round]) -> tuple[View, View]:
    """Both views fitted on the labelled rows and on what each has been given, by Newton steps over sums."""
    own = [(x, y) for x in labelled]
    whole = lambda f: f(iter(own)) + (rows.total(lambda xs: f(_chosen(history, xs))) if history else 0)
    sums, at, views = whole(_moments), 0, []
    for k, squares in ((0, labelled[0].shape[1]), (1, 1)):
        width = labelled[k].shape[1]
        n, first, second = sums[at], sums[at + 1 : at + 1 + width], sums[at + 1 + width : at + 1 + 2 * width]
        centre = first / n
        views.append(View(centre, np.maximum(np.sqrt(np.maximum(second / n - centre**2, 0)), 1e-3), squares, np.zeros(width + squares + 1)))
        at += 1 + 2 * width
    both = (views[0], views[1])
    for _ in range(25):
        sums, at, largest = whole(partial(_newton, both)), 0, 0.0
        for view in both:
            n = len(view.beta)
            slope, curve = sums[at : at + n] + 0.5 * view.beta, sums[at + n : at + n + n * n].reshape(n, n) + 0.5 * np.eye(n)
            step = np.linalg.solve(curve, slope)
            view.beta = view.beta - step
            largest, at = max(largest, np.abs(step).max()), at + n + n * n
        if largest < 1e-6:
            break
    return both


def co_train(labelled: Views, y: np.ndarray, held: np.ndarray, unlabelled: Views | Spread, *, rounds: int = 4, sure: float = 0.97, share: float = 0.05) -> Model:
    """Both views after ``rounds`` of exchange; ``held`` marks the labelled rows that calibrate.

    In a round, a view gives the other its surest ``share`` of all unlabelled rows of either class (rows
    at the same margin together), as far as its chance is at least ``sure``.
    """
    rows = unlabelled if isinstance(unlabelled, Spread) else Held(unlabelled)
    edge = float(np.log(sure / (1 - sure)))
    history: list[Round] = []
    for turn in range(rounds + 1):
        views = _fitted((labelled[0][~held], labelled[1][~held]), y[~held], rows, history)
        ends = rows.ends(views, share) if turn < rounds else None
        if ends is None:
            break
        history.append((views, tuple((min(low, -edge), max(high, edge)) for low, high in ends)))
    rest = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    ones = np.ones(rest.sum())
    calibration = tuple(fit_logistic(np.stack([v.margin(x[rest]), ones], 1), y[rest], ones, ridge=0.01) for v, x in zip(views, labelled, strict=True))
    model = Model(views, calibration, None, float(y.mean()))
    model.combination = fit_logistic(model._joined((labelled[0][rest], labelled[1][rest])), y[rest], ones, ridge=0.1)
    return model


def _features(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` and the two views of each row."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            a = [text_features(t or "") for t in frame[text]]
            b = [metadata_features(*row) for row in zip(frame["lang"], frame["source"], frame["n_chars"], strict=True)]
            yield frame[keep].assign(content=a, metadata=b)

    return docs.select(*keep, *(c for c in (text, "lang", "source", "n_chars") if c not in keep)).mapInPandas(run, f"{fields}, content array<double>, metadata array<double>")


def _unlabelled(docs: DataFrame, once: DataFrame, key: str, text: str) -> DataFrame:
    """(content, metadata) of every document without a label, null keys included; only keys and features are shuffled."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, source, n_chars = (batch.column(i).to_pylist() for i in (2, 3, 4))
            a = pa.array([text_features(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.float64()))
            b = pa.array([metadata_features(*row) for row in zip(lang, source, n_chars, strict=True)], pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), a, b], [key, "content", "metadata"])

    found = docs.select(key, text, "lang", "source", "n_chars").mapInArrow(run, f"`{key}` {kind}, content array<double>, metadata array<double>")
    rest = checkpointed(found.join(once.select(key), key, "left_anti").select("content", "metadata"))
    return rest.coalesce(1 + rest.count() // ROWS_IN_PARTITION)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", labelled: int = 8000) -> Model:
    """Fits on at most ``labelled`` labelled documents (those of least hash) and exchanges labels over all others."""
    once = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("double").alias("y"))
    some = once.orderBy(F.xxhash64(key, F.lit(9))).limit(labelled)
    found = _features(docs.select(key, text, "lang", "source", "n_chars").join(F.broadcast(some), key), ["y"], text).toPandas()
    if found.empty:
        return Model(None, None, None, 1.0)
    content, metadata = np.stack(found["content"].to_numpy()), np.stack(found["metadata"].to_numpy())
    y = found["y"].to_numpy(float)
    if len(set(y)) < 2:
        return Model(None, None, None, float(y.mean()))
    order = np.lexsort((*content.T[:6], y))  # the same order, whatever order the rows came in
    held = np.arange(len(y)) % 4 == 3
    return co_train((content[order], metadata[order]), y[order], held, Spread(_unlabelled(docs, once, key, text)))


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the chance that a document is of good quality."""
    if model.views is None:
        return docs.select(key, F.lit(model.share).alias("score"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a = np.array([text_features(t.as_py() or "") for t in batch.column(1)])
            b = np.array([metadata_features(*row) for row in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)])
            yield pa.record_batch([batch.column(0), pa.array(model.chance((a, b)))], [key, "score"])

    return docs.select(key, text, "lang", "source", "n_chars").mapInArrow(run, f"`{key}` {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, score, keep): the chance of good quality, and whether it is at least ``threshold``."""
    scored = score(docs, train(docs, labels, key=key, text=text, label=label), key=key, text=text)
    return scored.select(key, "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, model: Model, *, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose chance of good quality is at least ``threshold``."""
    if model.views is None:
        return docs.where(F.lit(model.share >= threshold))

    def good(batch: pa.RecordBatch) -> np.ndarray:
        worker_cache("quality", dict)  # what earlier tasks kept goes
        lang, source, n_chars = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "source", "n_chars"))
        metadata = [metadata_features(*row) for row in zip(lang, source, n_chars, strict=True)]
        content = [text_features(t.as_py() or "") for t in batch.column(batch.schema.get_field_index(text))]
        return model.chance((np.array(content), np.array(metadata))) >= threshold

    return kept(docs, good, text)
