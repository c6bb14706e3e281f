"""Toxicity: a subsequence string kernel, Nyström landmarks, and a support vector machine over sentences.

The kernel compares two words (with marks at both ends) by all subsequences of four characters within
seven, each weighted by DECAY to the power of its span, so that a word with a gap or an inserted character
still resembles the word. A sentence's feature is the sum of its words' similarities to the landmarks, in
Nyström coordinates. Sentences of labelled documents train the machine: of toxic documents those with
the words most bound to toxic documents, of others a sample. As the machine is linear in the kernel, its
weights fold into one table over subsequences, with which every word of every text is scored; documents are
calibrated on labelled documents that took no part in this.

The fitting sample is chosen by hashes of keys and sentences, so it does not depend on how rows are dealt.

Defined results: null and empty texts, or texts without letters or digits, get the score of a document
without a suspicious word; repeated rows keep a row each; an empty table gives an empty result; without
labels of both kinds every score is the share of toxic ones (0 without any). Extra columns are not touched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import kept, slices, worker_cache
from tessera.llm.linear import fit_logistic, fit_svm, sigmoid

SPAN, DECAY = 7, 0.7
BUCKETS = 1 << 20
#: Longer words are scored as overlapping windows of WINDOW characters.
LONGEST, WINDOW = 22, 16
#: Words of at most MEMO_LETTERS that a worker remembers with their score.
MEMO, MEMO_LETTERS = 100_000, 40
#: Subsequences that are worked on at a time.
AT_ONCE = 300_000

_INNER = re.compile(r"[\W_]+")
_LETTERS = re.compile(r"(?<!\S)\w(?:[ ._*-]\w){3,}(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+")
#: Digits and signs that stand for letters inside words.
_STANDS_FOR = str.maketrans("013457@$", "oieastas")


def fold(token: str) -> str:
    """The word to compare: without signs at its ends and between its characters, figures within letters read as letters."""
    if token.isalpha():
        return token
    if any(c.isalpha() for c in token):
        token = token.rstrip(".,;:!?\"')]}#%&*$").translate(_STANDS_FOR)
    return _INNER.sub("", token)


def words_of(text: str) -> list[str]:
    """Lower-cased tokens between white space, and runs of single letters as one word."""
    text = text.lower()
    spaced = [m[0].replace(" ", "") for m in _LETTERS.finditer(text)]
    return text.split() + spaced


@cache
def _shapes(length: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(positions of the subsequences, their weights, the norm) of words of one length, end marks included."""
    places = np.array([p for p in combinations(range(length), 4) if p[3] - p[0] < SPAN], np.int64).reshape(-1, 4)
    weight = DECAY ** (places[:, 3] - places[:, 0] - 3).astype(float)
    return places, weight.astype(np.float32), float(np.sqrt((weight**2).sum())) or 1.0


_CODES = np.array([ord(chr(i).lower()) - 97 if chr(i).isalpha() else 26 + (i - 48 if 48 <= i < 58 else 0) for i in range(128)])


def _codes(words: list[str], length: int) -> np.ndarray:
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), length)
    codes = np.where(points < 128, _CODES[np.minimum(points, 127)], 36 + points % 26)
    return np.concatenate([np.full((len(words), 1), 62), codes, np.full((len(words), 1), 63)], 1)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """(which words, buckets of their subsequences, weights, norm), words of one length at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        if length == 0:
            continue
        places, weight, norm = _shapes(int(length) + 2)
        if not len(places):
            continue
        own, step = np.flatnonzero(lengths == length), max(1, AT_ONCE // len(places))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            codes = _codes([words[i] for i in some], int(length))
            joint = codes[:, places[:, 0]]
            for column in (1, 2, 3):
                joint = joint * 64 + codes[:, places[:, column]]
            yield some, ((joint * 0x9E3779B1) >> 9) & (BUCKETS - 1), weight, norm


def _windows(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


class Landmarks:
    """Landmark words and the map from similarities to Nyström coordinates."""

    def __init__(self, words: list[str]):
        self.words = words
        found: Counter = Counter()
        entries = []
        for which, buckets, weight, norm in _by_length(words):
            for i, own in zip(which, buckets, strict=True):
                entries += [(int(b), int(i), float(w) / norm) for b, w in zip(own, weight, strict=True)]
                found.update(own.tolist())
        self.row = {b: r + 1 for r, b in enumerate(found)}
        self.table = np.zeros((len(found) + 1, len(words)), np.float32)  # row 0: subsequences of no landmark
        for bucket, i, value in entries:
            self.table[self.row[bucket], i] += value
        self.of_bucket = np.zeros(BUCKETS, np.int32)
        self.of_bucket[list(self.row)] = list(self.row.values())
        share, axes = np.linalg.eigh(self.similarities(words).astype(float))
        self.root = (axes / np.sqrt(np.maximum(share, 1e-3))) @ axes.T

    def similarities(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        for which, buckets, weight, norm in _by_length(words):
            rows, total = self.of_bucket[buckets], np.zeros((len(which), len(self.words)), np.float32)
            for column in range(rows.shape[1]):
                total += weight[column] * self.table[rows[:, column]]
            out[which] = total / norm
        return out

    def folded(self, weights: np.ndarray) -> np.ndarray:
        """One number for each bucket: a word's weighted similarity is the sum over its subsequences."""
        out = np.zeros(BUCKETS, np.float32)
        buckets, rows = list(self.row), list(self.row.values())
        out[buckets] = self.table[rows] @ (self.root @ weights)
        return out


@dataclass
class Model:
    """The folded machine, the margin that a word must pass to count, and the calibration of documents."""

    table: np.ndarray | None
    calibration: np.ndarray
    share: float
    name: str = ""

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), -1.0, np.float32)
        parts, owner = [], []
        for i, word in enumerate(words):
            for part in _windows(fold(word)):
                parts.append(part)
                owner.append(i)
        scores = np.full(len(parts), -1.0, np.float32)
        for which, buckets, weight, norm in _by_length(parts):
            scores[which] = self.table[buckets] @ weight / norm
        np.maximum.at(out, np.array(owner, np.int64), scores)
        return out


def document_features(texts: list[str], model: Model) -> np.ndarray:
    """Per document: the greatest word score, the number of suspicious words, their sum for the length, the length, a constant."""
    known = worker_cache(("toxicity", model.name), dict)
    out, tokens = np.zeros((len(texts), 5)), [words_of(t) for t in texts]
    if len(known) > MEMO:
        known.clear()
    new = list({w for own in tokens for w in own if w not in known})
    scores = dict(zip(new, model.word_scores(new).tolist(), strict=True))
    known.update((w, g) for w, g in scores.items() if len(w) <= MEMO_LETTERS)
    for i, own in enumerate(tokens):
        g = np.fromiter((scores[w] if w in scores else known[w] for w in own), float, len(own)) if own else np.array([-1.0])
        hits = g[g > 0.25]
        top = np.sort(g)[-3:]
        out[i] = top[-1], np.log1p(len(hits)), hits.sum() / np.sqrt(len(g)), top.mean(), 1.0
    return out


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def fold_of(key: Column) -> Column:
    """crc32 of the key as text, modulo 4."""
    return F.crc32(key.cast("string").cast("binary")) % 4


def _sample(labels: DataFrame, key: str, label: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled keys, toxic ones first up to half of it, by hash."""
    once = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64(key, F.lit(5))
    some = [once.where(F.col("label") == one).orderBy(order).limit(bound // 2) for one in (0, 1)]
    return some[0].union(some[1])


def train(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
    documents: int = 16_000, sentences: int = 12_000, landmarks: int = 256,
) -> Model:
    """Fits on at most ``documents`` labelled documents and ``sentences`` of their sentences.

    Documents whose fold (see ``fold_of``) is 3 calibrate, the others train. The caller leaves out the
    labels that must not be learnt from.
    """
    chosen = _sample(labels, key, label, documents)  # a bounded sample: at most ``documents`` rows
    rows = docs.select(key, text).join(F.broadcast(chosen), key).withColumn("calibrates", fold_of(F.col(key)) == 3).persist()
    try:
        counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        if len(counts) < 2:
            return Model(None, np.zeros(5), share)
        fitted = rows.where(~F.col("calibrates")) if rows.where("calibrates").select("label").distinct().count() == 2 else rows
        toxic, benign = (max(1, r) for r in (fitted.where("label = 1").count(), fitted.where("label = 0").count()))

        def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                of = [({f for w in words_of(t) if 3 <= len(f := fold(w)) <= LONGEST}, one) for t, one in zip(_texts(batch.column("text")), batch.column("label").to_pylist(), strict=True)]
                yield pa.record_batch([pa.array([w for own, _ in of for w in own], pa.string()), pa.array([one for own, one in of for _ in own], pa.int32())], ["word", "label"])

        train_on = fitted.select(F.col(text).alias("text"), F.col(key).cast("string").alias("name"), "label")
        words = train_on.mapInArrow(distinct_words, "word string, label int").groupBy("word").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
        words = words.withColumn("neg", F.col("n") - F.col("pos")).persist()
        bound = F.col("pos") / toxic - F.col("neg") / benign
        surprise = bound / F.sqrt((F.col("pos") + F.col("neg") + 1) / (toxic + benign)) * F.least(F.lit(1.0), F.col("pos") / 2)
        marked = words.where("pos >= 2").withColumn("bound", surprise).orderBy(F.desc("bound"), "word").limit(4 * landmarks).collect()
        common = words.where("neg >= 2 and pos <= n / 4").orderBy(F.xxhash64("word")).limit(landmarks // 4).collect()
        words.unpersist()
        weight = {r["word"]: float(r["bound"]) for r in marked if r["bound"] > 0}
        chosen_words = [w for w in weight][: landmarks - len(common)] + [r["word"] for r in common if r["word"] not in weight]
        if not chosen_words:
            return Model(None, np.zeros(5), share)
        marks = Landmarks(chosen_words)
        per_toxic, per_benign = max(1, min(4, sentences // (2 * toxic))), max(1, min(8, sentences // (2 * benign)))

        def sentence_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                kept, label_of, order = [], [], []
                for value, name, one in zip(_texts(batch.column("text")), batch.column("name").to_pylist(), batch.column("label").to_pylist(), strict=True):
                    own = [[p for w in words_of(s) for p in _windows(fold(w)) if p] for s in _SENTENCE.split(value)]
                    own = [s for s in own if s]
                    if one:
                        own = sorted(own, key=lambda s: -max(weight.get(w, 0.0) for w in s))[:per_toxic]
                        own = [s for s in own if max(weight.get(w, 0.0) for w in s) > 0] or own[:1]
                    else:
                        own = [own[i] for i in np.random.default_rng(len(own)).permutation(len(own))[:per_benign]]
                    kept += own
                    label_of += [one] * len(own)
                    order += [xxhash.xxh3_64_intdigest(" ".join([name, *s])) >> 1 for s in own]
                for s in range(0, len(kept), 1000):
                    some = kept[s : s + 1000]
                    alone = list({w for own in some for w in own})
                    at = {w: i for i, w in enumerate(alone)}
                    z = marks.similarities(alone) @ marks.root
                    x = [z[[at[w] for w in own]].sum(0).astype(np.float32) for own in some]
                    yield pa.record_batch([pa.array(label_of[s : s + 1000], pa.int32()), pa.array(order[s : s + 1000], pa.int64()), pa.array(x, pa.list_(pa.float32()))], ["label", "place", "x"])

        found = train_on.mapInArrow(sentence_features, "label int, place long, x array<float>").orderBy("place", "label").limit(sentences).select("label", "x").toPandas()
        x = np.stack(found["x"].to_numpy()).astype(float)
        y = np.where(found["label"] == 1, 1.0, -1.0)
        x = np.concatenate([x, np.ones((len(x), 1))], 1)
        even = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
        beta = fit_svm(x, y, even, ridge=2.0)
        folded = marks.folded(beta[:-1])
        model = Model(folded, np.zeros(5), share, xxhash.xxh3_64_hexdigest(folded.tobytes()))

        held = rows.where("calibrates") if fitted is not rows else rows

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                yield pa.record_batch([batch.column("label"), pa.array(list(document_features(_texts(batch.column("text")), model)), pa.list_(pa.float64()))], ["label", "x"])

        seen = held.select(F.col(text).alias("text"), "label").mapInArrow(features, "label int, x array<double>").toPandas()
        x, y = np.stack(seen["x"].to_numpy()), seen["label"].to_numpy().astype(float)
        same = np.lexsort((y, *x.T))  # whatever order the rows came in
        x, y = x[same], y[same]
        model.calibration = fit_logistic(x, y, _natural_weights(y, labels, label), ridge=0.05)
        return model
    finally:
        rows.unpersist()


def _natural_weights(y: np.ndarray, labels: DataFrame, label: str) -> np.ndarray:
    """Weights that give the sample the share of toxic documents that all labels have."""
    share = labels.where(F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    own = y.mean()
    if not 0 < own < 1 or not 0 < share < 1:
        return np.ones(len(y))
    return np.where(y == 1, share / own, (1 - share) / (1 - own))


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the calibrated chance that a document is toxic."""
    kind = docs.schema[key].dataType.simpleString()
    if model.table is None:
        return docs.select(key, F.lit(float(model.share)).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = document_features(_texts(batch.column(1)), model)
            yield pa.record_batch([batch.column(0), pa.array(sigmoid(x @ model.calibration))], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def keep_mild(docs: DataFrame, model: Model, *, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``."""
    if model.table is None:
        return docs.where(F.lit(model.share < threshold))

    def mild(batch: pa.RecordBatch) -> np.ndarray:
        return sigmoid(document_features(_texts(batch.column(text)), model) @ model.calibration) < threshold

    return kept(docs, mild, text)


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted): labels of documents whose fold is 2 are not learnt from."""
    model = train(docs, labels.where(fold_of(F.col(key)) != 2), key=key, text=text, label=label)
    scored = score(docs, model, key=key, text=text)
    return scored.select(key, F.coalesce(fold_of(F.col(key)) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
