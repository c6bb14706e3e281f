"""Personal data by weak supervision: labelers vote on candidate spans, EM learns whom to trust.

Candidates are the base patterns and looser ones around them. Four labelers vote for, against or not at
all: the strict pattern with its check (regex), lists of domains, issuers and dialling codes (gazetteer),
words shortly before the span (context), and the form of the span (shape). Expectation-maximisation over
the counts of vote patterns, of which there is a fixed number, estimates each labeler's reliability and
the share of true spans of each kind. Its posteriors are the soft labels of a logistic span classifier, which
sees the span and what stands around it (kinds of characters, lengths, groups of digits, words before), not the
votes; it is fitted by sums over all candidates, and decides on the looser ones. Base spans always stay.

Defined results: a null or empty text has no spans and the digest of no spans; repeated rows keep a row
each; an empty table, or one without candidates, adds nothing; extra columns are not touched. Positions
are code points, ends exclusive.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, slices, span_digests
from tessera.llm.linear import fit_logistic_over, sigmoid

# The base patterns of the contract; of an e-mail address, the part after the @ and the characters before it.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]

_SPOKEN_EMAIL = re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64}\s?[\[({<]\s?(?:at|AT)\s?[\])}>]\s?[A-Za-z0-9-]{1,63}(?:\s?[\[({<]\s?(?:dot|DOT)\s?[\])}>]\s?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\)[ .-]?|0[0-9]{1,4}[ ./-]|[0-9]{3}[.-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w.-]?[0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# The gazetteers.
_ENDINGS = frozenset("com org net edu gov io co info biz de fr es it nl uk us eu ch at be pl pt br mx".split())
_ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "38")
_DIALLING = ("+1", "+7", "+20", "+27", "+30", "+31", "+32", "+33", "+34", "+36", "+39", "+4", "+5", "+60", "+61", "+62", "+63", "+64", "+65", "+66", "+81", "+82", "+84", "+86", "+90", "+91")
_IBAN_LANDS = frozenset("AT BE BG CH CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV NL NO PL PT RO SE SI SK".split())
_FOR = re.compile(r"(?i)(e-?mail|mail|contact|kontakt|correo|courriel|phone|tel(?:efon|éfono|éphone)?|call|mobile|fax|cell|whatsapp|card|visa|karte|tarjeta|carte|iban|konto|account|ssn|social security|ip|host|address|adresse)\W{0,12}$")
_AGAINST = re.compile(r"(?i)(version|order|isbn|serial|part|section|chapter|id|ref|invoice|model|sku|doi|release|build)\W{0,6}$")

#: Votes for (1), against (0) or none (-1), in this order.
LABELERS = ("regex", "gazetteer", "context", "shape")


def luhn(digits: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(twice[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _iban_holds(span: str) -> bool:
    plain = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost addresses that don't overlap, found outward from each @, so that each character is looked at a few times only."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = free + len(text[free:at].rstrip(_LOCAL))
            if start < at:
                yield start, domain.end()
                free = domain.end()
        free = max(free, at + 1)
        at = text.find("@", free)


def _candidates(text: str) -> Iterator[tuple[str, int, int, bool, bool]]:
    """(kind, start, end, base, passes its check) of all candidates; what fails a checksum or a range is none."""
    for start, end in _emails(text):
        yield "email", start, end, True, True
    if "at" in text or "AT" in text:
        for m in _SPOKEN_EMAIL.finditer(text) if re.search(r"[\[({<]\s?(?:at|AT)\s?[\])}>]", text) else ():
            yield "email", *m.span(), False, True
    if not re.search("[0-9]", text):
        return
    for m in _IP.finditer(text):
        fine = all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))
        if fine:
            yield "ip", *m.span(), True, True
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if len(m[0]) < 64 else ""
        if 13 <= len(digits) <= 19:
            if luhn(digits):
                yield "card", *m.span(), len(digits) >= 16, True
    if "+" in text:
        for m in _PHONE.finditer(text):
            fine = 8 <= sum(c.isdigit() for c in m[0]) <= 15
            yield "phone", *m.span(), fine, fine
    for m in _LOCAL_PHONE.finditer(text):
        yield "phone", *m.span(), False, 8 <= sum(c.isdigit() for c in m[0]) <= 15
    for m in _IBAN.finditer(text):
        if _iban_holds(m[0]):
            yield "iban", *m.span(), False, True
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        yield "ssn", *m.span(), False, area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _gazetteer(kind: str, span: str) -> int:
    if kind == "email":
        return int(re.split(r"[.\s\])}>]+", span)[-1].lower() in _ENDINGS)
    if kind == "card":
        return int(span.startswith(_ISSUERS))
    if kind == "phone" and span[0] == "+":
        return int(span.startswith(_DIALLING))
    if kind == "ip":
        return 0 if re.match(r"0|127\.|255\.|22[4-9]\.|23\d\.", span) else -1
    if kind == "iban":
        return int(span[:2] in _IBAN_LANDS)
    return -1


def _shape(kind: str, span: str) -> int:
    digits = [c for c in span if c.isdigit()]
    if kind == "email":
        return int(len(span) <= 80 and span[0] not in ".-%")
    if len(set(digits)) <= 2:
        return 0  # 0000 0000, 1212 1212
    if kind == "phone":
        return int(9 <= len(digits) <= 14 and (span[0] == "+" or bool(re.search(r"[ ().-]", span))))
    if kind == "card":
        return int(len(digits) >= 15)
    return -1 if kind == "ip" else 1


def _votes(text: str, kind: str, start: int, end: int, passes: bool) -> list[int]:
    before, span = text[max(0, start - 40) : start], text[start:end]
    context = 1 if _FOR.search(before) else 0 if _AGAINST.search(before) else -1
    return [int(passes), _gazetteer(kind, span), context, _shape(kind, span)]


#: Slots for the words before a span, by hash.
WORD_SLOTS = 24
_WORDS = re.compile(r"[^\W\d_]{2,20}")
WIDTH = 1 + len(KINDS) + 16 + WORD_SLOTS


def _features(text: str, kind: str, start: int, end: int, passes: bool) -> np.ndarray:
    """What the span classifier sees: the kind, the span's characters and groups, its neighbours, the words before it."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 1]
    n, digits = len(span), [c for c in span if c.isdigit()]
    groups = [len(g) for g in re.findall("[0-9]+", span[:200])] or [0]
    out = np.zeros(WIDTH, np.float32)
    out[0] = out[1 + KINDS.index(kind)] = 1
    out[1 + len(KINDS) : 17 + len(KINDS)] = [
        min(n, 64) / 32, len(digits) / n, len(set(digits)) / 10, min(len(groups), 8) / 8, min(max(groups), 16) / 16, min(groups[-1], 16) / 16,
        sum(c.isupper() for c in span) / n, sum(c.isspace() for c in span) / n, span.count(".") / n, span.count("-") / n,
        span[0] in "+(", passes, before[-1:].isalnum(), before[-1:] in (":", "=") or before[-2:] in (": ", "= "), after.isalnum(), not before,
    ]
    for word in _WORDS.findall(before.lower())[-3:]:
        out[17 + len(KINDS) + xxhash.xxh3_64_intdigest(word) % WORD_SLOTS] = 1
    return out


def _apart(found: list[tuple[str, int, int, bool, bool]]) -> list[tuple[str, int, int, bool, bool]]:
    """The base candidates, and those that overlap none of them, by kind as listed, then start."""
    merged: list[list[int]] = []
    for start, end in sorted((c[1], c[2]) for c in found if c[3]):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    starts = [m[0] for m in merged]
    clear = lambda a, b: (i := bisect_left(starts, b)) == 0 or merged[i - 1][1] <= a
    return sorted((c for c in found if c[3] or clear(c[1], c[2])), key=lambda c: (KINDS.index(c[0]), c[1]))


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.float32()))]))
_FOUND_SQL = "array<struct<kind:string,start:long,end:long,base:boolean,votes:string,features:array<float>>>"


def candidates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, found array<struct<kind, start, end, base, votes, features>>) for each document: base spans, and candidates that overlap none."""
    key_kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for value in batch.column(1):
                value, own = value.as_py() or "", []
                for kind, start, end, base, passes in _apart(list(_candidates(value))):
                    votes = ",".join(map(str, _votes(value, kind, start, end, passes)))
                    own.append({"kind": kind, "start": start, "end": end, "base": base, "votes": votes, "features": _features(value, kind, start, end, passes)})
                out.append(own)
            yield pa.record_batch([batch.column(0), pa.array(out, _FOUND)], [key, "found"])

    return docs.select(key, text).mapInArrow(scan, f"`{key}` {key_kind}, found {_FOUND_SQL}")


#: What a vote counts for at first, as log odds, by labeler: a word beside the span says more than that its form is possible.
TRUST = (0.7, 1.0, 2.5, 0.7)


def reliabilities(votes: np.ndarray, kinds: np.ndarray, counts: np.ndarray, rounds: int = 60, trust: tuple[float, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """EM for labelers of unknown reliability: (posterior of each vote pattern, P(vote | truth, it votes) as labeler x truth x vote).

    A labeler that doesn't vote says nothing. ``trust`` is where EM starts from, 2 for each labeler by default.
    """
    sign = np.where(votes < 0, 0, 2 * votes - 1)
    truth = 1 / (1 + np.exp(-sign @ np.array(trust or [2.0] * votes.shape[1])))
    for _ in range(rounds):
        by_truth = np.stack([1 - truth, truth]) * counts
        chance = np.ones((votes.shape[1], 2, 2))  # one pseudo-count each
        for labeler in range(votes.shape[1]):
            for vote in (0, 1):
                chance[labeler, :, vote] += by_truth[:, votes[:, labeler] == vote].sum(1)
        chance /= chance.sum(2, keepdims=True)
        log = np.zeros((2, len(counts)))
        for one in np.unique(kinds):
            own = kinds == one
            share = (by_truth[:, own].sum(1) + 1) / (counts[own].sum() + 2)
            log[:, own] = np.log(share)[:, None]
        for labeler in range(votes.shape[1]):
            given = votes[:, labeler] >= 0
            log[:, given] += np.log(chance[labeler][:, votes[given, labeler]])
        truth = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return truth, chance


@dataclass
class Classifier:
    """The span classifier's weights; None where there was nothing to learn from, so that it accepts nothing."""

    beta: np.ndarray | None
    threshold: float

    def accepts(self, features: np.ndarray) -> np.ndarray:
        """Which rows of features have at least the threshold's chance."""
        if self.beta is None or not len(features):
            return np.zeros(len(features), bool)
        return sigmoid((features.astype(float) * self.beta).sum(1)) >= self.threshold


#: The candidates of one vote pattern weigh as much as so many in the classifier, at most, so that kinds with few of them count too.
MOST_OF_ONE = 1000.0


def train(found: DataFrame, *, threshold: float = 0.5) -> Classifier:
    """EM over the vote patterns of ``found`` (see ``candidates``), then the span classifier on its posteriors, over all candidates."""
    spans = checkpointed(found.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.features"))
    patterns = spans.groupBy("kind", "votes").count().orderBy("kind", "votes").collect()  # 6 kinds x 3^4 patterns at most
    if not patterns:
        return Classifier(None, threshold)
    counts = np.array([p["count"] for p in patterns], float)
    truth, _ = reliabilities(np.array([[int(v) for v in p["votes"].split(",")] for p in patterns]), np.array([KINDS.index(p["kind"]) for p in patterns]), counts, trust=TRUST)
    of = {(p["kind"], p["votes"]): (t, min(n, MOST_OF_ONE) / n) for p, t, n in zip(patterns, truth, counts, strict=True)}

    def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, WIDTH).astype(float)
        y, weight = np.array([of[p] for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]).T
        return x, y, weight

    return Classifier(fit_logistic_over(spans, rows_of, WIDTH), threshold)


def find_pii(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, spans array<struct<kind, start, end, base>>) of each document, by kind as listed, then start.

    An added span overlaps no base span and has a probability of at least ``threshold``.
    """
    found = checkpointed(candidates(docs, key=key, text=text))
    classifier = train(found, threshold=threshold)
    key_kind = docs.schema[key].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(1).to_pylist():
                likely = classifier.accepts(np.array([c["features"] for c in own], np.float32))
                out.append([{k: c[k] for k in ("kind", "start", "end", "base")} for c, fine in zip(own, likely, strict=True) if c["base"] or fine])
            yield pa.record_batch([batch.column(0), pa.array(out, spans)], [key, "spans"])

    return found.mapInArrow(decide, f"`{key}` {key_kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def redact(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets; of overlapping spans the earlier, then longer one.

    The spans are those of ``find_pii``, worked out again where the text stands: no key is used, so keys may
    repeat or be null. Texts without spans are untouched, nulls included.
    """
    classifier = train(candidates(docs.select(F.lit(0).alias(key), text), key=key, text=text), threshold=threshold)
    at = docs.columns.index(text)

    def replaced(value: str | None) -> str | None:
        found = _apart(list(_candidates(value or "")))
        if not found:
            return value
        likely = classifier.accepts(np.array([_features(value, kind, start, end, passes) for kind, start, end, _, passes in found]))
        parts, done = [], 0
        for kind, start, end in sorted((c[:3] for c, fine in zip(found, likely, strict=True) if c[3] or fine), key=lambda s: (s[1], -s[2])):
            if start >= done:
                parts += [value[done:start], f"<{kind}>"]
                done = end
        return "".join([*parts, value[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.set_column(at, text, pa.array([replaced(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans): spans as ``kind:start:end``, comma-joined."""
    return span_digests(find_pii(docs, key=key, text=text), {f"n_{kind}": kind for kind in BASE_KINDS}, key=key)
