"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles. XOR-hashing the set into a sketch of bits makes the
Hamming distance of two sketches a lower bound of the sets' symmetric difference. Two sets of sizes a and
b with Jaccard similarity of at least p/q differ in at most (a + b)(q - p)/(q + p) elements; so within a
band of sizes, a sketch cut into more segments than that has whole segments in which similar sets agree
(pigeonhole). Sets are joined on (band, segment, its bits), the Hamming distance of a short sketch excludes
most of what shares a segment by chance or by a common passage, and the rest is verified exactly.

The sketch that is cut has 2**64 bits a segment and is never written out: a segment is known by the XOR of
its shingles' 64-bit hashes. Empty segments say nothing, so there are a few segments more than the
pigeonhole needs; a set with no more empty ones than that leaves them out.

Copies are reduced to one set first. In each segment all sets are held against the first one. Sets that then still
share a segment with others that they aren't linked to are held against those by their rarest shingles: in the order
of how many of these sets hold a shingle, the first one that two similar sets share has at least the rest of
their intersection behind it in both, so that sets which only have a common passage, or many changes each, seldom meet.
Of those that share such a shingle, each is held against a few leaders, not against all others: sets found to be linked
already need no pair of their own, leaders have met all and leave, and the rest meets more leaders in the next round, until
each pair of unlinked sets has been verified or excluded by size, place or sketch. No link between different sets is lost.

Defined results: null and empty texts, or texts without words, have the empty set and are linked with
nothing, each other included; a key is expected to stand for one text, and rows that repeat it count as copies; an empty table gives an empty
result; null keys are never chosen as a class's or group's id unless alone; extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import checkpointed, release, slices, stored, worker_cache
from tessera.llm.pretokens import Memo
from tessera.operators.graph import components

#: Sizes of one band differ by less than this factor.
BAND = 1.5
#: The lowest bits of a segment's number are its band.
BAND_BITS = 7
#: 64-bit words of the folded sketch that goes with each segment; the whole one grows with the set and joins pairs only.
FOLDED = 16
#: Words that a worker remembers with their hash.
MEMO = 100_000
#: Shingles of the sets that are verified against one leader in one task.
GROUP_SHINGLES = 1_000_000
#: Up to so many rows of ids (32 bytes each) are broadcast; of more, a filter of bits.
BROADCAST_IDS = 200_000
#: Bits of that filter for each id, and the most 64-bit words it has.
FILTER_BITS, FILTER_WORDS = 16, 1 << 21

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of so many words; of the whole text's words if it has fewer.

    A-Z are lower-cased; words are runs of anything but space and the control characters 9 to 13.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    known = worker_cache("word hashes", lambda: Memo(xxhash.xxh3_64_intdigest, MEMO))
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    k = min(words, len(hashes))
    out = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _MIX + hashes[i : len(hashes) - k + 1 + i])
    return np.unique(out)


class Bands:
    """Which sketches a set of a given size takes part in, for a similarity of at least part/whole."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole
        self.ends = [1]  # sizes of band i: ends[i] <= size < ends[i + 1]

    def of(self, size: int) -> int:
        while self.ends[-1] <= size:
            self.ends.append(max(self.ends[-1] + 1, int(self.ends[-1] * BAND)))
        lo, hi = 0, len(self.ends)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.ends[mid] <= size else (lo, mid)
        return lo

    def segments(self, size: int) -> list[tuple[int, int, int]]:
        """(band, number of segments, how many of them may be left out) for each band in which a set of this size can be of a pair."""
        out = []
        largest = size * self.whole // self.part
        for band in range(self.of(size), self.of(largest) + 1):
            self.of(self.ends[band])
            bottom, differ = self.ends[band] * self.part // self.whole, self.most_apart(band)
            if differ:  # else only equal sets are similar
                empty = np.exp(-bottom / (differ + 1))  # of sets of the least size
                spare = 2 + int(1.5 * empty * (differ + 1))
                out.append((band, differ + 1 + spare, spare))
        return out

    def most_apart(self, band: int) -> int:
        """The largest symmetric difference of similar sets of the band."""
        self.of(self.ends[band])
        return 2 * (self.ends[band + 1] - 1) * (self.whole - self.part) // (self.whole + self.part)

    def sketch_words(self, band: int) -> int:
        """64-bit words of the short sketch: four bits for each element that similar sets may differ in, so that strangers differ in more bits."""
        return -(-4 * self.most_apart(band) // 64)


def sketch(shingles: np.ndarray, band: int, words: int) -> np.ndarray:
    """The short parity sketch: the XOR of one bit for each shingle."""
    bit = _mixed(shingles + np.uint64(2 * band + 1)) % np.uint64(64 * words)
    parity = (np.bincount(bit.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view("<i8")


def folded(whole: np.ndarray) -> np.ndarray:
    """The parity sketch of FOLDED words that the XOR of a longer one's words gives."""
    if len(whole) <= FOLDED:
        return whole
    padded = np.zeros(-(-len(whole) // FOLDED) * FOLDED, whole.dtype)
    padded[: len(whole)] = whole
    return np.bitwise_xor.reduce(padded.reshape(-1, FOLDED), axis=0)


def segment_keys(shingles: np.ndarray, band: int, segments: int, spare: int) -> np.ndarray:
    """A number for each segment and what it holds; without empty segments if there are no more than ``spare``."""
    mixed = _mixed(shingles + np.uint64(2 * band + 2))
    place = ((mixed >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    order = np.argsort(place, kind="stable")
    own, starts = np.unique(place[order], return_index=True)
    held = np.bitwise_xor.reduceat(_mixed(mixed[order] ^ _MIX), starts)
    content = np.zeros(segments, np.uint64)
    content[own.astype(np.int64)] = held
    key = _mixed(content + _mixed(np.arange(segments, dtype=np.uint64))) << np.uint64(BAND_BITS) | np.uint64(band)
    return (key if segments - len(own) > spare else key[own.astype(np.int64)]).view(np.int64)


def _sketched(docs: DataFrame, key: str, text: str, words: int, part: int, whole: int) -> DataFrame:
    """Rows (key, first, size, high, low, band, sketch, folded): for each document one for each of its bands, or one without a band.

    high and low are a 128-bit hash of the set.
    """
    kind = docs.schema[key].dataType.simpleString()
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(part, whole)
        for batch in slices(batches):
            rows = []
            for i, value in enumerate(batch.column(1)):
                shingles = shingle_set(value.as_py() or "", words)
                digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
                same = (len(shingles), (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63))
                own = bands.segments(len(shingles)) if len(shingles) else []
                if not own:
                    rows.append((i, True, *same, None, None, None))
                for k, (band, _, _) in enumerate(own):
                    long = sketch(shingles, band, bands.sketch_words(band))
                    rows.append((i, k == 0, *same, band, long, folded(long)))
            which, first, size, high, low, band, long, short = zip(*rows, strict=True) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(which, pa.int64())), pa.array(first, pa.bool_()), pa.array(size, pa.int64()), pa.array(high, pa.int64()),
                    pa.array(low, pa.int64()), pa.array(band, pa.int32()), pa.array(long, longs), pa.array(short, longs),
                ],
                names=[key, "first", "size", "high", "low", "band", "sketch", "folded"],
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, first boolean, size long, high long, low long, band int, sketch array<long>, folded array<long>")


def _chosen(docs: DataFrame, ids: DataFrame, count: int, key: str, text: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """Rows that begin with (key, text), and what leaves of a batch of them the documents whose key is one of ``count`` ids.

    Few ids are broadcast. Many would fill the driver's memory, and a shuffle join would move all texts: they reach the tasks as a filter of bits, which
    its size bounds and which lets a few other documents through. Whoever asks must bear those, or join what it makes of them.
    """
    own = docs.select(key, text)
    if count <= BROADCAST_IDS:
        return own.join(F.broadcast(ids.select(F.col("id").alias(key))), key, "left_semi"), lambda batch: batch
    words = min(FILTER_WORDS, 1 + count * FILTER_BITS // 64)

    def place(column: str) -> list[Column]:
        """The word of an id, and its bits there."""
        h = f"xxhash64(cast(`{column}` as bigint))"
        bits = " | ".join(f"shiftleft(1L, cast(shiftright({h}, {k}) & 63 as int))" for k in (0, 6, 12))
        return [F.expr(f"cast(pmod(shiftrightunsigned({h}, 18), {words}L) as int)").alias("_word"), F.expr(bits).alias("_bits")]

    found = ids.select(*place("id")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits")).toArrow()
    held = np.zeros(words, np.int64)
    held[np.asarray(found.column(0))] = np.asarray(found.column(1))
    known = docs.sparkSession.sparkContext.broadcast(held)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.asarray(batch.column(3))
        return batch.filter(pa.array(known.value[np.asarray(batch.column(2))] & bits == bits))

    return own.where(F.col(key).isNotNull()).select(key, text, *place(key)), keep


def _segments(docs: DataFrame, ids: DataFrame, key: str, text: str, words: int, part: int, whole: int) -> DataFrame:
    """(id, segment): the segment keys, in all their bands, of the documents whose key is an id, and of a few of their copies."""
    rows, keep = _chosen(docs, ids, ids.count(), key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(part, whole)
        for batch in map(keep, slices(batches)):
            keys = []
            for value in batch.column(1):
                shingles = shingle_set(value.as_py() or "", words)
                own = [segment_keys(shingles, *band) for band in (bands.segments(len(shingles)) if len(shingles) else [])]
                keys.append(np.concatenate(own) if own else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "segments"])

    return rows.mapInArrow(run, "id long, segments array<long>").select("id", F.explode("segments").alias("segment"))


def _rare_shingles(docs: DataFrame, ids: DataFrame, sets: DataFrame, key: str, text: str, words: int, part: int, whole: int) -> DataFrame:
    """(segment, id, place): shingles that at least two of the documents whose key is an id hold, in all bands of the set, marked with the band like segments.

    The place counts from the rarest shingle of the set; places that no similar set can have for its first common shingle are left out.
    Documents that ``_chosen`` lets through besides count for how rare a shingle is, the same for all sets.
    """
    rows, keep = _chosen(docs, ids, ids.count(), key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(keep, slices(batches)):
            found = [shingle_set(value.as_py() or "", words).view(np.int64) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in found], pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["id", "size", "shingles"]
            )

    held = rows.mapInArrow(run, "id long, size int, shingles array<long>").select("id", "size", F.explode("shingles").alias("shingle"))
    held = held.withColumn("n", F.count("*").over(Window.partitionBy("shingle"))).where("n > 1")
    # counted from the end, as shingles that no other set holds come first
    behind = F.dense_rank().over(Window.partitionBy("id", "size").orderBy(F.desc("n"), F.desc("shingle")))
    placed = held.withColumn("behind", behind).where(F.col("behind") * whole >= F.col("size") * part)
    placed = placed.select("id", "size", "shingle", (F.col("size") - F.col("behind") + 1).alias("place"))
    banded = placed.join(sets.select("id", "band", "size"), ["id", "size"])
    return banded.select(F.shiftleft("shingle", BAND_BITS).bitwiseOR(F.col("band").cast("long")).alias("segment"), "id", "place").distinct()


def _smallest_labels(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each id of the edges (a, b) reaches.

    Rounds grow with the logarithm of the longest chain and read what they wrote. A loop over checkpoints would keep the estimated size of each round's plan, which
    is the product of those before: a number whose digits grow exponentially with the rounds and fill the driver's memory.
    """
    found = components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.select(F.col("node").alias("id"), F.col("component").alias("label"))


def _verified(docs: DataFrame, pairs: DataFrame, count: int, key: str, text: str, words: int, part: int, whole: int) -> DataFrame:
    """Those of the pairs (a, b) of keys whose sets are similar enough, with the size of the intersection.

    ``count`` is the number of pairs, which carry the size of b. Only documents in a pair are read into sets. A
    leader's set is sent once to each group of partners that have about GROUP_SHINGLES together.
    """
    sizes = pairs.groupBy("a").agg(F.greatest(F.lit(1), F.ceil(F.sum("size_b") / GROUP_SHINGLES)).cast("int").alias("groups"))
    pairs = checkpointed(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part")), count)
    leaders = pairs.select(F.col("a").alias(key), "a", "part", F.lit(True).alias("leads")).distinct()
    wanted = leaders.unionByName(pairs.select(F.col("b").alias(key), "a", "part", F.lit(False).alias("leads")))
    wanted = checkpointed(wanted, 3 * count)
    if 3 * count <= BROADCAST_IDS:
        rows = docs.select(key, text).join(F.broadcast(wanted), key)
    else:  # only texts that are in a pair are shuffled
        ids = checkpointed(wanted.select(F.col(key).cast("long").alias("id")).distinct(), 3 * count)
        own, keep = _chosen(docs, ids, ids.count(), key, text)
        texts = own.mapInArrow(lambda batches: (keep(batch).select([key, text]) for batch in slices(batches)), docs.select(key, text).schema)
        rows = texts.join(wanted, key)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            found = [shingle_set(value.as_py() or "", words).tobytes() for value in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())], names=[key, "a", "part", "leads", "shingles"])

    kind = docs.schema[key].dataType.simpleString()
    placed = rows.select(key, "a", "part", "leads", text).mapInArrow(sets, f"`{key}` {kind}, a long, part int, leads boolean, shingles binary")

    def compare(table: pa.Table) -> pa.Table:
        leads = table.column("leads").to_pylist()
        if True not in leads:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "shared": pa.array([], pa.int64())})
        data, ids = table.column("shingles"), table.column(key)
        first = leads.index(True)
        leader = np.frombuffer(data[first].as_py(), np.uint64)
        b, shared = [], []
        for i, is_leader in enumerate(leads):
            if is_leader:
                continue
            other = np.frombuffer(data[i].as_py(), np.uint64)
            small, large = sorted((len(leader), len(other)))
            if small * whole < large * part:
                continue
            same = len(np.intersect1d(leader, other, assume_unique=True))
            if same * whole >= part * (small + large - same):
                b.append(ids[i].as_py())
                shared.append(same)
        return pa.table({"a": pa.array([ids[first].as_py()] * len(b), pa.int64()), "b": pa.array(b, pa.int64()), "shared": pa.array(shared, pa.int64())})

    return checkpointed(placed.groupBy("a", "part").applyInArrow(compare, "a long, b long, shared long"))


def _apart(x: str, y: str) -> Column:
    """The Hamming distance of two sketches."""
    return F.aggregate(F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda n, v: n + v)


def jaccard_components(
    docs: DataFrame, *, words: int = 5, similarity: tuple[int, int] = (4, 5), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_shingles, component_id): the set's size and the smallest key reachable by links, itself included.

    Two documents link when whole * |intersection| >= part * |union| for ``similarity`` = (part, whole), and
    neither set is empty. Keys are numbers. ``class_id`` is the smallest key with the same set.
    """
    part, whole = similarity
    rows = checkpointed(_sketched(docs, key, text, words, part, whole))
    base = rows.where("first").select(key, "size", "high", "low")
    classes = base.where("size > 0").groupBy("high", "low").agg(F.min(key).alias("class_id"))
    # one row for each set and band, whatever the number of its copies; only then are the segments dealt out
    banded = rows.where("band is not null").groupBy("high", "low", "band")
    id_ = F.min(key).cast("long").alias("id")
    alike = [F.first(c).alias(c) for c in ("size", "sketch", "folded")]  # the same for all copies
    sets = checkpointed(banded.agg(id_, *alike).where("id is not null").select("id", "band", "size", "sketch", "folded"))
    segments = _segments(docs, sets.select("id").distinct(), key, text, words, part, whole)
    one = Window.partitionBy("segment")
    shared = segments.withColumns({"a": F.min("id").over(one), "n": F.count("*").over(one)}).where("a <> id")
    shared = checkpointed(shared.select("segment", "id", "a", "n"))

    edges, tested, labels = None, None, None
    near = lambda x, y, size_x, size_y: _apart(x, y) * (whole + part) <= (F.col(size_x) + F.col(size_y)) * (whole - part)
    of = lambda x, sketch: sets.select("band", F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col(sketch).alias(f"{sketch}_{x}"))
    band = F.col("segment").bitwiseAND((1 << BAND_BITS) - 1).cast("int").alias("band")

    def look(pairs: DataFrame, bound: int) -> None:
        """Verifies those of the pairs (band, a, b) that the whole sketch doesn't exclude and that weren't verified before."""
        nonlocal edges, tested, labels
        pairs = pairs.join(of("a", "sketch"), ["a", "band"]).join(of("b", "sketch"), ["b", "band"]).where(near("sketch_a", "sketch_b", "size_a", "size_b"))
        pairs = pairs.select("a", "b", "size_b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = checkpointed(pairs, bound)
        count = pairs.count()
        if not count:
            return
        found = _verified(docs, pairs, count, key, text, words, part, whole)
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        if not found.isEmpty():
            edges = found if edges is None else edges.union(found)
            labels = _smallest_labels(edges)

    def unlinked(rows: DataFrame) -> DataFrame:
        """Rows, with their labels, of segments in which not all sets are linked."""
        if labels is None:
            named = rows.withColumn("label", F.col("id"))
        else:
            named = rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        sides = {"_least": F.min("label").over(one), "_most": F.max("label").over(one)}
        return named.withColumns(sides).where("_least <> _most").drop("_least", "_most")

    rows_left = shared.count()
    similar = F.least("size_a", "size_b") * whole >= F.greatest("size_a", "size_b") * part
    pairs = shared.select(band, "a", F.col("id").alias("b")).distinct().join(of("a", "folded"), ["a", "band"]).join(of("b", "folded"), ["b", "band"])
    look(pairs.where(similar & near("folded_a", "folded_b", "size_a", "size_b")).select("band", "a", "b"), rows_left)
    ids = checkpointed(unlinked(shared.where("n > 2").select("segment", "id")).select("id").distinct(), rows_left)
    del shared, pairs
    release(docs.sparkSession)
    leaders, left = 8, None
    if not ids.isEmpty():
        left = checkpointed(_rare_shingles(docs, ids, sets, key, text, words, part, whole))
    while left is not None:  # until every pair of unlinked sets that share a rare shingle has been looked at
        place = F.row_number().over(one.orderBy("id"))
        open_ = unlinked(left.select("segment", "id", "place")).withColumn("band", band).join(sets.drop("sketch"), ["id", "band"])
        # written, so that the join is a stage of its own and Spark may split a segment that very many sets share
        open_ = checkpointed(open_.withColumn("turn", place))
        rows_left = open_.count()
        if not rows_left:
            break
        lead = open_.where(F.col("turn") <= leaders).select("segment", "turn", *(F.col(c).alias(f"{c}_a") for c in ("id", "size", "label", "folded", "place")))
        # behind its first common shingle each set has the whole intersection
        least = (F.col("size") + F.col("size_a")) * part
        pairs = open_.withColumnRenamed("turn", "own").join(lead, "segment").where(
            (F.col("own") > F.col("turn"))
            & (F.col("label") != F.col("label_a"))
            & (F.least("size", "size_a") * whole >= F.greatest("size", "size_a") * part)
            & ((F.col("size") - F.col("place") + 1) * (whole + part) >= least)
            & ((F.col("size_a") - F.col("place_a") + 1) * (whole + part) >= least)
            & near("folded", "folded_a", "size", "size_a")
        )
        look(pairs.select("band", F.least("id_a", "id").alias("a"), F.greatest("id_a", "id").alias("b")).distinct(), rows_left * leaders)
        left = open_.where(F.col("turn") > leaders)
        leaders *= 8
        del open_, lead, pairs
        release(docs.sparkSession)
    out = base.join(classes, ["high", "low"], "left").select(F.col(key), F.col("size").alias("n_shingles"), "class_id")
    out = out.withColumn("class_id", F.when(F.col("n_shingles") > 0, F.coalesce("class_id", key)).otherwise(F.col(key)))
    if labels is None:
        return out.withColumn("component_id", F.col("class_id")).select(key, "n_shingles", "component_id", "class_id")
    found = out.join(labels.select(F.col("id").alias("class_id"), "label"), "class_id", "left")
    return found.select(key, "n_shingles", F.coalesce("label", "class_id").alias("component_id"), "class_id")


def one_of_each(docs: DataFrame, *, words: int = 5, similarity: tuple[int, int] = (4, 5), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of ``docs``, of least key in it; documents without words are all kept.

    Rows are told apart by an id of their own, not by their key, so keys may repeat or be null; a null key
    comes after all others. Of repeated rows one is kept.
    """
    own = "_row_id"
    while own in map(str.lower, docs.columns):
        own += "_"
    rows = stored(docs.withColumn(own, F.monotonically_increasing_id()))
    groups = jaccard_components(rows, words=words, similarity=similarity, key=own, text=text)
    named = groups.where("n_shingles > 0").join(rows.select(own, F.col(key).alias("key")), own)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", own)).alias("first"))
    keep = first.select(f"first.{own}").unionByName(groups.where("n_shingles = 0").select(own))
    return rows.join(keep, own, "left_semi").select(*docs.columns)
