"""Best-fit decreasing packing of tokenised documents into sequences of bounded length.

Best-fit decreasing looks at lengths only, and there are at most ``capacity`` of them. So the driver
plans from the histogram of lengths: a segment tree over remaining capacities finds the tightest open
sequences in logarithmic time, for all pieces of one length at once, and gives exactly the sequences
that taking the pieces one by one would give. The pieces are numbered within their length by a
distributed count, and each finds its sequence and offset in the plan.

Defined results: a null or empty text is the end token alone; repeated rows are packed once each; an
empty table gives an empty result; extra columns are not touched. A document of more than ``capacity``
tokens is cut from its end, so that only its first piece may be shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import pretokens
from tessera.llm.common import checkpointed, partitions, slices, worker_cache

#: Pieces of text that a worker remembers with their ids.
MEMO = 150_000


def added_tokens(tokenizer_path: str | None) -> list[str]:
    """The strings that the tokenizer file's own tokens, which its ranks don't hold, have in a text."""
    if tokenizer_path is None:
        return []
    from tokenizers import Tokenizer

    return sorted(token.content for token in Tokenizer.from_file(tokenizer_path).get_added_tokens_decoder().values())


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizer file gives them.

    Texts that hold one of ``added`` are encoded by the tokenizer itself. In all others the ids are those of
    the same vocabulary's ranks, which are worked out once for each piece between spaces.
    """

    def __init__(self, ranks_path: str, pattern: str, tokenizer_path: str | None = None, added: list[str] | None = None):
        encode = pretokens.encoding(ranks_path, pattern).encode_ordinary
        packed = lambda text: np.array(encode(text), "<u4").tobytes()
        self.packed, self.after_space = packed, pretokens.Memo(lambda part: packed(" " + part), MEMO)
        self.path, self.added, self.tokenizer = tokenizer_path, added or [], None

    def __call__(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self.by_tokenizer(text)
        parts = pretokens.cut(text)
        if parts is None:
            return self.packed(text)
        return self.packed(parts[0]) + b"".join(map(self.after_space.__getitem__, parts[1]))

    def by_tokenizer(self, text: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(
    docs: DataFrame, *, ranks_path: str, pattern: str, capacity: int, end_id: int, tokenizer_path: str | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, piece, start, length, ids_crc32) for each piece of each document.

    With ``tokenizer_path``, the file of the same vocabulary whose added tokens count as such in a text.
    """
    kind, added = docs.schema[key].dataType.simpleString(), added_tokens(tokenizer_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache(("packing", tokenizer_path, ranks_path, pattern), lambda: TextEncoder(ranks_path, pattern, tokenizer_path, added))
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            which, piece, start, length, crc = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = known(value.as_py() or "") + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for k, at in enumerate((0, *range(first, n, capacity))):
                    to = first if k == 0 else at + capacity
                    which.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(key, text).mapInArrow(encode, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity: which of them open sequences have."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, by: int) -> None:
        node = self.width + capacity
        while node:
            self.count[node] += by
            node //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that occurs."""
        node = self.width + least
        if self.count[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.width
            node //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces in each sequence, offset), by rank.

    Sequences with the same remaining capacity are held as intervals of sequence numbers. Best fit puts
    as many pieces of one length as fit into the tightest sequence before it turns to another, since
    what it has just filled is tighter still; so a whole interval is filled in one step.
    """
    tree, runs, opened, out = CapacityTree(capacity), {}, 0, {}

    def put_back(remaining: int, start: int, count: int) -> None:
        if count:
            runs.setdefault(remaining, []).append((start, count))
            tree.add(remaining, 1)

    for length in sorted(histogram, reverse=True):
        left, rank, steps = histogram[length], 0, []
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = capacity
                count = -(-left // (capacity // length))
                start, opened = opened, opened + count
            else:
                start, count = runs[remaining].pop()
                tree.add(remaining, -1)
            each = remaining // length
            full, rest = divmod(min(left, count * each), each)
            steps.append((rank, start, each, capacity - remaining))
            put_back(remaining - each * length, start, full)
            if rest:
                put_back(remaining - rest * length, start + full, 1)
            used = full + (rest > 0)
            put_back(remaining, start + used, count - used)
            rank, left = rank + full * each + rest, left - full * each - rest
        out[length] = np.array(steps, np.int64)
    return out


def pack(rows: DataFrame, *, capacity: int, key: str = "doc_id", salts: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Every sequence is filled without gaps from offset 0. Ranks within a length are counted in ``salts``
    parts, so that a length which most pieces have is no single task's work.
    """
    rows = checkpointed(rows)
    salts = salts or max(16, partitions(rows.sparkSession))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_base"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(key, "piece"))
    ranked = salted.withColumn("_number", number).join(bases, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_number") - 1)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    steps = plan(histogram, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                table = steps[int(one)]
                first, start, each, from_ = table[np.searchsorted(table[:, 0], rank[at], "right") - 1].T
                sequence[at] = start + (rank[at] - first) // each
                offset[at] = from_ + (rank[at] - first) % each * one
            kept = [c for c in batch.schema.names if not c.startswith("_")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    columns = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return ranked.select(*columns, "_rank").mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame, *, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2, tokenizer_path: str | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Tokenises ``docs``, cuts what is longer than ``capacity`` and packs all pieces by best fit."""
    cut = pieces(docs, ranks_path=ranks_path, pattern=pattern, capacity=capacity, end_id=end_id, tokenizer_path=tokenizer_path, key=key, text=text)
    return pack(cut, capacity=capacity, key=key)
