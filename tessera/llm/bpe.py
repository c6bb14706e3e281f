"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

Texts are cut into pre-tokens where they stand. For each block of documents, what leaves is each
distinct word once, dealt by the word over all tasks, so that one task sees all occurrences of a word
and encodes it once; and each document as the positions' word numbers. The words' ids return to their
block, where the documents are put together by position. Decoding joins the ids with the token-byte table.

Defined results: a null or empty text has no ids (an empty array) and decodes to no bytes; repeated
rows keep a row each; an empty table gives an empty result; extra columns are not touched. Should a task
be run again over other rows than before, its block's words and documents differ, which raises an error.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm import pretokens
from tessera.llm.common import parts, partitions, slices, worker_cache

#: Characters of text after which a block of documents is closed.
BLOCK_CHARS = 3_000_000
#: Words that a worker remembers with their ids.
MEMO = 100_000


def _pack(data: np.ndarray) -> bytes:
    """Compressed by byte planes, as most numbers are small."""
    return zstandard.compress(np.ascontiguousarray(data.astype("<u4").view("u1").reshape(-1, 4).T).tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


class Block:
    """Documents whose words are numbered as they first occur.

    A text is cut at its spaces, and what stands between two is worked out once for each block; so a
    document is first a list of numbers of such parts, then by numpy one of the words in the parts.
    """

    def __init__(self, pattern: str):
        self.matches = pretokens.compiled(pattern).findall
        self.numbers: dict[str, int] = {}
        self.flat, self.count = array("I"), array("I")
        self.after_space, self.at_start = pretokens.Memo(lambda part: self.part(" " + part), 1 << 62), pretokens.Memo(self.part, 1 << 62)
        self.rows, self.chars = [], 0

    def part(self, text: str) -> int:
        numbers = self.numbers
        own = [numbers.setdefault(w, len(numbers)) for w in self.matches(text)]
        self.flat.extend(own)
        self.count.append(len(own))
        return len(self.count) - 1

    def add(self, key: pa.Scalar, text: str) -> None:
        self.chars += len(text)
        cut = pretokens.cut(text)
        if cut is None:
            parts = np.array([self.part(text)], np.int32)
        else:
            parts = np.fromiter((self.at_start[cut[0]], *map(self.after_space.__getitem__, cut[1])), np.int32, len(cut[1]) + 1)
        self.rows.append((key, parts))

    def documents(self, some: int = 500) -> Iterator[tuple[list[pa.Scalar], np.ndarray, np.ndarray]]:
        """(keys, number of words of each, their word numbers in order), so many documents at a time."""
        count, flat = (np.frombuffer(a, np.uint32).astype(np.int64) if a else np.zeros(0, np.int64) for a in (self.count, self.flat))
        start = np.cumsum(count) - count
        for at in range(0, len(self.rows), some):
            keys, parts = zip(*self.rows[at : at + some], strict=True)
            joined = np.concatenate(parts)
            words, n = _spread(start[joined], count[joined]), np.array([count[p].sum() for p in parts])
            yield list(keys), n, flat[words]


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, run after run."""
    end = np.cumsum(count)
    return np.repeat(start - (end - count), count) + np.arange(end[-1] if len(end) else 0)


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[int, Block]]:
    """(block number, block) of one task."""
    worker_cache("blocks", dict)  # what earlier tasks kept goes
    block, at = Block(pattern), TaskContext.get().partitionId() << 24
    for batch in slices(batches):
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            block.add(key, text.as_py() or "")
            if block.chars >= BLOCK_CHARS:
                yield at, block
                block, at = Block(pattern), at + 1
    if block.rows:
        yield at, block


def _row(at: int, block: int, keys: pa.Array, a: bytes, b: bytes, c: bytes | None, n_words: int) -> pa.RecordBatch:
    """Of words (``at`` is negative): their numbers, lengths and bytes; of documents: their keys, numbers of words and word numbers."""
    return pa.RecordBatch.from_arrays(
        [pa.array([at], pa.int64()), pa.array([block], pa.int64()), keys, pa.array([a], pa.binary()), pa.array([b], pa.binary()), pa.array([c], pa.binary()), pa.array([n_words], pa.int64())],
        names=["at", "block", "keys", "a", "b", "c", "n_words"],
    )


def _word_encoder(ranks_path: str, pattern: str) -> pretokens.Memo:

    def make() -> pretokens.Memo:
        encode = pretokens.encoding(ranks_path, pattern).encode_ordinary
        return pretokens.Memo(lambda word: encode(word.decode()), MEMO)

    return worker_cache(("words", ranks_path, pattern), make)


def encode(docs: DataFrame, *, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", spread: int | None = None) -> DataFrame:
    """(key, ids array<int>): the ids of each match of ``pattern``, without special tokens."""
    spread = spread or partitions(docs.sparkSession)
    kind, key_type = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, block in _blocks(batches, pattern):
            words = [w.encode() for w in block.numbers]
            shard = np.fromiter((zlib.crc32(w) % spread for w in words), np.int64, len(words))
            for one in np.unique(shard):
                mine = np.flatnonzero(shard == one)
                lengths = np.fromiter((len(words[i]) for i in mine), np.int64, len(mine))
                steps, joined = np.diff(mine, prepend=0), zstandard.compress(b"".join(words[i] for i in mine), 3)
                yield _row(-1 - int(one), at, pa.array([None], pa.list_(key_type)), _pack(steps), _pack(lengths), joined, 0)
            for keys, n, numbers in block.documents():
                named = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.array([k.as_py() for k in keys], key_type))
                yield _row(at, at, named, _pack(n), _pack(numbers), None, len(words))

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_encoder(ranks_path, pattern)
        for batch in batches:
            words = batch.filter(pc.less(batch.column(0), 0)).select(["block", "a", "b", "c"])
            for row in words.to_pylist():
                ends = np.cumsum(_unpack(row["b"])).tolist()
                joined = zstandard.decompress(row["c"])
                ids = [known[joined[a:b]] for a, b in zip([0, *ends], ends, strict=False)]
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for word in ids for i in word), np.int64, int(counts.sum()))
                yield pa.RecordBatch.from_pydict({"at": [row["block"]], "numbers": [row["a"]], "counts": [_pack(counts)], "ids": [_pack(flat)]})

    def together(documents: pa.Table, words: pa.Table) -> pa.Table:
        if not documents.num_rows or documents.column("at")[0].as_py() < 0:
            return pa.table({key: pa.array([], documents.schema.field("keys").type.value_type), "ids": pa.array([], pa.list_(pa.int32()))})
        total = documents.column("n_words")[0].as_py()
        count, start, pool, at = np.zeros(total, np.int64), np.zeros(total, np.int64), [np.zeros(0, np.int32)], 0
        for row in words.to_pylist():
            numbers, counts = np.cumsum(_unpack(row["numbers"])), _unpack(row["counts"])
            count[numbers], start[numbers] = counts, at + np.cumsum(counts) - counts
            pool.append(_unpack(row["ids"]).astype(np.int32))
            at += len(pool[-1])
        flat = np.concatenate(pool)
        if any(n != total for n in documents.column("n_words").to_pylist()) or (count == 0).any():
            raise ValueError("a block of documents and its words differ: docs gave other rows when it was read again")
        parts = []
        for keys, n, numbers in zip(documents.column("keys"), documents.column("a"), documents.column("b"), strict=True):
            words_of, numbers = np.cumsum(_unpack(n.as_py())), _unpack(numbers.as_py())
            ids = pa.array(flat[_spread(start[numbers], count[numbers])])
            ends = np.concatenate([[0], np.cumsum(count[numbers])])[np.concatenate([[0], words_of])]
            parts.append(pa.table({key: keys.values, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)}))
        return pa.concat_tables(parts)

    # one shuffle deals out both, words by their shard and documents by their block; Spark runs it once for the two uses
    both = docs.select(key, text).mapInArrow(cut_up, f"at long, block long, keys array<{kind}>, a binary, b binary, c binary, n_words long").repartition(spread, "at")
    encoded = both.mapInArrow(encode_words, "at long, numbers binary, counts binary, ids binary")
    return both.groupBy("at").cogroup(encoded.groupBy("at")).applyInArrow(together, f"`{key}` {kind}, ids array<int>")


def _token_bytes(ranks_path: str, pattern: str) -> list[bytes]:
    coder = pretokens.encoding(ranks_path, pattern)
    return [coder.decode_single_token_bytes(i) for i in range(coder.n_vocab)]


def token_table(spark, *, ranks_path: str, pattern: str) -> DataFrame:
    """(id, bytes) of every token: as many rows as the vocabulary has."""
    table = _token_bytes(ranks_path, pattern)
    return spark.createDataFrame(list(enumerate(map(bytearray, table))), "id int, bytes binary")


def decode(encoded: DataFrame, *, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary): the token-byte table, which is of fixed size, joined in each task."""
    kind = encoded.schema[key].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_cache(("tokens", ranks_path, pattern), lambda: _token_bytes(ranks_path, pattern))
        length = np.fromiter(map(len, table), np.int64, len(table))
        flat, start = np.frombuffer(b"".join(table), np.uint8), np.cumsum(length) - length
        for rows in parts(batches, 100):
            column = rows.column(1)
            own = column.flatten().to_numpy(zero_copy_only=False)
            sizes = np.asarray(column.value_lengths().fill_null(0))
            after = np.concatenate([[0], np.cumsum(length[own])])[np.concatenate([[0], np.cumsum(sizes)])]
            out = pa.py_buffer(flat[_spread(start[own], length[own])].tobytes())
            text = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(after.astype(np.int32).tobytes()), out])
            yield pa.RecordBatch.from_arrays([rows.column(0), text], names=[key, "decoded"])

    return encoded.select(key, ids).mapInArrow(join, f"`{key}` {kind}, decoded binary")


def digests(docs: DataFrame, *, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each document encoded and decoded again."""
    kind = docs.schema[key].dataType.simpleString()
    encoded = encode(docs, ranks_path=ranks_path, pattern=pattern, key=key, text=text)
    numbers = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    rows = encoded.select(F.struct(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256")).alias("row"), "ids")
    back = decode(rows, ranks_path=ranks_path, pattern=pattern, key="row", ids="ids")
    return back.select(F.col(f"row.{key}").cast(kind).alias(key), "row.n_tokens", "row.ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
