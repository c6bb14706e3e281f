"""Merkle manifest of a dataset: a tree for each group of rows, and one over the groups' roots.

Leaves get their places by ``row_number`` within ranges of (group, key), so that a group of any size is numbered by many tasks.
Each level divides the places by the fanout, groups the children in order and hashes them into parents; groups
that are down to one node leave the climb. Proofs are made on the way down: a parent hands its children what stands beside them
and its own proof, so each level is one join of its nodes, and leaves take part only in the last.

``H`` is the lowercase hex SHA-256 of the inputs after each other, digests as hex text. A leaf is H of its fields, each
``-`` if null, else the number of its UTF-8 bytes, ``:`` and the value.

Defined results: leaves stand by key, nulls first; rows that share a key stand by their leaf, and equal leaves are
interchangeable; a null group comes first; a lone leaf is its group's subroot, a lone subroot the root; an empty
table gives an empty result; columns that aren't fields are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import checkpointed, partitions

#: Ranges that leaves are dealt to, at most: Spark samples a few hundred sort keys for each on the driver.
MOST_RANGES = 2_048
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """H of the fields, each ``-`` if null, else its number of bytes, ``:`` and its value."""
    texts = [c.cast("string") for c in fields]
    return digest(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def numbered(rows: DataFrame, order: Sequence[Column], spread: int) -> DataFrame:
    """``rows`` (group, digest, salt, ...) with ``idx``, their place in the group from 0, and ``n``, the group's size.

    Rows are dealt by ranges, whose sizes say where each begins in its group; the salt lets ranges cut through equal rows.
    """
    ranged = checkpointed(rows.repartitionByRange(spread, "group", *order, "digest", "salt").withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("group", "range").agg(F.count("*").alias("own"))
    ahead = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("group", "range", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy("group")).alias("n"))
    place = F.row_number().over(Window.partitionBy("group", "range").orderBy(*order, "digest", "salt"))
    return ranged.withColumn("place", place).join(starts, ["group", "range"]).withColumn("idx", F.col("before") + F.col("place") - 1).drop("range", "place", "before", "salt")


class Forest:
    """The trees over leaves (group, idx, n, digest, payload): ``levels[k]`` holds the nodes of level k and their children, up to where each group is down to one."""

    def __init__(self, leaves: DataFrame, fanout: int):
        self.levels = [checkpointed(leaves.select("group", "idx", "n", "digest", "payload"))]
        most = self.levels[0].agg(F.max("n")).first()[0] or 1
        rows = self.levels[0].count()
        while most > 1:
            below = self.levels[-1].where("n > 1")
            held = ["idx", "digest", "payload"] if len(self.levels) == 1 else ["idx", "digest"]
            runs = below.groupBy("group", F.floor(F.col("idx") / fanout).alias("idx")).agg(
                F.ceil(F.max("n") / fanout).alias("n"), F.array_sort(F.collect_list(F.struct(*held))).alias("children")
            )
            parents = runs.withColumn("digest", F.sha2(F.array_join("children.digest", ""), 256))
            rows = -(-rows // fanout) + 1_000_000  # groups' last runs are smaller
            self.levels.append(checkpointed(parents, rows if len(self.levels) > 1 else None))
            most = -(-most // fanout)

    def tops(self) -> DataFrame:
        """(group, digest) of each tree's root."""
        return reduce(DataFrame.union, (level.where("n = 1").select("group", "digest") for level in self.levels))

    def proofs(self, above: DataFrame) -> DataFrame:
        """(payload, digest, path, and the columns of ``above``) of each leaf; ``above`` has for each group the path on from its tree's root.

        A path lists, from the leaf up, what stands to the left and to the right in each run.
        """
        kept = [c for c in above.columns if c not in ("group", "path")]
        down = None
        for k in range(len(self.levels) - 1, 0, -1):
            level = self.levels[k]
            mine = level.where("n = 1").select("group", "idx").join(above, "group").select("group", "idx", "path", *kept)
            known = mine if down is None else down.select("group", "idx", "path", *kept).unionByName(mine)
            runs = level.select("group", "idx", "children").join(known, ["group", "idx"])
            digests = F.col("children.digest")
            beside = F.struct(F.array_join(F.slice(digests, F.lit(1), F.col("at")), "").alias("left"), F.array_join(F.slice(digests, F.col("at") + 2, F.size(digests)), "").alias("right"))
            each = runs.select("*", F.posexplode("children").alias("at", "child")).withColumn("path", F.concat(F.array(beside), "path"))
            down = each.select("group", F.col("child.idx").alias("idx"), F.col("child.digest").alias("digest"), *([F.col("child.payload").alias("payload")] if k == 1 else []), "path", *kept)
        lone = self.levels[0].where("n = 1").join(above, "group").select("payload", "digest", "path", *kept)
        return lone if down is None else down.select("payload", "digest", "path", *kept).unionByName(lone)


def proofs(docs: DataFrame, carry: Mapping[str, Column], *, fields: Sequence[str] = FIELDS, group: str = "source", key: str = "doc_id", fanout: int = 3, spread: int | None = None) -> DataFrame:
    """The columns of ``carry``, and ``leaf``, ``subroot``, ``root`` and ``path`` of each row.

    ``path`` is an array of (left, right) from the leaf to the root: the digests beside the node in its run, after each
    other. ``fold`` gives the root that a leaf and a path lead to; ``siblings`` all digests of the path.
    """
    spread = spread or min(MOST_RANGES, partitions(docs.sparkSession))
    named = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))  # null first
    made = docs.select(named.alias("group"), F.struct(F.col(key).alias("key")).alias("order"), leaf([F.col(f) for f in fields]).alias("digest"), F.struct(*(c.alias(name) for name, c in carry.items())).alias("payload"))
    rows = checkpointed(made.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())))  # texts are read once
    trees = Forest(numbered(rows, [F.col("order.key").asc_nulls_first()], spread), fanout)
    tops = trees.tops().select(F.lit("").alias("group"), F.struct(F.col("group").alias("key")).alias("order"), "digest", F.col("group").alias("payload")).withColumn("salt", F.lit(0).cast("long"))
    crown = Forest(numbered(tops, [F.col("order.key").asc()], spread), fanout)
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    root = crown.tops().select("group", nothing.alias("path"), F.col("digest").alias("root"))
    above = checkpointed(crown.proofs(root).select(F.col("payload").alias("group"), "path", F.col("digest").alias("subroot"), "root"))
    return trees.proofs(above).select(*(F.col("payload")[name].alias(name) for name in carry), F.col("digest").alias("leaf"), "subroot", "root", "path")


def siblings(path: Column) -> Column:
    """All digests of a path after each other, from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), "")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, run: digest(run["left"], node, run["right"]))


def verification(docs: DataFrame, *, key: str = "doc_id", text: str = "text", fields: Sequence[str] = FIELDS, **options) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified): each row's proof, held against the row after tampering.

    Tampering deletes the line feeds from the text of every row whose key's CRC-32, as decimal text, is even.
    """
    hit = F.coalesce(F.crc32(F.col(key).cast("string")) % 2 == 0, F.lit(False))
    altered = F.when(hit, F.translate(text, "\n", "")).otherwise(F.col(text))
    held = {key: F.col(key), "altered": leaf([altered if f == text else F.col(f) for f in fields])}
    found = proofs(docs, held, key=key, fields=fields, **options).withColumn("folded_root", fold(F.col("altered"), F.col("path")))
    return found.select(key, "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
