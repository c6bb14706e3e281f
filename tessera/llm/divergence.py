"""How far the sources of each language stand apart in their words, from joint histograms of counts.

The divergence of two sources is a sum over all terms of a function of the two counts alone. So for each pair of
sources the distinct (count, count) combinations are tallied with the number of terms that have them, and the function is
worked out once for each combination, times that number. Only terms that both sources have are joined; the
cells with a zero are implied: by each source's own histogram of counts, less what the joint ones hold.

Tasks count the terms of the texts they read before anything is shuffled, so a hot source or term sends a row from each task's
flush. All arithmetic is in integers and decimals.

Defined results: null texts, groups and sources read as ''; a text without terms adds its (group, source) alone; repeated rows and keys count each;
ties rank by item in UTF-8 order; a pair without terms has the value 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import checkpointed, slices

#: A-Z lower-cased, other ASCII letters and all bytes of other characters as they are, the rest a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Distinct terms, each counted for each group, that a task holds before it sends them on.
HELD = 400_000
#: Up to so many (group, source) rows are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 100_000


def terms(text: str) -> list[bytes]:
    """The runs of ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


def term_counts(docs: DataFrame, *, group: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, of each group."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, src), (n, in_docs) in found.items():
                words = list(n)
                yield pa.record_batch(
                    [pa.array([lang] * len(words), pa.string()), pa.array([src] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(in_docs.__getitem__, words), pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
            found.clear()

        for batch in slices(batches, "text"):
            for lang, src, value in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, in_docs = found[lang, src]
                before, words = len(n), terms(value)
                n.update(words)
                in_docs.update(set(words))
                held += len(n) - before
            if held >= HELD:
                yield from flushed()
                held = 0
        yield from flushed()

    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in (("lang", group), ("source", source), ("text", text))))
    counted = read.mapInArrow(tally, "lang string, source string, term string, n long, docs long")
    # dealt by term, so that what looks at all sources of a term needs no other shuffle
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / total), exactly."""
    return F.call_function("div", F.lit(scale).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), F.greatest(total, F.lit(1)).cast("decimal(19,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, *, group: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, scale: int = 1_000_000_000, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Of each group (``lang``) the terms in at least ``least_docs`` of its documents are kept, V of them. A source of the group, and the
    group itself, gives each kept term the share 1 + floor(scale * (count + 1) / (N + V)), N its counts' sum.
    Part ``pair`` has every other source of the group: the sum over all kept terms of floor((p - q)^2 / q), q the other's share.
    Part ``term`` has the ``top`` terms that the source holds more of than its group does, by the same measure.
    """
    named = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    # a term with its sources, at most as many as there are pairs of each in the result
    listed = term_counts(docs, group=group, source=source, text=text).groupBy("lang", "term")
    listed = listed.agg(F.sum("n").alias("total"), F.sum("docs").alias("in_docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells"))
    kept = checkpointed(listed.where(F.col("in_docs") >= least_docs).select("lang", "term", "total", "cells"))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("v"))
    own = checkpointed(kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source", "c.n").agg(F.count("*").alias("m")))
    sums = own.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("own_n"), F.sum("m").alias("terms"))
    none = F.lit(0).cast("long")
    sized = docs.select(named(group, "lang"), named(source, "source")).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    sized = checkpointed(sized.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("own_n", "terms", "lang_n", "v"))))
    few = sized.count() <= BROADCAST_GROUPS
    groups = F.broadcast(sized) if few else sized

    # joint histograms of the terms that both have: each two sources once, then seen from both sides
    first = kept.select("lang", F.posexplode("cells").alias("at", "x"), "cells")
    two = first.select("lang", "x", F.explode(F.slice("cells", F.col("at") + 2, F.size("cells"))).alias("y"))
    tallied = two.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count("*").alias("m"))
    sides = F.array(F.struct("a", "b", "na", "nb"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb")))
    joint = checkpointed(tallied).select("lang", F.explode(sides).alias("s"), "m").select("lang", "s.*", "m")
    # the implied cells: terms that one source has, or none, less those of them that both have
    zeros = F.array(*(F.struct(a.alias("na"), b.alias("nb"), m.alias("m")) for a, b, m in ((F.col("na"), none, -F.col("m")), (none, F.col("nb"), -F.col("m")), (none, none, F.col("m")))))
    both = joint.select("lang", "a", "b", F.explode(zeros).alias("g")).select("lang", "a", "b", "g.*")
    alone = own.select("lang", F.col("source").alias("a"), "n", "m").join(groups.select("lang", F.col("source").alias("b")), "lang").where("a <> b")
    cells = F.array(*(F.struct(c.alias("a"), d.alias("b"), x.alias("na"), y.alias("nb"), F.col("m")) for c, d, x, y in ((F.col("a"), F.col("b"), F.col("n"), none), (F.col("b"), F.col("a"), none, F.col("n")))))
    alone = alone.select("lang", F.explode(cells).alias("s")).select("lang", "s.*")
    pairs = sized.select("lang", F.col("source").alias("a"), F.col("terms").alias("ta"), "v").join(groups.select("lang", F.col("source").alias("b"), F.col("terms").alias("tb")), "lang").where("a <> b")
    neither = pairs.select("lang", "a", "b", none.alias("na"), none.alias("nb"), (F.col("v") - F.col("ta") - F.col("tb")).alias("m"))
    implied = both.unionByName(alone).unionByName(neither).groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m"))

    of = lambda x: groups.select("lang", F.col("source").alias(x), (F.col("own_n") + F.col("v")).alias(f"all_{x}"))
    shares = joint.unionByName(implied).join(of("a"), ["lang", "a"]).join(of("b"), ["lang", "b"])
    once = F.when(F.col("m") > 0, apart(share(F.col("na"), F.col("all_a"), scale), share(F.col("nb"), F.col("all_b"), scale))).otherwise(none)
    values = shares.groupBy("lang", "a", "b").agg(F.sum(once.cast("decimal(19,0)") * F.col("m").cast("decimal(18,0)")).cast("long").alias("value"))
    pair = values.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")

    shown = kept.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", "c.*")
    shown = shown.join(groups.select("lang", "source", (F.col("own_n") + F.col("v")).alias("own"), (F.col("lang_n") + F.col("v")).alias("all")), ["lang", "source"])
    shown = shown.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), share(F.col("n"), F.col("own"), scale).alias("p"), share(F.col("total"), F.col("all"), scale).alias("q"))
    term = shown.where("p > q").select("lang", "source", "part", "item", apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= top))
