"""URL verdicts: explicit rules first, gradient-boosted trees on lexical features for the rest.

Everything is DataFrame and SQL expressions; the trees are Spark's own. The rules label the URLs
they fit, and those labelled URLs train the trees. What a suffix's labelled URLs say is a feature too: for a
labelled URL it is taken from the other folds' URLs only, so that no URL's own label is among its features.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
judged by the trees on its (empty) features. Repeated URLs get the same verdict. Without two labels to
learn from (an empty table, or rules that all say the same), the trees are replaced by the only label
there is, or ``allow`` where there is none. Other columns of the input are not touched or needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed

#: (verdict, host and path) pairs; a rule fits its host and every subdomain.
Rule = tuple[str, str]

SUFFIX_BUCKETS = 4096
#: Parts of the labelled URLs, by hash of the URL; suffix rates of one come from the others.
FOLDS = 5

FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digit_ratio", "f_entropy",
    "f_params", "f_fragment", "f_hyphens", "f_path_digits", "f_www", "f_secure",
    "f_suffix_share", "f_suffix_rate", "f_end_share", "f_end_rate",
]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``; null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # later, longer rules override
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SUFFIX_BUCKETS)).cast("int")


def lexical(pages: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """Adds the columns of FEATURES that need only the row itself, and the buckets of its suffixes."""
    text = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return pages.withColumns(
        {
            "f_length": F.length(text).cast("double"),
            "f_host_length": F.length(host).cast("double"),
            "f_path_length": F.length(path).cast("double"),
            "f_depth": _count(F.regexp_replace(path, "/+$", ""), "/").cast("double"),
            "f_labels": F.size(F.split(host, r"\.")).cast("double"),
            "f_digit_ratio": _ratio(_count(text, "[0-9]"), F.length(text)),
            "f_entropy": _entropy(text),
            "f_params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
            "f_fragment": F.contains(text, F.lit("#")).cast("double"),
            "f_hyphens": _count(F.col(host), "-").cast("double"),
            "f_path_digits": _count(F.col(path), "[0-9]").cast("double"),
            "f_www": F.startswith(F.col(host), F.lit("www.")).cast("double"),
            "f_secure": F.startswith(text, F.lit("https:")).cast("double"),
            "suffix": _bucket(F.substring_index(host, ".", -2)),
            "end": _bucket(F.concat(F.substring_index(host, ".", -1), F.lit("/"), F.try_element_at(F.split(path, "/"), F.lit(2)))),
        }
    )


def with_suffix_statistics(rows: DataFrame) -> DataFrame:
    """Adds, for the buckets of both suffixes, their share of all rows and the smoothed block rate of their labelled rows.

    One pass counts both, by fold; the table of at most 2 * (SUFFIX_BUCKETS + 1) rows is then broadcast.
    """
    fold = F.when(F.col("label").isNotNull(), F.col("fold"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("of"), F.col(name).alias("bucket")) for name in ("suffix", "end"))))
    counts = rows.select(each.alias("b"), fold.alias("fold"), "label").groupBy("b", "fold").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum("label").alias("blocked"))
    by_fold = F.map_from_entries(F.collect_list(F.when(F.col("fold").isNotNull(), F.struct("fold", F.struct("labelled", "blocked")))))  # FOLDS entries at most
    table = checkpointed(counts.groupBy("b").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), by_fold.alias("folds")))
    total = table.where("b.of = 'end'").agg(F.sum("n")).first()[0] or 1
    for name in ("suffix", "end"):
        own = table.where(F.col("b.of") == name).select(F.col("b.bucket").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "labelled", "blocked", "folds")))
        rows = rows.join(F.broadcast(own), name, "left")
        mine = F.try_element_at(f"{name}_folds", fold)
        less = lambda c: F.coalesce(F.col(f"{name}_{c}"), F.lit(0)) - F.coalesce(mine[c], F.lit(0))  # noqa: E731, B023
        rows = rows.withColumns({f"f_{name}_share": F.col(f"{name}_n") / F.lit(total), f"f_{name}_rate": (less("blocked") + 1.0) / (less("labelled") + 2.0)})
        rows = rows.drop(*(f"{name}_{c}" for c in ("n", "labelled", "blocked", "folds")))
    return rows


def train(rows: DataFrame, *, sample: int, trees: int = 10, depth: int = 4, seed: int = 7) -> GBTClassificationModel | None:
    """Trees from at most ``sample`` distinct labelled URLs (those of least hash, half of them of each label); None without two labels."""
    labelled = rows.where("label is not null").select(*FEATURES, F.col("label").cast("double").alias("label"), "order")
    there = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.approx_count_distinct("order").alias("n")).collect()}
    if len(there) < 2:
        return None
    some = []
    for label, n in sorted(there.items()):
        own = labelled.where(F.col("label") == label)
        if n > sample:  # a hash filter first, so that the sort below sees few rows more than it keeps
            own = own.where(F.pmod("order", F.lit(1 << 20)) < F.lit(int((1 << 20) * sample / n)))
        some.append(own.dropDuplicates(["order"]).orderBy("order").limit(sample // 2))
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(some[0].union(some[1])).select("features", "label", "order")
    data = data.repartitionByRange(4, "order").sortWithinPartitions("order").drop("order").persist()
    try:
        return GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=seed).fit(data)
    finally:
        data.unpersist()


def featured(pages: DataFrame, rules: Sequence[Rule], *, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, hit (the rule), label (1 block, 0 allow, or null), order and fold (by hash of the URL), and FEATURES, written once."""
    rows = pages.select(F.col(key), F.col(url).alias("url_"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumns({"hit": matching_rule(F.col("host"), F.col("path"), rules), "order": F.xxhash64("url_", F.lit(11)), "fold": F.pmod(F.xxhash64("url_", F.lit(12)), F.lit(FOLDS)).cast("int")})
    rows = lexical(rows, "url_", "host", "path").withColumn("label", F.when(F.col("hit").isNotNull(), (F.col("hit.verdict") == "block").cast("int")))
    rows = checkpointed(rows.withColumns({name: F.coalesce(name, F.lit(-1)) for name in ("suffix", "end")}).drop("url_"))
    return with_suffix_statistics(rows)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    key: str = "page_id",
    url: str = "url",
    sample: int = 20_000,
    threshold: float = 0.5,
) -> DataFrame:
    """One row for each row of ``pages``: key, host, path, rule, verdict, block_score.

    ``sample`` bounds the labelled URLs that the trees are fitted on; the suffix statistics cover all
    rows and join as two tables of at most 4097 rows, which is what bounds their broadcast.
    ``block_score`` is the trees' probability of ``block``, null where a rule decided.
    """
    rows = featured(pages, rules, key=key, url=url)
    model = train(rows, sample=sample)
    if model is None:
        only = rows.agg(F.max("label")).first()[0]
        scored = rows.withColumn("score", F.lit(float(only or 0)))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        key,
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("hit").isNull(), F.col("score")).alias("block_score"),
    )
