"""Sharding, the Merkle manifest and the divergence audit against plain versions."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, difference

from tessera.llm import divergence, manifest, queries, sharding
from tessera.llm.common import table

from .conftest import DOCS, ODD

#: A row's doc_id, text, lang, source; among them nulls, repeats, one lone source, a group without terms.
ROWS = [
    *((i, f"line {i}\nword\nthe the", "en", "a") for i in range(23)),
    *((i, f"Ünder the wörd {i % 4}\n", "en", "b") for i in range(40, 47)),
    *((i, "the wörd", "en", None) for i in range(60, 64)),
    (70, "la la le\n", "fr", "z"), (71, None, "fr", "a"), (72, "", None, "a"), (None, "no id\nthe", "en", "a"), (5, "the same", "en", "a"), (5, "the same", "en", "a"), (80, "123 -- 45", "de", "q"), (81, "", "de", "r"),
]


@pytest.fixture(scope="module")
def odd_docs(spark):
    return spark.createDataFrame([(i, t, lang, src, None if i == 42 else len(t or ""), 0.5, "x", "y") for i, t, lang, src in ROWS], DOCS)


def held(rows, shards):
    """The law: every slot of every shard once, sizes at most one apart."""
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_shards_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = queries.op11_two_pass_shuffle(spark, sf_dir).collect()
    held(got, 8)
    raw = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len(raw(r["text"])) + 1, zlib.crc32(raw(r["text"]))) for r in docs.collect())
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_shards_follow_seed_alone(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").drop("lang")
    place = lambda d, **o: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shards(d, bucket_bytes=60_000, **o).collect()}
    first = place(docs, seed=3)
    assert first == place(docs.repartition(7, "source").coalesce(2), seed=3) != place(docs, seed=4)
    # neighbours by id are scattered: about 7 of 8 pairs fall apart
    ids = sorted(first)
    apart = np.mean([first[a][0] != first[b][0] for a, b in zip(ids, ids[1:], strict=False)])
    assert 0.75 < apart < 0.97


def test_fisher_yates():
    for n in (0, 1, 2, 50):
        draws = np.random.default_rng(n).random(n)
        want = list(range(n))
        for i in reversed(range(n)):
            j = int(draws[i] * (i + 1))
            want[i], want[j] = want[j], want[i]
        assert sharding.fisher_yates(n, draws).tolist() == want
    found = Counter(tuple(sharding.fisher_yates(3, np.random.default_rng([9, i]).random(3)).tolist()) for i in range(6_000))
    assert len(found) == 6 and min(found.values()) > 850


def test_each_bucket_is_shuffled_by_hash_order(spark, sf_dir):
    """The whole order, by a plain second pass over the buckets that Spark's hashes give."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents")
    size = sum(len((r["text"] or "").encode()) + sharding.ROW_BYTES for r in docs.collect())
    buckets = -(-size // 100_000)
    h = F.xxhash64(F.lit(1), "doc_id", "text")
    by = defaultdict(list)
    for r in docs.select("doc_id", h.alias("h"), F.pmod(F.xxhash64(F.lit(2), h), F.lit(buckets)).alias("b")).collect():
        by[r["b"]].append((r["h"], r["doc_id"]))
    want = []
    for b in sorted(by):
        own = [key for _, key in sorted(by[b])]
        draws = np.random.default_rng([1, b, 0]).random(len(own))
        for i in reversed(range(len(own))):
            j = int(draws[i] * (i + 1))
            own[i], own[j] = own[j], own[i]
        want += own
    got = sharding.shards(docs, seed=1, bucket_bytes=100_000, shards=3).orderBy("shard", "slot").collect()
    assert len(by) > 3 and [r["doc_id"] for r in got] == want


def test_shards_of_odd_rows(make_docs):
    docs = make_docs([*ODD, *[(1, "copy")] * 900, *[(None, None)] * 300])
    for options in ({}, {"bucket_bytes": 20_000}):  # repeats overfill buckets
        got = sharding.shards(docs, **options).collect()
        held(got, 8)
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([*ODD, *[(1, "copy")] * 900, *[(None, None)] * 300])
    clash = docs.selectExpr("*", "'mine' AS bucket", "1 AS shard", "2 AS part", "3 AS row", "4 AS hash")
    got = sharding.shards(clash, shards=2)
    assert got.columns == [*docs.columns, "bucket", "part", "row", "hash", "shard", "slot"]
    assert {(r["bucket"], r["part"], r["row"], r["hash"]) for r in got.collect()} == {("mine", 2, 3, 4)}
    assert sharding.report(make_docs([])).collect() == []
    assert [(r["shard"], r["slot"]) for r in sharding.shards(make_docs([(1, "a")])).collect()] == [(0, 0)]


def test_written_shards(spark, sf_dir, tmp_path):
    import pyarrow.parquet as pq

    docs = table(spark, sf_dir, "documents")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3, bucket_bytes=50_000)
    for s in range(3):
        files = sorted((tmp_path / "out" / f"shard={s}").glob("*.parquet"))
        slots = [pq.ParquetFile(f).read(["slot"])["slot"].to_pylist() for f in files]
        assert all(own == sorted(own) for own in slots) and sorted(sum(slots, [])) == list(range(sum(map(len, slots))))


def sha(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def plain_leaf(*fields):
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climbed(nodes):
    """The levels of one tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for key, src, lang, n, text in rows:
        hit = text.replace("\n", "") if text is not None and key is not None and zlib.crc32(str(key).encode()) % 2 == 0 else text
        groups[src].append(((key is not None, key or 0), plain_leaf(key, src, lang, n, text), plain_leaf(key, src, lang, n, hit), key))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([x[1] for x in sorted(groups[s])]) for s in order}
    crown, out = climbed([trees[s][-1][0] for s in order]), []
    for place, s in enumerate(order):
        for i, (_, leaf, hit, key) in enumerate(sorted(groups[s])):
            proof, node = "", hit
            for levels, at in ((trees[s], i), (crown, place)):
                for level in levels[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    proof += "".join(d for j, d in enumerate(run) if j != at % 3)
                    node = sha(*(node if j == at % 3 else d for j, d in enumerate(run)))
                    at //= 3
            out.append((key, leaf, trees[s][-1][0], crown[-1][0], sha(proof), node, node == crown[-1][0]))
    return sorted(out, key=repr)


FOUND = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_of_documents(spark, sf_dir):
    assert difference(spark, connect(sf_dir), sf_dir, queries.op12_merkle_manifest, queries.MERKLE_SQL) is None
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r[c] for c in FOUND) for r in queries.op12_merkle_manifest(spark, sf_dir).collect()), key=repr)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("spread", [1, 5, 40])
def test_manifest_of_odd_rows(odd_docs, spread):
    got = sorted((tuple(r[c] for c in FOUND) for r in manifest.verification(odd_docs, spread=spread).collect()), key=repr)
    assert got == plain_manifest([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in odd_docs.collect()])


def test_manifest_of_few_rows(odd_docs):
    assert manifest.verification(odd_docs.where("false")).collect() == []
    one = odd_docs.where("doc_id = 70")
    (r,) = manifest.verification(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == sha("") and r["verified"] == (zlib.crc32(b"70") % 2 == 1)
    many = odd_docs.limit(1).crossJoin(odd_docs.sparkSession.range(200).withColumnRenamed("id", "copy"))  # equal rows, cut by the salt
    got = sorted((tuple(r[c] for c in FOUND) for r in manifest.verification(many.drop("copy"), spread=7).collect()), key=repr)
    assert len(got) == 200 and got == plain_manifest([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in many.collect()])


def plain_audit(rows, top=200):
    texts = [(lang or "", src or "", "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in text or "")) for lang, src, text in rows]
    seen, total, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, src, text in texts:
        own[lang, src].update(text.split(" "))
        total[lang].update(text.split(" "))
        seen[lang].update(set(text.split(" ")))
    kept = {lang: sorted(t for t, n in c.items() if n >= 3 and t) for lang, c in seen.items()}

    def shares(counts, terms):
        n = sum(counts[t] for t in terms)
        return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (n + len(terms)) for t in terms}

    out = []
    ranked = lambda found: [(*x, i + 1) for i, x in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())))]
    for lang, src in own:
        terms = kept[lang]
        p, whole = shares(own[lang, src], terms), shares(total[lang], terms)
        pairs = []
        for other_lang, other in own:
            if other_lang == lang and other != src:
                q = shares(own[lang, other], terms)
                pairs.append((other, sum((p[t] - q[t]) ** 2 // q[t] for t in terms)))
        out += [(lang, src, "pair", *x) for x in ranked(pairs)]
        more = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in terms if own[lang, src][t] and p[t] > whole[t]]
        out += [(lang, src, "term", *x) for x in ranked(more)[:top]]
    return sorted(out)


def audited(docs, **options):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(docs, **options).collect())


def test_divergence_of_documents(spark, sf_dir):
    assert difference(spark, connect(sf_dir), sf_dir, queries.op13_source_divergence, queries.DIVERGENCE_SQL) is None
    docs = table(spark, sf_dir, "documents")
    got = audited(docs)
    assert got == plain_audit([(r["lang"], r["source"], r["text"]) for r in docs.collect()])
    assert {x[2] for x in got} == {"pair", "term"}


def test_divergence_of_odd_rows(odd_docs, monkeypatch):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd_docs.collect()]
    assert audited(odd_docs) == plain_audit(rows)
    assert audited(odd_docs, top=1) == plain_audit(rows, 1)
    assert ("de", "q", "pair", "r", 0, 1) in audited(odd_docs)
    assert audited(odd_docs.where("false")) == []
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    assert audited(odd_docs.repartition(5)) == plain_audit(rows)


def test_shares_are_exact_for_large_counts(spark):
    big = 3_000_000_000_000
    r = spark.range(1).select(divergence.share(divergence.F.lit(big), divergence.F.lit(7 * big), 1_000_000_000).alias("p")).first()
    assert r["p"] == 1 + 1_000_000_000 * (big + 1) // (7 * big)
