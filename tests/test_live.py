"""The live listing of a temporary tree."""

from __future__ import annotations

import os

import pytest

from tessera.sources.live import live_files

KEPT = ["a.txt", "app/x.ts", "database/d.ts", "src/deep/er/z.ts", "src/one.ts", "src/two.ts"]
LEFT_OUT = ["node_modules/p/i.js", "src/dist/o.js", "data/raw.csv", "app/out/page.html", "src/.git/HEAD"]


@pytest.fixture()
def tree(tmp_path):
    for path in [*KEPT, *LEFT_OUT]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "src", tmp_path / "linked")
    os.symlink(tmp_path / "a.txt", tmp_path / "src" / "link.ts")
    os.symlink(tmp_path, tmp_path / "src" / "loop")
    return str(tmp_path)


def paths(df):
    return sorted(r.file_path for r in df.collect())


def test_a_whole_tree_whatever_the_slices(spark, tree):
    for slices in (1, 2, 64):
        out = live_files(spark, tree, slices=slices)
        assert paths(out) == KEPT
    assert {r.file_path: r.bytes for r in out.collect()} == {p: len(p) for p in KEPT}
    assert all(abs(r.modified_at.timestamp() - os.stat(f"{tree}/{r.file_path}").st_mtime) < 1e-3 for r in out.collect())
    assert paths(live_files(spark, f"file://{tree}", segments=(), prefixes=())) == sorted(KEPT + LEFT_OUT)
    assert paths(live_files(spark, f"{tree}/empty")) == paths(live_files(spark, f"{tree}/none")) == []
    with pytest.raises(ValueError):
        live_files(spark, "hdfs://somewhere/tree")


def test_filters(spark, tree):
    assert paths(live_files(spark, tree, filters=["src", "src/deep", "src/one.ts", "a.txt", "a.txt"])) == ["a.txt", *KEPT[3:]]
    assert paths(live_files(spark, tree, filters=["../x", "/etc", "linked", "src/link.ts", "dist", "data", "nothing", ".."])) == []
    assert paths(live_files(spark, tree, filters=["./src/deep/", ""])) == KEPT


def test_a_limit_takes_the_first_by_path(spark, tree):
    for limit, cut in ((0, True), (2, True), (5, True), (6, False), (9, False)):
        rows = live_files(spark, tree, limit=limit).collect()
        assert sorted(r.file_path for r in rows) == KEPT[:limit] and {r.truncated for r in rows} <= {cut}
