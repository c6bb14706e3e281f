"""The activity log against a plain version; work-tree diffs, profile writes, histories and cut texts against literals."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import sessions as S

EVENT = "session_id long, ordinal long, ts long, kind string, name string, text string"


def plain_log(events, hot, warm, size):
    """Lines of one session, one event after another."""
    time = lambda ts: datetime.datetime.fromtimestamp(ts / 1000, datetime.UTC).strftime("%H:%M") if ts > 0 else "--:--"
    lines, bucket, day = [], [], None  # (said, first, last, n, divider)

    def flush():
        if bucket:
            tools = {}
            for e in bucket:
                if e["kind"] == "tool_use":
                    tools[e["name"]] = tools.get(e["name"], 0) + 1
            parts = [", ".join(f"{n}× {t}" for t, n in sorted(tools.items(), key=lambda x: (-x[1], x[0]))[:5])] if tools else []
            for kind, what in (("assistant_text", "AI turn"), ("assistant_thinking", "thought")):
                n = sum(e["kind"] == kind for e in bucket)
                parts += [f"{n} {what}" + "s" * (n != 1)] if n else []
            lines.append((f"◯ {len(bucket)} cold events: " + (", ".join(parts) or "misc"), bucket[0]["ts"], bucket[-1]["ts"], len(bucket), False))
            bucket.clear()

    for i, e in enumerate(events):
        if e["ts"] > 0:
            own = datetime.datetime.fromtimestamp(e["ts"] / 1000, datetime.UTC).strftime("%Y-%m-%d")
            if own != day:
                flush()
                lines.append((f"── {own} ──", e["ts"], e["ts"], 0, True))
                day = own
        back, kind, text = len(events) - i, e["kind"], e["text"] or ""
        failed = f"tool_error: {text}" if text else "tool_error"
        if back > hot + warm and kind not in ("user_text", "error", "hook"):
            if len(bucket) == size:
                flush()
            bucket.append(e)
            continue
        flush()
        if back > hot + warm:
            said = {"user_text": "· user", "error": f"· {failed}"}[kind]
        else:
            marks = ("👤 USER:\n", "🤖 AI:\n") if back <= hot else ("👤 ", "🤖 ")
            said = {"user_text": marks[0] + text, "assistant_text": marks[1] + text, "assistant_thinking": "💭 (thinking)", "tool_use": f"🔧 {e['name']}", "error": f"⚠ {failed}", "tool_result": "↩ tool_result"}[kind]
        lines.append((said, e["ts"], e["ts"], 1, False))
    flush()
    runs = []
    for said, first, last, n, divider in lines:
        short = said == "💭 (thinking)" or (said.startswith("· ") and " " not in said[2:])
        if runs and short and runs[-1][0] == said:
            runs[-1][2:5] = last, runs[-1][3] + n, runs[-1][4] + 1
        else:
            runs.append([said, first, last, n, 1, divider])
    span = lambda a, b: time(a) if time(a) == time(b) else f"{time(a)}–{time(b)}"
    return [(k + 1, said if divider else f"[{span(a, b)}] {said}" + (f" ×{times}" if times > 1 else ""), n) for k, (said, a, b, n, times, divider) in enumerate(runs)]


def test_activity_log_equals_a_plain_version(spark):
    draw = random.Random(5)
    kinds = ["user_text", "assistant_text", "assistant_thinking", "tool_use", "tool_use", "tool_result", "error"]
    events = []
    for session in range(12):
        ts = 0
        for ordinal in range([0, 1, 3, 12, 60, 90][session % 6]):
            ts += draw.choice([0, 60_000, 3_600_000, 9_000_000])
            events.append({"session_id": session, "ordinal": ordinal, "ts": ts, "kind": draw.choice(kinds), "name": f"T{draw.randrange(3)}", "text": draw.choice(["a b", "done.", "", None])})
    got = {}
    for r in S.activity_log(spark.createDataFrame(events, EVENT), hot=4, warm=5, size=6).orderBy("session_id", "place").collect():
        got.setdefault(r.session_id, []).append((r.place, r.line, r.n))
    want = {s: plain_log([e for e in events if e["session_id"] == s], 4, 5, 6) for s in {e["session_id"] for e in events}}
    assert got == want
    assert any("×" in line and "·" in line for lines in want.values() for _, line, _ in lines)


def test_activity_log_of_nothing(spark):
    assert S.activity_log(spark.createDataFrame([], EVENT)).count() == 0


def test_worktree_diffs(spark):
    rows = [(1, "c", "modified", "a\nb", "a\nx"), (2, "b", "deleted", "a", "kept"), (3, "a", "clean", "a", "b"), (4, "d", "modified", None, "a"), (5, "e", "modified", "a", None), (6, "f", "modified", "a", "b")]
    out = S.worktree_diffs(spark.createDataFrame(rows, "id long, file_path string, state string, old string, new string"), most=4)
    got = {r.file_path: (r.reason, r.diff, r.insertions, r.deletions) for r in out.collect()}
    assert got["c"] == (None, "@@ -1,2 +1,2 @@\n a\n-b\n+x", 1, 1)
    assert got["b"][0] is None and got["b"][3] == 1
    assert got["d"] == ("no kept text", None, None, None) and got["e"][0] == "no current text"
    assert set(got) == {"b", "c", "d", "e"}


def test_profile_writes_in_order_of_time(spark):
    stored = spark.createDataFrame([("old", "b", "t", 1, 1, None)], "name string, blurb string, tags string, created_at long, updated_at long, retired_at long")
    writes = [("new", "blurb", "early", 5), ("new", "create", None, 6), ("new", "tags", "x", 7), ("new", "retire", None, 8), ("old", "create", None, 9), ("old", "tags", "u", 10), ("none", "blurb", "lost", 3)]
    got = {r.name: tuple(r)[1:] for r in S.profile_writes(stored, spark.createDataFrame(writes, "name string, op string, value string, ts long")).collect()}
    assert got == {"new": ("", "x", 6, 7, 8, True), "old": ("b", "u", 1, 10, None, False)}


def test_append_entries_refuses_known_keys(spark):
    schema = "id long, source string, verification_status string, patterns_added array<string>, hazards_added array<string>, breaking_changes boolean, recovery_key string, idempotency_key string"
    new = [(i, None, None, None, None, None, r, k) for i, (r, k) in enumerate([("a", None), ("a", "x"), (None, "x"), (None, "y"), (None, None), (None, None), ("kept", None)])]
    stored = spark.createDataFrame([("kept", "y")], "recovery_key string, idempotency_key string")
    out = S.append_entries(stored, spark.createDataFrame(new, schema)).orderBy("id").collect()
    assert [r.id for r in out] == [0, 4, 5]
    assert out[0].asDict() == {"id": 0, "source": "agent", "verification_status": "pending", "patterns_added": [], "hazards_added": [], "breaking_changes": False, "recovery_key": "a", "idempotency_key": None}


def test_cut_texts(spark):
    rows = spark.createDataFrame([("aé€😀",), ("x",), (None,), ("",)], "t string")
    cuts = {n: [r[0] for r in rows.select(X.cut_bytes(F.col("t"), n)).collect()] for n in (1, 2, 3, 5, 6, 9, 10)}
    left = lambda s, n: f"{s}\n… [truncated, {n} more bytes]"
    assert [cuts[n][0] for n in (1, 2, 3, 5, 6, 9, 10)] == [left("a", 9), left("a", 9), left("aé", 7), left("aé", 7), left("aé€", 4), left("aé€", 4), "aé€😀"]
    assert cuts[3][1:] == ["x", None, ""]
    lines = spark.createDataFrame([("a\nb\nc",), ("a\nb\nc\nd",), ("a",)], "t string").select(X.cut_lines(F.col("t"), 2)).collect()
    assert [r[0] for r in lines] == ["a\nb\n… [+1 line elided]", "a\nb\n… [+2 lines elided]", "a"]


def test_history_takes_the_chain_or_the_tail(spark):
    log = [("p", i, i * 10, f"s{i % 5}") for i in range(20)] + [("q", i, i, "s9") for i in range(9)]
    chain = [("p", "s1"), ("p", "s7"), ("q", "s9")]
    out = S.history_shown(spark.createDataFrame(log, "project string, id long, t long, session_id string"), spark.createDataFrame(chain, "project string, session_id string")).orderBy("project", "number").collect()
    assert [(r.number, r.gap, r.linked) for r in out if r.project == "p"] == [(2, 10, True), (7, 10, True), (12, 10, True), (17, 10, True)]
    assert [(r.number, r.linked) for r in out if r.project == "q"] == [(n, False) for n in range(4, 10)]
