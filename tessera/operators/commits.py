"""Which commits of a log are let in: repeats within a window and files that another holder has claimed are turned away."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Milliseconds that a claim on a file holds and that a commit is remembered. Fixed value.
WINDOW = 30_000


def admit(requests: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """(id, decision, cause) of each request (id, workspace, file_path, holder, summary, file_hash, ts, released_at).

    Per file, in the order of ts and id: a request that repeats the summary and hash of one let in at most ``window`` ms before is a
    ``duplicate`` of it. One that meets a claim of another holder, less than ``window`` ms old and not released, is ``claimed`` by the claim's request. All others
    are ``accepted`` and claim the file until ``released_at``, or until the window is over where that is null.

    A file's requests are a stream through one task, which holds its claim and what was let in within the window. Null
    summaries and hashes are values like others; an empty log gives an empty result.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, claim, recent = None, None, OrderedDict()
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if (r.workspace, r.file_path) != file:
                    file, claim, recent = (r.workspace, r.file_path), None, OrderedDict()
                while recent and r.ts - next(iter(recent.values()))[0] > window:
                    recent.popitem(last=False)
                key = r.key
                if key in recent:
                    out.append((r.id, "duplicate", recent[key][1]))
                elif claim and claim[0] != r.holder and r.ts - claim[1] < window and r.ts < claim[2]:
                    out.append((r.id, "claimed", claim[3]))
                else:
                    claim = (r.holder, r.ts, r.until, r.id)
                    recent[key] = (r.ts, r.id)
                    out.append((r.id, "accepted", r.id))
            yield pd.DataFrame(out, columns=["id", "decision", "cause"])

    key = F.sha1(F.to_json(F.struct("summary", "file_hash")))
    until = F.coalesce("released_at", F.col("ts") + window).alias("until")
    name = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    log = requests.select("id", name("workspace"), name("file_path"), name("holder"), key.alias("key"), "ts", until)
    dealt = log.repartition("workspace", "file_path").sortWithinPartitions("workspace", "file_path", "ts", "id")
    return dealt.mapInPandas(fold, "id long, decision string, cause long")
