"""Status of long runs as keyed state with timers: a run that falls silent is in error, and its state goes later."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Statuses of a step, in the order in which they count at the same time.
STATUSES = ("running", "done", "error")
SILENT = "silent"
_STATE = "status string, started long, seen long, ended long"


def status_changes(updates: DataFrame, key: str, at: str, status: str, *, silence: int, forget: int, late: str = "0 seconds", error: str | None = None) -> DataFrame:
    """A stream of key, status, at, started_at, ended_at and error: a row for each change of a key's status.

    `updates` is a stream with a key, an event time and a status: running begins a run anew, done and error end it; any
    other value only shows that the run is alive. A running key of which nothing is seen for `silence` seconds turns to
    error at that time, with the error "silent", by the next update's time or by the watermark, which `late` holds back.
    A key that has ended is forgotten `forget` seconds later, and one without a status `forget` seconds after it was
    seen; it begins anew if it comes back. Updates of a key that are older than what was seen of it are left out. Whatever the batches, the changes are the same, as
    long as no key's updates come later than its newer ones.

    The state of a key is four values; keys are spread by hash and no batch holds more of a key than its new updates.
    """
    kind = dict(updates.dtypes)[key]
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.coalesce(status, F.lit("")))
    rows = updates.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    # each column costs every call of a key a conversion, so a status travels as its rank alone, and errors if there are any
    rows = rows.select(key, at, F.unix_micros(F.col(at).cast("timestamp")).alias("micros"), rank.cast("long").alias("rank"), *([F.col(error).alias("error")] if error else []))
    quiet, gone = silence * 1_000_000, forget * 1_000_000

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, started, seen, ended = state.get if state.exists else (None, None, None, None)
        out: list[tuple] = []

        def say(to: str, when: int, why: str | None) -> None:
            nonlocal now, started, ended
            now, started, ended = to, when if to == "running" else started, None if to == "running" else when
            out.append((to, when, started, ended, why))

        if state.hasTimedOut:
            if now == "running":
                say("error", seen + quiet, SILENT)
            else:
                now = None
                state.remove()
        else:
            told = (r for f in frames for r in zip(f["micros"].tolist(), f["rank"].tolist(), f["error"] if error else repeat(None, len(f)), strict=True))
            for micros, place, why in sorted(told, key=lambda r: r[:2]):
                if seen is not None and micros < seen:
                    continue
                if now == "running" and seen + quiet < micros:
                    say("error", seen + quiet, SILENT)
                if ended is not None and ended + gone < micros:
                    now = started = ended = None  # forgotten by then, whether or not its timer has come
                seen, to = micros, STATUSES[place - 1] if place else None
                if to:
                    say(to, seen, why if to == "error" and isinstance(why, str) else None)
        if seen is not None and (now is not None or not state.hasTimedOut):
            state.update((now, started, seen, ended))
            timer = seen + quiet if now == "running" else (seen if ended is None else ended) + gone
            state.setTimeoutTimestamp(max(timer // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            # one block of objects, which Spark puts together with other keys' and gives its types
            made = pd.DataFrame(out, columns=["status", "micros", "started", "ended", "error"], dtype=object)
            made.insert(0, "key", group[0])
            yield made

    schema = f"key {kind}, status string, micros long, started long, ended long, error string"
    found = rows.groupBy(key).applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    times = [F.timestamp_micros(c).alias(n) for c, n in (("micros", at), ("started", "started_at"), ("ended", "ended_at"))]
    return found.select(F.col("key").alias(key), "status", *times, "error")
