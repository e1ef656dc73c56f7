"""The last event before each other one, on a stream whose rows come in any order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.streaming.events import with_event_time

SPANS = 4
BUCKETS = 1024
FOUND = "id bigint, key bigint, at bigint, seen_id bigint, seen_at bigint"
HELD = ["asked_key", "asked_at", "asked_id", "seen_key", "seen_at", "seen_id"]
STATE = ", ".join(f"{name} array<bigint>" for name in HELD)


def last_seen_stream(
    events: DataFrame, delay: int, key: str, id_: str, seen: str, within: int, buckets: int = BUCKETS
) -> DataFrame:
    """Each row that is not ``seen`` (a boolean column) with the latest ``seen`` row of its key.

    That is at most ``within`` seconds before it, or at the same time; of several at one time the one with the
    largest id. ``id``, ``key``, ``at``, ``seen_id`` and ``seen_at`` (both null if there is none). Key and id
    are bigints; rows without a key or a time are left out.

    A row is answered once, when the watermark is past it, so rows may come late by ``delay`` and in any order. Rows
    meet by bucket of keys and by slot of ``SPANS`` times ``within`` seconds, a seen one also in the next slot if it
    reaches into that: a key's history is spread over its slots. A bucket's slot holds what is unanswered, the seen
    rows of each key from the last one before that on, and a timer for its next answer; when the watermark leaves the
    slot, its state is dropped. Each costs a call of Python, which works on all its keys at once, so ``buckets`` is a few per
    state store, of which there are a few per core; a stream keeps the number it began with.
    """
    reach = within * 1_000_000
    width = SPANS * reach
    timed = with_event_time(events.filter(F.col(key).isNotNull()), delay)
    at = F.unix_micros("ts")

    def slot(micros: Column) -> Column:
        return F.floor(micros / F.lit(width))

    slots = F.when(F.col(seen), F.array_distinct(F.array(slot(at), slot(at + reach)))).otherwise(F.array(slot(at)))
    dealt = timed.select(
        "ts",
        F.col(key).alias("key"),
        F.col(id_).alias("id"),
        at.alias("at"),
        F.col(seen).alias("seen"),
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"),
        F.explode(slots).alias("slot"),
    )
    found = dealt.groupBy("bucket", "slot").applyInPandasWithState(
        _answer(width, reach), FOUND, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("at", "seen_at")})


def _answer(width: int, reach: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def answer(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slot = int(group[1])
        held = [np.array(x, np.int64) for x in (state.get if state.exists else [[]] * len(HELD))]
        asked, seen = [np.stack(held[:3])], [np.stack(held[3:])]
        if not state.hasTimedOut:
            for part in parts:
                rows, is_seen = part[["key", "at", "id"]].to_numpy(np.int64).T, part["seen"].to_numpy(bool)
                asked.append(rows[:, ~is_seen])
                seen.append(rows[:, is_seen])
        asks, sights = (_in_order(np.concatenate(x, axis=1)) for x in (asked, seen))

        # A timer fires when the watermark, in whole milliseconds, is past it. It is set one after the row.
        passed = state.getCurrentWatermarkMs()
        final = asks[1] // 1000 + 1 < passed
        if final.any():
            yield _found(asks[:, final], sights, reach)
        asks = asks[:, ~final]

        slot_end = -(-(slot + 1) * width // 1000) + 1
        if not asks.shape[1] and slot_end < passed:
            state.remove()
            return
        earliest = (passed - 1) * 1000  # of what is unanswered or may still be asked
        sights = sights[:, _still_needed(sights, earliest, reach)]
        state.update(tuple(x.tolist() for x in (*asks, *sights)))
        due = int(asks[1].min()) // 1000 + 1 if asks.shape[1] else slot_end
        state.setTimeoutTimestamp(max(due, passed + 1))

    return answer


def _in_order(rows: np.ndarray) -> np.ndarray:
    """By key, time and id, which are the rows of the array."""
    return rows[:, np.lexsort(rows[::-1])]


def _still_needed(sights: np.ndarray, earliest: int, reach: int) -> np.ndarray:
    """Seen rows, in order, that a question at ``earliest`` or later can have as its answer."""
    key, at, _ = sights
    covered = np.zeros(len(at), bool)  # by a later one of its key, for all these questions
    covered[:-1] = (key[1:] == key[:-1]) & (at[1:] <= earliest)
    return ~covered & (at >= earliest - reach)


def _found(asks: np.ndarray, sights: np.ndarray, reach: int) -> pd.DataFrame:
    both = np.concatenate([sights, asks], axis=1)
    asking = np.arange(both.shape[1]) >= sights.shape[1]
    # At one time the seen ones come first, by id.
    order = np.lexsort((both[2], asking, both[1], both[0]))
    both, asking = both[:, order], asking[order]
    last = np.maximum.accumulate(np.where(asking, -1, np.arange(len(asking))))[asking]
    key, at, ids = both[:, asking]
    seen_key, seen_at, seen_id = both[:, last]
    some = (last >= 0) & (seen_key == key) & (at - seen_at <= reach)

    def of(values: np.ndarray) -> pd.Series:
        return pd.Series(values, dtype="Int64").mask(~some)

    return pd.DataFrame({"id": ids, "key": key, "at": at, "seen_id": of(seen_id), "seen_at": of(seen_at)})
