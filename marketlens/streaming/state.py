"""Operators that remember: the status of warnings from run to run, decisions that ripen, a master that only grows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_RANK = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}
STATUS = "ticker string, category string, run date, severity string, status string"
RIPE = "id string, decided timestamp, due timestamp"


def _status(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    was = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("run", kind="stable")
    out = []
    for run, severity in zip(rows["run"], rows["severity"], strict=True):
        status = "new" if was is None else "escalated" if _RANK.get(severity, 9) < _RANK.get(was, 9) else "ongoing"
        out.append((*key, run, severity, status))
        was = severity
    state.update((was,))
    yield pd.DataFrame(out, columns=["ticker", "category", "run", "severity", "status"])


def warning_status(warnings: DataFrame) -> DataFrame:
    """A stream of (ticker, category, run, severity) -> the same with status: new, escalated or ongoing against the key's run before."""
    keyed = warnings.select("ticker", "category", "run", "severity").groupBy("ticker", "category")
    return keyed.applyInPandasWithState(_status, STATUS, "severity string", "append", GroupStateTimeout.NoTimeout)


def _ripening(days: int):
    wait = days * 86_400_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            decided = pd.Timestamp(state.get[0], unit="ms")
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "decided": [decided], "due": [decided + pd.Timedelta(days=days)]})
            return
        first = min(int(pd.Timestamp(batch["ts"].min()).timestamp() * 1000) for batch in batches)
        if not state.exists:
            state.update((first,))
            state.setTimeoutTimestamp(max(first + wait, state.getCurrentWatermarkMs() + 1))

    return run


def ripe_decisions(decisions: DataFrame, days: int = 45, late: str = "1 day") -> DataFrame:
    """A stream of (id, ts) -> each decision once, when the stream's own time is ``days`` past it."""
    keyed = decisions.select(F.col("id").cast("string").alias("id"), "ts").withWatermark("ts", late).groupBy("id")
    return keyed.applyInPandasWithState(_ripening(days), RIPE, "decided long", "append", GroupStateTimeout.EventTimeTimeout)


def insert_only(batch: DataFrame, folder: str, key: str) -> int:
    """Adds the keys that the master table does not have yet, each once; what is there never changes. For foreachBatch."""
    from marketlens.sources.files import previous_run

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
    known = previous_run(batch.sparkSession, folder, schema)
    fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).join(known.select(key), key, "left_anti").select(*batch.columns).persist()
    added = fresh.count()
    fresh.write.mode("append").parquet(folder)
    fresh.unpersist()
    return added


SCORED = "ticker string, id string, decided timestamp, scored timestamp, price_at_decision double, target_at_decision double, price double, realized_return_pct double, outcome string"


def _one_decimal(x: float) -> float:
    """Rounded half up from its shortest decimal form, as the batch form rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_UP))


def _judged(price_at: float, target: float, price: float | None) -> tuple[float | None, str]:
    # fixed values: the outcomes' names
    if price is None:
        return None, "Left Watchlist (unscored)"
    realized, anticipated = ((_one_decimal((x - price_at) / price_at * 100) if price_at else None) for x in (price, target))
    won = realized is not None and anticipated > 0 and realized >= 0.5 * anticipated
    return realized, "Thesis Playing Out" if won else "Underperforming"


def _scoring(days: int):
    wait = days * 86_400_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # pending: [id, decided, price then, target then, time and value of the last price that is not after the due time]
        pending, newest = json.loads(state.get[0]) if state.exists else ([], None)
        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            # in the order of time; of prices at one time the highest is the last
            rows = pd.concat(list(batches)).sort_values(["ts", "price"], kind="stable")
            at, told = rows["ts"].astype("datetime64[ms]").to_numpy("int64"), rows["id"].isna().to_numpy()
            times, prices = at[told], rows["price"].to_numpy("float64")[told]
            held = {p[0] for p in pending}
            for t, i, price, target in zip(at.tolist(), rows["id"], rows["price"].tolist(), rows["target"].tolist(), strict=True):
                if pd.isna(i):
                    if newest is None or t >= newest[0]:
                        newest = [t, None if pd.isna(price) else price]
                elif i not in held:
                    held.add(i)
                    pending.append([i, t, price, target, *(newest if newest and newest[0] <= t + wait else [None, None])])
            # of the prices up to a due time only the last counts, so each decision looks one up
            last = np.searchsorted(times, np.array([p[1] + wait for p in pending], "int64"), "right") - 1
            for p, k in zip(pending, last.tolist(), strict=True):
                if k >= 0 and (p[4] is None or times[k] >= p[4]):
                    p[4], p[5] = int(times[k]), None if np.isnan(prices[k]) else float(prices[k])
        # a timer for the earliest is enough, as it is set again until none is left
        due = [p for p in pending if p[1] + wait < mark]
        pending = [p for p in pending if p[1] + wait >= mark]
        state.update((json.dumps([pending, newest]),))
        if pending:
            state.setTimeoutTimestamp(max(min(p[1] for p in pending) + wait, mark + 1))
        stamp = lambda ms: pd.Timestamp(ms, unit="ms")
        rows = [(key[0], p[0], stamp(p[1]), stamp(p[1] + wait), p[2], p[3], p[5], *_judged(p[2], p[3], p[5])) for p in due]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCORED.split(", ")])

    return run


def scored_stream(decisions: DataFrame, prices: DataFrame, days: int = 45, late: str = "1 day") -> DataFrame:
    """Two streams, decisions (id, ticker, ts, price, target) and prices (ticker, ts, price) -> each decision once, scored.

    A decision is scored by the ticker's last price at its due time, ``days`` after it was made, when the watermark of
    both streams has passed that time; a null price, or none, has left the watchlist. Decisions without a price or target
    of their own are not kept. Prices may come before or after the decision, and late ones count up to the watermark.
    Of a ticker's prices the state holds the newest, and one for each decision that waits.
    """
    asked = decisions.where("price is not null and target is not null and id is not null").select("ticker", "ts", F.col("id").cast("string").alias("id"), F.col("price").cast("double").alias("price"), F.col("target").cast("double").alias("target"))
    told = prices.select("ticker", "ts", F.lit(None).cast("string").alias("id"), F.col("price").cast("double").alias("price"), F.lit(None).cast("double").alias("target"))
    both = asked.unionByName(told).where("ticker is not null").withWatermark("ts", late).groupBy("ticker")
    return both.applyInPandasWithState(_scoring(days), SCORED, "held string", "append", GroupStateTimeout.EventTimeTimeout)
