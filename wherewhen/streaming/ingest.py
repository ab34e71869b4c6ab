"""Streams into a ledger, and running state over streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wherewhen.plans.ledger import Ledger


def stream_into(ledger: Ledger, stream: DataFrame, checkpoint: str, decide: Callable[[DataFrame], None] | None = None, **trigger) -> StreamingQuery:
    """Appends every micro-batch as a batch of the ledger; a rejected one stops the stream and changes nothing.

    decide is called after each with the current state: the place for policies that act on it.
    """

    def store(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            ledger.append(batch, token=f"{checkpoint}#{number}")  # a micro-batch that is run again is known by its number
            if decide is not None:
                decide(ledger.current_state())

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows by key and window, with a watermark for late ones."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide or width), key).agg(F.count("*").alias("n_rows"))


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows by key and session, a session ending where a gap begins."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n_rows"))


def topology_stream(stream: DataFrame, key: str = "entity", parent: str = "parent", epoch: str = "epoch_ns") -> DataFrame:
    """(child, parent, epoch) whenever a key's parent changes, in the order rows arrive; a late row of another parent than the current one is logged but does not move the current edge back."""

    def fold(k, frames, state):
        at, now = state.get if state.exists else (None, None)
        for pdf in frames:
            out = []
            for e, p in pdf.sort_values(epoch)[[epoch, parent]].itertuples(index=False):
                if now is None or p != now:
                    out.append((k[0], p, e))
                if at is None or e >= at:
                    at, now = int(e), int(p)
            yield pd.DataFrame(out, columns=["child", "parent", "epoch"])
        if now is not None:
            state.update((at, now))

    return stream.select(key, parent, epoch).groupBy(key).applyInPandasWithState(fold, "child bigint, parent bigint, epoch bigint", "at bigint, now bigint", "append", "NoTimeout")


def pose_stream(stream: DataFrame, key: str = "entity", epoch: str = "epoch_ns", values: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(key, epoch, values) of every key's latest row so far, whenever that changes: a running cache of poses. Of rows at one epoch the first to come stays."""
    kinds = dict(stream.dtypes)

    def fold(k, frames, state):
        best = state.get if state.exists else None
        before = best
        for pdf in frames:
            for row in pdf[[epoch, *values]].itertuples(index=False):
                if best is None or row[0] > best[0]:
                    best = (int(row[0]), *map(float, row[1:]))
        if best != before:
            state.update(best)
            yield pd.DataFrame([(k[0], *best)], columns=[key, epoch, *values])

    held = f"{epoch} bigint, " + ", ".join(f"{v} double" for v in values)
    return stream.select(key, epoch, *values).groupBy(key).applyInPandasWithState(fold, f"{key} {kinds[key]}, {held}", held, "update", "NoTimeout")
