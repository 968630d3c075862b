"""Streams: redraws of pictures, latest runs, masking of arriving text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskwright.functions.text import NEUTRAL, classify

#: Channel difference that counts as a change, and tries after a failed reading.
CHANGED, RETRIES = 24, 3


def changed_box(a: Column, b: Column, side: int, channels: int = 1, threshold: float = CHANGED) -> Column:
    """struct(x, y, w, h) of the cells of two thumbnails that differ by more than ``threshold``, with one cell of margin.

    Null without change; the whole picture where the sizes differ.
    """
    per = side * side * channels
    cells = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z, i: F.struct(F.floor(i / channels).cast("int").alias("i"), (F.abs(z["a"] - z["b"]) > threshold).alias("hot")))
    hot = F.transform(F.filter(cells, lambda c: c["hot"]), lambda c: c["i"])
    xs, ys = F.transform(hot, lambda i: i % side), F.transform(hot, lambda i: F.floor(i / side).cast("int"))
    low = lambda v: F.greatest(F.array_min(v) - 1, F.lit(0))
    high = lambda v: F.least(F.array_max(v) + 2, F.lit(side))
    box = lambda x, y, w, h: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))
    same_size = (F.size(a) == per) & (F.size(b) == per)
    return F.when(~same_size, box(F.lit(0), F.lit(0), F.lit(side), F.lit(side))).when(F.size(hot) > 0, box(low(xs), low(ys), high(xs) - low(xs), high(ys) - low(ys)))


def pixel_delta(a: Column, b: Column) -> Column:
    """Mean absolute difference of two thumbnails."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0).cast("double"), lambda s, v: s + v) / F.greatest(F.size(a), F.lit(1))


WATCH = "canvas_id string, seq long, event string, x int, y int, w int, h int, tries int, hidden boolean"


def _timed(events: DataFrame, forget: str | None, late: str) -> tuple[DataFrame, int, str]:
    """(events with a watermark, milliseconds after which a key's state ends, the kind of timeout)."""
    if forget is None:
        return events.withColumn("ts", F.lit(None).cast("timestamp")), 0, GroupStateTimeout.NoTimeout
    return events.withWatermark("ts", late), int(pd.Timedelta(forget).total_seconds() * 1000), GroupStateTimeout.EventTimeTimeout


def _ends(state: GroupState, last: pd.Timestamp | None, forget_ms: int) -> None:
    """Let the state end ``forget_ms`` after the key's last event, by the events' own time."""
    if forget_ms and last is not None:
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + forget_ms)


def watch_redraws(events: DataFrame, side: int, forget: str | None = None, late: str = "10 minutes") -> DataFrame:
    """State per canvas: what must be covered until it has been read.

    ``events``: canvas_id, seq, kind ("drawn", "read", "failed"), sig (array of numbers; drawn only), and ts where the state
    is to end. A change covers at once, a reading uncovers, a failed one counts; after ``RETRIES`` failures the cover stays.
    A canvas that is silent for ``forget`` ("1 hour"), by the events' time, is forgotten: what is drawn there next is new and
    covered whole. Time goes on with the events alone, so that a run over what is there ends. Without ``forget`` state stays.
    """
    events, forget_ms, timeout = _timed(events, forget, late)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sig, box, tries = state.get if state.exists else ([], [], 0)
        sig, box = list(sig), list(box)
        out, rows = [], pd.concat(list(batches)).sort_values("seq")
        last = rows.ts.max() if forget_ms else None
        for r in rows.itertuples():
            if r.kind == "drawn":
                new = list(map(float, r.sig))
                hot = [i for i, (p, q) in enumerate(zip(sig, new, strict=False)) if abs(p - q) > CHANGED] if len(sig) == len(new) else range(side * side)
                if len(hot):
                    xs, ys = [i % side for i in hot], [i // side for i in hot]
                    now = [max(min(xs) - 1, 0), max(min(ys) - 1, 0), min(max(xs) + 2, side), min(max(ys) + 2, side)]
                    box = [min(box[0], now[0]), min(box[1], now[1]), max(box[2], now[2]), max(box[3], now[3])] if box else now
                    tries = 0
                sig = new
            elif r.kind == "read" and tries < RETRIES:
                box, tries = [], 0
            elif r.kind == "failed" and box:
                tries = min(tries + 1, RETRIES)
            b = [box[0], box[1], box[2] - box[0], box[3] - box[1]] if box else [0, 0, 0, 0]
            out.append((key[0], r.seq, r.kind, *b, tries, bool(box)))
        state.update((sig, box, tries))
        _ends(state, last, forget_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WATCH.split(", ")])

    return events.groupBy("canvas_id").applyInPandasWithState(step, WATCH, "sig array<double>, box array<int>, tries int", "append", timeout)


def latest_run(results: DataFrame, key: str = "canvas_id", seq: str = "seq", value: str = "value") -> DataFrame:
    """Batch: per key the value of the greatest run number."""
    return results.groupBy(key).agg(F.max(seq).alias(seq), F.max_by(value, seq).alias(value))


def latest_run_stream(results: DataFrame, forget: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Stream of (canvas_id, seq, value): late results of older runs are dropped.

    With ``forget`` (results have ts) the newest number of a key that is silent for so long is forgotten; results that are
    older than the watermark (``late``) are dropped in any case, so that ``forget`` should be the longer of the two.
    """
    results, forget_ms, timeout = _timed(results, forget, late)

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else -1
        rows, came = [], pd.concat(list(batches)).sort_values("seq")
        last = came.ts.max() if forget_ms else None
        for r in came.itertuples():
            if r.seq > seen:
                seen = int(r.seq)
                rows.append((key[0], r.seq, r.value))
        state.update((seen,))
        _ends(state, last, forget_ms)
        yield pd.DataFrame(rows, columns=["canvas_id", "seq", "value"])

    return results.groupBy("canvas_id").applyInPandasWithState(step, "canvas_id string, seq long, value double", "seen long", "append", timeout)


def mask_stream(texts: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes", allow=NEUTRAL) -> DataFrame:
    """Stream (or table) of (ts, text): hidden words per window and type."""
    words = texts.withWatermark("ts", watermark).select("ts", F.explode(F.split("text", r"\s+")).alias("word"))
    typed = words.withColumn("type", classify("word", allow)).filter("type is not null")
    return typed.groupBy(F.window("ts", window).alias("win"), "type").agg(F.count("*").alias("n")).select(F.col("win.start").alias("start"), "type", "n")
