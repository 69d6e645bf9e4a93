"""Streams of track points: speed checks with state, windows, duplicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from trekframe.sources.shared import ship


def window_counts(points: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """start, region_key, n of tumbling or sliding windows on event time."""
    slot = F.window("event_ts", size, slide) if slide else F.window("event_ts", size)
    return points.withWatermark("event_ts", late).groupBy(slot.alias("w"), "region_key").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "region_key", "n")


def sessions(points: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """track_id, start, end, n of sessions apart by a gap."""
    return points.withWatermark("event_ts", late).groupBy(F.session_window("event_ts", gap).alias("w"), "track_id").agg(F.count("*").alias("n")).select("track_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(points: DataFrame, late: str = "2 days") -> DataFrame:
    """Points without those repeated within the watermark."""
    return points.withWatermark("event_ts", late).dropDuplicatesWithinWatermark(["track_id", "point_index"])


def _kmh(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Speeds between the rows of two frames of equal length; not a number where a position is unknown or no time passes."""
    p1, p2 = np.radians(a["latitude"].to_numpy(float)), np.radians(b["latitude"].to_numpy(float))
    half = np.radians(b["longitude"].to_numpy(float) - a["longitude"].to_numpy(float)) / 2
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(half) ** 2
    hours = (b["event_ts"].to_numpy("datetime64[us]") - a["event_ts"].to_numpy("datetime64[us]")).astype(float) / 3.6e9
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(hours > 0, 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1, h))) / hours, np.nan)


_POINT = "event_id long, event_ts timestamp, latitude double, longitude double"
_NAMES = ["event_id", "event_ts", "latitude", "longitude"]


class _Speeds(StatefulProcessor):
    """A track's speeds. State: its last point, and where points wait for their turn those above the watermark.

    An event-time timer fires when the watermark has passed the first waiting
    point, or, if none waits, the end of the last point's keep; then it goes too.
    """

    def __init__(self, max_kmh: float, in_order: bool, skip_unknown: bool, keep_ms: int):
        self.max_kmh, self.in_order, self.skip_unknown, self.keep_ms = max_kmh, in_order, skip_unknown, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _POINT)
        self.waiting = handle.getListState("waiting", _POINT)

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows))[_NAMES]
        if self.in_order:
            waiting = self._waiting()
            yield self._advance(key, pd.concat([waiting, batch]) if len(waiting) else batch, timerValues.getCurrentWatermarkInMs())
        else:
            yield self._checked(key, batch)
            self._arm(None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.in_order and self.waiting.exists():
            yield self._advance(key, self._waiting(), watermark)
            return
        if self.last.exists() and _ms(self.last.get()[1]) + self.keep_ms <= watermark:
            self.last.clear()
        else:
            self._arm(None)
        yield self._rows(key, [], [], [])

    def close(self) -> None:
        pass

    def _waiting(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(x) for x in self.waiting.get()] if self.waiting.exists() else [], columns=_NAMES)

    def _advance(self, key, rows: pd.DataFrame, watermark: int) -> pd.DataFrame:
        due = pd.to_datetime(rows["event_ts"]) <= pd.Timestamp(watermark, unit="ms")
        rest = rows[~due]
        if len(rest):
            self.waiting.put([tuple(r) for r in rest.astype(object).where(rest.notna(), None).itertuples(index=False)])
        else:
            self.waiting.clear()
        out = self._checked(key, rows[due])
        self._arm(pd.to_datetime(rest["event_ts"]).min() if len(rest) else None)
        return out

    def _arm(self, first) -> None:
        """One timer: at the first waiting point, else at the end of the last point's keep."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if first is not None:
            self.handle.registerTimer(_ms(first))
        elif self.last.exists():
            self.handle.registerTimer(_ms(self.last.get()[1]) + self.keep_ms)

    def _checked(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.astype({"latitude": float, "longitude": float})
        if self.skip_unknown:
            rows = rows.dropna(subset=["latitude", "longitude"])
        rows = rows.assign(event_ts=pd.to_datetime(rows["event_ts"])).sort_values(["event_ts", "event_id"])
        if self.last.exists():
            last = pd.DataFrame([tuple(self.last.get())], columns=_NAMES).astype({"latitude": float, "longitude": float})
            last = last.assign(event_ts=pd.to_datetime(last["event_ts"]))
            later = rows[rows["event_ts"] >= last["event_ts"].iloc[0]]
            rows = pd.concat([last, later]) if len(later) else last
        if not len(rows):
            return self._rows(key, [], [], [])
        a, b = rows.iloc[:-1], rows.iloc[1:]
        kmh = _kmh(a, b)
        fast = np.flatnonzero(kmh > self.max_kmh)
        end = rows.iloc[-1]
        self.last.update((int(end["event_id"]), end["event_ts"].to_pydatetime(), *(None if np.isnan(end[c]) else float(end[c]) for c in ("latitude", "longitude"))))
        return self._rows(key, a["event_id"].to_numpy()[fast], b["event_id"].to_numpy()[fast], kmh[fast])

    @staticmethod
    def _rows(key, a, b, kmh) -> pd.DataFrame:
        return pd.DataFrame({"track_id": pd.Series([key[0]] * len(kmh), dtype=object), "event_id": pd.Series(b, dtype="int64"), "from_event_id": pd.Series(a, dtype="int64"), "kmh": pd.Series(kmh, dtype=float)})


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).timestamp() * 1000)


def _speeds(points: DataFrame, max_kmh: float, late: str, in_order: bool, skip_unknown: bool, keep: str) -> DataFrame:
    ship(points.sparkSession)
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = points.withWatermark("event_ts", late).select("track_id", *_NAMES)
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return rows.groupBy("track_id").transformWithStateInPandas(_Speeds(max_kmh, in_order, skip_unknown, keep_ms), "track_id string, event_id long, from_event_id long, kmh double", "Append", "EventTime")


def fast_pairs(points: DataFrame, max_kmh: float = 50.0, late: str = "2 days", keep: str = "30 days") -> DataFrame:
    """track_id, event_id, kmh of points reached too fast, at once: a batch's points are put in order, those older than the track's last point are left out, as are unknown positions.

    The last point of a track is forgotten when the watermark is ``keep`` past it.
    """
    return _speeds(points, max_kmh, late, False, True, keep).select("track_id", "event_id", "kmh")


def speed_violations(points: DataFrame, max_kmh: float = 50.0, late: str = "2 days", keep: str = "30 days") -> DataFrame:
    """track_id, event_id, kmh of points from which the next one is reached too fast, as the batch check gives them, whatever the batches: points wait until the watermark has passed them, so those up to ``late`` late take their place.

    A point of unknown position takes its place too, and no speed leads to it or
    from it. State of a track ends when the watermark is ``keep`` past its last
    point; a point after that begins anew.
    """
    return _speeds(points, max_kmh, late, True, False, keep).select("track_id", F.col("from_event_id").alias("event_id"), "kmh")
