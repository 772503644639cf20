"""Keyed state processors: the live form of the order-dependent operators.

Each processor receives the rows that one key contributed to a micro batch (bounded by the source's
per-trigger limit), puts them in arrival order and steps a few state variables. The results equal
those of the batch operators over the same rows.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from busline import contracts as C
from busline.operators.detect import REFUSED_SOURCE, RULES_VERSION, largest_cluster
from busline.operators.forest import Packed


def _ordered(rows: Iterator[pd.DataFrame], *by: str) -> list[dict]:
    parts = [p for p in rows if len(p)]
    if not parts:
        return []
    return pd.concat(parts).sort_values(list(by), kind="stable").to_dict("records")


def _text(value) -> str | None:
    return None if value is None or value != value else str(value)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


class TripContext(StatefulProcessor):
    """Lifecycle and telemetry of one bus: active trip, known trips, newest reading time."""

    COLUMNS = ["bus_id", "arrival", "body", "trip_id", "route_id", "trip_status"]
    SCHEMA = ("bus_id string, arrival long, body string, trip_id string, route_id string, trip_status string")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "trip string, route string, status string")
        self.newest = handle.getValueState("newest", "t long")
        self.routes = handle.getMapState("routes", "trip string", "route string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        state = self.active.get() if self.active.exists() else None
        newest = self.newest.get()[0] if self.newest.exists() else None
        for row in _ordered(rows, "arrival"):
            event, trip, route = _text(row["event"]), _text(row["trip"]), _text(row["route"])
            if event is not None:
                if event in ("TRIP_STARTED", "TRIP_ACTIVATED", "STARTED") and route:
                    self.routes.updateValue((trip or "",), (route,))
                    state = (trip, route, "ACTIVE")
                elif event in ("TRIP_ENDED", "TRIP_COMPLETED", "ENDED"):
                    if self.routes.containsKey((trip or "",)):
                        self.routes.removeKey((trip or "",))
                    state = (None, None, "INACTIVE")
                continue
            t = int(row["t"])
            if newest is not None and t <= newest:
                continue
            newest = t
            boot_trip, boot_route = (_text(row["boot_trip"]), _text(row["boot_route"])) if state is None else (None, None)
            now_trip = trip or (state[0] if state else None) or boot_trip
            now_route = route or (state[1] if state else None) or boot_route
            if not now_route and now_trip and self.routes.containsKey((now_trip,)):
                now_route = self.routes.getValue((now_trip,))[0]
            status = state[2] if state else ("ACTIVE" if boot_trip or now_route else "INACTIVE")
            out.append((key[0], int(row["arrival"]), row["body"], now_trip, now_route, status))
        if state is not None:
            self.active.update(state)
        if newest is not None:
            self.newest.update((newest,))
        yield _frame(out, self.COLUMNS)


class IngestRules(StatefulProcessor):
    """Duplicate, sequence and rate rules of one bus; only accepted readings move the state."""

    COLUMNS = ["bus_id", "arrival", "verdict"]
    SCHEMA = "bus_id string, arrival long, verdict string"

    def __init__(self, limits: C.Thresholds = C.DEFAULTS):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long")
        self.seen = handle.getListState("seen", "identity string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        recent = [r[0] for r in self.seen.get()] if self.seen.exists() else []
        out = []
        for row in _ordered(rows, "arrival"):
            t, identity = int(row["t"]), row["identity"]
            if identity in recent:
                verdict = "DUPLICATE"
            elif last is not None and t < last:
                verdict = "SEQUENCE_ERROR"
            elif last is not None and t - last < self.limits.min_event_gap_ms:
                verdict = "RATE_LIMIT_EVENT_TIME"
            else:
                verdict, last = None, t
                recent = [*recent, identity][-self.limits.duplicate_cache:]
            out.append((key[0], int(row["arrival"]), verdict))
        if last is not None:
            self.last.update((last,))
            self.seen.put([(x,) for x in recent])
        yield _frame(out, self.COLUMNS)


class OffRouteStreak(StatefulProcessor):
    """Anchored off-route window of one bus; emits the reading that completes a streak."""

    COLUMNS = ["bus_id", "t", "off_route_m"]
    SCHEMA = "bus_id string, t long, off_route_m double"

    def __init__(self, limits: C.Thresholds = C.DEFAULTS):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start long, n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.window.get() if self.window.exists() else None
        out = []
        for row in _ordered(rows, "t"):
            if not row["off_route"]:
                state = None
                continue
            t = int(row["t"])
            if state is None or t - state[0] > self.limits.streak_window_ms:
                state = (t, 0)
            state = (state[0], state[1] + 1)
            if state[1] == self.limits.streak_count:
                out.append((key[0], t, float(row["off_route_m"])))
        if state is None:
            self.window.clear()
        else:
            self.window.update((int(state[0]), int(state[1])))
        yield _frame(out, self.COLUMNS)


class BehaviourWindow(StatefulProcessor):
    """Last readings of one bus and their summary vector."""

    COLUMNS = ["bus_id", "t", *C.BEHAVIOURAL_FEATURES]
    SCHEMA = "bus_id string, t long, " + ", ".join(f"{f} double" for f in C.BEHAVIOURAL_FEATURES)

    def __init__(self, limits: C.Thresholds = C.DEFAULTS):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "t long, speed double, heading double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        out = []
        for row in _ordered(rows, "t"):
            kept = [*kept, (int(row["t"]), float(row["speed"]), float(row["heading"]))][-self.limits.behaviour_rows:]
            if len(kept) < self.limits.behaviour_min_rows:
                continue
            t, speed, heading = np.array(kept, dtype=float).T
            seconds = np.diff(t) / 1000.0
            rate = np.diff(speed)[seconds > 0] / seconds[seconds > 0]
            out.append((key[0], kept[-1][0], float(rate.max(initial=-np.inf)) if len(rate) else 0.0,
                        float(rate.min(initial=np.inf)) if len(rate) else 0.0, float(speed.var()), float(heading.var()),
                        float(speed.mean()), float(len(kept))))
        self.rows.put(kept)
        yield _frame(out, self.COLUMNS)


class StationaryWindow(StatefulProcessor):
    """Trailing coordinates of one bus; emits the reading at which they become one dense cluster."""

    COLUMNS = ["bus_id", "t"]
    SCHEMA = "bus_id string, t long"

    def __init__(self, limits: C.Thresholds = C.DEFAULTS):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", "t long, lat double, lon double")
        self.alerted = handle.getValueState("alerted", "on boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        limits = self.limits
        kept = [tuple(r) for r in self.points.get()] if self.points.exists() else []
        alerted = bool(self.alerted.get()[0]) if self.alerted.exists() else False
        out = []
        for row in _ordered(rows, "t"):
            t = int(row["t"])
            kept = [p for p in kept if p[0] >= t - limits.stationary_ms] + [(t, float(row["lat"]), float(row["lon"]))]
            dense = False
            if len(kept) >= limits.stationary_min_points and t - kept[0][0] >= limits.stationary_span_ms:
                grid = pd.DataFrame(kept).iloc[:, 1:].to_numpy()
                top = largest_cluster(grid, limits.stationary_eps_deg, limits.stationary_min_points)
                dense = top / len(kept) >= limits.stationary_share
            if dense and not alerted:
                out.append((key[0], t))
            alerted = dense
        self.points.put(kept)
        self.alerted.update((alerted,))
        yield _frame(out, self.COLUMNS)


class SilenceTimer(StatefulProcessor):
    """One alert per silence of a bus: a timer is set past the newest reading and moved by the next."""

    COLUMNS = ["bus_id", "t", "alert_ms"]
    SCHEMA = "bus_id string, t long, alert_ms long"

    def __init__(self, limits: C.Thresholds = C.DEFAULTS):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = [int(r["t"]) for r in _ordered(rows, "t")]
        previous = self.last.get()[0] if self.last.exists() else None
        out = []
        for t in times:
            if previous is not None and t - previous > self.limits.silence_ms and not self._fired(previous):
                out.append((key[0], previous, t))
            previous = t if previous is None else max(previous, t)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((previous,))
        self.handle.registerTimer(previous + self.limits.silence_ms + 1)
        yield _frame(out, self.COLUMNS)

    def _fired(self, previous: int) -> bool:
        """The timer of this silence is gone when it has already raised the alert."""
        return previous + self.limits.silence_ms + 1 not in list(self.handle.listTimers()) and self._was_set(previous)

    def _was_set(self, previous: int) -> bool:
        return self.last.exists() and self.last.get()[0] == previous

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame([(key[0], self.last.get()[0], expiredTimerInfo.getExpiryTimeInMs())], self.COLUMNS)


class InactiveTripBurst(StatefulProcessor):
    """Refusals of one bus inside a minute, with a cooldown after each alert."""

    COLUMNS = ["bus_id", "t", "dlq_count"]
    SCHEMA = "bus_id string, t long, dlq_count long"

    def __init__(self, limits: C.Thresholds = C.DEFAULTS):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "t long")
        self.raised = handle.getValueState("raised", "t long")

    def hits(self, rows: list[dict]) -> list[tuple[dict, int]]:
        """(row, refusals in its window) of the rows that raise an alert; ``rows`` are in order."""
        kept = [r[0] for r in self.times.get()] if self.times.exists() else []
        last = self.raised.get()[0] if self.raised.exists() else None
        out = []
        for row in rows:
            t = int(row["t"])
            kept = [x for x in kept if x >= t - self.limits.dlq_window_ms] + [t]
            cooling = last is not None and t - last < self.limits.dlq_cooldown_ms
            if len(kept) >= self.limits.dlq_count and not cooling:
                last = t
                out.append((row, len(kept)))
        if kept:
            self.times.put([(x,) for x in kept])
        if last is not None:
            self.raised.update((last,))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield _frame([(key[0], int(row["t"]), n) for row, n in self.hits(_ordered(rows, "t", "arrival"))], self.COLUMNS)


class Detectors(StatefulProcessor):
    """All detectors of one bus in one pass over its readings and refusals; alerts in the shape of ``detect.alert``.

    Each stateful rule is one of the processors above with state variables of its own. ``forest`` (a packed forest, with
    the score above which a window is an anomaly) is asked first about behaviour; the rules are the fallback. Silence is
    seen by the next reading or by an event-time timer, whichever comes first.
    """

    COLUMNS = ["bus_id", "anomaly_type", "severity", "message", "trip_id", "route_id", "lat", "lon", "t", "model_version", "source", "detail"]
    SCHEMA = ("bus_id string, anomaly_type string, severity string, message string, trip_id string, route_id string, lat double, "
              "lon double, t long, model_version string, source string, detail string")

    def __init__(self, limits: C.Thresholds = C.DEFAULTS, version: str = RULES_VERSION, forest: tuple[Packed, float] | None = None):
        self.limits, self.version, self.forest = limits, version, forest
        self.streak, self.behaviour = OffRouteStreak(limits), BehaviourWindow(limits)
        self.stationary, self.burst = StationaryWindow(limits), InactiveTripBurst(limits)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        for part in (self.streak, self.behaviour, self.stationary, self.burst):
            part.init(handle)
        self.newest = handle.getValueState("newest", "t long, trip string, route string, lat double, lon double")

    def _alert(self, bus: str, row: dict, kind: str, message: str, detail: dict | None = None, source: str | None = None) -> tuple:
        return (bus, kind, "HIGH" if kind in C.HIGH_SEVERITY else "MEDIUM", message, _text(row["trip_id"]), _text(row["route_id"]),
                row["lat"], row["lon"], int(row["t"]), self.version, source, None if detail is None else json.dumps(detail))

    def _silence(self, bus: str, last: tuple) -> tuple:
        row = dict(zip(("t", "trip_id", "route_id", "lat", "lon"), last, strict=True))
        return self._alert(bus, row, "COMMUNICATION_LOSS", "No telemetry for over 3 minutes")

    def _silences(self, bus: str, rows: list[dict]) -> list[tuple]:
        last = tuple(self.newest.get()) if self.newest.exists() else None
        # the timer of a silence that was already reported is gone
        reported = last is not None and not list(self.handle.listTimers())
        out = []
        for row in rows:
            t = int(row["t"])
            if last is not None and t - last[0] > self.limits.silence_ms and not reported:
                out.append(self._silence(bus, last))
            last, reported = (t, _text(row["trip_id"]), _text(row["route_id"]), row["lat"], row["lon"]), False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.newest.update(last)
        self.handle.registerTimer(last[0] + self.limits.silence_ms + 1)
        return out

    def _erratic(self, bus: str, by_time: dict[int, dict], vectors: pd.DataFrame) -> Iterator[tuple]:
        if not len(vectors):
            return
        names, limits = C.BEHAVIOURAL_FEATURES, self.limits
        odd = np.zeros(len(vectors), dtype=bool)
        if self.forest is not None:
            odd = self.forest[0].rate(vectors[names].to_numpy(dtype=float)) > self.forest[1]
        rules = (((vectors["speed_variance"] >= limits.behaviour_speed_var) & (vectors["heading_variance"] >= limits.behaviour_heading_var))
                 | (vectors["max_acceleration"] >= limits.behaviour_acceleration)).to_numpy()
        for n in np.flatnonzero(odd | rules):
            vector = vectors.iloc[n]
            detail = {"features": {f: float(vector[f]) for f in names}, "detectionMethod": "isolation_forest" if odd[n] else "rules_fallback"}
            told = "Isolation Forest" if odd[n] else "rule fallback"
            yield self._alert(bus, by_time[int(vector["t"])], "ERRATIC_DRIVING", f"Behavioral anomaly detected ({told})", detail)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        limits, bus, out = self.limits, key[0], []
        ordered = _ordered(rows, "t", "arrival")
        readings, refused = [r for r in ordered if not r["refused"]], [r for r in ordered if r["refused"]]
        for row in readings:
            if row["speed"] > limits.alert_speed_kmh:
                out.append(self._alert(bus, row, "UNREALISTIC_SPEED", "Speed exceeded 120 km/h"))
            if not _text(row["route_id"]):
                out.append(self._alert(bus, row, "INACTIVE_GPS", "GPS received for inactive trip"))
            elif row["off_route"]:
                out.append(self._alert(bus, row, "OFF_ROUTE", f"Bus deviated by {round(row['off_route_m'])}m from route"))
        active = [r for r in readings if _text(r["route_id"])]
        if active:
            by_time = {int(r["t"]): r for r in active}
            frame = pd.DataFrame(active)
            seconds = limits.streak_window_ms // 1000
            for _, t, metres in next(self.streak.handleInputRows(key, iter([frame]), timerValues)).itertuples(index=False):
                detail = {"streakCount": limits.streak_count, "windowSeconds": seconds, "offRouteDistanceM": metres}
                message = f"Bus remained off-route for {limits.streak_count} readings within {seconds}s"
                out.append(self._alert(bus, by_time[t], "PERSISTENT_OFF_ROUTE", message, detail))
            for _, t in next(self.stationary.handleInputRows(key, iter([frame]), timerValues)).itertuples(index=False):
                out.append(self._alert(bus, by_time[t], "STATIONARY", "Bus stationary (DBSCAN cluster detected) for over 5 minutes"))
            out += self._erratic(bus, by_time, next(self.behaviour.handleInputRows(key, iter([frame]), timerValues)))
            out += self._silences(bus, active)
        if refused:
            for row, count in self.burst.hits(refused):
                detail = {"sourceReason": "INACTIVE_TRIP", "dlqCount": count, "windowSeconds": limits.dlq_window_ms // 1000}
                out.append(self._alert(bus, row, "TRIP_NOT_STARTED_DEVICE_ACTIVE", "Device is sending GPS but no active trip exists", detail, REFUSED_SOURCE))
        yield _frame(out, self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame([self._silence(key[0], tuple(self.newest.get()))], self.COLUMNS)


class SpeedSmoothing(StatefulProcessor):
    """Recent speeds of one trip; a trip end clears them. ``body`` is handed through with its reading."""

    COLUMNS = ["trip_id", "t", "smoothed_ms", "smoothing_rows", "body"]
    SCHEMA = "trip_id string, t long, smoothed_ms double, smoothing_rows int, body string"

    def __init__(self, limits: C.Thresholds = C.DEFAULTS):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "t long, v double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        out = []
        for row in _ordered(rows, "t", "is_reading"):
            t = int(row["t"])
            if not row["is_reading"]:
                kept = []
                continue
            kept = [*kept, (t, float(row["speed_ms"]))][-self.limits.smoothing_rows:]
            kept = [p for p in kept if p[0] >= t - self.limits.smoothing_ms]
            # plainly, newest first, as the batch form does; Python's sum() would round otherwise
            total = 0.0
            for _, v in reversed(kept):
                total += v
            out.append((key[0], t, total / len(kept), len(kept), row["body"]))
        if kept:
            self.recent.put(kept)
        else:
            self.recent.clear()
        yield _frame(out, self.COLUMNS)


class DwellState(StatefulProcessor):
    """Current and previous stay of one (bus, trip); a long gap forgets both."""

    COLUMNS = ["bus_id", "trip_id", "t", "stop_id", "dwell_current_s", "dwell_prev_s"]
    SCHEMA = "bus_id string, trip_id string, t long, stop_id string, dwell_current_s long, dwell_prev_s long"

    def __init__(self, limits: C.Thresholds = C.DEFAULTS):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stay = handle.getValueState("stay", "stop string, entry long, last long, previous long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.stay.get() if self.stay.exists() else None
        out = []
        for row in _ordered(rows, "t"):
            t, stop = int(row["t"]), row["stop_id"]
            if state is None or t - state[2] > self.limits.dwell_ttl_ms:
                state = (stop, t, t, None)
            elif stop != state[0]:
                state = (stop, t, t, (state[2] - state[1]) // 1000)
            else:
                state = (stop, state[1], t, state[3])
            out.append((key[0], key[1], t, stop, (t - state[1]) // 1000, state[3]))
        if state is not None:
            self.stay.update(state)
        frame = _frame(out, self.COLUMNS)
        frame["dwell_prev_s"] = frame["dwell_prev_s"].astype("Int64")
        yield frame


class _Trailing:
    """Sums of (t, total, n) entries between two times, by running sums."""

    def __init__(self, entries):
        ordered = sorted(entries)
        self.times = [e[0] for e in ordered]
        self.totals = [0.0, *accumulate(e[1] for e in ordered)]
        self.counts = [0, *accumulate(e[2] for e in ordered)]

    def within(self, start: int, end: int) -> tuple[float, int]:
        lo, hi = bisect_left(self.times, start), bisect_right(self.times, end)
        return self.totals[hi] - self.totals[lo], self.counts[hi] - self.counts[lo]


class StopConsensus(StatefulProcessor):
    """Recent reports at one stop; each named report gets the mean of the other passengers'."""

    COLUMNS = ["passenger_id", "arrival", "score", "others", "consensus"]
    SCHEMA = "passenger_id string, arrival long, score double, others long, consensus double"

    def __init__(self, limits: C.Thresholds = C.DEFAULTS):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        # per (second, passenger) sums keep the list as short as the window
        self.recent = handle.getListState("recent", "t long, passenger string, total double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = {(r[0], r[1]): (r[2], r[3]) for r in self.recent.get()} if self.recent.exists() else {}
        batch = [r for r in _ordered(rows, "t", "arrival") if _text(r["passenger_id"]) is not None]
        for row in batch:
            slot = (int(row["t"]), row["passenger_id"])
            total, n = kept.get(slot, (0.0, 0))
            kept[slot] = (total + float(row["score"]), n + 1)
        everyone = _Trailing((at, *v) for (at, _), v in kept.items())
        by_passenger: dict[str, list] = {}
        for (at, who), v in kept.items():
            by_passenger.setdefault(who, []).append((at, *v))
        own = {who: _Trailing(v) for who, v in by_passenger.items()}
        out = []
        for row in batch:
            t, me = int(row["t"]), row["passenger_id"]
            total, n = everyone.within(t - self.limits.crowd_window_ms, t)
            mine, times = own[me].within(t - self.limits.crowd_window_ms, t)
            others = n - times
            out.append((me, int(row["arrival"]), float(row["score"]), others, (total - mine) / others if others else None))
        if batch:
            edge = int(batch[-1]["t"]) - self.limits.crowd_window_ms
            self.recent.put([(at, who, v[0], v[1]) for (at, who), v in kept.items() if at >= edge])
        yield _frame(out, self.COLUMNS)


class TrustState(StatefulProcessor):
    """Trust, total and verified reports of one passenger, report by report."""

    COLUMNS = ["passenger_id", "arrival", "trust_score", "total_reports", "verified_reports"]
    SCHEMA = "passenger_id string, arrival long, trust_score double, total_reports long, verified_reports long"

    def __init__(self, limits: C.Thresholds = C.DEFAULTS):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.profile = handle.getValueState("profile", "points long, total long, verified long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        points, total, verified = self.profile.get() if self.profile.exists() else (
            round(self.limits.default_trust * 100), 0, 0)
        out = []
        for row in _ordered(rows, "arrival"):
            total += 1
            if row["others"] < 2:
                verified += 1
            elif abs(row["score"] - row["consensus"]) <= self.limits.consensus_points:
                points, verified = min(100, points + 2), verified + 1
            else:
                points = max(0, points - 5)
            out.append((key[0], int(row["arrival"]), points / 100.0, total, verified))
        self.profile.update((int(points), int(total), int(verified)))
        yield _frame(out, self.COLUMNS)
