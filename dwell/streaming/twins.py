"""Streaming counterparts of the batch operators: sessions, presence by second, runs, live tracks and quarantine.

Runs, tracks and quarantine are machines in event-time order: rows wait in state until the watermark has passed them,
and are then taken in order, so that results don't depend on the order of arrival. What is held for a key ends by timers:
after its last row, nothing of it is left (``hold``, ``gap`` or ``buffer`` later). Later rows than the watermark are
dropped. State is kept in RocksDB, which the functions choose for the session.

A key costs some milliseconds each time a trigger or a timer meets it. With ``buckets``, keys of one hash share a state, so that
this goes with buckets, not with keys; a bucket's rows are then held together. The results are the same.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keep_state(spark: SparkSession) -> None:
    """List, map and timer state need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def label_sessions(labels: DataFrame, keys: list[str], gap: str, lateness: str) -> DataFrame:
    """Runs of each (track, label) without a gap of ``gap`` or more; ``ts`` is the event time. A change of label
    alone doesn't end a session of either label: ``label_runs`` does that."""
    return (
        labels.withWatermark("ts", lateness)
        .groupBy(*keys, "label", F.session_window("ts", gap))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_similarity"))
        .drop("session_window")
    )


def presence_by_second(labels: DataFrame, lateness: str) -> DataFrame:
    return labels.withWatermark("ts", lateness).groupBy(F.window("ts", "1 second"), "label").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("second"), "label", "n")


def _chunk(pdf: pd.DataFrame) -> tuple[list, ...]:
    """The columns ms, tie, label and score of some rows."""
    ms = pdf["ts"].astype("datetime64[ms]").astype("int64").tolist()
    return ms, pdf["tie"].tolist(), pdf["label"].tolist(), [None if x != x else x for x in pdf["score"].astype("float64").tolist()]


def _in_time(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or "", row[3] is not None, row[3] or 0.0


def _timed(handle: StatefulProcessorHandle, timer: int | None, expired: int | None, following: list[int], now: int) -> int | None:
    """The one timer of a key after ``now``, at the first of the times that follow; ``timer`` is that registered so far."""
    wanted = max(min(following), now + 1) if following else None
    held = None if timer == expired else timer
    if held is not None and (wanted is None or held <= now or held > wanted):
        handle.deleteTimer(held)
        held = None
    if wanted is not None and held is None:
        handle.registerTimer(wanted)
        held = wanted
    return held


class _InOrder(StatefulProcessor):
    """Rows (ts, tie, label, score) of a key, taken in order of event time once the watermark has passed them.

    Each call to the state is a round trip to the JVM, so rows are held in chunks as they come, and the chunks are read
    only when the first row held is due: calls grow with a key's triggers, not with its rows.
    """

    STATE = ""
    HELD = "ms array<long>, tie array<long>, label array<string>, score array<double>"
    #: Times that are kept beside a state, where a machine has any.
    _times: list[int] | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getListState("held", self.HELD)
        self._state = handle.getValueState("state", f"earliest long, timer long, {self.STATE}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = []
        for pdf in rows:
            if len(pdf):
                chunk = _chunk(pdf)
                self._held.appendValue(chunk)
                earliest.append(min(chunk[0]))
        yield from self._go(key, timerValues.getCurrentWatermarkInMs(), earliest)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._go(key, timerValues.getCurrentWatermarkInMs(), [], expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _go(self, key: tuple, now: int, earliest: list[int], expired: int | None = None) -> Iterator[pd.DataFrame]:
        """``earliest`` are the first times of chunks just held; an ``expired`` timer is ended by Spark."""
        saved = self._state.get()
        first, timer, *state = saved or (None, None, None)
        first = min([*earliest, *([] if first is None else [first])], default=None)
        state, out = None if state[-1] is None else tuple(state), []
        if first is not None and first <= now:
            first, due = self._due(now)
            for ms, _, label, score in due:
                state = self.step(state, ms, label, score, out)
        state = self.passed(state, now, out)
        following = [t for t in (first, None if state is None else self.deadline(state)) if t is not None]
        held = _timed(self._handle, timer, expired, following, now)
        new = None if not following else (first, held, *(state or (None,) * (self.STATE.count(",") + 1)))
        if new is None and saved is not None:
            self._state.clear()
        elif new is not None and (saved is None or new != tuple(saved)):
            self._state.update(new)
        if out:
            yield pd.DataFrame([(*key, *x) for x in out], columns=self.columns)

    def _due(self, now: int) -> tuple[int | None, list[tuple]]:
        """The first time of what stays held, and the rows up to ``now`` in order."""
        rows = [row for chunk in self._held.get() for row in zip(*chunk, strict=True)]
        rows.sort(key=_in_time)
        n = bisect.bisect_right(rows, now, key=lambda r: r[0])
        later = rows[n:]
        if later:
            self._held.put([tuple(map(list, zip(*later, strict=True)))])
        else:
            self._held.clear()
        return later[0][0] if later else None, rows[:n]

    def step(self, state: tuple | None, ms: int, label: str | None, score: float | None, out: list[tuple]) -> tuple | None:
        """The state after a row; what is decided by it is added to ``out``."""
        raise NotImplementedError

    def passed(self, state: tuple | None, now: int, out: list[tuple]) -> tuple | None:
        """The state when no row up to ``now`` comes any more."""
        raise NotImplementedError

    def deadline(self, state: tuple) -> int:
        """When the state changes without a row."""
        raise NotImplementedError


class _Runs(_InOrder):
    """Runs without a gap of more than ``gap_ms``, of one label each where labels count."""

    STATE = "label string, first long, last long, total double, scored long, n long"

    def __init__(self, keys: list[str], gap_ms: int, by_label: bool) -> None:
        self._gap, self._by_label = gap_ms, by_label
        self.columns = [*keys, "label", "first_ms", "last_ms", "avg_similarity", "n"]

    def _ended(self, state: tuple) -> tuple:
        label, first, last, total, scored, n = state
        return label, first, last, total / scored if scored else None, n

    def step(self, state, ms, label, score, out):
        if state is not None and (ms - state[2] > self._gap or self._by_label and label != state[0]):
            out.append(self._ended(state))
            state = None
        name, first, _, total, scored, n = state or (label, ms, ms, 0.0, 0, 0)
        return name, first, ms, total + (score or 0.0), scored + (score is not None), n + 1

    def passed(self, state, now, out):
        if state is not None and now - state[2] >= self._gap:
            out.append(self._ended(state))
            return None
        return state

    def deadline(self, state):
        return state[2] + self._gap


class _Quarantine(_InOrder):
    """Identities of samples whose label tells whether they are doubtful ("1"); those that wait are a list of their times."""

    STATE = "identity int, waiting int, last long, doubt long"

    def __init__(self, hold_ms: int, consecutive: int, forget_ms: int) -> None:
        self._hold, self._consecutive, self._forget = hold_ms, consecutive, forget_ms
        self.columns = ["track_id", "ts_ms", "identity", "flushed"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._waiting = handle.getListState("waiting", "ms long")

    def _go(self, key, now, earliest, expired=None):
        # times that wait are read when a step asks for them first, and written once when all rows due are taken
        self._times, self._kept = None, []
        yield from super()._go(key, now, earliest, expired)
        if self._times and self._times != self._kept:
            self._waiting.put([(t,) for t in self._times])
        elif self._kept and not self._times:  # read, and all released
            self._waiting.clear()

    def _now_waiting(self, waiting: int) -> list[int]:
        """The times that wait, ``waiting`` of them as the state tells."""
        if self._times is None:
            self._kept = [int(w[0]) for w in self._waiting.get()] if waiting else []
            self._times = list(self._kept)
        return self._times

    def _release(self, waiting: int, identity: int, flushed: bool, out: list[tuple]) -> None:
        times = self._now_waiting(waiting)
        out += [(t, identity, flushed) for t in times]
        times.clear()

    def step(self, state, ms, label, score, out):
        identity, waiting, last, doubt = self.passed(state, ms - 1, out) or (0, 0, ms, ms)
        if label == "1":
            self._now_waiting(waiting).append(ms)
            waiting, doubt = waiting + 1, ms
            if waiting >= self._consecutive:
                identity += 1
                self._release(waiting, identity, False, out)
                waiting = 0
        else:
            if waiting:
                self._release(waiting, identity, False, out)
                waiting = 0
            out.append((ms, identity, False))
        return identity, waiting, ms, doubt

    def passed(self, state, now, out):
        if state is None:
            return None
        identity, waiting, last, doubt = state
        if waiting and now - doubt >= self._hold:
            self._release(waiting, identity, True, out)
            waiting = 0
        return None if now - last >= self._forget else (identity, waiting, last, doubt)

    def deadline(self, state):
        identity, waiting, last, doubt = state
        return min(doubt + self._hold, last + self._forget) if waiting else last + self._forget


class _Shared(StatefulProcessor):
    """The tracks of a bucket, each with a state of the machine; rows are held as those of one track are. What is kept of
    tracks is read and written only when a row or a state of one of them is due."""

    def __init__(self, machine: _InOrder) -> None:
        self._machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getListState("held", f"track array<string>, of array<int>, {self._machine.HELD}")
        self._state = handle.getValueState("state", "earliest long, following long, timer long")
        lists = ", ".join(f"{name} array<{kind}>" for name, kind in (c.split() for c in self._machine.STATE.split(",")))
        self._tracks = handle.getValueState("tracks", f"track array<string>, times array<array<long>>, {lists}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = []
        for pdf in rows:
            if len(pdf):
                of, tracks = pd.factorize(pdf["track"])
                chunk = _chunk(pdf)
                self._held.appendValue((tracks.tolist(), of.tolist(), *chunk))
                earliest.append(min(chunk[0]))
        yield from self._go(timerValues.getCurrentWatermarkInMs(), earliest)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._go(timerValues.getCurrentWatermarkInMs(), [], expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _go(self, now: int, earliest: list[int], expired: int | None = None) -> Iterator[pd.DataFrame]:
        saved = self._state.get()
        first, following, timer = saved or (None, None, None)
        first, out = min([*earliest, *([] if first is None else [first])], default=None), []
        if any(t is not None and t <= now for t in (first, following)):
            due: dict[str, list[tuple]] = {}
            if first is not None and first <= now:
                first, due = self._due(now)
            following = self._taken(due, now, out)
        times = [t for t in (first, following) if t is not None]
        new = (first, following, _timed(self._handle, timer, expired, times, now))
        if times and (saved is None or new != tuple(saved)):
            self._state.update(new)
        elif not times and saved is not None:
            self._state.clear()
        if out:
            yield pd.DataFrame(out, columns=["track", *self._machine.columns[-len(out[0]) + 1 :]])

    def _due(self, now: int) -> tuple[int | None, dict[str, list[tuple]]]:
        """The first time of what stays held, and the rows up to ``now`` of each track in order."""
        due, later = {}, []
        for tracks, of, *chunk in self._held.get():
            for k, *row in zip(of, *chunk, strict=True):
                if row[0] <= now:
                    due.setdefault(tracks[k], []).append(row)
                else:
                    later.append((tracks[k], *row))
        for rows in due.values():
            rows.sort(key=_in_time)
        if later:
            track, *chunk = zip(*later, strict=True)
            of, tracks = pd.factorize(pd.Series(track, dtype=object))
            self._held.put([(tracks.tolist(), of.tolist(), *map(list, chunk))])
        else:
            self._held.clear()
        return min((row[1] for row in later), default=None), due

    def _taken(self, due: dict[str, list[tuple]], now: int, out: list[tuple]) -> int | None:
        """Takes the rows that are due and lets time pass to ``now``; gives when the next state changes without a row."""
        m, saved = self._machine, self._tracks.get()
        kept = {track: (state, list(times)) for track, times, *state in zip(*saved, strict=True)} if saved else {}
        for track in [*due, *(t for t in kept if t not in due)]:
            state, m._times = kept.get(track, (None, []))
            told: list[tuple] = []
            for ms, _, label, score in due.get(track, ()):
                state = m.step(state, ms, label, score, told)
            if state is not None and m.deadline(state) <= now:
                state = m.passed(state, now, told)
            kept[track] = state, m._times
            out += [(track, *x) for x in told]
        left = [(track, times, *state) for track, (state, times) in kept.items() if state is not None]
        if left:
            self._tracks.update(tuple(map(list, zip(*left, strict=True))))
        elif saved:
            self._tracks.clear()
        return min((m.deadline(tuple(x[2:])) for x in left), default=None)


def _machine(rows: DataFrame, keys: list[str], label, score, processor: _InOrder, schema: str, lateness: str, buckets: int | None) -> DataFrame:
    """``schema`` is that of the results beside the keys."""
    _keep_state(rows.sparkSession)
    tie = F.col("tie").cast("long") if "tie" in rows.columns else F.lit(0).cast("long")
    own = rows.select(*keys, "ts", tie.alias("tie"), label.alias("label"), score.alias("score")).withWatermark("ts", lateness)
    kinds = _kinds(rows, keys)
    if buckets is None:
        return own.groupBy(*keys).transformWithStateInPandas(processor, f"{kinds}, {schema}", "append", "eventtime")
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    named = own.withColumn("track", F.to_json(F.struct(*keys), exact)).drop(*keys).withColumn("bucket", F.pmod(F.xxhash64("track"), F.lit(buckets)))
    got = named.groupBy("bucket").transformWithStateInPandas(_Shared(processor), f"track string, {schema}", "append", "eventtime")
    return got.withColumn("track", F.from_json("track", kinds, exact)).select("track.*", *got.columns[1:])


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


_RUN = "label string, first_ms long, last_ms long, avg_similarity double, n long"


def label_runs(labels: DataFrame, keys: list[str], gap_ms: int, lateness: str, buckets: int | None = None) -> DataFrame:
    """(keys, label, first_ms, last_ms, avg_similarity, n): runs of equal labels of each track without a gap of more than
    ``gap_ms``; they end where the label changes, as those of the batch form do. Rows (ts, label, score) of one time of a
    track are taken in order of their ``tie``, where there is such a column."""
    return _machine(labels, keys, F.col("label"), F.col("score").cast("double"), _Runs(keys, gap_ms, True), _RUN, lateness, buckets)


def live_tracks(observations: DataFrame, buffer_ms: int, lateness: str, buckets: int | None = None) -> DataFrame:
    """(track_id, first_ms, last_ms, n) of tracks unseen for more than ``buffer_ms`` of event time; one that is seen again
    is another."""
    none = F.lit(None)
    runs = _machine(observations, ["track_id"], none.cast("string"), none.cast("double"), _Runs(["track_id"], buffer_ms, False), _RUN, lateness, buckets)
    return runs.select("track_id", "first_ms", "last_ms", "n")


def quarantine(samples: DataFrame, hold_ms: int, consecutive: int, lateness: str, forget_ms: int | None = None, buckets: int | None = None) -> DataFrame:
    """(track_id, ts_ms, identity, flushed) of samples whose flag ``doubtful`` tells that they are far from their track.

    Doubtful samples wait: the next sure one takes them along, ``consecutive`` of them in a row are a new identity, and
    those that nothing decides within ``hold_ms`` of event time are given back to the identity they came to. A track
    unseen for ``forget_ms`` (ten times ``hold_ms``, if none is given) is forgotten: its identities begin at 0 again.
    """
    forget = max(hold_ms, 10 * hold_ms if forget_ms is None else forget_ms)
    flag = F.coalesce(F.col("doubtful"), F.lit(False)).cast("int").cast("string")
    return _machine(samples, ["track_id"], flag, F.lit(None).cast("double"), _Quarantine(hold_ms, consecutive, forget), "ts_ms long, identity int, flushed boolean", lateness, buckets)


class Heartbeat(StreamingQueryListener):
    """Calls ``tell`` with the rows and the rate of each trigger."""

    def __init__(self, tell) -> None:
        self._tell = tell

    def onQueryStarted(self, event) -> None:
        self._tell({"started": str(event.id)})

    def onQueryProgress(self, event) -> None:
        self._tell({"rows": event.progress.numInputRows, "rows_per_second": event.progress.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._tell({"ended": str(event.id)})
