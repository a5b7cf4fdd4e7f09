"""Windows of the heuristic tier in keyed state.

Every event is filed under its tenant and shape, in the window of its time. A timer closes a window
once its grace has passed, without any new input, and a second one forgets it once no event can come
for it any more. A late event, or one that changes how windows pair up, sends what it touches again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.correlate import WINDOW, shape_key

#: Seconds that a window stays open after its end, and by which an event may be behind the clock.
GRACE, LATE = 210, 900
#: Ids of a window that are kept, read and written together.
PART = 256
#: kind: "event" (a new one, as it came), "late" (one that came too late), or "closed" (an event of a group whose windows are closed).
OUT = "kind string, tenant_id string, shape string, window_no long, event_id string, event_time long, row string"


def paired(windows: list[int], before: tuple[int, int] | None) -> dict[int, int]:
    """The window that each of some sorted windows goes by: one that follows another joins it, unless that one was joined already.

    `before` is the last forgotten window and what it went by.
    """
    out = {}
    last, last_as = before or (None, None)
    for w in windows:
        last_as = last_as if last is not None and w == last + 1 and last_as == last else w
        out[w], last = last_as, w
    return out


class Windows(StatefulProcessor):
    """State of one tenant and shape. Times are in seconds; the clock is the wall's, or the watermark's in a replay.

    All windows lie in one value, each with how many ids it has, how many were sent, as which window, and the ids of
    its last part; full parts lie apart. One timer is set, for what is due next. So a batch or a timer
    costs a key a few calls from Python, however many windows it has.
    """

    def __init__(self, window: int, grace: int, lateness: int, replay: bool):
        self.window, self.grace, self.lateness, self.replay = window, grace, lateness, replay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # JSON: the windows; the last forgotten one and what it went by; when the timer is set for.
        self.state = handle.getValueState("state", "windows string, before string, timer long")
        self.members = handle.getMapState("members", "w long, part int", "ids string")

    def _now(self, timers) -> int:
        return (timers.getCurrentWatermarkInMs() if self.replay else timers.getCurrentProcessingTimeInMs()) // 1000

    def _closes(self, w: int) -> int:
        return (w + 1) * self.window + self.grace

    def _forgotten(self, w: int) -> int:
        """From then on no event is taken for this window or the next one, which may have to join it."""
        return (w + 2) * self.window + max(self.grace, self.lateness) + 1

    def _get(self) -> tuple[dict[int, list], list | None, int]:
        windows, before, timer = self.state.get() or ("{}", "null", 0)
        return {int(w): x for w, x in json.loads(windows).items()}, json.loads(before), timer

    def _put(self, found: dict[int, list], before: list | None, timer: int, now: int) -> None:
        """Keeps the state, and sets the timer for what is due first: a window closes, changed after it had closed, or is forgotten."""
        if not found:
            self.state.clear()
            return
        due = lambda w, n, sent: self._closes(w) if self._closes(w) > now or n != sent else self._forgotten(w)
        at = max(min(due(w, n, sent) for w, (n, sent, *_) in found.items()), now + 1)
        if timer <= now or at < timer:
            self.handle.registerTimer(1000 * at)
            timer = at
        self.state.update((json.dumps(found), json.dumps(before), timer))

    def _file(self, found: dict[int, list], w: int, new: list[tuple[str, int]]) -> None:
        n, sent, sent_as, own = found.get(w, (0, 0, -1, []))
        known = {i for i, _ in own}
        for item in new:
            if item[0] in known:  # a redelivery; one of an earlier part is dropped when the window is sent
                continue
            if len(own) == PART:
                self.members.updateValue((w, n // PART - 1), (json.dumps(own),))
                own = []
            own.append(item)
            known.add(item[0])
            n += 1
        found[w] = [n, sent, sent_as, own]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self._now(timerValues)
        new: dict[int, list[tuple[str, int]]] = {}
        for row in rows:
            late = row.event_time < now - self.lateness
            yield Row(kind="late" if late else "event", tenant_id=key[0], shape=key[1], window_no=None, event_id=row.event_id, event_time=row.event_time, row=row.row)
            if not late:
                new.setdefault(row.event_time // self.window, []).append((row.event_id, row.event_time))
        if not new:
            return
        found, before, timer = self._get()
        for w, own in new.items():
            self._file(found, w, own)
        self._put(found, before, timer, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(self._now(timerValues), expiredTimerInfo.getExpiryTimeInMs() // 1000)
        found, before, timer = self._get()
        went_by = paired(sorted(found), before)
        groups: dict[int, list[int]] = {}
        for w, as_ in went_by.items():
            groups.setdefault(as_, []).append(w)
        for as_, own in groups.items():
            new = any(found[w][0] != found[w][1] or found[w][2] != as_ for w in own)
            if not new or any(self._closes(w) > now for w in own):
                continue
            members = {}
            for w in own:
                n, _, _, last = found[w]
                for part in range((n - 1) // PART):
                    members.update(json.loads(self.members.getValue((w, part))[0]))
                members.update(last)
                found[w] = [n, n, as_, last]
            for event_id, event_time in members.items():
                yield Row(kind="closed", tenant_id=key[0], shape=key[1], window_no=as_, event_id=event_id, event_time=event_time, row=None)
        gone = [w for w in sorted(found) if self._forgotten(w) <= now]
        for w in gone:
            for part in range((found.pop(w)[0] - 1) // PART):
                self.members.removeKey((w, part))
        if gone:
            before = [gone[-1], went_by[gone[-1]]]
        self._put(found, before, timer, now)

    def close(self) -> None:
        pass


def closing(events: DataFrame, window: int = WINDOW, grace: int = GRACE, lateness: int = LATE, replay: bool = False) -> DataFrame:
    """A stream's events as they come, and those of every group whose windows have closed (see OUT).

    Events without a shape stand alone under their id. In a replay the clock follows received_at, of which
    the stream has to be in order but for one second; else it is the wall's and timers need no input.
    """
    row = F.to_json(F.struct(*events.columns))
    keyed = events.select("tenant_id", F.coalesce(shape_key(), F.concat(F.lit("solo|"), "event_id")).alias("shape"), "event_id", "event_time", row.alias("row"), F.timestamp_seconds("received_at").alias("received"))
    if replay:
        keyed = keyed.withWatermark("received", "1 second")
    return keyed.groupBy("tenant_id", "shape").transformWithState(
        Windows(window, grace, lateness, replay), outputStructType=OUT, outputMode="Append", timeMode="EventTime" if replay else "ProcessingTime"
    )
