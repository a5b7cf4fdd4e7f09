"""Windows in keyed state, without a stream: what a key costs, and which groups it sends."""

from __future__ import annotations

import random
from types import SimpleNamespace

from crosslight.streaming.windows import PART, Windows, paired

KEY = ("t", "t2|t|198.51.100.7|shop.test|/a|GET")


class Handle:
    """State of one key in dictionaries, which counts the calls to it."""

    def __init__(self):
        self.calls, self.timers, self.value, self.map = 0, set(), None, {}

    def _counted(self, f):
        def run(*args):
            self.calls += 1
            return f(*args)

        return run

    def getValueState(self, *_):
        put = lambda x: setattr(self, "value", x)
        return SimpleNamespace(exists=self._counted(lambda: self.value is not None), get=self._counted(lambda: self.value), update=self._counted(put), clear=self._counted(lambda: put(None)))

    def getMapState(self, name, *_):
        own = self.map.setdefault(name, {})
        return SimpleNamespace(
            getValue=self._counted(own.get), updateValue=self._counted(own.__setitem__), removeKey=self._counted(own.pop), containsKey=self._counted(own.__contains__), iterator=self._counted(lambda: iter(list(own.items())))
        )

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms // 1000)


def made(replay=False):
    handle, windows = Handle(), Windows(5, 210, 900, replay)
    windows.init(handle)
    return handle, windows


def clock(now):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: 1000 * now, getCurrentProcessingTimeInMs=lambda: 1000 * now)


def file(windows, now, *events):
    rows = [SimpleNamespace(event_id=i, event_time=at, row="{}") for i, at in events]
    return [r.kind for r in windows.handleInputRows(KEY, iter(rows), clock(now))]


def ring(handle, windows, now):
    """Everything that the timers up to `now` send: the window and ids of each group."""
    out = []
    while due := [x for x in handle.timers if x <= now]:
        at = min(due)
        handle.timers.discard(at)
        sent: dict = {}
        for row in windows.handleExpiredTimer(KEY, clock(at), SimpleNamespace(getExpiryTimeInMs=lambda at=at: 1000 * at)):
            sent.setdefault(row.window_no, set()).add(row.event_id)
        out += sorted(sent.items())
    return out


def test_many_windows_cost_a_key_a_few_calls():
    handle, windows = made(replay=True)
    at = 1_700_000_000
    file(windows, 0, *((f"e{k}", at + 20 * k) for k in range(300)))
    assert handle.calls <= 5 and len(handle.timers) == 1
    handle.calls = 0
    end = at + 100_000
    handle.timers.clear()
    sent = list(windows.handleExpiredTimer(KEY, clock(end), SimpleNamespace(getExpiryTimeInMs=lambda: 1000 * end)))
    assert {r.event_id for r in sent} == {f"e{k}" for k in range(300)} and len(sent) == 300
    assert handle.calls <= 5 and handle.value is None and not handle.timers


def test_a_large_window_lies_in_parts_and_is_sent_whole():
    handle, windows = made()
    at = 1_700_000_000
    ids = [f"e{k}" for k in range(2 * PART + 3)]
    for k in range(0, len(ids), 100):
        file(windows, at, *((i, at) for i in ids[k : k + 100]), (ids[k], at))
    ((_, found),) = ring(handle, windows, at + 5_000)
    assert found == set(ids)
    assert handle.value is None and not any(handle.map.values()) and not handle.timers


def test_groups_are_those_of_all_windows_however_events_come():
    """Events in any order within their lateness: what is sent last of each event is the group that all windows give."""
    dice = random.Random(7)
    for _ in range(60):
        handle, windows = made()
        base = 1_700_000_000 - 1_700_000_000 % 5
        events = {f"e{k}": base + dice.randrange(400) for k in range(dice.randrange(1, 60))}
        came = sorted(events, key=lambda i: events[i] + dice.choice((0, 5, 300, 880)))
        last: dict = {}
        now = base
        for i in came:
            now = max(now, events[i] + dice.choice((0, 5, 300, 880)))
            for w, ids in ring(handle, windows, now):
                last |= {x: w for x in ids}
            if file(windows, now, (i, events[i])) == ["late"]:
                del events[i]
        for w, ids in ring(handle, windows, now + 10_000):
            last |= {x: w for x in ids}
        went_by = paired(sorted({t // 5 for t in events.values()}), None)
        assert last == {i: went_by[t // 5] for i, t in events.items()}
        assert handle.value is None and not handle.timers


def test_a_window_that_only_exact_events_fill_pairs_with_none(spark, tmp_path):
    """The first of three windows holds requests of the exact tier alone, so the second pairs with the third, as in the batch."""
    from crosslight.operators import correlate
    from crosslight.streaming import pipeline

    from .test_correlate import SCHEMA, event

    at = 1_700_000_000
    rows = [event("a", "cloudflare", at, "r1"), event("b", "f5", at, "r1"), event("c", "cloudflare", at + 5, "r2"), event("d", "f5", at + 10, "r3"), event("e", "f5", at + 15, "r4"), event("z", "f5", at + 3_000, "r5", path="/z")]
    events = spark.createDataFrame(rows, SCHEMA)
    ids = lambda found: sorted((r.correlation_id, tuple(sorted(r.event_ids))) for r in found.collect())
    got = ids(pipeline.replayed(events, str(tmp_path), 2))
    assert got == ids(correlate.records(events)) and ("c", "d") in {x for _, x in got}
