"""Each look at the state is a call from Python to Spark: how many a key needs."""

from types import SimpleNamespace

from millrace.streaming import timers


class Handle:
    def __init__(self):
        self.calls, self.value = [], None

    def getValueState(self, *_):  # noqa: N802
        def update(v):
            self.calls.append("update")
            self.value = v

        return SimpleNamespace(exists=lambda: self.calls.append("exists") or self.value is not None, get=lambda: self.calls.append("get") or self.value, update=update)

    def getMapState(self, *_):  # noqa: N802
        self.calls.append("map")
        return SimpleNamespace(iterator=lambda: iter(()), clear=lambda: self.calls.append("clear"))

    def registerTimer(self, _):  # noqa: N802
        self.calls.append("timer")

    def deleteTimer(self, _):  # noqa: N802
        self.calls.append("no timer")


def test_sessions_need_no_map():
    handle, sessions = Handle(), timers.Evicted(1_800_000, 300_000)
    sessions.init(handle)
    rows = lambda *ts: [SimpleNamespace(t=t, seq=t) for t in ts]
    assert list(sessions.handleInputRows((1,), rows(5, 9), None)) == []
    assert handle.calls == ["get", "timer", "update"] and handle.value == (5, 2_100_000, 2)
    handle.calls.clear()
    assert [r.requests for r in sessions.handleInputRows((1,), rows(2_100_001), None)] == [2]
    assert handle.calls == ["get", "no timer", "timer", "update"]
