"""What a key costs: rows instead of frames, and few calls to the state store."""

from pyspark.sql import Row

from quantloom.streaming import stateful


class Store:
    """A handle and value state that count their calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def _called(self):
        self.calls += 1

    def exists(self):
        self._called()
        return self.value is not None

    def get(self):
        self._called()
        return self.value

    def update(self, value):
        self._called()
        self.value = value

    def registerTimer(self, at):
        self._called()
        self.timers.add(at)

    def deleteTimer(self, at):
        self._called()
        self.timers.remove(at)


def rows(*xs):
    return iter([Row(at=at, id=i, value=v, action=a) for at, i, v, a in xs])


def test_a_snapshot_key_takes_few_calls():
    store, p = Store(), stateful.Snapshot(5_000_000)
    p.init(store)
    p.handleInitialState((7,), Row(key=7, at=1_000_000, id=1, value=0.5), None)
    assert store.calls == 2 and store.timers == {6001}
    got = list(p.handleInputRows((7,), rows((3_000_000, 4, 2.0, ""), (3_000_000, 5, 3.0, ""), (2_000_000, 9, 1.0, "")), None))
    assert got == [Row(key=7, at=3_000_000, id=5, value=3.0, source="quote", kind="quote")]
    assert store.calls == 2 + 4 and store.timers == {8001}
    assert list(p.handleInputRows((7,), rows((2_999_999, 8, 1.0, "")), None)) == [] and store.value[1] == 5
    assert list(p.handleInputRows((7,), rows(), None)) == [] and store.calls == 7
    assert [r.kind for r in p.handleExpiredTimer((7,), None, None)] == ["stale"] and store.calls == 8


def test_a_queue_key_takes_few_calls():
    store, p = Store(), stateful.Queue(1_000_000)
    p.init(store)
    got = list(p.handleInputRows((7,), rows((5_000_000, 2, 0.0, "take"), (1_000_000, 1, 0.0, "take")), None))
    assert got == [Row(task=7, at=2_000_000, tries=1, started=1_000_000)] and store.calls == 3 and store.timers == {6001}
    assert list(p.handleInputRows((7,), rows((5_500_000, 3, 0.0, "ack")), None)) == []
    assert store.calls == 6 and store.timers == set() and tuple(store.value) == (-1, 0)
