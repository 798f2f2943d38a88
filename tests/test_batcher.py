"""The batcher of keys, with a stand-in for Spark's state."""

import pandas as pd

from walkgraph.streaming.pipeline import KeyBatcher


class State:
    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def get(self):
        return iter(list(self.rows))

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class Clock:
    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_full_batches_go_at_once_and_the_rest_when_the_timer_expires():
    state, batcher = State(), KeyBatcher(size=3, interval=60)
    batcher.init(state)
    give = lambda *keys: [f["keys"][0] for f in batcher.handleInputRows((0,), iter([pd.DataFrame({"pubkey": list(keys)})]), Clock())]
    assert give("a", "b") == [] and state.timers == [61000]
    assert give("c") == [["a", "b", "c"]] and state.rows == []
    assert give("d", "e", "f", "g") == [["d", "e", "f"]] and state.rows == [("g",)]
    assert [f["keys"][0] for f in batcher.handleExpiredTimer((0,), Clock(), None)] == [["g"]] and state.rows == []
    assert list(batcher.handleExpiredTimer((0,), Clock(), None)) == []
