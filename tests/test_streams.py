"""Keyed state of streams without a stream: what a call of the worker reads, writes and asks to be woken for."""

from types import SimpleNamespace

import numpy as np
import pandas as pd

from tidewright.streaming import state


class Kept(dict):
    """A state variable that counts calls."""

    calls = 0

    def told(self, x):
        Kept.calls += 1
        return x

    exists = lambda self: self.told(bool(self))
    getValue = lambda self, k: self.told(dict.get(self, k))
    updateValue = lambda self, k, v: self.told(self.__setitem__(k, v))
    removeKey = lambda self, k: self.told(self.pop(k))
    iterator = lambda self: iter(list(self.told(self.items())))
    get = lambda self: self.told(dict.get(self, 0))
    update = lambda self, v: self.told(self.__setitem__(0, v))

    def keys(self):
        return iter(list(dict.keys(self)))


class Handle:
    def __init__(self):
        self.timers, Kept.calls = [], 0

    getMapState = lambda self, *_: Kept()
    getValueState = lambda self, *_: Kept()

    def registerTimer(self, at):
        self.timers.append(at)
        Kept.calls += 1


def ran(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle


def clock(sec):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: sec * 1000)


def test_a_shard_takes_all_parked_tasks_at_one_timer():
    p, handle = ran(state._Unpark())
    n = 5_000
    told = pd.DataFrame({"report": False, "id": np.arange(n), "every": 100, "ok": False, "sec": np.arange(n)})
    bad = pd.DataFrame({"report": True, "id": 0, "every": 0, "ok": [False, True], "sec": [200, 1_000]})
    assert not list(p.handleInputRows(("c", 0), iter([told, bad]), None))
    assert handle.timers == [100_999]
    out = pd.concat(p.handleExpiredTimer(("c", 0), clock(20_000), None))
    assert len(out) == n and Kept.calls < 60
    due = out.set_index("id")["due"]
    # The first clock that a good report has come before, or none: those that ask from 200 until 999 wait on.
    assert due[0] == 100 and due[99] == 199 and due[100] == 1_000 and due[150] == 1_050 and due[900] == 1_000 and due[4_999] == 5_099


def test_a_task_that_is_parked_anew_leaves_by_its_new_clock():
    p, handle = ran(state._Unpark())
    for sec in (0, 9_000):
        list(p.handleInputRows(("c", 0), iter([pd.DataFrame({"report": [False], "id": [7], "every": [100], "ok": [False], "sec": [sec]})]), None))
    assert not [x for x in p.handleExpiredTimer(("c", 0), clock(5_000), None) if len(x)]
    assert pd.concat(p.handleExpiredTimer(("c", 0), clock(9_101), None))["due"].tolist() == [9_100]
    assert not [x for x in p.handleExpiredTimer(("c", 0), clock(50_000), None) if len(x)]


def test_a_block_of_groups_is_one_read_and_one_write():
    p, _ = ran(state._Barrier())
    rows = lambda of, task, s: pd.DataFrame({"group_id": of, "task_id": task, "state": s, "expect": 2})
    ids = np.arange(512)
    assert not list(p.handleInputRows((0,), iter([rows(ids, 1, "done")]), None))
    out = pd.concat(p.handleInputRows((0,), iter([rows(ids[:500], 2, "failed"), rows(ids[500:], 1, "failed")]), None))
    assert out["group_id"].tolist() == list(range(500)) and set(map(tuple, out.drop(columns="group_id").to_numpy().tolist())) == {(2, 1, 1, 0)}
    assert Kept.calls < 12
    late = list(p.handleInputRows((0,), iter([rows(ids, 3, "odd"), rows(ids, 4, None)]), None))
    assert pd.concat(late).to_numpy().tolist() == [[i, 2, 0, 1, 0] for i in range(500, 512)]
