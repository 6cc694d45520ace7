"""The stateful processors with a state that counts its calls: a call is a round trip to the state store, so their
number must not grow with the rows of a session's batch."""

from collections import Counter

import pytest
from pyspark.sql import Row

from parlance.streaming import archive as SA
from parlance.streaming import context as SC
from parlance.streaming import session_buffer as SB


class State:
    """A value, list or map state of one session."""

    def __init__(self, calls, empty):
        self.calls, self.empty, self.held = calls, empty, empty()

    def _call(self):
        self.calls["state"] += 1

    def get(self):
        self._call()
        return self.held if self.empty is lambda_none else iter(list(self.held))

    def exists(self):
        self._call()
        return bool(self.held)

    def update(self, value):
        self._call()
        self.held = value

    put = update

    def clear(self):
        self._call()
        self.held = self.empty()

    def iterator(self):
        self._call()
        return iter([((k,), v) for k, v in self.held.items()])

    def containsKey(self, key):
        self._call()
        return key[0] in self.held

    def getValue(self, key):
        self._call()
        return self.held.get(key[0])

    def updateValue(self, key, value):
        self._call()
        self.held[key[0]] = value


def lambda_none():
    return None


class Handle:
    def __init__(self):
        self.calls, self.timers = Counter(), set()

    def getValueState(self, *_):
        return State(self.calls, lambda_none)

    def getListState(self, *_):
        return State(self.calls, list)

    def getMapState(self, *_):
        return State(self.calls, dict)

    def listTimers(self):
        self.calls["timer"] += 1
        return list(self.timers)

    def deleteTimer(self, t):
        self.calls["timer"] += 1
        self.timers.remove(t)

    def registerTimer(self, t):
        self.calls["timer"] += 1
        self.timers.add(t)


def rows(n):
    fields = ["current_goal", "last_tool_used", "user_mood", "extracted_entities"]
    return [Row(session_id=7, msg_id=i, ts=100 + 10 * i + 500 * (i // 40), field=fields[i % 4], value=f"v{i}", increment=i % 3,
                number=i % 3, bad=0, role="user", content=f"c{i}", tokens=None if i % 5 else i, tool_calls=None) for i in range(n)]


MAKE = {"buffer": lambda: SB.SessionBufferProcessor(6, 300, 5), "context": SB.SessionContextProcessor,
        "expiry": lambda: SC.ExpiringContext(300), "archive": lambda: SA.ArchivingBuffer(6, 300, 5)}


def run(name, batches):
    processor, handle, out = MAKE[name](), Handle(), []
    processor.init(handle)
    for batch in batches:
        out.append([tuple(r) for r in processor.handleInputRows((7,), iter(batch), None)])
    return out, handle


def calls(name, n):
    _, handle = run(name, [rows(20), rows(n)[20:]])
    return sum(handle.calls.values())


@pytest.mark.parametrize("name", MAKE)
def test_calls_do_not_grow_with_the_rows(name):
    assert calls(name, 2000) <= calls(name, 200) + 2 <= 30


@pytest.mark.parametrize("name", MAKE)
def test_batches_end_as_one_batch_in_any_order(name):
    whole, one = run(name, [rows(200)[::-1]])
    parts, cut = run(name, [sorted(rows(200), key=lambda r: (r.ts, r.msg_id))[at:at + 30] for at in range(0, 200, 30)])
    if name in ("buffer", "archive"):
        assert whole[0] == [r for part in parts for r in part]
    elif name == "context":
        assert whole[0][-1] == parts[-1][-1]
    else:
        closed = [[r for r in part if r[-1]] for part in parts]
        assert [r for r in whole[0] if r[-1]] == [r for part in closed for r in part] and len(whole[0]) > 2
        assert whole[0][-1] == parts[-1][-1]
    assert one.timers == cut.timers


def test_nulls_of_a_message_stay_nulls():
    out, _ = run("archive", [rows(60)])
    assert {r[5] for r in out[0] if r[0] == 7 and r[7] == "archived"} >= {None, 0, 5}
