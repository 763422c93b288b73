"""Keyed state in few messages: what the processors keep, against states held in dictionaries."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import Row

from paywarden.functions.constants import DAY, HOUR
from paywarden.streaming import counters, devices


class State(dict):
    """A value, map or any other state of one key; counts what is asked of it."""

    def __init__(self, calls):
        super().__init__()
        self.calls = calls

    def _called(self, name):
        self.calls[name] += 1

    def exists(self):
        self._called("read")
        return bool(self)

    def get(self):
        self._called("read")
        return dict.get(self, "value")

    def update(self, value):
        self._called("write")
        self["value"] = value

    def containsKey(self, key):
        self._called("read")
        return key in self

    def getValue(self, key):
        self._called("read")
        return dict.get(self, key)

    def updateValue(self, key, value):
        self._called("write")
        self[key] = value

    def removeKey(self, key):
        self._called("write")
        del self[key]

    def iterator(self):
        self._called("read")
        return iter(list(self.items()))

    def clear(self):
        self._called("write")
        super().clear()


class Handle:
    def __init__(self):
        self.calls, self.states = Counter(), {}

    def _made(self, name, *_):
        return self.states.setdefault(name, State(self.calls))

    getValueState = getMapState = _made


def _started(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle


@pytest.mark.parametrize("together", [3, 1000])
def test_known_devices_in_one_record(monkeypatch, together):
    """Flags are those of a plain walk, whether devices lie in the record or beyond it; a batch reads and writes the record once."""
    monkeypatch.setattr(devices, "TOGETHER", together, raising=False)
    rng = random.Random(1)
    rows = sorted((rng.randrange(200) * DAY // 2, i, rng.choice(["a", "b", "c", "d", "e", "f", "g", None])) for i in range(400))
    known, until, want = set(), 0, {}
    for us, i, d in rows:
        if us >= until:
            known = set()
        want[i] = int(d is not None and d not in known)
        if want[i]:
            known.add(d)
            until = us + 5 * DAY
    p, handle = _started(devices.KnownDevices(5 * DAY))
    got = {}
    for k in range(0, 400, 40):
        handle.calls.clear()
        batch = [Row(txn_id=i, user_id=1, device=d, us=us) for us, i, d in rows[k:k + 40]]
        rng.shuffle(batch)
        for r in p.handleInputRows((1,), iter(batch), None):
            got |= dict(zip(r["txn_id"], r["new_device_flag"], strict=True))
        assert together == 3 or handle.calls.total() <= 2
    assert got == want and 0 < sum(want.values()) < 399


@pytest.mark.parametrize("kind", ["u", "m"])
def test_counters_in_parts(monkeypatch, kind):
    """Many micro-batches with parts of a few rows count what one micro-batch counts; few parts are touched, and old ones go."""
    rng = random.Random(2)
    rows = sorted((t * HOUR // 4, i) for i, t in enumerate(rng.sample(range(70 * 24 * 4), 1500)))  # an instant lies in one micro-batch
    made = [Row(**dict.fromkeys(counters._TXN) | {"txn_id": i, "user_id": i * 7 % 41 if i % 9 else None, "merchant_id": 5, "us": us, "cents": i * 31 % 90_000, "device": f"d{i % 23}" if i % 5 else None, "ip": f"i{i * us % 59}", "lat": float("nan") if i % 3 else 1.5, "lng": 2.0}) for us, i in rows]

    def run(size):
        p, handle = _started(counters.Counters())
        out, most = [], 0
        for k in range(0, len(made), size):
            handle.calls.clear()
            for r in p.handleInputRows((kind, 5), iter(made[k:k + size][::-1]), None):
                out += zip(*(r[c] for c in counters._TXN + counters._NAMES), strict=True)
            most = max(most, handle.calls.total())
        return out, most, handle.states

    want, _, _ = run(len(made))
    got, most, _ = run(50)
    assert got == want and most <= 6 + 4  # the record is asked for and read, then written; parts of hours, parts of members
    monkeypatch.setattr(counters, "PART_ROWS", 7)
    monkeypatch.setattr(counters, "PART_MEMBERS", 5)
    got, _, states = run(50)
    assert got == want
    if kind == "u":
        assert len(states["hours"]) > 50
        last, held = made[-1]["us"], [h for hours, *_ in states["hours"].values() for h in hours]
        assert len(held) == len(set(held)) and min(max(hours) for hours, *_ in states["hours"].values()) + HOUR > last - 30 * DAY
    members = [(k, m) for kinds, names, _ in states["members"].values() for k, m in zip(kinds, names, strict=True)]
    assert len(members) == len(set(members)) and all(0 < len(kinds) <= 5 for kinds, _, _ in states["members"].values())


@pytest.mark.parametrize("kind", ["u", "m"])
def test_counters_ask_for_what_they_know(monkeypatch, kind):
    """A key of few rows: one read in its first micro-batch, one more for hours and members each later; no map is gone through."""
    def gone_through(_):
        raise AssertionError("a map is gone through")

    monkeypatch.setattr(State, "iterator", gone_through)
    p, handle = _started(counters.Counters())
    reads = []
    for k in range(3):
        handle.calls.clear()
        rows = [Row(**dict.fromkeys(counters._TXN) | {"txn_id": 10 * k + i, "user_id": i, "merchant_id": 5, "us": (3 * k + i) * HOUR // 2, "cents": 100, "device": f"d{i}", "ip": "i"}) for i in range(3)]
        out = [r for r in p.handleInputRows((kind, 5), iter(rows), None)]
        assert [x for r in out for x in r["txn_id"]] == [10 * k + i for i in range(3)]
        assert [x for r in out for x in r["past_n"]] == [(3 * k + i) // 2 * 2 for i in range(3)]
        reads.append(handle.calls["read"])
    assert reads == ([1, 3, 3] if kind == "u" else [1, 2, 2])


@pytest.mark.parametrize("kind", ["u", "m"])
@pytest.mark.parametrize("few", [0, 4])
def test_keys_of_a_bucket(monkeypatch, kind, few):
    """Keys that share a bucket count what each counts alone, in few messages, also where parts are entries of their own."""
    monkeypatch.setattr(counters, "FEW_PARTS", few)
    monkeypatch.setattr(counters, "PART_ROWS", 7)
    monkeypatch.setattr(counters, "PART_MEMBERS", 5)
    monkeypatch.setattr(counters, "PACKED", 9)
    rng = random.Random(3)
    keys, at = [4, None, 9], {k: n for n, k in enumerate(counters._TXN)}
    rows = [(i, i * 7 % 41 if i % 9 else None, 5, us * HOUR // 4, i * 31 % 90_000, float("nan") if i % 4 else 2.5, f"d{i % 23}" if i % 5 else None, f"i{i % 59}", "KE", None, float("nan") if i % 3 else 1.5, 2.0, keys[i % 3])
            for i, us in enumerate(sorted(rng.sample(range(70 * 24 * 4), 900)))]
    names = [*counters._TXN, "key"]
    want = {}
    for key in keys:
        p, _ = _started(counters.Counters())
        for k in range(0, 900, 90):
            batch = [Row(**dict(zip(counters._TXN, r, strict=False))) for r in rows[k:k + 90] if r[-1] == key]
            for r in p.handleInputRows((kind, key), iter(batch), None):
                want |= {x[0]: x for x in zip(*(r[c] for c in counters._TXN + counters._NAMES), strict=True)}
    p, handle = _started(counters.BucketCounters())
    got, most = {}, 0
    for k in range(0, 900, 90):
        handle.calls.clear()
        batch = rows[k:k + 90]
        rng.shuffle(batch)
        table = pa.table({c: pa.array([None if x != x else x for x in (r[n] for r in batch)]) for n, c in enumerate(names)} | {"kind": [kind] * 90, "bucket": [3] * 90})
        table = table.set_column(at["currency"], "currency", pa.nulls(90, pa.string()))
        blocks = [Row(**x) for b in counters._dealt(iter(table.to_batches(max_chunksize=40))) for x in b.to_pylist()]
        done = [r.asDict() for r in p.handleInputRows((kind, 3), iter(blocks), None)]
        assert len(blocks) == len(done) == 10
        for b in counters._flattened(iter([pa.RecordBatch.from_pylist(done)])):
            got |= {x["txn_id"]: (x["key"], *(x[c] for c in counters._TXN + counters._NAMES)) for x in b.to_pylist()}
        most = max(most, handle.calls.total())
    assert {i: x[1:] for i, x in got.items()} == want and {i: x[0] for i, x in got.items()} == {r[0]: r[-1] for r in rows}
    assert most > 2 if few == 0 else most <= 2 or handle.states["entries"]


def test_a_bucket_of_small_keys_is_one_record():
    """A hundred keys cost one read and one write in a micro-batch."""
    p, handle = _started(counters.BucketCounters())
    for k in range(2):
        handle.calls.clear()
        rows = [(100 * k + i, i, 5, (3 * k + 1) * HOUR, 100, 1.0, f"d{i % 3}", "i", "KE", "KES", None, None, i) for i in range(100)]
        blocks = [Row(kind="u", bucket=1, rows=counters._packed(rows))]
        out = [r for r in p.handleInputRows(("u", 1), iter(blocks), None)]
        assert len(out) == 1 and handle.calls == {"read": 1, "write": 1}
