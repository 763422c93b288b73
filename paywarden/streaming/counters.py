"""What a user or merchant did before each transaction, kept as keyed state of a stream.

Per key the state holds: one record of running totals (with the counters that expire after a pause, the hours gone by, the
last known place), the transactions of every hour, and the last use of every device, ip or customer; the latter two in parts
of many, because every access to the state is a message to the JVM. A trailing window is a difference of running totals, so a transaction reads the hours in which its windows begin, not
its history. Hours and members that no window reaches any more are removed. A micro-batch reads itself and the state of the
keys it holds.

Spark hands each value of a stateful row to Python, and takes each value of a result, by itself, and every key costs several
messages; both take far longer than the counting. On a stream keys are therefore dealt to ``BUCKETS`` buckets, whose keys lie
in one record, and the rows of a bucket are put together first (``mapInArrow`` behind a shuffle by bucket): one row with one
binary value for many transactions goes into the state's processor and one comes out, and is taken apart again.

Transactions of a key come in order of time over the batches; inside a batch they are put in order. Of one instant, windows
see no row, counters see those of smaller id.
"""

from __future__ import annotations

import pickle
import struct
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.constants import DAY, HOUR

TXN = "txn_id long, user_id long, merchant_id long, us long, cents long, amount double, device string, ip string, country string, currency string, lat double, lng double"
COUNTED = ("n_1h long, n_24h long, n_7d long, cents_7d long, n_30d long, cents_30d long, squares_30d string, device_count_30d long, ip_count_30d long, new_device_flag int, "
           "count_1h long, sum_1h long, count_24h long, sum_24h long, unique_customers_24h long, historical_structuring_flag int, past_n long, past_hours long, last_us long, last_lat double, last_lng double")
_TXN, _NAMES = ([c.split()[0] for c in x.split(", ")] for x in (TXN, COUNTED))
_US, _READ = _TXN.index("us"), itemgetter(*[_TXN.index(c) for c in ("us", "cents", "device", "ip", "user_id", "lat", "lng")])
_AMOUNT, _LAT, _LNG = (_TXN.index(c) for c in ("amount", "lat", "lng"))
#: Rows that go back to Spark together, as one row of arrays: most keys have few rows in a micro-batch, and each row sent costs.
BLOCK = 10_000
#: Keys of a kind are dealt to so many buckets: a record holds few keys, and the messages stop growing with the keys.
BUCKETS = 4_096
#: Rows of a task that are dealt to their buckets at once, and rows of one binary value.
CHUNK, PACKED = 500_000, 1_000
#: Parts of hours, and of members, that a key may keep in its bucket's record.
FEW_PARTS = 4
LONGEST = 30 * DAY
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
_FLAT = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in f"kind string, {TXN}, key long, {COUNTED}".split(", "))])


#: Rows after which a part of hours is full, and members of a part of members: what a key of few rows keeps is one part of each.
PART_ROWS, PART_MEMBERS = 1_000, 1_000


class _Hours:
    """Running totals (rows, cents, squares) at any time, from the hours that are asked for. Hours lie together in parts, each
    named by its first hour; a part is read when one of its hours is, and takes no more hours once it has ``PART_ROWS`` rows."""

    def __init__(self, stored, known: list[int], parts: list[int], part_n: int, totals: tuple[int, int, int]):
        self.stored, self.known, self.parts, self.part_n, self.totals = stored, known, dict(zip(known, parts, strict=True)), part_n, totals
        self.saved, self.packed, self.read, self.changed = set(parts), {}, {}, set()

    def _load(self, part: int) -> None:
        for at, *packed in zip(*self.stored.getValue((part,)), strict=True):
            self.packed[at] = packed

    def hour(self, at: int) -> list:
        if at not in self.read:
            if at not in self.packed:
                self._load(self.parts[at])
            n, cents, squares, times, values = self.packed[at]
            times, values = (list(struct.unpack(f"<{len(x) // 8}q", x)) for x in (times, values))
            self.read[at] = [(n, cents, int(squares)), times, [0, *accumulate(values)], [0, *accumulate(v * v for v in values)], values]
        return self.read[at]

    def before(self, at: int) -> tuple[int, int, int]:
        """Totals of all rows earlier than ``at``."""
        start = at - at % HOUR
        i = bisect_left(self.known, start)
        if i == len(self.known):
            return self.totals
        base, times, cents, squares, _ = self.hour(self.known[i])
        k = bisect_left(times, at) if self.known[i] == start else 0
        return base[0] + k, base[1] + cents[k], base[2] + squares[k]

    def add(self, us: int, cents: int) -> None:
        at = us - us % HOUR
        if not self.known or self.known[-1] != at:
            if not self.known or self.totals[0] - self.part_n >= PART_ROWS:
                self.parts[at], self.part_n = at, self.totals[0]
            else:
                self.parts[at] = self.parts[self.known[-1]]
            self.known.append(at)
            self.read[at] = [self.totals, [], [0], [0], []]
        h = self.hour(at)
        h[1].append(us)
        h[2].append(h[2][-1] + cents)
        h[3].append(h[3][-1] + cents * cents)
        h[4].append(cents)
        self.totals = self.totals[0] + 1, self.totals[1] + cents, self.totals[2] + cents * cents
        self.changed.add(at)

    def store(self, now: int) -> None:
        gone = 0
        while gone < len(self.known) and self.known[gone] + HOUR <= now - LONGEST:
            del self.parts[self.known[gone]]
            gone += 1
        del self.known[:gone]
        changed: dict[int, list] = {self.parts[at]: [] for at in self.changed if at in self.parts}
        for at in self.known:
            part = self.parts[at]
            if part in changed:
                if at in self.changed:
                    base, times, _, _, values = self.read[at]
                    row = base[0], base[1], str(base[2]), struct.pack(f"<{len(times)}q", *times), struct.pack(f"<{len(values)}q", *values)
                else:
                    if at not in self.packed:
                        self._load(part)
                    row = self.packed[at]
                changed[part].append((at, *row))
        for part, rows in changed.items():
            self.stored.updateValue((part,), tuple(map(list, zip(*rows, strict=True))))
        for part in self.saved - set(self.parts.values()):
            self.stored.removeKey((part,))


class _Members:
    """Members used within ``width``, and when each was used last."""

    def __init__(self, found: dict[str, int], width: int):
        self.width, self.last, self.changed = width, found, set()
        self.queue = deque(sorted((us, m) for m, us in self.last.items()))
        self.present = set(self.last)

    def count(self, now: int) -> int:
        while self.queue and self.queue[0][0] < now - self.width:
            us, m = self.queue.popleft()
            if self.last[m] == us:
                self.present.discard(m)
        return len(self.present)

    def use(self, member: str | None, us: int) -> bool:
        """Notes a use; True if the member was not used within ``width`` before."""
        if member is None:
            return False
        before = self.last.get(member)
        self.last[member] = us
        self.changed.add(member)
        return before is None or us - before >= self.width

    def arrive(self, members, us: int) -> None:
        for m in members:
            if m is not None:
                self.present.add(m)
                self.queue.append((us, m))


class _Uses:
    """The members of a key, of every kind, in parts of ``PART_MEMBERS``; parts are written as a whole, those that changed."""

    def __init__(self, stored, widths: dict[str, int], parts: list[int]):
        self.stored, self.place, self.sizes, found = stored, {}, {}, {k: {} for k in widths}
        for part in parts:  # asked for by name: going through a map costs many times as much
            kinds, members, last = stored.getValue((part,))
            self.sizes[part] = len(kinds)
            for k, m, us in zip(kinds, members, last, strict=True):
                found[k][m] = us
                self.place[k, m] = part
        self.saved = set(self.sizes)
        self.kinds = {k: _Members(found[k], w) for k, w in widths.items()}

    def store(self, now: int) -> list[int]:
        """Writes what changed; the parts that are there now."""
        touched = set()
        for k, members in self.kinds.items():
            for m in [m for m, us in members.last.items() if us < now - members.width]:
                del members.last[m]
                members.changed.discard(m)
                if (k, m) in self.place:
                    part = self.place.pop((k, m))
                    self.sizes[part] -= 1
                    touched.add(part)
        free = [p for p, n in self.sizes.items() if n < PART_MEMBERS]
        for k, members in self.kinds.items():
            for m in members.changed:
                part = self.place.get((k, m))
                if part is None:
                    while free and self.sizes[free[-1]] >= PART_MEMBERS:
                        free.pop()
                    if not free:
                        free.append(max(self.sizes, default=-1) + 1)
                        self.sizes[free[-1]] = 0
                    part = self.place[k, m] = free[-1]
                    self.sizes[part] += 1
                touched.add(part)
        rows: dict[int, list] = {p: [] for p in touched}
        for (k, m), part in self.place.items():
            if part in rows:
                rows[part].append((k, m, self.kinds[k].last[m]))
        for part, held in rows.items():
            if held:
                self.stored.updateValue((part,), tuple(map(list, zip(*held, strict=True))))
            elif part in self.saved:
                self.stored.removeKey((part,))
        return sorted(p for p, n in self.sizes.items() if n)


def _taken(rows: Iterator[Row]) -> Iterator[tuple]:
    """The columns of ``TXN`` of each row; where they stand is looked up once, not by name for every value."""
    pick = None
    for r in rows:
        if pick is None:
            pick = itemgetter(*[r.__fields__.index(c) for c in _TXN])
        yield pick(tuple(r))


def _ordered(rows: Iterator[tuple]) -> list[tuple]:
    """Rows of ``TXN`` by time and id (those without id last); what is not a number is no value."""
    clean = [r if r[_AMOUNT] == r[_AMOUNT] and r[_LAT] == r[_LAT] and r[_LNG] == r[_LNG] else tuple(None if x != x else x for x in r) for r in rows]
    return sorted(clean, key=lambda r: (r[_US], r[0] is None, r[0] or 0))


class Counters(StatefulProcessor):
    """Features of every transaction of a key (``kind`` u: a user, m: a merchant) from the key's earlier ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "n long, cents long, squares string, hours array<long>, parts array<long>, part_n long, moved long, c1 long, v1 long, c24 long, v24 long, hist int, past_n long, past_hours long, hour long, hour_n long, last_us long, lat double, lng double, latest long, member_parts array<long>")
        self.hours = handle.getMapState("hours", "part long", "hours array<long>, n array<long>, cents array<long>, squares array<string>, times array<binary>, values array<binary>")
        self.members = handle.getMapState("members", "part long", "kinds array<string>, members array<string>, last array<long>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = _ordered(_taken(rows))  # a key's rows of one micro-batch
        out = self._counted(key[0], rows)
        for i in range(0, len(rows), BLOCK):
            columns = [*zip(*rows[i:i + BLOCK], strict=True), *zip(*out[i:i + BLOCK], strict=True)]
            yield Row(kind=key[0], key=key[1], **dict(zip(_TXN + _NAMES, map(list, columns), strict=True)))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """Transactions from before the stream, all of a key's in one row."""
        self._counted(key[0], _ordered(tuple(r[c] for c in _TXN) for r in initialState["past"]))

    def _counted(self, kind: str, txn: list[tuple]) -> list[tuple]:
        user = kind == "u"
        stored = self.now.get()
        if stored is not None:
            n, cents, squares, known, parts, part_n, moved, c1, v1, c24, v24, hist, past_n, past_hours, hour, hour_n, last_us, lat, lng, latest, held = stored
            totals, known, parts = (n, cents, int(squares)), list(known), list(parts)
        else:
            held = []
            totals, known, parts, part_n, moved, latest, hour, last_us, lat, lng = (0, 0, 0), [], [], 0, None, None, None, None, None, None
            c1 = v1 = c24 = v24 = hist = past_n = past_hours = hour_n = 0
        hours = _Hours(self.hours, known, parts, part_n, totals)
        uses = _Uses(self.members, {"d": LONGEST, "i": LONGEST} if user else {"c": DAY}, held)
        kinds = uses.kinds
        rows = list(map(_READ, txn))
        devices, ips, customers = (kinds.get(k) for k in "dic")
        out, i, w, held_d, held_i, held_c = [], 0, (None,) * 7, None, None, None
        while i < len(rows):
            t = int(rows[i][0])
            j = i + 1
            while j < len(rows) and rows[j][0] == t:
                j += 1
            here = rows[i:j]
            if hour is None or t - t % HOUR != hour:
                if hour is not None:
                    past_n, past_hours = past_n + hour_n, past_hours + 1
                hour, hour_n = t - t % HOUR, 0
            hour_n += j - i
            if user:
                (n, s, q), (n1, _, _), (nd, _, _) = hours.before(t), hours.before(t - HOUR), hours.before(t - DAY)
                (n7, s7, _), (n30, s30, q30) = hours.before(t - 7 * DAY), hours.before(t - LONGEST)
                w = n - n1, n - nd, n - n7, s - s7, n - n30, s - s30, str(q - q30)
                held_d, held_i = devices.count(t), ips.count(t)
            else:
                held_c = customers.count(t)
            for _, cents, device, ip, customer, y, x in here:
                cents = int(cents)
                idle = DAY if moved is None else t - moved
                n_1h, sum_1h = (c1, v1) if idle < HOUR else (0, 0)
                n_24h, sum_24h = (c24, v24) if idle < DAY else (0, 0)
                fresh = devices.use(device, t) if user else False
                out.append((*w, held_d, held_i, int(fresh), n_1h, sum_1h, n_24h, sum_24h, held_c, hist, past_n, past_hours, last_us, lat, lng))
                if n_24h >= 5 and cents < 100_000_000 < sum_24h + cents and min(1.0, n_24h / 10.0) > 0.5:
                    hist = 1
                if user or customer is not None:
                    c1, v1, c24, v24, moved = n_1h + 1, sum_1h + cents, n_24h + 1, sum_24h + cents, t
                if user:
                    ips.use(ip, t)
                    if y is not None and x is not None:
                        last_us, lat, lng = t, float(y), float(x)
                elif customer is not None:
                    customers.use(str(int(customer)), t)
            if user:
                devices.arrive([r[2] for r in here], t)
                ips.arrive([r[3] for r in here], t)
                for r in here:
                    hours.add(t, int(r[1]))
            else:
                customers.arrive([None if r[4] is None else str(int(r[4])) for r in here], t)
            latest, i = t, j
        hours.store(latest)
        held = uses.store(latest)
        n, cents, squares = hours.totals
        self.now.update((n, cents, str(squares), hours.known, [hours.parts[at] for at in hours.known], hours.part_n, moved, c1, v1, c24, v24, hist, past_n, past_hours, hour, hour_n, last_us, lat, lng, latest, held))
        return out


class _Record:
    """A value that lies in the record of its bucket."""

    def __init__(self, mine: dict):
        self.mine = mine

    def get(self) -> tuple | None:
        return self.mine.get("now")

    def update(self, value: tuple) -> None:
        self.mine["now"] = value


class _Parts:
    """The parts (of hours or members) of one key. Few lie in the record of the bucket; once there are more than ``FEW_PARTS``,
    they are entries of their own, of which those asked for are read and those that changed are written."""

    def __init__(self, mine: dict, what: str, key: int | None, entries):
        self.near, self.far = mine.setdefault(what, ({}, set()))
        self.name, self.entries = f"{what}/{key}/", entries

    def getValue(self, part: tuple[int]) -> tuple:
        return self.near[part[0]] if part[0] in self.near else pickle.loads(self.entries.getValue((f"{self.name}{part[0]}",))[0])

    def updateValue(self, part: tuple[int], value: tuple) -> None:
        self.near[part[0]] = value

    def removeKey(self, part: tuple[int]) -> None:
        self.near.pop(part[0], None)
        if part[0] in self.far:
            self.far.remove(part[0])
            self.entries.removeKey((f"{self.name}{part[0]}",))

    def settle(self) -> None:
        if len(self.near.keys() | self.far) <= FEW_PARTS:
            return
        for part, value in self.near.items():
            self.entries.updateValue((f"{self.name}{part}",), (pickle.dumps(value, pickle.HIGHEST_PROTOCOL),))
        self.far |= self.near.keys()
        self.near.clear()


class BucketCounters(Counters):
    """:class:`Counters` of all keys of a bucket; rows of ``TXN`` and the key come in and go out in binary values."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "kept binary")
        self.entries = handle.getMapState("entries", "name string", "kept binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held: list[tuple] = []
        for done in self._keys(key[0], (r for block in rows for r in zip(*pickle.loads(block["rows"]), strict=True))):
            held += done
            while len(held) >= PACKED:
                yield Row(kind=key[0], bucket=key[1], rows=_packed(held[:PACKED]))
                del held[:PACKED]
        if held:
            yield Row(kind=key[0], bucket=key[1], rows=_packed(held))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """Transactions from before the stream, all of a bucket's in one row."""
        for _ in self._keys(key[0], (tuple(r[c] for c in [*_TXN, "key"]) for r in initialState["past"])):
            pass

    def _keys(self, kind: str, rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        """The rows of each key with what was counted."""
        by_key: dict[int | None, list[tuple]] = {}
        for r in rows:
            by_key.setdefault(r[-1], []).append(r)
        stored = self.record.get()
        kept = {} if stored is None else pickle.loads(stored[0])
        for key, mine in by_key.items():
            state = kept.setdefault(key, {})
            self.now, self.hours, self.members = _Record(state), _Parts(state, "hours", key, self.entries), _Parts(state, "members", key, self.entries)
            mine = _ordered(mine)
            yield [r + c for r, c in zip(mine, self._counted(kind, mine), strict=True)]
            self.hours.settle()
            self.members.settle()
        self.record.update((pickle.dumps(kept, pickle.HIGHEST_PROTOCOL),))


def _packed(rows: list[tuple]) -> bytes:
    return pickle.dumps(list(map(list, zip(*rows, strict=True))), pickle.HIGHEST_PROTOCOL)


def _values(column: pa.Array) -> list:
    """The column as Python values; numbers without nulls and repeated strings take the quick way."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        coded = column.dictionary_encode()
        known = np.array([*coded.dictionary.to_pylist(), None], object)
        return known[coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)].tolist()
    return column.to_numpy(zero_copy_only=False).tolist() if column.null_count == 0 else column.to_pylist()


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``TXN`` with kind, key and bucket become rows of kind, bucket and up to ``PACKED`` such rows in one binary value."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield from _grouped(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield from _grouped(pa.Table.from_batches(held))


def _grouped(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    kind, bucket = (rows.column(c).combine_chunks() for c in ("kind", "bucket"))
    ids = np.asarray(bucket) * 2 + np.asarray(pc.equal(kind, "m").cast("int64"))
    order = np.argsort(ids, kind="stable")
    first = [0, *(np.flatnonzero(np.diff(ids[order])) + 1).tolist()]
    starts = [k for a, b in zip(first, [*first[1:], len(order)], strict=True) for k in range(a, b, PACKED)]
    ends = [*starts[1:], len(order)]
    columns = [_values(rows.column(c).combine_chunks().take(pa.array(order))) for c in [*_TXN, "key"]]
    kind, bucket = (c.take(pa.array(order[starts])) for c in (kind, bucket))
    for i in range(0, len(starts), 1_000):
        packed = [pickle.dumps([c[a:b] for c in columns], pickle.HIGHEST_PROTOCOL) for a, b in zip(starts[i:i + 1_000], ends[i:i + 1_000], strict=True)]
        yield pa.RecordBatch.from_arrays([kind[i:i + 1_000], bucket[i:i + 1_000], pa.array(packed, pa.binary())], names=["kind", "bucket", "rows"])


def _flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in the binary values, in the columns of ``_FLAT``."""
    held: list[list] = [[] for _ in _FLAT]
    for b in batches:
        for kind, packed in zip(b.column("kind"), b.column("rows"), strict=True):
            columns = pickle.loads(packed.as_py())
            for h, c in zip(held, [[kind.as_py()] * len(columns[0]), *columns], strict=True):
                h += c
            if len(held[0]) >= BLOCK:
                yield _flat(held)
                held = [[] for _ in _FLAT]
    if held[0]:
        yield _flat(held)


def _flat(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FLAT, strict=True)], schema=_FLAT)


def keyed(txn: DataFrame) -> DataFrame:
    """Every transaction once for its user and, where it has one, once for its merchant."""
    names = [c.split()[0] for c in TXN.split(", ")]
    both = F.array_compact(F.array(F.struct(F.lit("u").alias("kind"), F.col("user_id").cast("long").alias("key")),
                                   F.when(F.col("merchant_id").isNotNull(), F.struct(F.lit("m").alias("kind"), F.col("merchant_id").cast("long").alias("key")))))
    flat = txn.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in TXN.split(", ")])
    return flat.select(*names, F.explode(both).alias("_k")).select(*names, "_k.kind", "_k.key")


def _bucketed(txn: DataFrame) -> DataFrame:
    return keyed(txn).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))


def prepare(spark: SparkSession) -> None:
    """The state store that keyed state of several kinds asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def counted(txn: DataFrame, past: DataFrame | None = None) -> DataFrame:
    """The stream's transactions, by kind of key, with what the key did before; ``past``: transactions from before the stream."""
    prepare(txn.sparkSession)
    by = ["kind", "bucket"]
    first = None if past is None else _bucketed(past).groupBy(*by).agg(F.collect_list(F.struct(*_TXN, "key")).alias("past")).groupBy(*by)
    packed = "kind string, bucket long, rows binary"
    counts = _bucketed(txn).repartition(*by).mapInArrow(_dealt, packed).groupBy(*by).transformWithState(
        statefulProcessor=BucketCounters(), outputStructType=packed, outputMode="Append", timeMode="None", initialState=first)
    return counts.mapInArrow(_flattened, f"kind string, {TXN}, key long, {COUNTED}").select(*_TXN, "kind", "key", *_NAMES)
