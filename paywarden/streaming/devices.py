"""Known devices per user on a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.constants import DAY
from .counters import BLOCK, prepare

OUTPUT = "user_id long, txn_id array<long>, us array<long>, new_device_flag array<int>"


#: Known devices of a user that lie together in one record; further ones are entries of their own.
TOGETHER = 1_000


class KnownDevices(StatefulProcessor):
    """The known devices of a user and the time at which all of them expire: one record, read and written once in a micro-batch,
    and beyond ``TOGETHER`` devices a map, of which only devices of the micro-batch are read."""

    def __init__(self, life_us: int):
        self.life_us = life_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "until long, devices array<string>, more long")
        self.devices = handle.getMapState("more_devices", "device string", "since long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = sorted(((r["us"], r["txn_id"], r["device"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0))  # one user's rows of one micro-batch
        stored = self.known.get()
        until, devices, more = (0, [], 0) if stored is None else stored
        known, beyond, changed, flags = set(devices), {}, False, []
        for us, _, d in rows:
            if us is not None and us >= until and (known or more):
                if more:
                    self.devices.clear()
                known, beyond, more, changed = set(), {}, 0, True
            fresh = False
            if d is not None and d not in known:
                if more and d not in beyond:
                    beyond[d] = self.devices.containsKey((d,))
                fresh = not beyond.get(d, False)
            if fresh:
                if len(known) < TOGETHER:
                    known.add(d)
                else:
                    self.devices.updateValue((d,), (us,))
                    beyond[d], more = True, more + 1
                until, changed = us + self.life_us, True
            flags.append(int(fresh))
        if changed:
            self.known.update((until, sorted(known), more))
        for i in range(0, len(rows), BLOCK):
            part = rows[i:i + BLOCK]
            yield Row(user_id=key[0], us=[us for us, _, _ in part], txn_id=[t for _, t, _ in part], new_device_flag=flags[i:i + BLOCK])


def new_devices(txn: DataFrame, life_us: int = 30 * DAY) -> DataFrame:
    """1 for a device outside the user's known set. The set expires as a whole ``life_us`` after the
    last device was added to it; using a known device does not prolong it. ``txn``: txn_id, user_id,
    device, us."""
    prepare(txn.sparkSession)
    blocks = txn.select("txn_id", "user_id", "device", "us").groupBy("user_id").transformWithState(
        statefulProcessor=KnownDevices(life_us), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
    return blocks.select("user_id", F.inline(F.arrays_zip("txn_id", "us", "new_device_flag"))).select("txn_id", "user_id", "us", "new_device_flag")
