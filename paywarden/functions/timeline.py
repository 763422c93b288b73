"""Per-key timelines that stay balanced when one key owns most of the rows.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. Here a
timeline is cut into slices of fixed time width. Work inside a slice is a
normal window over ``(key, slice)``; what a slice inherits from earlier ones is
worked out on one summary row per ``(key, slice)``, whose number is bounded by
the clock and not by the row count, and joined back on the same partitioning.

Sliding windows are differences of running sums: a row counts from just after
its own time until ``width`` later, so it enters as ``+x`` at ``t`` and leaves
as ``-x`` at ``t + width``. Measures are integers or decimals, hence exact. (A RANGE frame would
add up its whole window again for every row.)

Every helper reads its input twice, once for the rows and once for the summaries. Callers should
therefore hand in narrow columns and put results side by side with :func:`attach` rather than
feed one helper's output into the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .constants import HOUR

_SL = "_slice"
SLICE = 6 * HOUR  # narrower slices split a hotter key further, at the price of more summary rows


def slice_start(time: Column, width: int) -> Column:
    return time - F.pmod(time, F.lit(width))


def attach(base: DataFrame, *parts: DataFrame, on: str = "txn_id") -> DataFrame:
    """Put narrow per-row results beside ``base``; one shuffle of ``base`` on the row id serves all parts."""
    for p in parts:
        base = base.join(p, on, "left")
    return base


def _win(keys, *order):
    return Window.partitionBy(*keys, _SL).orderBy(*order)


def _slices(keys):
    return Window.partitionBy(*keys).orderBy(_SL)


def _joined_keys(keys) -> list[Column]:
    """The keys of summary rows, for the join with their rows.

    A join tells its right side that keys are not null. Told down to the input, that would make it differ from the input of the
    rows, and Spark would shuffle what both read twice; it does not pass a value that a window worked out.
    """
    return [F.max(k).over(_slices(keys)).alias(k) for k in keys]


def neighbours(df: DataFrame, keys: list[str], time: str, tie: str, before: dict[str, str] | None = None,
               after: dict[str, str] | None = None, slice_us: int = SLICE, slice_col: Column | None = None) -> DataFrame:
    """Add columns of the key's previous row (``before``: out -> column) and next row (``after``),
    in (time, tie) order; null where there is none. Both directions share one pass."""
    before, after = before or {}, after or {}
    base = df.withColumn(_SL, slice_start(F.col(time), slice_us) if slice_col is None else slice_col)
    w, at = _win(keys, time, tie), F.struct(time, tie)
    ways = [(n, m, sh, pick) for n, m, sh, pick in
            (("b", before, F.lag, F.max_by), ("a", after, F.lead, F.min_by)) if m]
    packed = {n: F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(m.values())]) for n, m, _, _ in ways}

    def edge(n: str, m: dict[str, str], pick) -> Column:
        if set(m.values()) == {time}:  # the time itself needs no row to be picked
            t = (F.max if n == "b" else F.min)(time)
            return F.struct(*[t.alias(f"c{i}") for i in range(len(m))])
        return pick(packed[n], at)

    edges = base.groupBy(*keys, _SL).agg(*[edge(n, m, pick).alias(f"_edge_{n}") for n, m, _, pick in ways])
    edges = edges.select(*_joined_keys(keys), _SL, *[sh(f"_edge_{n}").over(_slices(keys)).alias(f"_far_{n}") for n, _, sh, _ in ways])
    # plain columns, and a mark that there is a row at all: structs would be made before the shuffle and sent beside their columns
    local = base.select("*", *[c for n, m, sh, _ in ways for c in (
        sh(F.lit(1)).over(w).alias(f"_is_{n}"), *[sh(x).over(w).alias(f"_near_{n}{i}") for i, x in enumerate(m.values())])])
    joined = local.join(edges, [*keys, _SL], "left")
    return joined.select(*df.columns, *[
        F.when(F.col(f"_is_{n}").isNotNull(), F.col(f"_near_{n}{i}")).otherwise(F.col(f"_far_{n}.c{i}")).alias(o)
        for n, m, _, _ in ways for i, o in enumerate(m)])


def running(df: DataFrame, keys: list[str], time: str, sums: dict[str, Column], slice_col: Column,
            tie: str | None = None, inclusive: bool = False) -> DataFrame:
    """Add running sums per key. With ``tie`` rows follow (time, tie) order; without it rows of
    equal time are taken together. ``inclusive`` counts the row itself (or its whole tie group)."""
    tmp = {o: f"_m{i}" for i, o in enumerate(sums)}
    base = df.select("*", *[c.alias(tmp[o]) for o, c in sums.items()], slice_col.alias(_SL))
    w = _win(keys, time, tie) if tie else _win(keys, time)
    last = 0 if inclusive else -1
    frame = w.rowsBetween(Window.unboundedPreceding, last) if tie else w.rangeBetween(Window.unboundedPreceding, last)
    before = _slices(keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy(*keys, _SL).agg(*[F.sum(t).alias(t) for t in tmp.values()])
    totals = totals.select(*_joined_keys(keys), _SL, *[F.sum(t).over(before).alias(f"{t}o") for t in tmp.values()])
    local = base.select("*", *[F.sum(t).over(frame).alias(f"{t}l") for t in tmp.values()])
    out = local.join(totals, [*keys, _SL], "left")
    return out.select(
        *df.columns,
        *[(F.coalesce(F.col(f"{t}l"), F.lit(0)) + F.coalesce(F.col(f"{t}o"), F.lit(0))).alias(o) for o, t in tmp.items()],
    )


def last_time(df: DataFrame, time: str = "us") -> Column:
    """The latest ``time`` of ``df``, as a value that any other frame can be compared with."""
    return df.agg(F.max(time)).scalar()


def trailing(df: DataFrame, keys: list[str], time: str, specs: dict[str, tuple[int, Column, Column]], slice_us: int = SLICE,
             keep: list[str] | None = None, asking: Column | None = None, last: Column | None = None) -> DataFrame:
    """Sliding totals over ``[t - width, t - 1us]`` per key.

    ``specs`` maps an output name to (width, value on entry, value on exit). Rows of the same
    time do not see each other. One shuffle serves every width and measure.

    What is not needed is not shuffled: ``keep`` names the columns that come back beside the totals (all by default); rows for
    which ``asking`` is not true count but do not come back; no row comes back that is later than ``last``, so that what a row
    takes away after that need not be told.
    """
    widths = sorted({w for w, _, _ in specs.values()})
    cols = df.columns if keep is None else keep
    rest = [c for c in cols if c not in keys and c != time]
    asked = F.lit(True) if asking is None else F.coalesce(asking, F.lit(False))
    prepared = df.select(
        F.when(asked, F.struct(F.lit(True).alias("_asked"), *rest)).alias("_row"), *keys, F.col(time).alias("_t"),
        *[e.alias(f"_in{i}") for i, (_, e, _) in enumerate(specs.values())],
        *[x.alias(f"_out{i}") for i, (_, _, x) in enumerate(specs.values())],
    )
    leaves = {w: [i for i, (v, _, _) in enumerate(specs.values()) if v == w] for w in widths}

    def counts(side: str, of: list[int]) -> Column:
        return reduce(lambda a, b: a | b, [F.col(f"{side}{i}") != 0 for i in of])

    enters = F.struct(F.lit(0).alias("kind"), F.col("_t").alias("at"))
    marks = [enters if asking is None else F.when(F.col("_row").isNotNull() | counts("_in", range(len(specs))), enters)]
    for n, w in enumerate(widths, 1):
        at = F.col("_t") + F.lit(w)
        seen = counts("_out", leaves[w])
        if last is not None:
            seen = seen & F.coalesce(at <= last, F.lit(True))
        marks.append(F.when(seen, F.struct(F.lit(n).alias("kind"), at.alias("at"))))
    marked = prepared.withColumn("_e", F.explode(F.array_compact(F.array(*marks))))
    deltas, sums = [], {}
    for i, (name, (w, _, _)) in enumerate(specs.items()):
        n = widths.index(w) + 1
        deltas.append(
            F.when(F.col("_e.kind") == 0, F.col(f"_in{i}")).when(F.col("_e.kind") == n, -F.col(f"_out{i}"))
            .otherwise(F.lit(0)).alias(f"_d{i}")
        )
        sums[f"_s{i}"] = F.col(f"_d{i}")
    flat = marked.select(*keys, F.col("_e.at").alias("_at"), *deltas, F.when(F.col("_e.kind") == 0, F.col("_row")).alias("_row"))
    ran = running(flat, keys, "_at", sums, slice_start(F.col("_at"), slice_us))
    return ran.filter(F.col("_row").isNotNull()).select(
        *[F.col(c) if c in keys else F.col("_at").alias(c) if c == time else F.col(f"_row.{c}").alias(c) for c in cols],
        *[F.col(f"_s{i}").alias(name) for i, name in enumerate(specs)],
    )


def presence(df: DataFrame, keys: list[str], member: str, time: str, tie: str, width: int, name: str,
             slice_us: int = SLICE) -> DataFrame:
    """Flags ``{name}_in`` / ``{name}_out`` that make :func:`trailing` count distinct members, and
    ``{name}_fresh``: not seen for ``width``; ``{name}_known``: the row has a member.

    A member stays present for ``width`` after each of its rows. Only the row that opens a spell
    and the row that ends it count, so the sliding distinct count is a sum of +1 and -1.
    """
    known = df.filter(F.col(member).isNotNull())
    blank = df.filter(F.col(member).isNull())
    b = neighbours(known, [*keys, member], time, tie, {"_p": time}, {"_n": time}, slice_us)
    t = F.col(time)
    flags = [
        F.when(F.col("_p").isNull() | (t - F.col("_p") > width), 1).otherwise(0).cast("long").alias(f"{name}_in"),
        F.when(F.col("_n").isNull() | (F.col("_n") - t > width), 1).otherwise(0).cast("long").alias(f"{name}_out"),
        F.when(F.col("_p").isNull() | (t - F.col("_p") >= width), 1).otherwise(0).alias(f"{name}_fresh"),
        F.lit(1).alias(f"{name}_known"),
    ]
    zero = [F.lit(0).alias(f"{name}_fresh"), F.lit(0).alias(f"{name}_known"), F.lit(0).cast("long").alias(f"{name}_in"), F.lit(0).cast("long").alias(f"{name}_out")]
    return b.select(*df.columns, *flags).unionByName(blank.select(*df.columns, *zero))


def session_counters(df: DataFrame, keys: list[str], time: str, tie: str, amount: str, gaps: dict[str, int],
                     moves: Column | None = None, slice_us: int = SLICE) -> DataFrame:
    """Count and sum of the key's earlier rows since its last pause of at least the gap.

    This is what an expiring counter shows before the row is added: every write renews the
    expiry, so the counter resets only after a silence. Rows where ``moves`` is false read the
    counter without writing. Adds ``count_{g}`` and ``sum_{g}``.
    """
    moved = F.lit(True) if moves is None else F.coalesce(moves, F.lit(False))
    base = df.select("*", slice_start(F.col(time), slice_us).alias(_SL), F.when(moved, F.col(time)).alias("_t"),
                     F.when(moved, 1).otherwise(0).cast("long").alias("_w"),
                     F.when(moved, F.col(amount)).otherwise(F.lit(0)).alias("_x"))
    w = _win(keys, time, tie)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = base.select(
        "*", F.max("_t").over(earlier).alias("_prev"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_c"),
        F.coalesce(F.sum("_x").over(earlier), F.lit(0)).alias("_v"))
    local = local.select("*", *[F.when(F.col("_t") - F.col("_prev") >= g, F.struct("_c", "_v")).alias(f"_b_{n}") for n, g in gaps.items()])

    summary = local.groupBy(*keys, _SL).agg(
        F.sum("_w").alias("_n"), F.sum("_x").alias("_s"), F.min("_t").alias("_first"), F.max("_t").alias("_final"),
        *[F.max(f"_b_{n}").alias(f"_b_{n}") for n in gaps])
    prior = _slices(keys).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        "*", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_oc"),
        F.coalesce(F.sum("_s").over(prior), F.lit(0)).alias("_ov"), F.max("_final").over(prior).alias("_pf"))
    start = F.struct(F.col("_oc").alias("c"), F.col("_ov").alias("v"))
    heads = {n: F.col("_first").isNotNull() & (F.col("_pf").isNull() | (F.col("_first") - F.col("_pf") >= g)) for n, g in gaps.items()}
    summary = summary.select("*", *[
        F.when(F.col(f"_b_{n}").isNotNull(),
               F.struct((F.col("_oc") + F.col(f"_b_{n}._c")).alias("c"), (F.col("_ov") + F.col(f"_b_{n}._v")).alias("v")))
        .when(heads[n], start).alias(f"_pos_{n}") for n in gaps])
    summary = summary.select("*", *[F.max(f"_pos_{n}").over(prior).alias(f"_carry_{n}") for n in gaps])
    summary = summary.select(
        *_joined_keys(keys), _SL, "_oc", "_ov", "_pf", *[f"_carry_{n}" for n in gaps],
        *[F.when(heads[n], start).otherwise(F.col(f"_carry_{n}")).alias(f"_enter_{n}") for n in gaps])
    local = local.select(*df.columns, _SL, "_prev", "_c", "_v", *[F.max(f"_b_{n}").over(upto).alias(f"_last_{n}") for n in gaps])
    out = local.join(summary, [*keys, _SL], "left")
    idle = F.col(time) - F.coalesce("_prev", "_pf")
    cols = []
    for n, g in gaps.items():
        for part, own, off, field in (("count", "_c", "_oc", "c"), ("sum", "_v", "_ov", "v")):
            begin = F.coalesce(
                F.col(off) + F.col(f"_last_{n}.{own}"),
                F.when(F.col("_c") == 0, F.col(f"_carry_{n}.{field}")).otherwise(F.col(f"_enter_{n}.{field}")))
            live = F.col(off) + F.col(own) - begin
            cols.append(F.coalesce(F.when(idle < g, live), F.lit(0)).alias(f"{part}_{n}"))
    return out.select(*df.columns, *cols)
