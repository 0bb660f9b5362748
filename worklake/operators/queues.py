"""Replay of a work queue: k servers, constant service time, a shift start, no pre-emption.

Arrival order has a closed form in windows. For any other ranking the set of start times stays
the arrival-order set (servers never idle while work waits, service is constant), so only the
matching of items to those slots is left: at each slot the best-ranked item that has arrived goes.
An item may use slot number `reach` or later, `reach` being the number of slots that start before
it arrives. Where `reach` equals the item's own arrival position nobody waits, and the matching
falls apart into independent stretches there.

Stretches that fit a task are matched by a heap in a grouped Arrow function. A longer stretch is
first cut by rank into as many classes as needed: the items better than a bound take exactly the
slots they would take if the others did not exist (again the arrival-order closed form), so each
class has the slots that it adds, and is matched to them by its own task.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklake.operators.ordered import CHUNK, MAX, SAMPLED, SUM, chunk, numbered, running
from worklake.session import materialize, piece_rows

MINUTE_US = 60_000_000


@dataclass(frozen=True)
class Shift:
    servers: int = 1
    start_hour: int = 8
    minutes: float = 20

    @property
    def service_us(self) -> int:
        return int(round(self.minutes * MINUTE_US))


def shift_start(day: str, shift: Shift) -> Column:
    return F.timestamp_add("HOUR", F.lit(shift.start_hour), F.col(day).cast("timestamp_ntz"))


def at_time(day: str, offset: str, shift: Shift) -> Column:
    """Microseconds after the shift start -> timestamp."""
    return F.timestamp_add("MICROSECOND", F.col(offset), shift_start(day, shift))


def fifo_slots(df: DataFrame, keys: list[str], day: str, arrival: str, item: str, shift: Shift) -> DataFrame:
    """Adds pos (0-based arrival position), arrival_us and start_us, both relative to the shift start."""
    m, k = shift.service_us, shift.servers
    timed = df.withColumn("arrival_us", F.timestamp_diff("MICROSECOND", shift_start(day, shift), F.col(arrival)))
    timed = chunk(timed, keys, [F.col("arrival_us"), F.col(item)])  # one cutting for both scans
    placed = numbered(timed, keys, [F.col("arrival_us"), F.col(item)], "_n")
    placed = (placed.withColumn("pos", F.col("_n") - 1)
                    .withColumn("_server", F.col("pos") % k)
                    .withColumn("_turn", F.floor(F.col("pos") / k).cast("bigint")))
    slack = F.greatest(F.col("arrival_us"), F.lit(0)) - F.col("_turn") * m
    scanned = running(placed, [*keys, "_server"], [F.col("pos")], {"_lag": (MAX, slack)})
    return (scanned.withColumn("start_us", F.col("_turn") * m + F.col("_lag"))
                   .drop("_n", "_turn", "_lag", CHUNK).withColumnRenamed("_server", "server"))


def with_reach(slots: DataFrame, keys: list[str]) -> DataFrame:
    """Adds reach (first slot the item may use) and stretch (position where its independent stretch begins). _latest is the last arrival of
    the group, or later. The rows stay cut along pos."""
    # a mark for the arrival carries the row, the mark for the slot only its time; a slot after the last arrival counts for nobody
    payload = F.struct(*[c for c in slots.columns if c not in (*keys, "pos", "_latest")])
    both = F.array(F.struct(F.col("arrival_us").alias("_t"), F.lit(0).alias("_is_slot"), payload.alias("_row")),
                   F.struct(F.col("start_us").alias("_t"), F.lit(1).alias("_is_slot"), F.when(F.lit(False), payload).alias("_row")))
    marks = slots.select(*keys, "pos", "_latest", F.inline(both)).where((F.col("_is_slot") == 0) | (F.col("_t") < F.col("_latest"))).drop("_latest")
    # at equal times the arrival comes first, so only slots that start earlier are counted
    order = [F.col("_t"), F.col("_is_slot"), F.col("pos")]
    marks = chunk(marks, keys, order)  # arrivals lie in it in the order of pos, so the second scan uses it too
    counted = running(marks, keys, order, {"reach": (SUM, F.col("_is_slot").cast("bigint"))})
    items = counted.where("_is_slot = 0").select(*keys, "pos", "_row.*", "reach", CHUNK)
    begins = F.when(F.col("reach") == F.col("pos"), F.col("pos"))
    return running(items, keys, [F.col("pos")], {"stretch": (MAX, begins)})


def _with_before(df: DataFrame, keys: list[str], day: str, arrival: str, item: str, shift: Shift) -> DataFrame:
    """Arrival-order slots, cut along pos, plus _before: the start of the slot before."""
    slots = chunk(fifo_slots(df, keys, day, arrival, item, shift), keys, [F.col("pos")])
    # starts never decrease with pos, so the item just before an item is the last to finish before it
    # the first of a piece looks back at the pieces before it
    edge = slots.groupBy(*keys, CHUNK).agg(F.max("start_us").alias("_edge"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col(CHUNK).alias("_p_chunk"), F.max("_edge").over(earlier).alias("_edge"))
    cond = F.col(CHUNK) == F.col("_p_chunk")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_p_{k}"))
    own = F.lag("start_us").over(Window.partitionBy(*keys, CHUNK).orderBy("pos"))
    slots = slots.withColumn("_own", own).join(edge, cond, "left").withColumn("_before", F.coalesce("_own", "_edge"))
    return slots.drop("_own", "_edge", "_p_chunk", *[f"_p_{k}" for k in keys])


def busy_periods(df: DataFrame, keys: list[str], day: str, arrival: str, item: str, shift: Shift) -> DataFrame:
    """Arrival-order slots plus period: 1-based number of the stretch in which someone is always waiting or served.

    A new period starts where an item arrives after every earlier item has been finished.
    """
    slots = _with_before(df, keys, day, arrival, item, shift)
    begins = F.col("_before").isNull() | (F.greatest(F.col("arrival_us"), F.lit(0))
                                          > F.col("_before") + shift.service_us)
    return running(slots, keys, [F.col("pos")], {"period": (SUM, begins.cast("bigint"))}).drop("_before", CHUNK)


def readers(df: DataFrame, keys: list[str], day: str, arrival: str, item: str, shift: Shift) -> DataFrame:
    """Arrival-order slots plus reader, 0-based: of the servers that are free the first takes the item. One server or two.

    Of two servers only the one that took the item before can still be busy. If it isn't, both are free and the first takes the
    item; else it is the other's. So they take turns from each slot on at which both are free.
    """
    if shift.servers > 2:
        raise ValueError("with more than two servers the one that takes an item depends on all that are busy")
    slots = _with_before(df, keys, day, arrival, item, shift)
    both_free = F.col("_before").isNull() | (F.col("start_us") >= F.col("_before") + shift.service_us)
    since = running(slots, keys, [F.col("pos")], {"_since": (MAX, F.when(both_free, F.col("pos")))}).drop("_before", CHUNK)
    return since.withColumn("reader", (F.col("pos") - F.col("_since")) % shift.servers).drop("_since")


def _match(reach: list[int], slots: list[int], ranks: list[int]) -> list[int]:
    """Index of the slot of every item; items come in order of reach, slots in order of time."""
    taken, waiting, nxt = [0] * len(reach), [], 0
    for at, slot in enumerate(slots):
        while nxt < len(reach) and reach[nxt] <= slot:
            heapq.heappush(waiting, (ranks[nxt], nxt))
            nxt += 1
        taken[heapq.heappop(waiting)[1]] = at
    return taken


def _bounds(stretches: DataFrame, node: list[str], orders: dict[str, list[Column]], limit: int) -> DataFrame:
    """Per stretch and arm an array of bounds that cut its ranking into classes of about limit items (rows: _size of them)."""
    classes = F.ceil(F.col("_size") / limit).cast("int")
    sample = stretches.sample(min(1.0, SAMPLED / limit), seed=1).groupBy(*node, "_size").agg(
        *[F.sort_array(F.collect_list(_rank(order))).alias(arm) for arm, order in orders.items()])

    def cut(arm: str) -> Column:
        return F.transform(F.sequence(F.lit(1), classes - 1),
                           lambda i: F.get(arm, F.floor(F.size(arm) * i / classes).cast("int")))
    # stored, because all that follows has to see the same bounds
    return materialize(sample.select(*node, *[cut(arm).alias(f"_bounds_{arm}") for arm in orders]), "bounds")


def _rank(order: list[Column]) -> Column:
    return F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])


def _not_above(bounds: str, rank: Column) -> Column:
    return F.greatest(F.size(F.filter(bounds, lambda b: b <= rank)), F.lit(0))  # a stretch that no sampled row is of has no bounds


def _turns(items: DataFrame, node: list[str], better: str, last: str) -> DataFrame:
    """(node, pos, _turn): by how much, from slot pos on, the number of bounds grows whose better items take a slot.

    Class `better` of an item is the number of bounds that are not above it, `last` the number of all bounds. The items below a bound take
    the slots they would take alone: sorted by reach, number j takes slot j + max(reach - j) so far. Items of equal reach take consecutive
    slots, so a row per reach and bound is enough, and where the maximum stays the slots are one run.
    """
    group = [*node, "_bound"]
    counts = items.groupBy(*node, "reach", better, last).agg(F.count(F.lit(1)).alias("_n")).where(F.col(better) < F.col(last))
    counts = (counts.select(*node, "reach", "_n", F.explode(F.sequence(F.col(better) + 1, F.col(last))).alias("_bound"))
                    .groupBy(*group, "reach").agg(F.sum("_n").alias("_n")))
    counts = running(chunk(counts, group, [F.col("reach")]), group, [F.col("reach")], {"_end": (SUM, F.col("_n"))})
    begin = F.col("_end") - F.col("_n")
    runs = running(counts, group, [F.col("reach")], {"_late": (MAX, F.col("reach") - begin)}).groupBy(*group, "_late").agg(
        F.min(begin).alias("_begin"), F.max("_end").alias("_end"))
    edges = F.array(F.struct((F.col("_begin") + F.col("_late")).alias("pos"), F.lit(1).alias("_turn")),
                    F.struct((F.col("_end") + F.col("_late")).alias("pos"), F.lit(-1).alias("_turn")))
    turns = runs.select(*node, F.inline(edges)).groupBy(*node, "pos").agg(F.sum("_turn").alias("_turn"))
    return materialize(turns, "turns")  # its size tells Spark whether the slots have to move for it


def _serve_classes(slots: DataFrame, long: DataFrame, keys: list[str], item: str, orders: dict[str, list[Column]], places: list[str],
                   limit: int) -> DataFrame:
    """Stretches that are too long for one task: every class of ranks is matched to its own slots by its own task."""
    node, arms = [*keys, "stretch"], list(orders)
    stretches = slots.join(F.broadcast(long), node)  # each has more than limit rows
    bounds = _bounds(stretches, node, orders, limit)
    bounded = stretches.drop("_size").join(F.broadcast(bounds), node, "left")
    for arm, order in orders.items():
        bounded = bounded.withColumn(f"_class_{arm}", _not_above(f"_bounds_{arm}", _rank(order))).withColumn(
            f"_last_{arm}", F.greatest(F.size(f"_bounds_{arm}"), F.lit(0)))
    bounded = bounded.drop(*[f"_bounds_{arm}" for arm in arms])
    free = bounded.select(*node, "pos", "start_us", CHUNK, *[f"_last_{arm}" for arm in arms])
    for arm in arms:
        turns = _turns(bounded, node, f"_class_{arm}", f"_last_{arm}")
        free = free.join(turns.withColumnRenamed("_turn", f"_turn_{arm}"), [*node, "pos"], "left")
    # a slot that the items below a bound take, those below any higher bound take too
    free = running(free, node, [F.col("pos")], {f"_taken_{arm}": (SUM, F.coalesce(f"_turn_{arm}", F.lit(0))) for arm in arms})
    out = None
    for arm, order in orders.items():
        carried = ["pos", "server", "arrival_us", "start_us"] if arm == arms[-1] else []
        mine = bounded.withColumn("_class", F.col(f"_class_{arm}").cast("bigint"))
        theirs = free.withColumn("_class", F.col(f"_last_{arm}") - F.col(f"_taken_{arm}"))
        served = _serve_class(mine, theirs, [*node, "_class"], [*keys, item, *carried], order, arm)
        served = by_start(served, keys, arm, item, f"{arm}_seq") if arm in places else served
        out = served if out is None else out.join(served, [*keys, item])
    return out


def _serve_class(items: DataFrame, slots: DataFrame, group: list[str], keep: list[str], order: list[Column], arm: str) -> DataFrame:
    """keep, <arm>_start_us and <arm>_slot: the items of every group matched to its slots."""
    together = Window.partitionBy(*group).orderBy(*order)
    ranked = items.select(*dict.fromkeys([*group, *keep]), "reach", F.row_number().over(together).alias("_rank"))
    free = slots.select(*[F.col(c).alias(f"_{c}") for c in [*group, "pos", "start_us"]])  # other names, as both sides come from the same rows
    schema = T.StructType(items.select(*keep).schema.fields + [T.StructField(f"{arm}_{c}", T.LongType()) for c in ("start_us", "slot")])

    def serve(waiting: pa.Table, free: pa.Table) -> pa.Table:
        waiting, free = waiting.sort_by("reach"), free.sort_by("_pos")
        taken = _match(waiting["reach"].to_pylist(), free["_pos"].to_pylist(), waiting["_rank"].to_pylist())
        at = pa.array(taken, pa.int64())
        out = waiting.select(keep).append_column(f"{arm}_start_us", free["_start_us"].take(at))
        return out.append_column(f"{arm}_slot", free["_pos"].take(at))

    return ranked.groupBy(*group).cogroup(free.groupBy(*[f"_{c}" for c in group])).applyInArrow(serve, schema)


def replay(df: DataFrame, keys: list[str], day: str, arrival: str, item: str, shift: Shift,
           ranks: dict[str, list[Column]], slots: bool = False) -> DataFrame:
    """df plus pos, server, arrival_us, start_us (arrival order) and <arm>_start_us for every arm in ranks; with slots also <arm>_slot,
    the number of the slot it took, from 0 by start.

    ranks: arm -> ordering columns; ties are broken by arrival and item. Items are unique within their group.
    """
    out = served(df, keys, day, arrival, item, shift, ranks)
    return df.join(out if slots else out.drop(*[f"{a}_slot" for a in ranks]), [*keys, item])


def served(df: DataFrame, keys: list[str], day: str, arrival: str, item: str, shift: Shift, ranks: dict[str, list[Column]],
           places: list[str] = ()) -> DataFrame:
    """keys, item and what replay adds, for callers that join more to it before the rows of df; for the arms in places also <arm>_seq, the
    1-based place by start, ties by item."""
    # the scans rewrite their rows, so they get the narrow ones
    columns = {f"_{arm}_{i}": c for arm, order in ranks.items() for i, c in enumerate(order)}
    narrow = df.select(*dict.fromkeys([*keys, day, arrival, item]), *[c.alias(n) for n, c in columns.items()])
    named = {arm: [F.col(f"_{arm}_{i}") for i in range(len(order))] for arm, order in ranks.items()}
    out = _replay(narrow, keys, day, arrival, item, shift, named, list(places))
    added = [f"{a}_{c}" for a in ranks for c in ("start_us", "slot", *(["seq"] if a in places else []))]
    return out.select(*keys, item, "pos", "server", "arrival_us", "start_us", *added)


def by_start(df: DataFrame, keys: list[str], arm: str, item: str, name: str) -> DataFrame:
    """1-based place by start in an arm of replay with slots, ties by item. As many items start at once as there are servers, or fewer."""
    together = Window.partitionBy(*keys, f"{arm}_start_us")
    first = F.min(f"{arm}_slot").over(together)
    return df.withColumn(name, first + F.row_number().over(together.orderBy(item)))


def _replay(df: DataFrame, keys: list[str], day: str, arrival: str, item: str, shift: Shift,
            ranks: dict[str, list[Column]], places: list[str]) -> DataFrame:
    limit = piece_rows(df.sparkSession)
    last = df.groupBy(*keys).agg(F.max(F.timestamp_diff("MICROSECOND", shift_start(day, shift), F.col(arrival))).alias("_latest"))
    last = materialize(last, "last")  # as many rows as groups: its size tells Spark whether the slots have to move for it
    slots = fifo_slots(df, keys, day, arrival, item, shift).drop(arrival, *([] if day in keys else [day])).join(last, keys)
    slots = materialize(with_reach(slots, keys), "stretches")
    orders = {arm: [*order, F.col("arrival_us"), F.col(item)] for arm, order in ranks.items()}
    long = slots.groupBy(*keys, "stretch").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > limit)
    long = materialize(long, "long")  # of rows / limit rows at most
    short = slots.join(F.broadcast(long), [*keys, "stretch"], "left_anti")
    out = _serve(short, keys, item, orders, places, limit)
    if long.isEmpty():
        return out
    return out.unionByName(_serve_classes(slots, long, keys, item, orders, places, limit).select(*out.columns))


def _serve(slots: DataFrame, keys: list[str], item: str, orders: dict[str, list[Column]], places: list[str], limit: int) -> DataFrame:
    """Whole stretches are bundled, so a task takes many short ones or one long one."""
    keep, arms = [*keys, item, "pos", "server", "arrival_us", "start_us"], list(orders)
    bundled = slots.withColumn("_bundle", F.floor(F.col("stretch") / max(1, limit // 4)).cast("bigint"))
    together = Window.partitionBy(*keys, "_bundle")
    ranked = bundled.select(*keep, "_bundle", "reach", *[F.row_number().over(together.orderBy(*o)).alias(f"_{a}") for a, o in orders.items()])
    schema = T.StructType(slots.select(*keep).schema.fields + [
        T.StructField(f"{a}_{c}", T.LongType()) for a in arms for c in ("start_us", "slot", *(["seq"] if a in places else []))])

    def serve(table: pa.Table) -> pa.Table:
        # reach follows pos, and at the start of a stretch every earlier slot is taken: one pass does all
        table = table.sort_by("pos")
        reach, slot = table["reach"].to_pylist(), table["pos"].to_pylist()
        out = table.select(keep)
        for arm in arms:
            taken = pa.array(_match(reach, slot, table[f"_{arm}"].to_pylist()), pa.int64())
            out = out.append_column(f"{arm}_start_us", table["start_us"].take(taken)).append_column(f"{arm}_slot", table["pos"].take(taken))
            if arm in places:  # slots that start at once lie in one stretch
                ordered = pc.sort_indices(out, [(f"{arm}_start_us", "ascending"), (item, "ascending")])
                place = pc.add(table["pos"], 1).take(pc.sort_indices(ordered))
                out = out.append_column(f"{arm}_seq", place)
        return out

    return ranked.groupBy(*keys, "_bundle").applyInArrow(serve, schema)
