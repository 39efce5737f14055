"""Items of varying length put into containers of fixed capacity, planned on the histogram of lengths.

Best-fit decreasing looks only at how many items of each length there are, and lengths are bounded by the capacity, so the
whole packing is planned from a table of at most ``capacity`` rows, whatever the number of items. The plan says which ranks
among the items of a length go to which range of containers; items look up their own place by rank.

Capacities are chosen together: a container is opened in the permitted size that costs least, counting its fixed cost and
the room that shorter items still to come can't fill, and is cut down in the end to the smallest permitted size that holds
its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.operators.rank import hash_order, rank_in_groups
from gridwright.session import cut_lineage

CAPACITIES = (1024, 2048, 4096)
#: Tokens that a container costs besides its capacity.
FIXED_COST = 64


@dataclass
class Plan:
    """For each length, ranges of ranks: first rank, items a container, first container. And runs of like containers."""

    places: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    containers: list[tuple[int, int, int, int]] = field(default_factory=list)  # first, number, opened size, used


def plan_packing(counts: dict[int, int], capacities: Iterable[int] = CAPACITIES, fixed_cost: int = FIXED_COST) -> Plan:
    """Best-fit decreasing for ``counts[length]`` items, all containers of a like state handled at once."""
    sizes = sorted(set(capacities))
    if not sizes or sizes[0] <= 0:
        raise ValueError("capacities must be positive")
    if any(length <= 0 or length > sizes[-1] for length in counts):
        raise ValueError("lengths must be from 1 to the largest capacity")
    plan, following = Plan(), 0
    free: dict[int, list[tuple[int, int, int]]] = {}  # room left: (first container, number, opened size)
    rooms: list[int] = []
    to_come = sum(length * n for length, n in counts.items())
    open_room = 0

    def put_back(room: int, first: int, number: int, size: int) -> None:
        if room not in free:
            free[room] = []
            insort(rooms, room)
        free[room].append((first, number, size))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        to_come -= length * left
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):

                def cost(size: int) -> tuple[float, int]:
                    number = -(-left // (size // length))
                    room = number * size - left * length
                    return number * (size + fixed_cost) - min(room, max(0, to_come - open_room)), -size

                size = min((s for s in sizes if s >= length), key=cost)
                number = -(-left // (size // length))
                put_back(size, following, number, size)
                following += number
                open_room += number * size
                continue
            room = rooms[at]
            first, number, size = free[room].pop()
            if not free[room]:
                del free[room], rooms[at]
            each = room // length
            full = min(number, left // each)
            steps = [(each, first, full)] if full else []
            if full < number and left % each and left < each * number:
                steps.append((left % each, first + full, 1))
            done = 0
            for items, start, many in steps:
                plan.places.setdefault(length, []).append((rank, items, start))
                rank += items * many
                left -= items * many
                open_room -= items * many * length
                done += many
                put_back(room - items * length, start, many, size)
            if done < number:
                put_back(room, first + done, number - done, size)
    for room, runs in free.items():
        plan.containers += [(first, number, size, size - room) for first, number, size in runs if room < size]
    return plan


def cut_down(used: int, capacities: Iterable[int]) -> int:
    return min(s for s in capacities if s >= used)


def pack(items: DataFrame, id_col: str, length: str, capacities: Iterable[int] = CAPACITIES, fixed_cost: int = FIXED_COST, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(places, containers)``.

    places: ``id, piece, pieces, start, tokens, container_id``, a row for each piece; containers: ``first_id, number,
    capacity, used``, a row for each run of like containers with following ids. An item is cut only if it is longer than
    the largest capacity: into full pieces and a rest. Items of length 0, null or less take no room: one row, container
    null. Ids may be null or repeated, each row is an item. The driver sees the histogram only, one row for each length up
    to the largest capacity. An empty table gives two empty ones.
    """
    sizes = sorted(set(capacities))
    largest = sizes[-1]
    spark = items.sparkSession
    total = F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long")
    pieces = items.select(F.col(id_col).alias("id"), total.alias("total"))
    pieces = pieces.withColumn("pieces", F.greatest(F.ceil(F.col("total") / largest), F.lit(1)).cast("int"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * largest)
    pieces = pieces.withColumn("tokens", F.least(F.col("total") - F.col("start"), F.lit(largest)).cast("int")).drop("total")
    counts = {r["tokens"]: r["n"] for r in pieces.where("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packing(counts, sizes, fixed_cost)
    # a few numbers for each range of ranks; their number is bounded by the capacity, not by the items
    spread = spark.sparkContext.broadcast({k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in plan.places.items()})

    @F.pandas_udf("long")
    def container(lengths: pd.Series, ranks: pd.Series) -> pd.Series:
        out = np.full(len(lengths), -1, dtype=np.int64)
        lengths, ranks = lengths.to_numpy(), ranks.to_numpy()
        for one in np.unique(lengths):
            if one in spread.value:
                first, each, start = spread.value[one]
                at = np.flatnonzero(lengths == one)
                k = np.searchsorted(first, ranks[at], side="right") - 1
                out[at] = start[k] + (ranks[at] - first[k]) // each[k]
        return pd.Series(out)

    ordered = pieces.withColumn("_order", hash_order(F.col("id"), F.col("piece"), seed=seed))
    ranked = rank_in_groups(ordered, ["tokens"], "_order", ["id", "piece"], "_rank")
    places = ranked.withColumn("container_id", container("tokens", "_rank"))
    places = places.select("id", "piece", "pieces", "start", "tokens", F.when(F.col("container_id") >= 0, F.col("container_id")).alias("container_id"))
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("first_id", "number", "capacity", "used")])
    runs = [(first, number, cut_down(used, sizes), used) for first, number, _, used in plan.containers]
    return places, spark.createDataFrame(runs, schema)


def pack_texts(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """:func:`pack` over the token counts of texts, which are worked out once and kept in the checkpoint folder."""
    return pack(cut_lineage(counts), id_col, "tokens")
