"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard has many points on a ring. A row belongs to the first point clockwise of
its id's hash; if that shard is full it goes on to the next shard on the ring. No
shard takes more than its share of ``load`` times the mean, so at load 1 the sizes
differ by one row at most, and only rows of full shards leave their first place.

Which rows come too late is found on counts alone. A row's turn is a hash; turns are
dealt into ``STEPS`` steps, and the driver plays the steps on the counts by arc and
step, whose number is fixed. A shard closes for the round before the step that would
overfill it. The few rows that found every shard closed start the next round with the
room that is left, until so few remain that they are played one by one; however few rows
there are, the first round is one of steps.

Defined results: a null text has size 1 and checksum 0; rows without an id share a
place on the ring but not their turns; repeated rows are placed each for itself; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.llm.tables import chunks_for, cut, rank_in_group

VIRTUAL_NODES = 64
STEPS = 256
#: So many rows at most are played one by one, on the driver.
LAST_ROWS = 20_000


def _spread(numbers: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Ring:
    """Points of all shards in clockwise order, and each point's shards from there on."""

    shards: int
    nodes: int = VIRTUAL_NODES
    points: np.ndarray = field(init=False)
    onwards: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        number = np.arange(1, self.shards * self.nodes + 1)
        at = _spread(number)
        order = np.argsort(at, kind="stable")
        self.points, owner = at[order], ((number - 1) // self.nodes)[order]
        self.onwards = np.empty((len(order), self.shards), dtype=np.int32)
        for k in range(len(order)):
            ahead = np.roll(owner, -k)
            _, first = np.unique(ahead, return_index=True)
            self.onwards[k] = ahead[np.sort(first)]

    def arcs(self, hashes: np.ndarray) -> np.ndarray:
        """The point that each hash comes to first, clockwise."""
        at = np.searchsorted(self.points, hashes.astype(np.int64).view(np.uint64), "left")
        return at % len(self.points)

    def first_open(self, is_open: np.ndarray) -> np.ndarray:
        """For each point the first open shard, -1 where none is."""
        allowed = is_open[self.onwards]
        first = self.onwards[np.arange(len(self.points)), allowed.argmax(axis=1)]
        return np.where(allowed.any(axis=1), first, -1).astype(np.int32)


def play_steps(ring: Ring, counts: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shards by step and arc for these counts, -1 where none is open.

    ``room`` is what every shard has left, and is lowered here.
    """
    is_open = room > 0
    out = np.full(counts.shape[::-1], -1, dtype=np.int32)
    target = ring.first_open(is_open)
    for step in range(counts.shape[1]):
        come = counts[:, step]
        while is_open.any():
            loads = np.bincount(target, come, minlength=len(room)).astype(np.int64)
            if (loads <= room).all():
                break
            is_open &= loads <= room
            target = ring.first_open(is_open)
        if not is_open.any():
            break
        out[step] = target
        room -= loads
    return out


def play_rows(ring: Ring, arcs: np.ndarray, turns: np.ndarray, room: np.ndarray):
    """Last turns of the phases in which the same shards are open, and their targets."""
    is_open = room > 0
    ends, targets, target = [], [], ring.first_open(is_open)
    for arc, turn in zip(arcs.tolist(), turns.tolist(), strict=True):
        shard = target[arc]
        if shard < 0:
            break
        room[shard] -= 1
        if not room[shard]:
            ends.append(turn)
            targets.append(target)
            is_open[shard] = False
            target = ring.first_open(is_open)
    ends.append(np.iinfo(np.int64).max)
    targets.append(target)
    return np.array(ends), np.stack(targets)


def _turn(round_: int, by_id: bool) -> Column:
    """The hash that orders rows in a round; later rounds also part rows of equal id."""
    return F.xxhash64(F.lit(round_), "h") if by_id else F.xxhash64(F.lit(round_), "h", "row_id")


def _step(turn: Column) -> Column:
    return F.pmod(turn, F.lit(STEPS)).cast("int")


def shard_by_ring(
    docs: DataFrame,
    shards: int = 8,
    load: float = 1.0,
    nodes: int = VIRTUAL_NODES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Id, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``home`` of every row.

    ``size`` is the UTF-8 bytes of the text plus 1, ``home`` the shard that the ring
    alone would give, ``slot`` the row's number in its shard.
    """
    if load < 1:
        raise ValueError("load must be 1 or more")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.lit(0), F.col(id_col)).alias("h"),
        )
    ).withColumn("row_id", F.monotonically_increasing_id())
    total = rows.count()
    ring = Ring(shards, nodes)
    if load == 1.0:
        room = total // shards + (np.arange(shards) < total % shards)
    else:
        room = np.full(shards, ceil(load * total / shards))
    room = room.astype(np.int64)
    whole = room.sum()
    shared = spark.sparkContext.broadcast(ring)

    @F.pandas_udf("int")
    def arc(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.arcs(h.to_numpy(np.int64)).astype(np.int32))

    placed = rows.withColumn("arc", arc("h")).withColumn("shard", F.lit(-1))
    left, round_ = total, 0
    while left > LAST_ROWS or not round_:
        step = _step(_turn(round_, round_ == 0))
        counted = placed.filter("shard < 0").groupBy("arc", step.alias("step")).count().toPandas()
        counts = np.zeros((len(ring.points), STEPS), dtype=np.int64)
        counts[counted["arc"], counted["step"]] = counted["count"]
        plan = spark.sparkContext.broadcast(play_steps(ring, counts, room))
        placed = placed.withColumn("shard", _planned(plan)("shard", "arc", step))
        left, round_ = total - int(whole - room.sum()), round_ + 1
    turn = _turn(round_, False)
    last = placed.filter("shard < 0").select("arc", turn.alias("turn")).toPandas()
    last = last.sort_values("turn")
    phases = play_rows(ring, last["arc"].to_numpy(), last["turn"].to_numpy(), room)
    ends = spark.sparkContext.broadcast(phases)

    @F.pandas_udf("int")
    def settle(shard: pd.Series, arc: pd.Series, turn: pd.Series) -> pd.Series:
        until, targets = ends.value
        phase = np.searchsorted(until, turn.to_numpy(np.int64), "left")
        now = targets[phase, arc.to_numpy()]
        return pd.Series(np.where(shard < 0, now, shard).astype(np.int32))

    homes = ring.first_open(np.ones(shards, dtype=bool))
    home = spark.sparkContext.broadcast(homes)

    @F.pandas_udf("int")
    def first(arc: pd.Series) -> pd.Series:
        return pd.Series(home.value[arc.to_numpy()])

    done = placed.select(
        "id", "size", "text_crc32", "h", "row_id", settle("shard", "arc", turn).alias("shard"),
        first("arc").alias("home"),
    )
    ranked = rank_in_group(done, ["shard"], ["h", "row_id"], chunks_for(total), "slot")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", "home")


def _planned(plan):
    @F.pandas_udf("int")
    def place(shard: pd.Series, arc: pd.Series, step: pd.Series) -> pd.Series:
        now = plan.value[step.to_numpy(), arc.to_numpy()]
        return pd.Series(np.where(shard < 0, now, shard).astype(np.int32))

    return place
