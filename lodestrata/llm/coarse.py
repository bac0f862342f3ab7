"""A graph in levels for sharding: clusters of linked nodes become nodes of a smaller graph.

Clusters come from label propagation under a size bound: each node starts with a label of its own
and asks, in half of the rounds, for the label that most of its links lead to and that has room;
of those that ask for one label as many may go as fit, by hash. Nodes that stay alone because all
labels around them are full join others of the same neighbour (a hub's leaves aren't linked with
each other). Every level is a table; only the last, of bounded size, is divided in the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Rounds of labels for a level.
ROUNDS = 4
#: Starts that a division in the driver tries, and more for very small graphs.
STARTS, SMALL, SMALL_STARTS = 32, 64, 60


def clusters(nodes: DataFrame, edges: DataFrame, bound: int, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, weight, unit): the cluster of each node (doc_id, weight) by edges (doc_id, other, w), both ways."""
    label = nodes.select("doc_id", "weight", F.col("doc_id").alias("unit"))
    pulls = lambda now: edges.join(now.select(F.col("doc_id").alias("other"), "unit"), "other").groupBy("doc_id", "unit").agg(F.sum("w").alias("pull"))
    sized = lambda now: now.groupBy("unit").agg(F.sum("weight").alias("size"))
    for turn in range(rounds):
        size = scratch.keep(sized(label), "sizes")
        pull = scratch.keep(pulls(label), "pulls")
        mine = label.withColumnRenamed("unit", "own")
        own = mine.join(pull.withColumnsRenamed({"unit": "own", "pull": "own_pull"}), ["doc_id", "own"], "left")
        offers = pull.join(size, "unit").join(mine, "doc_id").where((F.col("unit") != F.col("own")) & (F.col("size") + F.col("weight") <= bound))
        best = offers.groupBy("doc_id").agg(F.max(F.struct("pull", F.xxhash64("unit", F.lit(turn)).alias("h"), "unit", "size")).alias("best"))
        asks = own.join(best, "doc_id").where(F.col("best.pull") > F.coalesce("own_pull", F.lit(0))).where(F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(2)) == 0)
        asks = scratch.keep(asks.select("doc_id", "weight", F.col("best.unit").alias("to"), (bound - F.col("best.size")).alias("room")), "asks")
        asked = asks.groupBy("to").agg(F.sum("weight").alias("asked"))
        chance = F.pmod(F.xxhash64("doc_id", F.lit(turn), F.lit("may")), F.lit(1 << 20)) / float(1 << 20)
        goes = asks.join(asked, "to").where(chance * F.col("asked") < F.col("room")).select("doc_id", "to")
        label = scratch.keep(label.join(goes, "doc_id", "left").select("doc_id", "weight", F.coalesce("to", "unit").alias("unit")), "labels")
    # alone at the end: together with others that pull most to the same cluster, in parts of the bound
    size = sized(label)
    alone = label.join(size, "unit").where(F.col("size") == F.col("weight")).where(F.col("unit") == F.col("doc_id")).select("doc_id", "weight")
    near = pulls(label).groupBy("doc_id").agg(F.max_by("unit", F.struct("pull", "unit")).alias("near"))
    alone = scratch.keep(alone.join(near, "doc_id").where("near <> doc_id"), "alone")
    parts = alone.groupBy("near").agg(F.ceil(F.sum("weight") / bound).alias("parts"))
    alone = alone.join(parts, "near").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), "parts"))
    together = alone.groupBy("near", "part").agg(F.min("doc_id").alias("to"))
    # the smallest one keeps its own label, so a cluster that others joined meanwhile keeps its name
    joined = alone.join(together, ["near", "part"]).select("doc_id", "to")
    return scratch.keep(label.join(joined, "doc_id", "left").select("doc_id", "weight", F.coalesce("to", "unit").alias("unit")), "clusters")


def contracted(label: DataFrame, edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the clusters."""
    nodes = scratch.keep(label.groupBy("unit").agg(F.sum("weight").alias("weight")).withColumnRenamed("unit", "doc_id"), "coarse-nodes")
    at = lambda name, unit: label.select(F.col("doc_id").alias(name), F.col("unit").alias(unit))
    both = edges.join(at("doc_id", "u"), "doc_id").join(at("other", "v"), "other").where("u <> v")
    return nodes, scratch.keep(both.groupBy(F.col("u").alias("doc_id"), F.col("v").alias("other")).agg(F.sum("w").alias("w")), "coarse-edges")


def divide(weight: np.ndarray, links: np.ndarray, capacity: list[int], seed: int = 0) -> np.ndarray:
    """The part of each node of a small graph (dense weights of links), -1 for those that fit nowhere.

    Parts grow one after the other from the rim, each time by the node that cuts least; then nodes
    move, the best first and also at a loss, and the best state that keeps to the capacities stays.
    """
    n = len(weight)
    best, least = np.full(n, -1), None
    for start in range(SMALL_STARTS if n <= SMALL else STARTS):
        part = _moved(_grown(weight, links, capacity, np.random.default_rng(seed + start)), weight, links, capacity)
        inside = part[:, None] == part[None]
        cut = links[~inside | (part < 0)[:, None]].sum()
        key = (weight[part < 0].sum(), cut)
        if least is None or key < least:
            best, least = part, key
    return best


def _grown(weight: np.ndarray, links: np.ndarray, capacity: list[int], rng: np.random.Generator) -> np.ndarray:
    n, part = len(weight), np.full(len(weight), -1)
    noise = rng.random(n) * 1e-3
    room = list(capacity)
    heavy = np.argsort(-weight, kind="stable")
    limit = max(1, sum(capacity) // max(1, len(capacity)) // 8)
    for v in heavy[weight[heavy] > limit]:  # what hardly fits comes first
        s = int(np.argmax(room))
        if weight[v] <= room[s]:
            part[v], room[s] = s, room[s] - weight[v]
    for s in np.argsort(room, kind="stable"):
        to_part = links[:, part == s].sum(1)
        free = links[:, part < 0].sum(1)
        taken = links[:, part >= 0].sum(1)
        while True:
            can = (part < 0) & (weight <= room[s])
            if not can.any():
                break
            inner = can & (to_part > 0)
            if inner.any():
                v = int(np.flatnonzero(inner)[np.argmax((2 * to_part - free + noise)[inner])])
            else:  # a new place: at the rim of what is taken, or where least is cut
                rim = can & (taken > 0) if (can & (taken > 0) & (free > 0)).any() else can
                v = int(np.flatnonzero(rim)[np.argmin((free + noise)[rim])])
            part[v], room[s] = s, room[s] - weight[v]
            to_part, free, taken = to_part + links[:, v], free - links[:, v], taken + links[:, v]
            if room[s] <= 0:
                break
    return part


def _moved(part: np.ndarray, weight: np.ndarray, links: np.ndarray, capacity: list[int], passes: int = 12) -> np.ndarray:
    n, k = len(weight), len(capacity)
    if not n or k < 2 or not links.any():
        return part
    cap = np.array(capacity)
    placed = np.flatnonzero(part >= 0)
    slack = int(weight[placed].min()) if len(placed) else 0
    for _ in range(passes):
        now, locked = part.copy(), part < 0
        to = np.zeros((n, k))
        for s in range(k):
            to[:, s] = links[:, now == s].sum(1)
        used = np.array([weight[now == s].sum() for s in range(k)])
        total = gained = 0.0
        best, since = part, 0
        for _ in range(min(len(placed), 400)):
            gain = to - to[np.arange(n), np.maximum(now, 0)][:, None]
            gain[np.arange(n), np.maximum(now, 0)] = -np.inf
            over = used > cap
            fits = used[None] + weight[:, None] <= cap[None] + (0 if over.any() else slack)
            gain[~fits | locked[:, None]] = -np.inf
            if over.any():  # first back under the capacities
                gain[~over[np.maximum(now, 0)]] = -np.inf
            v, s = divmod(int(gain.argmax()), k)
            if gain[v, s] == -np.inf:
                break
            total += gain[v, s]
            used[now[v]] -= weight[v]
            used[s] += weight[v]
            to[:, now[v]] -= links[:, v]
            to[:, s] += links[:, v]
            now[v], locked[v] = s, True
            since += 1
            if total > gained + 1e-9 and (used <= cap).all():
                gained, best, since = total, now.copy(), 0
            if since > 60:
                break
        if not gained:
            break
        part = best
    return part
