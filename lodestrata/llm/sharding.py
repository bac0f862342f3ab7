"""Sharding by balanced label propagation.

Documents are nodes, links join documents that should share a shard. Linked documents are first
clustered under a size bound, again and again, until the graph of clusters is small enough for the
driver (``coarse.py``); that graph is divided evenly, cutting as few links as it can. Then the
clusters are undone level by level, and on each level nodes move in rounds: linked nodes count
their neighbours' shards in a join and ask to move to the best one; quotas from an 8 x 8 table of
requests and free places say how many of each kind may go, those with most to gain first.
Followers (nodes with a neighbour of more links) and leaders move in turn, so two neighbours don't
swap for ever. A level's rounds end when its cut has not fallen for ``PATIENCE`` of them, with the
best state that there was. Shards may be a little too large meanwhile; then the nodes that lose
least go to shards with room, and a last level of rounds keeps to the exact sizes. At the end documents without links fill every shard to its exact size,
so law ``rows`` holds: counts differ by at most one, whatever the links.

Ranks are never taken in one task: rows are hashed to about sqrt(rows) buckets, numbered inside
and offset by the counts of the buckets before.

Defined results: a null text has size 1 and crc32 0 and, like a null doc_id, no links; equal
texts, the empty one too, are linked by way of their smallest doc_id; repeated rows are rows of
their own, moved together as one node while linked, unless a node fits into no shard: its rows alone
are placed like those without links; other columns are ignored.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .coarse import clusters, contracted, divide
from .store import Scratch

SHARDS = 8
#: Rounds without a smaller cut after which a level ends.
PATIENCE = 2
#: What a shard may have too much while clusters are undone, and rounds in which that is moved away.
SLACK, EVEN_ROUNDS = 0.04, 12
#: Nodes of the graph that the driver divides, at most. A third as many clusters of full size would hold all rows.
COARSEST = 1024
#: Hash slices of equal gain among the movers of one kind; a quota is met to within one slice.
SLICES = 1024
#: A node of more than one row and of more than this part of a shard is heavy.
HEAVY = 64


def numbered(frame: DataFrame, key: list[str], order: list[str | Column], rows: int, name: str) -> DataFrame:
    """A gapless number from 0 in ``name`` for the rows of each ``key`` (the whole frame if none)."""
    buckets = max(1, isqrt(rows))
    frame = frame.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets)).cast("int"))
    group = [*key, "_bucket"]
    sizes = frame.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    total = Window.partitionBy(*(key or [F.lit(0)])).orderBy("_bucket")
    before = sizes.select(*group, (F.sum("_n").over(total) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return frame.withColumn("_inside", inside.cast("long") - 1).join(before, group).withColumn(name, F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def quotas(asked: list[list[int]], free: list[int]) -> list[list[int]]:
    """How many of the rows asking to go from shard i to j may go, for no shard to overflow."""
    n = len(free)
    left, free, go = [list(r) for r in asked], list(free), [[0] * n for _ in range(n)]

    def move(i: int, j: int, k: int) -> None:
        left[i][j] -= k
        go[i][j] += k
        free[i] += k
        free[j] -= k

    for i in range(n):  # swaps need no free place
        for j in range(i):
            k = min(left[i][j], left[j][i])
            move(i, j, k)
            move(j, i, k)
    moved = True
    while moved:  # each move frees a place that another may take
        moved = False
        for i in range(n):
            for j in range(n):
                if i != j and (k := min(left[i][j], free[j])) > 0:
                    move(i, j, k)
                    moved = True
    return go


def both_ways(links: DataFrame) -> DataFrame:
    """Links (a, b) as edges (doc_id, other, w), from either end."""
    ends = links.select(F.col("a").alias("doc_id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("doc_id"), F.col("a").alias("other")))
    return ends.where("doc_id != other").distinct().withColumn("w", F.lit(1).cast("long"))


def propagate(nodes: DataFrame, edges: DataFrame, capacity: list[int], scratch: Scratch, log: list | None = None) -> DataFrame:
    """(doc_id, weight, shard) of nodes after balanced label propagation.

    ``nodes``: doc_id, weight (rows), shard; at most ``capacity`` rows a shard. ``edges``: doc_id,
    other, w, both ways. ``log`` gets (cut, weight that moved) of each round.
    """
    n = len(capacity)
    degree = edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("degree"))
    rank = F.struct(F.col("degree"), F.xxhash64("doc_id").alias("h"))
    ranked = degree.select("doc_id", rank.alias("rank"))
    highest = edges.join(ranked.withColumnsRenamed({"doc_id": "other", "rank": "other_rank"}), "other").groupBy("doc_id").agg(F.max("other_rank").alias("highest"))
    leads = ranked.join(highest, "doc_id").select("doc_id", (F.col("rank") > F.col("highest")).alias("leads"))
    nodes = best_nodes = scratch.keep(nodes.join(leads, "doc_id", "left"), "nodes")
    least, idle, turn = None, 0, 0
    while True:
        votes = edges.join(nodes.select(F.col("doc_id").alias("other"), "shard"), "other").groupBy("doc_id").agg(*(F.sum(F.when(F.col("shard") == s, F.col("w")).otherwise(0)).alias(f"v{s}") for s in range(n)))
        best = F.greatest(*(F.struct(F.col(f"v{s}").alias("votes"), (F.col("shard") == s).alias("stays"), F.xxhash64("doc_id", F.lit(s), F.lit(turn)).alias("h"), F.lit(s).alias("to")) for s in range(n)))
        mine = F.element_at(F.array(*(F.col(f"v{s}") for s in range(n))), F.col("shard") + 1)
        scored = nodes.join(votes, "doc_id").withColumn("best", best)
        scored = scratch.keep(scored.select("doc_id", "weight", "shard", "leads", F.col("best.to").alias("to"), (F.col("best.votes") - mine).alias("gain"), (sum(F.col(f"v{s}") for s in range(n)) - mine).alias("cut")), "scored")
        cut = scored.agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0] // 2
        if least is None or cut < least:
            least, best_nodes, idle = cut, nodes, 0
        else:
            idle += 1
        if not cut or idle >= PATIENCE:
            return best_nodes.select("doc_id", "weight", "shard")
        asks = scored.where(F.col("leads") == bool(turn % 2)).where("gain > 0")
        asks = scratch.keep(asks.withColumn("level", F.least(F.floor(F.log2(F.col("gain").cast("double"))), F.lit(40)).cast("int")).withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(SLICES)).cast("int")), "asks")
        # n * n * 41 * SLICES rows at most, on the driver the sums by slice of the kinds that can't all go
        table = asks.groupBy("shard", "to").agg(F.sum("weight").alias("w")).collect()
        used = {r["shard"]: r["w"] for r in nodes.groupBy("shard").agg(F.sum("weight").alias("w")).collect()}
        asked = [[0] * n for _ in range(n)]
        for r in table:
            asked[r["shard"]][r["to"]] = r["w"]
        go = quotas(asked, [c - used.get(s, 0) for s, c in enumerate(capacity)])
        moved = 0
        if any(map(any, go)):
            # rows of one kind in order of gain, whole slices as long as they fit the quota
            order = Window.partitionBy("shard", "to").orderBy(F.desc("level"), "slice")
            slices = asks.groupBy("shard", "to", "level", "slice").agg(F.sum("weight").alias("w")).withColumn("upto", F.sum("w").over(order))
            while True:
                limits = F.create_map(*(x for i in range(n) for j in range(n) for x in (F.lit(i * n + j), F.lit(go[i][j]))))
                fits = slices.where(F.col("upto") <= F.element_at(limits, F.col("shard") * n + F.col("to")))
                # whole slices may leave a bit of a quota, so less may go than was to make room
                go = [[0] * n for _ in range(n)]
                for r in fits.groupBy("shard", "to").agg(F.sum("w").alias("w")).collect():
                    go[r["shard"]][r["to"]] = r["w"]
                over = [used.get(j, 0) + sum(go[i][j] for i in range(n)) - sum(go[j]) - capacity[j] for j in range(n)]
                if max(over) <= 0:
                    break
                for j in range(n):
                    for i in range(n):
                        less = max(0, min(over[j], go[i][j]))
                        go[i][j] -= less
                        over[j] -= less
            accepted = asks.join(fits.select("shard", "to", "level", "slice"), ["shard", "to", "level", "slice"]).select("doc_id", "to")
            new = scratch.keep(nodes.join(accepted, "doc_id", "left").select("doc_id", "weight", F.coalesce("to", "shard").cast("int").alias("shard"), "leads", F.col("to").isNotNull().alias("moved")), "nodes")
            moved = new.where("moved").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
            nodes = new.drop("moved")
            over = [r for r in nodes.groupBy("shard").agg(F.sum("weight").alias("w")).collect() if r["w"] > capacity[r["shard"]]]
            if over:
                raise RuntimeError(f"shards over capacity: {over}")
        if log is not None:
            log.append((cut, moved))
        turn += 1


def even_start(nodes: DataFrame, target: list[int]) -> DataFrame:
    """(doc_id, weight, shard) of whole nodes, at most ``target`` rows a shard; nodes that don't fit are left out.

    Heavy nodes come first, the heaviest into the emptiest shard. The others follow by their sum of
    weights, in proportion to what is left; of those on a border, one for each, the same is done.
    """
    shards, room = len(target), list(target)
    place: dict[int, int] = {}

    def fit(some: list) -> None:
        for r in sorted(some, key=lambda r: (-r["weight"], r["doc_id"])):
            s = max(range(shards), key=lambda s: room[s])
            if r["weight"] <= room[s]:
                room[s] -= r["weight"]
                place[r["doc_id"]] = s

    is_heavy = (F.col("weight") > 1) & (F.col("weight") * HEAVY > sum(target) // shards)
    fit(nodes.where(is_heavy).select("doc_id", "weight").collect())  # some HEAVY * shards at most
    light = nodes.where(~is_heavy).select("doc_id", "weight")
    count, weight = light.agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    space, border, upto = sum(room), [], 0
    for s in range(shards):
        upto += room[s]
        border.append(min(weight, space) * upto // max(space, 1))
    light = light.withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, isqrt(count)))).cast("int"))
    sums = light.groupBy("_bucket").agg(F.sum("weight").alias("_w"))
    before = sums.select("_bucket", (F.sum("_w").over(Window.orderBy("_bucket")) - F.col("_w")).alias("_before"))
    light = light.withColumn("_inside", F.sum("weight").over(Window.partitionBy("_bucket").orderBy("doc_id"))).join(before, "_bucket")
    end = F.col("_before") + F.col("_inside")
    shard_of = lambda last: F.aggregate(F.array(*map(F.lit, border)), F.lit(0), lambda n, b: n + (b < last).cast("int"))
    light = light.select("doc_id", "weight", shard_of(end).alias("shard"), shard_of(end - F.col("weight") + 1).alias("first"))
    whole = (F.col("first") == F.col("shard")) & (F.col("shard") < shards)
    for r in light.where(whole).groupBy("shard").agg(F.sum("weight").alias("w")).collect():
        room[r["shard"]] -= r["w"]
    fit(light.where(~whole & (F.col("first") < shards)).select("doc_id", "weight").collect())  # one for each border
    out = light.where(whole).select("doc_id", "weight", "shard")
    if place:
        chosen = nodes.sparkSession.createDataFrame(list(place.items()), "doc_id long, shard int")
        out = out.unionByName(nodes.join(F.broadcast(chosen), "doc_id").select("doc_id", "weight", "shard"))
    return out


def _room(placed: DataFrame, target: list[int]) -> list[int]:
    used = {r["shard"]: r["w"] for r in placed.where("shard is not null").groupBy("shard").agg(F.sum("weight").alias("w")).collect()}
    return [n - used.get(s, 0) for s, n in enumerate(target)]


def _coarsest(nodes: DataFrame, edges: DataFrame, target: list[int], scratch: Scratch) -> DataFrame:
    """(doc_id, weight, shard) of the last level's nodes; those that fit nowhere are left out."""
    linked = edges.select("doc_id").distinct()
    heavy = nodes.where((F.col("weight") > 1) & (F.col("weight") * HEAVY > sum(target) // len(target)))  # some HEAVY * shards at most
    if linked.count() > COARSEST:  # clusters don't grow any more: an even start, and what the rounds make of it
        return even_start(nodes, target)
    rows = nodes.join(linked, "doc_id", "left_semi").unionByName(heavy.join(linked, "doc_id", "left_anti")).orderBy("doc_id").collect()
    at = {r["doc_id"]: i for i, r in enumerate(rows)}
    links = np.zeros((len(rows), len(rows)))
    for r in edges.collect():  # COARSEST ** 2 at most
        links[at[r["doc_id"]], at[r["other"]]] = r["w"]
    part = divide(np.array([r["weight"] for r in rows], np.int64), links, target)
    chosen = nodes.sparkSession.createDataFrame([(r["doc_id"], r["weight"], int(s)) for r, s in zip(rows, part, strict=True) if s >= 0], "doc_id long, weight long, shard int")
    chosen = scratch.keep(chosen, "coarsest")
    tried = nodes.sparkSession.createDataFrame([(r["doc_id"],) for r in rows], "doc_id long")
    return chosen.unionByName(even_start(nodes.join(F.broadcast(tried), "doc_id", "left_anti"), _room(chosen, target)))


def evened(nodes: DataFrame, edges: DataFrame, target: list[int], scratch: Scratch) -> DataFrame:
    """(doc_id, weight, shard) with at most ``target`` rows a shard: the nodes that lose least go where there is room; those that still are too many are left out."""
    n = len(target)
    for turn in range(EVEN_ROUNDS + 1):
        room = _room(nodes, target)
        over, free = [max(0, -r) for r in room], [max(0, r) for r in room]
        if not any(over):
            break
        votes = edges.join(nodes.select(F.col("doc_id").alias("other"), "shard"), "other").groupBy("doc_id").agg(*(F.sum(F.when(F.col("shard") == s, F.col("w")).otherwise(0)).alias(f"v{s}") for s in range(n)))
        vote = lambda s: F.coalesce(F.col(f"v{s}"), F.lit(0).cast("long"))
        best = F.greatest(*(F.struct((F.lit(free[s] > 0)).alias("open"), vote(s).alias("votes"), F.xxhash64("doc_id", F.lit(s)).alias("h"), F.lit(s).alias("to")) for s in range(n)))
        mine = F.element_at(F.array(*(vote(s) for s in range(n))), F.col("shard") + 1)
        much = F.element_at(F.array(*map(F.lit, over)), F.col("shard") + 1)
        asks = nodes.join(votes, "doc_id", "left").where(much > 0).withColumn("best", best)
        asks = asks.select("doc_id", "weight", "shard", F.col("best.to").alias("to"), (mine - F.col("best.votes")).alias("loss"), much.alias("much"))
        asks = scratch.keep(asks.withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(1 << 20)).cast("int")), "even")
        by_loss = lambda *key: Window.partitionBy(*key).orderBy(F.least("loss", F.lit(1 << 20)), "slice")
        if turn == EVEN_ROUNDS:
            # each shard's excess and a node more, taken out
            sums = asks.groupBy("shard", F.least("loss", F.lit(1 << 20)).alias("loss"), "slice", "much").agg(F.sum("weight").alias("w"))
            gone = sums.withColumn("upto", F.sum("w").over(by_loss("shard"))).where(F.col("upto") - F.col("w") < F.col("much"))
            keys = asks.withColumn("loss", F.least("loss", F.lit(1 << 20))).join(gone.select("shard", "loss", "slice"), ["shard", "loss", "slice"]).select("doc_id")
            return scratch.keep(nodes.join(keys, "doc_id", "left_anti"), "evened")
        some = asks.where(F.col("weight") <= F.col("much")).withColumn("loss", F.least("loss", F.lit(1 << 20)))
        sums = some.groupBy("shard", "to", "loss", "slice", "much").agg(F.sum("weight").alias("w"))
        fits = scratch.keep(sums.withColumn("upto", F.sum("w").over(by_loss("shard"))).where(F.col("upto") <= F.col("much")), "fits")
        go = [[0] * n for _ in range(n)]
        for r in fits.groupBy("shard", "to").agg(F.sum("w").alias("w")).collect():
            go[r["shard"]][r["to"]] = r["w"]
        for j in range(n):  # what has no room waits for another round
            left = free[j]
            for i in range(n):
                go[i][j] = min(go[i][j], left)
                left -= go[i][j]
        limits = F.create_map(*(x for i in range(n) for j in range(n) for x in (F.lit(i * n + j), F.lit(go[i][j]))))
        goes = fits.withColumn("upto", F.sum("w").over(by_loss("shard", "to"))).where(F.col("upto") <= F.element_at(limits, F.col("shard") * n + F.col("to")))
        accepted = some.join(goes.select("shard", "to", "loss", "slice"), ["shard", "to", "loss", "slice"]).select("doc_id", "to")
        nodes = scratch.keep(nodes.join(accepted, "doc_id", "left").select("doc_id", "weight", F.coalesce("to", "shard").cast("int").alias("shard")), "evened")
    return nodes


def divided(nodes: DataFrame, edges: DataFrame, target: list[int], scratch: Scratch, log: list | None = None) -> DataFrame:
    """(doc_id, weight, shard) of linked nodes, by levels; nodes that fit into no shard are left out."""
    bound, levels, before = max(2, 3 * sum(target) // COARSEST), [], None
    while (n := edges.select("doc_id").distinct().count()) > COARSEST and (before is None or n < 0.95 * before):
        linked = edges.select("doc_id").distinct()
        label = clusters(nodes.join(linked, "doc_id", "left_semi"), edges, bound, scratch)
        label = scratch.keep(label.unionByName(nodes.join(linked, "doc_id", "left_anti").select("doc_id", "weight", F.col("doc_id").alias("unit"))), "level")
        levels.append((edges, label))
        nodes, edges = contracted(label, edges, scratch)
        before = n
    wide = [t + int(SLACK * t) for t in target] if levels else target
    place = scratch.keep(_coarsest(nodes, edges, target, scratch), "place")
    place = propagate(place, edges.join(place.select("doc_id"), "doc_id", "left_semi").join(place.select(F.col("doc_id").alias("other")), "other", "left_semi"), wide, scratch, log)
    for edges, label in reversed(levels):
        placed = scratch.keep(label.join(place.select(F.col("doc_id").alias("unit"), "shard"), "unit", "left").select("doc_id", "weight", "shard"), "placed")
        lost = placed.where("shard is null").select("doc_id", "weight")
        place = placed.where("shard is not null")
        if not lost.isEmpty():  # clusters that fit nowhere, node by node
            place = place.unionByName(even_start(lost, [max(0, r) for r in _room(placed, wide)]))
        place = scratch.keep(place, "place")
        here = edges.join(place.select("doc_id"), "doc_id", "left_semi").join(place.select(F.col("doc_id").alias("other")), "other", "left_semi")
        here = scratch.keep(here, "edges")
        place = propagate(place, here, wide, scratch, log)
    if levels and min(_room(place, target)) < 0:
        place = evened(place, here, target, scratch)
        place = propagate(place, here, target, scratch, log)
    return place


def shard(rows: DataFrame, links: DataFrame, shards: int = SHARDS, log: list | None = None) -> DataFrame:
    """The rows (with a doc_id) with ``shard``, ``slot`` and under law ``rows``: counts at most one apart.

    ``links``: pairs (a, b) of doc_ids that should share a shard; a link to no row is ignored.
    ``log`` gets (cut, weight that moved) of each round, level by level.
    """
    scratch = Scratch(rows.sparkSession, "sharding")
    # rows that are equal in all that is known of them get a number; however many there are, no task holds them together
    columns = rows.columns
    equal = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_equal"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    told = rows.join(scratch.keep(equal, "equal"), same, "left")
    rows = scratch.keep(told.select(*columns, F.when(F.col("_equal"), F.monotonically_increasing_id() + 1).otherwise(0).alias("row")), "rows")
    total = rows.count()
    target = [total // shards + (s < total % shards) for s in range(shards)]
    ends = scratch.keep(links.where("a != b").select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
    nodes = rows.join(ends, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("weight"))
    nodes = scratch.keep(nodes, "linked")
    edges = both_ways(links).join(nodes.select("doc_id"), "doc_id", "left_semi").join(nodes.select(F.col("doc_id").alias("other")), "other", "left_semi")
    linked = divided(nodes, scratch.keep(edges, "edges"), target, scratch, log) if nodes.take(1) else None
    placed = rows.withColumn("_linked", F.lit(None).cast("int")) if linked is None else rows.join(linked.select("doc_id", F.col("shard").alias("_linked")), "doc_id", "left")
    placed = scratch.keep(placed, "placed")
    have = {r["_linked"]: r["n"] for r in placed.groupBy("_linked").agg(F.count(F.lit(1)).alias("n")).collect()}
    # rows without links fill the shards: those numbered up to each border
    border, upto = [], 0
    for s in range(shards):
        upto += target[s] - have.get(s, 0)
        border.append(upto)
    free = numbered(placed.where("_linked is null"), [], ["doc_id", "row"], have.get(None, 1), "_number")
    fill = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        fill = F.when(F.col("_number") < border[s], F.lit(s)).otherwise(fill)
    done = free.withColumn("shard", fill.cast("int")).drop("_number", "_linked").unionByName(placed.where("_linked is not null").withColumnRenamed("_linked", "shard"))
    return numbered(scratch.keep(done, "done"), ["shard"], ["doc_id", "row"], total, "slot").drop("row")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under law ``rows``; documents of equal texts are linked."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), crc.alias("text_crc32"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    scratch = Scratch(spark, "op2")
    rows = scratch.keep(rows, "documents")
    keyed = rows.where("doc_id is not null and key is not null").select("doc_id", "key")
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).where("a < last").select("key", "a")
    first = scratch.keep(first, "groups")  # read from a table, so that Spark can split a very common text in the join
    links = scratch.keep(keyed.join(first, "key").where("a < doc_id").select("a", F.col("doc_id").alias("b")), "links")
    out = shard(rows.drop("key"), links)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
