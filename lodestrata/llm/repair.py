"""Repair of conversations' structure by an error-correcting Earley parser with weights.

The grammar's nonterminals say what the turns up to a place form: nothing, an opening system
turn, an open question, an answered one. Each production is a nonterminal and one more role, so
every item of the chart begins at the conversation's start and a chart set has one item for each
nonterminal at most. Error productions delete a row, give it another role, or insert a turn. An
item keeps its least (cost, audit); the audit is the edits' initials. Two items of a set are told
apart by the order of their audits alone, so a set holds small numbers, and pointers to the set
before it spell the audit when the chart is complete. Two laws make that right: what an audit
costs follows from its letters, so of two audits of one cost neither begins the other; and behind
one set two audits differ at the last row that they share, or one has inserted turns behind it.

A set depends on the one before but for its costs' sum, and on the row's kind; sets are few, and a
step between two is worked out once. Items that can't win any more leave a set (``STANDS_IN``).

Conversations are sorted by ranges, so one of any length lies in several tasks. Each task cuts its
rows into parts of bounded size and parses a part from each nonterminal it may start at. The
parts' results, a few numbers each, are put together conversation by conversation, which tells
where the best parse enters and leaves each part; then the parts are parsed again, and give the
repaired turns.

Defined results: null roles and texts are one space; rows are ordered by turn (nulls first), role
and text, and repeated rows are rows of their own (the second is a duplicate); rows with a null
conv_id form one conversation; turns of any role may occur, only the first letter of a role
counts; texts may have any length; other columns are ignored; an empty table gives an empty
result. Among the parts' rows those of equal conv_id, turn and role stay in one task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, small_batches

#: Nonterminal -> (nonterminal before, role) of its productions.
GRAMMAR: dict[str, tuple[tuple[str, str], ...]] = {
    "empty": (),
    "opened": (("empty", "system"),),
    "asked": (("empty", "user"), ("opened", "user"), ("answered", "user")),
    "answered": (("asked", "assistant"),),
}
FINAL = ("empty", "answered")
#: Roles that an edit can give.
GIVEN = ("user", "assistant")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: (a, b, c): whatever follows ``a``, ``b`` and c more can have it too, so an ``a`` dearer than that is no use.
#: Behind "answered" an opening system turn is deleted instead; behind "opened" comes a question, as behind "answered".
STANDS_IN = (("empty", "answered", DELETE), ("opened", "answered", 0))
#: Rows and characters of texts in a part, at most (one longer text is a part of its own).
PART_ROWS, PART_CHARS = 1024, 1 << 20

_NAMES = tuple(GRAMMAR)
_ROLE = {name: productions[0][1] for name, productions in GRAMMAR.items() if productions}
_INITIALS = {role[0] for role in _ROLE.values()}

#: (nonterminal, cost, order of the audit) of a set's items; and the row's (initial, dearer if kept, to be deleted).
Set = tuple[tuple[str, int, int], ...]
Kind = tuple[str, int, bool]


def inserted(items: Set) -> dict[str, tuple[int, int, tuple[str, ...], str]]:
    """A set with inserted turns: nonterminal -> (cost, order, nonterminals inserted, item it comes from), the least."""
    best = {name: (cost, order, (), name) for name, cost, order in items}
    changed = True
    while changed:
        changed = False
        for into, productions in GRAMMAR.items():
            for before, role in productions:
                if role in GIVEN and before in best:
                    cost, order, path, base = best[before]
                    new = (cost + INSERT, order, (*path, into), base)
                    if into not in best or _least(new) < _least(best[into]):
                        best[into], changed = new, True
    return best


def _least(item: tuple[int, int, tuple[str, ...], str]) -> tuple[int, int, str]:
    return item[0], item[1], "I" * len(item[2])


@functools.lru_cache(1 << 14)
def step(items: Set, kind: Kind) -> tuple[int, Set, dict[str, tuple[str, tuple[str, ...], str]]]:
    """The set behind one more row: (cost to add to its items, items, nonterminal -> (item before, inserted, edit))."""
    initial, dearer, gone = kind
    best: dict = {}

    def offer(name: str, cost: int, edit: str, item: tuple) -> None:
        key = (cost, item[1], "I" * len(item[2]) + edit)
        if name not in best or key < best[name][0]:
            best[name] = (key, (item[3], item[2], edit))

    before = inserted(items)
    for name, item in before.items():
        offer(name, item[0] + DELETE, "D", item)
    for into, productions in GRAMMAR.items() if not gone else ():
        for left, role in productions:
            if left in before:
                item = before[left]
                if role[0] == initial:
                    offer(into, item[0] + dearer, "K", item)
                elif role in GIVEN:
                    offer(into, item[0] + dearer + REROLE, "R", item)
    ranked = {name: i for i, name in enumerate(sorted(best, key=lambda n: best[n][0][1:]))}
    new = tuple((name, best[name][0][0], ranked[name]) for name in _NAMES if name in best)
    cheap = {name: item[0] for name, item in inserted(new).items()}
    # an item that inserting reaches for less, or that another stands in for, is no use
    new = tuple(i for i in new if i[1] <= cheap[i[0]] and not any(i[0] == a and b in cheap and cheap[b] + c < i[1] for a, b, c in STANDS_IN))
    least = min(i[1] for i in new)
    order = {rank: i for i, rank in enumerate(sorted(i[2] for i in new))}
    return least, tuple((name, cost - least, order[rank]) for name, cost, rank in new), {name: best[name][1] for name, _, _ in new}


def parse(kinds: list[Kind], start: str) -> tuple[dict[str, tuple[int, int]], list[dict]]:
    """The chart of a part that ``start`` stands before: (nonterminal -> (cost, order) at the end, pointers of each row)."""
    items, total, pointers = ((start, 0, 0),), 0, []
    for kind in kinds:
        more, items, back = step(items, kind)
        total += more
        pointers.append(back)
    return {name: (total + cost, order) for name, cost, order in items}, pointers


def edits(kinds: list[Kind], start: str, end: str) -> list[tuple[tuple[str, ...], str, str]]:
    """For each row of a part: (nonterminals inserted before it, edit, nonterminal behind it)."""
    out = []
    for back in reversed(parse(kinds, start)[1]):
        before, path, edit = back[end]
        out.append((path, edit, end))
        end = before
    return out[::-1]


class Joined:
    """A conversation's parts, one after the other: the least (cost, audit) up to each nonterminal."""

    def __init__(self):
        self.items: dict[str, tuple[int, int]] = {"empty": (0, 0)}
        self.back: list[dict[str, str]] = []

    def add(self, moves: dict[str, dict[str, tuple[int, int]]]) -> None:
        """``moves``: from nonterminal -> to nonterminal -> (cost, order) of the next part."""
        best: dict = {}
        for start, (cost, order) in self.items.items():
            for end, (more, rank) in moves[start].items():
                key = (cost + more, order, rank)
                if end not in best or key < best[end][0]:
                    best[end] = (key, start)
        order = {name: i for i, name in enumerate(sorted(best, key=lambda n: best[n][0][1:]))}
        self.items = {name: (key[0], order[name]) for name, (key, _) in best.items()}
        self.back.append({name: start for name, (_, start) in best.items()})

    def close(self) -> tuple[int, list[tuple[str, str]], tuple[str, ...]]:
        """(cost, nonterminals before and behind each part, those inserted at the end)."""
        done = inserted(tuple((name, cost, order) for name, (cost, order) in self.items.items()))
        cost, _, tail, end = min((done[name] for name in FINAL if name in done), key=_least)
        ways = []
        for back in reversed(self.back):
            ways.append((back[end], end))
            end = back[end]
        return cost, ways[::-1], tail


def faulty(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, blank, again (an earlier turn of the conversation has role and text), truncated."""
    text = F.col("text")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    said = F.rtrim(text, F.lit(" \t\n\x0b\f\r"))
    rows = rows.withColumns({"blank": said == "", "truncated": ~F.right(said, F.lit(1)).isin(".", "!", "?"), "_said": F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))})
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # nulls first
    several = rows.groupBy("conv_id", "_said").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    several = several.select(F.col("conv_id").alias("_conv"), F.col("_said").alias("_again"), F.col("first").alias("_first"))
    rows = rows.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_again")), "left")
    return rows.select("conv_id", "turn", "role", "text", "blank", F.coalesce(F.col("_first") < place, F.lit(False)).alias("again"), "truncated")


_LINE = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])
_PART = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("lines", pa.list_(_LINE)), ("moves", pa.list_(pa.int64())), ("first_initial", pa.string()), ("last_initial", pa.string()), ("illegal", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("min_turn", pa.int64()), ("max_turn", pa.int64()), ("turns", pa.int64())])
_PART_SQL = "conv_id long, part long, lines array<struct<turn:bigint,role:string,text:string,fault:string>>, moves array<bigint>, first_initial string, last_initial string, illegal long, blank long, duplicate long, truncated long, min_turn long, max_turn long, turns long"


def _kind(line: dict) -> Kind:
    initial = line["role"][:1]
    return (initial if initial in _INITIALS else "", TRUNCATED if line["fault"] == "truncated" else 0, line["fault"] in ("blank", "duplicate"))


def _illegal(before: str, behind: str) -> bool:
    return before + behind not in ("su", "ua", "au")


def _summary(lines: list[dict]) -> dict:
    """What the joining of parts needs of one: its parses from each nonterminal, counts, and what lies at its borders."""
    kinds = [_kind(x) for x in lines]
    initials = [x["role"][:1] for x in lines]
    turns = [x["turn"] for x in lines if x["turn"] is not None]
    moves = [-1] * (2 * len(_NAMES) ** 2)
    for i, start in enumerate(_NAMES):
        for end, (cost, order) in parse(kinds, start)[0].items():
            at = 2 * (i * len(_NAMES) + _NAMES.index(end))
            moves[at : at + 2] = cost, order
    count = lambda fault: sum(x["fault"] == fault for x in lines)
    return {
        "moves": moves, "first_initial": initials[0], "last_initial": initials[-1], "illegal": sum(map(_illegal, initials, initials[1:])), "blank": count("blank"), "duplicate": count("duplicate"),
        "truncated": count("truncated"), "min_turn": min(turns, default=None), "max_turn": max(turns, default=None), "turns": len(set(turns)),
    }


def _moves(flat: list[int]) -> dict[str, dict[str, tuple[int, int]]]:
    n = len(_NAMES)
    return {a: {b: (flat[k], flat[k + 1]) for j, b in enumerate(_NAMES) if flat[k := 2 * (i * n + j)] >= 0} for i, a in enumerate(_NAMES)}


def parts(turns: DataFrame) -> DataFrame:
    """The conversations, sorted and cut into parts of bounded size, numbered in order, with their summaries."""
    small_batches(turns.sparkSession)
    rows = faulty(turns).repartitionByRange("conv_id", "turn", F.left("role", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, conv, last, lines, chars = TaskContext.get().partitionId() << 33, None, None, [], 0

        def part() -> list[dict]:
            nonlocal number, lines, chars
            made = [{"conv_id": conv, "part": number, "lines": lines, **_summary(lines)}] if lines else []
            number, lines, chars = number + 1, [], 0
            return made

        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "blank", "again", "truncated")), strict=True):
                key, turn, role, text, blank, again, truncated = row
                if lines and (key != conv or len(lines) >= PART_ROWS or chars + len(text) > PART_CHARS):
                    out += part()
                conv, chars = key, chars + len(text)
                fault = "blank" if blank else "duplicate" if again or row[:4] == last else "truncated" if truncated else None
                lines.append({"turn": turn, "role": role, "text": text, "fault": fault})
                last = row[:4]
            yield pa.RecordBatch.from_pylist(out, _PART)
        yield pa.RecordBatch.from_pylist(part(), _PART)

    return rows.mapInArrow(run, _PART_SQL)


_WAY = pa.schema([("part", pa.int64()), ("enters", pa.string()), ("leaves", pa.string()), ("tail", pa.list_(pa.string())), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))])
_WAY_SQL = "part long, enters string, leaves string, tail array<string>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def ways(cut: DataFrame) -> DataFrame:
    """For each part where the best parse enters and leaves it; a conversation's last part also has its counts and cost."""
    rows = cut.drop("lines").repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, joined, numbers, told, edge = None, None, [], {}, None

        def close() -> Iterator[pa.RecordBatch]:
            cost, through, tail = joined.close()
            rows = [{"part": n, "enters": a, "leaves": b} for n, (a, b) in zip(numbers, through, strict=True)]
            low, high = told.pop("min_turn"), told.pop("max_turn")
            rows[-1] |= {"tail": list(tail), "cost": cost, "gaps": 0 if low is None else high - low + 1 - told["turns"]} | {c: told[c] for c in ("blank", "duplicate", "truncated", "illegal")}
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], _WAY)

        for batch in batches:
            for row in batch.to_pylist():
                if joined is None or row["conv_id"] != conv:
                    if joined is not None:
                        yield from close()
                    conv, joined, numbers, edge = row["conv_id"], Joined(), [], None
                    told = dict.fromkeys(("illegal", "blank", "duplicate", "truncated", "turns"), 0) | {"min_turn": None, "max_turn": None}
                joined.add(_moves(row["moves"]))
                numbers.append(row["part"])
                for c in ("illegal", "blank", "duplicate", "truncated", "turns"):
                    told[c] += row[c]
                told["illegal"] += edge is not None and _illegal(edge, row["first_initial"])
                edge = row["last_initial"]
                if row["min_turn"] is not None:
                    told["turns"] -= row["min_turn"] == told["max_turn"]  # a turn on both sides of the border
                    told["min_turn"] = row["min_turn"] if told["min_turn"] is None else told["min_turn"]
                    told["max_turn"] = row["max_turn"]
        if joined is not None:
            yield from close()

    return rows.mapInArrow(run, _WAY_SQL)


_EDIT = pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("was", pa.string()), ("fault", pa.string())])
EDITS = "array<struct<edit:string,turn:bigint,role:string,text:string,was:string,fault:string>>"


def repair(turns: DataFrame) -> DataFrame:
    """A row for each part: conv_id, part (in order), ``edits`` (edit, turn, role, text, was: the old role, fault) in order; a conversation's last part has gaps, blank, duplicate, truncated, illegal and cost, others null.

    Of the edits K and R keep a row, D is a deleted one, I an inserted turn without text.
    """
    cut = Scratch(turns.sparkSession, "repair").keep(parts(turns), "parts")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = cut.select("conv_id", "part", "lines").join(ways(cut), "part").select("conv_id", "part", "lines", "enters", "leaves", "tail", *counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = lambda name: {"edit": "I", "role": _ROLE[name], "text": ""}
        for batch in batches:
            lists = []
            for lines, enters, leaves, tail in zip(*(batch.column(c).to_pylist() for c in ("lines", "enters", "leaves", "tail")), strict=True):
                out = []
                for line, (path, edit, name) in zip(lines, edits([_kind(x) for x in lines], enters, leaves), strict=True):
                    out += map(new, path)
                    out.append(line | {"edit": edit, "was": line["role"]} | ({"role": _ROLE[name]} if edit == "R" else {}))
                lists.append(out + list(map(new, tail or ())))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(lists, pa.list_(_EDIT)), *(batch.column(c) for c in counts)], ["conv_id", "part", "edits", *counts])

    return found.mapInArrow(run, f"conv_id long, part long, edits {EDITS}, {', '.join(f'{c} long' for c in counts)}")


def repaired(repairs: DataFrame) -> DataFrame:
    """conv_id, part, place, turn, role, text of the turns that a repair leaves, in order by part and place."""
    lines = repairs.select("conv_id", "part", F.posexplode(F.filter("edits", lambda e: e["edit"] != "D")).alias("place", "e"))
    return lines.select("conv_id", "part", "place", "e.turn", "e.role", "e.text")


_DIGEST = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def digests(repairs: DataFrame) -> DataFrame:
    """conv_id, counts, cost, audit and repaired_sha256 (of the repaired ``role:text``, joined by newlines) of each conversation; its parts stream past."""
    left = F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    rows = repairs.select("conv_id", "part", F.array_join(F.transform("edits", lambda e: e["edit"]), "").alias("audit"), F.when(F.size(left) > 0, F.array_join(left, "\n")).alias("text"), *_DIGEST.names[1:7])
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, said, some = [], hashlib.sha256(), False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                audit.append(row["audit"])
                if row["text"] is not None:
                    said.update((("\n" if some else "") + row["text"]).encode())
                    some = True
                if row["cost"] is not None:  # the conversation's last part
                    out.append({c: row[c] for c in _DIGEST.names[:7]} | {"audit": "".join(audit), "repaired_sha256": said.hexdigest()})
                    audit, said, some = [], hashlib.sha256(), False
            yield pa.RecordBatch.from_pylist(out, _DIGEST)

    return rows.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with faults planted by a rule on conv_id and turn: dropped, emptied, without sentence ends, repeated, said by the user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key.cast("binary")) % 20).alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.array_repeat(F.lit(0), F.when(F.col("d") == 3, 2).otherwise(1)).alias("times"))
    return rows.withColumn("times", F.explode("times")).drop("times")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged, with their faults, the cheapest repair and a digest of what it gives."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    told = digests(repair(damaged(turns)))
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = every.join(told.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
