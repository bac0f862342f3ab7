"""Structure repair against all edits of small conversations, and a plain chart of strings for longer ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import queries, repair

from ..conftest import same_rows

RIGHT = re.compile("(s?(ua)+)?").fullmatch
GAPS = ["", "u", "a", "uu", "ua", "au", "aa"]


def every_edit(kinds):
    """(cost, audit) of the best of all edits, at most two turns inserted at a place."""
    best = None
    choices = []
    for initial, dearer, gone in kinds:
        row = [(2, "D", "")]
        if not gone:
            row += [(dearer, "K", initial or "?"), (1 + dearer, "R", "u"), (1 + dearer, "R", "a")]
        choices.append([(5 * len(g) + c, "I" * len(g) + e, g + r) for g in GAPS for c, e, r in row])
    for path in itertools.product(*choices, [(5 * len(g), "I" * len(g), g) for g in GAPS]):
        if RIGHT("".join(r for _, _, r in path)):
            found = (sum(c for c, _, _ in path), "".join(e for _, e, _ in path))
            best = found if best is None else min(best, found)
    return best


def plain_chart(kinds):
    """The same with whole strings, for any length."""
    far = (1 << 40, "")
    e, s, u, a = (0, ""), far, (5, "I"), (10, "II")
    for initial, dearer, gone in kinds:
        put = lambda x, c, w: (x[0] + c, x[1] + w)
        read = lambda x, r: far if gone else put(x, dearer + (initial != r), "K" if initial == r else "R")  # noqa: E731, B023
        e, s, u, a = (
            put(e, 2, "D"), min(put(s, 2, "D"), put(e, dearer, "K") if initial == "s" and not gone else far),
            min(put(u, 2, "D"), read(e, "u"), read(s, "u"), read(a, "u")), min(put(a, 2, "D"), read(u, "a")),
        )
        u = min(u, put(e, 5, "I"), put(s, 5, "I"), put(a, 5, "I"))
        a = min(a, put(u, 5, "I"))
    return min(e, a)


def chart(kinds, size=None):
    """By the operator's parser, in parts of ``size`` rows."""
    joined, size = repair.Joined(), size or len(kinds) or 1
    cut = [kinds[i : i + size] for i in range(0, len(kinds), size)]
    for part in cut:
        joined.add({start: repair.parse(part, start)[0] for start in repair.GRAMMAR})
    cost, ways, tail = joined.close()
    out = [x for part, (start, end) in zip(cut, ways, strict=True) for x in repair.edits(part, start, end)]
    return cost, "".join("I" * len(path) + edit for path, edit, _ in out) + "I" * len(tail)


KINDS = st.tuples(st.sampled_from(["s", "u", "a", ""]), st.sampled_from([0, 5]), st.booleans())


@settings(max_examples=40, deadline=None)
@given(st.lists(KINDS, max_size=3))
def test_all_edits(kinds):
    assert chart(kinds) == every_edit(kinds) == plain_chart(kinds)


@settings(max_examples=400, deadline=None)
@given(st.lists(KINDS, max_size=40), st.integers(1, 9))
def test_long_conversations_in_parts(kinds, size):
    assert chart(kinds) == chart(kinds, size) == plain_chart(kinds)


def test_charts_are_few():
    rng = random.Random(5)
    repair.step.cache_clear()
    for _ in range(30):
        kinds = [(rng.choice(["s", "u", "u", "a", ""]), rng.choice([0, 0, 5]), rng.random() < 0.2) for _ in range(2000)]
        assert chart(kinds, 64) == plain_chart(kinds)
    chart([("u", 0, False)] * 20_000, 512)
    assert repair.step.cache_info().currsize < 3000


def brute(rows):
    """conv_id -> what the operator says, from (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv), key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, faults, kinds = set(), [], []
        for _, _, role, text in mine:
            said = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
            seen.add((role, text))
            kinds.append((role[:1] if role[:1] in "sua" else "", 5 if faults[-1] == "truncated" else 0, faults[-1] in ("blank", "duplicate")))
        cost, audit = plain_chart(kinds)
        odd, left, i = len(audit.replace("D", "")) % 2, [], 0
        for edit in audit:
            role = ("user", "assistant")[(len(left) - odd) % 2]
            if edit in "KR":
                left.append((mine[i][2] if edit == "K" else role) + ":" + mine[i][3])
            elif edit == "I":
                left.append(role + ":")
            i += edit != "I"
        turns = [t for known, t, _, _ in mine if known]
        pairs = [x[2][:1] + y[2][:1] for x, y in itertools.pairwise(mine)]
        count = faults.count
        out[conv] = (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "PART_ROWS", 7)
    rng = random.Random(6)
    texts = ["", " \t", None, "Yes.", "no", "So? ", "Well!\n", "x" * 300_000, "é."]
    rows = [(1, None, None, None), (None, 0, "user", "a."), (None, None, "assistant", "b."), (2, 0, "tool", "t."), (2, 0, "tool", "t."), (3, 5, "system", "s."), (4, None, "", "x.")]
    for conv in range(10, 30):
        for _ in range(rng.randint(1, 40)):
            rows.append((conv, rng.choice([None, *range(12)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice([*texts, f"{rng.randint(0, 20)}.", f"{rng.randint(0, 20)}."])))
    rows += [(99, i, "user", f"{i}.") for i in range(500)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit("clash").alias("part"), F.lit(1).alias("edit")).repartition(3)
    fixed = repair.repair(frame)
    got = {r["conv_id"]: tuple(r) for r in repair.digests(fixed).collect()}
    assert got == brute(rows)
    left = repair.repaired(fixed).orderBy("conv_id", "part", "place").collect()
    roles = {}
    for r in left:
        roles.setdefault(r["conv_id"], []).append(r["role"][0])
    assert all(RIGHT("".join(r)) for r in roles.values()) and len(roles[99]) == 500
    assert repair.digests(repair.repair(frame.limit(0))).count() == 0


def test_a_conversation_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(repair, "PART_ROWS", 50)
    rng = random.Random(7)
    rows = [(5, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["", "go", f"{i}.", f"{i % 40}!"])) for i in range(3000)] + [(6, 0, "user", "q?"), (4, 1, "assistant", "a.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = repair.parts(frame).where("conv_id = 5").select((F.col("part") / (1 << 33)).cast("int").alias("task")).distinct().count()
        got = {r["conv_id"]: tuple(r) for r in repair.digests(repair.repair(frame)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cut > 1 and got == brute(rows)


def test_query(spark, sf_dir, connection):
    same_rows(queries.QUERIES["op11_structure_repair"](spark, sf_dir), connection, queries.ORACLES["op11_structure_repair"])
