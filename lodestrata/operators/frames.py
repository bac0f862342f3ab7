"""Streamed answers: event frames of a model server put together again.

A frame ends with a blank line. Frames without the ``data: `` mark and frames that hold no valid
JSON are skipped; a frame with ``stop`` still counts and is the last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contents(stream: Column) -> Column:
    """array<struct<content, stop>> of the frames that count, from a stream's whole text."""
    frames = F.filter(F.split(stream, "\n\n"), lambda f: F.ltrim(f).startswith("data: "))
    parsed = F.transform(frames, lambda f: F.from_json(F.substring(F.ltrim(f), 7, 1 << 30), "content string, stop boolean", {"mode": "PERMISSIVE"}))
    good = F.filter(parsed, lambda p: p["content"].isNotNull())
    stop = F.array_position(F.transform(good, lambda p: F.coalesce(p["stop"], F.lit(False))), True).cast("int")
    return F.when(stop > 0, F.slice(good, F.lit(1), F.greatest(stop, F.lit(1)))).otherwise(good)


def answer(stream: Column) -> Column:
    """The contents up to the stop, in order."""
    return F.array_join(F.transform(contents(stream), lambda p: p["content"]), "")
