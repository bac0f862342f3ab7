"""Encoding and decoding with a merge-type vocabulary of the sentencepiece library.

The vocabulary is the library's; the encoding is ours. Of a text, spaces become U+2581 and one
more goes in front. Its characters are symbols; every two neighbours whose joined text is a piece
stand on an agenda, ordered by the piece's score, then from left to right. The best pair is
joined and its new neighbours go on the agenda, until it is empty. A symbol that is no piece is
written as its UTF-8 bytes' pieces.

Two characters can be joined only if some piece has both, so the characters fall into families
that no piece mixes, U+2581 apart. A text is cut where the family changes and before U+2581
(without cuts if a piece has it behind another character). Each distinct chunk is worked out once
for a while, and what it gives is compared with the library's ids for that chunk, batch by batch.
Decoded texts are compared with the library's as wholes. A difference is an error, as the
vocabulary is then of another kind.

Defined results: null and empty texts are the end id alone, and decode to an empty text; texts of
any length are encoded whole; rows may repeat, and other columns are passed through; an empty
table gives an empty result. A text's own U+2581 is read as a space, as the library does.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .store import small_batches

BLANK = "▁"
#: Characters of text encoded at once, and of distinct chunks that a worker remembers.
BLOCK_CHARS, KNOWN_CHARS = 1 << 20, 1 << 23
#: Symbols whose agenda is a list; more have a heap.
SHORT, _NEVER = 40, float("inf")


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """One U+FFFD for each byte that is in no character."""
    return "�", error.start + 1


codecs.register_error("lodestrata-each-byte", _each_byte)


class Vocabulary:
    """The pieces of a model file: scores of those that text can be joined to, and ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.vocab_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) for i in range(n)]
        normal = [i for i in range(n) if not (special[i] or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {names[i]: i for i in normal}
        self.cost = {names[i]: -lib.get_score(i) for i in normal}
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.end, self.unknown = lib.eos_id(), lib.unk_id()
        # what each id says when decoded
        said = [bytes([int(x[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else x.replace(BLANK, " ").encode() for i, x in enumerate(names)]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_at = np.concatenate([[0], np.cumsum([len(x) for x in said])])
        self.silent = np.array([lib.is_control(i) for i in range(n)])
        self.blank_first = np.array([x.startswith(BLANK) and not s for x, s in zip(names, special, strict=True)])
        # a character that is in no longer piece: behind it the library starts as we do
        self.guard = next(c for c in map(chr, range(9, 0x3000)) if c not in " \r" and not any(c in x for x in self.cost))
        self.lead = lib.encode(self.guard)
        self.cut = re.compile(self._chunk_pattern(), re.S).findall
        self.forget()

    def _chunk_pattern(self) -> str:
        """A chunk: blanks and characters of one family behind them."""
        if any(BLANK in x.lstrip(BLANK) for x in self.cost):
            return ".+"
        family: dict[str, str] = {}

        def head(c: str) -> str:
            while family.setdefault(c, c) != c:
                c = family[c]
            return c

        for piece in self.cost:
            word = piece.lstrip(BLANK)
            for c in word[1:]:
                family[head(c)] = head(word[0])
        members: dict[str, list[str]] = {}
        for c in list(family):
            members.setdefault(head(c), []).append(c)
        groups = ["[" + "".join(map(re.escape, sorted(m))) + "]+" for m in sorted(members.values(), key=len, reverse=True) if len(m) > 1]
        return f"{BLANK}*(?:{'|'.join([*groups, f'[^{BLANK}]'])})|{BLANK}+"

    def forget(self) -> None:
        # chunk -> entry, and the entries' ids one after the other; no chunk stands for the end
        self.code: dict[str, int] = {"": 0}
        self.known_chars, self.flat, self.flat_at = 0, array("i", [self.end]), array("q", [0, 1])

    def chunks(self, text: str) -> list[str]:
        """The parts of a text that no piece reaches across."""
        if not text:
            return []
        return self.cut(BLANK + text.replace(" ", BLANK))

    def symbols(self, chunk: str) -> list[str]:
        """The chunk's characters, joined by the agenda."""
        return self._short(chunk) if len(chunk) <= SHORT else self._long(chunk)

    def _short(self, chunk: str) -> list[str]:
        """A few symbols: the agenda is a list of their pairs' costs from left to right, and the first of the least is next."""
        cost, part = self.cost.get, list(chunk)
        agenda = [cost(a + b, _NEVER) for a, b in itertools.pairwise(part)]
        while agenda and (best := min(agenda)) < _NEVER:
            i = agenda.index(best)
            part[i] = joined = part[i] + part.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(joined + part[i + 1], _NEVER)
            if i:
                agenda[i - 1] = cost(part[i - 1] + joined, _NEVER)
        return part

    def _long(self, chunk: str) -> list[str]:
        """Many symbols: the agenda is a heap of (cost, place, joined)."""
        cost, part = self.cost, list(chunk)
        n = len(part)
        agenda = [(c, i, part[i] + part[i + 1]) for i in range(n - 1) if (c := cost.get(part[i] + part[i + 1])) is not None]
        if not agenda:
            return part
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(agenda)
        while agenda:
            _, i, joined = heapq.heappop(agenda)
            j = after[i]
            # either side may have been joined to something else since
            if j >= n or not part[i] or part[i] + part[j] != joined:
                continue
            part[i], part[j] = joined, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (c := cost.get(both := joined + part[k])) is not None:
                    heapq.heappush(agenda, (c, i, both))
            if (h := before[i]) >= 0 and (c := cost.get(both := part[h] + joined)) is not None:
                heapq.heappush(agenda, (c, h, both))
        return [p for p in part if p]

    def ids_of(self, chunk: str) -> list[int]:
        out: list[int] = []
        for symbol in self.symbols(chunk):
            if (found := self.ids.get(symbol)) is not None:
                out.append(found)
            else:
                out += [self.byte_ids.get(b, self.unknown) for b in symbol.encode()] if self.byte_ids else [self.unknown]
        return out

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks that are new, and compare with the library."""
        if not chunks:
            return
        theirs = self.library.encode([self.guard + c.replace(BLANK, " ") for c in chunks], num_threads=1)
        for chunk, want in zip(chunks, theirs, strict=True):
            got = self.ids_of(chunk)
            if self.lead + got != want:
                raise ValueError(f"the library encodes {chunk[:100]!r} in another way; the vocabulary must be of merge type, with plain normalisation")
            self.code[chunk] = len(self.code)
            self.flat.extend(got)
            self.flat_at.append(len(self.flat))
            self.known_chars += len(chunk)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; border of each text)."""
        values, sizes, a = [], [], 0
        while a < len(texts):
            b, chars = a, 0
            while b < len(texts) and (b == a or chars + len(texts[b]) <= BLOCK_CHARS):
                chars += len(texts[b])
                b += 1
            if self.known_chars > KNOWN_CHARS:
                self.forget()
            parts = [self.chunks(t) for t in texts[a:b]]
            for p in parts:
                p.append("")  # the end
            row = list(itertools.chain.from_iterable(parts))
            self.learn(list(set(row).difference(self.code)))
            codes = np.fromiter(map(self.code.__getitem__, row), np.int64, len(row))
            at = np.frombuffer(self.flat_at, np.int64).copy()
            values.append(gather(np.frombuffer(self.flat, np.int32).copy(), at, codes))
            ends = np.cumsum([len(p) for p in parts])
            total = np.concatenate([[0], np.cumsum(at[codes + 1] - at[codes])])
            sizes.append(np.diff(total[np.concatenate([[0], ends])]))
            a = b
        none = np.zeros(0, np.int32)
        return np.concatenate([none, *values]), np.concatenate([[0], np.cumsum(np.concatenate([none, *sizes]))]).astype(np.int64)

    def decode(self, ids: np.ndarray, border: np.ndarray) -> list[str]:
        """The text of each row of ids; the blank that encoding puts in front goes."""
        data, length = gather(self.said, self.said_at, ids), self.said_at[ids + 1] - self.said_at[ids]
        at = np.concatenate([[0], np.cumsum(length)])[border]
        out = []
        for i in range(len(border) - 1):
            text = data[at[i] : at[i + 1]].tobytes().decode("utf-8", "lodestrata-each-byte")
            row = ids[border[i] : border[i + 1]]
            heard = row[: np.argmin(self.silent[row]) + 1][-1:] if len(row) and not self.silent[row].all() else row[:0]
            out.append(text[1:] if len(heard) and self.blank_first[heard[0]] else text)
        return out


def gather(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """flat[at[r] : at[r + 1]] for each of the rows, one after the other."""
    size = at[rows + 1] - at[rows]
    place = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(rows) else at[:0], size)
    return flat[place + np.arange(len(place))]


@functools.lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(frame: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``frame`` with the ids of ``text`` in place of it, the end id behind them."""
    small_batches(frame.sparkSession)
    rest = [c for c in frame.columns if c not in (text, into)]
    frame = frame.select(*rest, F.col(text).cast("string").alias(text))
    schema = StructType([*frame.drop(text).schema, StructField(into, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            ids, border = words.encode([t or "" for t in batch.column(len(rest)).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*rest, into])

    return frame.mapInArrow(run, schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``frame`` with the text that its ids say, compared with the library's."""
    rest = [c for c in frame.columns if c not in (ids, into)]
    frame = frame.select(*rest, F.col(ids).cast("array<int>").alias(ids))
    schema = StructType([*frame.schema, StructField(into, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            lists = pc.fill_null(batch.column(len(rest)), pa.scalar([], batch.column(len(rest)).type))
            values, border = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = words.decode(values.astype(np.int64), border)
            if texts != words.library.decode([values[a:b].tolist() for a, b in zip(border[:-1], border[1:], strict=True)], num_threads=1):
                raise ValueError("the library decodes some ids in another way")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*rest, ids, into])

    return frame.mapInArrow(run, schema)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, with an end id, and decoded again, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    there = decode(encode(docs, path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return there.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
