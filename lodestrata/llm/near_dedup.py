"""MinHash near-dedup with HyperMinHash registers.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit
   fingerprint of the set, and ``REGISTERS`` HyperMinHash registers: a shingle's hash picks a
   register, which keeps the rarest hash seen as a leading-zero count and some mantissa bits.
2. Documents of equal sets are one class; only its representative goes on.
3. Empty registers are filled from others of the document (optimal densification), so bands of
   small sets are as selective as those of large ones. Bands are hashed, and documents that
   share a band form a bucket. In each bucket the member with most collisions is the hub, and
   the others are candidates with it. The collision-corrected estimate of the Jaccard
   similarity rules out pairs that are far off; the rest are confirmed on the full sets.
4. Buckets make families: a member joins its hub's, unless their estimate is under ``FAR``. Such
   members came by chance and are paired with those they may be linked to. (Jaccard distance is a
   metric: two linked documents differ by at most 0.2 in their distance to a hub.)
5. In a family whose confirmed links leave several components, every document outside the largest
   one is compared exactly with all others of the family, block by block, and only links between
   components come out. So no pair that shares a band goes unseen, and no pairs are expanded.

With 6 registers a band and 64 bands, a pair of similarity 0.8 shares no band with probability
(1 - 0.8**6)**64 < 4e-9.

Defined results: null, empty and wordless texts have an empty set, are linked with nothing and
are kept; rows with a null doc_id are kept unlinked; rows with one doc_id are one node; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .components import connected_components, joined_components
from .store import Scratch, lean, small_batches

BAND_ROWS, BANDS = 6, 64
REGISTERS = BAND_ROWS * BANDS
MANTISSA_BITS = 10
#: Candidate pairs whose estimate lies this many standard errors under the threshold are ruled out.
SIGMAS = 6.0
#: Candidates whose similarity is at most this are of different families.
FAR = 0.45
#: Sets in a block of an exact comparison, about.
BLOCK_SETS = 1024
#: Up to so many document ids are broadcast to a scan; more are joined.
BROADCAST_IDS = 1_000_000

_U = np.uint64


def shingle_hashes(block: words.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of k words; a shorter document has its whole sequence."""
    runs = words.run_hashes(block.hash, k)
    at = words.run_starts(block.first, k)
    document = block.document()
    n = np.diff(block.first)
    hashes, owner = [runs[at]], [document[at]]
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            hashes.append(words.run_hashes(block.hash, size, salt=size)[block.first[short]])
            owner.append(short)
    return np.concatenate(hashes), np.concatenate(owner)


def distinct_by_document(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, hash) pairs, sorted by both."""
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order], kind="stable")]
    h, d = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def registers(hashes: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """HyperMinHash registers (uint16, 0 = empty): larger means a smaller hash.

    The value holds the leading-zero count, then the complement of the mantissa bits behind the
    first one bit, so the largest value is the smallest hash of the register.
    """
    bucket = ((hashes >> _U(32)) * _U(REGISTERS)) >> _U(32)
    tail = words.mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5))
    # the exponent of a double is its leading bit; 53 bits are enough and convert exactly
    top = (tail >> _U(11)) | _U(1)
    _, exponent = np.frexp(top.astype(np.float64))
    zeros = (53 - exponent).astype(np.int64)
    mantissa = (top << (zeros + 1).astype(np.uint64) & _U((1 << 53) - 1)) >> _U(53 - MANTISSA_BITS)
    value = ((zeros << MANTISSA_BITS) + ((1 << MANTISSA_BITS) - 1 - mantissa.astype(np.int64)) + 1).astype(np.uint16)
    out = np.zeros(n_docs * REGISTERS, np.uint16)
    np.maximum.at(out, owner * REGISTERS + bucket.astype(np.int64), value)
    return out.reshape(n_docs, REGISTERS)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected Jaccard estimate, standard error bound) for rows of registers.

    Registers of disjoint sets agree by chance where leading zeros and mantissa coincide. For a
    register with rate x of shingles on either side the chance is about 2**-MANTISSA_BITS times
    the chance that both have the same leading zeros; its expected number is taken off.
    """
    either = (a != 0) | (b != 0)
    same = either & (a == b)
    filled = either.sum(1)
    ra, rb = na / REGISTERS, nb / REGISTERS
    chance = np.zeros(len(a))
    for z in range(40):
        hi, lo = 2.0**-z, 2.0 ** -(z + 1)
        # the register's smallest hash lies in [lo, hi): no shingle below lo, one below hi
        chance += (np.exp(-ra * lo) - np.exp(-ra * hi)) * (np.exp(-rb * lo) - np.exp(-rb * hi))
    chance *= 2.0**-MANTISSA_BITS * REGISTERS
    filled = np.maximum(filled, 1)
    j = np.clip((same.sum(1) - chance) / np.maximum(filled - chance, 1), 0, 1)
    return j, 0.5 / np.sqrt(filled) + 1.0 / filled


def _binary_rows(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * matrix.itemsize
    offsets = pa.py_buffer((np.arange(len(matrix) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, offsets, pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), registers (binary; null for an empty set)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(1), lower=True):
                h, d = distinct_by_document(*shingle_hashes(block, shingle))
                n_docs = len(block.rows)
                count = np.bincount(d, minlength=n_docs)
                sums = []
                for salt in (1, 2):
                    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(h + _U(salt)))])
                    border = np.searchsorted(d, np.arange(n_docs + 1))
                    sums.append((upto[border[1:]] - upto[border[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(block.rows)), pa.array(count, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), _binary_rows(registers(h, d, n_docs))],
                    ["doc_id", "n_shingles", "f1", "f2", "registers"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_shingles long, f1 long, f2 long, registers binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(words.buffers(column)[1], np.uint16, len(column) * REGISTERS, int(words.buffers(column)[0][0])).reshape(-1, REGISTERS)


#: The register that an empty one looks at in each attempt.
_ATTEMPTS = 48
_LOOK = (words.mix(np.arange(_ATTEMPTS * REGISTERS, dtype=np.uint64) + _U(1 << 40)) % _U(REGISTERS)).astype(np.int64).reshape(_ATTEMPTS, REGISTERS)


def densified(regs: np.ndarray) -> np.ndarray:
    """The registers with each empty one filled from another of its row, chosen by hash.

    Small sets leave most registers empty, and a band of one filled register would match all
    sets with one common shingle. An empty register takes the first filled one in its own order
    of all registers, which is equal in two sets with the probability of their similarity.
    """
    out = regs.copy()
    todo = np.flatnonzero((out == 0).any(1) & (regs != 0).any(1))
    for look in _LOOK:
        if not len(todo):
            return out
        have = out[todo]
        have = np.where(have == 0, regs[todo][:, look], have)
        out[todo] = have
        todo = todo[(have == 0).any(1)]
    for row in todo.tolist():  # few registers filled: all of them are looked at
        filled, empty = np.flatnonzero(regs[row]), np.flatnonzero(out[row] == 0)
        order = words.mix((empty[:, None] * REGISTERS + filled[None, :]).astype(np.uint64) + _U(1 << 41))
        out[row, empty] = regs[row, filled[order.argmin(1)]]
    return out


def band_keys(sketch: DataFrame) -> DataFrame:
    """(key, doc_id) for each band of the densified registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = densified(_matrix(batch.column(1))).reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), regs.shape[:2])
            for i in range(BAND_ROWS):
                key = words.mix(key * _U(0x9E3779B97F4A7C15) + regs[:, :, i])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(regs)), BANDS)))], ["key", "doc_id"])

    return sketch.select("doc_id", "registers").mapInArrow(lean(run), "key long, doc_id long")


def estimated(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs (a, b) with bounds ``low`` and ``high`` on their similarity by the registers."""
    side = lambda x: sketch.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            j, error = estimate(_matrix(batch.column(4)), _matrix(batch.column(5)), na, nb)
            most = np.minimum(na, nb) / np.maximum(na, nb)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.maximum(j - SIGMAS * error, 0)), pa.array(np.minimum(j + SIGMAS * error, most))], ["a", "b", "low", "high"]
            )

    return joined.mapInArrow(lean(run), "a long, b long, low double, high double")


def shingle_sets(docs: DataFrame, ids: DataFrame, n_ids: int, shingle: int) -> DataFrame:
    """(doc_id, shingles array<long>): full sets of the documents in ``ids``, computed from their texts."""
    ids = ids.select(F.col("doc_id").alias("wanted"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, F.col("doc_id") == F.col("wanted"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(1), lower=True):
                h, d = distinct_by_document(*shingle_hashes(block, shingle))
                border = np.searchsorted(d, np.arange(len(block.rows) + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(block.rows)), pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(h.view(np.int64)))], ["doc_id", "shingles"])

    return texts.mapInArrow(lean(run), "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with their exact similarity, and whether it reaches the threshold.

    The set of b travels, as b is in few pairs; a may be a hub and stays where its set is.
    """
    joined = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    joined = joined.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    both = F.size("sa").cast("long") + F.size("sb").cast("long") - F.col("shared")
    return joined.select("a", "b", shared.alias("shared"), "sa", "sb").select("a", "b", (F.col("shared") / both).alias("similarity"), (100 * F.col("shared") >= percent * both).alias("linked"))


def bucket_pairs(members: DataFrame, sketch: DataFrame, bound: float, scratch: Scratch) -> DataFrame:
    """(a, b, low, high): the candidates of all buckets (key, doc_id), in a written table.

    Each member is paired with its bucket's hub, the one with most collisions. Pairs with ``high``
    of at least ``FAR`` make families. A member x with less came by chance; it is linked to no y
    of the bucket but those whose ``low`` is under ``FAR`` + 1 - bound, and is paired with these.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    degree = members.join(sizes, "key").groupBy("doc_id").agg(F.sum(F.col("n") - 1).alias("degree"))
    hubs = members.join(degree, "doc_id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("minus"))).alias("hub")).select("key", (-F.col("hub.minus")).alias("hub"))
    starred = members.join(hubs, "key").where("hub != doc_id").select("key", "doc_id", F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b"))
    starred = scratch.keep(starred, "starred")
    pairs = scratch.keep(estimated(starred.select("a", "b").distinct(), sketch), "pairs")
    seen = starred.join(pairs.where(F.col("low") < FAR + 1 - bound + 1e-9), ["a", "b"])
    chance = seen.where(F.col("high") < FAR).select("key", F.col("doc_id").alias("x"))
    more = seen.select("key", F.col("doc_id").alias("y")).join(chance, "key").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = estimated(more.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), sketch)
    return scratch.keep(pairs.unionByName(more.where(F.col("high") >= FAR)), "candidates")


def _links_between(strays: pa.Table, others: pa.Table, percent: int) -> Iterator[tuple[int, int]]:
    """Links between the components of two blocks (doc_id, component, shingles), one for each stray and component."""

    def flat(table):
        column = table["shingles"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets = np.asarray(column.offsets, np.int64)
        return table["doc_id"].to_numpy(), table["component"].to_numpy(), offsets - offsets[0], column.flatten().to_numpy()

    ida, ca, oa, ta = flat(strays)
    idb, cb, ob, tb = flat(others)
    nb = np.diff(ob)
    a = 0
    while a < len(ida):
        b = min(len(ida), max(a + 1, int(np.searchsorted(oa, oa[a] + 20_000, "right")) - 1))
        vocabulary, at = np.unique(ta[oa[a] : oa[b]], return_inverse=True)
        mine = np.zeros((b - a, len(vocabulary)), np.float32)
        mine[np.repeat(np.arange(b - a), np.diff(oa[a : b + 1])), at] = 1
        step = max(1, 8_000_000 // len(vocabulary))
        for c in range(0, len(idb), step):
            d = min(len(idb), c + step)
            tokens, row = tb[ob[c] : ob[d]], np.repeat(np.arange(d - c), nb[c:d])
            at = np.minimum(np.searchsorted(vocabulary, tokens), len(vocabulary) - 1)
            known = vocabulary[at] == tokens
            theirs = np.zeros((d - c, len(vocabulary)), np.float32)
            theirs[row[known], at[known]] = 1
            shared = (mine @ theirs.T).astype(np.int64)  # exact: counts are under 2**24
            both = np.diff(oa[a : b + 1])[:, None] + nb[None, c:d] - shared
            i, j = np.nonzero((100 * shared >= percent * both) & (ca[a:b, None] != cb[None, c:d]))
            _, first = np.unique(np.stack([i, cb[c + j]]), axis=1, return_index=True)
            yield from zip(ida[a + i[first]].tolist(), idb[c + j[first]].tolist(), strict=True)
        a = b


def family_links(docs: DataFrame, candidates: DataFrame, component: DataFrame, percent: int, shingle: int, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) between components of one family that the hubs didn't show; None if no family has several."""
    family = scratch.keep(joined_components(component, candidates.where(F.col("high") >= FAR), scratch), "families").withColumnsRenamed({"node": "doc_id", "component": "family"})
    member = family.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    parts = member.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("family").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = mixed.select("family", F.col("largest.component").alias("largest"), F.col("members").alias("n_members"), (F.col("members") - F.col("largest.n")).alias("n_strays"))
    member = scratch.keep(member.join(mixed, "family"), "mixed")
    if member.isEmpty():
        return None
    sets = shingle_sets(docs, member.select("doc_id"), member.count(), shingle)
    member = scratch.keep(member.join(sets, "doc_id"), "mixed-sets")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_SETS).cast("int")
    block = lambda n: F.pmod(F.xxhash64("doc_id"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    columns = ["family", "x", "y", "doc_id", "component", "shingles"]
    strays = member.where("component != largest").withColumn("x", block("n_strays")).withColumn("y", every("n_members")).select(columns)
    others = member.withColumn("x", every("n_strays")).withColumn("y", block("n_members")).select(*(F.col(c).alias(c) for c in columns))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        found = list(_links_between(a, b, percent)) if a.num_rows and b.num_rows else []
        return pa.table([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])

    key = ["family", "x", "y"]
    return scratch.keep(strays.groupBy(key).cogroup(others.groupBy(key)).applyInArrow(compare, "a long, b long").distinct(), "family-links")


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row.

    Documents whose sets have ``100 * intersection >= percent * union`` are linked;
    ``component_id`` is the smallest doc_id that links reach.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    bound = percent / 100
    sketch = scratch.keep(sketches(docs, shingle), "sketches")
    filled = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep(filled.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("class_id")), "classes")
    one_each = filled.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")

    bands = band_keys(one_each)
    shared = bands.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key")
    members = scratch.keep(bands.join(shared, "key", "left_semi"), "buckets")
    candidates = bucket_pairs(members, filled, bound, scratch)
    links = verify(docs, candidates.where(F.col("high") >= bound), percent, shingle, scratch).where("linked").select("a", "b")
    # a doc_id of several rows is one node, so it links the classes of all its sets
    repeated = scratch.keep(sketch.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    again = not repeated.isEmpty()
    if again:
        of_doc = filled.join(repeated, "doc_id", "left_semi").join(classes, ["f1", "f2", "n_shingles"]).groupBy("doc_id", "class_id").agg(F.lit(1))
        ends = of_doc.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a < b")
        links = links.unionByName(of_doc.join(ends.select("doc_id", "a"), "doc_id").select("a", F.col("class_id").alias("b")).where("a < b"))
    component = scratch.keep(connected_components(links, scratch), "components")
    if (more := family_links(docs, candidates, component, percent, shingle, scratch)) is not None and not more.isEmpty():
        component = scratch.keep(joined_components(component, more, scratch), "components")

    of = classes.join(component.withColumnRenamed("node", "class_id"), "class_id", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "class_id").alias("component"))
    rows = sketch.select("doc_id", "n_shingles", "f1", "f2").join(of, ["f1", "f2", "n_shingles"], "left")
    component_id = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "n_shingles", component_id.alias("component_id"))
    if again:  # rows with an empty set follow the others of their doc_id
        least = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        rows = rows.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` without those of a document that is not kept; of repeated rows of one doc_id one stays."""
    found = Scratch(docs.sparkSession, "near-dedup").keep(near_duplicates(docs, percent, shingle), "found")
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    if found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy("text")
    once = kept.where("doc_id is not null").withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    return once.unionByName(kept.where("doc_id is null"))


def verify(docs: DataFrame, pairs: DataFrame, percent: int, shingle: int, scratch: Scratch) -> DataFrame:
    """The pairs' exact similarities, in a written table."""
    nodes = scratch.keep(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "nodes")
    sets = scratch.keep(shingle_sets(docs, nodes, nodes.count(), shingle), "sets")
    links = scratch.keep(confirmed(pairs.select("a", "b"), sets, percent), "links")
    scratch.drop(sets)
    return links


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at a Jaccard similarity of 0.8 of their two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=80, shingle=2)
