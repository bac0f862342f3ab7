"""Toxicity by weak supervision.

1. Three lexicons are mined from a bounded sample of labelled rows: words, short and long word
   beginnings whose documents are reliably toxic (lower bound of the precision). A short fixed list
   of insults comes by language.
2. Each lexicon and each pattern (density and variety of listed insults, exclamations, shouting) is
   a voter: it says toxic, says clean, or abstains. Most have nothing to do with the labels. Votes
   are counted by vote pattern over all documents.
3. A generative label model takes the counts: expectation-maximisation estimates the balance of
   the two classes, how each voter votes in each (its accuracy), and which voters depend on each
   other within a class: the strongest of these dependencies form a tree, whose edges are modelled
   (so two lexicons that fire together count little more than one).
   A given label is one more voter, which abstains on all other rows and whose accuracy is
   estimated like the others'.
4. A linear classifier on hit counts is fitted to the model's posteriors: of all documents, by vote
   pattern (their mean counts, as many times as there are), and of the labelled ones, whose label
   has voted, too. It scores every document's whole text in one pass without a shuffle.

Rows that are held out (``held_out_of``) are never in the sample, and their labels are not read.

Defined results: null, empty and wordless texts get the score of a text without hits; a null
doc_id is scored and not held out; repeated rows are scored alike; labels without a toxic value
or a document don't count, and of several labels of a document the largest does; of several texts
of a labelled doc_id one is learnt from; without labels of both kinds the fixed list decides; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .store import Scratch, lean, small_batches

#: Bounds of the fit: labelled documents, and lexicon entries.
SAMPLE_DOCUMENTS, LEXICON_ENTRIES = 20_000, 4_096
#: Word beginnings, in bytes, that may be lexicon entries.
STEMS = (4, 5, 6, 8)
#: Lower bounds of the precision that make an entry strong, fair or weak.
TIERS = (0.85, 0.65, 0.45)
GROUPS = 8
#: The mined lexicon of a word's hash and of those of its beginnings.
KIND = (0, 1, 1, 2, 2)
KINDS = 3

# Common insults in the languages of the documents.
INSULTS = {
    "en": ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown"),
    "de": ("dumm", "trottel", "abschaum", "wertlos"),
    "es": ("idiota", "imbécil", "basura", "estúpido"),
    "fr": ("imbécile", "crétin", "ordure", "stupide"),
}
#: Mined lexicons, those of the languages, density, variety, exclamations, shouting.
VOTERS = KINDS + len(INSULTS) + 4
ABSTAIN, CLEAN, TOXIC = 0, 1, 2
#: How often a given label is taken to be right at first, the rows that this counts as when it is estimated, and what a labelled row weighs at most.
LABEL_ACCURACY, LABEL_ROWS, LABEL_WEIGHT = 0.995, 20, 10
#: What the posteriors of all documents' vote patterns weigh together in the fit, in labelled rows.
PATTERN_WEIGHT = 2000
#: Dependence of two voters within a class, in nats, from which on it is modelled.
DEPENDENCE = 0.01

_U = np.uint64
_CLASS = words.byte_class(words.NOT_ALNUM, True)
COUNTS = GROUPS + len(TIERS) + 3  # strong hits by group, hits by tier, insults, distinct hits, exclamations
FEATURES = 2 * COUNTS + 2


def term_hashes(block: words.Block) -> list[np.ndarray]:
    """For each word the hashes of itself and of its beginnings; a shorter word's beginning counts as 0."""
    whole, *stems = words.stem_hashes(block.data, block.start, block.end, _CLASS[1], STEMS)
    size = block.end - block.start
    return [whole, *(np.where(size >= n, words.mix(h + _U(n)), _U(0)) for n, h in zip(STEMS, stems, strict=True))]


def _fixed_terms() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the fixed list and each one's language."""
    found = [(b.hash, i) for i, listed in enumerate(INSULTS.values()) for b in words.blocks(pa.array(listed), words.NOT_ALNUM, True)]
    return np.concatenate([h for h, _ in found]), np.concatenate([np.full(len(h), i) for h, i in found])


class Lexicon:
    """Terms by hash with their tier; a bit table rules most words out at once."""

    def __init__(self, terms: np.ndarray, tier: np.ndarray):
        fixed, language = _fixed_terms()
        new = ~np.isin(fixed, terms)
        term = np.concatenate([terms, fixed[new]])
        order = np.argsort(term)
        self.term = term[order]
        self.tier = np.concatenate([tier, np.full(new.sum(), len(TIERS))])[order]
        self.language = np.full(len(term), -1)
        self.language[np.searchsorted(self.term, fixed)] = language
        self.fixed = self.language >= 0
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.term & _U(0xFFFF)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, lexicon entries) of the hashes that are terms."""
        maybe = np.flatnonzero(self.bits[(h & _U(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.term, h[maybe]), len(self.term) - 1)
        is_term = self.term[at] == h[maybe]
        return maybe[is_term], at[is_term]


def counts(block: words.Block, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, number of words, what only voters look at: hits of the lexicons and shouted words) of each document of the block."""
    n, document = len(block.rows), block.document()
    seen = np.zeros((n, KINDS + len(INSULTS) + 1), np.int64)
    out = np.zeros((n, COUNTS))
    word, entry = [], []
    for kind, h in zip(KIND, term_hashes(block), strict=True):
        w, e = lexicon.hits(h)
        np.add.at(seen[:, kind], document[w[lexicon.tier[e] < len(TIERS)]], 1)
        word.append(w)
        entry.append(e)
    if not (lexicon.tier < len(TIERS)).any():
        seen[:, :KINDS] = -1  # nothing was mined, which says nothing
    word, entry = np.concatenate(word), np.concatenate(entry)
    of_language = lexicon.language[entry]
    for i in range(len(INSULTS)):
        np.add.at(seen[:, KINDS + i], document[word[of_language == i]], 1)
    # a word of three and more letters, the first and the last capitals
    last = block.data[np.maximum(block.end - 1, 0)] if len(block.end) else block.data[:0]
    capital = lambda x: (x >= 65) & (x <= 90)
    np.add.at(seen[:, -1], document[capital(block.data[block.start]) & capital(last) & (block.end - block.start > 2)], 1)
    # a word counts once, by its best entry
    order = np.lexsort((lexicon.tier[entry], word))
    word, entry = word[order], entry[order]
    first = np.ones(len(word), bool)
    first[1:] = word[1:] != word[:-1]
    word, entry = word[first], entry[first]
    doc, tier = document[word], lexicon.tier[entry]
    strong = tier == 0
    np.add.at(out, (doc[strong], (lexicon.term[entry[strong]] >> _U(61)).astype(np.int64)), 1)
    listed = tier < len(TIERS)
    np.add.at(out, (doc[listed], GROUPS + tier[listed]), 1)
    fixed = lexicon.fixed[entry]
    np.add.at(out, (doc[fixed], GROUPS + len(TIERS)), 1)
    pairs = np.unique(doc[listed] * len(lexicon.term) + entry[listed])
    np.add.at(out, (pairs // len(lexicon.term), GROUPS + len(TIERS) + 1), 1)
    marks = np.flatnonzero((block.data[:-1] == 33) & (block.data[1:] == 33))
    border = np.append(block.start, len(block.data))[block.first]
    border[0] = 0
    np.add.at(out, (np.clip(np.searchsorted(border, marks, "right") - 1, 0, n - 1), GROUPS + len(TIERS) + 2), 1)
    return out, np.diff(block.first), seen


def votes(c: np.ndarray, n: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each document's votes, two bits for each voter, as one number."""
    insults, marks = c[:, GROUPS + len(TIERS)], c[:, GROUPS + len(TIERS) + 2]
    languages, never = seen[:, KINDS : KINDS + len(INSULTS)], np.zeros(len(n), bool)
    toxic = [*(seen[:, : KINDS + len(INSULTS)] > 0).T, insults > 0.01 * np.maximum(n, 1), insults > 2, marks > 2, (seen[:, -1] > 0.3 * np.maximum(n, 1)) & (n > 4)]
    clean = [(seen[:, f] == 0) & (n > 0) for f in range(KINDS)] + [never] * len(INSULTS) + [(languages.sum(1) == 0) & (n > 0)] + [never] * 3
    return sum(np.where(t, TOXIC, np.where(k, CLEAN, ABSTAIN)).astype(np.int64) << (2 * i) for i, (t, k) in enumerate(zip(toxic, clean, strict=True)))


def features(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    size = np.maximum(n, 1)[:, None]
    return np.hstack([np.log1p(c), 10 * np.sqrt(c / size), np.log1p(size) / 5, np.ones_like(size)])


def _values(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> (2 * np.arange(VOTERS))) & 3


def majority(patterns: np.ndarray) -> np.ndarray:
    """The share of toxic votes among those that don't abstain; a half if all do."""
    x = _values(patterns)
    toxic, clean = (x == TOXIC).sum(1), (x == CLEAN).sum(1)
    return np.where(toxic + clean > 0, toxic / np.maximum(toxic + clean, 1), 0.5)


class LabelModel:
    """Two classes of vote vectors: a balance, each voter's votes in each class, and a tree of dependencies.

    ``accuracy``: of each voter where it doesn't abstain. ``edges``: pairs (voter, the one it depends
    on). ``correlation``: of toxic votes within a class, for every pair. ``says``: by class, the
    chance of either label.
    """

    def __init__(self, pattern: np.ndarray, n: np.ndarray, labelled: np.ndarray, label: np.ndarray, n_labelled: np.ndarray, rounds: int = 25):
        pos, neg = n_labelled * label, n_labelled * (1 - label)
        known = pos.sum() > 0 and neg.sum() > 0
        self.balance = float(np.clip((pos.sum() + 1) / (pos.sum() + neg.sum() + 10), 0.005, 0.5)) if known else 0.1
        self.says = np.array([[LABEL_ACCURACY, 1 - LABEL_ACCURACY], [1 - LABEL_ACCURACY, LABEL_ACCURACY]])  # a label's chance, by class
        every = np.concatenate([pattern, labelled])
        hot = np.eye(3)[_values(every)].reshape(len(every), 3 * VOTERS)
        # labelled rows weigh as much as all others together, but a row at most LABEL_WEIGHT others
        weight = float(np.clip(n.sum() / max(n_labelled.sum(), 1), 1, LABEL_WEIGHT)) if known else 1.0
        q = np.where(label > 0, LABEL_ACCURACY, 1 - LABEL_ACCURACY) if known else majority(labelled)
        if known:
            self._fit(hot, np.vstack([np.concatenate([0 * n, n_labelled * (1 - q)]), np.concatenate([0 * n, n_labelled * q])]))
            p = (self.posterior(pattern) + majority(pattern)) / 2  # few labels have not seen all that voters can say
        else:
            p = majority(pattern)
        for _ in range(rounds if known else 1):
            self._fit(hot, np.vstack([np.concatenate([n * (1 - p), weight * n_labelled * (1 - q)]), np.concatenate([n * p, weight * n_labelled * q])]))
            if known:
                for c, share in enumerate((1 - q, q)):
                    rows = (share * n_labelled).sum()
                    self.says[c, c] = ((share * (pos if c else neg)).sum() + max(rows, LABEL_ROWS) * LABEL_ACCURACY) / (rows + max(rows, LABEL_ROWS))
                    self.says[c, 1 - c] = 1 - self.says[c, c]
            new, q = self.posterior(pattern), self.posterior(labelled, label)
            self.balance = float(np.clip((n @ new + weight * (n_labelled @ q if known else 0)) / max(n.sum() + weight * (n_labelled.sum() if known else 0), 1), 0.005, 0.5))
            moved, p = np.abs(new - p).max(initial=0), new
            if moved < 1e-6:
                break

    def _fit(self, hot: np.ndarray, w: np.ndarray) -> None:
        """Votes and dependencies of both classes from weighted rows ``hot`` (three columns for each voter)."""
        total = np.maximum(w.sum(1), 1e-9)
        joint = np.stack([(hot * wi[:, None]).T @ hot for wi in w]).reshape(2, VOTERS, 3, VOTERS, 3)
        single = np.einsum("cvava->cva", joint)
        rate = (single + 0.2) / (total[:, None, None] + 0.6)
        both = (joint + 0.2 / 3) / (total[:, None, None, None, None] + 0.6)
        share = total / total.sum()
        gain = np.einsum("c,cuavb->uv", share, both * np.log(both / (rate[:, :, :, None, None] * rate[:, None, None])))
        np.fill_diagonal(gain, 0)
        # the tree of the largest dependencies, grown voter by voter
        self.parent = np.full(VOTERS, -1)
        left, best = set(range(1, VOTERS)), {v: (gain[0, v], 0) for v in range(1, VOTERS)}
        while left:
            v = max(left, key=lambda x: best[x][0])
            left.remove(v)
            self.parent[v] = best[v][1] if best[v][0] > DEPENDENCE else -1
            for u in left:
                best[u] = max(best[u], (gain[v, u], v))
        self.edges = [(v, int(p)) for v, p in enumerate(self.parent) if p >= 0]
        self.rate = rate
        self.table = np.empty((2, VOTERS, 3, 3))  # log of a vote's chance by the parent's vote
        for v, p in enumerate(self.parent):
            given = both[:, p, :, v, :] / both[:, p, :, v, :].sum(2, keepdims=True) if p >= 0 else np.repeat(rate[:, None, v], 3, 1)
            self.table[:, v] = np.log(given)
        says = rate[:, :, TOXIC] + rate[:, :, CLEAN]
        right = (1 - self.balance) * rate[0, :, CLEAN] + self.balance * rate[1, :, TOXIC]
        self.accuracy = right / ((1 - self.balance) * says[0] + self.balance * says[1])
        t, pair = rate[:, :, TOXIC], joint[:, :, TOXIC, :, TOXIC] / total[:, None, None]
        cov = np.einsum("c,cuv->uv", share, pair - t[:, :, None] * t[:, None])
        spread = np.sqrt(np.einsum("c,cv->v", share, t * (1 - t)))
        self.correlation = cov / np.maximum(np.outer(spread, spread), 1e-12)

    def posterior(self, pattern: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """Chance of the toxic class; with ``label`` that of rows whose label has voted, too."""
        x = _values(pattern)
        above = np.where(self.parent >= 0, x[:, np.maximum(self.parent, 0)], 0)
        chance = (self.table[:, np.arange(VOTERS), above, x] * (x != ABSTAIN)).sum(2)  # who abstains says nothing
        z = chance[1] - chance[0] + np.log(self.balance / (1 - self.balance))
        if label is not None:
            z = z + np.log(self.says[1] / self.says[0])[label.astype(int)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on weighted soft labels by Newton's method; the last feature is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out_of(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def mine_lexicon(sample: DataFrame) -> Lexicon:
    """Words and beginnings of the sample (text, toxic) by the lower bound of their precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for block in words.blocks(batch.column(0), words.NOT_ALNUM, True):
                document = block.document()
                for h in term_hashes(block):
                    order = np.lexsort((document, h))
                    h, d = h[order], document[order]
                    new = h != 0
                    new[1:] &= (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                    h, y = h[new], toxic[block.rows[d[new]]]
                    first = np.ones(len(h), bool)
                    first[1:] = h[1:] != h[:-1]
                    at = np.cumsum(first) - 1
                    pos = np.bincount(at, y, first.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(pos, pa.float64()), pa.array(np.bincount(at, minlength=first.sum()) - pos, pa.float64())], ["term", "pos", "neg"])

    sizes = sample.agg(F.sum("toxic")).first()[0] or 0
    least = max(3, round(0.01 * sizes))
    n, pos, neg = F.col("pos") + F.col("neg"), F.col("pos"), F.col("neg")
    low = (pos + 2 - 2 * F.sqrt(pos * neg / n + 1)) / (n + 4)  # Wilson's lower bound at two standard errors
    terms = sample.mapInArrow(lean(run), "term long, pos double, neg double").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    best = terms.where(F.col("pos") >= least).withColumn("low", low).where(F.col("low") >= TIERS[-1])
    best = best.orderBy(F.desc("low"), F.desc("pos"), "term").limit(LEXICON_ENTRIES).collect()
    tier = np.array([sum(r["low"] < t for t in TIERS) for r in best], np.int64)
    return Lexicon(np.array([r["term"] for r in best], np.int64).view(np.uint64), tier)


def learn(docs: DataFrame, labels: DataFrame, by_model: bool = True) -> tuple[Lexicon, np.ndarray, LabelModel]:
    """(lexicon, weights of the linear classifier, label model) from documents and labels.

    Without ``by_model`` the classifier learns the bare labels, to compare with.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    labels = labels.where(~held_out_of(F.col("doc_id"))).groupBy("doc_id").agg(F.least(F.max("toxic"), F.lit(1)).alias("toxic"))
    some = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    # one row for each label, however often its doc_id occurs
    sample = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    sample = Scratch(spark, "toxicity").keep(sample.select("text", "toxic"), "sample")
    lexicon = mine_lexicon(sample)
    shared, columns = spark.sparkContext.broadcast(lexicon), [f"x{i}" for i in range(FEATURES)]

    def count_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(0), words.NOT_ALNUM, True):
                c, size, seen = counts(block, shared.value)
                pattern, which, n = np.unique(votes(c, size, seen), return_inverse=True, return_counts=True)
                x = np.zeros((len(pattern), FEATURES))
                np.add.at(x, which, features(c, size))
                yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n), *(pa.array(col) for col in x.T)], ["pattern", "n", *columns])

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(0), words.NOT_ALNUM, True):
                c, n, seen = counts(block, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(votes(c, n, seen)), batch.column(1).take(pa.array(block.rows)), pa.array(list(features(c, n)), pa.list_(pa.float64()))], ["pattern", "toxic", "x"])

    # a row for each vote pattern: of the voters' combinations few occur
    every = docs.select("text").mapInArrow(lean(count_votes), f"pattern long, n long, {', '.join(f'{c} double' for c in columns)}").groupBy("pattern").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns))
    every = every.orderBy("pattern").collect()
    rows = sample.mapInArrow(lean(examples), "pattern long, toxic int, x array<double>").collect()  # SAMPLE_DOCUMENTS at most
    rows.sort(key=lambda r: (r["pattern"], r["toxic"], r["x"]))
    column = lambda r, k, kind: np.array([x[k] for x in r], kind)
    pattern, label = column(rows, "pattern", np.int64), column(rows, "toxic", float)
    patterns, n = column(every, "pattern", np.int64), column(every, "n", float)
    model = LabelModel(patterns, n, pattern, label, np.ones(len(rows)))
    shared.unpersist()
    if len(set(label)) < 2:  # nothing to tell apart: the fixed list alone
        weights = np.zeros(FEATURES)
        weights[GROUPS + len(TIERS)], weights[-1] = 4.0, -3.0
        return lexicon, weights, model
    x = np.array([r["x"] for r in rows])
    if not by_model:
        return lexicon, fit_linear(x, label, np.ones(len(x))), model
    mean = np.array([[r[c] for c in columns] for r in every]) / n[:, None]
    share = n * PATTERN_WEIGHT / n.sum()
    return lexicon, fit_linear(np.vstack([x, mean]), np.concatenate([model.posterior(pattern, label), model.posterior(patterns)]), np.concatenate([np.ones(len(x)), share])), model


def toxicity(docs: DataFrame, labels: DataFrame, keep_clean: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    ``keep_clean``: instead the rows of ``docs`` that are not predicted toxic, with all their columns.
    """
    spark = docs.sparkSession
    lexicon, weights, _ = learn(docs, labels)
    shared = spark.sparkContext.broadcast((lexicon, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, w = shared.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for block in words.blocks(batch.column(batch.schema.get_field_index("text")), words.NOT_ALNUM, True):
                score[block.rows] = 1 / (1 + np.exp(-np.clip(features(*counts(block, terms)[:2]) @ w, -30, 30)))
            if keep_clean:
                yield batch.filter(pa.array(score < 0.5))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    if keep_clean:
        return docs.mapInArrow(lean(run), docs.schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_of(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
