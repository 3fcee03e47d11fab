"""Quality and toxicity by a weak-label model and a hashed linear scorer.

1. Labellers. Cheap heuristics over the whole text each vote bad or good or not at all; known labels, where a table
   has them, are one more labeller. Votes of all documents are counted by vote pattern, a table of at most
   3**labellers rows.
2. Weak-label model. Expectation-maximisation over the pattern counts estimates how reliable each labeller is and
   the share of bad documents; it gives each pattern the probability of bad.
3. Scorer. Posterior labels of a bounded sample (``SAMPLE`` documents of each kind, by hash of id and text) train
   a logistic model with L1 penalty on hashed features: words, their first letters, and the shape of the text. A
   document no labeller votes on teaches nothing about that target. All documents are scored.

A document is rejected if the probability that it is of low quality, or that it is toxic, is at least ``REJECT``:
losing a clean document counts more than keeping a doubtful one.

Defined results: null and empty texts have no words and get the scores of an empty document, and are kept
unless the model rejects those; several labels of one id count by majority, ties as bad; labels of unknown ids are
ignored; a null id has no label; repeated rows repeat their result; without any documents the result is empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm import flat
from strandweave.session import cut_lineage, ship_code

#: Documents of each kind (low quality, toxic, neither) the scorer is trained on at most.
SAMPLE = 2_500
#: Of these, documents of each kind whose features are all looked at to choose the ``SCREENED`` features of each
#: target whose share differs most between the classes; the model is trained on those.
SCREENING, SCREENED = 1_500, 10_000
BITS = 20
REJECT = 0.7
#: First letters of a word that are features of their own.
STEMS = (3, 4, 5, 6)
TARGETS = ("bad", "toxic")

# English words of abuse, for persons and for things.
PERSONS = ["idiot", "moron", "loser", "clown", "fool", "jerk", "imbecile", "scum", "creep", "liar"]
THINGS = ["stupid", "worthless", "trash", "disgusting", "pathetic", "garbage", "dumb", "filthy", "ugly", "vile"]

#: Shape of a text per word or letter: (name, unsuspicious below, bad from).
SHAPES = [("capitals", 0.02, 0.10), ("bars", 0.01, 0.05), ("marks", 0.02, 0.15), ("repeats", 0.03, 0.15), ("shouts", 0.05, 0.20)]
LABELLERS = {"bad": [name for name, _, _ in SHAPES] + ["plain", "label"], "toxic": ["persons", "things", "several", "label"]}
#: Labellers whose missing vote says nothing; of the others it is an answer like any other.
SILENT = {"label", "persons", "things", "several"}
NO, GOOD, BAD = 0, 1, 2

_table = np.zeros((5, 256), bool)
_table[0, 65:91] = True
_table[1, 65:91] = _table[1, 97:123] = True
_table[2, [ord(c) for c in "#$%&*+=<>^~@"]] = True
_table[3, ord("!")] = True
_table[4, [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _word_hashes(words: list[str]) -> np.ndarray:
    return flat.words([" ".join(words).encode()], flat.piece_hashes)[0]


def _bare(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of words without the punctuation at both ends; words of punctuation alone stay whole."""
    where = np.flatnonzero(_table[4][data])
    if not len(where):
        return starts, ends
    low = np.searchsorted(where, starts)
    first = where[np.minimum(low, len(where) - 1)]
    last = where[np.maximum(np.searchsorted(where, ends) - 1, 0)] + 1
    some = (low < len(where)) & (first < ends)
    return np.where(some, first, starts), np.where(some, last, ends)


def _stem_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: int) -> np.ndarray:
    """End of the first ``letters`` characters of each word, or -1 where the word has no more."""
    heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    at = np.minimum(np.searchsorted(heads, starts) + letters, len(heads) - 1)
    return np.where(heads[at] < ends, heads[at], -1)


@dataclass
class Batch:
    """Votes and hashed features of some texts."""

    votes: dict[str, np.ndarray]
    features: np.ndarray
    at: np.ndarray


_persons, _things = np.sort(_word_hashes(PERSONS)), np.sort(_word_hashes(THINGS))


def _hits(hashes: np.ndarray, listed: np.ndarray) -> np.ndarray:
    return listed[np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)] == hashes


def describe(texts: list[bytes], with_features: bool) -> Batch:
    whole, starts, ends, at = flat.words(texts, flat.piece_hashes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    byte_at = flat.offsets_of([len(t) for t in texts])
    n = np.diff(at)

    def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

    letter = _table[1][data]
    inner = _table[0][data]  # capitals behind a letter
    inner[1:] &= letter[:-1]
    inner[byte_at[:-1][byte_at[:-1] < len(data)]] = False
    capitals, letters, marks, shouts = (per_text(x, byte_at) for x in (inner, letter, _table[2][data], _table[3][data]))
    again = np.zeros(len(whole), bool)
    again[1:] = whole[1:] == whole[:-1]
    again[at[:-1][at[:-1] < len(whole)]] = False
    bars = (ends - starts == 1) & (data[starts] == ord("|")) if len(starts) else np.zeros(0, bool)
    # a few words or letters more in the denominators: a short text shows little
    shares = [capitals / (letters + 20), per_text(bars, at) / (n + 4), marks / (n + 4), per_text(again, at) / (n + 4), shouts / (n + 4)]
    votes = {name: np.where(x >= bad, BAD, NO) for (name, _, bad), x in zip(SHAPES, shares)}
    votes["plain"] = np.where(np.all([x < good for (_, good, _), x in zip(SHAPES, shares)], axis=0), GOOD, NO)
    first, last = _bare(data, starts, ends)
    lower = flat._LOWER[data]
    plain = flat.piece_hashes(lower, first, last)
    persons, things = per_text(_hits(plain, _persons), at), per_text(_hits(plain, _things), at)
    votes |= {name: np.where(x > 0, BAD, NO) for name, x in (("persons", persons), ("things", things))}
    votes["several"] = np.where(persons + things > 1, BAD, NO)
    if not with_features:
        return Batch(votes, np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    rows, keys = [text], [plain]
    for letters_in in STEMS:
        end = _stem_ends(data, first, last, letters_in)
        long = np.flatnonzero(end >= 0)
        rows.append(text[long])
        keys.append(flat.mix(flat.piece_hashes(lower, first[long], end[long])))
    for k, x in enumerate(shares):  # in steps of a twentieth
        rows.append(np.arange(len(texts)))
        keys.append(flat.mix((np.minimum(x * 20, 20).astype(np.uint64) + np.uint64(1)) * np.uint64(1009 + k)))
    slot = np.concatenate(keys) & np.uint64((1 << BITS) - 1)
    pairs = np.unique(np.concatenate(rows).astype(np.int64) << BITS | slot.astype(np.int64))
    return Batch(votes, pairs & ((1 << BITS) - 1), np.searchsorted(pairs >> BITS, np.arange(len(texts) + 1)))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, silent: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Posterior of bad per pattern, accuracy per labeller, share of bad, rounds.

    ``votes`` is (patterns, labellers). A ``silent`` labeller is right with one probability whenever it votes; the
    others have a distribution over (no vote, good, bad) for each class. Starts from "a bad vote means bad" and ends
    when no posterior moves by 1e-9.
    """
    one_hot = votes[:, :, None] == np.arange(3)
    bad, good = one_hot[:, :, BAD], one_hot[:, :, GOOD]
    heard = ~silent.all() | (votes != NO).any(1)
    post = np.where(bad.any(1), 0.9, 0.05)
    rounds = 0
    while True:
        rounds += 1
        weight = np.stack([counts * (1 - post), counts * post])
        table = np.einsum("cp,plv->lcv", weight, one_hot) + 0.1
        table /= table.sum(2, keepdims=True)
        right = weight[1] @ bad + weight[0] @ good
        accuracy = np.clip((right + 1.6) / (counts @ (bad | good) + 2), 0.5, 1 - 1e-6)
        share = (weight[1][heard].sum() + 0.1) / (counts[heard].sum() + 0.2)
        odds = np.where(silent[:, None], np.log(accuracy / (1 - accuracy))[:, None] * np.array([0, -1, 1]), np.log(table[:, 1] / table[:, 0]))
        score = np.einsum("plv,lv->p", one_hot, odds) + np.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-9:
            return post, accuracy, float(share), rounds


def _labelled(docs: DataFrame, labels: DataFrame | None, id_col: str) -> DataFrame:
    if labels is None:
        return docs.withColumns({"bad_label": F.lit(NO), "toxic_label": F.lit(NO)})
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_doc")).agg(
        F.avg(F.when(F.col("quality") == 0, 1.0).when(F.col("quality") == 1, 0.0)).alias("_b"),
        F.avg(F.when(F.col("toxic") == 1, 1.0).when(F.col("toxic") == 0, 0.0)).alias("_t"))
    vote = lambda c: F.when(c.isNull(), NO).when(c >= 0.5, BAD).otherwise(GOOD)
    return docs.join(known, "_doc", "left").withColumns({"bad_label": vote(F.col("_b")), "toxic_label": vote(F.col("_t"))}).drop("_b", "_t")


def votes_of(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_doc, _of`` (hash of the text) and one column per labeller."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_of"), F.coalesce(text_col, F.lit("")).cast("binary").alias("_text"))
    names = [f"{t}_{name}" for t in TARGETS for name in LABELLERS[t] if name != "label"]
    schema = T.StructType([rows.schema["_doc"], T.StructField("_of", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in names]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in flat.chunks([len(t) for t in texts]):
                votes = describe(texts[a:b], False).votes
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     *[pa.array(votes[c.partition("_")[2]], pa.int32()) for c in names]], names=schema.names)

    return _labelled(rows.mapInArrow(flat.trimmed(work), schema), labels, id_col)


@dataclass
class WeakLabels:
    """What the weak-label model found for one target."""

    labellers: list[str]
    accuracy: dict[str, float]
    share: float
    rounds: int
    patterns: np.ndarray
    posterior: np.ndarray
    heard: np.ndarray
    counts: np.ndarray


def weak_labels(votes: DataFrame, target: str) -> WeakLabels:
    names = [f"{target}_{name}" for name in LABELLERS[target]]
    rows = votes.groupBy(*names).count().orderBy(*names).collect()  # at most 3**labellers patterns
    patterns = np.array([r[:-1] for r in rows], np.int64).reshape(-1, len(names))
    counts = np.array([r[-1] for r in rows], float)
    silent = np.array([name in SILENT for name in LABELLERS[target]])
    post, accuracy, share, rounds = expectation_maximisation(patterns, counts, silent)
    heard = ~silent.all() | (patterns != NO).any(1)
    return WeakLabels(LABELLERS[target], dict(zip(LABELLERS[target], accuracy.tolist())), share, rounds, patterns, post, heard, counts)


def _posterior(votes: DataFrame, found: WeakLabels, target: str, into: str) -> DataFrame:
    names = [f"{target}_{name}" for name in found.labellers]
    rows = [(*map(int, p), float(q) if h else None) for p, q, h in zip(found.patterns, found.posterior, found.heard)]
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in names] + [T.StructField(into, T.DoubleType())])
    return votes.join(F.broadcast(votes.sparkSession.createDataFrame(rows, schema)), names)


@dataclass
class Scorer:
    """Hashed linear model: a weight per feature and target, and intercepts."""

    weights: np.ndarray
    intercepts: np.ndarray

    def probabilities(self, features: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(at) - 1, len(TARGETS)))
        full = np.flatnonzero(np.diff(at))  # summed document by document: the batch makes no difference
        if len(full):
            sums[full] = np.add.reduceat(self.weights[features].astype(np.float64), at[full], axis=0)
        return 1 / (1 + np.exp(-np.clip(sums + self.intercepts, -50, 50)))


class Screening:
    """Shares of the features in bad and good rows of one target, summed row by row."""

    def __init__(self):
        self.bad, self.good = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
        self.seen = np.zeros(1 << BITS, np.int32)
        self.totals = np.full(2, 1e-12)

    def add(self, features: np.ndarray, target: float, weight: float) -> None:
        self.bad[features] += weight * target
        self.good[features] += weight * (1 - target)
        self.seen[features] += 1
        self.totals += weight * target, weight * (1 - target)

    def chosen(self) -> np.ndarray:
        """Features whose share differs most, in standard deviations; sorted."""
        p = np.clip((self.bad + self.good) / self.totals.sum(), 1e-9, 1 - 1e-9)
        z = np.abs(self.bad / self.totals[0] - self.good / self.totals[1]) / np.sqrt(p * (1 - p)) * (self.seen >= 4)
        used = np.sort(np.argpartition(-z, SCREENED)[:SCREENED])
        return used[z[used] > 0]


def train(features: np.ndarray, at: np.ndarray, target: np.ndarray, weight: np.ndarray, used: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on the features ``used`` with L1 penalty, by accelerated proximal steps.

    ``target`` is a probability per row.
    """
    n = len(at) - 1
    weight = weight / max(weight.sum(), 1e-12)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    column = np.full(1 << BITS, -1, np.int32)
    column[used] = np.arange(len(used))
    column = column[features]
    row, column = row[column >= 0], column[column >= 0]
    per_row = np.bincount(row, minlength=n) + 1.0
    # the curvature of each feature is at most a quarter of the weighted sizes of its rows
    step = 1 / (1e-9 + 0.25 * np.bincount(column, (weight * per_row)[row], len(used)))
    step_b = 1 / (0.25 * (weight * per_row).sum() + 1e-9)
    start = np.log(max((weight * target).sum(), 1e-9) / max((weight * (1 - target)).sum(), 1e-9))
    w, b, ahead, ahead_b, t = np.zeros(len(used)), start, np.zeros(len(used)), start, 1.0
    for _ in range(rounds):
        z = np.bincount(row, ahead[column], n) + ahead_b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        moved = ahead - step * np.bincount(column, error[row], len(used))
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_b = ahead_b - step_b * error.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    out = np.zeros(1 << BITS, np.float32)
    out[used] = w
    return out, float(b)


def _gathered(docs: DataFrame, picks: list[int], id_col: str, text_col: str, only: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Pick and features of the picked documents, one after the other; ``only`` restricts the features.

    The features are written to the shared folder first, so that they are made in parallel and held one
    partition at a time.
    """
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(k,) for k in picks], "_pick long")
    keyed = docs.select(F.xxhash64(F.col(id_col), F.xxhash64(text_col)).alias("_pick"), F.coalesce(text_col, F.lit("")).cast("binary").alias("_text"))
    keyed = keyed.join(F.broadcast(wanted), "_pick", "left_semi")  # as many as were picked
    schema = T.StructType([T.StructField("_pick", T.LongType()), T.StructField("_features", T.BinaryType())])
    keep = None if only is None else spark.sparkContext.broadcast(only)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = None
        if keep is not None:
            listed = np.zeros(1 << BITS, bool)
            listed[keep.value] = True
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in flat.chunks([len(t) for t in texts]):
                d = describe(texts[a:b], True)
                rows = (d.features[x:y] for x, y in zip(d.at[:-1], d.at[1:]))
                parts = [(r if listed is None else r[listed[r]]).astype("<u4").tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(parts, pa.binary())], names=schema.names)

    known = set()
    for r in cut_lineage(keyed.mapInArrow(flat.trimmed(work), schema)).toLocalIterator():
        if r["_pick"] not in known:  # repeated rows
            known.add(r["_pick"])
            yield r["_pick"], np.frombuffer(r["_features"], "<u4").astype(np.int32)


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Scorer, dict[str, WeakLabels]]:
    """Weak-label models over all documents, and the scorer trained on at most ``4 * sample`` of them."""
    spark = docs.sparkSession
    votes = cut_lineage(votes_of(docs, labels, id_col, text_col))
    found = {t: weak_labels(votes, t) for t in TARGETS}
    for t in TARGETS:
        votes = _posterior(votes, found[t], t, f"_{t}")
    bad, toxic = F.coalesce("_bad", F.lit(0.0)) > 0.5, F.coalesce("_toxic", F.lit(0.0)) > 0.5
    votes = votes.withColumn("_kind", F.when(toxic, 2).when(bad, 1).when(F.col("_toxic").isNotNull(), 3).otherwise(0))
    sizes = {r["_kind"]: r["count"] for r in votes.groupBy("_kind").count().collect()}
    order = F.xxhash64("_doc", "_of")
    rows = []
    for kind in sorted(sizes):  # low quality, toxic, clean for all that is known, clean but for toxicity unknown
        part = votes.where(F.col("_kind") == kind).select(order.alias("_pick"), "_bad", "_toxic", "_kind").dropDuplicates(["_pick"])
        rows += part.orderBy("_pick").limit(sample).collect()
    taken = Counter(r["_kind"] for r in rows)
    by_pick = {r["_pick"]: (r["_bad"], r["_toxic"], sizes[r["_kind"]] / taken[r["_kind"]]) for r in rows}
    first: Counter = Counter()
    some = []
    for r in rows:  # in order of their hashes
        first[r["_kind"]] += 1
        if first[r["_kind"]] <= SCREENING:
            some.append(r["_pick"])

    def label(i: int, pick: int) -> tuple[float, float]:
        """Posterior and weight of a document for a target."""
        target, known = by_pick[pick][i], found[TARGETS[i]]
        good = float((known.counts * (1 - known.posterior))[known.heard].sum())
        silent = float(known.counts[~known.heard].sum())
        if target is None:  # if nobody votes good, what nobody votes on is taken as good
            return 0.0, 0.0 if good >= 0.5 else by_pick[pick][2]
        # good documents nobody votes on are stood for by the good ones somebody votes on
        return target, by_pick[pick][2] * (1 + silent / max(good, 1.0) if target < 0.5 and good >= 0.5 else 1.0)

    screens = [Screening() for _ in TARGETS]
    for pick, features in _gathered(docs, some, id_col, text_col):
        for i, screen in enumerate(screens):
            screen.add(features, *label(i, pick))
    used = [screen.chosen() for screen in screens]
    del screens
    rows = sorted(_gathered(docs, list(by_pick), id_col, text_col, np.unique(np.concatenate(used))), key=lambda r: r[0])
    features, at = np.concatenate([np.zeros(0, np.int32), *[f for _, f in rows]]), flat.offsets_of([len(f) for _, f in rows])
    weights, intercepts = [], []
    for i in range(len(TARGETS)):
        target, weight = np.array([label(i, pick) for pick, _ in rows], float).reshape(-1, 2).T
        w, b = train(features, at, target, weight, used[i])
        weights.append(w)
        intercepts.append(b)
    return Scorer(np.stack(weights, 1), np.array(intercepts)), found


def scored(docs: DataFrame, scorer: Scorer, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``<prefix>bad_score``, ``<prefix>toxic_score`` and ``<prefix>keep``."""
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(scorer)  # 2**BITS weights per target
    names = [f"{prefix}{t}_score" for t in TARGETS] + [f"{prefix}keep"]
    docs = docs.drop(*names)
    place = docs.columns.index(text_col)
    schema = T.StructType(docs.schema.fields + [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(place).to_pylist()]
            for a, b in flat.chunks([len(t) for t in texts]):
                d = describe(texts[a:b], True)
                p = model.probabilities(d.features, d.at)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((p < REJECT).all(1))], names=schema.names)

    return docs.mapInArrow(flat.trimmed(work), schema)
