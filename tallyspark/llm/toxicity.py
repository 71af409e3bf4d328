"""Toxicity by multiple-instance learning.

A document is a bag of sentences (cut at . ! ? and line ends). A sentence's features are its words and the first
four and six bytes of them, hashed; its probability is logistic in their weights. A document's is the noisy-or
of its sentences, 1 - prod(1 - p), and the weights are learned through it from document labels alone, by adaptive
proximal gradients: an L1 shrinkage first chooses few features, a second pass weighs those without it. The same weights then locate the offending sentences.

Training reads a documented, bounded sample: of the labelled rows outside the held-out fold, the first ``TOXIC`` and
``CLEAN`` by a hash of the id, whole texts of at most ``LONGEST`` characters, and of these the first that together have
at most ``CHARS``. Spark counts in how many sampled documents of each label a feature is; of those in ``LEAST`` or more
the ``FEATURES`` whose shares differ most go into the model, and only their places in sentences come to the driver, as
32-bit numbers. So neither the sample nor the model grows with the corpus or with a text. Scoring is one Arrow pass
over whole texts, no shuffle.

An empty or null text has no sentence: score 0. Without labels every score is near 0. Labels that disagree about a
document count as toxic; null labels are ignored. Repeated rows are scored one by one, null ids too (never held out);
in the sample an id of several texts has the least one. Very long texts are scored whole. Empty documents give no rows, empty
labels scores near 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOXIC, CLEAN, LEAST, EPOCHS, CUT = 1000, 2400, 3, 120, 0.3
LONGEST, CHARS, FEATURES = 200_000, 40_000_000, 20_000
STEP, SHRINK, HOLD = 0.6, 0.03, 0.05
PARTS, PART, PREFIXES = 4, 2, (0, 4, 6)  # 0: the whole word
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
END = np.zeros(256, np.int64)
END[[ord(c) for c in ".!?\n"]] = 1
_KIND = np.random.default_rng(3).integers(1, 1 << 63, 4, dtype=np.uint64)
_MASK = np.uint64((1 << 20) - 1)


def features(data: np.ndarray, at: np.ndarray):
    """Words of some rows as (row, sentence, hashes of each kind; 0: none), and the rows' sentence counts.

    Sentences are numbered through all rows; only those with a word count.
    """
    starts, ends = common.word_runs(data, at, GAP)
    row = np.searchsorted(at, starts, "right") - 1
    place = np.cumsum(END[data])[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(new) - 1
    low = common.LOWER[data]
    out = np.zeros((len(PREFIXES), len(starts)), np.uint64)
    size = ends - starts
    for k, n in enumerate(PREFIXES):
        fit = size >= max(1, n)
        out[k, fit] = common.mix(common.span_hashes(low, starts[fit], starts[fit] + n if n else ends[fit]) ^ _KIND[k])
    return row, sentence, out, np.bincount(row[new], minlength=len(at) - 1), starts, ends


def _sample(batches):
    """(toxic, n, s, f): of each text its label, its sentences, and distinct pairs of sentence and feature."""
    for batch in batches:
        texts = common.as_strings(batch.column(1))
        for a, b in common.slices(texts):
            row, sentence, h, count, *_ = features(*common.text_bytes(texts, a, b))
            first = np.concatenate([[0], np.cumsum(count)])
            bags, feats = [], []
            for i in range(b - a):
                own = row == i
                s, f = np.repeat(sentence[own] - first[i], len(PREFIXES)), h[:, own].T.ravel()
                pair = np.unique(np.stack([s[f != 0].astype(np.uint64), f[f != 0]]), axis=1)
                bags.append(pair[0].astype(np.int32))
                feats.append(pair[1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count, pa.int64()), pa.array(bags, pa.list_(pa.int32())), pa.array(feats, pa.list_(pa.int64()))], ["toxic", "n", "s", "f"])


def _numbered(keys):
    """The pairs whose feature is among ``keys`` (sorted), the feature by its number."""

    def run(batches):
        own = keys.value
        for batch in batches:
            bags, feats = [], []
            for i in range(batch.num_rows):
                s, f = (np.asarray(batch.column(k)[i].values) for k in (2, 3))
                at = np.minimum(np.searchsorted(own, f), max(0, len(own) - 1))
                use = own[at] == f if len(own) else np.zeros(len(f), bool)
                bags.append(s[use])
                feats.append(at[use].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.list_(pa.int32())), pa.array(feats, pa.list_(pa.int32()))], ["toxic", "n", "s", "f"])

    return run


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Model:
    """Weights of a few features, by hash, and the bias of every sentence."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], float(bias)
        self.near = np.zeros(int(_MASK) + 1, bool)
        self.near[(self.keys & _MASK).astype(np.int64)] = True

    def score(self, data: np.ndarray, at: np.ndarray):
        """Probabilities of the rows, and for each row (start, end, probability) of its worst sentence, in bytes."""
        row, sentence, h, count, starts, ends = features(data, at)
        kind, word = np.nonzero(self.near[(h & _MASK).astype(np.int64)] & (h != 0)) if len(self.keys) else (np.zeros(0, int),) * 2
        got = h[kind, word]
        place = np.minimum(np.searchsorted(self.keys, got), max(0, len(self.keys) - 1))
        hit = self.keys[place] == got if len(self.keys) else np.zeros(0, bool)
        place, owner = place[hit], sentence[word[hit]]
        pair = np.unique(owner * len(self.keys) + place) if len(place) else np.zeros(0, np.int64)
        z = np.full(int(count.sum()), self.bias)
        if len(pair):
            np.add.at(z, pair // len(self.keys), self.weights[pair % len(self.keys)])
        bag = np.repeat(np.arange(len(count)), count)
        total = np.bincount(bag, np.logaddexp(0, z), minlength=len(count))
        worst = []
        firsts = np.flatnonzero(np.diff(sentence, prepend=-1))
        base = np.concatenate([[0], np.cumsum(count)])
        for i in range(len(count)):
            if count[i] and 1 - np.exp(-total[i]) >= CUT:
                k = base[i] + int(np.argmax(z[base[i] : base[i + 1]]))
                last = (firsts[k + 1] if k + 1 < len(firsts) else len(starts)) - 1
                worst.append((starts[firsts[k]] - at[i], ends[last] - at[i], float(_logistic(z[k]))))
            else:
                worst.append(None)
        return 1 - np.exp(-total), worst


def noisy_or(y: np.ndarray, owner: np.ndarray, bag: np.ndarray, at: np.ndarray, share: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Slopes of the weighted log loss of the noisy-or by the weights ``w`` and the bias ``b``.

    Sentence ``bag[i]`` has the feature ``at[i]``, document ``owner[k]`` the sentence ``k``.
    """
    z = b + np.bincount(bag, w[at], minlength=len(owner))
    clear = np.exp(-np.bincount(owner, np.logaddexp(0, z), minlength=len(y)))  # prod(1 - p)
    slope = np.where(y == 1, -clear / np.maximum(1 - clear, 1e-9), 1.0) * share
    gz = slope[owner] * _logistic(z)
    return np.bincount(at, gz[bag], minlength=len(w)), float(gz.sum())


def learn(y: np.ndarray, count: np.ndarray, bag: np.ndarray, at: np.ndarray, keys: np.ndarray, rate: float, epochs: int = EPOCHS) -> Model:
    """Weights by adaptive proximal gradients on the mean log loss of the noisy-or, with L1 shrinkage of all but the bias.

    Document ``i`` has the label ``y[i]`` and ``count[i]`` sentences, numbered through; sentence ``bag[j]`` has the
    feature ``keys[at[j]]``. ``rate`` is the share of toxic documents among all labelled ones, to which the sample is weighted.
    """
    n_bags, share = int(count.sum()), np.where(y == 1, rate / max(1, (y == 1).sum()), (1 - rate) / max(1, (y != 1).sum()))
    if not n_bags or not (y == 1).any():
        return Model(keys[:0], np.zeros(0), -12.0)
    owner = np.repeat(np.arange(len(y)), count)
    w, b = np.zeros(len(keys)), -5.0
    for shrink, hold in ((SHRINK / np.sqrt(len(y)), 0.0), (0.0, HOLD / len(y))):  # first choose features, then weigh those few
        past = np.full(len(keys) + 1, 1e-8)
        for _ in range(epochs):
            gw, gb = noisy_or(y, owner, bag, at, share, w, b)
            g = np.append(gw + hold * w, gb)
            past += g * g
            step = STEP / np.sqrt(past)
            w, b = w - (step * g)[:-1], b - step[-1] * g[-1]
            w = np.sign(w) * np.maximum(0, np.abs(w) - step[:-1] * shrink)
        use = w[at] != 0
        number = np.cumsum(w != 0) - 1
        bag, at, keys, w = bag[use], number[at[use]], keys[w != 0], w[w != 0]
    return Model(keys, w, b)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled ``docs`` outside the held-out fold."""
    common.prepare(docs.sparkSession)
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    known = known.filter(~common.held_out(F.col("doc_id"), PARTS, PART)).withColumn("o", F.xxhash64("doc_id"))
    rate = known.agg(F.avg("toxic")).first()[0] or 0.0
    some = [known.filter(c).orderBy("o", "doc_id").limit(n) for c, n in (("toxic = 1", TOXIC), ("toxic <> 1", CLEAN))]
    ids = F.broadcast(some[0].union(some[1]).select(F.col("doc_id").alias("_id"), "toxic", "o"))  # TOXIC + CLEAN rows at most
    rows = docs.select("doc_id", "text").filter(F.length("text") <= LONGEST).join(ids, F.col("doc_id") == F.col("_id"))
    rows = common.cut(rows.groupBy("_id", "toxic", "o").agg(F.min("text").alias("text")))
    size = rows.select("_id", F.sum(F.length("text")).over(Window.orderBy("o", "_id")).alias("before")).filter(F.col("before") <= CHARS).select("_id")
    told = common.cut(rows.join(F.broadcast(size), "_id").select("toxic", "text").mapInArrow(_sample, "toxic long, n long, s array<int>, f array<long>"))
    keys = _chosen(told)
    shared = docs.sparkSession.sparkContext.broadcast(keys)
    got = told.mapInArrow(_numbered(shared), "toxic long, n long, s array<int>, f array<int>").toArrow().combine_chunks()
    toxic, count = (np.asarray(got.column(k)) for k in (0, 1))
    sizes = np.array([len(x) for x in got.column("s")], np.int64)
    bag, at = (np.concatenate([np.asarray(c.flatten()) for c in got.column(k).chunks] + [np.zeros(0, np.int32)]) for k in ("s", "f"))
    bag = bag + np.repeat(np.cumsum(count) - count, sizes).astype(np.int32)
    shared.destroy()
    return learn(toxic, count, bag, at, keys.view(np.uint64), rate)


def _chosen(told: DataFrame) -> np.ndarray:
    """The features that go into the model, sorted: at most FEATURES, by how far their shares of the two labels differ."""
    totals = told.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("t"), F.count("*").alias("n")).first()
    t, c = totals["t"] or 0, (totals["n"] or 0) - (totals["t"] or 0)
    each = told.select((F.col("toxic") == 1).cast("int").alias("toxic"), F.explode(F.array_distinct("f")).alias("f"))
    each = each.groupBy("f").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    share = (F.col("n") + 1) / (t + c + 2)
    far = F.abs((F.col("a") + 0.5) / (t + 1) - (F.col("n") - F.col("a") + 0.5) / (c + 1)) / F.sqrt(share * (1 - share))
    best = each.orderBy(far.desc(), "f").limit(FEATURES).select("f").toArrow()
    return np.sort(np.asarray(best.column(0).combine_chunks()).astype(np.int64))


def _score(model):
    def run(batches):
        own = model.value
        for batch in batches:
            texts = common.as_strings(batch.column(1))
            for a, b in common.slices(texts):
                data, at = common.text_bytes(texts, a, b)
                score, worst = own.score(data, at)
                spans = [None if x is None else [len(data[at[i] : at[i] + n].tobytes().decode()) for n in x[:2]] for i, x in enumerate(worst)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(score),
                    pa.array([x and x[0] for x in spans], pa.int64()), pa.array([x and x[1] for x in spans], pa.int64()), pa.array([x and x[2] for x in worst], pa.float64()),
                ], ["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and of texts at CUT or more the worst sentence: its code points (end exclusive) and probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double, worst_start long, worst_end long, worst_score double")


def _keep(model, names):
    def run(batches):
        own, t = model.value, names.index("text")
        for batch in batches:
            texts = common.as_strings(batch.column(t))
            for a, b in common.slices(texts):
                yield batch.slice(a, b - a).filter(pa.array(own.score(*common.text_bytes(texts, a, b))[0] < CUT))

    return run


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those that score CUT or more."""
    common.prepare(docs.sparkSession)
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model), docs.columns), docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", common.held_out(F.col("doc_id"), PARTS, PART).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")
