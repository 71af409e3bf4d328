"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's bytes (A-Z lower-cased), whatever they are, run through a GRU in each direction; a softmax labels every byte,
and a document's probabilities are the mean over all its bytes. Texts go in windows of ``WINDOW`` bytes with ``AROUND``
more on each side, through which the state comes from the neighbours without being labelled again; so states pass from
word to word, a very long text is as many rows of a batch as windows, and memory is bounded by ``ROWS`` windows. Empty
tables give no rows.
Training is backpropagation through time with Adam on the mean log loss of all positions of random windows.

Training reads a bounded, documented sample, whole texts: of each language up to ``DOCS`` documents outside the
held-out fold, or ``MOST`` divided by the languages, by a hash of the id, of at most ``LONGEST`` characters. A language is
learned if any of its documents qualifies. A text without a letter, or a null one, is ``und`` with score 0; so is every
text if nothing could be learned. Ties go to the first language by name. Repeated rows and null ids are labelled one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PARTS, PART = 3, 1
DOCS, MOST, LONGEST, HIDDEN, INPUT = 150, 3000, 20_000, 16, 12
WINDOW, AROUND, ROWS = 1024, 64, 2048
STEPS, BATCH, LENGTH, RATE = 240, 128, 48, 0.02
GAP = np.ones(256, bool)
GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * z)


class Network:
    """Parameters: byte vectors, a GRU (update, reset, candidate) for each direction, and the labels' layer."""

    def __init__(self, langs: list[str], seed: int = 0):
        r = np.random.default_rng(seed)
        self.langs = langs
        new = lambda *shape: (r.normal(0, 1 / np.sqrt(shape[0]), shape)).astype(np.float32)
        self.p = {"bytes": r.normal(0, 0.3, (256, INPUT)).astype(np.float32), "out": new(2 * HIDDEN, len(langs)), "out_b": np.zeros(len(langs), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": new(INPUT, 3 * HIDDEN), f"h{d}": new(HIDDEN, 2 * HIDDEN), f"c{d}": new(HIDDEN, HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def _run(self, d: str, gates: np.ndarray, code: np.ndarray, keep: list | None = None, onward: bool = True) -> list[np.ndarray]:
        """States after each byte of windows of one length; ``gates`` has each byte's part of the gates."""
        p, h = self.p, np.zeros((len(code), HIDDEN), np.float32)
        out = [h] * code.shape[1]
        for t in range(code.shape[1]) if onward else range(code.shape[1] - 1, -1, -1):
            x = gates[code[:, t]]
            zr = _logistic(x[:, : 2 * HIDDEN] + h @ p[f"h{d}"])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ p[f"c{d}"])
            if keep is not None:
                keep.append((t, h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def gates(self) -> dict[str, np.ndarray]:
        return {d: self.p["bytes"] @ self.p[f"x{d}"] + self.p[f"b{d}"] for d in "fb"}

    def labels(self, code: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sums of the labels' probabilities over the bytes from ``first`` to before ``last`` of each window.

        ``code``: a row for each place, a column for each window, windows by falling ``size``; so the windows that have a
        byte at a place are the first ``m``, and both directions step over exactly these. Update, reset and candidate
        are arrays of their own, so that every step works on whole memory; the halves in a logistic by tanh are in the weights.
        """
        steps, rows = code.shape
        p, n, H = self.p, len(self.langs), HIDDEN
        there = np.searchsorted(-size, -np.arange(steps), "left")
        logits = np.zeros((steps, rows, n), np.float32)
        z, r, c = (np.empty((rows, H), np.float32) for _ in range(3))
        made = np.empty((rows, H), np.float32)
        for d, places, out in (("f", range(steps), p["out"][:H]), ("b", range(steps - 1, -1, -1), p["out"][H:])):
            table = p["bytes"] @ p[f"x{d}"] + p[f"b{d}"]
            half = [np.ascontiguousarray(x, np.float32) for x in (0.5 * table[:, :H], 0.5 * table[:, H : 2 * H], table[:, 2 * H :])]
            wz, wr, wc = (np.ascontiguousarray(x, np.float32) for x in (0.5 * p[f"h{d}"][:, :H], 0.5 * p[f"h{d}"][:, H:], p[f"c{d}"]))
            out, h = np.ascontiguousarray(out, np.float32), np.zeros((rows, H), np.float32)
            for j in places:
                m = int(there[j])
                x, hm, mm = code[j, :m].astype(np.intp), h[:m], made[:m]
                for gate, told, w in ((z[:m], half[0], wz), (r[:m], half[1], wr)):
                    np.take(told, x, axis=0, out=gate, mode="clip")
                    gate += np.matmul(hm, w, out=mm)
                    np.tanh(gate, out=gate)
                    gate *= 0.5
                    gate += 0.5
                np.multiply(r[:m], hm, out=r[:m])
                np.take(half[2], x, axis=0, out=c[:m], mode="clip")
                c[:m] += np.matmul(r[:m], wc, out=mm)
                np.tanh(c[:m], out=c[:m])
                c[:m] -= hm
                c[:m] *= z[:m]
                hm += c[:m]
                logits[j, :m] += hm @ out
        total = np.zeros((rows, n))
        for a in range(0, steps, 32):  # few places at a time stay near
            m, at = int(there[a]), np.arange(a, min(a + 32, steps))[:, None]
            q = logits[a : a + 32, :m] + p["out_b"]
            q -= q.max(axis=2, keepdims=True)
            np.exp(q, out=q)
            q *= (((first[:m] <= at) & (at < last[:m])) / q.sum(axis=2))[:, :, None]
            total[:m] += q.sum(axis=0)
        return total

    def slopes(self, code: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions (``y``: their languages), and its gradients by backpropagation through time."""
        p, n = self.p, code.size
        g = {k: np.zeros_like(v) for k, v in p.items()}
        gates, kept, loss = self.gates(), {"f": [], "b": []}, 0.0
        states = {d: self._run(d, gates[d], code, kept[d], d == "f") for d in "fb"}
        back = {"f": {}, "b": {}}
        for t in range(code.shape[1]):
            both = np.concatenate([states["f"][t], states["b"][t]], axis=1)
            q = both @ p["out"] + p["out_b"]
            q = np.exp(q - q.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            loss -= float(np.log(np.maximum(q[np.arange(len(y)), y[:, t]], 1e-9)).sum()) / n
            q[np.arange(len(y)), y[:, t]] -= 1
            q /= n
            g["out"] += both.T @ q
            g["out_b"] += q.sum(axis=0)
            down = q @ p["out"].T
            back["f"][t], back["b"][t] = down[:, :HIDDEN], down[:, HIDDEN:]
        for d in "fb":
            flow = np.zeros((len(code), HIDDEN), np.float32)
            for t, h, z, r, c in reversed(kept[d]):
                flow = flow + back[d][t]
                dc = flow * z * (1 - c * c)
                dz = flow * (c - h) * z * (1 - z)
                drh = dc @ p[f"c{d}"].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                dx = np.concatenate([dzr, dc], axis=1)
                g[f"c{d}"] += (r * h).T @ dc
                g[f"h{d}"] += h.T @ dzr
                g[f"b{d}"] += dx.sum(axis=0)
                g[f"x{d}"] += p["bytes"][code[:, t]].T @ dx
                np.add.at(g["bytes"], code[:, t], dx @ p[f"x{d}"].T)
                flow = flow * (1 - z) + drh * r + dzr @ p[f"h{d}"].T
        return loss, g


def train(texts: list[tuple[bytes, int]], langs: list[str], steps: int = STEPS) -> Network:
    """A network that labels the bytes of each text with its language, from random windows; every language weighs the same."""
    net, r = Network(langs), np.random.default_rng(1)
    texts = [(np.frombuffer(w, np.uint8), y) for w, y in texts if w]
    data = np.concatenate([np.zeros(0, np.uint8), *(w for w, _ in texts)])
    of, size = (np.array(x, np.int64) for x in ([y for _, y in texts], [len(w) for w, _ in texts]))
    at = np.cumsum(size) - size
    own = {y: np.flatnonzero(of == y) for y in set(of.tolist())}  # a language's texts, drawn by their lengths
    share = {y: np.cumsum(size[k]) for y, k in own.items()}
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for t in range(1, steps + 1 if texts else 1):
        begin = np.zeros(BATCH, np.int64)
        for i, y in enumerate(r.choice(sorted(own), BATCH)):
            k = own[y][np.searchsorted(share[y], r.integers(0, share[y][-1]), "right")]
            begin[i] = at[k] + r.integers(0, max(1, size[k] - LENGTH + 1))
        place = (begin[:, None] + np.arange(LENGTH)) % len(data)  # a short text is followed by what comes next
        _, g = net.slopes(data[place], of[np.searchsorted(at, place, "right") - 1])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = RATE * min(1, 2 * (1 - t / (steps + 1)))
        for k, x in g.items():
            x = x * min(1, 1 / max(norm, 1e-9))
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.01 * (x * x - v[k])
            net.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
    return net


def _lower(batches):
    for batch in batches:
        texts = common.as_strings(batch.column(1))
        for a, b in common.slices(texts):
            data, at = common.text_bytes(texts, a, b)
            low = common.LOWER[data].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([low[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], ["lang", "bytes"])


def fit(docs: DataFrame, steps: int = STEPS) -> Network:
    common.prepare(docs.sparkSession)
    able = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= LONGEST) & ~common.held_out(F.col("doc_id"), PARTS, PART))
    able = able.select("doc_id", "lang").distinct().withColumn("o", F.xxhash64("doc_id"))  # an id counts once, however many its rows
    counts = common.cut(able.groupBy("lang").agg(F.count("*").alias("n")))
    each = max(1, min(DOCS, MOST // max(1, counts.count())))
    # About twice the wanted ids of each language by hash, so the ranking below sees few however many there are.
    part = (F.col("o").bitwiseAND((1 << 30) - 1)) / float(1 << 30)
    few = able.select("doc_id", "lang", "o").join(common.small(counts, 10_000), "lang").filter(part * F.col("n") <= 2 * each + 100)
    ranked = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id"))).filter(F.col("k") <= each)
    ids = common.small(ranked.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "k"), 2 * MOST)
    some = docs.select("doc_id", "lang", "text").filter(F.length("text") <= LONGEST).join(ids, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    some = some.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # of an id's several texts the least
    rows = some.select("lang", "text").mapInArrow(_lower, "lang string, bytes binary").toLocalIterator()
    held = sorted((lang, bytes(w)) for lang, w in rows)
    langs = sorted({lang for lang, _ in held})
    return train([(w, langs.index(lang)) for lang, w in held], langs, steps)


class Labeller:
    """Pools a network's labels over texts."""

    def __init__(self, net: Network):
        self.net = net

    def pooled(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean label probabilities of each row's bytes; a row without bytes has zeros."""
        size = np.diff(at)
        total = np.zeros((len(size), len(self.net.langs)))
        if not len(data) or not self.net.langs:
            return total
        low = common.LOWER[data]
        n = -(-size // WINDOW)
        row = np.repeat(np.arange(len(size)), n)
        begin = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        stop = np.minimum(begin + WINDOW, size[row])
        left, right = np.maximum(begin - AROUND, 0), np.minimum(stop + AROUND, size[row])
        order = np.argsort(left - right, kind="stable")
        for a in range(0, len(order), ROWS):
            some = order[a : a + ROWS]
            long, start = (right - left)[some], at[row[some]] + left[some]
            code = low[np.minimum(start + np.arange(int(long[0]))[:, None], len(low) - 1)]
            np.add.at(total, row[some], self.net.labels(code, long, (begin - left)[some], (stop - left)[some]))
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)


def _label(net):
    def run(batches):
        own = Labeller(net.value)
        names = np.array([*own.net.langs, "und"], object)
        ascii_ = ~GAP & (np.arange(256) < 128)
        for batch in batches:
            texts = common.as_strings(batch.column(1))
            for a, b in common.slices(texts, 2 << 20):
                data, at = common.text_bytes(texts, a, b)
                mean = own.pooled(data, at)
                letters = np.diff(np.concatenate([[0], np.cumsum(ascii_[data])])[at]) > 0
                for i in np.flatnonzero(~letters):
                    letters[i] = any(c.isalpha() for c in texts[a + int(i)].as_py())
                best = mean.argmax(axis=1) if mean.shape[1] else np.zeros(len(mean), int)
                score = np.where(letters, mean.max(axis=1), 0.0) if mean.shape[1] else np.zeros(len(mean))
                best = np.where(letters & (score > 0), best, len(names) - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "lang_pred", "score"])

    return run


def label(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred and score of each text."""
    common.prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_label(docs.sparkSession.sparkContext.broadcast(net)), "doc_id long, lang_pred string, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return label(docs, fit(docs)).select("doc_id", common.held_out(F.col("doc_id"), PARTS, PART).alias("held_out"), "lang_pred", "score")
