"""Best-fit packing of token sequences by a configuration linear program.

A document's ids are cut into pieces of at most ``CAPACITY``. The histogram of piece lengths - at most CAPACITY rows,
however many pieces - comes to the driver. There multiplicative weights solve the configuration program for pieces over ``FILLERS``, in classes of ``UNIT`` lengths: each round a
knapsack dynamic program prices out the fullest configuration under the present weights, it is used as often as its
scarcest length allows, and the weights of the lengths it covers fall. The fractions are rounded up as far as pieces
are left, fullest configurations first, the last piece of each being whatever length fits best; what stays is placed by best fit, decreasing, into the gaps and new sequences.
All this is on counts, so the plan's size depends on the capacity, not on the corpus.

Spark ranks the pieces of each length (in salted parts, so one very common length is many tasks) and looks the ranks
up in the plan, by buckets of ranks in which a few of its entries lie, which gives each its sequence and offset.

Tokens: word-level, so the ids of a text are those of its pre-token pieces one after the other; a worker keeps the ids
of pieces it has met. Texts beyond Latin-1, or that spell a special token, go through the tokenizer as a whole.

A null or empty text is the single end id. Repeated rows and null ids are packed one by one. An empty table gives none.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY, END, UNIT, FILLERS, ROUNDS, FALL, KEPT = 4096, 1, 8, 256, 600, 0.1, 300_000
PART, PARTS = 1000, 4000  # pieces of one length that are ranked together, and how often a length is split at most
VOCABULARY = "word_bpe_49k.json"

_cat = {b: unicodedata.category(chr(b)) for b in range(256)}
_white = {*range(9, 14), 0x20, 0x85, 0xA0}
_letters = b"".join(re.escape(bytes([b])) for b in range(256) if _cat[b][0] == "L")
_numbers = b"".join(re.escape(bytes([b])) for b in range(256) if _cat[b][0] == "N")
_others = b"".join(re.escape(bytes([b])) for b in range(256) if _cat[b][0] not in "LN" and b not in _white)
#: The tokenizer's own pre-token pieces, for Latin-1 bytes.
_PIECE = re.compile(b"'s|'t|'re|'ve|'m|'ll|'d|[" + _letters + b"]+|[" + _numbers + b"]|[" + _others + b"]+")


class Tokenizer:
    """Ids of texts as little-endian 32-bit bytes."""

    _own: dict[str, Tokenizer] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Public

        self.public, self.kept = Public.from_file(path), {}
        words = self.public.get_vocab()
        self.last = np.zeros(max(words.values()) + 1, bool)
        self.last[[i for w, i in words.items() if w.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> Tokenizer:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.public.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _meet(self, new: list[bytes]) -> None:
        """Keeps the ids of pieces: some at a time as one text of words, whose last ids tell where each ends."""
        lists = [new[k : k + 200] for k in range(0, len(new), 200)]
        for part in range(0, len(lists), 50):
            some = lists[part : part + 50]
            for pieces, e in zip(some, self.public.encode_batch_fast([b" ".join(ps).decode("latin-1") for ps in some], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                raw, at = ids.tobytes(), [0, *((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()]
                self.kept.update(zip(pieces, [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        found: list = []
        for t in texts:
            try:
                raw = None if "<|startoftext|>" in t or "<|endoftext|>" in t else t.lower().encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            found.append(t if raw is None else _PIECE.findall(raw))
        if len(self.kept) > KEPT:
            self.kept = {}
        new = list(set().union(*(f for f in found if isinstance(f, list))).difference(self.kept))
        self._meet(new)
        get = self.kept.__getitem__
        out = [b"".join(map(get, f)) if isinstance(f, list) else self._whole(f) for f in found]
        for p in new:
            if len(p) > 64:
                del self.kept[p]
        return out


def _pieces(path: str, capacity: int):
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        own = Tokenizer.of(path)
        for batch in batches:
            texts = common.as_strings(batch.column(1))
            for a, b in common.slices(texts):
                ids = own.ids(texts.slice(a, b - a).to_pylist())
                at, nth, start, length, crc = [], [], [], [], []
                for i, x in enumerate(ids):
                    x += end
                    for k, s in enumerate(range(0, len(x), 4 * capacity)):
                        part = x[s : s + 4 * capacity]
                        at.append(a + i)
                        nth.append(k)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(nth, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _knapsack(sizes: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(index, copies) of the best filling; a size goes in lots of 1, 2, 4, ... up to ``most`` copies."""
    best = np.zeros(capacity + 1)
    lots, took = [], []
    for i in range(len(sizes)):
        left, lot = int(min(most[i], capacity // sizes[i])), 1
        while left > 0:
            n = min(lot, left)
            size, value = int(sizes[i]) * n, worth[i] * n
            more = best[: capacity + 1 - size] + value
            better = more > best[size:] + 1e-12
            best[size:][better] = more[better]
            lots.append((i, n, size))
            took.append(better)
            left, lot = left - n, lot * 2
    out: dict[int, int] = {}
    c = int(best.argmax())
    for (i, n, size), better in zip(reversed(lots), reversed(took)):
        if c >= size and better[c - size]:
            out[i] = out.get(i, 0) + n
            c -= size
    return sorted(out.items())


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[list[tuple[int, int]], float]]:
    """The program's solution by multiplicative weights: configurations and how often each is used (fractions)."""
    done, used = np.zeros(len(sizes)), {}
    for _ in range(rounds):
        if not len(sizes) or done.min() >= 3:
            break
        worth = sizes * np.exp(-FALL * done)
        some = np.flatnonzero(done < done.min() + 4)  # what is covered this much more has next to no weight
        picked = [(int(some[i]), n) for i, n in _knapsack(sizes[some], worth[some], counts[some], capacity)]
        times = min(counts[i] / n for i, n in picked)
        for i, n in picked:
            done[i] += times * n / counts[i]
        key = tuple(picked)
        used[key] = used.get(key, 0.0) + times
    scale = max(1.0, float(np.median(done))) if len(sizes) else 1.0
    return [(list(c), x / scale) for c, x in used.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {length: copies in each}) that hold exactly the histogram's pieces."""
    left = dict(histogram)
    groups: list[tuple[int, dict[int, int]]] = []
    if left.pop(capacity, 0):
        groups.append((histogram[capacity], {capacity: 1}))
    slack: list[tuple[int, int]] = []  # (gap, group), sorted
    stock: dict[int, list[int]] = {}  # a class's lengths with pieces left, the longest last
    for size in sorted(left):
        if size > min(FILLERS, capacity // 4):
            stock.setdefault(-(-size // UNIT), []).append(size)
    classes = np.array(sorted(stock, reverse=True), np.int64)
    counts = np.array([sum(left[s] for s in stock[c]) for c in classes.tolist()], np.int64)
    there = sorted(left)
    solved = configurations(classes, counts, capacity // UNIT, rounds)
    for chosen, x in sorted(solved, key=lambda cx: (-sum(int(classes[i]) * n for i, n in cx[0]), -cx[1])):
        times = int(np.ceil(x))
        while times > 0:
            held: dict[int, int] = {}
            least = chosen[-1][0]  # classes stand from long to short
            for i, n in chosen:  # the longest pieces that are left of each class
                n -= i == least
                for size in reversed(stock[int(classes[i])]):
                    some = min(n, left[size])
                    held |= {size: some} if some else {}
                    n -= some
                if n:
                    times = 0
            gap = capacity - sum(size * some for size, some in held.items())
            at = bisect_right(there, gap) - 1
            while at >= 0 and left[there[at]] <= held.get(there[at], 0):
                at -= 1
            if at >= 0:  # the last one is whatever fits best
                held[there[at]] = held.get(there[at], 0) + 1
            if not times or not held:
                break
            run = min(times, *(left[size] // some for size, some in held.items()))
            for size, some in held.items():
                left[size] -= run * some
                if not left[size]:
                    there.pop(bisect_left(there, size))
                    own = stock.get(-(-size // UNIT), [])
                    if size in own:
                        own.remove(size)
            insort(slack, (capacity - sum(size * some for size, some in held.items()), len(groups)))
            groups.append((run, held))
            times -= run
    sizes = sorted(left, reverse=True)
    for size in sizes:
        while left[size]:
            at = bisect_left(slack, (size, -1))
            if at == len(slack):  # no gap is wide enough: new sequences
                each = min(capacity // size, left[size])
                n, held, gap = left[size] // each, {}, capacity
            else:
                gap, g = slack.pop(at)
                n, held = groups[g]
                each = min(gap // size, left[size])
                times = min(n, left[size] // each)
                if times < n:
                    insort(slack, (gap, len(groups)))
                    groups.append((n - times, held))
                groups[g], n = (0, {}), times
            left[size] -= n * each
            insort(slack, (gap - each * size, len(groups)))
            groups.append((n, held | {size: held.get(size, 0) + each}))
    return [g for g in groups if g[0]]


def _ranges(groups: list[tuple[int, dict[int, int]]]) -> list[tuple[int, ...]]:
    """(length, first rank, end rank, first sequence, copies in each, offset) of all plan entries."""
    at: dict[int, int] = {}
    base, rows = 0, []
    for n, held in groups:
        offset = 0
        for size, copies in sorted(held.items(), reverse=True):
            first = at.get(size, 0)
            rows.append((size, first, first + n * copies, base, copies, offset))
            at[size] = first + n * copies
            offset += size * copies
        base += n
    return rows


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    pieces = common.cut(pieces)
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most ``capacity`` rows
    rows = _ranges(plan(histogram, capacity))
    entries: dict[int, int] = {}
    for size, *_ in rows:
        entries[size] = entries.get(size, 0) + 1
    step = {size: -(-n // (4 * entries[size])) for size, n in histogram.items()}
    rows = [(r[0], b, *r[1:]) for r in rows for b in range(r[1] // step[r[0]], (r[2] - 1) // step[r[0]] + 1)]  # at most five for each entry
    ranges = spark.createDataFrame(rows, "length long, bucket long, first long, last long, base long, copies long, at long")
    lengths = spark.createDataFrame([(size, min(-(-n // PART), PARTS), step[size]) for size, n in histogram.items()], "length long, parts long, step long")
    salted = pieces.join(F.broadcast(lengths), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("parts")))  # ``capacity`` lengths at most
    counts = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    local = salted.withColumn("k", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = local.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("k")).withColumn("bucket", F.expr("rank div step"))
    # The plan has a few thousand entries at any scale.
    found = ranked.join(common.small(ranges, 200_000), ["length", "bucket"]).filter("rank >= first and rank < last")
    nth = F.col("rank") - F.col("first")
    sequence = F.col("base") + F.expr("(rank - first) div copies")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), (F.col("at") + F.pmod(nth, F.col("copies")) * F.col("length")).alias("offset"))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    common.prepare(docs.sparkSession)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return packed(tokenized(docs, path, capacity), capacity)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
