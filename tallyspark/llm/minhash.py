"""MinHash near-dedup by fast similarity sketching.

A text's set holds its distinct five-word shingles (white space splits words, A-Z are lower-cased; a text of
fewer words is one shingle; no words: empty set, linked with nothing). Two texts link at a Jaccard similarity of
``percent`` in a hundred or more, and links make components.

1. One Arrow pass hashes whole texts and fills a sketch of ``BANDS * ROWS`` places: in each round every element
   falls into one hashed place; the least (round, value) stays, and rounds go on until no place is empty - by
   chance in the first as many rounds as there are places, then place by place, which fills every one.
2. Equal sets form classes; only one row of each, known by its doc_id and a hash of its text, goes on. An id with
   several texts is in several classes, and links them.
3. Bands of the sketch make buckets; a lower threshold takes bands of fewer places, so that two texts at it miss each
   other with a probability of at most ``MISS``. A bucket of at most ``SMALL`` representatives gives all its pairs, so a row
   gives at most SMALL of them a band. A larger one gives a pair of each with its hub, the member that meets most.
   Joins on buckets, classes and hubs spread those with many rows over all tasks.
4. Whole sets confirm the links. Members that the hub left in different components are then joined exactly, by their
   differences from the hub: with k = (1 - t) / (1 + t) two sets x and y link only if their differences X and Y have
   |X & Y| >= (f(x) + f(y)) / 2, where f(x) = |X| - k|x|. If that isn't positive both link with the hub; else they
   share one of their rarest |X| - need + 1 differences, for each class of f that the partner may have. So near copies
   of one text, which share nearly all shingles but few differences, meet rarely. No pair within a component is made.
   Where more than ``SMALL`` meet in one difference, one of them becomes their hub in turn, in which that difference is
   none any more, and the same join goes on among them until no difference meets that many: each level takes its hubs
   away, so there is a last one. No key is ever paired with more than ``MANY`` meetings.
   Any one order of differences is right; rarity comes from hashed counters, which are broadcast: ``CELLS``, more where there
   are more than 16 differences to one, ``MOST_CELLS`` (32 MiB) at most. What they show once nobody shares.
   A first pass over the keys marks hashed cells that hold keys of several components; only such keys are joined.

Null texts count as empty. A null doc_id links with nothing: its component is null and it is kept. Repeated rows
give repeated results. Other columns are ignored. Very long texts are shingled whole; empty tables give no rows. Texts are
told apart by 128 bits of their shingles. Whole texts are read where they lie; of those only the ones with candidates are
shuffled, told by a bitmap (``common.meeting``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BANDS, ROWS, SMALL, SHINGLE, CLASS, CELLS, MOST_CELLS, PARTS, MOST, MANY = 24, 5, 48, 5, 5, 1 << 20, 1 << 24, 64, 65_535, 1 << 14
PLACES = BANDS * ROWS
_rng = np.random.default_rng(7)
_ORDER = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROUND = _rng.integers(1, 1 << 63, 2 * PLACES, dtype=np.uint64)
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = MIXED = np.uint64(2**64 - 1)
MISS = 1e-6


def rows_of(percent: int) -> int:
    """The most places a band may have, up to ROWS, for two texts at the threshold to miss each other in all bands that rarely."""
    able = (r for r in range(ROWS, 0, -1) if PLACES % r == 0 and (1 - (percent / 100) ** r) ** (PLACES // r) <= MISS)
    return next(able, 1)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles."""
    starts, ends = common.word_runs(data, at)
    words = common.span_hashes(common.LOWER[data], starts, ends)
    first = np.searchsorted(starts, at)
    n = max(0, len(words) - SHINGLE + 1)
    joined = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        joined += words[k : k + n] * _ORDER[k]
    joined = common.mix(joined)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(joined[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(common.mix((words[a:b] * _ORDER[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(joined[:0])
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of PLACES numbers for each set that isn't empty; two rows agree in a place about as often as sets overlap."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    places = np.full(len(sets) * PLACES, _NONE)
    for i in range(2 * PLACES):
        h = common.mix(every ^ _ROUND[i])
        place = (h >> np.uint64(32)) * np.uint64(PLACES) >> np.uint64(32) if i < PLACES else np.uint64(i - PLACES)
        value = (np.uint64(i) << np.uint64(52)) | (common.mix(h) >> np.uint64(12))
        np.minimum.at(places, owner * PLACES + place.astype(np.int64), value)
        if i % 4 == 0 or i >= PLACES or i < 4:
            open_ = (places.reshape(-1, PLACES) == _NONE).any(axis=1)
            if not open_.any():
                break
            stay = open_[owner]
            if not stay.all():
                every, owner = every[stay], owner[stay]
    return places.reshape(-1, PLACES)


def band_keys(places: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = places.reshape(-1, PLACES // rows, rows) * _BAND.reshape(-1, rows)
    return common.mix(parts.sum(axis=2, dtype=np.uint64) + np.arange(1, PLACES // rows + 1, dtype=np.uint64)).view(np.int64)


def _sketch(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.as_strings(batch.column(1))
            for a, b in common.slices(texts):
                sets = shingle_sets(*common.text_bytes(texts, a, b))
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, band_keys(sketches([sets[i] for i in full]), rows)):
                        keys[i] = row
                print_ = [[int(common.mix(s ^ k).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets] for k in (_ROUND[0], _ROUND[1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(print_[0], pa.int64()), pa.array(print_[1], pa.int64()), pa.array(keys, pa.list_(pa.int64())), batch.column(2).slice(a, b - a)], ["doc_id", "n", "p", "q", "keys", "h"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = common.as_strings(batch.column(1))
        for a, b in common.slices(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in shingle_sets(*common.text_bytes(texts, a, b))], pa.binary())], ["id", "s"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, x, y = (batch.column(i) for i in range(4))
            good = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) with their sets x and y; a hub's many rows, and its set, go to many tasks."""
    one = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("x")), "u")
    hubs = pairs.groupBy("v").agg(F.count("*").alias("size"))
    theirs = common.cut(sets.select(F.col("id").alias("v"), F.col("s").alias("y")).join(hubs, "v"))
    return common.spread(one, theirs, ["v"], F.length("y")).select("u", "v", "x", "y")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets meet the threshold."""
    return _with_sets(pairs, sets).mapInArrow(_confirm(percent), "u long, v long")


def _differences(batches):
    """(hub, id, n, d): the elements in which a set differs from its hub's; u, v, x, y are document, hub and their sets."""
    for batch in batches:
        n, diff = [], []
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
            n.append(len(a))
            diff.append(np.setxor1d(a, b, assume_unique=True).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(n, pa.int64()), pa.array(diff, pa.binary())], ["hub", "id", "n", "d"])


def _cells(hub: int, elements: np.ndarray, cells: int) -> np.ndarray:
    return (common.mix(elements ^ common.mix(np.array([hub & (2**64 - 1)], np.uint64))) % np.uint64(cells)).astype(np.int64)


def _tally(cells: int):
    """(part, c): a task's counters in PARTS parts, as 16-bit numbers; parts without any are left out."""

    def run(batches):
        counts = np.zeros(cells, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                np.add.at(counts, _cells(batch.column(0)[i].as_py(), np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64), cells), 1)
        parts = np.minimum(counts, MOST).astype("<u2").reshape(PARTS, -1)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["part", "c"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sum of one part's counters: as many rows as there are tasks."""
    total = 0
    for x in table.column("c"):
        total = total + np.frombuffer(x.as_buffer(), "<u2").astype(np.int64)
    return pa.table({"part": table.column("part").slice(0, 1), "c": pa.array([np.minimum(total, MOST).astype("<u2").tobytes()], pa.binary())})


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What two sides met in each cell: 0 none, MIXED different components, else the one component (its number and one)."""
    return np.where(a == 0, b, np.where((b == 0) | (a == b), a, MIXED))


def _key_cells(percent: int, counts):
    """(part, at, of): of the cells that a task's keys fall into, the place within their part and whose they are."""

    def run(batches):
        cells = len(counts.value)
        of = np.zeros(cells, np.uint64)
        for batch in _prefixes(percent, counts)(batches):
            at = (np.asarray(batch.column(0)).view(np.uint64) % np.uint64(cells)).astype(np.int64)
            comp = np.asarray(batch.column(1)).view(np.uint64) + np.uint64(1)
            order = np.lexsort((comp, at))
            at, comp = at[order], comp[order]
            begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
            least, most = comp[begins], comp[np.r_[begins[1:], len(at)] - 1] if len(at) else comp
            of[at[begins]] = _met(of[at[begins]], np.where(least == most, least, MIXED))
        of = of.reshape(PARTS, -1)
        some = np.flatnonzero(of.any(axis=1))
        held = [np.flatnonzero(of[k]) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([h.astype("<i4").tobytes() for h in held], pa.binary()), pa.array([of[k][h].astype("<u8").tobytes() for k, h in zip(some, held)], pa.binary())], ["part", "at", "of"])

    return run


def _mixed(cells: int):
    """Bits of one part's cells in which keys of different components fall, over all tasks."""

    def run(table: pa.Table) -> pa.Table:
        of = np.zeros(cells // PARTS, np.uint64)
        for x, y in zip(table.column("at"), table.column("of")):
            at = np.frombuffer(x.as_buffer(), "<i4")
            of[at] = _met(of[at], np.frombuffer(y.as_buffer(), "<u8"))
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(of == MIXED).tobytes()], pa.binary())})

    return run


def _prefixes(percent: int, counts, mixed=None):
    """(key, comp, id, side, f, after) of the rarest differences ``d`` of a set of size ``n`` that a partner of each class of f must share.

    With ``mixed`` only keys whose cell is one of several components. ``side``: 0 in the lower class of the two, 1 in the higher, 2 if they are one; ``after``: how many differences are less rare.
    """
    t = percent / 100
    k = (1 - t) / (1 + t)

    def run(batches):
        for batch in batches:
            keys, after, per = [], [], []
            for i in range(batch.num_rows):
                hub, doc, n, comp = (batch.column(c)[i].as_py() for c in range(4))
                able = [c["own"] for c in batch.column(5)[i].as_py() if not c["least"] == c["most"] == comp]
                e = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                met = counts.value[_cells(hub, e, len(counts.value))]
                ranked = e[np.lexsort((e, met))]
                size, own_only = len(ranked), int((met < 2).sum())  # those stand first and nobody shares them
                f, most = size - k * n, k * (n + n / t)  # two linked sets differ in no more than ``most``
                own = math.floor(f / CLASS)
                first, end = math.floor((size - most - k * n / t) / CLASS), math.floor((size + most - k * n * t) / CLASS)
                for c in able:
                    if not first <= c <= end or f + (c + 1) * CLASS <= 0:
                        continue
                    top = size + 1 - max(1, math.ceil((f + c * CLASS) / 2 - 1e-6))
                    if top > own_only:
                        pair = (min(own, c) * 1_000_003 + max(own, c)) & (2**64 - 1)
                        made = common.mix(ranked[own_only:top] ^ common.mix(np.array([hub & (2**64 - 1)], np.uint64) ^ common.mix(np.array([pair], np.uint64))))
                        keys.append(made.view(np.int64))
                        after.append(np.arange(size - 1 - own_only, size - 1 - top, -1))
                        per.append((comp, doc, 2 if own == c else int(own > c), f, top - own_only))
            if keys:
                comp, doc, side, f, top = (np.array(x) for x in zip(*per))
                key = np.concatenate(keys)
                use = np.ones(len(key), bool) if mixed is None else mixed.value[(key.view(np.uint64) % np.uint64(len(mixed.value))).astype(np.int64)]
                many = lambda x: np.repeat(x, top)[use]
                yield pa.RecordBatch.from_arrays([
                    pa.array(key[use], pa.int64()), pa.array(many(comp), pa.int64()), pa.array(many(doc), pa.int64()),
                    pa.array(many(side).astype(np.int8)), pa.array(many(f), pa.float64()), pa.array(np.concatenate(after).astype(np.int32)[use]),
                ], ["key", "comp", "id", "side", "f", "after"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    common.prepare(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    seen = common.cut(base.mapInArrow(_sketch(rows_of(percent)), "doc_id long, n long, p long, q long, keys array<long>, h long"))
    whole = seen.filter("n > 0 and doc_id is not null")
    classes = whole.groupBy("n", "p", "q").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.count("*").alias("size"), F.first("keys").alias("keys"))
    classes = common.cut(classes.withColumn("id", F.monotonically_increasing_id()))

    rows = classes.select("id", "n", F.explode("keys").alias("key"))
    buckets = common.cut(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    shared = common.cut(common.spread(rows, buckets.withColumn("met", F.col("size")), ["key"]))

    small = shared.filter(F.col("met") <= SMALL).select("key", "id", "n")
    other = small.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"))
    pairs = small.join(other, "key").filter((F.col("id") < F.col("id2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")))
    pairs = pairs.select(F.col("id").alias("u"), F.col("id2").alias("v"))

    large = shared.filter(F.col("met") > SMALL)
    most = large.groupBy("id").agg(F.sum("met").alias("all"))
    hubs = large.join(most, "id").groupBy("key").agg(F.max(F.struct("all", "id")).alias("hub"), F.count("*").alias("size"))
    hubs = common.cut(hubs.select("key", F.col("hub.id").alias("v"), "size"))
    hubbed = common.cut(common.spread(large.select("key", F.col("id").alias("u")), hubs, ["key"]).filter("u <> v").select("u", "v").distinct())
    first = common.cut(pairs.unionByName(hubbed).distinct())

    wanted = first.select(F.col("u").alias("id")).union(first.select("v")).distinct()
    wanted = wanted.join(classes.select("id", "rep.*"), "id")
    at = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("h").cast("string")).alias("at")
    texts = common.meeting(base.select(at, "text"), common.cut(wanted.select(at, "id")), "at")
    sets = common.cut(texts.dropDuplicates(["at"]).select("id", "text").mapInArrow(_sets, "id long, s binary"))
    links = common.cut(_links(first, sets, percent))
    links = _rest(hubbed, sets, links, percent)

    edges = links.unionByName(_several(whole, classes))
    found = common.components(edges)
    members = found.unionByName(found.select(F.col("component").alias("node"), "component")).distinct()
    least = members.join(classes.select(F.col("id").alias("node"), "rep.doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("root"))
    rooted = members.join(least, "component").select(F.col("node").alias("id"), "root")
    told = common.cut(classes.join(rooted, "id", "left").select("n", "p", "q", "size", F.coalesce("root", "rep.doc_id").alias("root")))

    named = common.spread(whole.select("doc_id", "n", "p", "q"), told, ["n", "p", "q"]).select("doc_id", "n", "root")
    alone = seen.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("root"))
    return named.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("root"), F.lit(True)).alias("kept"))


def _several(whole: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the classes of the texts of one id."""
    differ = " or ".join(f"min({c}) <> max({c})" for c in "npq")
    ids = common.cut(whole.groupBy("doc_id").agg(F.expr(differ).alias("several")).filter("several").select("doc_id"))
    if ids.isEmpty():
        return whole.sparkSession.createDataFrame([], "u long, v long")
    each = whole.join(ids, "doc_id", "left_semi").select("doc_id", "n", "p", "q").distinct().join(classes.select("n", "p", "q", "id"), ["n", "p", "q"])
    least = each.groupBy("doc_id").agg(F.min("id").alias("v"))
    return common.cut(each.join(least, "doc_id").filter("id <> v").select(F.col("id").alias("u"), "v").distinct())


def _rest(hubbed: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """``links`` and all others between documents (u) of one hub (v), as far as components need them, exactly."""
    if hubbed.isEmpty():
        return links
    found = common.components(links).withColumnRenamed("node", "id")
    each = common.cut(_with_sets(hubbed, sets).mapInArrow(_differences, "hub long, id long, n long, d binary"))
    differ = each.agg(F.coalesce(F.sum(F.length("d")), F.lit(0))).first()[0] // 8
    cells = min(MOST_CELLS, max(CELLS, 1 << (differ // 16).bit_length()))
    told = each.mapInArrow(_tally(cells), "part int, c binary").groupBy("part").applyInArrow(_added, "part int, c binary").toArrow()  # PARTS rows, 2 bytes a cell
    counts = np.zeros((PARTS, cells // PARTS), np.uint16)
    for part, c in zip(told.column(0).to_pylist(), told.column(1)):
        counts[part] = np.frombuffer(c.as_buffer(), "<u2")
    counts = counts.ravel()
    shared = each.sparkSession.sparkContext.broadcast(counts)
    placed = common.cut(each.join(found, "id", "left").select("hub", "id", "n", F.coalesce("component", "id").alias("comp"), "d"))
    t = percent / 100
    own = F.floor((F.length("d") / 8 - F.lit((1 - t) / (1 + t)) * F.col("n")) / CLASS)
    able = placed.groupBy("hub", own.alias("own")).agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("size"))
    able = able.groupBy("hub").agg(F.sum("size").alias("size"), F.collect_list(F.struct("own", "least", "most")).alias("able"))  # classes of one hub
    placed = common.spread(placed, common.cut(able), ["hub"], 24 * F.size("able")).select("hub", "id", "n", "comp", "d", "able")
    found_in = placed.mapInArrow(_key_cells(percent, shared), "part int, at binary, of binary").groupBy("part").applyInArrow(_mixed(cells), "part int, bits binary").toArrow()  # PARTS rows, a bit for each cell
    bits = np.zeros((PARTS, cells // PARTS), bool)
    for part, x in zip(found_in.column(0).to_pylist(), found_in.column(1)):
        bits[part] = np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8)).astype(bool)
    mixed_cells = each.sparkSession.sparkContext.broadcast(bits.ravel())
    keys = common.cut(placed.mapInArrow(_prefixes(percent, shared, mixed_cells), "key long, comp long, id long, side byte, f double, after int"))
    shared.destroy()
    mixed_cells.destroy()
    low, high, alike = (F.count(F.when(F.col("side") == x, 1)) for x in (0, 1, 2))
    mixed = keys.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("size"), (low * high + alike * alike / 2).alias("meet"), F.min("id").alias("hub"))
    mixed = common.cut(mixed.filter("a <> b and meet > 0").select("key", "size", "meet", "hub"))
    left = common.cut(common.spread(keys, mixed, ["key"]))
    few = left.filter(F.col("meet") < MANY).select("key", "comp", "id", "side", "f", "after")
    right = few.select("key", *[F.col(c).alias(f"{c}2") for c in few.columns[1:]])
    sides = ((F.col("side") == 2) & (F.col("side2") == 2) & (F.col("comp") < F.col("comp2"))) | ((F.col("side") == 0) & (F.col("side2") == 1) & (F.col("comp") != F.col("comp2")))
    enough = 1 + F.least("after", "after2") >= (F.col("f") + F.col("f2")) / 2 - 1e-6
    pairs = few.join(right, "key").filter(sides & enough).select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v"))
    many = common.cut(left.filter(F.col("meet") >= MANY).filter("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct())
    more = common.cut(_links(common.cut(pairs.unionByName(many).distinct()), sets, percent))
    links = links.unionByName(more)
    return _rest(many, sets, links, percent)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), 85)
