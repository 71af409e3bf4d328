"""What the operators of this subpackage share: lineage cuts, Arrow block walking, numpy hashing, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold; a batch of ordinary documents then takes a few MB.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches, and names a checkpoint folder only where the session has none and runs on this machine (tests)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and goes on from there."""
    prepare(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has at most so many rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key that meets more rows is hot; so many hot keys, or bytes of what they carry, may be broadcast; beyond that rows are salted.
HOT, HOT_KEYS, HOT_BYTES, SALTS = 256, 20_000, 16 << 20, 16


def spread(rows: DataFrame, groups: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row for each key and in ``size`` how many rows meet it.

    No task gets all rows of a hot key: hot groups are broadcast where their number and bytes are small (``weight``: bytes
    of one), else every group stands once for each salt. Give ``groups`` cut, as it is read more than once.
    """
    hot = groups.filter(F.col("size") > HOT)
    n, held = hot.agg(F.count("*"), F.coalesce(F.sum(F.lit(64) if weight is None else weight), F.lit(0))).first()
    if not n:
        return rows.join(groups.drop("size"), keys)
    if n <= HOT_KEYS and held <= HOT_BYTES:
        few = F.broadcast(hot.drop("size"))
        cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.filter(F.col("size") <= HOT).drop("size"), keys)
        return cold.unionByName(rows.join(few, keys))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    each = groups.drop("size").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return salted.join(each, [*keys, "_salt"]).drop("_salt")


#: A bitmap has so many bits a key, up to BITS (32 MiB, which are broadcast), in rows of PAGE bits.
BITS_EACH, BITS, PAGE = 64, 1 << 28, 1 << 15
#: So many keys are broadcast themselves.
FEW = 16_384


def may_be_in(rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_may``: false only where ``key`` (not null) is surely not in ``some``. Rows aren't shuffled; a bounded bitmap is broadcast."""
    bits = min(BITS, max(PAGE, 1 << (BITS_EACH * some.count()).bit_length()))
    bit = F.pmod(F.xxhash64(F.lit(29), key), F.lit(bits))
    pages = some.select((bit / PAGE).cast("int").alias("_page"), (bit % PAGE).alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = rows.withColumn("_at", bit).withColumn("_page", (F.col("_at") / PAGE).cast("int")).withColumn("_at", (F.col("_at") % PAGE).cast("int"))
    told = told.join(F.broadcast(pages), "_page", "left")
    return told.select(*rows.columns, F.coalesce(F.getbit(byte, F.col("_at") % 8) == 1, F.lit(False)).alias("_may"))


def meeting(rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``some`` (cut; one row a ``key``); of ``rows`` only those that may meet one are shuffled, none where ``some`` is small."""
    if some.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(some), key)
    return may_be_in(rows, some, key).filter("_may").drop("_may").join(some, key)


def chosen(rows: DataFrame, good: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``good``; every key is in one of ``good`` and ``bad`` (cut, a column, a row a key).

    Rows that can't be bad stay where they are; the others meet the good keys that a bitmap of bad ones doesn't tell from those.
    """
    told = may_be_in(rows, bad, key)
    unsure = cut(may_be_in(good, bad, key).filter("_may").select(key))
    return told.filter("not _may").drop("_may").unionByName(meeting(told.filter("_may").drop("_may"), unsure, key))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a document belongs to the held-out fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def slices(texts: pa.Array, most: int = (1 << 20) - 2) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; a longer text stands alone."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(texts: pa.Array, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of some rows, and where each begins among them (one more than rows); nulls are empty."""
    at = np.frombuffer(texts.buffers()[1], np.int32, stop - start + 1, (texts.offset + start) * 4).astype(np.int64)
    data = texts.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(stop - start + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def as_strings(column: pa.Array) -> pa.Array:
    """The column as plain strings with 32-bit offsets and no bytes under nulls."""
    return column.cast(pa.string()).fill_null("")


_rng = np.random.default_rng(20_011)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        got = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _P)]).astype(np.uint64)), np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _PINV)]).astype(np.uint64))
        if size > 1 << 21:
            return got  # for one very long text; not kept
        _powers[size] = got
    return _powers[size]


def word_runs(data: np.ndarray, at: np.ndarray, gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all rows begin and end; a word never crosses rows."""
    word = ~gap[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = at[(at > 0) & (at < len(data))]
    begin[inner] = word[inner]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    stop[inner - 1] = word[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial by prefix sums, then mixed."""
    up, down = _pow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): the least node reachable.

    Alternates large and small stars; each round is cut, so a lost executor costs one round at most.
    Groups are only ever reduced to their minimum, which Spark does before the shuffle.
    """

    def low(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())

    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(low(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(low(large), "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low(large).select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
