import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import packing


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def whole(rows, public, capacity=4096):
    """Pieces by the tokenizer alone."""
    out = []
    for doc, text in rows:
        ids = [*public.encode(text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            out.append((doc, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return Counter(out)


def gapless(rows, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_whole_table(spark, sf, public):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = packing.op1(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == whole(docs, public)
    least = -(-sum(r.length for r in out) // 4096)
    assert gapless(out) <= 1.01 * least


def test_edges(spark, public):
    texts = [None, "", "It's  THE end\x85don't I'LL ½²3 '''s \x1c\x1f_-!!ß İ", "ΑΣ ς ﬁ é 日本 😀's", "<|endoftext|> a <|startoftext|>b", "w" * 3000, "one two " * 5000, "µªº×÷ÀÿŸœ", "''re 'tis \xad\x00\x7f"]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, texts[2], 3), (2, texts[2], 3)], "doc_id long, text string, piece int")
    out = packing.pack(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == whole([(r.doc_id, r.text) for r in docs.collect()], public)
    gapless(out)
    assert packing.pack(docs.limit(0)).count() == 0


def test_plan_holds_every_piece_and_beats_plain_best_fit_where_it_errs():
    r = np.random.default_rng(0)
    for h in ({1400: 900, 1300: 900, 1700: 10}, {int(k): int(v) for k, v in zip(r.integers(1, 4096, 400), r.integers(1, 60, 400))}, {4096: 5}, {1: 10_000}, {2049: 7, 2047: 7}, {}):
        groups, held = packing.plan(h), Counter()
        for n, parts in groups:
            assert sum(a * b for a, b in parts.items()) <= 4096
            for a, b in parts.items():
                held[a] += n * b
        assert held == Counter(h)
    pairs = {1400: 900, 1300: 900, 1700: 10}
    assert sum(n for n, _ in packing.plan(pairs)) < sum(n for n, _ in packing.plan(pairs, rounds=0))


def test_knapsack_against_all_choices():
    r = np.random.default_rng(4)
    for _ in range(30):
        sizes, worth, most = r.integers(2, 9, 4), r.random(4), r.integers(1, 4, 4)
        best = max((sum(w * k for w, k in zip(worth, ks)) for ks in np.ndindex(*(most + 1)) if sum(sizes * ks) <= 20))
        got = packing._knapsack(sizes, worth, most, 20)
        assert abs(sum(worth[i] * n for i, n in got) - best) < 1e-9 and sum(int(sizes[i]) * n for i, n in got) <= 20 and all(n <= most[i] for i, n in got)
