import hashlib
import random
import re

from tallyspark.llm import pii


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(reversed(d))) % 10 == 0


RAW = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", luhn),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= sum(c.isdigit() for c in s) <= 15),
}


def brute(text):
    spans = {k: [m.span() for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in RAW.items()}
    told = ",".join(f"{k}:{a}:{b}" for k in RAW for a, b in spans[k])
    return (*(len(spans[k]) for k in RAW), hashlib.sha256(told.encode()).hexdigest()), told


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = pii.op5(spark, sf).collect()
    assert len(out) == len(docs)
    print([sum(r[i] for r in out) for i in range(1, 5)], sum("context" in r.spans for r in out))
    for r in out:
        want, told = brute(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want and r.spans.startswith(told)


EDGES = [
    None, "", "é a.b%c@d-e.f.g%h@i.j@k.l m@n m@n.", "1.2.3.4.5.6.7.8 256.1.1.1 0000001.02.3.255 1.1.1.1000 1.2.3", "4111 1111 1111 1111, 4111111111111112 4111-1111-1111-1111-0 4 4",
    "+1 (555) 123-4567. +12 +123456789012345678 ++33.1.22.33.44.55- +1-2", "\x01a@b.c\x01 $0 \\1 x@y.z", "a@b.c" * 2000, "1" * 50_000 + " " + "a" * 50_000 + "@", "9.9.9.9 " * 3000, "a@" + "b." * 20_000 + "c", "+" * 2000 + "+1" * 2000,
]


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(EDGES)] + [(None, EDGES[2], 5), (2, EDGES[2], 5)], "doc_id long, text string, email int")
    out = pii.digest(docs).collect()
    assert len(out) == len(EDGES) + 2
    for r in out:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute(EDGES[2 if r.doc_id is None else r.doc_id])[0], r.doc_id
    assert pii.digest(docs.limit(0)).count() == 0


def bootstrap_rows():
    rows = [(i, f"words here Mail: u{i}@host.example and of more text") for i in range(20)]
    rows += [(50 + i, f"some release{i}x of it") for i in range(20)]
    return rows + [(100, "hidden Mail: user77_at_host stays, of user88_at_host too"), (101, "again id <user77_at_host>. here"), (102, "of of of 123456x")]


def test_patterns_discover_unseen_identifiers(spark):
    out = {r.doc_id: r for r in pii.digest(spark.createDataFrame(bootstrap_rows(), "doc_id long, text string")).collect()}
    assert out[100].spans == "context:13:27" and out[101].spans == "context:10:24" and out[102].spans == "" and out[3].spans.startswith("email:17:")
    assert out[100].n_context == 1 and out[100].found and not out[102].found and not out[55].found


def test_planted_identifiers_are_found_and_others_are_not(spark):
    """Identifiers that no base pattern holds, in the contexts of seeds: left words, right words, both, and shape."""
    r = random.Random(11)
    filler = [f"{a}{b}" for a in "ban cor del fim gus".split() for b in "ta lo mi ne".split()]
    some = lambda n: " ".join(r.choice(filler) for _ in range(n))
    seeds = [lambda: f"{some(1)}{r.randrange(99)}@{r.choice(filler)}.example", lambda: f"+49 171 {r.randrange(10**6, 10**7)}", lambda: ".".join(str(r.randrange(256)) for _ in range(4))]
    unseen = [lambda: f"{some(1)}{r.randrange(99)}_at_{r.choice(filler)}", lambda: f"cust-{r.randrange(10**5, 10**6)}", lambda: f"ID/{r.randrange(10**6, 10**7)}/x"]
    decoys = [lambda: f"release-{r.randrange(10**5)}", lambda: f"chapter{r.randrange(1000):03d}"]
    frames = ["{} please contact {} for details {}", "{} reach me at {} {}", "{} user name is {} over there {}"]
    rows, planted = [], {}
    for d in range(900):
        kind = 0 if d % 3 == 0 else 2 if d % 9 == 1 else 1
        frame = r.choice(frames) if kind else r.choice(["{} see {} {}", "{} in {} we read {}"])
        inner = r.choice((decoys, seeds, unseen)[kind])()
        text = frame.format(some(r.randrange(1, 20)), inner, some(r.randrange(1, 20)))
        if kind == 2:
            planted[d] = (text.index(inner), text.index(inner) + len(inner))
        rows.append((d, text))
    out = pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {(o.doc_id, *map(int, x.split(":")[1:])) for o in out for x in o.spans.split(",") if x.startswith("context")}
    want = {(d, *at) for d, at in planted.items()}
    print(len(want), len(want & added) / len(want), len(want & added) / max(1, len(added)))
    assert len(want & added) >= 0.95 * len(want) and len(want & added) >= 0.95 * len(added)
    assert all(o.found == bool(o.spans) and o.n_context == o.spans.count("context") for o in out)


def test_mask(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in bootstrap_rows()] + [(200, None, "y"), (201, "é +1 555 123 4567 8, 9.9.9.9", "y")], "doc_id long, text string, occ string")
    out = {r.doc_id: (r.text, r.occ) for r in pii.mask(docs).collect()}
    assert len(out) == docs.count()
    assert out[3] == ("words here Mail: [EMAIL] and of more text", "x")
    assert out[100][0] == "hidden Mail: [CONTEXT] stays, of user88_at_host too"
    assert out[200] == (None, "y") and out[201] == ("é [PHONE], [IP]", "y")
