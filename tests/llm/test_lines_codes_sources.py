"""Line dedup, vector codes and the divergence of sources against plain computations."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from docspark.llm import common, line_dedup, source_divergence, vector_codes

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_lines(rows, least, chars):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(d)
    top = {k: max((x for x in ds if x is not None), default=None) for k, ds in held.items() if len(k) >= chars and len(ds) >= least}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def lines_of(spark, rows, **named):
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, hi long, lo long, lines string")
    return sorted(map(tuple, line_dedup.drop_repeated_lines(frame, **named).collect()), key=str)


def test_lines(spark):
    rng = random.Random(5)
    common_lines = [f"Line number {i} Ünï stands in many documents of this corpus, ÄB" for i in range(12)] + ["short line"]
    rows = []
    for d in range(120):
        lines = [rng.choice(["", "  ", "\t"]) + rng.choice([str.upper, str.lower, str])(rng.choice(common_lines)) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(6))]
        rows.append((d, "\n".join([*lines, *([f"own {d} " * 8] if d % 3 else [])])))
    rows += [(7, "another row of an id\n" + common_lines[0]), (None, common_lines[0] + "\n" + common_lines[1]), (None, None), (500, ""), (501, "\n\n"), (502, "\n".join([common_lines[2]] * 3000)), (503, None)]
    rng.shuffle(rows)
    want = brute_lines(rows, 5, 40)
    assert sum(r[3] for r in want) > 100
    assert lines_of(spark, rows) == want
    assert lines_of(spark, rows, batches=9, fan=2) == want
    assert lines_of(spark, rows, batches=1, least=2, min_chars=5) == brute_lines(rows, 2, 5)
    assert lines_of(spark, rows, least=10**6) == sorted(((d, t or "", len((t or "").split("\n")), 0) for d, t in rows), key=str)


def test_lines_of_few_rows(spark, empty):
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    assert lines_of(spark, [(None, "a" * 50)] * 9) == [(None, "a" * 50, 1, 0)] * 9
    assert not spark.catalog.listTables()


def test_keyed_join_of_many_keys(spark):
    rows = spark.range(5000).selectExpr("IF(id % 3 = 0, 1, id % 400) AS key", "id")
    table = spark.range(300).selectExpr("id AS key", "id * 2 AS twice")
    want = sorted((1 if i % 3 == 0 else i % 400, i) for i in range(5000))
    want = [(k, i, 2 * k) for k, i in want if k < 300]
    for most in (10, 1000):
        assert sorted(map(tuple, common.keyed_join(rows, table, ["key"], most).collect())) == want


def brute_codes(rows, parts, entries, rounds):
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in kept], np.float64) * 256).astype(np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].copy()
    nearest = lambda: ((x[:, None] - books[None]) ** 2).sum(3).argmin(1)
    for _ in range(rounds):
        code = nearest()
        for p in range(parts):
            for e in range(len(books)):
                own = x[code[:, p] == e, p]
                if len(own):
                    books[e, p] = own.sum(0) // len(own)
    code = nearest()
    error = sum(((x[:, p] - books[code[:, p], p]) ** 2).sum(1) for p in range(parts))
    by_label = Counter()
    for r, e in zip(kept, error.tolist(), strict=True):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for p in range(parts) for b in books for v in b[p].tolist()).encode()).hexdigest()
    return sorted(((r[0], bytes(c.tolist()).hex(), e, by_label[r[2]], digest) for r, c, e in zip(kept, code, error.tolist(), strict=True)), key=str)


def vectors_of(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding {kind}, label int, error long, block string")


@pytest.mark.parametrize("entries, block", [(8, 50), (64, 4096), (256, 333)])
def test_codes(spark, entries, block):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (5, 8))
    rows = [(i, (middle[i % 5] + rng.normal(0, 0.2, 8)).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(1, 1500)]
    rows += [(i, [0.25, -0.25] * 4, 1) for i in range(2000, 2600)]  # equal vectors
    rows += [(None, [1.0] * 8, None), (5, [0.5] * 8, 2), (5, [0.25] * 8, 2), (0, [-0.001] * 8, 4), (-3, [-0.001] * 8, 4)]
    odd = [(3000, None, 1), (3001, [], 1), (3002, [None] * 8, 1), (3003, [float("nan")] * 8, 1), (3004, [float("-inf")] * 8, 1), (3005, [1.0] * 4, 1)]
    got = vector_codes.vector_codes(vectors_of(spark, rows + odd), parts=4, entries=entries, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows, 4, entries, 2)


def test_codes_of_few_vectors(spark):
    assert vector_codes.vector_codes(vectors_of(spark, [])).count() == 0
    assert vector_codes.vector_codes(vectors_of(spark, [(1, None, 1), (2, [], None)])).count() == 0
    rows = [(9, [float(i) for i in range(16)], None)]
    assert list(map(tuple, vector_codes.vector_codes(vectors_of(spark, rows, "array<double>")).collect())) == brute_codes(rows, 16, 64, 2)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(vectors_of(spark, rows), parts=5)
    with pytest.raises(Exception, match="exact 64-bit"):
        vector_codes.vector_codes(vectors_of(spark, [(1, [1e30] * 16, 1)]))


def test_trees_hold_and_prune():
    rng = np.random.default_rng(1)
    points = rng.integers(-300, 300, (3000, 4)) + rng.integers(-4, 5, (3000, 1)) * 2000
    tree = vector_codes.laid_out(points)
    assert sorted(tree["order"].tolist()) == list(range(3000))
    for ball in range(len(tree["start"])):
        start, size, first = tree["start"][ball], tree["size"][ball], tree["first"][ball]
        own = points[tree["order"][start : start + size]]
        assert (own.sum(0) == tree["sum"][ball]).all()
        assert np.sqrt(((own - tree["mean"][ball]) ** 2).sum(1)).max() <= tree["radius"][ball] + 1e-9
        if first:
            assert tree["size"][first] + tree["size"][first + 1] == size and tree["start"][first] == start
    book = points[:32]
    balls, _, places, _ = vector_codes.owners(tree, points, book)
    assert tree["size"][balls].sum() + len(places) == 3000 and len(balls) > 20
    assert (vector_codes.coded(tree, points, book) == ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)).all()


def brute_divergence(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER))) for t, lang, source in rows]
    out = []
    for lang in {r[0] for r in found}:
        held = Counter(t for la, _, ts in found if la == lang for t in set(ts))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        counts = {s: Counter(t for la, so, ts in found if (la, so) == (lang, s) for t in ts) for s in {s for la, s, _ in found if la == lang}}
        whole = Counter(t for c in counts.values() for t in c.elements())
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        q, ps = shares(whole), {s: shares(c) for s, c in counts.items()}
        for s, p in ps.items():
            pairs = sorted((-sum(f(p[t], o[t]) for t in kept), x.encode()) for x, o in ps.items() if x != s)
            marks = sorted((-f(p[t], q[t]), t.encode()) for t in kept if counts[s][t] and p[t] > q[t])[:top]
            out += [(lang, s, part, x.decode(), -v, i) for part, found_ in (("pair", pairs), ("term", marks)) for i, (v, x) in enumerate(found_, 1)]
    return sorted(out)


def sources_of(spark, rows, **named):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, value long, term string, rank int")
    return sorted(map(tuple, source_divergence.source_divergence(frame, **named).collect()))


def test_divergence(spark):
    rng = random.Random(2)
    vocabulary = ["Alpha", "beta", "gamma", "Straße", "ÄRGER", "日本", "don", "x"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [(" ".join(rng.choices(vocabulary, [1 / (1 + (i + s) % 50) for i in range(len(vocabulary))], k=rng.randrange(30))), rng.choice(["en", "de", None]), f"s{s}") for s in (rng.randrange(23) for _ in range(700))]
    rows += [(None, "en", "silent"), ("", "en", None), ("don't-stop_me1now\x00A", "en", "s1"), ("word " * 3000 + "\nend", "de", "s2"), ("few words", "fr", "a"), ("other", "fr", "b"), (None, "it", "only")]
    want = brute_divergence(rows, 10, 10)
    assert sources_of(spark, rows) == want
    assert sources_of(spark, rows, group_block=3, term_block=16) == want
    assert sources_of(spark, rows, min_docs=1, top=3) == brute_divergence(rows, 1, 3)
    assert sources_of(spark, []) == []


def test_term_counts_of_long_texts(monkeypatch):
    monkeypatch.setattr(source_divergence, "PART_BYTES", 7)
    text = "Ein Äpfelchen, two THREE\t4four " * 50
    want = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
    assert [w.decode() for part in source_divergence.words(text.encode()) for w in part] == want


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    cases = [(2, 2), (3, 7), (9 * 10**12 + 2, 9 * 10**12 + 4), (10**15 + 7, 3 * 10**15 + 11), (2, 0)]
    got = spark.createDataFrame(cases, "n long, total long").select(source_divergence.share(F.col("n"), F.col("total"))).collect()
    assert [r[0] for r in got] == [1 + (10**9 * n // t if t else 0) for n, t in cases]
