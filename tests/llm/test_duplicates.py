"""Exact dedup, the Jaccard join, components and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from docspark import staging
from docspark.llm import components, decontaminate, exact_dedup, jaccard_join, shingles


def rows_of(frame):
    return [(r.doc_id, r.text or "") for r in frame.collect()]


def brute_sets(rows):
    out = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    ids = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    return sorted((rows[i][0], len(sets[i]), ids[root[i]]) for i in range(len(rows)))


def test_exact(corpus, empty):
    rows = rows_of(corpus)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t) for _, t in rows]
    for pages in (2, None):
        got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(corpus, page_keys=pages).collect()}
        assert len(got) == len(rows)
        for (d, _), n in zip(rows, norm, strict=True):
            same = [rows[i][0] for i in range(len(rows)) if norm[i] == n]
            keep = min((x for x in same if x is not None), default=None)
            r = got[(d, hashlib.sha256(n.encode()).hexdigest())]
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), d == keep)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory_doubles(spark):
    keys = spark.range(4000).selectExpr("xxhash64(id) AS key", "CASE WHEN id = 7 THEN 20000L ELSE 1L END AS rows")
    bits = exact_dedup.bits_of(4000, 100)
    cells = exact_dedup.directory(keys, 100, bits).collect()
    assert bits == 8 and exact_dedup.bits_of(10, 100) == 2 and exact_dedup.bits_of(10**9, exact_dedup.page_of(10**9)) == 15
    held, shares = {}, {}
    for k, rows in keys.collect():
        c = (k % (1 << 64)) >> (64 - bits)
        (r,) = (x for x in cells if x.cell == c)
        assert r.start == c >> (bits - r.depth) << (bits - r.depth)
        held.setdefault((r.depth, r.start), []).append(k)
        shares[rows] = max(shares.get(rows, 0), r.shares)
    assert max(map(len, held.values())) <= 100 and min(d for d, _ in held) >= 5 and len({s for _, s in held}) == len(held)
    assert shares[20000] == 3


def test_large_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARE_ROWS", 50)
    rows = [(i if i % 3 else None, "one  text" if i % 2 else "one text") for i in range(3000)] + [(5000 + i, f"t{i % 400}") for i in range(1000)] + [(None, "no id")] * 70
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for page in (None, 10):
        got = sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, page).collect())))
        want = [(d, 1, 3000, d == 1) for d, _ in rows[:3000]] + [(5000 + i, 5000 + i % 400, 2 + (i % 400 < 200), i < 400) for i in range(1000)] + [(None, None, 70, True)] * 70
        assert got == sorted(map(str, want))


def near_corpus(spark, n=60, seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    base = [[word() for _ in range(r.randint(3, 120))] for _ in range(6)]
    line = [word() for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w + (line if r.random() < 0.5 else []))))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_join_on_near_copies(spark, monkeypatch):
    docs = near_corpus(spark)
    want = brute_components(rows_of(docs))
    for long_column, block in ((64, 256), (3, 256), (3, 4)):
        monkeypatch.setattr(jaccard_join, "LONG_COLUMN", long_column)
        monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
        assert got == want


def test_copies_in_many_tasks_make_no_column_shared(spark, monkeypatch):
    held, write = {}, jaccard_join.common.stored

    def counted(df, name):
        out = write(df, name)
        held[name] = out.where("token is not null").count() if name == "columns" else 0
        return out

    monkeypatch.setattr(jaccard_join.common, "stored", counted)
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(10)]
    docs = spark.createDataFrame([(i, texts[i % 10]) for i in range(80)], "doc_id long, text string").repartition(8)
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()) == [(i, i % 10) for i in range(80)]
    assert held["columns"] == 0


def test_a_stored_table_leaves_no_shuffle_files(spark):
    kept = lambda: {str(f) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}
    before = kept()
    table = spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(r["count"] for r in staging.stored(table, "counts").collect()) == [1428] * 3 + [1429] * 4
    assert not kept() - before


def test_join_on_odd_rows(spark, corpus, empty):
    docs = corpus.where("doc_id IS NOT NULL")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == brute_components(rows_of(docs))
    assert jaccard_join.jaccard_components(corpus).count() == corpus.count()
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_hash_is_by_words_not_place():
    long = " ".join(f"W{i}" for i in range(40))
    assert np.isin(shingles.shingles(" ".join(long.split()[7:12])), shingles.shingles(long)).all()
    assert len(shingles.shingles(long)) == 36 and len(shingles.shingles("a b")) == 1 and len(shingles.shingles(" \n")) == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {v: v for e in edges for v in e}
    for _ in range(500):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    odd = [0, 1, -1, 1 << 40, -(1 << 63), (1 << 63) - 1, 123456789012345678]
    frame = spark.createDataFrame([(x,) for x in odd], "n long").select("n", components._mixed("n").alias("m"))
    assert all(r.n == r.p for r in frame.select("n", components._plain("m").alias("p")).collect()) and len({r.m for r in frame.collect()}) == len(odd)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: m for v, m in root.items() if v in got} and all(root[v] == v for v in set(root) - set(got))


def test_a_chain_of_rising_ids_takes_few_rounds(spark, monkeypatch):
    kept, names = components.common.stored, []
    monkeypatch.setattr(components.common, "stored", lambda df, name: names.append(name) or kept(df, name))
    found = components.components(spark.createDataFrame([(i, i + 1) for i in range(1500)], "a long, b long"))
    assert {r.root for r in found.select("root").distinct().collect()} == {0} and found.count() == 1501
    assert names.count("edges") <= 12


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    r = random.Random(3)
    for _ in range(200):
        item = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        text = "".join(r.choice("abc") for _ in range(r.randint(0, 120)))
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        assert decontaminate.best_match(item, text, masks)[0] == distance(item, text)


def test_decontamination(spark, empty):
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    items = [(i, prose(20)) for i in range(8)] + [(8, None), (9, ""), (10, "tiny")]
    docs = []
    for i in range(40):
        text, (_, item) = prose(30), items[i % 8]
        edits = list(item)
        for _ in range(r.choice([0, 2, 5, 6, 7, 12])):
            edits[r.randrange(len(edits))] = r.choice("xyz")
        docs.append((i, text + " " + "".join(edits).upper() + "\n" + prose(5)))
    docs += [(100, None), (101, ""), (102, "a tiny one"), (103, "attiny one")]
    got = {(x.doc_id, x.item_id): x.edit_distance for x in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for i, item in items:
            if t and item:
                k = distance(decontaminate.normalised(item), decontaminate.normalised(t))
                if k <= int(decontaminate.ERROR_RATE * len(item)):
                    want[(d, i)] = k
    assert got == want and {(102, 10), (103, 10)} <= set(got)
    assert decontaminate.contaminated(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_of_odd_rows(spark, corpus):
    """Repeated rows and items, a very long text, and columns whose names clash with the operator's own."""
    item = "seven wizards brew strange tea in the old stone tower near the river"
    items = spark.createDataFrame([(1, item, "a", 5), (1, item, "a", 5), (2, item, "b", 6), (3, "jumps", None, None)], "item_id long, text string, doc_id string, start long")
    long = "filler words " * 40_000 + item.replace("tea", "tee") + " end" * 1000
    docs = corpus.unionByName(spark.createDataFrame([(70, long, None, None, None, None, None)] * 2, corpus.schema)).withColumnRenamed("key", "item_id").withColumnRenamed("token", "edit_distance")
    got = sorted((r.doc_id, r.item_id, r.edit_distance) for r in decontaminate.contaminated(docs, items).collect())
    want = [(d, i, 0) for d in (0, 1, 2, 10) for i in (1, 2, 3)] + [(70, i, 1) for i in (1, 2)] * 2
    assert got == sorted(want)
    tiny = spark.createDataFrame([(1, "wizard")], "item_id long, text string")
    assert decontaminate.contaminated(docs, tiny).count() == 6  # one rule for items of any length: also inside words


def test_start_of_a_match(spark):
    rng = random.Random(4)
    item = "".join(rng.choices("abcdef ", k=60)).strip() + "x"
    lost, more = item[:20] + item[22:], item[:30] + "zz" + item[30:]
    docs = [(1, "qqq " + item), (2, "qqq " + lost + " end"), (3, "qqqq " + more), (4, "qq " + item[:40] + "Y" + item[41:])]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    texts = {d: decontaminate.normalised(t) for d, t in docs}
    for r in found:
        assert decontaminate.normalised(item)[:10] == texts[r.doc_id][r.start : r.start + 10], r
    assert sorted((r.doc_id, r.edit_distance) for r in found) == [(1, 0), (2, 2), (3, 2), (4, 1)]
