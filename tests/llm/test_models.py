"""Personal data, URL filters, toxicity and language ID: brute force for rules, held-out accuracy for models."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import language_id, pii, toxicity, url_filter

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark, corpus, empty):
    tricky = [
        "a@b.c+x@y.z, é世a@b.c.d@e.f", "a@b@c.de", "x" * 5000 + "@", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.04", "4539 1488 0343 6467 and 4539148803436467 then 1-2-3", "+1 (234) 567-8901+12 3",
        "+1234567890123456 +12", "4539-1488-0343-6467-4539-1488-0343-6467", "", None, " ".join(f"u{i}@h{i}.org {i}.{i % 250}.3.4" for i in range(1500)), "%@-.-",
    ]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")).collect()}
    for i, t in enumerate(tricky):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert set(want) <= set(got[i].spans.split(",")) or not want
    assert pii.personal_data(corpus).count() == corpus.count() and pii.personal_data(empty).count() == 0


def test_base_spans_of_whole_tables(spark, sf_dir, corpus):
    for docs in (corpus.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")):
        want = []
        for r in docs.collect():
            spans = base_spans(r.text or "")
            want.append((r.doc_id, *[sum(s.startswith(k) for s in spans) for k in PATTERNS], hashlib.sha256(",".join(spans).encode()).hexdigest()))
        got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.personal_data(docs).collect()]
        assert want and sorted(map(str, got)) == sorted(map(str, want))


def test_added_spans(spark):
    texts = ["write to jane.roe [at] example [dot] com now", "tel (743) 555-3824 any time", "we met at noon and the dot was red", "order no 4785380592391130 shipped", "token = \"2321bac4d15ec8f90433955bf9d3cf61\"", "mail a@b.com"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.added] for r in pii.find_spans(docs).collect()}
    assert got[0] == [("email", "jane.roe [at] example [dot] com")]
    assert got[1] == [("phone", "(743) 555-3824")]
    assert not any(got[i] for i in (2, 3, 4, 5))


# Personal data in running text, written by hand for this test and apart from the constructed examples.
WRITTEN = [
    ("Please send the draft to maria.lopez [at] uni-hamburg [dot] de before Friday.", "maria.lopez [at] uni-hamburg [dot] de"),
    ("you can reach me under tom_b (at) posteo (dot) net, mornings only", "tom_b (at) posteo (dot) net"),
    ("My new address is k.meyer{at}webmail.org since March.", "k.meyer{at}webmail.org"),
    ("Contact: info [AT] gardenclub [DOT] org", "info [AT] gardenclub [DOT] org"),
    ("questions go to the secretary, anna99 [at] example.fr", "anna99 [at] example.fr"),
    ("Call the office on (212) 555-0187 after nine.", "(212) 555-0187"),
    ("Tel. 415-555-0132 or leave a note at the door", "415-555-0132"),
    ("fax: 020 7946 0958 (London)", None),
    ("The hotline (800) 555-0199 is open all night", "(800) 555-0199"),
    ("mobile 0171/5550123, evenings", "0171/5550123"),
    ("phone 310.555.0145 ext 4", "310.555.0145"),
    ("Charged to card 4111.1111.1111.1111 on the ninth", "4111.1111.1111.1111"),
    ("visa 4539 1488 0343 6467, expires soon", None),  # a base span
    ("she read out 5555/5555/5555/4444 over the phone", "5555/5555/5555/4444"),
    ("the server 2001:0db8:85a3:0000:0000:8a2e:0370:7334 was down", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
    ("ping fe80:0:0:0:202:b3ff:fe1e:8329 from the lab", "fe80:0:0:0:202:b3ff:fe1e:8329"),
]
HARMLESS = [
    "We met at noon and the dot on the map was red.", "The meeting on 2024-05-17 runs from 10:30 to 12:45.", "ISBN 978-3-16-148410-0 is out of print.", "See pages 12-17, 45-48 and 101.",
    "Version 10.4.22.1 fixes the bug.", "Order no 20231145871 has shipped.", "In 1990 there were 1.250.300 people, in 2000 1.310.450.", "look at example.com for more", "The ratio 16:9:4:3:2 was chosen.",
    "token = 9f86d081884c7d659a2feaa0c55ad015", "Invoice 4785380592391131 is overdue.", "They sat at home. dot matrix printers hummed.", "coordinates 52.5200 13.4050", "The score was 3-2, 4-1 and 0-0.",
]


def test_recall_on_written_text(spark):
    texts = [t for t, _ in WRITTEN] + HARMLESS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    added = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.added] for r in pii.find_spans(docs).collect()}
    wanted = [(i, w) for i, (_, w) in enumerate(WRITTEN) if w]
    caught = [w for i, w in wanted if w in added[i]]
    wrong = {texts[i]: added[i] for i in range(len(WRITTEN), len(texts)) if added[i]}
    assert len(caught) >= 0.8 * len(wanted) and len(wrong) <= 2


def test_training_does_not_depend_on_partitions(spark):
    one = pii.Scorer(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "7")
    try:
        two = pii.Scorer(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert one.sql == two.sql and one.thresholds == two.thresholds


@pytest.mark.parametrize("text", ["jane {at} example.com", "jane [ at ] example.com", "jane ( at ) example.com", "JANE [AT] EXAMPLE [DOT] COM", "jane at example.com"])
def test_spelled_addresses_need_nothing_elsewhere(spark, text):
    pattern = pii.CANDIDATES["spelled"]
    wanted = F.expr(pii.CANDIDATE_NEEDS["spelled"] or "true")
    docs = spark.createDataFrame([(0, text), (1, text + ", or x@ and dot")], "doc_id long, text string")
    assert [r[0] for r in docs.select(F.when(wanted, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).collect()] == [[text], [text]]
    added = {r.doc_id: r.added for r in pii.find_spans(docs).collect()}
    assert added[0] == added[1]
    if text != "jane at example.com":
        assert [(s.kind, text[s.start : s.end]) for s in added[0]] == [("email", text)]


def test_parts_of_a_run_of_digits(spark):
    runs = {
        "call (555) 123-4567 (555) 765-4321 now": ["(555) 123-4567", "(555) 765-4321"], "12 (555) 123-4567": ["(555) 123-4567"], "1 (555) 123-4567": ["1 (555) 123-4567"],
        "see 4539.1488.0343.6467 4539.1488.0343.6467": ["4539.1488.0343.6467"] * 2, "2024-01-12 2024-01-13 10.20.1999": [], "page 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16": [],
    }
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    got = {r.doc_id: r.added for r in pii.find_spans(docs).collect()}
    for i, (text, want) in enumerate(runs.items()):
        assert [text[s.start : s.end] for s in got[i]] == want, text


def test_all_parts_are_proposed(spark):
    text = "é 12 (555) 123-4567 (555) 765/4321, 12345678"
    frame = spark.createDataFrame([(text,)], "text string").withColumns(dict(zip(("f", "g"), pii._found("text", pii.CANDIDATES["digits"], F.lit(True)), strict=True)))
    got = frame.select(F.expr(pii._spans("f", "g")).alias("c")).select(F.expr(pii._parts("c"))).first()[0]
    want = set()
    for run in re.finditer(pii.CANDIDATES["digits"], text):
        groups = [m.span() for m in re.finditer(r"[+(]?[0-9]+", run[0])]
        parts = {(a, b) for i, (a, _) in enumerate(groups) for _, b in groups[i:] if 7 <= len(re.sub("[^0-9]", "", run[0][a:b])) <= 19} | {(0, len(run[0]))}
        want |= {(run.start() + a, run.start() + b) for a, b in parts}
    assert sorted((s.start, s.end) for s in got) == sorted(want)
    assert all(s.s == text[s.start : s.end] and s.before == text[: s.start][-24:][-len(s.before) :] and text[s.end :].startswith(s.after) for s in got)


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :])[0]


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.net", "http://x.net/", "ftp://example.com/de/1", "http://notexample.com/de/1", "http://a.org/fr/", "http://a.org/fr", "nothing", None, "", "a://b://c/d", "http://adult-x.example.com/en/1", "http://adult-x.example.com/en/1", "http://é.com/ü", "x://?a", "://h/p\nq", "http://the.free-bets7.example.com/" + "é/" * 50_000, "http://alphabets.example.com", "http://M.SPAM-x.org/fr/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    for most in (url_filter.MOST_BYTES, 1):
        got = {r.page_id: r for r in url_filter.filter_urls(pages, url_filter.hosts_with_words(pages), most_bytes=most).collect()}
        for i, u in enumerate(urls):
            host, path = brute_url(u)
            fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "block" if set(re.split("[-.0-9]+", host)) & set(url_filter.LISTED_WORDS) else "allow"))
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert url_filter.filter_urls(pages.limit(0), pages.limit(0)).count() == 0
    named = spark.createDataFrame([("X.net",), ("x",), (None,), ("x",), ("",), ("elsewhere.org",)], "host string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, named).collect()}
    assert {got[i].host for i in got if got[i].listed} == {"x.net", ""} and got[7].verdict == "block" and len(got) == len(urls)


def hashes(spark, keys, levels):
    frame = spark.createDataFrame([(k,) for k in keys], "host string").select(*[url_filter.level_hash(i) for i in range(levels)]).toPandas()
    return [frame[c].to_numpy() for c in frame.columns]


def test_cascade_is_exact(spark):
    keys = [f"h{i}" for i in range(20_000)]
    listed = np.array([i % 9 == 0 for i in range(20_000)])
    cascade = url_filter.build(spark.createDataFrame(list(zip(keys, listed.tolist(), strict=True)), "host string, listed boolean"))
    assert (cascade.listed(*hashes(spark, keys, len(cascade.filters))) == listed).all() and 1 < len(cascade.filters) < 12


def test_cascades_of_small_universes_end(spark):
    """The same levels in numpy: no universe needs many, whatever keys meet in a filter of the least size."""
    r = np.random.default_rng(12)
    found = hashes(spark, [f"k{i}" for i in range(4000)], 40)
    for _ in range(400):
        n = int(r.integers(2, 60))
        some = r.choice(4000, n, replace=False)
        listed = r.random(n) < r.choice([0.1, 0.5, 0.9])
        inside, outside, level = some[listed], some[~listed], 0
        while len(inside) or not level:
            words, bits = np.zeros(64, np.uint64), max(64, (url_filter.MORE_BITS if level else url_filter.FIRST_BITS) * len(inside))
            h = found[level][inside]
            for i in range(url_filter.HASHES):
                at = ((h & 0xFFFFFFFF) + i * ((h >> 32) & 0xFFFFFFFF)) % bits
                np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            assert url_filter._holds(words, bits, h).all()
            passed = outside[url_filter._holds(words, bits, found[level][outside])]
            inside, outside, level = passed, inside, level + 1
            assert level < 12


def test_keys_that_agree_at_a_level_part_later(spark):
    """Two keys whose bits at the first level are the same, one listed and one not."""
    held = hashes(spark, [f"k{i}" for i in range(4000)], 1)[0]
    seen = {}
    for i, h in enumerate(held.tolist()):
        bits = tuple(sorted(((h & 0xFFFFFFFF) + j * ((h >> 32) & 0xFFFFFFFF)) % 64 for j in range(3)))
        if bits in seen:
            break
        seen[bits] = i
    keys = [f"k{seen[bits]}", f"k{i}"]
    for flags in ([True, False], [False, True]):
        cascade = url_filter.build(spark.createDataFrame(list(zip(keys, flags, strict=True)), "host string, listed boolean"))
        assert cascade.listed(*hashes(spark, keys, len(cascade.filters))).tolist() == flags and 1 < len(cascade.filters) < 12


def labelled(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_toxicity(spark, corpus, empty):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    index = toxicity.train(docs, labels)
    assert not {int(i) for i in index.ids if zlib.crc32(str(i).encode()) % 3 == 1}
    held = labels.where(~toxicity.learnable())
    got = toxicity.score(docs.join(held, "doc_id", "left_semi"), index).join(held, "doc_id").toPandas()
    assert got["score"].between(0, 1).all()
    flagged = got[got["predicted"] == 1]
    assert flagged["toxic"].mean() > 0.9 and got[got["toxic"] == 1]["predicted"].mean() > 0.7
    odd = toxicity.score(corpus, index)
    assert odd.count() == corpus.count() and odd.where("score IS NULL").count() == 0 and toxicity.score(empty, index).count() == 0
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.score(corpus, None).count() == corpus.count()


def made_index(rng, n, words):
    """An index over random bags: common words, rare ones, and some that come with the label."""
    toxic = (np.arange(n) % 3 == 0).astype(int)
    rows = []
    for i in range(n):
        held = set(rng.choice(words, rng.integers(0, 12), replace=False).tolist()) | set(rng.choice(8, 5, replace=False).tolist()) | ({8 + int(rng.integers(3))} if toxic[i] else set())
        rows += [(i, t, int(rng.integers(1, 4))) for t in sorted(held)] if i % 17 else []
    row, term, counts = (np.array(c) for c in zip(*rows, strict=True))
    return toxicity.make_index([f"w{i}" for i in range(words)], np.arange(n) * 10, toxic, row, term, counts, np.bincount(term, minlength=words) + 3, 4 * n)


def brute_neighbours(index, terms, w, k, skip=-1):
    sims = np.zeros(len(index.ids))
    for t, v in zip(terms.tolist(), w.tolist(), strict=True):
        at = index.term == t
        sims[index.example[at]] += v * index.weight[at]
    order = [i for i in np.lexsort((np.arange(len(sims)), -sims)) if sims[i] > 1e-6 and i != skip]
    return order[:k], sims


@pytest.mark.parametrize("n", [40, 700])
def test_blocks_lose_no_neighbour(n):
    rng = np.random.default_rng(8)
    index = made_index(rng, n, 400)
    assert len(index.dense) and len(index.weights) and (np.bincount(index.example, index.weight**2, n)[np.unique(index.example)].round(5) == 1).all()
    bags = [np.sort(rng.choice(400, m, replace=False)) for m in rng.integers(0, 40, 300)]
    cuts, terms = np.cumsum([0, *map(len, bags)]), np.concatenate(bags)
    w = index.vectors(cuts, terms, rng.integers(1, 5, len(terms)))
    near = list(index.nearest(cuts, terms, w))
    assert len(near) == 300
    for (found, got), a, b in zip(near, cuts, cuts[1:], strict=False):
        want, sims = brute_neighbours(index, terms[a:b], w[a:b], toxicity.NEIGHBOURS)
        assert len(found) == len(want) and np.allclose(got, sims[want], atol=1e-5) and np.allclose(sims[found], got, atol=1e-5)
    order = np.argsort(index.example, kind="stable")
    cuts = np.searchsorted(index.example[order], np.arange(n + 1))
    for i, (found, got) in enumerate(index.nearest(cuts, index.term[order], index.weight[order], skip=True)):
        want, sims = brute_neighbours(index, index.term[order][cuts[i] : cuts[i + 1]], index.weight[order][cuts[i] : cuts[i + 1]], toxicity.NEIGHBOURS, i)
        assert i not in found and np.allclose(got, sims[want], atol=1e-5)


def test_scores_by_brute_force(spark):
    """Bags, weights, neighbours and votes once more in plain Python."""
    rng = np.random.default_rng(4)
    common_words, bad = [f"common{chr(97 + i)}" for i in range(12)], ["nasty", "vile", "Foul"]
    text = lambda toxic: " ".join([*rng.choice(common_words, 9), *("x" + "".join(rng.choice(list("abcdef"), 4)) for _ in range(3)), *([str(rng.choice(bad))] if toxic else [])])
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(160)] + [(200, None, 1), (201, "", 0), (202, "1 2 3", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, "zzz a repeated id"), (0, "zzz a repeated id")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    index = toxicity.train(docs, labels)
    learned = {i: (t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert sorted(index.ids.tolist()) == sorted(learned) and index.ids[np.argsort(index.ids)][0] == min(learned)
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    everywhere = [set(words(r.text)) for r in docs.collect()]
    bag = {i: {w: words(t).count(w) for w in words(t)} for i, (t, _) in learned.items()}
    n_bad, n_good = sum(y for _, y in learned.values()), sum(1 - y for _, y in learned.values())
    factor = {}
    for w in {w for b in bag.values() for w in b}:
        b, g = (sum(w in bag[i] for i, (_, y) in learned.items() if y == v) for v in (1, 0))
        odds = abs(np.log((b + 1) / (n_bad + 2)) - np.log((g + 1) / (n_good + 2)))
        factor[w] = np.log((1 + len(everywhere)) / (1 + sum(w in e for e in everywhere))) * (0.1 + odds * (b + g) / (b + g + 10))

    def vector(counts):
        v = {w: (1 + np.log(c)) * factor[w] for w, c in counts.items() if w in factor}
        norm = np.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    vectors = {i: vector(b) for i, b in bag.items()}
    got = {(r.doc_id, r.score): r for r in toxicity.score(docs, index).collect()}
    for (d, score), r in got.items():
        texts = {t.text for t in docs.where(f"doc_id = {d}").collect()} if d == 0 else {next(t for i, t, _ in rows if i == d)}
        scores = []
        for t in texts:
            q = vector({w: words(t).count(w) for w in words(t)})
            sims = sorted(((sum(x * v.get(w, 0) for w, x in q.items()), i) for i, v in vectors.items()), reverse=True)
            sims = [(s, i) for s, i in sims if s > 1e-6][: toxicity.NEIGHBOURS]
            vote = index.base
            if sims:
                near = [1 / (1.05 - min(s, 1)) for s, _ in sims]
                vote = (sum(w * learned[i][1] for w, (_, i) in zip(near, sims, strict=True)) + 0.5 * index.base) / (sum(near) + 0.5)
            scores.append(index.score(vote, sims[0][0] if sims else 0.0))
        assert min(abs(score - s) for s in scores) < 2e-3, (d, score, scores)
        assert r.predicted == int(score >= 0.7) and [e.similarity for e in r.evidence] == sorted((e.similarity for e in r.evidence), reverse=True)
    assert {r.predicted for r in got.values() if r.doc_id in (200, 201, 202)} == {0}


def test_language(spark, corpus, empty):
    docs, _ = labelled(spark, "/root/testdata/sf0.01")
    held_out = language_id.held_out()
    model = language_id.train(docs.where(~held_out), sample_rows=600)
    got = language_id.identify(docs.where(held_out), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    odd = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(corpus, model).collect()]
    for d, lang, score in odd:
        if d in (4, 5, 11):
            assert (lang, score) == ("und", 0.0)
    assert len(odd) == corpus.count() and language_id.identify(empty, model).count() == 0
    assert language_id.train(empty) is None and {r.lang_pred for r in language_id.identify(corpus, None).collect()} == {"und"}


def test_many_languages_are_all_learned(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 12)}{w}" for w in "abcdefgh") * 4, f"l{i % 300}") for i in range(1200)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=600)
    assert len(model.languages) == 300


@pytest.mark.parametrize("k", [1, 2, 4, 7, 8, 30, 1000])
def test_codewords_differ(k):
    codes = language_id.codewords(k)
    assert codes.shape[0] == k and len({tuple(c) for c in codes.tolist()}) == k


def test_sample_of_languages_of_very_different_size(spark):
    """Each language has its share, whatever its size, repeats and ids."""
    words = {f"l{k}": [chr(97 + k) * 3 + c for c in "aeiou"] for k in range(10)}
    rows = [(i, " ".join(words[f"l{k}"][(i + j) % 5] for j in range(8)), f"l{k}") for k in range(10) for i in range(3 * 2**k)] + [(-1, "jjja " * 5, "l9")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, sample_rows=40)
    assert sorted(model.languages) == sorted(words)
    judged = language_id.identify(docs, model).join(docs.select("doc_id", "lang").distinct(), "doc_id").where("lang_pred = lang")
    assert judged.count() >= 0.95 * docs.count()
