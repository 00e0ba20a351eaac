"""Token counts, packing and token files against the library itself."""

from __future__ import annotations

import functools
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docspark.llm import packing, token_counts, token_files, tokenizing

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def library(path):
    return Tokenizer.from_file(path)


def ids_of(path, text):
    return library(path).encode(text, add_special_tokens=False).ids


def rows_of(frame):
    return [(r.doc_id, r.text or "") for r in frame.collect()]


@pytest.mark.parametrize(("path", "drops"), [(BYTE, False), (WORD, True)])
def test_pieces_equal_whole_texts(path, drops):
    rng, alphabet = np.random.default_rng(5), list("aB .\n\t' sé²½ß_-1’世́\xa0\x85\x1cµ<|") + ["<|endoftext|>", "  ", "I'Ve", "ΑΣ", "İ"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(400)]
    texts.append("".join(texts))
    encoder = tokenizing.PieceEncoder(path, drops, memo_limit=50, segment=200)
    for some in (texts, texts[:1], ["one two  three", "", "a", "wörd,\nNext$$$ 'tis <|endoftext|> b"] * 3, []):
        ids, at = encoder.encode(pa.array(some, pa.string()))
        assert len(at) == len(some) + 1 and at[-1] == len(ids)
        for text, a, b in zip(some, at, at[1:], strict=False):
            assert ids[a:b].tolist() == ids_of(path, text)


def invented(n, seed, marks=True):
    """Texts of words that hardly come twice, with marks and line feeds between some."""
    rng, syllables = np.random.default_rng(seed), ["the", "on", "er", "é", "ção", "zu", "ing", "St", "ou", "ä", "nt", "Wh"]
    words = ["".join(syllables[k] for k in row) for row in rng.integers(0, len(syllables), (n, 6))]
    ends = ["", "", "", ",", ".", "%%%", ".\nThis", "|\nUnd,"] if marks else [""]
    words = [w + ends[k] for w, k in zip(words, rng.integers(0, len(ends), n), strict=True)]
    return pa.array([" ".join(words[k : k + 200]) for k in range(0, n, 200)])


@pytest.mark.parametrize(("path", "drops"), [(BYTE, False), (WORD, True)])
def test_kept_words_take_few_bytes(path, drops):
    encoder = tokenizing.PieceEncoder(path, drops)
    encoder.encode(invented(1000, 0))
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    for seed in range(1, 6):
        encoder.encode(invented(20_000, seed, marks=False))
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert kept < 90 * 100_000


@pytest.mark.parametrize(("path", "drops"), [(BYTE, False), (WORD, True)])
def test_table_of_words_turns(path, drops):
    encoder = tokenizing.PieceEncoder(path, drops, memo_limit=700)
    latin = "".join(chr(k) for k in range(33, 256))
    for seed in range(8):
        texts = pa.concat_arrays([invented(600, seed % 3), pa.array([f"x {latin} y", " ".join(latin), " ".join(f"a{c}A{c}" for c in latin), "x" * 70 + " x" + "Y" * 64])])
        ids, at = encoder.encode(texts.cast(pa.large_string()) if seed == 7 else texts)
        for text, a, b in zip(texts.to_pylist(), at, at[1:], strict=False):
            assert ids[a:b].tolist() == ids_of(path, text)
    assert len(encoder.words.names) <= 700 + 1300


def share_of_library(path, drops):
    """CPU time of words that hardly come twice as a share of the library's own for the same texts, the least of three batches."""
    encoder, shares = tokenizing.PieceEncoder(path, drops), []
    encoder.encode(invented(1000, 0))
    for seed in range(1, 4):
        texts = invented(40_000, seed)
        began = time.process_time()
        encoder.encode(texts)
        own = time.process_time() - began
        for text in texts.to_pylist():
            ids_of(path, text)
        shares.append(own / (time.process_time() - began - own))
    return min(shares)


def test_packing_encodes_new_words_faster_than_the_library():
    assert share_of_library(BYTE, False) < 0.9


def test_token_files_encode_new_words_faster_than_the_library():
    assert share_of_library(WORD, True) < 0.9


def test_counts(corpus, empty):
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(corpus, BYTE).collect())
    want = sorted((d is None, d, len(t.encode()), len(ids_of(BYTE, t)), len(ids_of(BYTE, t)) > 1024) for d, t in rows_of(corpus))
    assert got == want
    assert token_counts.token_counts(empty, BYTE).count() == 0


def test_packing(corpus, empty):
    rows = packing.pack(corpus, BYTE, group_rows=5, group_bins=1).toPandas()
    expected = sorted(len(ids_of(BYTE, t)) + 1 for _, t in rows_of(corpus))
    assert rows["length"].sum() == sum(expected)
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 2048
    for d, t in rows_of(corpus):
        if d not in (None, 3):
            ids, g = np.array([*ids_of(BYTE, t), 0], np.uint32), rows[rows["doc_id"] == d].sort_values("piece")
            assert g["piece"].tolist() == list(range(len(g))) and g["start"].tolist() == [0, *g["length"].cumsum()[:-1]]
            assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g["start"], g["length"], strict=True)] == g["ids_crc32"].tolist()
            assert g["length"].tolist()[1:] == [2048] * (len(g) - 1)
    assert packing.pack(empty, BYTE).count() == 0


def test_local_search_saves_bins():
    rng = np.random.default_rng(2)
    saved = 0
    for low, high in [(1, 1200), (500, 900), (600, 1400), (1, 2049), (1024, 1025), (2048, 2049), (1, 40)] * 3:
        sizes = rng.integers(low, high, 400).tolist()
        first = packing.fill(sizes, 2048)
        filled = [sum(sizes[i] for i in b) for b in first]
        after = packing.improve([list(b) for b in first], sizes, 2048)
        load = [sum(sizes[i] for i in b) for b in after]
        assert sorted(i for b in after for i in b) == list(range(400)) and max(load) <= 2048
        assert sum(x * x for x in load) >= sum(x * x for x in filled)
        best = packing.search(sizes, 2048)
        assert len(best) <= len(after) <= len(first) and len(best) <= len(packing.fill(sorted(sizes, reverse=True), 2048))
        assert sorted(i for b in best for i in b) == list(range(400)) and max(sum(sizes[i] for i in b) for b in best) <= 2048
        saved += len(first) - len(after)
        again = packing.improve([list(b) for b in after], sizes, 2048)
        assert len(again) == len(after)
    assert saved >= 60


def test_exchanges():
    # A move, one for one and two for one each empty the last bin.
    for sizes, bins in (([4, 3, 3, 10], [[0], [1, 2], [3]]), ([5, 3, 6, 2, 4], [[0, 1], [2], [3, 4]]), ([6, 3, 5, 4, 2], [[0, 1], [2, 3], [4]])):
        assert len(packing.improve([list(b) for b in bins], sizes, 10)) == 2


def test_packing_of_repeated_rows(spark):
    rows = [(7, "the same words again and again")] * 3000 + [(None, None)] * 500 + [(8, "x " * 3000)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, BYTE, group_rows=500, group_bins=1).toPandas()
    whole = sum(len(ids_of(BYTE, t or "")) + 1 for _, t in rows)
    assert got["length"].sum() == whole and len(got[got["piece"] == 0]) == len(rows)
    fills = got.groupby("sequence_id")["length"].sum()
    assert fills.max() <= 2048 and len(fills) <= -(-whole // 2048) + 2
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]]


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 31, 32, 70_000, 200_000):
        ids = np.minimum(rng.geometric(0.001, n), 49_000).astype(np.uint32)
        symbols, freqs = token_files.frequencies(ids)
        assert freqs.sum() == 1 << token_files.SCALE and freqs.min() >= 1
        blocks = token_files.encode(ids, symbols, freqs)
        assert np.array_equal(token_files.decode(blocks, symbols, freqs), ids)
        assert sum(len(b["words"]) for b in blocks) < 4 * n + 8
    every = np.arange(49_408, dtype=np.uint32)
    symbols, freqs = token_files.frequencies(every)
    assert np.array_equal(token_files.decode(token_files.encode(every, symbols, freqs), symbols, freqs), every)


def test_damage_is_found():
    ids = np.arange(500, dtype=np.uint32) % 7
    symbols, freqs = token_files.frequencies(ids)
    blocks = token_files.encode(ids, symbols, freqs)
    words = bytearray(blocks[0]["states"])
    words[3] ^= 1
    blocks[0]["states"] = bytes(words)
    with pytest.raises(ValueError):
        token_files.decode(blocks, symbols, freqs)


def test_files(spark, corpus, empty, tmp_path):
    docs = corpus.unionByName(spark.createDataFrame([(3, f"repeated {i % 7}", None, None, 1, None, None) for i in range(200)], corpus.schema))
    token_files.write(docs, f"{tmp_path}/t", WORD, shard_tokens=100)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, f"{tmp_path}/t").collect())
    want = []
    for d, t in rows_of(docs):
        ids = np.array([*ids_of(WORD, t), 1], np.uint32)
        want.append((d is not None, d or 0, len(ids), zlib.crc32(ids.tobytes())))
    found = [(d is not None, d or 0, n, crc) for _, d, n, crc in got]
    assert sorted(found) == sorted(want) and [x[:2] for x in found] == sorted(x[:2] for x in found)
    assert [r[0] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    token_files.write(empty, f"{tmp_path}/e", WORD)
    assert token_files.read(spark, f"{tmp_path}/e").count() == 0
