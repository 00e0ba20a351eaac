"""Token ids on disk: shards coded with a static range asymmetric numeral system (rANS).

A shard holds whole documents in ascending id order and one frequency table, which all its blocks
share. A block has its own interleaved lanes, checkpoints (lane states and word positions every
``STEPS`` steps) and a checksum, so blocks and the parts between checkpoints decode by
themselves. Shards are rows of Parquet files: Spark writes and commits them to any store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm import common, tokenizing
from docspark.packaging import ship

LANES = 32
STEPS = 512  # between checkpoints
SEGMENTS = 4  # in a block
BLOCK = LANES * STEPS * SEGMENTS
SCALE = 18  # frequencies sum to 2**SCALE
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
FILE_SCHEMA = (
    "part int, shard int, part_start long, n_tokens long, symbols binary, freqs binary, doc_ids array<long>, doc_tokens array<long>, "
    "blocks array<struct<n:int, words:binary, states:binary, positions:array<int>, crc:long>>"
)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies, scaled to ``2**SCALE``, each at least 1."""
    symbols, counts = np.unique(ids, return_counts=True)
    freqs = np.maximum(1, np.floor(counts * ((1 << SCALE) / counts.sum()))).astype(np.int64)
    spare = (1 << SCALE) - int(freqs.sum())
    order = np.argsort(-freqs, kind="stable")
    while spare:
        if spare > 0:
            freqs[order[0]] += spare
            break
        can = np.minimum(freqs[order] // 2, -spare)
        room = np.minimum(np.cumsum(can), -spare)
        freqs[order] -= np.diff(room, prepend=0)
        spare = (1 << SCALE) - int(freqs.sum())
    return symbols, freqs


def encode(ids: np.ndarray, symbols: np.ndarray, freqs: np.ndarray) -> list[dict]:
    """Blocks of a shard; all blocks run side by side, one vector step for each lane step."""
    n_blocks = -(-len(ids) // BLOCK)
    width = n_blocks * LANES
    starts = np.cumsum(freqs) - freqs
    at = np.searchsorted(symbols, ids)

    def grid(values: np.ndarray, pad: int) -> np.ndarray:
        """Steps by lanes; padding codes a sure symbol, which leaves a state as it is."""
        full = np.full(n_blocks * BLOCK, pad, np.uint64)
        full[: len(ids)] = values
        return np.ascontiguousarray(full.reshape(n_blocks, STEPS * SEGMENTS, LANES).transpose(1, 0, 2).reshape(-1, width))

    freq, start = grid(freqs[at], 1 << SCALE), grid(starts[at], 0)
    bound = freq << np.uint64(63 - SCALE)
    state = np.full(width, LOW, np.uint64)
    words, out = np.zeros(freq.shape, np.uint32), np.zeros(freq.shape, bool)
    states = np.zeros((SEGMENTS, width), np.uint64)
    for s in range(STEPS * SEGMENTS - 1, -1, -1):
        full = state >= bound[s]
        if full.any():
            out[s] = full
            words[s] = state.astype(np.uint32)
            state = np.where(full, state >> WORD, state)
        q = state // freq[s]
        state = (q << np.uint64(SCALE)) + (state - q * freq[s]) + start[s]
        if s % STEPS == 0:
            states[s // STEPS] = state
    blocks = []
    for b in range(n_blocks):
        lanes = slice(b * LANES, (b + 1) * LANES)
        flags = out[:, lanes]
        held = flags.reshape(SEGMENTS, -1).sum(1)
        part = ids[b * BLOCK : (b + 1) * BLOCK]
        blocks.append({"n": len(part), "words": words[:, lanes][flags].tobytes(), "states": states[:, lanes].tobytes(), "positions": (np.cumsum(held) - held).tolist(), "crc": zlib.crc32(part.tobytes())})
    return blocks


def decode(blocks: list[dict], symbols: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Ids of the blocks; every part between checkpoints decodes side by side."""
    starts = np.cumsum(freqs) - freqs
    slot = np.repeat(np.arange(len(symbols)), freqs)
    f64, s64 = freqs.astype(np.uint64), starts.astype(np.uint64)
    state = np.concatenate([np.frombuffer(b["states"], np.uint64).reshape(SEGMENTS, LANES) for b in blocks])
    sizes = [len(b["words"]) // 4 for b in blocks]
    words = np.concatenate([*(np.frombuffer(b["words"], np.uint32) for b in blocks), np.zeros(LANES, np.uint32)]).astype(np.uint64)
    base = np.cumsum(sizes) - sizes
    position = np.concatenate([base[k] + np.array(b["positions"], np.int64) for k, b in enumerate(blocks)])
    n = np.array([b["n"] for b in blocks])
    # Tokens of each part; its steps after the last token are padding.
    left = (n[:, None] - np.arange(SEGMENTS) * STEPS * LANES).reshape(-1)
    got = np.zeros((STEPS, *state.shape), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    lane = np.arange(LANES)
    for s in range(STEPS):
        live = left[:, None] > s * LANES + lane
        low = state & mask
        k = slot[low.astype(np.int64)]
        got[s] = symbols[k]
        state = np.where(live, f64[k] * (state >> np.uint64(SCALE)) + low - s64[k], state)
        short = live & (state < LOW)
        count = short.sum(1)
        if count.any():
            take = position[:, None] + np.cumsum(short, axis=1) - 1
            state = np.where(short, (state << WORD) | words[np.where(short, take, 0)], state)
            position += count
    flat = got.transpose(1, 0, 2).reshape(len(blocks), -1)
    parts = [flat[k, :m] for k, m in enumerate(n)]
    for p, b in zip(parts, blocks, strict=True):
        if zlib.crc32(p.tobytes()) != b["crc"]:
            raise ValueError("a block's checksum doesn't fit its tokens")
    return np.concatenate(parts)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, drops_space: bool = True, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents in ascending id order as shards under ``path``.

    Each document ends with ``end_id``; null and empty texts are that id alone. Rows with null ids come
    first, rows that share an id follow each other by a hash of their texts. A shard closes after the document that brings it to ``shard_tokens``. An empty table gives files without
    rows; other columns are not read.
    """

    def shard(part: int, number: int, before: int, doc_ids: list, held: list[bytes]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(held), np.uint32)
        symbols, freqs = frequencies(ids)
        row = {
            "part": part, "shard": number, "part_start": before, "n_tokens": len(ids), "symbols": zlib.compress(symbols.astype(np.uint32).tobytes()), "freqs": zlib.compress(freqs.astype(np.uint32).tobytes()),
            "doc_ids": doc_ids, "doc_tokens": [len(x) // 4 for x in held], "blocks": encode(ids, symbols, freqs),
        }
        return pa.RecordBatch.from_pylist([row], schema=_file_schema())

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part = tokenizing.encoder(tokenizer_path, drops_space), np.uint32(end_id).tobytes(), TaskContext.get().partitionId()
        number = before = size = 0
        doc_ids, held = [], []
        for batch in batches:
            for piece in common.slices(batch):
                ids, at = enc.encode(piece.column(1))
                raw, cuts = ids.tobytes(), (4 * at).tolist()
                for doc, a, b in zip(piece.column(0).to_pylist(), cuts, cuts[1:], strict=False):
                    doc_ids.append(doc)
                    held.append(raw[a:b] + end)
                    size += (b - a) // 4 + 1
                    if size >= shard_tokens:
                        yield shard(part, number, before, doc_ids, held)
                        number, before, size, doc_ids, held = number + 1, before + size, 0, [], []
        if held:
            yield shard(part, number, before, doc_ids, held)

    # Rows that share an id, or all of it, are dealt by their texts' hashes and their places: no id is one task's.
    keyed = common.texts(docs, id_col, text_col).withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "place").select("doc_id", "text")
    ordered.mapInArrow(shards, FILE_SCHEMA).write.parquet(path)


def _file_schema() -> pa.Schema:
    block = pa.struct([("n", pa.int32()), ("words", pa.binary()), ("states", pa.binary()), ("positions", pa.list_(pa.int32())), ("crc", pa.int64())])
    return pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("symbols", pa.binary()), ("freqs", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("blocks", pa.list_(block))])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode the shards under ``path``: ``doc_id, start, n_tokens, ids_crc32``, one row per document."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                symbols, freqs = (np.frombuffer(zlib.decompress(row[c]), np.uint32) for c in ("symbols", "freqs"))
                raw = memoryview(decode(row["blocks"], symbols, freqs.astype(np.int64)).astype("<u4").tobytes())
                n = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                crcs = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.record_batch([pa.array([row["part"]] * len(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["part_start"] + ends - n), pa.array(n), pa.array(crcs, pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    ship(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row per range partition that wrote the files: their number is a setting, not the data's.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = parts.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    found = files.mapInArrow(documents, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
