"""Packing of token sequences by a local search of swaps and moves.

Documents are dealt to groups by their place in their partition, so a group holds a bounded number of rows whatever
their ids, sources or texts. A group is filled in the order of arrival; then the emptiest bins give their documents away, one
for none, one for one or two for one, until no exchange increases the squared fill or no bin can be saved. What stands in
the emptiest bins of all groups is pooled and packed again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm import common, tokenizing

GROUP_ROWS, MOST_ROWS, GROUP_BINS = 8192, 1 << 16, 1000
POOLED_BINS = 16  # of a group, for the next level
STATE = "doc_id long, n long, crcs array<long>, seq long, at long, more long, open boolean"


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins in the order of arrival: an item goes to the fullest bin that takes it. A bit mask says which rests exist."""
    bins: list[list[int]] = []
    by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, size in enumerate(sizes):
        fits = mask >> size
        if fits:
            rest = size + (fits & -fits).bit_length() - 1
            b = by_rest[rest].pop()
            if not by_rest[rest]:
                mask &= ~(1 << rest)
        else:
            rest, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        rest -= size
        if rest:
            by_rest[rest].append(b)
            mask |= 1 << rest
    return bins


def _offers(items: list[int], sizes: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[int, ...]]]:
    """What a bin can give, by size: one item or two. A bin's distinct sizes are few, as they add up to its load."""
    of: dict[int, list[int]] = {}
    for i in items:
        of.setdefault(int(sizes[i]), []).append(i)
    found = {s: (held[0],) for s, held in of.items()}
    names = sorted(of)
    for k, s in enumerate(names):
        for t in names[k:]:
            if s + t not in found and (s != t or len(of[s]) > 1):
                found[s + t] = (of[s][0], of[t][-1])
    return np.array(sorted(found), np.int64), found


def _drain(b: int, bins: list[list[int]], bin_of: np.ndarray, load: np.ndarray, sizes: np.ndarray, capacity: int) -> bool:
    """The bin gives to the other underfull bins while an exchange increases the squared fill; the largest gain goes first."""
    # What a receiver gives back: one of its items, or (-1) nothing. Entries of spent items point to the last bin, which is full.
    others = np.flatnonzero((load > 0) & (load < capacity))
    held = np.flatnonzero(load[bin_of] < capacity)
    back, where = np.concatenate([np.full(len(others), -1), held]), np.concatenate([others, bin_of[held]])
    back, where = back[where != b], where[where != b]
    size = np.where(back < 0, 0, sizes[back])
    changed = False
    while bins[b]:
        offers, of = _offers(bins[b], sizes)
        k = np.searchsorted(offers, size + capacity - load[where], side="right") - 1
        gain = np.where(k >= 0, offers[k] - size, 0)
        gain[load[where] + gain <= load[b]] = 0
        j = int(gain.argmax()) if len(gain) else -1
        if j < 0 or gain[j] <= 0:
            break
        a, given, got = int(where[j]), of[int(offers[k[j]])], int(back[j])
        for i in given:
            bins[b].remove(i)
            bins[a].append(i)
            bin_of[i] = a
        if got >= 0:
            bins[a].remove(got)
            bins[b].append(got)
            bin_of[got] = b
            where[j], size[j] = len(load) - 1, 0
        load[a] += gain[j]
        load[b] -= gain[j]
        back, where, size = np.append(back, given), np.append(where, [a] * len(given)), np.append(size, sizes[list(given)])
        changed = True
    return changed


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search to a fixed point: the emptiest bins give items to fuller ones; bins left without any are dropped.

    Each exchange increases the sum of squared fills, so the search ends: when no exchange does so any more, or when
    the bins are as few as all items together need.
    """
    size = np.array([*sizes, 0], np.int64)
    load = np.array([sum(sizes[i] for i in b) for b in bins] + [capacity], np.int64)  # the last one takes nothing
    bin_of = np.zeros(len(sizes), np.int64)
    for b, items in enumerate(bins):
        bin_of[items] = b
    least = -(-int(size.sum()) // capacity)
    changed = True
    while changed and (load[:-1] > 0).sum() > least:
        changed = False
        for b in np.argsort(load[:-1], kind="stable").tolist():
            if 0 < load[b] < capacity:
                changed |= _drain(b, bins, bin_of, load, size, capacity)
                if (load[:-1] > 0).sum() <= least:
                    break
    return [b for b in bins if b]


def search(sizes: list[int], capacity: int) -> list[list[int]]:
    """The search from a fill in the order of arrival; where that ends above the least number, also from a fill by falling size."""
    found = improve(fill(sizes, capacity), sizes, capacity)
    if len(found) > -(-sum(sizes) // capacity):
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
        other = improve([[order[i] for i in b] for b in fill([sizes[i] for i in order], capacity)], sizes, capacity)
        found = min(found, other, key=len)
    return found


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its tokens with the end id, the checksums of its pieces and its place in its partition: ``doc_id, n, crcs, place``."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, place = tokenizing.encoder(tokenizer_path), np.uint32(end_id).tobytes(), TaskContext.get().partitionId() * 7919
        for batch in batches:
            for part in common.slices(batch):
                ids, at = enc.encode(part.column(1))
                raw, cuts = ids.tobytes(), (4 * at).tolist()
                n, crcs = np.diff(at) + 1, []
                for a, b, m in zip(cuts, cuts[1:], n.tolist(), strict=False):
                    one = raw[a:b] + end
                    ends = [0, *range(4 * (m % capacity or capacity), 4 * m + 1, 4 * capacity)]
                    crcs.append([zlib.crc32(one[x:y]) for x, y in zip(ends, ends[1:], strict=False)])
                yield pa.record_batch([part.column(0), pa.array(n), pa.array(crcs, pa.list_(pa.int64())), pa.array(place + np.arange(len(n)))], names=["doc_id", "n", "crcs", "place"])
                place += len(n)

    return common.texts(docs, id_col, text_col).mapInArrow(tokens, "doc_id long, n long, crcs array<long>, place long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, group_rows: int = GROUP_ROWS, group_bins: int = GROUP_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of at most ``capacity`` tokens over all documents, one row per piece.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Only documents longer
    than a sequence are cut: the first piece takes the remainder, the others fill a sequence
    each. Null and empty texts are the end id alone; repeated rows are packed each; of equal lengths any may stand
    first; an empty table gives an empty table; other columns are not read. A group has about ``group_rows`` documents, or as
    many as fill ``group_bins`` sequences where that is more, but 65,536 at most.
    """
    lengths = common.stored(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "lengths")
    first = F.when(F.col("n") % capacity == 0, capacity).otherwise(F.col("n") % capacity)

    def assigned(level: int, last: bool):
        def one_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["place", "doc_id"], kind="stable")
            n = rows["n"].to_numpy()
            size = np.where(n % capacity == 0, capacity, n % capacity)
            bins = search(size.tolist(), capacity)
            seq, at, load = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(bins), np.int64)
            for k, b in enumerate(bins):
                for i in b:
                    seq[i], at[i] = k, load[k]
                    load[k] += size[i]
            wanted = np.zeros(len(bins), bool)
            if not last:
                wanted[np.argsort(load, kind="stable")[:POOLED_BINS]] = True
                wanted &= load < capacity
            base = (level << 58) + (int(key[0]) << 32)
            count = (n - size) // capacity
            more = base + len(n) + np.cumsum(count) - count if level == 0 else rows["more"].to_numpy()
            return pd.DataFrame({"doc_id": rows["doc_id"].array, "n": n, "crcs": rows["crcs"], "seq": base + seq, "at": at, "more": more, "open": wanted[seq]})

        return one_group

    todo, level, out = lengths.withColumn("more", F.lit(0).cast("long")), 0, None
    while True:
        count, tokens = todo.agg(F.count("*"), F.coalesce(F.sum(first), F.lit(0))).first()
        groups = max(1, -(-count // MOST_ROWS), min(-(-count // group_rows), -(-tokens // (group_bins * capacity))))
        placed = common.stored(todo.groupBy(F.pmod("place", F.lit(groups)).alias("grp")).applyInPandas(assigned(level, groups == 1), STATE), f"placed{level}")
        left = placed.where("open")
        # Pooled documents get fewer at each level; where they don't, they stay where they are.
        if groups == 1 or left.count() * 2 > count:
            out = placed if out is None else out.unionByName(placed)
            break
        out = placed.where("not open") if out is None else out.unionByName(placed.where("not open"))
        todo, level = left.select("doc_id", "n", "crcs", F.xxhash64("seq", "at").alias("place"), "more"), level + 1
    found = out.select("doc_id", "seq", "at", "more", first.cast("long").alias("head"), F.posexplode("crcs").alias("piece", "ids_crc32"))
    one = F.col("piece") == 0
    return found.select(
        "doc_id", "piece", F.when(one, 0).otherwise(F.col("head") + (F.col("piece") - 1) * capacity).cast("long").alias("start"), F.when(one, F.col("head")).otherwise(capacity).cast("long").alias("length"),
        "ids_crc32", F.when(one, F.col("seq")).otherwise(F.col("more") + F.col("piece") - 1).alias("sequence_id"), F.when(one, F.col("at")).otherwise(0).cast("long").alias("offset"),
    )
