"""Vector codes: a codebook for each part of the vectors, fitted by whole-number k-means over anchors-hierarchy metric trees.

Vectors lie in blocks. For each part of a block a tree of balls is grown middle-out: some square root of the points become anchors,
each the farthest point of the widest ball so far and stealing what lies nearer to it; each anchor's points are grown in
the same way; and the anchors' balls are then merged in pairs, tightest first, up to one root. Balls keep their sums and counts. In
a pass a ball inherits its parent's candidate entries and loses those that can't be nearest to any of its points; a ball left with one
candidate is wholly owned and counts by its cached sum.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm import common
from docspark.packaging import ship

BLOCK = 4096
LEAF = 24
MOST = 1 << 28  # largest component (times 256) whose squared distances fit 64 bits
FAR = np.iinfo(np.int64).max


class Ball:
    """Points ``at`` of a block around their mean; ``below`` are its two halves, or none for a leaf."""

    __slots__ = ("at", "below", "mean", "radius")

    def __init__(self, points: np.ndarray, at: np.ndarray, below: tuple[Ball, ...] = ()):
        self.at, self.below = at, below
        own = points[at]
        self.mean = own.mean(0)
        self.radius = float(np.sqrt(((own - self.mean) ** 2).sum(1).max()))


def anchored(points: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The points in about the square root of their number of groups, each about an anchor. Equal points stay together."""
    own = points[at].astype(np.float64)
    anchors = [own[0]]
    owner, far = np.zeros(len(at), np.int64), np.sqrt(((own - own[0]) ** 2).sum(1))
    while len(anchors) ** 2 < len(at):
        new = int(far.argmax())
        if not far[new]:
            break
        gap = np.sqrt(((np.array(anchors) - own[new]) ** 2).sum(1))
        near = np.flatnonzero(far > gap[owner] / 2)  # others can't be nearer to the new anchor, by the triangle inequality
        steps = np.sqrt(((own[near] - own[new]) ** 2).sum(1))
        stolen = steps < far[near]
        owner[near[stolen]], far[near[stolen]] = len(anchors), steps[stolen]
        anchors.append(own[new])
    groups = (at[owner == a] for a in range(len(anchors)))
    return [g for g in groups if len(g)]


def grown(points: np.ndarray, at: np.ndarray) -> Ball:
    """The tree over some points of a block."""
    groups = anchored(points, at) if len(at) > LEAF else []
    if len(groups) < 2:
        return Ball(points, at)
    balls = [grown(points, g) for g in groups]
    n = len(balls)
    means, radii = np.array([b.mean for b in balls]), np.array([b.radius for b in balls])

    def spans(i: int) -> np.ndarray:
        apart = np.sqrt(((means - means[i]) ** 2).sum(1))
        return np.maximum((apart + radii + radii[i]) / 2, np.maximum(radii, radii[i]))

    cost = np.array([spans(i) for i in range(n)])
    cost[np.diag_indices(n)] = np.inf
    for _ in range(n - 1):
        i, j = divmod(int(cost.argmin()), n)
        balls[i] = Ball(points, np.concatenate([balls[i].at, balls[j].at]), (balls[i], balls[j]))
        means[i], radii[i] = balls[i].mean, balls[i].radius
        cost[j], cost[:, j] = np.inf, np.inf
        alive = np.isfinite(cost[i])
        cost[i] = cost[:, i] = np.where(alive, spans(i), np.inf)
        root = balls[i]
    return root


def laid_out(points: np.ndarray) -> dict[str, np.ndarray]:
    """A block's tree as arrays. ``order`` lists the points so that each ball is a range of it; children follow their parents."""
    root = grown(points, np.arange(len(points)))
    balls, starts, first = [root], [0], []
    for ball, start in zip(balls, starts, strict=False):  # both grow on the way
        first.append(len(balls) if ball.below else 0)
        for half in ball.below:
            balls.append(half)
            starts.append(start)
            start += len(half.at)
    return {
        "order": root.at, "start": np.array(starts), "size": np.array([len(b.at) for b in balls]), "first": np.array(first),
        "mean": np.array([b.mean for b in balls]), "radius": np.array([b.radius for b in balls]), "sum": np.array([points[b.at].sum(0) for b in balls]),
    }


def owners(tree: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Balls that are wholly owned with their entries, and the other points (as places in ``order``) with theirs.

    Entry e leaves a ball with nearest entry b when |c-e|^2 - |c-b|^2 > 2 r |e-b| for its mean c and radius r: then b is nearer for all points within.
    Equal entries give way to the first of them. Points of leaves with several candidates are compared in whole numbers.
    """
    entries = book.astype(np.float64)
    apart = np.sqrt(((entries[:, None] - entries[None]) ** 2).sum(-1))
    firsts = (book[:, None] == book[None]).all(-1).argmax(1) == np.arange(len(book))
    balls, candidates = np.array([0]), firsts[None]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    places, nearest = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(balls):
        far = ((tree["mean"][balls][:, None] - entries[None]) ** 2).sum(-1)
        far = np.where(candidates, far, np.inf)
        best = far.argmin(1)
        reach = 2 * tree["radius"][balls][:, None] * apart[best]
        least = far[np.arange(len(balls)), best][:, None]
        candidates = candidates & (far - least <= reach + 1e-7 * (1 + far + reach))
        whole = candidates.sum(1) == 1
        found.append((balls[whole], best[whole]))
        balls, candidates = balls[~whole], candidates[~whole]
        leaf = tree["first"][balls] == 0
        size = tree["size"][balls[leaf]]
        at = np.repeat(tree["start"][balls[leaf]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        if len(at):
            steps = ((points[tree["order"][at]][:, None] - book[None]) ** 2).sum(-1)
            places.append(at)
            nearest.append(np.where(np.repeat(candidates[leaf], size, 0), steps, FAR).argmin(1))
        balls, candidates = tree["first"][balls[~leaf]], candidates[~leaf]
        balls, candidates = np.concatenate([balls, balls + 1]), np.concatenate([candidates, candidates])
    owned, entry = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    return owned, entry, np.concatenate(places), np.concatenate(nearest)


def gathered(tree: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of each entry's points."""
    balls, entry, places, nearest = owners(tree, points, book)
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    np.add.at(sums, entry, tree["sum"][balls])
    np.add.at(counts, entry, tree["size"][balls])
    np.add.at(sums, nearest, points[tree["order"][places]])
    np.add.at(counts, nearest, 1)
    return sums, counts


def coded(tree: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Each point's entry."""
    balls, entry, places, nearest = owners(tree, points, book)
    code = np.empty(len(points), np.int64)
    size = tree["size"][balls]
    at = np.repeat(tree["start"][balls] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    code[tree["order"][at]] = np.repeat(entry, size)
    code[tree["order"][places]] = nearest
    return code


def _packed(points: np.ndarray) -> bytes:
    """All parts of a block, ``points[part, place, component]``, with their trees."""
    out = io.BytesIO()
    small = np.int32 if np.abs(points).max() < 1 << 31 else np.int64
    np.savez(out, points=points.astype(small), **{f"{name}_{part}": a for part, own in enumerate(points) for name, a in laid_out(own).items()})
    return out.getvalue()


def _unpacked(block: bytes) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    with np.load(io.BytesIO(block)) as held:
        points = held["points"].astype(np.int64)
        for part, own in enumerate(points):
            yield {name: held[f"{name}_{part}"] for name in ("order", "start", "size", "first", "mean", "radius", "sum")}, own


def vector_codes(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Codes of all vectors: ``vec_id, code, error, label_error, codebooks_sha256``, one row for each kept row.

    Rows whose vector is null or empty or holds null or non-finite components are dropped, and so are those of another length
    than the vector with the smallest id. That length must be a multiple of ``parts``. Components become floor(256 * x) and must be within 2**28 then, or an error
    says so: beyond it squared distances leave 64 bits. The ``entries`` smallest ids start the codebooks (ties by vector, null ids
    last; fewer vectors make fewer entries); repeated rows count each. An empty table gives an empty table; other columns are not read.

    The driver holds the codebooks only; sums come to it by entry and component.
    """
    spark = vectors.sparkSession
    ship(spark)
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    label_type = vectors.schema[label_col].dataType
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & sound)
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    least = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).select(F.size("v").alias("n")).collect()
    if not least:
        return spark.createDataFrame([], schema)
    length = least[0]["n"]
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("v") == length)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    whole = np.floor(np.clip(np.array([r["v"] for r in first]) * 256, -MOST, MOST)).astype(np.int64)  # components beyond are an error below
    books = whole.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                cut = batch.slice(start, block)
                x = np.floor(cut.column(2).flatten().to_numpy(zero_copy_only=False).reshape(cut.num_rows, length) * 256)
                if np.abs(x).max() > MOST:
                    raise ValueError(f"components beyond {MOST // 256} don't fit exact 64-bit distances")
                points = x.astype(np.int64).reshape(cut.num_rows, parts, -1).transpose(1, 0, 2)
                ids, labels = (pa.ListArray.from_arrays([0, cut.num_rows], cut.column(c)) for c in (0, 1))
                yield pa.record_batch([ids, labels, pa.array([_packed(points)], pa.binary())], names=["ids", "labels", "block"])

    trees = common.stored(rows.mapInArrow(blocks, f"ids array<long>, labels array<{label_type.simpleString()}>, block binary"), "metric-trees")

    for _ in range(rounds):
        held = books

        def sums(batches: Iterator[pa.RecordBatch], held: np.ndarray = held) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(held.shape, np.int64), np.zeros(held.shape[:2], np.int64)
            for batch in batches:
                for raw in batch.column(0):
                    for part, (tree, points) in enumerate(_unpacked(raw.as_py())):
                        s, n = gathered(tree, points, held[part])
                        total[part] += s
                        count[part] += n
            part, entry, place = np.nonzero(np.broadcast_to(count[:, :, None] > 0, total.shape))
            yield pa.record_batch([part.astype(np.int32), entry.astype(np.int32), place.astype(np.int32), total[part, entry, place], count[part, entry]], names=["part", "entry", "place", "s", "n"])

        found = trees.select("block").mapInArrow(sums, "part int, entry int, place int, s long, n long").groupBy("part", "entry", "place").agg(F.sum("s"), F.sum("n")).collect()
        books = books.copy()
        for part, entry, place, s, n in found:
            books[part, entry, place] = s // n

    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    last = books

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, raw in zip(*(batch.column(c) for c in range(3)), strict=True):
                found, error = [], np.zeros(len(ids), np.int64)
                for part, (tree, points) in enumerate(_unpacked(raw.as_py())):
                    code = coded(tree, points, last[part])
                    error += ((points - last[part][code]) ** 2).sum(1)
                    found.append(code)
                lines = np.array(found, np.uint8).T.copy()
                yield pa.record_batch([ids.values, labels.values, pa.array([line.tobytes().hex() for line in lines]), error], names=["vec_id", "label", "code", "error"])

    coded_rows = common.stored(trees.mapInArrow(codes, f"vec_id long, label {label_type.simpleString()}, code string, error long"), "codes")
    key = F.when(F.col("label").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("label").cast("string")))
    keyed = coded_rows.select("vec_id", "code", "error", key.alias("label_key"))
    by_label = common.stored(keyed.groupBy("label_key").agg(F.sum("error").alias("label_error")), "label-errors")
    return common.keyed_join(keyed, by_label, ["label_key"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    step = "list_sum(list_transform(range(1, w + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
    out = [
        "k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"s AS (SELECT vec_id, label, part, len(v) // {parts} AS w, v FROM k, (SELECT unnest(range({parts})) AS part))",
        "p AS MATERIALIZED (SELECT vec_id, label, part, w, v[part * w + 1 : (part + 1) * w] AS x FROM s)",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {entries})",
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(label) AS label, any_value(p.x) AS x, min(d) AS d, arg_min(entry, d * 256 + entry) AS entry FROM (SELECT p.vec_id, p.part, p.label, p.x, b.entry, {step} AS d FROM p JOIN b{r} b ON p.part = b.part) p GROUP BY vec_id, part)")
        if r < rounds:
            out.append(f"t{r} AS (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY part, entry, i)")
            out.append(f"m{r} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM t{r} GROUP BY part, entry)")
            out.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry)")
    out.append(f"c AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    out.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n     ".join(out) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"


ORACLE_SQL = _oracle()
