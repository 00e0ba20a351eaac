"""Benchmark decontamination: pigeonhole search with bit-parallel verification.

A test item that may differ in k characters is split into k + 1 pieces; one of them stands unchanged in
any text that holds the item. Exact piece hits come from one automaton, and the surroundings of a
hit are verified with Myers' bit-parallel edit distance.
"""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm import common
from docspark.packaging import ship

ERROR_RATE = 0.05
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 8 << 20
SCHEMA = "doc_id long, item_id long, edit_distance int, error_budget int, start long"


def normalised(text: str) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: str, text: str, masks: dict[str, int], anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the item to any part of the text, and the end of the first such part; ``anchored`` parts begin where the text does."""
    m = len(item)
    high, full = 1 << (m - 1), (1 << m) - 1
    plus, minus, score = full, 0, m
    best = (m, 0)
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = (minus | ~(xh | plus)) & full, plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1 | anchored) & full, (mh << 1) & full
        plus, minus = (mh | ~(xv | ph)) & full, ph & xv
        if score < best[0]:
            best = (score, end)
            if not score:
                break
    return best


class Matcher:
    """All test items of a block behind one automaton."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = [(i, t, int(error_rate * len(t))) for i, x in items if (t := normalised(x))]
        self.masks: dict[tuple[int, bool], dict[str, int]] = {}
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item, budget) in enumerate(self.items):
            for at, piece in pieces(item, budget):
                owners.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, of in owners.items():
            self.automaton.add_word(piece, (len(piece), of))
        if owners:
            self.automaton.make_automaton()

    def _mask(self, k: int, backwards: bool = False) -> dict[str, int]:
        if (k, backwards) not in self.masks:
            found: dict[str, int] = {}
            for i, c in enumerate(self.items[k][1][:: -1 if backwards else 1]):
                found[c] = found.get(c, 0) | 1 << i
            self.masks[k, backwards] = found
        return self.masks[k, backwards]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Items held by a whole text: ``item_id, edit distance, budget, start`` in the normalised text."""
        text = normalised(text)
        if not text or not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, of) in self.automaton.iter(text):
            for k, at in of:
                starts.setdefault(k, set()).add(end + 1 - size - at)
        out = []
        for k in sorted(starts):
            item_id, item, budget = self.items[k]
            best = None
            run: list[int] = []
            for s in [*sorted(starts[k]), None]:
                if run and (s is None or s - run[-1] > 2 * budget + 1):
                    found = self._verify(k, text, run[0], run[-1])
                    if found and (best is None or found < best):
                        best = found
                    run = []
                    if best and not best[0]:
                        break
                if s is not None:
                    run.append(s)
            if best:
                out.append((item_id, best[0], budget, best[1]))
        return out

    def _verify(self, k: int, text: str, first: int, last: int) -> tuple[int, int] | None:
        """Least distance around some starts and where that match begins: read backwards from its end, the shortest part with that distance."""
        _, item, budget = self.items[k]
        low = max(0, first - budget)
        distance, end = best_match(item, text[low : last + len(item) + budget], self._mask(k))
        if distance > budget:
            return None
        if not distance:
            return 0, low + end - len(item)
        back = text[max(0, low + end - len(item) - budget) : low + end][::-1]
        return distance, low + end - best_match(item[::-1], back, self._mask(k, True), anchored=True)[1]


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Which documents hold which test items: one row for each pair of a document row and an item.

    Returns ``doc_id, item_id, edit_distance, error_budget, start`` (the place in the normalised text). An item may
    differ in ``error_rate`` of its characters, rounded down, and may stand anywhere, also inside words; that holds for items of any length. Null
    and empty texts and items match nothing; repeated rows answer each, repeated items once; texts are searched whole;
    empty tables give an empty table; other columns are not read. Items go to the tasks in blocks of bounded size, one
    pass over the documents for each; there is no shuffle of documents.
    """
    rows = common.texts(docs, id_col, text_col)
    out = None
    for sent in _blocks(benchmark, item_col, item_text_col):
        hits = rows.mapInArrow(_search(sent, error_rate), SCHEMA)
        out = hits if out is None else out.unionByName(hits)
    return out


def _blocks(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> Iterator:
    """Broadcast blocks of test items, each of bounded size."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item")).where("item is not null").distinct()
    count, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("item")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        held = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == b).collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(held)


def holds_item(benchmark: DataFrame, text: Column, error_rate: float = ERROR_RATE) -> Column:
    """Whether a text holds a test item, as a column: filters keep whole rows without a join."""
    ship(benchmark.sparkSession)
    found = F.lit(False)
    for sent in _blocks(benchmark):
        found = found | _holds(sent, error_rate)(text.cast("string"))
    return found


def _holds(sent, error_rate: float):
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value, error_rate)
        for texts in batches:
            yield pd.Series([bool(matcher.find(t)) for t in texts.fillna("")], dtype=bool)

    return holds


def _search(sent, error_rate: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, error_rate)
        for batch in batches:
            for part in common.slices(batch):
                found = [(d, *hit) for d, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for hit in matcher.find(x)]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "edit_distance", "error_budget", "start"])

    return search
