"""Toxicity from the nearest labelled examples.

Examples and documents are TF-IDF vectors over all words of the examples. A word's inverse document frequency counts all
documents; its weight also grows with its relevance, the smoothed log odds of the label among the examples, so that rare
words without a bearing on the label don't drown the others. No word is left out, and the cosines are exact.

The index is inverted: a word's postings stand by blocks of examples, each with its largest weight. Blocks are
visited by falling bound until none can reach the current k-th similarity. Words of many examples are summed by one
matrix product for a batch of texts, which makes their part of the bounds exact. The neighbours' votes weigh by distance
and a logistic curve fitted on the examples (each without itself) turns them into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm import common

EXAMPLES = 6000
NEIGHBOURS = 30
BLOCK = 32
DENSE = 0.05  # share of the examples from which a word is a row of the matrix
ROWS = 256  # texts at once
RELEVANCE = (0.1, 10)  # a word's least factor, and how many examples make its odds half as sure


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Runs of letters in lower case: where each text's words start, the words by number, and the distinct words."""
    split = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(texts), r"\PL+", " "), " ")
    parts = split.flatten().dictionary_encode()
    return split.offsets.to_numpy().astype(np.int64), parts.indices.to_numpy().astype(np.int64), parts.dictionary.to_numpy(zero_copy_only=False).tolist()


def bags(texts: pa.Array, vocabulary: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Counts of words in whole texts: where each text's entries start, word numbers (of the vocabulary, else of the batch), counts, batch's words."""
    bounds, codes, words = words_of(texts)
    number = np.array([i if w else -1 for i, w in enumerate(words)] if vocabulary is None else [vocabulary.get(w, -1) for w in words], np.int64)
    n = len(texts)
    size = max(1, len(words) if vocabulary is None else len(vocabulary))
    term = number[codes] if len(words) else codes
    keys, counts = np.unique((np.repeat(np.arange(n), np.diff(bounds)) * size + term)[term >= 0], return_counts=True)
    return np.searchsorted(keys, np.arange(n + 1) * size), keys % size, counts, words


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of ranges, one range after the other."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


@dataclass
class Index:
    vocabulary: dict[str, int]
    factor: np.ndarray  # of each word: inverse document frequency times relevance
    ids: np.ndarray  # of the examples
    toxic: np.ndarray
    term: np.ndarray  # postings by word and example
    example: np.ndarray
    weight: np.ndarray
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))
    base: float = 0.5

    def __post_init__(self) -> None:
        n = len(self.ids)
        self.blocks = -(-n // BLOCK)
        # Words of many examples are rows of a matrix, the others keep postings.
        many = np.flatnonzero(np.bincount(self.term, minlength=len(self.factor)) >= max(2, n * DENSE))
        self.row = np.full(len(self.factor), -1)
        self.row[many] = np.arange(len(many))
        common_word = self.row[self.term] >= 0
        self.dense = np.zeros((len(many), self.blocks * BLOCK), np.float32)
        self.dense[self.row[self.term[common_word]], self.example[common_word]] = self.weight[common_word]
        term, example = self.term[~common_word], self.example[~common_word]
        self.weights, self.examples, block = self.weight[~common_word].astype(np.float32), example.astype(np.int32), example // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.empty(0, np.int64)
        self.at = np.append(first, len(term)).astype(np.int32)  # of each block of a word, its postings
        self.block = block[first].astype(np.int32)
        self.best = np.maximum.reduceat(self.weights, first) if len(first) else self.weights
        self.of = np.searchsorted(term[first], np.arange(len(self.factor) + 1)).astype(np.int32)  # of each word, its blocks

    def vectors(self, cuts: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF weights of texts, of length one each."""
        w = (1 + np.log(counts)) * self.factor[terms]
        text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        norm = np.sqrt(np.bincount(text, w * w, len(cuts) - 1))
        return w / np.where(norm > 0, norm, 1)[text]

    def nearest(self, cuts: np.ndarray, terms: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, skip: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text (``cuts`` of terms and weights) the k most similar examples and their cosines, ties by place; only positive ones.

        With ``skip`` the texts are the examples in their order, each without itself.
        """
        for start in range(0, len(cuts) - 1, ROWS):
            own = cuts[start : start + ROWS + 1]
            t, v = terms[own[0] : own[-1]], w[own[0] : own[-1]]
            row = self.row[t]
            text = np.repeat(np.arange(len(own) - 1), np.diff(own))
            share = np.zeros((len(own) - 1, len(self.dense)), np.float32)
            share[text[row >= 0], row[row >= 0]] = v[row >= 0]
            sums = share @ self.dense
            tops = sums.reshape(len(sums), self.blocks, BLOCK).max(2)
            rare = row < 0
            t, v, at = t[rare], v[rare].astype(np.float32), np.searchsorted(text[rare], np.arange(len(own)))
            for i in range(len(own) - 1):
                yield self._nearest(sums[i], tops[i], t[at[i] : at[i + 1]], v[at[i] : at[i + 1]], k, start + i if skip else -1)

    def _nearest(self, sums: np.ndarray, tops: np.ndarray, terms: np.ndarray, w: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks by falling bound: the largest sum over the common words plus the largest weights of the others."""
        held = self.of[terms + 1] - self.of[terms]
        entry, w = _ranges(self.of[terms], held), np.repeat(w, held)
        block = self.block[entry]
        bound = tops + np.bincount(block, w * self.best[entry], self.blocks)
        order = np.argsort(-bound, kind="stable")
        found, sims = np.empty(0, np.int64), np.empty(0)
        done, step = 0, 8
        while done < self.blocks and bound[order[done]] > 1e-6 and (len(sims) < k or bound[order[done]] >= sims[-1] - 1e-6):
            now = order[done : done + step]
            wanted = np.zeros(self.blocks, bool)
            wanted[now] = True
            some = np.flatnonzero(wanted[block])
            size = self.at[entry[some] + 1] - self.at[entry[some]]
            place = _ranges(self.at[entry[some]], size)
            more = np.bincount(self.examples[place], np.repeat(w[some], size) * self.weights[place], len(sums))
            here = (np.sort(now)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            s = sums[here] + more[here]
            at = np.flatnonzero((s >= max(sims[-1], 1e-6) if len(sims) >= k else s > 1e-6) & (here != skip))
            found, sims = np.concatenate([found, here[at]]), np.concatenate([sims, s[at]])
            best = np.lexsort((found, -sims))[:k]
            found, sims = found[best], sims[best]
            done, step = done + step, step * 2
        return found, sims

    def votes(self, found: np.ndarray, sims: np.ndarray) -> tuple[float, float]:
        """Share of toxic neighbours weighed by distance, with the base rate as one weak vote, and the best similarity."""
        if not len(found):
            return self.base, 0.0
        w = 1 / (1.05 - np.minimum(sims, 1))
        return float(((w * self.toxic[found]).sum() + 0.5 * self.base) / (w.sum() + 0.5)), float(sims[0])

    def score(self, vote: float, near: float) -> float:
        z = self.curve @ np.array([1.0, _logit(vote), near])
        return float(1 / (1 + np.exp(-z)))


def _logit(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return float(np.log(p / (1 - p)))


def make_index(words: list[str], ids: np.ndarray, toxic: np.ndarray, row: np.ndarray, term: np.ndarray, counts: np.ndarray, spread: np.ndarray, documents: int) -> Index:
    """Weights and postings from the words' counts in the examples; ``spread`` has the words' frequencies in all documents."""
    bad, good = np.bincount(term[toxic[row] == 1], minlength=len(words)), np.bincount(term[toxic[row] == 0], minlength=len(words))
    odds = np.log((bad + 1) / (toxic.sum() + 2)) - np.log((good + 1) / ((1 - toxic).sum() + 2))
    least, half = RELEVANCE
    factor = np.log((1 + documents) / (1 + spread)) * (least + np.abs(odds) * (bad + good) / (bad + good + half))
    w = (1 + np.log(counts)) * factor[term]
    norm = np.sqrt(np.bincount(row, w * w, len(ids)))
    w = w / np.where(norm > 0, norm, 1)[row]
    # Examples with the same heaviest word stand together, so that a block's bounds are near its weights.
    heavy = np.full(len(ids), -1)
    order = np.lexsort((w, row))
    heavy[row[order]] = term[order]  # the last of a row is its heaviest
    place = np.empty(len(ids), np.int64)
    place[np.lexsort((ids, toxic, heavy))] = np.arange(len(ids))
    by_place = np.argsort(place)
    row = place[row]
    order = np.lexsort((row, term))
    return Index({x: i for i, x in enumerate(words)}, factor, ids[by_place], toxic[by_place], term[order], row[order], w[order])


def _calibrate(index: Index, share: float) -> None:
    """Logistic curve over votes by Newton steps; classes weigh as in the labelled table."""
    order = np.argsort(index.example, kind="stable")
    cuts = np.searchsorted(index.example[order], np.arange(len(index.ids) + 1))
    rows = [index.votes(*near) for near in index.nearest(cuts, index.term[order], index.weight[order], skip=True)]
    x = np.array([[1.0, _logit(v), near] for v, near in rows])
    y = index.toxic.astype(float)
    held = max(y.mean(), 1e-6)
    weight = np.where(y == 1, share / held, (1 - share) / max(1 - held, 1e-6))
    curve = np.array([0.0, 1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ curve))
        gradient = x.T @ (weight * (y - p)) - 1e-2 * (curve - [0, 1, 0])
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        curve = curve + np.linalg.solve(hessian, gradient)
    index.curve = curve


def learnable(id_col: str = "doc_id", modulus: int = 3, rest: int = 1) -> Column:
    """Rows whose labels may be learned: crc32 of the id as text leaves another rest."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus != rest, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index | None:
    """Index over at most about ``examples`` labelled documents, half of each class where there are enough.

    Documents are taken by a hash of their id. Where several rows carry an id, its least text stands for it, and it is
    toxic if any of its labels is; null ids and labels other than 0 and 1 teach nothing. All words of the examples are
    terms; their document frequencies count all documents. None where a class has no example.
    """
    rows = common.texts(docs, id_col, text_col)
    spark = rows.sparkSession
    marked = labels.where(learnable(id_col)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    sizes = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    part = F.when(F.col("toxic") == 1, min(1.0, examples / 2 / sizes[1])).otherwise(min(1.0, examples / 2 / sizes[0]))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    picked = marked.withColumn("place", place).where(F.col("place") < part).orderBy("place", "doc_id").limit(2 * examples)
    chosen = common.stored(rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic"), "examples")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.slices(batch):
                cuts, term, counts, words = bags(some.column(1))
                names = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(words, pa.string()).take(pa.array(term)))
                yield pa.record_batch([some.column(0), some.column(2).cast(pa.int64()), names, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(counts, pa.int64()))], names=["doc_id", "toxic", "words", "counts"])

    got = chosen.mapInArrow(counted, "doc_id long, toxic long, words array<string>, counts array<long>").orderBy("doc_id").toArrow().combine_chunks()
    if set(got.column("toxic").unique().to_pylist()) != {0, 1}:
        return None
    lists = got.column("words").combine_chunks()
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    row, term = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), flat.indices.to_numpy().astype(np.int64)
    sent = spark.sparkContext.broadcast({x: i for i, x in enumerate(words)})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Document frequencies of the examples' words, one row for each word that a task has seen, and its documents as word -1."""
        seen, n = np.zeros(len(sent.value), np.int64), 0
        for batch in batches:
            for some in common.slices(batch):
                seen += np.bincount(bags(some.column(1), sent.value)[1], minlength=len(seen))
                n += some.num_rows
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n))], names=["term", "held"])

    found = rows.mapInArrow(frequencies, "term int, held long").groupBy("term").agg(F.sum("held").alias("held")).toArrow()
    at, held = found.column("term").to_numpy(), found.column("held").to_numpy()
    spread = np.zeros(len(words), np.int64)
    spread[at[at >= 0]] = held[at >= 0]
    toxic = got.column("toxic").to_numpy()
    index = make_index(words, got.column("doc_id").to_numpy(), toxic, row, term, got.column("counts").combine_chunks().flatten().to_numpy(), spread, int(held[at < 0].sum()))
    share = sizes[1] / (sizes[0] + sizes[1])
    bare = np.bincount(index.example, minlength=len(index.ids)) == 0
    odds = share / toxic.sum() * (bare & (index.toxic == 1)).sum(), (1 - share) / (1 - toxic).sum() * (bare & (index.toxic == 0)).sum()
    index.base = float((odds[0] + 1e-4) / (sum(odds) + 2e-4)) if bare.any() else share
    _calibrate(index, share)
    return index


def score(docs: DataFrame, index: Index | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Toxicity of every whole text: ``doc_id, score, predicted, evidence``.

    ``evidence`` has the three nearest examples with their labels and similarities. Null and empty texts, and
    those without a known word, score as the base rate does; without an index every score
    is 0. Repeated rows are scored each; an empty table gives an empty table; other columns are not read. No shuffle.
    """
    rows = common.texts(docs, id_col, text_col)
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for some in common.slices(batch):
                scores, evidence = [0.0] * some.num_rows, [[]] * some.num_rows
                if index is not None:
                    cuts, term, counts, _ = bags(some.column(1), index.vocabulary)
                    for i, (found, sims) in enumerate(index.nearest(cuts, term, index.vectors(cuts, term, counts))):
                        scores[i] = index.score(*index.votes(found, sims))
                        evidence[i] = [{"doc_id": int(index.ids[j]), "toxic": int(index.toxic[j]), "similarity": float(s)} for j, s in zip(found[:3], sims[:3], strict=True)]
                yield pa.record_batch([some.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())])))], names=["doc_id", "score", "evidence"])

    judged = rows.mapInArrow(judge, "doc_id long, score double, evidence array<struct<doc_id:long,toxic:int,similarity:double>>")
    return judged.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
