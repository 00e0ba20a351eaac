"""Language identification with error-correcting output codes.

Each language has a codeword; binary logistic classifiers over hashed character n-grams predict the
bits of a text's codeword, and the language with the least weighted loss against the predicted bits wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm import common
from docspark.packaging import ship

BUCKETS = 2048
SAMPLE_ROWS = 4000
_LETTER = re.compile(r"[^\W\d_]")


def codewords(k: int) -> np.ndarray:
    """One row of -1 and 1 for each of k languages: all splits for few, else random ones."""
    if k <= 7:
        bits = [[1 if b >> i & 1 else -1 for b in range(1, 1 << (k - 1))] for i in range(k)]
        return np.array(bits or [[1]], np.float32).reshape(k, -1)
    return np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (k, 10 * int(np.ceil(np.log2(k)))))


def features(texts: list[str]) -> np.ndarray:
    """Root frequencies of hashed byte n-grams (one to three) of lower-cased whole texts."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, x in enumerate(texts):
        b = np.frombuffer((" " + x.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        two = b[:-1] * 257 + b[1:]
        three = two[:-1] * 263 + b[2:]
        for n, gram in ((1, b), (2, two), (3, three)):
            slot = ((gram + np.uint32(n << 26)) * np.uint32(2654435761)) >> np.uint32(32 - 11)
            out[i] += np.bincount(slot, minlength=BUCKETS)
        out[i] = np.sqrt(out[i] / out[i].sum())
    return out


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    sharpness: float = 4.0

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each language against the predicted bits, weighted by the classifiers' trust."""
        margin = x @ self.weights + self.bias
        return np.stack([np.logaddexp(0, -margin * code) @ self.trust for code in self.codes], 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, its score, and the share of the runner-up."""
        loss = self.losses(x)
        p = np.exp(-self.sharpness * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        p[np.arange(len(p)), best] = 0
        return best, score, p.max(1)


def fit(x: np.ndarray, languages: list[str], steps: int = 150, ridge: float = 1e-5) -> Model:
    """Binary classifiers of all bits by accelerated gradient steps; each language weighs the same."""
    names = sorted(set(languages))
    y = np.array([names.index(v) for v in languages])
    codes = codewords(len(names))
    share = (1 / np.bincount(y))[y] / len(names)
    target = codes[y]
    w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    last_w, last_b = w, b
    for step in range(steps):
        k = step / (step + 3)
        vw, vb = w + k * (w - last_w), b + k * (b - last_b)
        pull = (-target / (1 + np.exp(target * (x @ vw + vb)))) * share[:, None]
        last_w, last_b = w, b
        w, b = vw - 4 * (x.T @ pull + ridge * vw).astype(np.float32), vb - 4 * pull.sum(0).astype(np.float32)
    right = ((np.sign(x @ w + b) == target) * share[:, None]).sum(0)
    trust = np.maximum(right - 0.5, 0.01)
    return Model(names, codes, w, b, (trust / trust.sum()).astype(np.float32))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on at most ``sample_rows`` labelled rows and one more for each language, spread evenly over all languages.

    Of each language the distinct rows of the least 64-bit hash of id and text are taken; its count says below which hash to look, so
    few rows are ranked. The bound and the spread hold whatever the corpus. None without labelled rows.
    """
    ship(docs.sparkSession)
    h = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    labelled = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"), h.alias("h")).where("lang is not null")
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return None
    each = -(-sample_rows // len(counts))
    below = {r.lang: min((1 << 63) - 1, int((1.1 * each + 3) / r["count"] * (1 << 64)) - (1 << 63)) for r in counts}
    low = labelled.where(F.col("h") <= F.create_map(*[F.lit(v) for pair in below.items() for v in pair])[F.col("lang")]).dropDuplicates(["lang", "h"])
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= each)
    sample = ranked.orderBy("lang", "h").select(F.lit(0).alias("none"), "text", "lang")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                x = features(part.column(1).to_pylist()).astype(np.float16)
                yield pa.record_batch([part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = sample.mapInArrow(measured, "lang string, x binary").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return fit(x, got.column("lang").to_pylist())


def held_out(id_col: str = "doc_id", modulus: int = 4, rest: int = 2) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves the rest."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == rest, F.lit(False))


def _judged(model: Model | None, texts: list[str], margin: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and ambiguity of some texts."""
    lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    at = [i for i, t in enumerate(texts) if model is not None and _LETTER.search(t)]
    if at:
        best, top, second = model.predict(features([texts[i] for i in at]))
        for i, b in zip(at, best, strict=True):
            lang[i] = model.languages[b]
        score[at], unsure[at] = top, top - second < margin
    return lang, score, unsure


def in_a_language(spark: SparkSession, model: Model | None, text: Column, least: float, wanted: tuple[str, ...] | None = None) -> Column:
    """Whether the predicted language is known (one of ``wanted``, if given) and its score reaches ``least``: a column, for filters that keep whole rows without a join."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def asks(texts: pd.Series) -> pd.Series:
        held = texts.fillna("").tolist()
        parts = [_judged(sent.value, held[i : i + 512], 0.0)[:2] for i in range(0, len(held), 512)]
        return pd.Series([x != "und" and s >= least and (wanted is None or x in wanted) for lang, score in parts for x, s in zip(lang, score, strict=True)], dtype=bool)

    return asks(text.cast("string"))


def has_letter(spark: SparkSession, text: Column) -> Column:
    """Whether a text has a letter, as the model asks before it judges."""
    ship(spark)

    @F.pandas_udf("boolean")
    def asks(texts: pd.Series) -> pd.Series:
        return pd.Series([_LETTER.search(t) is not None for t in texts.fillna("")], dtype=bool)

    return asks(text.cast("string"))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.2) -> DataFrame:
    """Language of every whole text: ``doc_id, lang_pred, score, ambiguous``.

    ``und`` with score 0 where the text is null, empty or without a letter, or where nothing was
    learned. Ambiguous: the runner-up comes within ``margin``. Repeated rows are judged each; an empty table
    gives an empty table; other columns are not read. No shuffle.
    """
    rows = common.texts(docs, id_col, text_col)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                for start in range(0, part.num_rows, 512):
                    some = part.slice(start, 512)
                    lang, score, unsure = _judged(sent.value, some.column(1).to_pylist(), margin)
                    yield pa.record_batch([some.column(0), pa.array(lang, pa.string()), pa.array(score.astype(np.float64)), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(judge, "doc_id long, lang_pred string, score double, ambiguous boolean")
