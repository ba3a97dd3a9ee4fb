"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is one matrix of log-probabilities (buckets x languages), of a size fixed by its parameters, that every task
gets as a broadcast; texts are scored in Arrow batches with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from veridoc.llm.common import slices, to_python

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Most languages a model may have: with BUCKETS it bounds what is collected and broadcast (32 MB).
MAX_LANGUAGES = 256
#: The fit reads about this many labelled texts of a language, chosen by a hash of the identifier; fewer: all of them.
TRAIN_TEXTS = 20_000
FIT_TASKS = 12
UNKNOWN = "und"

# Characters handled at once; longer texts are cut with an overlap, so that no n-gram is lost or counted twice.
_SLAB = 1 << 19
_LETTER = re.compile(r"[^\W\d_]")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


@dataclass(frozen=True)
class Model:
    """Languages in code point order; log_prob[bucket, language]; log_prior[language]."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray
    orders: tuple[int, ...] = ORDERS


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _slabs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lower-cased, space-framed texts as (code points, index of the text of each one), in pieces of bounded size.

    A piece of a cut text starts with the last characters of the piece before; those carry the index -1 - i, which
    lets n-grams that end after them count and those that end in them not.
    """
    reach, codes, owners, size = max(ORDERS) - 1, [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        whole = _codes(f" {text.lower()} ")
        for at in range(0, len(whole), _SLAB):
            lead = min(at, reach)
            piece = whole[at - lead:at + _SLAB]
            owner = np.full(len(piece), i, dtype=np.int64)
            owner[:lead] = -1 - i
            codes.append(piece)
            owners.append(owner)
            size += len(piece)
            if size >= _SLAB:
                yield np.concatenate(codes), np.concatenate(owners)
                codes, owners, size = [], [], 0
    if codes:
        yield np.concatenate(codes), np.concatenate(owners)


def _grams(codes: np.ndarray, owners: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of each n-gram of one order that lies inside one text."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mixed = codes[:n] * _FACTORS[0] + np.uint32(order)
    for k in range(1, order):
        mixed = (mixed ^ (mixed >> np.uint32(15))) * _FACTORS[k] + codes[k:k + n]
    mixed = (mixed ^ (mixed >> np.uint32(13))) * _FACTORS[4]
    bucket = (mixed >> np.uint32(7)) & np.uint32(buckets - 1)
    first, last = owners[:n], owners[order - 1:]
    inside = (last >= 0) & ((first == last) | (first == -1 - last))
    return bucket[inside].astype(np.int64), last[inside]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_texts: int = TRAIN_TEXTS,
        buckets: int = BUCKETS, alpha: float = 0.1) -> Model:
    """Fit on the rows of `docs` with a text and a label.

    `train_texts` bounds the labelled texts read of one language: rows are kept by a hash of `key` (null keys by the
    text's hash) at the rate bound / count. Rows with a null or empty text or a null label teach nothing. No usable row
    gives a model without languages, whose predictions are all `und`. Of more than `MAX_LANGUAGES` labels the most frequent
    ones are learned, ties by code point.
    """
    spark = docs.sparkSession
    usable = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.col(key).alias("k")).filter(
        F.col("t").isNotNull() & (F.col("t") != "") & F.col("l").isNotNull())
    counts = usable.groupBy("l").agg(F.count("*").alias("n"))
    sizes = {r["l"]: r["n"] for r in counts.orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((buckets, 0), np.float32), np.zeros(0))
    share = F.pmod(F.xxhash64(F.coalesce(F.col("k").cast("string"), F.col("t"))), F.lit(1_000_000)) / 1_000_000.0
    rate = F.lit(0.0)
    for name, n in sizes.items():
        rate = F.when(F.col("l") == F.lit(name), F.lit(min(1.0, train_texts / n))).otherwise(rate)
    rows = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(rows) * buckets, dtype=np.int64)
        for batch in slices(batches):
            texts, labels = batch.column(0).to_pylist(), np.array([rows[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for codes, owners in _slabs(texts):
                for order in ORDERS:
                    bucket, owner = _grams(codes, owners, order, buckets)
                    seen += np.bincount(labels[owner] * buckets + bucket, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["cell", "n"])

    # The sample is bounded, so it goes to a fixed number of tasks and their sums to few rows.
    counted = (to_python(usable).filter(share < rate).select("t", "l").repartition(FIT_TASKS)
               .mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas())
    total = np.zeros((len(rows), buckets))
    total.reshape(-1)[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    smooth = total + alpha
    log_prob = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)
    log_prior = np.log(np.array([sizes[x] for x in languages], dtype=float) / sum(sizes.values()))
    return Model(languages, np.ascontiguousarray(log_prob), log_prior)


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Most probable language and its posterior of each text; `und` and 0 for null and texts without a letter."""
    total = np.zeros((len(texts), len(model.languages)))
    if model.languages:
        lettered = [t if t and _LETTER.search(t) else None for t in texts]
        for codes, owners in _slabs(lettered):
            for order in model.orders:
                bucket, owner = _grams(codes, owners, order, len(model.log_prob))
                if len(owner):
                    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    total[owner[starts]] += np.add.reduceat(model.log_prob[bucket], starts, axis=0)
        total += model.log_prior
        best = total.argmax(axis=1)
        posterior = 1.0 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
    names, scores = [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        known = bool(model.languages) and lettered[i] is not None
        names.append(model.languages[best[i]] if known else UNKNOWN)
        scores[i] = posterior[i] if known else 0.0
    return names, scores


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of `docs` but `pred` and `score` of the same name, which are replaced, and the prediction.

    Whole texts are scored. Null texts, empty ones and those without a letter give `und` and 0.0; equal texts give equal
    predictions; of languages with the same score the first by code point is taken; an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in (pred, score)]
    source = docs.select(*(F.col(f"`{c}`") for c in kept))
    if text not in kept:
        source = source.withColumn(text, F.col(f"`{text}`"))
    schema = T.StructType([*source.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    at, shared = kept.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = score_texts(shared.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)],
                                             [*batch.schema.names, pred, score])

    return to_python(source).mapInArrow(run, schema)


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs` whose language can be told, with their columns, whatever the names of these.

    Null and empty texts and those without a letter go. A model that has learned no language rejects nothing else.
    """
    if not model.languages:
        return docs.filter(F.coalesce(F.col(f"`{text}`").rlike(r"[\p{L}\p{Nl}\p{No}]"), F.lit(False)))
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("lang_pred", "score"):
        while name in taken:
            name += "_"
        names.append(name)
    told = predict(docs, model, text, *names)
    return told.filter(F.col(names[0]) != UNKNOWN).select(*(F.col(f"`{c}`") for c in docs.columns))


def in_training_part(key: str = "doc_id") -> Column:
    """crc32 of the identifier as text, modulo 3, is not 1; false for a null identifier."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
