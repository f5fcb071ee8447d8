"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text is words and runs of signs; each of its n-grams up to ``ngram`` is hashed to a slot, and the slots' counts,
damped and scaled to unit length, are its features. FTRL-proximal keeps a sum of gradients and of their squares for
each slot, so rare slots learn faster and those that carry nothing stay at zero. A score is a sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.workspace import prepared, release

TOKEN = re.compile(r"\w+|[^\w\s]+")
MAX_WORDS = 150_000


@dataclass(frozen=True)
class QualityParams:
    ngram: int = 2
    slot_bits: int = 20
    train_rows: int = 12_000  # bound of the sample of labelled rows that the model is fitted on
    epochs: int = 10
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.005
    l2: float = 0.02
    threshold: float = 0.3


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word, 11)
        return value


_HASHES = _WordHash()


def features(text: str | None, params: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a whole text; slot 0 is the constant."""
    words = TOKEN.findall(text.lower()) if text else []
    slots = [np.zeros(1, np.int64)]
    values = [np.ones(1)]
    if words:
        single = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
        grams, gram = [single], single
        for k in range(1, params.ngram):
            if len(single) <= k:
                break
            gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[k:]
            grams.append(gram ^ (gram >> np.uint64(29)))
        mixed = np.concatenate(grams) * np.uint64(0xD6E8FEB86659FD93)
        found, counts = np.unique((mixed >> np.uint64(64 - params.slot_bits)).astype(np.int64), return_counts=True)
        damped = np.log1p(counts)
        slots.append(np.maximum(found, 1))
        values.append(damped / np.sqrt((damped * damped).sum()))
    return np.concatenate(slots), np.concatenate(values)


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], params: QualityParams) -> np.ndarray:
    """Weights by FTRL-proximal over the examples in the order given, ``epochs`` times."""
    z, n = np.zeros(1 << params.slot_bits), np.zeros(1 << params.slot_bits)

    def weights(at):
        zi = z[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - params.l1, 0)
        return -shrunk / ((params.beta + np.sqrt(n[at])) / params.alpha + params.l2)

    for _ in range(params.epochs):
        for slots, values, label in examples:  # kept narrow; an example at a time is widened
            slots, values = slots.astype(np.int64), values.astype(float)
            w = weights(slots)
            g = (sigmoid(w @ values) - label) * values
            g2 = g * g
            z[slots] += g - (np.sqrt(n[slots] + g2) - np.sqrt(n[slots])) / params.alpha * w
            n[slots] += g2
    return weights(slice(None)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> np.ndarray:
    """Weights from ``labels(doc_id, quality)`` and the texts of ``docs``.

    At most about ``train_rows`` labelled ids are used, chosen by the hash of the id, and of the rows of an id one
    text, that of the greatest hash, with the id's greatest label. So the broadcast table of ids, the training task and
    the weights that the driver gets are all of bounded size, also where an id is repeated very often.
    """
    prepared(docs.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    labelled = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, params.train_rows / max(1, labelled.count()))
    picked = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(labelled.where(picked)), "doc_id"
    )

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t, params) for t in batch["text"]]
            yield pd.DataFrame({
                "order": batch["order"], "label": batch["label"],
                "slots": [s.astype(np.int32).tobytes() for s, _ in found],
                "values": [v.astype(np.float32).tobytes() for _, v in found],
            })

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for batch in batches for r in zip(batch["order"], batch["slots"], batch["values"], batch["label"])]
        rows.sort(key=lambda r: r[:2])
        examples = [(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32), int(y)) for _, s, v, y in rows]
        yield pd.DataFrame({"weights": [train(examples, params).tobytes()]})
        del examples, rows
        release()

    one = F.max(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    source = joined.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"), one.alias("text")).select(
        F.xxhash64("doc_id", F.lit(5)).alias("order"), "label", "text"
    )
    found = source.mapInPandas(prepare, "order long, label int, slots binary, values binary")
    learnt = found.repartition(1).mapInPandas(learn, "weights binary").collect()
    if not learnt:  # no labelled row has a document
        return np.zeros(1 << params.slot_bits, np.float32)
    return np.frombuffer(learnt[0]["weights"], np.float32)


def score_column(docs: DataFrame, weights: np.ndarray, params: QualityParams, text_col: str = "text"):
    """The score of a text as a column; the weights, of fixed size, are broadcast."""
    shared = prepared(docs.sparkSession).sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value

        def one(text: str | None) -> float:
            slots, values = features(text, params)
            return float(sigmoid(w[slots].astype(float) @ values))

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype=float)
        release()

    return score(F.col(text_col).cast("string"))


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learnt from: the crc32 of the id as text is a multiple of 5. Null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Learns from the labels of rows that are not held out, and from texts only. Null and empty texts get the score
    of the constant alone; rows with repeated or null ids are scored each; null labels are passed over; without any
    usable label every score is 0.5; an empty table gives no rows.
    """
    weights = fit(docs, labels.where(~held_out()), params)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(docs, weights, params).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))
