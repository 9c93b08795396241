"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded on its own, gated attention says how
much each one weighs, and the weighted sum of the encodings is scored; only the document's label is
known in training (Ilse et al., 2018). A passage is 512 bytes of the text's UTF-8 form, its
features are hashed byte pairs and a few shares (repeated words, distinct words, capitals, digits,
signs), damped in short passages; every passage of the whole text is encoded.

Training happens on the driver with a bounded sample: at most ``max_bags`` labelled rows, the
first in the order of a hash of their id, with at most ``max_passages`` passages each, spread evenly
over the text. Their features are made in tasks. Scoring is a function of the text alone, with a
model of some hundred kilobytes in it: no shuffle.

Defined results: a null text is an empty text; an empty text is one passage without features and
gets a score like any other. Equal texts get equal scores. A null id is never held out and has no
label. Repeated labels of an id count once, by their mean, rounded; null labels count as none. If
the sample lacks one of the two labels, the score is the mean label, or 0.5 without any. Other columns play
no part. An empty table gives an empty one.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import text_of
from waymesh.runtime import ship

#: Bytes of a passage, and number of hashed features and of shares.
PASSAGE, HASHED, SHARES = 512, 512, 6
WIDTH = HASHED + SHARES
#: A passage of as many bytes counts half.
_DAMPING = 48
#: Bounds of the training sample.
MAX_BAGS, MAX_PASSAGES = 3000, 12


# kinds of bytes: 1 capitals, 2 digits, 3 signs, 0 the rest
_KIND = np.zeros(256, dtype=np.int64)
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


def held_out(id: Column) -> Column:
    """Whether a row is kept out of training: a third of the ids, by checksum."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def passage_features(text: str, most: int | None = None) -> np.ndarray:
    """One row of features per passage (at least one); ``most`` picks passages spread evenly."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    count = max(1, -(-len(data) // PASSAGE))
    pairs = data[:-1].astype(np.uint32) * 251 + data[1:] * np.uint32(7) + np.uint32(1)
    pairs = (pairs * np.uint32(2654435761)) >> np.uint32(23)  # 9 bits: HASHED
    chosen = np.arange(count)
    if most and count > most:
        chosen = np.unique(np.linspace(0, count - 1, most).astype(np.int64))
    out = np.zeros((len(chosen), WIDTH), dtype=np.float32)
    for row, passage in enumerate(chosen):
        here = slice(passage * PASSAGE, (passage + 1) * PASSAGE)
        part, bytes_here = pairs[here], data[here]
        if len(part):
            out[row, :HASHED] = np.sqrt(np.bincount(part, minlength=HASHED) / len(part))
            out[row, HASHED:] = _shares(bytes_here)
            out[row] *= len(part) / (len(part) + _DAMPING)
    return out


def _shares(part: np.ndarray) -> list[float]:
    words = part.tobytes().split()
    pairs, kinds = max(1, len(words) - 1), _KIND[part]
    counts = np.bincount(kinds, minlength=4)
    return [
        2.0 * sum(map(operator.eq, words, words[1:])) / pairs,
        1.0 - len(set(words)) / max(1, len(words)),
        *(2.0 * counts[1:4] / len(part)),
        len(part) / (10.0 * max(1, len(words))),
    ]


@dataclass
class AttentionModel:
    """Weights of encoder, gates and output."""

    encode: np.ndarray
    encode_bias: np.ndarray
    gate_v: np.ndarray
    gate_u: np.ndarray
    attend: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    NAMES = ("encode", "encode_bias", "gate_v", "gate_u", "attend", "out", "bias")

    @classmethod
    def start(cls, hidden: int = 24, gates: int = 12, seed: int = 7) -> AttentionModel:
        draw = np.random.default_rng(seed)
        r = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return cls(r(WIDTH, hidden) * 4, np.zeros(hidden, np.float32), r(hidden, gates), r(hidden, gates), r(gates), r(hidden),
                   np.zeros(1, np.float32))

    def run(self, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of bags whose passages are the rows of ``x`` from ``begins`` on."""
        h = np.tanh(x @ self.encode + self.encode_bias)
        v, u = np.tanh(h @ self.gate_v), 1 / (1 + np.exp(-np.clip(h @ self.gate_u, -30, 30)))
        e = np.exp(np.clip((v * u) @ self.attend, -30, 30))
        owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(x))))
        a = e / np.add.reduceat(e, begins)[owner]
        z = np.add.reduceat(a[:, None] * h, begins, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ self.out + self.bias[0], -30, 30)))
        return p, (h, v, u, a, z, owner)

    def gradients(self, x: np.ndarray, begins: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy."""
        p, (h, v, u, a, z, owner) = self.run(x, begins)
        off = (p - label) / len(label)
        dz = off[:, None] * self.out
        da = (dz[owner] * h).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, begins)[owner])
        dg = ds[:, None] * self.attend
        dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
        dh = a[:, None] * dz[owner] + dv @ self.gate_v.T + du @ self.gate_u.T
        dt = dh * (1 - h * h)
        return {
            "encode": x.T @ dt, "encode_bias": dt.sum(axis=0), "gate_v": h.T @ dv, "gate_u": h.T @ du,
            "attend": (v * u).T @ ds, "out": z.T @ off, "bias": np.array([off.sum()]),
        }

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> AttentionModel:
        """Adam over shuffled batches; the same bags in the same order give the same weights."""
        draw = np.random.default_rng(seed)
        state = {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in self.NAMES}
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(bags))
            for at in range(0, len(bags), batch):
                picked = order[at:at + batch]
                part = [bags[k] for k in picked]
                begins = np.cumsum([0, *[len(b) for b in part[:-1]]])
                step += 1
                for n, g in self.gradients(np.concatenate(part), begins, labels[picked]).items():
                    m, s = state[n]
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    change = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - change).astype(np.float32))
        return self

    def score(self, text: str) -> float:
        return float(self.run(passage_features(text), np.array([0]))[0][0])


def training_bags(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    max_bags: int = MAX_BAGS, max_passages: int = MAX_PASSAGES,
) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the bounded sample of rows that are not held out."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "id": batch["id"], "order": batch["order"], "label": batch["label"],
                "features": [passage_features(t, max_passages).astype(np.float16).tobytes() for t in batch["body"]],
            })

    known = (
        labels.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("double").alias("label"))
        .na.drop().filter(~held_out(F.col("id"))).groupBy("id").agg(F.round(F.avg("label")).alias("label"))
        .withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(max_bags)
    )
    bodies = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), text_of(text).alias("body"))
    found = (
        bodies.join(F.broadcast(known), "id")  # at most max_bags rows
        .mapInPandas(work, "id bigint, order bigint, label double, features binary")
        .orderBy("order", "id", F.md5("features")).limit(max_bags).collect()
    )
    bags = [np.frombuffer(r.features, dtype=np.float16).reshape(-1, WIDTH).astype(np.float32) for r in found]
    return bags, np.array([r.label for r in found], dtype=np.float32)


def quality_score(bags: list[np.ndarray], labels: np.ndarray):
    """A function from a column of texts to their scores, trained from the sample."""
    constant, model = None, None
    if not len(labels) or labels.min() == labels.max():
        constant = float(labels.mean()) if len(labels) else 0.5
    else:
        model = AttentionModel.start().fit(bags, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([constant if model is None else model.score(t) for t in texts], dtype="float64")

    return score


def score_documents(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", **bounds
) -> DataFrame:
    """``id, held_out, score, predicted`` for every row."""
    score = quality_score(*training_bags(docs, labels, id, text, label, **bounds))
    scored = docs.select(F.col(f"`{id}`").alias(id), score(text_of(text)).alias("score"))
    return scored.select(
        F.col(f"`{id}`"), held_out(F.col(f"`{id}`")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", **bounds) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; all columns stay."""
    score = quality_score(*training_bags(docs, labels, id, text, label, **bounds))
    return docs.filter(score(text_of(text)) >= 0.5)
