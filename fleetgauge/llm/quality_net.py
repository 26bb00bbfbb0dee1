"""A byte-level convolutional network in numpy that tells good documents from bad ones.

A text is read as bytes in chunks of 32 that overlap by half and cover all of it. A chunk's inputs are the
learned embeddings of its bytes in place and, for every lag up to 33, how many of its bytes repeat the byte
that far back. Learned filters run over the chunks; the greatest answer of each filter over the whole text is
combined into one probability.

Training reads a bounded sample: at most ``per_label`` labelled documents of each label, a stretch of
``stretch`` characters at a hashed place of each. Rows held out are never read. Scoring is one pass without a
shuffle and reads whole texts; the network (some 30 KB) travels with the job.

Null and empty texts are scored as a chunk of padding; without a labelled row of both labels the network stays
as it was drawn and scores are near one half; repeated rows score alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import flat_bytes, slices, text_or_empty

HALF, LAGS, PAD = 16, range(2, 34), 255  # 255 is no byte of UTF-8
GAP = 3  # blocks of padding between texts: more than the longest lag


@dataclass
class Net:
    embed: np.ndarray  # 256 x e
    byte_filters: np.ndarray  # 32 e x f
    lag_filters: np.ndarray  # lags x f
    bias: np.ndarray  # f
    out: np.ndarray  # f
    shift: np.ndarray  # 1

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.byte_filters, self.lag_filters, self.bias, self.out, self.shift]


def fresh(seed: int = 7, embed: int = 6, filters: int = 24) -> Net:
    r = np.random.default_rng(seed)

    def draw(*shape, scale):
        return (r.standard_normal(shape) * scale).astype(np.float32)

    wide = 2 * HALF * embed
    return Net(draw(256, embed, scale=0.5), draw(wide, filters, scale=wide**-0.5), draw(len(LAGS), filters, scale=0.3),
               np.zeros(filters, np.float32), draw(filters, scale=0.2), np.zeros(1, np.float32))


def laid_out(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as blocks of 16 bytes with padding between them; the first block and the chunks of each text."""
    size = np.diff(rows)
    own = np.maximum(1, -(-size // HALF))
    first = GAP + np.concatenate([[0], np.cumsum(own + GAP)])
    blocks = np.full(int(first[-1]) * HALF, PAD, np.uint8)
    shift = np.repeat(first[:-1] * HALF - rows[:-1], size)
    blocks[np.arange(len(data)) + shift] = data
    return blocks.reshape(-1, HALF), first[:-1], own


def repeats(blocks: np.ndarray) -> np.ndarray:
    """For each chunk (a block and the next) and lag, the share of bytes that equal the byte that far back."""
    flat = blocks.ravel()
    out = np.empty((len(blocks) - 1, len(LAGS)), np.float32)
    for i, lag in enumerate(LAGS):
        same = np.zeros(len(flat), np.uint8)
        same[lag:] = flat[lag:] == flat[:-lag]
        n = same.reshape(-1, HALF).sum(axis=1, dtype=np.uint8)
        out[:, i] = n[:-1] + n[1:]
    return out / np.float32(2 * HALF)


def answers(net: Net, blocks: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """Filter answers of every chunk."""
    e = net.embed[blocks].reshape(len(blocks), -1)
    half = e.shape[1]
    out = e[:-1] @ net.byte_filters[:half] + e[1:] @ net.byte_filters[half:]
    return out + lags @ net.lag_filters + net.bias


def pooled(found: np.ndarray, first: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The greatest answer of each filter over each text's chunks."""
    edges = np.stack([first, first + own], axis=1).ravel()
    found = np.concatenate([found, np.zeros((1, found.shape[1]), found.dtype)])
    return np.maximum.reduceat(found, edges, axis=0)[::2]


def probabilities(net: Net, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    blocks, first, own = laid_out(data, rows)
    top = np.tanh(pooled(answers(net, blocks, repeats(blocks)), first, own))
    return 1 / (1 + np.exp(-(top @ net.out + net.shift[0]).astype(np.float64)))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Net:
    """Adam on the cross-entropy; the gradient reaches the filters through the chunk that answered most."""
    net, r = fresh(seed), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        return net
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            own_texts = [texts[i] for i in pick]
            rows = np.concatenate([[0], np.cumsum([len(x) for x in own_texts])]).astype(np.int64)
            blocks, first, own = laid_out(np.frombuffer(b"".join(own_texts), np.uint8), rows)
            lags = repeats(blocks)
            found = answers(net, blocks, lags)
            best = np.stack([a + found[a:a + n].argmax(axis=0) for a, n in zip(first, own)])  # texts x filters
            top = np.tanh(np.take_along_axis(found, best, axis=0))
            wrong = (1 / (1 + np.exp(-(top @ net.out + net.shift[0])))) - labels[pick]
            wrong = (wrong / len(pick)).astype(np.float32)
            back = wrong[:, None] * net.out[None] * (1 - top**2)
            pairs = np.concatenate([blocks[best], blocks[best + 1]], axis=2)  # texts x filters x 32
            seen = net.embed[pairs].reshape(*best.shape, -1)
            g_bytes = np.einsum("tf,tfd->df", back, seen)
            g_lags = np.einsum("tf,tfl->lf", back, lags[best])
            to_embed = (back[:, :, None] * net.byte_filters.T[None]).reshape(-1, net.embed.shape[1])
            g_embed = np.zeros_like(net.embed)
            np.add.at(g_embed, pairs.ravel(), to_embed)
            grads = [g_embed, g_bytes, g_lags, back.sum(axis=0), wrong @ top + 1e-4 * net.out, wrong.sum(keepdims=True)]
            step += 1
            speed = rate * (1 - epoch / epochs)
            for p, g, (m, v) in zip(net.parts(), grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, per_label: int = 1200, stretch: int = 4096) -> Net:
    """A network for ``labels`` (doc_id, quality), learned from rows that are not ``held_out``."""
    known = (labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label IN (0, 1)")
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    pool = known.where(~F.coalesce(held_out, F.lit(True))).withColumn("order", F.xxhash64("doc_id", F.lit(1)))
    chosen = None
    for label in (0, 1):
        part = pool.where(F.col("label") == label).orderBy("order", "doc_id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    start = F.pmod("order", F.greatest(F.lit(1), F.length(text) - stretch + 1)) + 1
    found = docs.join(chosen, "doc_id").select("label", "order", F.substring(text, start.cast("int"), F.lit(stretch)).alias("text"))
    # an id may stand for several rows: the sample keeps its bound
    rows = sorted(((r["order"], r["text"], r["label"]) for r in found.orderBy("order", "text").limit(2 * per_label).collect()))
    return train([t.encode() for _, t, _ in rows], np.array([x for _, _, x in rows], np.float32))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) for every row, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            data, rows = flat_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probabilities(net, data, rows))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
