"""Cross-entropy difference of documents under two matched n-gram models.

A target model (documents of a target set) and a background model (all documents) count the same runs of
``ORDER`` bytes and share one vocabulary, the 256 bytes, with equal smoothing; a document's score is the mean
over its bytes of background loss minus target loss, so higher means more like the target. Counts are complete:
every run of every text counts, in tables that grow with the corpus; lower orders are sums of the highest.

Texts are dealt once to blocks of bounded bytes by a hash of the row, whatever its source. A block gives its
distinct runs with their counts; totals become one loss pair per run; the block's runs fetch theirs by a join
on (run) and come home by block, where the texts are read once more. Nothing is broadcast.

Smoothing: order k takes its count over its context's count and leaves a share to order k - 1, by the number of
distinct followers of the context (Witten-Bell); below order 1 all bytes are alike.

Null and empty texts have no bytes and score 0 with losses 0; without a target the target model is flat;
repeated rows score alike and count each; documents whose id is in the target more than once count once;
further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import flat_bytes, text_or_empty
from fleetgauge.llm.components import stored

ORDER = 5  # bytes; a run fits a long
BLOCK_BYTES, PART_BYTES = 6 << 20, 1 << 20


def runs_of(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each byte the run that ends with it, as a number; texts begin after zeros."""
    own = np.repeat(rows[:-1], np.diff(rows))
    place = np.arange(len(data)) - own
    out = data.astype(np.int64)
    for back in range(1, ORDER):
        before = np.zeros(len(data), np.int64)
        before[back:] = data[:-back]
        before[place < back] = 0
        out |= before << (8 * back)
    return out


def _parts(data: np.ndarray, rows: np.ndarray):
    """Consecutive texts of about PART_BYTES: their first and past-last row, distinct runs and each byte's among them."""
    start, last = 0, len(rows) - 1
    while start < last:
        end = min(last, max(start + 1, int(np.searchsorted(rows, rows[start] + PART_BYTES, side="right")) - 1))
        own = rows[start:end + 1]
        value, place = np.unique(runs_of(data[own[0]:own[-1]], own - own[0]), return_inverse=True)
        yield start, end, value, place
        start = end


def _block_counts(key: tuple, table: pa.Table) -> pa.Table:
    texts, wanted = _split(table)
    data, rows = flat_bytes(texts.column("text"))
    in_target = np.isin(texts.column("id").to_numpy(zero_copy_only=False).astype(str), wanted) if len(wanted) else np.zeros(texts.num_rows, bool)
    found = [(np.zeros(0, np.int64),) * 3]
    for start, end, value, place in _parts(data, rows):
        target = np.repeat(in_target[start:end], np.diff(rows[start:end + 1]))
        found.append((value, np.bincount(place, minlength=len(value)), np.bincount(place[target], minlength=len(value))))
    values, every, target = (np.concatenate(x) for x in zip(*found))
    value, place = np.unique(values, return_inverse=True)
    sums = [np.bincount(place, weights=x, minlength=len(value)).astype(np.int64) for x in (every, target)]
    return pa.table({"block": pa.array(np.full(len(value), key[0].as_py(), np.int64)), "run": pa.array(value),
                     "n_b": pa.array(sums[0]), "n_t": pa.array(sums[1])})


def _split(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
    """The texts of a block, and the ids it was told to be in the target."""
    batch = table.combine_chunks()
    is_text = batch.column("is_text").combine_chunks()
    texts = batch.filter(is_text).combine_chunks()
    ids = batch.filter(pa.compute.invert(is_text)).column("id").to_numpy().astype(str)
    one = texts.to_batches()
    return (one[0] if one else pa.RecordBatch.from_pylist([], schema=texts.schema)), np.unique(ids)


def losses(counts: DataFrame) -> DataFrame:
    """run, loss_t and loss_b for all runs of ``counts`` (run, n_b, n_t)."""
    model = counts
    # order k of a run is its last k bytes; its context is that without the last byte
    for k in range(1, ORDER + 1):
        model = model.withColumn(f"g{k}", F.expr(f"run & {(1 << (8 * k)) - 1}L"))
    p = {"b": F.lit(1 / 256), "t": F.lit(1 / 256)}
    for k in range(1, ORDER + 1):
        own = counts.groupBy(F.expr(f"run & {(1 << (8 * k)) - 1}L").alias(f"g{k}")).agg(
            F.sum("n_b").alias(f"b{k}"), F.sum("n_t").alias(f"t{k}"))
        context = own.groupBy(F.shiftrightunsigned(f"g{k}", 8).alias(f"c{k}")).agg(
            F.sum(f"b{k}").alias(f"cb{k}"), F.sum(f"t{k}").alias(f"ct{k}"),
            F.sum((F.col(f"b{k}") > 0).cast("long")).alias(f"db{k}"), F.sum((F.col(f"t{k}") > 0).cast("long")).alias(f"dt{k}"))
        both = own.withColumn(f"c{k}", F.shiftrightunsigned(f"g{k}", 8)).join(context, f"c{k}").drop(f"c{k}")
        model = model.join(both, f"g{k}")
        for m in "bt":
            lower = p[m]
            p[m] = F.when(F.col(f"c{m}{k}") > 0, (F.col(f"{m}{k}") + F.col(f"d{m}{k}") * lower) / (F.col(f"c{m}{k}") + F.col(f"d{m}{k}"))).otherwise(lower)
            model = model.withColumn(f"p{m}{k}", p[m])
            p[m] = F.col(f"p{m}{k}")
    return model.select("run", (-F.log(p["t"])).alias("loss_t"), (-F.log(p["b"])).alias("loss_b"))


def _block_scores(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    texts, _ = _split(left)
    data, rows = flat_bytes(texts.column("text"))
    known = right.column("run").to_numpy()
    order = np.argsort(known)
    known = known[order]
    losses = {c: right.column(c).to_numpy()[order] for c in ("loss_t", "loss_b")}
    sums = {c: np.zeros(texts.num_rows) for c in losses}
    for start, end, value, place in _parts(data, rows):
        at = np.searchsorted(known, value)
        own = rows[start:end + 1] - rows[start]
        for c, loss in losses.items():
            total = np.concatenate([[0.0], np.cumsum(loss[at][place])])
            sums[c][start:end] = (total[own[1:]] - total[own[:-1]]) / np.maximum(1, np.diff(own))
    return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": pa.array(np.diff(rows).astype(np.int64)),
                     "loss_target": pa.array(sums["loss_t"]), "loss_background": pa.array(sums["loss_b"]),
                     "score": pa.array(sums["loss_b"] - sums["loss_t"])})


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens (bytes), loss_target, loss_background and score for every row; ``target`` holds doc_ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_or_empty()
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text.alias("text"), F.lit(True).alias("is_text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    wanted = target.where("doc_id IS NOT NULL").select("doc_id").distinct().select(
        F.lit(None).cast(kind).alias("doc_id"), F.col("doc_id").cast("string").alias("id"), F.lit("").alias("text"), F.lit(False).alias("is_text"))
    # rows without an id go by their text
    place = F.pmod(F.when(F.col("is_text") & F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), F.lit(blocks))
    dealt = rows.unionByName(wanted).withColumn("block", place)
    schema = "block long, run long, n_b long, n_t long"
    found = stored(dealt.groupBy("block").applyInArrow(_block_counts, schema), "lm-runs")
    totals = stored(found.groupBy("run").agg(F.sum("n_b").alias("n_b"), F.sum("n_t").alias("n_t")), "lm-totals")
    model = losses(totals)
    home = found.select("block", "run").join(model, "run")
    return dealt.groupBy("block").cogroup(home.groupBy("block")).applyInArrow(
        _block_scores, f"doc_id {kind}, n_tokens long, loss_target double, loss_background double, score double")
