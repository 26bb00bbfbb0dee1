"""Documents to training sequences: quality rules, near-duplicates, repeated passages, benchmark passages, packing.

``run`` applies STAGES to ``documents``; each stage's rows are written to the shared folder and read again by
the next. All but the last return the columns of documents; the last returns the pieces of sequences.

Null texts are empty and go with the quality rules; rows are judged one by one, so repeated rows go together
until near-duplicate removal keeps one of them; columns that documents lack (n_chars, source) are not added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import decontaminate, packing, quality_rules, simhash, substrings
from fleetgauge.llm.common import table
from fleetgauge.llm.components import stored

def _free(docs: DataFrame, name: str) -> str:
    """``name``, longer if documents have such a column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with a key per row from its contents, and the key's name. Equal rows share their key, and
    what is decided holds for all of them."""
    row = _free(docs, "_row")
    names = [F.col(f"`{c}`") for c in sorted(docs.columns)]
    return docs.withColumn(row, F.md5(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))), row


def _keyed(docs: DataFrame, row: str) -> DataFrame:
    """What operators take: the row key in the place of the id, and the text."""
    return docs.select(F.col(row).alias("doc_id"), "text")


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars of the new text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that fail; documents that lose too much are gone."""
    rules = quality_rules.Rules()
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index("text")
        for batch in quality_rules.slices(batches):
            found = [quality_rules.judge((x or "").encode(), rules) for x in batch.column("text").to_pylist()]
            kept = pa.array([x[7] for x in found], pa.bool_())
            arrays = list(batch.columns)
            arrays[at] = pa.array([x[8].decode("utf-8", "replace") for x in found], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(kept)

    return _with_text(docs.mapInArrow(run, schema), columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest row key."""
    rows, row = _numbered(docs)
    groups = simhash.near_groups(_keyed(rows, row))
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias(row)).distinct()
    kept = rows.join(first, row, "left_semi")
    # rows that are equal in every column share their key: one of them stays
    return kept.groupBy(row).agg(*[F.first(f"`{c}`").alias(c) for c in docs.columns]).select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur elsewhere; documents of which nothing is left are gone."""
    rows, row = _numbered(docs)
    rest = _free(docs, "_left")
    left = substrings.remove_repeats(_keyed(rows, row), as_text=True).where("n_removed > 0")
    left = left.groupBy(F.col("doc_id").alias(row)).agg(F.min("kept").alias(rest))
    out = rows.join(left, row, "left")
    out = out.where(F.col(rest).isNull() | (F.trim(rest) != "")).withColumn("text", F.coalesce(rest, "text"))
    return _with_text(out, docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold benchmark passages in one word of twenty or more."""
    rows, row = _numbered(docs)
    hits = decontaminate.find_items(_keyed(rows, row), table(spark, sf_dir, "benchmark"))
    bad = hits.where("n_hit > 0 AND 20 * n_hit >= n_words").select(F.col("doc_id").alias(row))
    return rows.join(bad, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{i}-{name.split()[0]}")
    return docs


#: SimHash components, suffix sorting and tokenizing are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL: str | None = None
