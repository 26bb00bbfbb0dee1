"""Token counts of whole texts: lengths only, one pass, no shuffle.

Slices are balanced by bytes, long texts are cut at boundaries that the tokenizer never joins across, and each
distinct chunk of a slice is encoded once. Null texts count as empty (0 bytes, 0 tokens); repeated rows give
equal rows; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetgauge.llm.chunks import Encoder, piece_cuts, row_sums
from fleetgauge.llm.common import flat_bytes, slices, text_or_empty


def piece_model(path: str):
    """The model of sentencepiece and whether its texts may be cut before blanks and line ends."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i)]
    fit = not any("▁" in x.lstrip("▁") or "\n" in x for x in pieces)
    probe = "a  b　▁ \tＡ\n c "  # kept as it stands: no white space folded, nothing else mapped
    fit = fit and model.decode(model.encode(probe)) == probe.replace("▁", " ")
    return model, fit


def piece_encoder(model, fit: bool) -> Encoder:
    """Ids as they count: a chunk stands for itself inside its text, where no blank is put before it."""

    def encode(chunks: list[bytes]) -> list[list[int]]:
        # The model puts a blank before each text: a chunk's own blank gives way to it, and before a line end
        # it is a token of its own that is taken off again.
        texts = [x.decode("utf-8", "replace") for x in chunks]
        found = model.encode([x[1:] if x[:1] == " " else x for x in texts], num_threads=1)
        blanks = [i for i, x in enumerate(texts) if x == " "]
        if blanks:
            lone = model.encode("\n", num_threads=1)[:1]
            for i in blanks:
                found[i] = lone
        return [ids[1:] if x[:1] == "\n" else ids for x, ids in zip(texts, found)]

    return Encoder(encode, piece_cuts if fit else lambda data: np.zeros(0, np.int64))


def counts(encoder: Encoder, model, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Tokens of each text of a slice."""
    codes, firsts, starts = encoder.chunks(data, rows)
    n = row_sums(encoder.sizes[codes], firsts)
    # a text that itself begins with a blank or a line end keeps the blank that the model puts before it
    for i in np.flatnonzero(np.diff(rows) > 0):
        if data[rows[i]] in (0x20, 0x0A):
            k = firsts[i]
            end = min(rows[i + 1], starts[k + 1] if k + 1 < len(starts) else rows[i + 1])
            first = bytes(data[rows[i]:end]).decode("utf-8", "replace")
            n[i] += len(model.encode(first, num_threads=1)) - encoder.sizes[codes[k]]
    return n


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, fit = piece_model(model_path)
        encoder = piece_encoder(model, fit)
        for batch in slices(batches):
            data, rows = flat_bytes(batch.column("text"))
            n = counts(encoder, model, data, rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(rows), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run, f"doc_id {key}, n_bytes long, n_tokens long, over_limit boolean")
