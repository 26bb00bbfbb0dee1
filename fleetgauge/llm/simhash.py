"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy keys.

A fingerprint takes the words ``[^\\x20\\x09-\\x0D]+`` of the text, lower-cased in A-Z, and hashes every shingle
of consecutive words; a bit is set when more than half of the shingles set it. Fingerprints link at a small
Hamming distance and components follow the links.

Keys. The 64 bits are split into three segments of at most 23 bits. Of up to three differing bits, two
segments hold at most one each (pigeonhole). Within a segment, the binary Golay code gives every 23-bit word
exactly one codeword within distance 3; a word and its one-bit neighbours decode to one codeword if the word
is nearer than 3 and to six otherwise. So for every pair of segments a fingerprint is filed under its own two
codewords and looked up under all codewords of its neighbourhood: no link can be missed. Candidates are
verified by the whole distance inside the join.

Groups. Equal fingerprints are one row, so copies never meet each other. A fingerprint near the smallest one filed
under the same key first points at it, one link each instead of all pairs. The join then gives no links among
those that point at the same one, and a crowded key is split by AQE as any other.

Null and empty texts, and texts without words, have fingerprint 0 and link like any other; repeated rows fall
into one component; components take the smallest doc_id (NULL if no member has a doc_id); further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import slices, text_or_empty
from fleetgauge.llm.components import cut, labelled

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and bits
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GOLAY = 0b110001110101


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    parts = text.lower().split()
    if not parts:
        return 0
    take = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return take(b" ".join(parts), seed)  # one shingle: its bits are the majority
    shingles = zip(*(parts[i:] for i in range(words)))
    hashes = np.fromiter((take(x, seed) for x in map(b" ".join, shingles)), np.uint64, len(parts) - words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a long, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x.encode(), words) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {key}, fp long")


def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes the error of weight 0 to 3, and the syndromes of the 23 single bits."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    single = np.array([syndrome(1 << i) for i in range(23)], np.int64)
    error = np.zeros(2048, np.int64)
    for i in range(23):
        error[single[i]] = 1 << i
        for j in range(i):
            error[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                error[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return error, single


def codewords(words: np.ndarray, code: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The nearest codeword of each 23-bit word, by the 12 bits that name it."""
    error, single = code
    syndromes = np.zeros(len(words), np.int64)
    for i in range(23):
        syndromes ^= np.where(words >> i & 1, single[i], 0)
    return (words ^ error[syndromes]) >> 11


def neighbours(words: np.ndarray, code: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Codewords of each word and of the 23 words one bit away: a row each, six different ones at most."""
    out = np.stack([codewords(words, code), *(codewords(words ^ (1 << i), code) for i in range(23))], axis=1)
    out.sort(axis=1)
    fresh = np.concatenate([np.ones((len(out), 1), bool), out[:, 1:] != out[:, :-1]], axis=1)
    rank = np.cumsum(fresh, axis=1) - 1
    kept = np.full((len(out), 6), -1, np.int64)
    rows = np.broadcast_to(np.arange(len(out))[:, None], out.shape)
    kept[rows[fresh], rank[fresh]] = out[fresh]
    return kept


def _keys(batches: Iterator[pa.RecordBatch], all_near: bool) -> Iterator[pa.RecordBatch]:
    code = golay()
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            fp = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            segments = [(fp >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
            named = [neighbours(x, code) if all_near else codewords(x, code)[:, None] for x in segments]
            rows, keys = [], []
            for number, (i, j) in enumerate(PAIRS):
                a, b = named[i], named[j]
                key = ((a[:, :, None] << 12 | b[:, None, :]) * 4 + number).reshape(len(fp), -1)
                real = ((a[:, :, None] >= 0) & (b[:, None, :] >= 0)).reshape(len(fp), -1)
                r, c = np.nonzero(real)
                rows.append(r)
                keys.append(key[r, c])
            r = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys), pa.int64()), pa.array(fp.view(np.int64)[r]),
                 part.column("part").take(pa.array(r))], names=["key", "fp", "part"])


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly before each of them becomes many: small inputs would stay in a task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


SCHEMA = "key long, fp long, part long"


def pointers(fps: DataFrame, most: int = 3) -> DataFrame:
    """fp and ``part``, the smallest fingerprint that is near enough and the first filed under a key of its own.

    One pointer a fingerprint, however crowded a place is; without such a neighbour it points at itself."""
    own = fps.select("fp", F.col("fp").alias("part"))
    filed = _spread(own).mapInArrow(functools.partial(_keys, all_near=False), SCHEMA)
    least = filed.groupBy("key").agg(F.min("fp").alias("a"))
    near = filed.select("key", "fp").join(least, "key").where((F.col("fp") > F.col("a")) & (_distance(F.col("fp"), F.col("a")) <= most))
    return near.select("fp", F.col("a").alias("part")).unionByName(own).groupBy("fp").agg(F.min("part").alias("part"))


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``most`` bits that lie in different parts.

    ``fps`` has fp and part; rows of one part count as linked already, through it."""
    if not 0 <= most <= 3:
        raise ValueError("the keys hold for up to three differing bits")
    dealt = _spread(fps.select("fp", "part"))
    filed = dealt.mapInArrow(functools.partial(_keys, all_near=False), SCHEMA).alias("x")
    asked = dealt.mapInArrow(functools.partial(_keys, all_near=True), SCHEMA).alias("y")
    near = asked.join(filed, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") != F.col("y.part"))
                      & (F.col("x.fp") > F.col("y.fp")) & (_distance(F.col("x.fp"), F.col("y.fp")) <= most))
    return near.select(F.col("y.fp").alias("a"), F.col("x.fp").alias("b"))


def near_groups(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fp (16 lowercase hex digits) and component_id, the smallest doc_id reachable, for every row."""
    rows = cut(fingerprints(docs, words))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parted = cut(pointers(fps.select("fp"), most))
    edges = links(parted, most).unionByName(parted.select(F.col("part").alias("a"), F.col("fp").alias("b")))
    labels = labelled(edges)
    whole = fps.join(labels, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    named = whole.select("fp", "component").join(ids, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
