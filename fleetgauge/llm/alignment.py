"""Alignment of two tokenizers' tokens over the same bytes.

Each text, with a blank before it, is tokenised whole by a byte-level vocabulary (A) and by a piece vocabulary that
puts that blank there itself (B). The tokens' bytes are joined and compared with the text, so where an A and a B
token both end is known for sure. Such shared ends before a token that begins with the blank mark split a text into
windows, mostly words; a window's alignment depends on its ids alone and is worked out once for each tuple of ids
(a task keeps a bounded number). A group is what lies between shared ends; a link is a pair of tokens that overlap.

How many documents hold a pair linked is counted over the corpus: tasks give the distinct pairs of blocks of
documents with their counts, these are summed by pair, the highest of each A id is found, and every block gets the
totals of its own pairs back. Blocks are written once and hold windows with their number of times, not tokens.
Nothing is broadcast; what a block sends and gets is bounded by its bytes. Long texts are worked off in parts, cut
only where neither tokenizer joins across.

Null and empty texts, and texts whose joined bytes differ from the text (they hold the piece vocabulary's own blank
mark), have no tokens: zeros, and '' for their groups. Repeated rows count each; ids may be of any type, also null;
further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.chunks import GRAPH, SOLID, Encoder, byte_level_cuts, row_sums
from fleetgauge.llm.common import flat_bytes, slices, spread, text_or_empty
from fleetgauge.llm.components import stored
from fleetgauge.llm.token_counts import piece_encoder, piece_model


@dataclasses.dataclass(frozen=True)
class Limits:
    """Of memory, not of results."""

    part: int = 3 << 20  # bytes of text worked off together
    block: int = 4 << 20  # bytes of a block of documents
    docs: int = 1 << 16  # documents of a block
    keep: int = 3 << 16  # windows, and chunks of either tokenizer, that a task keeps


class Vocabulary:
    """The bytes of each id: one array, with offsets and lengths."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread(self.at[ids], self.size[ids])]


def byte_alphabet() -> dict[str, int]:
    """The character by which byte-level vocabularies spell each byte: printable ones stand for themselves, the
    others follow from U+0100 on in their order."""
    out, more = {}, 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[chr(b)] = b
        else:
            out[chr(more)] = b
            more += 1
    return out


def byte_tokens(model) -> list[bytes]:
    """The bytes of each id of a byte-level model; added tokens are their text."""
    alphabet = byte_alphabet()
    plain = model.get_vocab(with_added_tokens=False)
    out = [b""] * (1 + max(model.get_vocab(with_added_tokens=True).values()))
    for token, i in plain.items():
        out[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    for i, t in model.get_added_tokens_decoder().items():
        out[i] = t.content.encode()
    return out


def piece_tokens(model) -> list[bytes]:
    """The bytes of each id of a piece model."""
    def one(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return [one(i) for i in range(model.get_piece_size())]


def plain_byte_encoder(json_path: str, ranks_path: str | None) -> tuple[Encoder, Vocabulary]:
    """Ids of the byte-level file for plain text, where the strings of special tokens are text as any other.

    ``ranks_path`` names the same vocabulary as ranks: if ids, bytes and pattern agree, the ranks encode."""
    import tokenizers

    model = tokenizers.Tokenizer.from_file(json_path)
    model.encode_special_tokens = True
    tokens = byte_tokens(model)

    def slowly(chunks: list[bytes]) -> list[list[int]]:
        return [x.ids for x in model.encode_batch_fast([x.decode("utf-8", "replace") for x in chunks], add_special_tokens=False)]

    fast = _rank_encoder(tokens, slowly, ranks_path) if ranks_path else None
    return Encoder(fast or slowly, byte_level_cuts), Vocabulary(tokens)


#: Text whose splitting tells patterns apart.
PROBE = "It's they'll 3rd  xé中² --a_b\t \n\n c　d I’M 'S <|endoftext|> "


def _rank_encoder(tokens: list[bytes], slowly, path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if any(i >= len(tokens) or tokens[i] != x for x, i in ranks.items()):
        return None
    own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    if own.encode_ordinary(PROBE) != slowly([PROBE.encode()])[0]:
        return None
    return lambda chunks: [own.encode_ordinary(x.decode("utf-8", "replace")) for x in chunks]


class Windows:
    """What a task knows of windows by their tuples of ids: groups as text, counts, linked pairs (a << 32 | b)."""

    def __init__(self, a: Vocabulary, b: Vocabulary) -> None:
        self.a, self.b = a, b
        self.digits = Vocabulary([b"%d," % i for i in range(max(len(a.size), len(b.size)))])
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.text: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.groups = self.links = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def codes(self, windows: pa.Array) -> np.ndarray:
        """The number of each window; new ones are worked out."""
        coded = windows.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        fresh = [k for k in keys if k not in self.known]
        if fresh:
            base = len(self.known)
            self.known.update((k, base + i) for i, k in enumerate(fresh))
            self._learn(fresh)
        own = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        return own[coded.indices.to_numpy(zero_copy_only=False)]

    def _learn(self, keys: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(keys), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, keys), np.int64, len(keys)) // 4
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        n_a = flat[first]
        a, b = flat[spread(first + 1, n_a)], flat[spread(first + 1 + n_a, size - 1 - n_a)]
        a_end, b_end = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        ends = np.union1d(a_end, b_end)  # each stretch between ends lies in one token of either side
        a_at, b_at = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        shared = np.flatnonzero((a_end[a_at] == ends) & (b_end[b_at] == ends))
        # windows end at shared ends
        window = a_end[np.cumsum(n_a) - 1]
        till = np.searchsorted(ends[shared], window) + 1
        self.text += self._texts(a, b, a_at[shared] + 1, b_at[shared] + 1, till)
        self.groups = np.concatenate([self.groups, np.diff(till, prepend=0)])
        self.links = np.concatenate([self.links, np.diff(np.searchsorted(ends, window) + 1, prepend=0)])
        self.pairs = np.concatenate([self.pairs, a[a_at] << 32 | b[b_at]])

    def _texts(self, a: np.ndarray, b: np.ndarray, till_a: np.ndarray, till_b: np.ndarray, till: np.ndarray) -> list[bytes]:
        """The groups of each window as text; groups end before the tokens ``till_a`` and ``till_b``, windows before
        the groups ``till``."""
        n_a, n_b = np.diff(till_a, prepend=0), np.diff(till_b, prepend=0)
        group = np.arange(len(till_a))
        of_a, of_b = np.repeat(group, n_a), np.repeat(group, n_b)
        # tokens in the order of the text: a group's A ids, then its B ids, each with the sign that follows it
        place_a = np.arange(len(a)) + (till_b - n_b)[of_a]
        place_b = np.arange(len(b)) + till_a[of_b]
        ids = np.empty(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        size = self.digits.size[ids]
        end = np.cumsum(size)
        out = self.digits.joined(ids).copy()
        out[end[place_a[till_a - 1]] - 1] = ord("|")
        close = end[place_b[till_b - 1]]
        out[close - 1] = ord(";")
        raw, stops = out.tobytes(), close[till - 1].tolist()
        return [raw[x:y - 1] for x, y in zip([0, *stops[:-1]], stops)]

    def pairs_of(self, codes: np.ndarray) -> np.ndarray:
        at = np.cumsum(self.links) - self.links
        return self.pairs[spread(at[codes], self.links[codes])]


class Aligner:
    """Tokens and windows of texts, each with the blank before it."""

    def __init__(self, json_path: str, ranks_path: str | None, model_path: str) -> None:
        self.encode_a, self.a = plain_byte_encoder(json_path, ranks_path)
        model, fit = piece_model(model_path)
        self.encode_b, self.b = piece_encoder(model, fit), Vocabulary(piece_tokens(model))
        self.windows = Windows(self.a, self.b)

    def forget(self, keep: int) -> None:
        """Starts anew what holds more than ``keep``; windows' numbers are then given again."""
        if len(self.windows.known) > keep:
            self.windows.clear()
        for encoder in (self.encode_a, self.encode_b):
            if len(encoder.known) > keep:
                encoder._clear()

    def _tokens(self, encoder: Encoder, vocabulary: Vocabulary, data: np.ndarray, rows: np.ndarray):
        codes, firsts, _ = encoder.chunks(data, rows)
        table, at = encoder.ids()
        ids = table[spread(at[codes], encoder.sizes[codes])].astype(np.int64)
        n = row_sums(encoder.sizes[codes], firsts)
        size = vocabulary.size[ids]
        told = row_sums(size, np.concatenate([[0], np.cumsum(n)]))
        good = told == np.diff(rows)
        if good.all():
            wrong = np.concatenate([[0], np.cumsum(vocabulary.joined(ids) != data)])
            good = wrong[rows[1:]] == wrong[rows[:-1]]
        return ids, n, np.cumsum(size), good

    def part(self, data: np.ndarray, rows: np.ndarray):
        """For each text n_a and n_b and whether it has tokens; the codes of all windows, and each text's first one."""
        kept = np.flatnonzero(np.diff(rows) > 0)
        own = rows
        while True:  # texts whose tokens are other bytes go, and the others are done once more without them
            a, n_a, a_end, good_a = self._tokens(self.encode_a, self.a, data, own)
            b, n_b, b_end, good_b = self._tokens(self.encode_b, self.b, data, own)
            good = good_a & good_b
            if good.all():
                break
            sizes = np.diff(own)[good]
            data, kept = data[spread(own[:-1][good], sizes)], kept[good]
            own = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(data) + 1, np.uint8)
        mark[a_end] = 1
        mark[b_end] |= 2
        anchor = mark[:-1] == 3
        anchor[own[:-1]] = True
        starts = np.flatnonzero(anchor & (data == 0x20))
        first_a, first_b = np.searchsorted(a_end, starts, side="right"), np.searchsorted(b_end, starts, side="right")
        in_a, in_b = np.diff(first_a, append=len(a)), np.diff(first_b, append=len(b))
        at = np.concatenate([[0], np.cumsum(1 + in_a + in_b)])
        flat = np.empty(at[-1], np.uint32)
        flat[at[:-1]] = in_a
        flat[spread(at[:-1] + 1, in_a)] = a
        flat[spread(at[:-1] + 1 + in_a, in_b)] = b
        keys = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(4 * at), pa.py_buffer(flat)])
        counts = np.zeros((3, len(rows) - 1), np.int64)
        counts[0, kept], counts[1, kept], counts[2, kept] = n_a, n_b, np.diff(np.searchsorted(starts, own))
        has = np.zeros(len(rows) - 1, bool)
        has[kept] = True
        return counts[0], counts[1], has, self.windows.codes(keys), np.concatenate([[0], np.cumsum(counts[2])])


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from zero in the least of one, two, four or eight bytes; the first byte of all tells which."""
    most = int(values.max()) if len(values) else 0
    kind = next(k for k in (1, 2, 4, 8) if most < 1 << (8 * k))
    return bytes([kind]) + values.astype(f"u{kind}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def spaced(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank before each."""
    own = rows + np.arange(len(rows))
    out = np.full(own[-1], 0x20, np.uint8)
    out[spread(own[:-1] + 1, np.diff(rows))] = data
    return out, own


def parts_of(data: np.ndarray, rows: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All texts at once, or a long one in parts of about ``most`` bytes, cut before a blank between a printable ASCII
    sign and a character that is no white space."""
    if len(data) <= 2 * most or len(rows) > 2:
        yield data, rows
        return
    start = 0
    while start < len(data):
        end = start + most
        while True:
            look = data[end:end + 65536 + 2]
            if len(look) < 3:
                end = len(data)
                break
            fit = np.flatnonzero(GRAPH[look[:-2]] & (look[1:-1] == 0x20) & SOLID[look[2:]])
            if len(fit):
                end += 1 + int(fit[0])
                break
            end += 65536
        yield data[start:end], np.array([0, end - start])
        start = end


def _block_type(key: str) -> str:
    return (f"block long, doc_id array<{key}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<binary>, "
            "held binary, windows binary, times binary, links binary, linked binary, pairs array<long>, docs array<long>")


class Block:
    """Documents collected for one row of the block table."""

    def __init__(self, windows: Windows) -> None:
        self.windows, self.size = windows, 0
        self.ids: list = []
        self.counts: list[tuple] = []
        self.groups: list[bytes] = []
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, docs: np.ndarray, codes: np.ndarray) -> None:
        """Windows of documents, those that occur more than once in a document with their number of times."""
        value, times = np.unique(docs << 32 | codes, return_counts=True)
        self.entries.append((value >> 32, value & 0xFFFFFFFF, times))

    def record(self, seq: int, names: list[str], key: pa.DataType) -> pa.RecordBatch:
        empty = np.zeros(0, np.int64)
        docs, codes, times = (np.concatenate(x) for x in zip(*self.entries)) if self.entries else (empty, empty, empty)
        value, back = np.unique(docs << 32 | codes, return_inverse=True)  # parts of a long text have windows in common
        times = np.bincount(back, times, len(value)).astype(np.int64)
        docs, codes = value >> 32, value & 0xFFFFFFFF
        used, window = np.unique(codes, return_inverse=True)
        links = self.windows.links[used]
        pairs, linked = np.unique(self.windows.pairs_of(used), return_inverse=True)
        at = np.cumsum(links) - links
        # each document counts once for a pair, whatever its windows
        both = distinct(np.repeat(docs, links[window]) << 32 | linked[spread(at[window], links[window])])
        seen = np.bincount(both & 0xFFFFFFFF, minlength=len(pairs))
        held = np.bincount(docs, minlength=len(self.ids))
        n_a, n_b, n_groups, n_links = zip(*self.counts)
        ints = [packed(x) for x in (held, window, times, links, linked)]
        values = [(TaskContext.get().partitionId() << 32) + seq, self.ids, n_a, n_b, n_groups, n_links, self.groups, *ints, pairs, seen]
        long, many, raw = pa.int64(), pa.list_(pa.int64()), pa.binary()
        kinds = [long, pa.list_(key), many, many, many, many, pa.list_(raw), raw, raw, raw, raw, raw, many, many]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)


def _blocks(paths: tuple, names: list[str], with_text: bool, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*paths)
        windows, seq, key = aligner.windows, 0, None
        block = Block(windows)
        for batch in slices(batches, most=limits.part):
            key = batch.column("doc_id").type
            data, rows = flat_bytes(batch.column("text"))
            _collect(block, aligner, batch.column("doc_id").to_pylist(), data, rows, with_text, limits.part)
            if block.size >= limits.block or len(block.ids) >= limits.docs or len(windows.known) > limits.keep:
                yield block.record(seq, names, key)
                block, seq = Block(windows), seq + 1
                aligner.forget(limits.keep)
        if block.ids:
            yield block.record(seq, names, key)

    return run


def _collect(block: Block, aligner: Aligner, ids: list, data: np.ndarray, rows: np.ndarray, with_text: bool, most: int) -> None:
    """One slice of texts: many short ones, or a long one in parts."""
    windows, base = aligner.windows, len(block.ids)
    some = np.flatnonzero(np.diff(rows) > 0)
    own = np.concatenate([[0], np.cumsum(np.diff(rows)[some])])
    total = np.zeros((4, len(ids)), np.int64)
    digest = [hashlib.sha256() for _ in ids] if not with_text else None
    text: list[list[bytes]] = [[] for _ in ids]
    broken = np.zeros(len(ids), bool)
    entries = []
    for part, at in parts_of(*spaced(data, own), most) if len(some) else ():
        n_a, n_b, has, codes, firsts = aligner.part(part, at)
        broken[some[~has]] = True
        total[:, some] += [n_a, n_b, row_sums(windows.groups[codes], firsts), row_sums(windows.links[codes], firsts)]
        entries.append((np.repeat(some + base, np.diff(firsts)), codes))
        for i, x, y in zip(some.tolist(), firsts[:-1].tolist(), firsts[1:].tolist()):
            piece = b";".join(map(windows.text.__getitem__, codes[x:y].tolist()))
            if with_text:
                text[i].append(piece)
            else:
                digest[i].update(b";" + piece if text[i] else piece)
                text[i] = [b""]
    total[:, broken] = 0
    bad = np.flatnonzero(broken) + base
    for docs, codes in entries:
        if len(bad):
            keep = ~np.isin(docs, bad)
            docs, codes = docs[keep], codes[keep]
        block.add(docs, codes)
    block.ids += ids
    block.counts += list(map(tuple, total.T.tolist()))
    for i in range(len(ids)):
        none = broken[i] or not text[i]
        block.groups.append(b"" if none else b";".join(text[i]) if with_text else digest[i].hexdigest().encode())
    block.size += len(data)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of blocks with the sums of their links' totals."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = {n: batch.column(n)[i] for n in batch.schema.names}
            held, window, times, links, linked = (unpacked(one[n].as_py()) for n in ("held", "windows", "times", "links", "linked"))
            totals = one["totals"].values
            count, best = (np.zeros(len(totals), np.int64) for _ in range(2))
            place = totals.field("place").to_numpy()
            count[place] = totals.field("n").to_numpy()
            best[place] = totals.field("best").to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(links)])
            rows = np.concatenate([[0], np.cumsum(held)])
            sums = [row_sums(times * row_sums(x[linked], at)[window], rows) for x in (best, count)]
            own = [one[n].values for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(sums[0]), pa.array(sums[1]), one["groups"].values.cast(pa.string())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


class Alignment:
    """``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups. ``pairs``: pair (a << 32 | b), n
    (documents that hold it linked), best (no other B id of its A id is in more)."""

    def __init__(self, documents: DataFrame, pairs: DataFrame) -> None:
        self.documents, self.pairs = documents, pairs


def align(docs: DataFrame, json_path: str, ranks_path: str | None, model_path: str, with_text: bool = False,
          limits: Limits = Limits()) -> Alignment:
    """The alignment of all texts of ``docs``; ``groups`` is the groups' text, or its sha256 unless ``with_text``."""
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = _block_type(key)
    plain = docs.select("doc_id", text_or_empty().alias("text"))
    names = [f.split(" ")[0] for f in schema.split(", ")]
    blocks = stored(plain.mapInArrow(_blocks((json_path, ranks_path, model_path), names, with_text, limits), schema), "alignment-blocks")
    seen = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = seen.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    pairs = stored(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "alignment-pairs")
    home = seen.select("block", "place", "pair").join(pairs, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("totals"))
    kind = "array<struct<place:int,n:bigint,best:boolean>>"
    back = blocks.drop("pairs", "docs").join(home, "block", "left").withColumn("totals", F.coalesce("totals", F.array().cast(kind)))
    out = f"doc_id {key}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return Alignment(back.mapInArrow(_sums, out), pairs)
