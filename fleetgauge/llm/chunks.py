"""Tokens of whole texts, chunk by chunk.

A text is cut only where the tokenizer itself never joins across, so the tokens of the chunks in order are
the tokens of the text. Distinct chunks of a slice are encoded once; a bounded dictionary keeps them for the
next slices of the task.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

KEEP, KEEP_BYTES = 1 << 19, 64 << 20  # distinct chunks kept by a task, and their bytes


def _either(where: np.ndarray, row_starts: np.ndarray, size: int) -> np.ndarray:
    """Sorted chunk starts: marked bytes and the first byte of each row."""
    mark = np.zeros(size, bool)
    mark[where] = True
    mark[row_starts[row_starts < size]] = True
    return np.flatnonzero(mark)


def _is(values) -> np.ndarray:
    """A table of 256 flags."""
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


#: Bytes that begin a character which is surely no white space.
SOLID = _is([*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)])
GRAPH = _is(range(0x21, 0x7F))
LETTER = _is([*range(0x41, 0x5B), *range(0x61, 0x7B)])
STOPS = b".,;:!?|$%&*#"


def byte_level_cuts(data: np.ndarray, stops: bytes = STOPS) -> np.ndarray:
    """Cuts for byte-level BPE with the usual word pattern: before a blank that a solid character follows
    (a pattern match never runs on into it), on both sides of a single line end between solid characters, and
    between a letter and one of ``stops``."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    solid, graph = SOLID[data], GRAPH[data]
    blank = np.flatnonzero((data[:-1] == 0x20) & solid[1:])
    line = 1 + np.flatnonzero((data[1:-1] == 0x0A) & graph[:-2] & solid[2:])
    stop = 1 + np.flatnonzero(LETTER[data[:-1]] & _is(stops)[data[1:]])
    return np.concatenate([blank, line, line + 1, stop])


def piece_cuts(data: np.ndarray) -> np.ndarray:
    """Cuts for pieces that hold blanks only in front and never a line end: before a run of blanks (not after
    the last byte of the blank sign itself) and before each line end."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    before = data[:-1]
    blank = 1 + np.flatnonzero((data[1:] == 0x20) & (before != 0x20) & (before != 0x81))
    return np.concatenate([blank, np.flatnonzero(data == 0x0A)])


class Encoder:
    """Ids of chunks as numbers into one growing table; encode turns a list of bytes into a list of id lists."""

    def __init__(self, encode, cuts) -> None:
        self.encode, self.cuts = encode, cuts
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.sizes = np.zeros(0, np.int64)
        self.held = 0

    def chunks(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The code of each chunk of the slice, for each row (and the end) the number of its first chunk, and chunk starts."""
        if len(self.known) > KEEP or self.held > KEEP_BYTES:
            self._clear()
        starts = _either(self.cuts(data), rows[:-1], len(data))
        ends = np.append(starts, len(data)).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        coded = array.dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self.known
        fresh = [x for x in words if x not in known]
        if fresh:
            lists = self.encode(fresh)
            base = len(known)
            self.held += sum(map(len, fresh))
            known.update((x, base + i) for i, x in enumerate(fresh))
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, lists), np.int64, len(lists))])
            self.parts.append(np.fromiter((y for x in lists for y in x), np.uint32))
        own = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        codes = own[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(starts) else np.zeros(0, np.int64)
        return codes, np.searchsorted(starts, rows), starts

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the table, and where those of a code begin."""
        self.parts = [np.concatenate(self.parts)] if self.parts else [np.zeros(0, np.uint32)]
        return self.parts[0], np.concatenate([[0], np.cumsum(self.sizes)])


def row_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the values of each row."""
    run = np.concatenate([[0], np.cumsum(values)])
    return run[firsts[1:]] - run[firsts[:-1]]


def byte_encoder(json_path: str, ranks_path: str | None = None) -> Encoder:
    """Ids of the tokenizers library for its byte-level BPE file, without begin or end tokens.

    ``ranks_path`` names the same vocabulary as ranks: if both agree, chunks without an added token's text are
    encoded by the ranks, which gives equal ids in less time."""
    import tokenizers

    model = tokenizers.Tokenizer.from_file(json_path)
    tokens = model.get_added_tokens_decoder().values()
    added = [t.content.encode() for t in tokens]
    inside = set(b"".join(added))
    # an added token is found before any pattern: no cut may fall into one, nor take its surroundings away
    if inside & set(b" \n") or any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokens):
        cuts = lambda data: np.zeros(0, np.int64)
    else:
        cuts = functools.partial(byte_level_cuts, stops=bytes(b for b in STOPS if b not in inside))

    def slowly(chunks: list[bytes]) -> list[list[int]]:
        found = model.encode_batch_fast([x.decode("utf-8", "replace") for x in chunks], add_special_tokens=False)
        return [x.ids for x in found]

    fast = _rank_encoder(model, ranks_path) if ranks_path else None
    if fast is None:
        return Encoder(slowly, cuts)

    def encode(chunks: list[bytes]) -> list[list[int]]:
        out = [fast(x.decode("utf-8", "replace")) for x in chunks]
        odd = [i for i, x in enumerate(chunks) if any(t in x for t in added)]
        for i, ids in zip(odd, slowly([chunks[i] for i in odd])):
            out[i] = ids
        return out

    return Encoder(encode, cuts)


def _rank_encoder(model, ranks_path: str):
    """The encoder of the ranks, or None if they aren't the model's vocabulary."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    # byte-level files spell each byte as one character: lengths by id tell whether the ids are the same
    sizes = {i: len(x) for x, i in model.get_vocab(with_added_tokens=False).items()}
    if any(sizes.get(i) != len(x) for x, i in ranks.items()):
        return None
    return own.encode_ordinary
