"""Removal of long byte strings that occur more than once, by a difference-cover suffix sort.

A byte goes if a string of ``least`` bytes that covers it also starts anywhere else, in the same or another
text. Strings are judged on the input.

1. Anchors. The windows of ``least`` bytes of a text are dealt to anchors: a window's anchor is the place among
   its first ``least - GRAM + 1`` bytes where a hash of the next eight bytes is least (the leftmost of equals),
   so equal windows have their anchors at the same place inside them. Consecutive windows of one anchor form a
   run; equal windows have equal GRAM bytes at their anchor. A GRAM seen once cannot be part of a repeat:
   counting its hash (aggregated before the shuffle) leaves few runs, and loses none.
2. Copies. Runs that are equal as a whole become one row with a count: a group of copies costs one string.
3. Suffix sort. The distinct runs, dealt by GRAM, are put into texts of bounded size and their suffixes sorted
   by the difference cover modulo 3: sort the sampled triples, name them, recurse on the names while they
   repeat, sort the rest by byte and following rank, merge. Adjacent prefixes of ``least`` bytes are compared:
   equal ones are repeats, as is any prefix of a run that stands for several copies.
4. A GRAM with more distinct runs than a task should hold is split by longer GRAMs: windows whose anchors lie
   at about the same place in them share more bytes. Blocks of places get narrower until no GRAM is crowded.
5. What was found is joined back to all runs and cut out of the texts.

No step gathers a GRAM, a group of copies or a source in one task. Shuffles: GRAM hashes, runs (places, not
text), the distinct strings, and the texts once.

Null and empty texts lose nothing; texts shorter than ``least`` never do; repeated rows are copies of each
other; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import flat_bytes, offsets, slices, spread, text_or_empty
from fleetgauge.llm.components import stored

GRAM = 100  # bytes that windows of one anchor share
SORT_BYTES = 1 << 20  # bytes of one suffix sort; names of three levels fit 63 bits
GROUP_RUNS = 2000  # distinct runs of a GRAM sorted in one task
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _letters() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


LETTERS = _letters()


class Prefixes:
    """Hashes of any stretch of a byte array, from running sums modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        with np.errstate(over="ignore"):
            self.power = np.ones(n + 1, np.uint64)
            np.multiply.accumulate(np.full(n, BASE), out=self.power[1:])
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(LETTERS[data] * self.power[:-1], out=self.sums[1:])
            self.top = n

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal stretches have equal values wherever they stand in this or any array (after ``of`` scales
        each to the same power)."""
        with np.errstate(over="ignore"):
            x = (self.sums[end] - self.sums[start]) * inverse_power(start)
            x ^= x >> np.uint64(31)
            x *= MIX
            return x ^ (x >> np.uint64(29))


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_low = np.ones(1 << 12, np.uint64)
_high = np.ones(1 << 19, np.uint64)
with np.errstate(over="ignore"):
    np.multiply.accumulate(np.full(len(_low) - 1, INVERSE), out=_low[1:])
    np.multiply.accumulate(np.full(len(_high) - 1, np.uint64(pow(int(INVERSE), 1 << 12, 1 << 64))), out=_high[1:])


def inverse_power(i: np.ndarray) -> np.ndarray:
    """BASE to the power of -i, modulo 2**64 (i below 2**31)."""
    with np.errstate(over="ignore"):
        return _low[i & 0xFFF] * _high[i >> 12]


def runs(data: np.ndarray, rows: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first and last window start and anchor of every run, as places in ``data``."""
    none = (np.zeros(0, np.int64),) * 4
    windows = len(data) - least + 1
    if windows <= 0:
        return none
    wide = least - gram + 1
    with np.errstate(over="ignore"):
        grams = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)) * MIX
    grams ^= grams >> np.uint64(32)
    with np.errstate(over="ignore"):
        grams *= BASE
    # the place in the low half: the least value is the leftmost of equal hashes
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= wide:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if wide > size:
        key = np.minimum(key[:size - wide], key[wide - size:])
    anchor = (key[:windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    length = np.diff(rows)
    fit = np.flatnonzero(length >= least)
    if not len(fit):
        return none
    mine = spread(rows[fit], length[fit] - least + 1)  # windows that don't cross texts
    owner = np.repeat(fit, length[fit] - least + 1)
    a = anchor[mine]
    new = np.ones(len(mine), bool)
    new[1:] = (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(mine)) - 1
    return owner[at], mine[at], mine[last], a[at]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` (numbers from 0 up) in order, by the difference cover modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = s.astype(np.int64) + 1  # 0 stands for the end
    t = np.concatenate([s, np.zeros(3, np.int64)])
    bits = int(t.max()).bit_length()
    ones = np.arange(1, n + (n % 3 == 1), 3)  # with one place past the end, so that the two parts don't touch
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    t = np.concatenate([t, np.zeros(1, np.int64)])
    triple = (t[sample] << (2 * bits)) | (t[sample + 1] << bits) | t[sample + 2]
    order = np.argsort(triple, kind="stable")
    sorted_triples = triple[order]
    name = np.empty(len(sample), np.int64)
    step = np.concatenate([[0], np.cumsum(sorted_triples[1:] != sorted_triples[:-1])])
    name[order] = step
    if step[-1] + 1 < len(sample):
        order = suffix_array(name)
    sample_sorted = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sample_sorted] = np.arange(1, len(sample) + 1)
    sample_sorted = sample_sorted[sample_sorted < n]
    rb = int(len(sample) + 1).bit_length()
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort((t[rest] << rb) | rank[rest + 1], kind="stable")]
    # merge: against places of rest 1 by (symbol, rank), of rest 2 by (two symbols, rank)
    kind = sample_sorted % 3
    s1, s2 = sample_sorted[kind == 1], sample_sorted[kind == 2]
    k1 = (t[s1] << rb) | rank[s1 + 1]
    k2 = (((t[s2] << bits) | t[s2 + 1]) << rb) | rank[s2 + 2]
    before = np.searchsorted(k1, (t[rest] << rb) | rank[rest + 1])
    before = before + np.searchsorted(k2, (((t[rest] << bits) | t[rest + 1]) << rb) | rank[rest + 2])
    place = before + np.arange(len(rest))
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = rest
    out[~taken] = sample_sorted
    return out


def repeated_starts(strings: list[bytes], copies: np.ndarray, least: int) -> list[np.ndarray]:
    """For each string (a run), the window starts in it that are repeats: by copies of the run, or because
    an adjacent suffix has the same first ``least`` bytes."""
    size = np.array([len(x) for x in strings], np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)  # 255 is no byte of UTF-8
    starts = size - least + 1
    mine = spread(first, starts)
    owner = np.repeat(np.arange(len(strings)), starts)
    slot = np.full(len(text), -1, np.int64)
    slot[mine] = np.arange(len(mine))
    order = slot[suffix_array(text)]
    order = order[order >= 0]
    at = mine[order]
    same = np.ones(max(0, len(at) - 1), bool)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text),), "<u8", padded, strides=(1,))
    live = np.arange(len(same))
    for k in [*range(0, least - 7, 8), least - 8]:
        equal = words[at[live] + k] == words[at[live + 1] + k]
        same[live[~equal]] = False
        live = live[equal]
    hit = np.zeros(len(mine), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    hit |= copies[owner] > 1
    edges = np.concatenate([[0], np.cumsum(starts)])
    return [np.flatnonzero(hit[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def ranges(starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Window starts as joined byte ranges."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > least)
    a = starts[np.concatenate([[0], gap + 1])]
    b = starts[np.concatenate([gap, [len(starts) - 1]])] + least
    return list(zip(a.tolist(), b.tolist()))


def _runs(rows: DataFrame, least: int, gram: int, with_place: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            data, at = flat_bytes(batch.column("text"))
            owner, a, b, p = runs(data, at, least, gram)
            sums = Prefixes(data)
            h = sums.of(p, p + gram).view(np.int64)
            if not with_place:
                value, count = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count.astype(np.int64))], names=["h", "n"])
                continue
            with np.errstate(over="ignore"):
                whole = (sums.of(a, b + least) * BASE + (p - a).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(whole), batch.column("key").take(pa.array(owner)), pa.array((a - at[owner]).astype(np.int64)),
                 pa.array((b - a).astype(np.int32))], names=["h", "run", "key", "first", "more"])

    schema = "h long, run long, key long, first long, more int" if with_place else "h long, n long"
    return rows.select("key", "text").mapInArrow(run, schema)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in order of h as batches that end with a group, with the first row of each group (and the end)."""
    rest = None
    for batch in batches:
        if batch.num_rows:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            h = batch.column("h").to_numpy()
            edges = np.concatenate([[0], 1 + np.flatnonzero(h[1:] != h[:-1]), [len(h)]])
            rest = batch.slice(edges[-2])  # may go on
            if edges[-2]:
                yield batch.slice(0, edges[-2]), edges[:-1]
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def _sorted(strings: DataFrame, least: int) -> DataFrame:
    """Repeats inside distinct runs (h, run, n, s): h, run, start, end.

    A run that is alone in its group needs no sort: equal windows have their anchor at the same place in them, so two
    in one run would begin at the same byte; it repeats whole if it has copies, else not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def told(part: pa.Table | pa.RecordBatch, rows, start, end) -> pa.RecordBatch:
            own = part.select(["h", "run"]).take(pa.array(rows, pa.int64()))
            columns = [own.column(c) for c in ("h", "run")]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            return pa.RecordBatch.from_arrays([*columns, pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["h", "run", "start", "end"])

        def done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            found = repeated_starts(whole.column("s").to_pylist(), whole.column("n").to_numpy(), least)
            out = [(i, a, b) for i, x in enumerate(found) for a, b in ranges(x, least)]
            return told(whole, *np.ascontiguousarray(np.array(out, np.int64).reshape(-1, 3).T))

        for batch, edges in _whole_groups(batches):
            count = np.diff(edges)
            alone = edges[:-1][count == 1]
            copied = alone[batch.column("n").to_numpy()[alone] > 1]
            if len(copied):
                length = np.diff(offsets(batch.column("s")))[copied]
                yield told(batch, copied, np.zeros(len(copied), np.int64), length)
            for a, b in zip(edges[:-1][count > 1], edges[1:][count > 1]):
                if size > SORT_BYTES:  # only between groups
                    yield done()
                    held, size = [], 0
                part = batch.slice(a, b - a)
                held.append(part)
                at = offsets(part.column("s"))
                size += int(at[-1] - at[0])
        if held:
            yield done()

    return strings.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, run long, start long, end long")


def _split(strings: DataFrame, least: int, gram: int, block: int) -> DataFrame:
    """Runs of crowded GRAMs in shorter runs under longer GRAMs: windows whose anchors lie in one block of
    ``block`` places behind their starts share all bytes from the block's last start on to its first end.
    Gives the shorter run (h2, run2, n, s2) and where it lies in the run it comes from (h, run, shift)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "s", most=1 << 20):
            data, at = flat_bytes(batch.column("s"))
            _, first, last, p = runs(data, at, least, gram)  # one run a string: it has one anchor
            owner, far = [], []
            for i, (x, y) in enumerate(zip((p - last).tolist(), (p - first).tolist())):
                for b in range(x // block, y // block + 1):
                    owner.append(i)
                    far.append(b)
            owner, low = np.array(owner, np.int64), np.array(far, np.int64) * block
            p, begin = p[owner], first[owner]
            a = p - np.minimum(p - begin, low + block - 1)
            b = p - np.maximum(p - last[owner], low)
            sums = Prefixes(data)
            with np.errstate(over="ignore"):
                h2 = sums.of(p - low, p - low - (block - 1) + least) * BASE + low.astype(np.uint64)
                run2 = sums.of(a, b + least) * BASE + (p - a).astype(np.uint64)
            raw = data.tobytes()
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h2.view(np.int64)), pa.array(run2.view(np.int64)), batch.column("n").take(take),
                 pa.array([raw[x:y] for x, y in zip(a.tolist(), (b + least).tolist())], pa.binary()),
                 batch.column("h").take(take), batch.column("run").take(take), pa.array(a - begin)],
                names=["h2", "run2", "n", "s2", "h", "run", "shift"])

    return strings.select("h", "run", "n", "s").mapInArrow(run, "h2 long, run2 long, n long, s2 binary, h long, run long, shift long")


def _repeated(strings: DataFrame, least: int, gram: int) -> DataFrame:
    """Repeats inside distinct runs (h, run, n, s), crowded GRAMs split until none is too large for a task.

    At blocks of one place the shared bytes are the whole window, so a GRAM has a single run."""
    result, back = None, []
    for block in (32, 8, 2, 1, 0):
        crowded = stored(strings.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > GROUP_RUNS).select("h"), "crowded")
        some = block > 0 and not crowded.limit(1).isEmpty()
        found = _sorted(strings.join(crowded, "h", "left_anti").select("h", "run", "n", "s") if some else strings, least)
        for link in reversed(back):
            found = link.join(found.withColumnsRenamed({"h": "h2", "run": "run2"}), ["h2", "run2"]).select(
                "h", "run", (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end"))
        result = found if result is None else result.unionByName(found)
        if not some:
            return result
        parts = stored(_split(strings.join(crowded, "h", "left_semi"), least, gram, block), "split")
        back.append(parts.select("h2", "run2", "h", "run", "shift"))
        strings = stored(parts.groupBy(F.col("h2").alias("h"), F.col("run2").alias("run")).agg(
            F.sum("n").alias("n"), F.first("s2").alias("s")), "strings")
    return result


def repeats(docs: DataFrame, least: int = 200) -> tuple[DataFrame, str]:
    """Every row of ``docs`` (doc_id, text) with ``cuts``, byte ranges that repeat; and the type of doc_id."""
    gram = min(GRAM, least // 2)
    if gram < 8:
        raise ValueError("strings of at least 16 bytes")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    long = rows.where(F.octet_length("text") >= least)
    often = stored(_runs(long, least, gram, False).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "grams")
    found = _runs(long, least, gram, True).join(often, "h", "left_semi")
    found = stored(found, "runs")
    groups = found.groupBy("h", "run").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "more")).alias("at"))
    groups = stored(groups.select("h", "run", "n", "at.*"), "groups")
    # equal rows share their key and their bytes; a string that comes twice then stands for copies anyway
    places = groups.groupBy("key").agg(F.collect_list(F.struct("h", "run", "n", "first", "more")).alias("at"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            out: dict[str, list] = {c: [] for c in ("h", "run", "n", "s")}
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist()):
                raw = text.encode()
                for x in at:
                    out["s"].append(raw[x["first"]:x["first"] + x["more"] + least])
                    for c in ("h", "run", "n"):
                        out[c].append(x[c])
                if len(out["s"]) > 8192:
                    yield _strings(out)
                    out = {c: [] for c in out}
            yield _strings(out)

    strings = stored(rows.join(places, "key").select("text", "at").mapInArrow(cut_out, "h long, run long, n long, s binary"), "strings")
    result = _repeated(strings, least, gram)
    spans = found.join(result, ["h", "run"]).select(
        "key", (F.col("first") + F.col("start")).alias("a"), (F.col("first") + F.col("end")).alias("b"))
    cuts = spans.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("cuts"))
    return rows.join(cuts, "key", "left").select("doc_id", "text", "cuts"), kind


def _strings(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(out["h"], pa.int64()), pa.array(out["run"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["s"], pa.binary())],
        names=["h", "run", "n", "s"])


def remove_repeats(docs: DataFrame, least: int = 200, as_text: bool = False) -> DataFrame:
    """doc_id, ``kept`` (the bytes left), n_bytes, n_removed and n_spans (maximal removed runs) for every row.

    ``as_text`` gives ``kept`` as a string, without the loose bytes of characters that a cut falls into."""
    rows, kind = repeats(docs, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, sizes, gone, spans = [], [], [], []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                raw, left, end, n = text.encode(), [], 0, 0
                for a, b in sorted((x["a"], x["b"]) for x in cuts or ()):
                    if a > end or not n:
                        left.append(raw[end:a])
                        n += 1
                    end = max(end, b)
                left.append(raw[end:])
                out = b"".join(left)
                kept.append(out.decode("utf-8", "ignore") if as_text else out)
                sizes.append(len(raw))
                gone.append(len(raw) - len(out))
                spans.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.string() if as_text else pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans))],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    left = "string" if as_text else "binary"
    return rows.mapInArrow(run, f"doc_id {kind}, kept {left}, n_bytes long, n_removed long, n_spans long")
