"""Plain, slow versions of the document operators."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, most=3):
    """{row number: smallest doc_id reachable} of [(doc_id, fingerprint)]."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= most:
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return [best.get(find(i)) for i in range(len(rows))]


def substring_rows(texts, least=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i:i + least]] > 1:
                gone[i:i + least] = b"\x01" * least
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def quality(text):
    text = text or ""
    w = words(text)
    dup, seen = 0, set()
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def bench_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(texts, items, window=13):
    pats = {}
    for name, text in items:
        w = bench_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            pats.setdefault(tuple(w[i:i + n]), set()).add(str(name))
    sizes = {len(p) for p in pats}
    out = []
    for t in texts:
        w, hit, own = bench_words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if x := pats.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    own |= x
        out.append((len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def turns(rows):
    """n_turns, digest, loss_chars, digest of [(turn, role, text)]."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    whole = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)
    learned = "".join(t or "" for _, r, t in rows if r == "assistant")
    return (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


def check_packing(pieces, ids_of, size=1024):
    """pieces: (doc_id, start, length, crc, doc_tokens, sequence_id, offset); ids_of: doc_id -> ids with the end id."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_seq.setdefault(p[5], []).append(p)
    assert set(by_doc) == set(ids_of)
    for d, ps in by_doc.items():
        ids, at = ids_of[d], 0
        for p in sorted(ps, key=lambda p: p[1]):
            assert p[1] == at and p[4] == len(ids) and p[2] > 0
            raw = b"".join(int(x).to_bytes(4, "little") for x in ids[at:at + p[2]])
            assert zlib.crc32(raw) == p[3]
            at += p[2]
        assert at == len(ids)
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at <= size
    full = sum(1 for ps in by_seq.values() if sum(p[2] for p in ps) == size)
    assert full >= len(by_seq) - 1
