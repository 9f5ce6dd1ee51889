"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``WIDTH`` bytes covers it that also starts earlier (smaller doc_id, or same
document and earlier start).  Strings never cross documents.

Which suffixes are sorted.  All suffixes of a corpus, front-coded or not, take many times its size, so
the sort runs on a sparse set that no repeat can miss.  Every window of WIDTH bytes names as its anchor
the k-gram in it of smallest hash, the leftmost such.  Equal windows have equal anchors at equal
offsets, so each window is judged at its anchor, and anchors are a thirtieth of all positions.  A first,
thin exchange of k-gram hashes finds the anchors that occur twice; suffixes start at those.

The sort.  A chunk of documents sorts the suffixes at its anchors, drops copies within the chunk (which
are repeats for certain), and sends a front-coded run (common prefix with the one before, rest) to each
bucket of k-grams.  A bucket merges its runs with a loser tree whose nodes remember the common prefix with
the last winner: a suffix with the longer one wins unread, and only equal ones are compared, from there
on.  Suffixes of one anchor then stand together with what is to their left, and all windows at the same
offset are compared, hash first and bytes after.

Hot anchors.  A line shorter than a window that very many documents share gives as many different
suffixes, and almost no repeat.  Chunks mark anchors with ``MANY`` different surroundings, and the windows of anchors
whose marks add up to ``HOT`` are dealt out one by one: a window is a suffix of its own, filed under its hash
instead of its anchor's.  Such windows spread evenly, and go through the same sorted runs, loser trees and comparison
of bytes as all others, so the marks decide where a window is judged and never how.

Repetitive texts.  A window that equals the one up to ``PERIOD`` bytes before it is a repeat for certain, and is
marked at once; so anchors are never dense, whatever the text.

Null texts are empty.  Null ids count as the largest.  Of rows with equal ids the one read first counts as
the earlier.  Extra columns are not read.  Long texts are worked through in slices; a chunk holds at least
one whole text.
"""

from __future__ import annotations

import math
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, bytes_of, cut, mixed, new_path, open_fs, spread, table

WIDTH, GRAM, CHUNK_BYTES, SLICE, ANCHORS_IN_BUCKET, WINDOWS, MANY, HOT = 100, 36, 8_000_000, 1 << 20, 100_000, 1_000_000, 8, 512
PERIOD, COMPARED = 8, 1 << 15
NO_ID = (1 << 63) - 1
_B = 0x9E3779B97F4A7C15
EVEN = U64(2**64 - 2)  # the lowest bit of a hash carries a mark


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), U64)
    out[0] = 1
    return np.multiply.accumulate(out)


# -- the store of documents


def store(docs: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """Writes chunk files and returns their manifest (chunk, path in the folder, bytes)."""

    def run(batches):
        part, seq, held, size, done = TaskContext.get().partitionId(), 0, [], 0, []

        def put():
            name = uuid.uuid4().hex
            fs, path = open_fs(f"{folder}/{name}.arrow")
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as f, pa.ipc.new_stream(f, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
                for b in held:
                    w.write_batch(b)
            done.append(((part << 24) + seq, name, size))

        for b in batches:
            b = pa.RecordBatch.from_arrays([b.column(0).fill_null(NO_ID), b.column(1).fill_null("").cast(pa.binary())], names=["doc_id", "text"])
            at, offsets = 0, bytes_of(b.column(1))[1]
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES - size, "right")) - 1)
                held.append(b.slice(at, to - at))
                size += int(offsets[to] - offsets[at])
                at = to
                if size >= CHUNK_BYTES - 1 or at < b.num_rows:
                    put()
                    held, size, seq = [], 0, seq + 1
        if held:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], names=["chunk", "path", "bytes"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "chunk bigint, path string, bytes bigint")
    return cut(rows, "suffix-manifest")


class Chunk:
    """The documents of one chunk file."""

    def __init__(self, folder: str, name: str) -> None:
        fs, path = open_fs(f"{folder}/{name}.arrow")
        with fs.open_input_stream(path) as f, pa.ipc.open_stream(f) as r:
            t = r.read_all().combine_chunks()
        self.ids = t["doc_id"].to_numpy()
        text = t["text"].combine_chunks() if t.num_rows else pa.array([], pa.binary())
        self.data, self.offsets = bytes_of(text)


# -- anchors


def periodic(data: np.ndarray, end: np.ndarray, at: int, starts: int) -> np.ndarray:
    """Which of the windows at at, at + 1, ... equal the one up to PERIOD bytes before them in their document."""
    out, to = np.zeros(starts, bool), at + starts + WIDTH - 1
    for d in range(1, PERIOD + 1):
        lo = max(at, d)
        # A window holds two whole strides of 32 bytes, whose first 8 show at a thirtieth of the cost if there can be any.
        n = (to - lo) // 32
        x, y = (np.lib.stride_tricks.as_strided(data[k:].view(np.uint8), (n, 8), (32, 1)).copy().view(U64)[:, 0] for k in (lo, lo - d)) if n else (np.empty(0, U64),) * 2
        hit = x == y
        if not (hit[1:] & hit[:-1]).any():
            continue
        run = np.zeros(to - lo + 1, np.int32)
        # The byte d before must lie in the same document.
        np.cumsum((data[lo:to] == data[lo - d : to - d]) & (end[lo:to] == end[lo - d : to - d]), out=run[1:])
        out[lo - at :] |= (run[WIDTH:] - run[:-WIDTH] == WIDTH)[: starts - (lo - at)]
    return out


def anchors(data: np.ndarray, offsets: np.ndarray):
    """For every run of windows that share an anchor: place of the anchor, first and last start of a
    window, the k-gram's (even) hash, a hash of all bytes of the windows, and the row of the document.  Last
    the (row, from, to) spans of windows that repeat the one just before them, which have no part in the rest."""
    n, span = len(data), WIDTH - GRAM + 1
    some = min(n, SLICE + 2 * WIDTH)
    power, back = _powers(_B, some + 1), _powers(pow(_B, -1, 2**64), some + 1)
    end = np.repeat(offsets[1:], np.diff(offsets))
    out, sure = [], [np.empty((0, 3), np.int64)]
    for at in range(0, max(n - WIDTH + 1, 0), SLICE):
        starts = min(SLICE, n - WIDTH + 1 - at)
        x = data[at : at + starts + WIDTH - 1].astype(U64)
        sums = np.zeros(len(x) + 1, U64)
        np.cumsum(x * power[: len(x)], out=sums[1:])
        grams = len(x) - GRAM + 1
        h = mixed((sums[GRAM:] - sums[:grams]) * back[:grams])
        key = (h >> U64(31) << U64(31)) | np.arange(grams, dtype=U64)
        full = np.full(-(-grams // span) * span, np.iinfo(np.uint64).max, U64)
        full[:grams] = key
        blocks = full.reshape(-1, span)
        before = np.minimum.accumulate(blocks, 1).reshape(-1)
        after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
        least = np.minimum(after[:starts], before[span - 1 : span - 1 + starts])
        p = (least & U64((1 << 31) - 1)).astype(np.int64)
        inside = np.arange(at, at + starts) + WIDTH <= end[at : at + starts]
        again = periodic(data, end, at, starts) & inside
        if again.any():
            k = np.flatnonzero(again) + at
            row = np.searchsorted(offsets, k, "right") - 1
            sure.append(window_spans(row, k - offsets[row]))
        s = np.flatnonzero(inside & ~again)
        if len(s):
            first = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 1) | (np.diff(p[s]) != 0)]))
            last = np.append(first[1:] - 1, len(s) - 1)
            whole = mixed((sums[s[last] + WIDTH] - sums[s[first]]) * back[s[first]])
            out.append((p[s[first]] + at, s[first] + at, s[last] + at, h[p[s[first]]] & EVEN, whole))
    if not out:
        z = np.empty(0, np.int64)
        return z, z, z, z.astype(U64), z.astype(U64), z, np.concatenate(sure)
    p, lo, hi, h, whole = (np.concatenate(c) for c in zip(*out, strict=True))
    return p, lo, hi, h, whole, np.searchsorted(offsets, lo, "right") - 1, np.concatenate(sure)


def bucket_of(h: np.ndarray, depth: int) -> np.ndarray:
    """The bucket of a k-gram.  Anchors have small hashes, being the smallest near by, so hashes are mixed
    once more to fill buckets evenly."""
    return (mixed(h & EVEN) >> U64(64 - depth)).astype(np.int64)


def marked(h: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The distinct hashes in order, odd where they have MANY different surroundings."""
    order = np.lexsort((whole, h))
    h, whole = h[order], whole[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    other = np.concatenate([[True], (h[1:] != h[:-1]) | (whole[1:] != whole[:-1])]) if len(h) else np.empty(0, bool)
    kinds = np.add.reduceat(other.astype(np.int64), first) if len(h) else np.empty(0, np.int64)
    return h[first] | (kinds >= MANY).astype(U64)


def pack(lcp, right, left, doc, row, place, rest: np.ndarray, before: np.ndarray) -> bytes:
    """A run as one byte string: numbers of suffixes, of bytes to the right and to the left, and the columns one
    after another.  At a large corpus most runs hold a suffix or two, so it has no other frame."""
    columns = [x.astype(t) for x, t in zip((lcp, right, left, doc, row, place), RUN, strict=True)]
    plain = b"".join(x.tobytes() for x in (*columns, rest, before))
    small = pa.compress(plain, codec="zstd", asbytes=True)
    return struct.pack("<III", len(lcp), len(rest), len(before)) + min(small, plain, key=len)


def unpack(raw: bytes) -> list[np.ndarray]:
    n, *more = struct.unpack_from("<III", raw)
    size = n * sum(np.dtype(t).itemsize for t in RUN) + sum(more)
    plain = raw[12:] if len(raw) - 12 == size else pa.decompress(raw[12:], size, codec="zstd", asbytes=True)
    at, out = 0, []
    for count, t in [*((n, t) for t in RUN), *((m, "u1") for m in more)]:
        out.append(np.frombuffer(plain, t, count, at))
        at += count * np.dtype(t).itemsize
    return out


# -- sorted runs


def matrix(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Rows data[start:start+length], filled up with zeros to width."""
    at = np.arange(width)
    rows = data[np.minimum(start[:, None] + at, max(len(data) - 1, 0))]
    rows[at >= length[:, None]] = 0
    return rows


def sorted_order(rows: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """Order of byte rows, ties by the arrays of then."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(">u8").astype(U64)
    return np.lexsort([*then[::-1], *words.T[::-1]])


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of two byte matrices."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


#: Types of a run's columns: common prefix with the suffix before, bytes to the right and to the left of
#: the anchor, document, row of the chunk, place in the document.
RUN = ("u1", "u1", "u1", "<i8", "<i4", "<i4")


def make_run(chunk: Chunk, p, lo, hi, row) -> bytes:
    """A front-coded sorted run of the suffixes at p."""
    right, left = hi + WIDTH - p, p - lo
    suffix, prefix = matrix(chunk.data, p, right, WIDTH), matrix(chunk.data, lo, left, WIDTH - GRAM)
    order = sorted_order(suffix, right, row, p)
    p, row, right, left, suffix, prefix = (c[order] for c in (p, row, right, left, suffix, prefix))
    lcp = np.zeros(len(p), np.int64)
    lcp[1:] = np.minimum(common(suffix[1:], suffix[:-1]), np.minimum(right[1:], right[:-1]))
    at = np.arange(WIDTH)
    rest = suffix[(at >= lcp[:, None]) & (at < right[:, None])]
    before = prefix[np.arange(WIDTH - GRAM) < left[:, None]]
    return pack(lcp, right, left, chunk.ids[row], row, p - chunk.offsets[row], rest, before)


def read_run(raw: bytes) -> tuple[list[bytes], list[int], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, their common prefixes with the one before, left parts, doc, row, place."""
    lcp, right, left, doc, row, place, rest, before = unpack(raw)
    rest, before = rest.tobytes(), before.tobytes()
    out, parts, at, to, last = [], [], 0, 0, b""
    for l, r, n in zip(lcp.tolist(), right.tolist(), left.tolist(), strict=True):  # noqa: E741
        last = last[:l] + rest[at : at + r - l]
        at += r - l
        out.append(last)
        parts.append(before[to : to + n])
        to += n
    return out, lcp.tolist(), parts, doc, row.astype(np.int64), place.astype(np.int64)


def differ(a: bytes, b: bytes, at: int) -> int:
    """First place from at on in which a and b differ, or the shorter one's length."""
    end = min(len(a), len(b))
    while at < end:
        x, y = a[at : at + 8], b[at : at + 8]
        if x != y:
            m = min(len(x), len(y))
            z = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return at + m - (z.bit_length() + 7) // 8
        at += 8
    return end


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merges sorted runs (strings, common prefixes) into the order of runs' numbers and the common
    prefixes of the merged sequence, by a loser tree that never compares a known prefix again."""
    k = 1 << max(len(runs) - 1, 0).bit_length()
    n_runs = len(runs)
    head = [0] * k  # next string of each run
    text: list[bytes | None] = [runs[r][0][0] if r < n_runs and runs[r][0] else None for r in range(k)]
    known = [0] * k  # common prefix of that string with the last winner
    loser = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets what the loser is known to share with the winner."""
        s, t = text[a], text[b]
        if t is None:
            return a, b
        if s is None:
            return b, a
        x, y = known[a], known[b]
        if x > y:
            return a, b
        if y > x:
            return b, a
        at = differ(s, t, x)
        if s[at : at + 1] < t[at : at + 1] or (len(s) == at and len(t) == at and a < b):
            known[b] = at
            return a, b
        known[a] = at
        return b, a

    winners = list(range(k))
    level = k
    while level > 1:
        half = level >> 1
        nxt = []
        for i in range(half):
            w, lo = play(winners[2 * i], winners[2 * i + 1])
            loser[half + i] = lo
            nxt.append(w)
        winners, level = nxt, half
    best = winners[0]
    order, prefixes = [], []
    while text[best] is not None:
        order.append(best)
        prefixes.append(known[best])
        strings, shared = runs[best]
        head[best] += 1
        if head[best] < len(strings):
            text[best], known[best] = strings[head[best]], shared[head[best]]
        else:
            text[best] = None
        node, w = (k + best) >> 1, best
        while node:
            w, loser[node] = play(w, loser[node])
            node >>= 1
        best = w
    return order, prefixes


# -- judging windows


def judge(suffix: np.ndarray, right: np.ndarray, prefix: np.ndarray, left: np.ndarray, group: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items and offsets (bytes of a window before its anchor) of windows that an item of smaller rank
    in the group has too.  suffix rows start at the anchor, prefix rows end there.

    Only windows at one offset can be equal, so offsets are taken a few at a time: memory stays with the
    items, however large a group is.
    """
    m, most = len(suffix), WIDTH - GRAM
    whole = np.concatenate([prefix, suffix], 1)
    sums = np.zeros((m, whole.shape[1] + 1), U64)
    np.multiply(whole, _powers(_B, whole.shape[1]), out=sums[:, 1:])
    np.cumsum(sums, axis=1, out=sums)
    step = max(1, min(most + 1, WINDOWS // max(m, 1)))
    out = [_judge_offsets(range(o, min(o + step, most + 1)), whole, sums, suffix, right, prefix, left, group, rank) for o in range(0, most + 1, step)]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _judge_offsets(offsets: range, whole, sums, suffix, right, prefix, left, group, rank) -> tuple[np.ndarray, np.ndarray]:
    m, most = len(suffix), WIDTH - GRAM
    o = np.array(offsets)
    item, off = np.nonzero((o <= left[:, None]) & (WIDTH - o <= right[:, None]))
    off = off + offsets.start
    value = sums[item, most - off + WIDTH] - sums[item, most - off]
    key = mixed(value ^ mixed((group[item].astype(U64) << U64(8)) + off.astype(U64)))
    order = np.lexsort((rank[item], key))
    key, item, off = key[order], item[order], off[order]
    same = np.flatnonzero(key[1:] == key[:-1]) + 1
    a, b = item[same - 1], item[same]
    pairs, which = np.unique(a * m + b, return_inverse=True)
    i, j = np.divmod(pairs, m)
    ahead = np.minimum(common(suffix[i], suffix[j]), np.minimum(right[i], right[j]))
    behind = np.minimum(common(prefix[i][:, ::-1], prefix[j][:, ::-1]), np.minimum(left[i], left[j]))
    real = (group[a] == group[b]) & (off[same - 1] == off[same]) & (off[same] <= behind[which]) & (WIDTH - off[same] <= ahead[which])
    if real.all():
        return b, off[same]
    # Two windows share a 64-bit hash: judge these by their bytes.
    bad = np.isin(key, key[same[~real]])
    seen, hit = set(), []
    for x in np.flatnonzero(bad)[np.argsort(rank[item[bad]], kind="stable")].tolist():
        w = (int(group[item[x]]), int(off[x]), whole[item[x], most - off[x] : most - off[x] + WIDTH].tobytes())
        if w in seen:
            hit.append(x)
        seen.add(w)
    keep = np.concatenate([same[~bad[same]], np.array(hit, np.int64)])
    return item[keep], off[keep]


def spans_of(item: np.ndarray, off: np.ndarray, place: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """(item, from, to) of the bytes that windows cover, neighbours joined; place is given by item, or
    by which."""
    start = place[item if which is None else which] - off
    order = np.lexsort((start, item))
    item, start = item[order], start[order]
    if not len(item):
        return np.empty((0, 3), np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(item) != 0) | (np.diff(start) != 1)]))
    last = np.append(first[1:] - 1, len(item) - 1)
    return np.stack([item[first], start[first], start[last] + WIDTH], 1)


def window_spans(row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(row, from, to) of the bytes that windows at places cover."""
    return spans_of(row, np.zeros(len(row), np.int64), place, np.arange(len(row)))


def judge_bucket(raws: list[bytes], chunks: np.ndarray) -> list[np.ndarray]:
    """For each run the (row, from, to) spans that go."""
    runs = [read_run(r) for r in raws]
    order, lcp = merge([(r[0], r[1]) for r in runs])
    out: list[list[np.ndarray]] = [[] for _ in runs]
    if not order:
        return [np.empty((0, 3), np.int64) for _ in runs]
    run = np.array(order)
    at = np.empty(len(run), np.int64)
    by = np.argsort(run, kind="stable")
    count = np.bincount(run, minlength=len(runs))
    at[by] = np.concatenate([np.arange(c) for c in count])
    group = np.cumsum(np.array(lcp) < GRAM)
    start = np.cumsum(count) - count
    of = start[run] + at  # place in the runs' columns, one after another
    doc, row, place = (np.concatenate([r[c] for r in runs])[of] for c in (3, 4, 5))
    rank = np.empty(len(run), np.int64)
    rank[np.lexsort((place, row, chunks[run], doc))] = np.arange(len(run))
    edges = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
    size = np.diff(np.append(edges, len(run)))
    todo = np.repeat(size, size) > 1
    k = np.flatnonzero(todo)
    lo = 0
    while lo < len(k):
        hi = min(lo + 20_000, len(k))
        while hi < len(k) and group[k[hi]] == group[k[hi - 1]]:
            hi += 1
        part = k[lo:hi]
        strings = [runs[run[i]][0][at[i]] for i in part.tolist()]
        parts = [runs[run[i]][2][at[i]] for i in part.tolist()]
        as_rows = lambda xs, n: np.frombuffer(b"".join(xs), np.uint8).reshape(-1, n)
        suffix, prefix = as_rows([s.ljust(WIDTH, b"\0") for s in strings], WIDTH), as_rows([s.rjust(WIDTH - GRAM, b"\0") for s in parts], WIDTH - GRAM)
        right, left = np.array([len(s) for s in strings]), np.array([len(s) for s in parts])
        item, off = judge(suffix, right, prefix, left, group[part], rank[part])
        found = spans_of(item, off, place[part])
        for r in np.unique(run[part[found[:, 0]]]).tolist():
            mine = found[run[part[found[:, 0]]] == r]
            out[r].append(np.stack([row[part[mine[:, 0]]], mine[:, 1], mine[:, 2]], 1))
        lo = hi
    return [np.concatenate(o) if o else np.empty((0, 3), np.int64) for o in out]


# -- windows of hot anchors


def window_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, start and a 64-bit hash of every window from lo to hi of each item."""
    size = hi - lo + 1
    item = np.repeat(np.arange(len(lo)), size)
    start = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    h = np.zeros(len(item), U64)
    for k in range(WIDTH):
        h *= U64(_B)
        h += data[start + k] + U64(1)
    return item, start, mixed(h)


# -- copies within a chunk


def first_of_each(chunk: Chunk, p, lo, hi, row, key) -> tuple[np.ndarray, np.ndarray]:
    """Which neighbourhoods stay, and the (row, from, to) spans of the others: those that equal, byte for byte, an
    earlier one of their key in the chunk.  Bytes are compared a slice at a time."""
    key = mixed(key ^ mixed(((p - lo).astype(U64) << U64(32)) | (hi - lo).astype(U64)))
    order = np.lexsort((p, row, chunk.ids[row], key))
    same = np.concatenate([[False], key[order[1:]] == key[order[:-1]]])
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    copy, of = order[same], first[same]
    equal = np.ones(len(copy), bool)
    at = np.arange(2 * WIDTH - GRAM)
    for k in range(0, len(copy), COMPARED):
        x, y = copy[k : k + COMPARED], of[k : k + COMPARED]
        size = hi[x] + WIDTH - lo[x]
        end = len(chunk.data) - 1
        a, b = (chunk.data[np.minimum(lo[z][:, None] + at, end)] for z in (x, y))
        equal[k : k + COMPARED] = ((a == b) | (at >= size[:, None])).all(1) & (hi[y] + WIDTH - lo[y] == size) & (p[y] - lo[y] == p[x] - lo[x])
    gone = copy[equal]
    stay = np.ones(len(p), bool)
    stay[gone] = False
    base = chunk.offsets[row[gone]]
    return np.flatnonzero(stay), np.stack([row[gone], lo[gone] - base, hi[gone] + WIDTH - base], 1)


# -- the job


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)


HASHES = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("path", pa.string()), ("hashes", pa.binary())])
RUNS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("path", pa.string()), ("run", pa.binary()), ("spans", pa.binary())])
SPANS = pa.schema([("chunk", pa.int64()), ("path", pa.string()), ("spans", pa.binary())])
DDL = {s: ", ".join(f"{f.name} {({'int64': 'bigint'}).get(str(f.type), str(f.type))}" for f in s) for s in (HASHES, RUNS, SPANS)}


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (array of struct from, to: the bytes that go, in order) and kept (binary)."""
    spark = docs.sparkSession
    folder = new_path(spark, "suffix-store")
    manifest = store(docs, folder, id_col, text_col)
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    wanted = max(total // ((WIDTH - GRAM + 2) // 2) // ANCHORS_IN_BUCKET, int(spark.conf.get("spark.sql.shuffle.partitions")))
    depth = max(1, round(math.log2(max(wanted, 2))))
    # A task for a chunk, up to a limit: the rows are small, the work on a chunk is not.
    tasks = max(1, min(4096, manifest.count()))
    chunks = spread(manifest.select("chunk", "path"))

    def hashes(batches):
        for b in batches:
            for chunk, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = Chunk(folder, path)
                h = marked(*anchors(c.data, c.offsets)[3:5])
                bucket = bucket_of(h, depth)
                order = np.argsort(bucket, kind="stable")
                h, bucket = h[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                yield _rows([(int(b[0]), chunk, path, x.tobytes()) for b, x in zip(np.split(bucket, cuts), np.split(h, cuts), strict=True) if len(x)], HASHES)

    def repeated(t: pa.Table) -> pa.Table:
        packed = t["hashes"].to_pylist()
        h = np.frombuffer(b"".join(packed), U64)
        of = np.repeat(np.arange(len(packed)), [len(x) // 8 for x in packed])
        order = np.argsort(h, kind="stable")
        s = h[order] & EVEN
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(s)))
        weight = np.add.reduceat(np.where(h[order] & U64(1), MANY, 1), first) if len(s) else size
        h = np.empty_like(h)  # a copy, with the mark of the whole corpus
        h[order] = s | np.repeat(weight >= HOT, size).astype(U64)
        hit = order[np.repeat(size > 1, size)]
        hit = hit[np.lexsort((h[hit], of[hit]))]
        rows, (which, first) = [], np.unique(of[hit], return_index=True)
        for w, x in zip(which.tolist(), np.split(hit, first[1:]) if len(hit) else [], strict=True):
            rows.append((t["bucket"][w].as_py(), t["chunk"][w].as_py(), t["path"][w].as_py(), h[x].tobytes()))
        return pa.Table.from_batches([_rows(rows, HASHES)])

    def runs(t: pa.Table) -> pa.Table:
        chunk, path = t["chunk"][0].as_py(), t["path"][0].as_py()
        c = Chunk(folder, path)
        p, lo, hi, h, whole, row, sure = anchors(c.data, c.offsets)
        known = np.frombuffer(b"".join(t["hashes"].to_pylist()), U64)
        hot = known[(known & U64(1)) == 1] & EVEN
        here = np.sort(h)
        known = np.union1d(known & EVEN, here[1:][here[1:] == here[:-1]])
        k = np.flatnonzero(np.isin(h, known))
        p, lo, hi, h, whole, row = (x[k] for x in (p, lo, hi, h, whole, row))
        k, copies = first_of_each(c, p, lo, hi, row, h ^ mixed(whole))
        p, lo, hi, h, row = (x[k] for x in (p, lo, hi, h, row))
        spans, key = [sure, copies], h & EVEN
        alone = np.isin(h, hot)
        if alone.any():
            item, start, by = window_hashes(c.data, lo[alone], hi[alone])
            of = row[alone][item]
            k, copies = first_of_each(c, start, start, start, of, by)
            spans.append(copies)
            p, lo, hi = (np.concatenate([x[~alone], start[k]]) for x in (p, lo, hi))
            row, key = np.concatenate([row[~alone], of[k]]), np.concatenate([key[~alone], by[k]])
        bucket = bucket_of(key, depth)
        order = np.argsort(bucket, kind="stable")
        rows = []
        for k in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            rows.append([int(bucket[k[0]]), chunk, path, make_run(c, p[k], lo[k], hi[k], row[k]), None])
        # Any bucket hands the spans on; the hash keeps chunks from choosing the same one.
        spans, by = np.concatenate(spans).astype(np.int64), int(mixed(np.array([chunk]))[0])
        if len(spans) and not rows:
            rows.append([by % (1 << depth), chunk, path, None, None])
        if len(spans):
            rows[by % len(rows)][4] = spans.tobytes()
        return pa.Table.from_batches([_rows(rows, RUNS)])

    def judged(t: pa.Table) -> pa.Table:
        chunks, packed = t["chunk"].to_numpy(), t["run"].to_pylist()
        found = [np.empty((0, 3), np.int64)] * len(packed)
        k = [i for i, r in enumerate(packed) if r]
        for i, x in zip(k, judge_bucket([packed[i] for i in k], chunks[k]), strict=True):
            found[i] = x
        rows = []
        for chunk, path, own, more in zip(t["chunk"].to_pylist(), t["path"].to_pylist(), t["spans"].to_pylist(), found, strict=True):
            if own or len(more):
                rows.append((chunk, path, (own or b"") + more.astype(np.int64).tobytes()))
        return pa.Table.from_batches([_rows(rows, SPANS)])

    kind = docs.schema[id_col].dataType.simpleString()
    out_type = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("kept", pa.binary())])

    def removed(t: pa.Table) -> pa.Table:
        c = Chunk(folder, t["path"][0].as_py())
        s = np.frombuffer(b"".join(x for x in t["spans"].to_pylist() if x), np.int64).reshape(-1, 3)
        edge = np.zeros(len(c.data) + 1, np.int32)
        base = c.offsets[s[:, 0]]
        np.add.at(edge, base + s[:, 1], 1)
        np.add.at(edge, base + s[:, 2], -1)
        gone = np.cumsum(edge[:-1]) > 0
        n = len(c.ids)
        flag = np.zeros(len(gone) + 2, np.int8)
        flag[1:-1] = gone
        step = np.diff(flag)  # a span may touch the next document's: cut at document edges
        inner = c.offsets[1:-1][(c.offsets[1:-1] > 0) & (c.offsets[1:-1] < len(gone))]
        inner = inner[gone[inner] & gone[inner - 1]]
        start = np.unique(np.concatenate([np.flatnonzero(step == 1), inner]))
        end = np.unique(np.concatenate([np.flatnonzero(step == -1), inner]))
        row = np.searchsorted(c.offsets, start, "right") - 1
        pairs = pa.StructArray.from_arrays([pa.array(start - c.offsets[row]), pa.array(end - c.offsets[row])], names=["from", "to"])
        at = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(row, minlength=n), out=at[1:])
        left = c.data[~gone]
        before = np.concatenate([[0], np.cumsum(~gone)])[c.offsets]
        kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(before.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(left))])
        return pa.Table.from_arrays([pa.array(c.ids), pa.array(np.diff(c.offsets)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pairs), kept], schema=out_type)

    first = chunks.mapInArrow(hashes, DDL[HASHES]).groupBy("bucket").applyInArrow(repeated, DDL[HASHES])
    every = manifest.select(F.lit(-1).cast("long").alias("bucket"), "chunk", "path", F.lit(b"").alias("hashes"))
    sent = first.unionByName(every).repartition(tasks, "chunk").groupBy("chunk").applyInArrow(runs, DDL[RUNS])
    spans = sent.groupBy("bucket").applyInArrow(judged, DDL[SPANS])
    every = manifest.select("chunk", "path", F.lit(b"").alias("spans"))
    out = spans.unionByName(every).repartition(tasks, "chunk").groupBy("chunk").applyInArrow(removed, "doc_id bigint, n_bytes bigint, spans array<struct<from:bigint,to:bigint>>, kept binary")
    return out.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)).cast(kind))


def digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(dedup(table(spark, sf_dir, "documents")))
