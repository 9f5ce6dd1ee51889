"""Adaptive context-mixing range coder for token ids.

A stream of ids is cut into blocks that can each be decoded alone, given the stream's prior: a table of how
often each id occurs and which ids follow it at least twice.  Every block starts from an empty model, has a
CRC-32, and codes an id in up to three steps.

1. *Does the best prediction hold?*  Order 2 (the two ids before) and order 1 (the one before) each
   keep, by context, an id and a count of confidence that grows when the id comes and halves when another does;
   the more confident of them is the prediction.  Its odds are a logistic mix, with weights that the block learns,
   of three adaptive odds: by both confidences and whether the orders agree, by what held for the last ids, and by
   the share the prior gives the prediction after the id before it.
2. *Else, does the prior know the id as a follower of the one before?*  If so, the prior's frequencies of
   followers (order 1) code it.
3. *Else* order 0: one of ``BINS`` classes of ids, by an adaptive cumulative table, and the id
   within its class by the prior's frequencies.  Ids of every class stay possible.

The arithmetic is a carry-less range coder with 64 bits of state that puts out 16 bits at a time.  All
totals are powers of two, so encoding divides nothing, and an id shrinks a range by 44 bits at most, so one
renormalisation an id is enough.  All model arithmetic is in integers, so every machine decodes alike.

Queries run these steps compiled, in Spark's JVM (:mod:`jvm_coder`), which takes tables and limits from here.  The
steps here make the same bytes without Spark; Python is too slow for an id at a time, so all blocks of a
stream advance together, one id each, as numpy arrays.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

BLOCK, BINS = 2048, 32
SHARE = np.int32(40503)
SLOTS1, SLOTS2, RATE, SURE = 512, 1024, 5, 15
U = np.uint64
TOP, LEAST = U(1 << 48), U(1 << 44)
MASK, WORD = LEAST - U(1), U(16)
#: Where a cumulative table of BINS symbols and total 4096 moves when a symbol comes; neighbours differ by 1
#: at least, which keeps every symbol possible.
AIM = np.array([[j if j <= s else 4096 - (BINS - j) for j in range(BINS + 1)] for s in range(BINS)], np.int16)


#: The logistic function at 33 points, rounded, so that no machine's last digit matters.
POINTS = [min(max(round(4096 / (1 + math.exp(8 - k / 2))), 1), 4095) for k in range(33)]


def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """Odds of 4096 for every stretched value + 2048, in 256ths, and the stretched value of all odds.  Lines join
    the points."""
    points, at = np.array(POINTS), np.arange(4096)
    low, part = points[at >> 7], at & 127
    squash = (low * (128 - part) + points[(at >> 7) + 1] * part + 64) >> 7
    return squash.astype(np.int32), (np.searchsorted(squash, np.arange(4096)).clip(1, 4095) - 2048).astype(np.int32)


SQUASH, STRETCH = _logistic()
SQUASH = SQUASH.clip(24, 4072)  # after STRETCH is made


# -- the prior


class Prior:
    """Frequencies of ids and of followers, as the head of a stream says them."""

    def __init__(self, raw: bytes) -> None:
        raw = zlib.decompress(raw)
        n, m = np.frombuffer(raw, "<u4", 2).tolist()
        at = 8
        self.ids = np.cumsum(np.frombuffer(raw, "<u2", n, at).astype(np.int64)).astype(np.int32)
        level0 = np.frombuffer(raw, np.uint8, n, at := at + 2 * n)
        followers = np.frombuffer(raw, "<u2", n, at := at + n).astype(np.int64)
        step = np.frombuffer(raw, "<u2", m, at := at + 2 * n).astype(np.int64)
        level1 = np.frombuffer(raw, np.uint8, m, at + 2 * m)
        self.rank = np.zeros(1 << 16, np.int32)
        self.rank[self.ids] = np.arange(n)
        # Order 0: classes in order of frequency, of about equal weight and numbers of ids.
        weight = _freq(level0)
        order = np.lexsort((np.arange(n), -weight))
        share = weight[order] / max(weight.sum(), 1) + 1 / max(n, 1)
        place = np.minimum((np.cumsum(share) - share) * (BINS / 2), BINS - 1).astype(np.int64)
        self.bin, self.start0, self.width0 = (np.zeros(max(n, 1), np.int32) for _ in range(3))
        self.lookup = np.zeros((BINS, 4096), np.int32)
        for k in range(BINS):
            of = order[place == k]
            if len(of):
                width = _scaled(weight[of], 4096)
                self.bin[of], self.width0[of], self.start0[of] = k, width, np.cumsum(width) - width
                self.lookup[k] = np.repeat(of, width)
        # Order 1: rows of followers, each row's widths together 65 536.
        self.first = np.concatenate([[0], np.cumsum(followers)])
        row = np.repeat(np.arange(n), followers)
        follower = np.cumsum(step) - np.repeat((np.cumsum(step) - step)[np.minimum(self.first[:-1], max(m - 1, 0))], followers) if m else step
        self.key = (row << 16 | follower).astype(np.int64)
        self.follower = follower.astype(np.int32)
        self.width1 = np.zeros(m, np.int32)
        weight = _freq(level1)
        if m:
            some = np.flatnonzero(followers)
            total = np.add.reduceat(weight, self.first[some])
            count = followers[some]
            whole = np.repeat(total, count)
            width = 1 + weight * np.repeat(65536 - count, count) // whole
            spare = 65536 - np.add.reduceat(width, self.first[some])
            width[self.first[some]] += spare
            self.width1 = width.astype(np.int32)
        self.cum = np.concatenate([[0], np.cumsum(self.width1, dtype=np.int64)])
        self.base = self.cum[self.first[:-1]] if n else np.zeros(1, np.int64)
        self.start1 = (self.cum[:-1] - self.base[row]).astype(np.int32) if m else np.zeros(0, np.int32)
        self.known, self.coarse = np.append(followers > 0, False), None
        # Bit lengths of followers' widths, by a hash of the pair.
        self.mask = (1 << max(10, (4 * m).bit_length())) - 1
        self.octave = np.zeros(self.mask + 1, np.int32)
        self.guess = np.zeros(self.mask + 1, np.int32)  # a follower's place by a hash of the pair
        self.guess[self.key * 0x9E3779B1 >> 12 & self.mask] = np.arange(m)
        if m:
            np.maximum.at(self.octave, (row * 40503 + follower) & self.mask, np.minimum(np.frexp(self.width1.astype(float))[1], 15))

    def followers_at(self, before: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Places of the followers in whose widths the values of 65 536 lie."""
        if not len(self.follower):
            raise ValueError("a damaged block asks for followers, and the prior has none")
        if self.coarse is None:  # only decoding needs it: the place of every 256th value of a row
            some = np.repeat(self.base, 256) + np.tile(np.arange(256) << 8, len(self.base))
            self.coarse = np.minimum(np.searchsorted(self.cum, some, "right") - 1, len(self.follower) - 1).astype(np.int32)
        before = np.minimum(before, len(self.base) - 1)
        at, value = self.coarse.take((before << 8) + (value >> 8)), self.base.take(before) + value
        go = np.arange(len(at))
        for _ in range(4):
            go = go[self.cum.take(at[go] + 1) <= value[go]]
            if not len(go):
                return at
            at[go] += 1
        at[go] = np.minimum(np.searchsorted(self.cum, value[go], "right") - 1, len(self.follower) - 1)
        return at

    def share(self, before: np.ndarray, x: np.ndarray) -> np.ndarray:
        """A class, 0 to 15, of the share that the prior gives x after before."""
        return self.octave.take((before * SHARE + x) & self.mask)  # products may wrap, the mask is narrower

    def places(self, before: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Where the pairs of ranks are among the followers, or -1."""
        if not len(self.key):
            return np.full(len(x), -1, np.int32)
        key = before.astype(np.int64) << 16 | x
        at = self.guess.take(key * 0x9E3779B1 >> 12 & self.mask)
        off = np.flatnonzero(self.key.take(at) != key)
        at[off] = -1
        off = off[self.share(before[off], x[off]) > 0]  # a follower has a width
        sure = np.minimum(np.searchsorted(self.key, key[off]), len(self.key) - 1)
        at[off] = np.where(self.key.take(sure) == key[off], sure, -1)
        return at


def _level(count: np.ndarray) -> np.ndarray:
    """Counts as steps of an eighth of an octave."""
    return np.minimum(np.round(np.log2(np.maximum(count, 1)) * 8), 255).astype(np.uint8)


#: What a step stands for, as integers.
FREQ = np.array([max(1, round(2 ** (k / 8))) for k in range(256)], np.int64)


def _freq(level: np.ndarray) -> np.ndarray:
    return FREQ[level]


def _scaled(weight: np.ndarray, total: int) -> np.ndarray:
    width = 1 + weight * (total - len(weight)) // weight.sum()
    width[0] += total - width.sum()
    return width


def prior_of(ids: np.ndarray) -> bytes:
    count = np.bincount(ids, minlength=1 << 16)
    known = np.flatnonzero(count)
    rank = np.zeros(1 << 16, np.uint32)
    rank[known] = np.arange(len(known))
    r = rank[ids]
    pairs = np.sort(r[:-1] << np.uint32(16) | r[1:])
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(pairs)))
    pairs, size = pairs[first[size > 1]].astype(np.int64), size[size > 1]
    row, follower = pairs >> 16, pairs & 0xFFFF
    step = follower.copy()
    same = np.flatnonzero(row[1:] == row[:-1]) + 1
    step[same] -= follower[same - 1]
    head = np.array([len(known), len(pairs)], "<u4").tobytes()
    body = [np.diff(known, prepend=0).astype("<u2"), _level(count[known]), np.bincount(row, minlength=len(known)).astype("<u2"), step.astype("<u2"), _level(size)]
    return zlib.compress(head + b"".join(a.tobytes() for a in body), 6)


# -- the adaptive model


def _nearer(odds: np.ndarray, aim: np.ndarray, rate: int = RATE) -> np.ndarray:
    """A share of the way to aim, 0 or 4096, towards zero, so that odds stay between 2^rate - 1 and the rest."""
    way = aim - odds
    way += way >> 31 & (1 << rate) - 1
    way >>= rate
    way += odds
    return way


class _Model:
    """The adaptive state of n blocks; both directions run the same steps."""

    def __init__(self, n: int, prior: Prior) -> None:
        lane = np.arange(n)
        self.prior = prior
        # Entries of orders 1 and 2, a block's side by side: rank of the predicted id and its confidence in the low 4 bits.
        self.slots = np.stack([lane * (SLOTS1 + SLOTS2), lane * (SLOTS1 + SLOTS2) + SLOTS1])
        self.entries, self.now = np.zeros(n * (SLOTS1 + SLOTS2), np.int32), self.slots.copy()
        # The three odds of each state, a block's side by side, and their weights.
        self.odds, self.weights = np.full(n * (512 + 64 + 16), 1200, np.int32), np.full((3, n), 24000, np.int32)
        self.lane = np.stack([lane * 592, lane * 592 + 512, lane * 592 + 576])
        self.known = np.full(n * 4, 3800, np.int32)
        self.lane4 = (lane * 4).astype(np.int32)
        self.cdf = np.tile((np.arange(BINS + 1) * (4096 // BINS)).astype(np.int16), (n, 1))
        self.past, self.before = np.zeros(n, np.int32), np.full(n, len(prior.ids), np.int32)

    def predict(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The best prediction of the first m blocks and its odds of 4096."""
        self.e = self.entries.take(self.now[:, :m])
        self.g, self.c = self.e >> 4, self.e & 15
        (g1, g2), (c1, c2) = self.g, self.c
        best = np.where(c2 >= np.maximum(c1 >> 1, 1), g2, g1)
        state = c2 << 5
        state |= c1 << 1
        state |= g1 == g2
        self.at = np.empty((3, m), np.int64)
        for out, lane, part in zip(self.at, self.lane, (state, self.past[:m], self.prior.share(self.before[:m], best)), strict=True):
            np.add(lane[:m], part, out=out)
        self.p = self.odds.take(self.at)
        self.s = STRETCH.take(self.p)
        dot = self.weights[:, :m] >> 4
        dot *= self.s
        dot = dot[0] + dot[1] + dot[2]
        dot >>= 12
        dot += 2048
        self.mix = SQUASH.take(dot, mode="clip")
        return best, self.mix

    def doubt(self, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the odds (of 256) that the prior knows the follower are kept for the lanes, and these odds."""
        slot = self.lane4.take(lanes) + self.prior.known.take(self.before.take(lanes)) * 2
        return slot, np.clip(self.known.take(slot) >> 4, 1, 255).astype(U)

    def assure(self, slot: np.ndarray, yes: np.ndarray) -> None:
        self.known[slot] = _nearer(self.known.take(slot), yes << np.int32(12))

    def classify(self, lanes: np.ndarray, part: np.ndarray) -> None:
        cdf = self.cdf[lanes]
        self.cdf[lanes] = cdf + (AIM.take(part, 0) - cdf >> RATE)

    def learn(self, m: int, x: np.ndarray, hit: np.ndarray) -> None:
        """After the ranks x, hit where the prediction held."""
        one = hit.astype(np.int32)
        # A share of the way to 0 or 4096, towards zero.
        way = self.p + ((one << RATE) - one)
        way >>= RATE
        np.subtract(self.p, way, out=way)
        way += one << 12 - RATE
        self.odds[self.at.reshape(-1)] = way.reshape(-1)
        self.s *= (one << 12) - self.mix
        self.s >>= 12
        self.weights[:, :m] += self.s
        e, c, now = self.e, self.c, self.now[:, :m]
        more = np.minimum(e + 1, e | SURE)
        less = c + 1
        less >>= 1
        np.subtract(e, less, out=less)
        less = np.where(c > 1, less, x << 4 | 1)
        self.entries[now.reshape(-1)] = np.where(self.g == x, more, less).reshape(-1)
        before = self.before[:m]
        np.add(self.slots[0, :m], x & SLOTS1 - 1, out=now[0])
        mixed = before * 0x2F0B4C47
        mixed += x * 0x1F35
        mixed >>= 7
        mixed &= SLOTS2 - 1
        np.add(self.slots[1, :m], mixed, out=now[1])
        before[:] = x
        past = self.past[:m]
        past <<= 1
        past |= one
        past &= 63


class _Coder:
    def __init__(self, n: int) -> None:
        self.low, self.range = np.zeros(n, U), np.full(n, np.iinfo(np.uint64).max, U)

    def renew(self, m: int) -> None:
        """Moves settled words out of the first m ranges until each is wide enough for another id."""
        low, size = self.low[:m], self.range[:m]
        end = low + size
        end ^= low
        go = np.flatnonzero((end < TOP) | (size < LEAST))
        while len(go):
            a, b = low.take(go), size.take(go)
            loose = (a ^ (a + b)) >= TOP
            if loose.any():
                b = np.where(loose, (U(0) - a) & MASK, b)
            self.word(go, a)
            a, b = a << WORD, b << WORD
            low[go], size[go] = a, b
            go = go[((a ^ (a + b)) < TOP) | (b < LEAST)]


class _Writer(_Coder):
    def __init__(self, n: int) -> None:
        super().__init__(n)
        self.width = BLOCK // 2
        self.out, self.pos = np.zeros((n, self.width), np.uint16), np.zeros(n, np.int64)

    def word(self, go: np.ndarray, low: np.ndarray) -> None:
        pos = self.pos.take(go)
        if pos.max() >= self.width:
            self.out = np.pad(self.out, ((0, 0), (0, BLOCK // 2)))
            self.width += BLOCK // 2
        self.out.reshape(-1)[go * self.width + pos] = low >> U(48)
        self.pos[go] = pos + 1

    def blocks(self) -> list[bytes]:
        tail = np.stack([(self.low >> U(48 - 16 * k)).astype(np.uint16) for k in range(4)], 1)
        return [np.concatenate([o[:p], t]).astype("<u2").tobytes() for o, p, t in zip(self.out, self.pos.tolist(), tail, strict=True)]


class _Reader(_Coder):
    def __init__(self, blocks: list[bytes]) -> None:
        super().__init__(len(blocks))
        self.width = max(map(len, blocks)) // 2 + 4
        words = np.zeros((len(blocks), self.width), np.uint16)
        for row, b in zip(words, blocks, strict=True):
            row[: len(b) // 2] = np.frombuffer(b, "<u2")
        self.code = np.zeros(len(blocks), U)
        for k in range(4):
            self.code = self.code << WORD | words[:, k]
        self.words, self.pos = words.reshape(-1), np.arange(len(blocks)) * self.width + 4

    def word(self, go: np.ndarray, low: np.ndarray) -> None:
        pos = self.pos.take(go)
        self.code[go] = self.code.take(go) << WORD | self.words.take(pos, mode="clip")
        self.pos[go] = pos + 1


def _turned(grid: np.ndarray) -> np.ndarray:
    """The transpose, copied in strips that stay in the cache."""
    out = np.empty(grid.shape[::-1], grid.dtype)
    for a in range(0, len(grid), 64):
        for b in range(0, grid.shape[1], 64):
            out[b : b + 64, a : a + 64] = grid[a : a + 64, b : b + 64].T
    return out


def _past(miss: np.ndarray, low: np.ndarray, size: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low ends and ranges of the lanes whose prediction failed: what lies above the edge."""
    edge = edge.take(miss)
    return low.take(miss) + edge, (size.take(miss) << U(12)) - edge


def encode(ids: np.ndarray) -> tuple[bytes, list[bytes], list[int], list[int]]:
    """The prior, blocks of at most BLOCK ids (below 65 536), their numbers of ids and their checksums."""
    if not len(ids):
        return prior_of(np.empty(0, np.int64)), [], [], []
    if ids.max() > 0xFFFF or ids.min() < 0:
        raise ValueError("ids must lie in 0..65535")
    raw = prior_of(ids)
    prior = Prior(raw)
    n = -(-len(ids) // BLOCK)
    last = len(ids) - (n - 1) * BLOCK
    grid = np.zeros((n, BLOCK), np.int32)
    grid.reshape(-1)[: len(ids)] = prior.rank[ids]
    grid = _turned(grid)
    model, w = _Model(n, prior), _Writer(n)
    for t in range(BLOCK if n > 1 else last):
        m = n if t < last else n - 1
        x, low, size = grid[t, :m], w.low[:m], w.range[:m]
        best, odds = model.predict(m)
        hit = best == x
        size >>= U(12)
        edge = size * odds.astype(U)
        miss = np.flatnonzero(~hit)
        if len(miss):
            l, r = _past(miss, low, size, edge)  # noqa: E741
        size[:] = edge
        if len(miss):
            at = prior.places(model.before.take(miss), x.take(miss))
            yes = at >= 0
            slot, odds = model.doubt(miss)
            r >>= U(8)
            edge = r * odds
            model.assure(slot, yes)
            l += np.where(yes, U(0), edge)  # noqa: E741
            r = np.where(yes, edge, (r << U(8)) - edge)
            k = np.flatnonzero(yes)
            if len(k):
                step = r[k] >> U(16)
                l[k] += step * prior.start1.take(at[k]).astype(U)
                r[k] = step * prior.width1.take(at[k]).astype(U)
            k = np.flatnonzero(~yes)
            if len(k):
                lane = miss[k]
                what = x[lane]
                part = prior.bin.take(what)
                start, end = model.cdf[lane, part], model.cdf[lane, part + 1]
                step = r[k] >> U(12)
                l[k] += step * start.astype(U)
                step = (step * (end - start).astype(U)) >> U(12)
                l[k] += step * prior.start0.take(what).astype(U)
                r[k] = step * prior.width0.take(what).astype(U)
                model.classify(lane, part)
            low[miss], size[miss] = l, r
        w.renew(m)
        model.learn(m, x, hit)
    plain = np.ascontiguousarray(ids, "<u4")
    return raw, w.blocks(), [BLOCK] * (n - 1) + [last], [zlib.crc32(plain[k * BLOCK : (k + 1) * BLOCK]) for k in range(n)]


def decode(raw: bytes, blocks: list[bytes], lengths: list[int], checks: list[int]) -> np.ndarray:
    """The ids of blocks, all of which but the last hold the same number."""
    if not blocks:
        return np.empty(0, np.uint32)
    prior, n, most = Prior(raw), len(blocks), max(lengths)
    if any(k != most for k in lengths[:-1]):
        raise ValueError("blocks but the last must be equally long")
    grid = np.zeros((most, n), np.int32)
    model, r_ = _Model(n, prior), _Reader(blocks)
    for t in range(most):
        m = n if t < lengths[-1] else n - 1
        low, size, code = r_.low[:m], r_.range[:m], r_.code[:m]
        best, odds = model.predict(m)
        size >>= U(12)
        edge = size * odds.astype(U)
        hit = code - low < edge
        x = best  # learn() asks for x alone
        miss = np.flatnonzero(~hit)
        if len(miss):
            l, r = _past(miss, low, size, edge)  # noqa: E741
        size[:] = edge
        if len(miss):
            slot, odds = model.doubt(miss)
            r >>= U(8)
            c = code.take(miss)
            edge = r * odds
            yes = c - l < edge
            model.assure(slot, yes)
            l += np.where(yes, U(0), edge)  # noqa: E741
            r = np.where(yes, edge, (r << U(8)) - edge)
            k = np.flatnonzero(yes)
            if len(k):
                step = r[k] >> U(16)
                value = np.minimum((c[k] - l[k]) // step, U(65535)).astype(np.int64)
                at = prior.followers_at(model.before.take(miss[k]), value)
                x[miss[k]] = prior.follower.take(at)
                l[k] += step * prior.start1.take(at).astype(U)
                r[k] = step * prior.width1.take(at).astype(U)
            k = np.flatnonzero(~yes)
            if len(k):
                lane = miss[k]
                step = r[k] >> U(12)
                value = np.minimum((c[k] - l[k]) // step, U(4095)).astype(np.int16)
                part = (value[:, None] >= model.cdf[lane, 1:BINS]).sum(1)
                start, end = model.cdf[lane, part], model.cdf[lane, part + 1]
                l[k] += step * start.astype(U)
                step = (step * (end - start).astype(U)) >> U(12)
                value = np.minimum((c[k] - l[k]) // step, U(4095)).astype(np.int64)
                what = prior.lookup[part, value]
                x[lane] = what
                l[k] += step * prior.start0.take(what).astype(U)
                r[k] = step * prior.width0.take(what).astype(U)
                model.classify(lane, part)
            low[miss], size[miss] = l, r
        r_.renew(m)
        grid[t, :m] = x
        model.learn(m, x, hit)
    ids = prior.ids.take(_turned(grid), mode="clip").astype("<u4")
    for k, (row, size, check) in enumerate(zip(ids, lengths, checks, strict=True)):
        if zlib.crc32(row[:size]) != check:
            raise ValueError(f"block {k} is damaged")
    return ids.reshape(-1)[: sum(lengths)]
