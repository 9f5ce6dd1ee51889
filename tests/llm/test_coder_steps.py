"""The range coder's steps by numpy against the same model in plain integers, one id at a time."""

import random
import zlib

import numpy as np

from tidemark.llm import rangecoder
from tidemark.llm.rangecoder import BINS, RATE, SLOTS1, SLOTS2, STRETCH, SURE


def nearer(odds, aim):
    way = aim - odds
    return odds + (way >> RATE if way >= 0 else -(-way >> RATE))


def block_by_hand(ranks, p):
    """The bytes of one block."""
    n, all64, out = len(p.ids), (1 << 64) - 1, []
    t1, t2, odds, weight, known = [0] * SLOTS1, [0] * SLOTS2, {}, [24000] * 3, [3800] * 2
    cdf = [k * (4096 // BINS) for k in range(BINS + 1)]
    place = {int(k): at for at, k in enumerate(p.key)}
    i1 = i2 = past = low = 0
    before, size = n, all64
    for x in ranks:
        (g1, c1), (g2, c2) = divmod(t1[i1], 16), divmod(t2[i2], 16)
        best = g2 if c2 > 0 and c2 >= c1 >> 1 else g1
        at = [("a", c2, c1, g1 == g2), ("b", past), ("c", int(p.octave[(before * 40503 + best) & p.mask]))]
        s = [int(STRETCH[odds.get(a, 1200)]) for a in at]
        dot = (sum(v * (w >> 4) for v, w in zip(s, weight, strict=True)) >> 12) + 2048
        mix = min(max(int(rangecoder.SQUASH[min(max(dot, 0), 4095)]), 24), 4072)
        hit, size = best == x, size >> 12
        edge = size * mix
        if hit:
            size = edge
        else:
            low, size = low + edge & all64, (size << 12) - edge
            follows = before < n and int(p.first[before + 1] > p.first[before])
            f = place.get(before << 16 | x)
            r = size >> 8
            edge = r * min(max(known[follows] >> 4, 1), 255)
            known[follows] = nearer(known[follows], 0 if f is None else 4096)
            if f is not None:
                step = edge >> 16
                low, size = low + step * int(p.start1[f]), step * int(p.width1[f])
            else:
                part, step = int(p.bin[x]), (r << 8) - edge >> 12
                low += edge + step * cdf[part]
                step = step * (cdf[part + 1] - cdf[part]) >> 12
                low, size = low + step * int(p.start0[x]), step * int(p.width0[x])
                cdf = [c + ((j if j <= part else 4096 - (BINS - j)) - c >> RATE) for j, c in enumerate(cdf)]
            low &= all64
        while (low ^ (low + size & all64)) < 1 << 48 or size < 1 << 44:
            if (low ^ (low + size & all64)) >= 1 << 48:
                size = -low & (1 << 44) - 1
            out.append(low >> 48)
            low, size = low << 16 & all64, size << 16
        for k, a in enumerate(at):
            odds[a] = nearer(odds.get(a, 1200), 4096 * hit)
            weight[k] += s[k] * (4096 * hit - mix) >> 12
        for t, i, g, c in ((t1, i1, g1, c1), (t2, i2, g2, c2)):
            t[i] = g << 4 | min(c + 1, SURE) if g == x else g << 4 | c >> 1 if c > 1 else x << 4 | 1
        i1, i2 = x & SLOTS1 - 1, (before * 0x2F0B4C47 + x * 0x1F35) >> 7 & SLOTS2 - 1
        before, past = x, (past << 1 | hit) & 63
    out += [low >> 48 - 16 * k & 0xFFFF for k in range(4)]
    return np.array(out, "<u2").tobytes()


def test_every_step_is_the_models():
    rng = random.Random(41)
    phrases = [[min(int(rng.paretovariate(0.6)), 40_000) for _ in range(rng.randrange(2, 30))] for _ in range(150)]
    ids = np.array([i for _ in range(700) for i in rng.choice(phrases) + [rng.randrange(50_000)] * rng.randrange(3)])
    raw, blocks, lengths, checks = rangecoder.encode(ids)
    p, at = rangecoder.Prior(raw), 0
    assert len(blocks) > 3 and len(p.follower) > 100
    for b, n, check in zip(blocks, lengths, checks, strict=True):
        assert b == block_by_hand(p.rank[ids[at : at + n]].tolist(), p) and check == zlib.crc32(ids[at : at + n].astype("<u4"))
        at += n
    assert (rangecoder.decode(raw, blocks, lengths, checks) == ids).all()
