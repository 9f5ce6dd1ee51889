"""Operators that treat each text by itself: quality rules, BPE, token files."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bpe, quality, rangecoder, tokens
from tidemark.llm.common import new_path

W = re.compile(r"[^\x20\x09-\x0D]+")


# -- quality rules


def base_measures(text):
    words, lines = W.findall(text or ""), (text or "").split("\n")
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in lines:
        if W.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n


def dup_chars(text, n):
    words, seen, inside = W.findall(text or ""), set(), set()
    for i in range(len(words) - n + 1):
        w = tuple(words[i : i + n])
        if w in seen:
            inside.update(range(i, i + n))
        seen.add(w)
    return sum(len(words[i]) for i in inside)


def test_measures(documents, corpus):
    got = collections.Counter()
    for r in quality.measure(documents).collect():
        got[(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["dup_5gram_chars"], r["dup_10gram_chars"])] += 1
        assert not (r["kept"] and r["base_failed"])
    want = collections.Counter((i, *base_measures(t), dup_chars(t, 5), dup_chars(t, 10)) for i, t, *_ in corpus)
    assert got == want


def test_verdicts(documents, corpus, clashing, no_documents):
    kept = {r["text"] for r in quality.keep_good(documents).collect()}
    rng = random.Random(2)
    assert None not in kept and "" not in kept
    assert not any("same line here\nsame line here" in t for t in kept)
    clean = [t for _, t, *_ in corpus if t and len(W.findall(t)) >= 60 and base_measures(t)[4] == 0 and "\n" not in t]
    assert len(clean) > 10 and set(clean) <= kept and rng
    assert not any(r["kept"] for r in quality.measure(documents.selectExpr("doc_id", "replace(text, ' ', ' # ') AS text")).collect())
    out = quality.keep_good(clashing)
    assert out.columns == clashing.columns and out.count() == quality.keep_good(documents).count()
    assert quality.measure(no_documents).count() == 0 == quality.keep_good(no_documents).count()


def test_lines_without_words_do_not_count():
    """Blank lines and the blanks of a repeated line are measured alike above and below the fraction."""
    rng = random.Random(3)
    line = lambda: " ".join(f"{rng.randrange(10**6)}" for _ in range(12))
    a, others = line(), [line() for _ in range(4)]
    text = "\n".join([a, *["", " \t"] * 60, a, *others])
    m = quality.measures(pa.array([text])).to_pylist()[0]
    assert (m["n_lines"], m["n_dup_lines"], m["dup_line_chars"]) == (6, 1, len(a)) and m["line_chars"] == 2 * len(a) + sum(map(len, others))
    three = quality.measures(pa.array(["\n".join([a, *[""] * 90, a, a, *others])])).to_pylist()[0]
    assert not three["kept"]  # two lines of seven are copies, whatever blank lines stand between


def test_equal_hashes_are_checked_word_by_word():
    ids = np.array([1, 2, 3, 9, 1, 2, 3, 8, 4, 5, 6])
    doc, n = np.zeros(11, np.int64), 3
    hashes = np.zeros(9, np.uint64)  # all windows collide
    every, later = quality.repeated_windows(ids, doc, hashes, n)
    assert sorted(every) == [0, 4] and list(later) == [4]


# -- BPE


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_round_trip_is_the_librarys(documents, corpus, word_tokenizer, clashing, no_documents):
    want = collections.Counter()
    for i, t, *_ in corpus:
        ids = word_tokenizer.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(i, len(ids), sha(" ".join(map(str, ids))), sha(word_tokenizer.decode(ids, skip_special_tokens=False)))] += 1
    for docs in (documents, clashing):
        assert collections.Counter(map(tuple, bpe.digests(bpe.round_trip(docs)).collect())) == want
    assert bpe.round_trip(no_documents).count() == 0


def test_odd_words(word_tokenizer):
    rng, b = random.Random(3), bpe.SegmentTreeBpe(bpe.default_path())
    pools = [range(32, 127), range(0xA0, 0x250), range(0x250, 0x3000), range(0x3000, 0xD7FF), range(0xE000, 0x1FFFF)]
    texts = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["x" * 700, "ab" * 3000, "don't WE'LL"]
    ids, at = b.encode_batch(texts)
    for k, e in enumerate(word_tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == e.ids


def test_trees_in_numpy_and_in_lists_agree():
    rng, b = random.Random(4), bpe.SegmentTreeBpe(bpe.default_path())
    words = ["".join(rng.choice("abcdeth") for _ in range(rng.randrange(1, 17))).encode() for _ in range(500)]
    assert [x.tolist() for x in b.merge_many(words, 16)] == [b.merge_one(w) for w in words]


# -- token files


def test_token_files(spark, documents, corpus, clashing, no_documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    ordered, want, at = sorted(corpus, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), [], 0
    for i, text, *_ in ordered:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for docs in (documents, clashing):
        out = tokens.read_shards(tokens.write_shards(docs, new_path(spark, "ids"))).selectExpr("doc_id", "start", "n_tokens", "crc32(ids)")
        assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == want
    assert tokens.read_shards(tokens.write_shards(no_documents, new_path(spark, "ids"))).count() == 0


def test_words_are_cut_like_the_librarys():
    rng, b = random.Random(5), tokens.ByteBpe(tokens.default_path())
    pool = ["'s", "s", "t", "re", "'ll", "v", " ", "  ", "\n", "\t", "\xa0", "\x85", "é", "ß", "1", "²", "!", "—", "_", "A", " 've", "\0", "\x1c", "ª", "日"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(3000)]
    ids, at = b.encode(pa.array(texts, pa.string()), 0)
    for k, e in enumerate(b.library.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == [*e.ids, 0], texts[k]


@pytest.mark.parametrize("name", ["none", "one", "edges", "same", "random", "skewed", "periodic", "blocks"])
def test_range_coder(name):
    rng = np.random.default_rng(6)
    x = {"none": [], "one": [5], "edges": [65_535, 0, 1, 2], "same": [0] * 9000, "random": rng.integers(0, 65_536, 9000), "skewed": np.minimum(rng.zipf(1.3, 9000), 65_535), "periodic": np.tile(np.arange(300), 40), "blocks": np.arange(2 * rangecoder.BLOCK) % 7}[name]
    x = np.array(x, np.int64)
    prior, blocks, lengths, checks = rangecoder.encode(x)
    assert rangecoder.decode(prior, blocks, lengths, checks).tolist() == x.tolist()
    if name in ("same", "periodic", "blocks"):
        assert sum(map(len, blocks)) < len(x) / 2
    if len(blocks) > 1:  # blocks stand alone
        assert rangecoder.decode(prior, blocks[-1:], lengths[-1:], checks[-1:]).tolist() == x[sum(lengths[:-1]) :].tolist()


def test_range_coder_finds_damage():
    prior, blocks, lengths, checks = rangecoder.encode(np.random.default_rng(7).integers(0, 50_000, 500))
    bad = bytearray(blocks[0])
    bad[40] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode(prior, [bytes(bad)], lengths, checks)
    with pytest.raises(ValueError):
        rangecoder.encode(np.array([70_000]))


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no generated tables")
def test_range_coder_beats_general_compressors():
    """With its prior, under a byte an id and well under zlib and bz2 on the raw 16-bit ids."""
    import bz2

    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id")["text"].combine_chunks().cast(pa.string())
    ids, _ = tokens.ByteBpe(tokens.default_path()).encode(texts.fill_null(""), 0)
    prior, blocks, lengths, checks = rangecoder.encode(ids)
    size, raw = len(prior) + sum(map(len, blocks)), ids.astype("<u2").tobytes()
    assert size < 0.85 * len(ids) and size < 0.8 * len(zlib.compress(raw, 6)) and size < len(bz2.compress(raw))
    assert (rangecoder.decode(prior, blocks, lengths, checks) == ids).all()
    # On ids in random order there is nothing to predict but their frequencies.
    mixed_up = np.random.default_rng(3).permutation(ids[:200_000])
    prior, blocks, *_ = rangecoder.encode(mixed_up)
    count = np.bincount(mixed_up)
    share = count[count > 0] / len(mixed_up)
    assert sum(map(len, blocks)) < 1.08 * len(mixed_up) * -(share * np.log2(share)).sum() / 8
