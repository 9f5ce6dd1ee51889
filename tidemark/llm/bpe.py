"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word is a row of symbols.  Leaf i of its segment tree holds ``rank * width + i`` for the pair that
starts at symbol i, or infinity if the pair does not merge; a node holds the smaller of its children,
so the root is the leftmost pair of lowest rank.  A merge changes three leaves (the pair, the one before
it and the symbol that went), each in a logarithmic number of steps.  Words not met before are merged
together, thousands of trees as the rows of one numpy array; few or very long words go one at a time
through plain lists.  Encoded words are remembered by each Python worker, up to ``REMEMBER``.

Texts are cut into words as the tokenizer file says (special strings, normaliser, pattern).  Texts of
ordinary Latin characters are cut here; others are cut by the tokenizer file's own normaliser and
pre-tokenizer, so that Unicode tables are the same.  Decoding maps ids to token strings and joins them.

Null texts count as empty and have no ids.  Rows are independent: there is no shuffle, equal rows give
equal results, extra columns are not read.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_slices

REMEMBER, SLICE_BYTES, TOGETHER, LONG = 250_000, 2_000_000, 24, 256
INF = 1 << 62
#: Characters on which all Unicode versions agree and normalisation does nothing.
PLAIN = r"[\x00-ɏ‐-‧]*+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class SegmentTreeBpe:
    """Encoder and decoder of a byte-level BPE tokenizer file with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = dict(sorted((i, t) for t, i in [*vocab.items(), *self.special.items()]))
        self.size = max(tokens) + 1
        self.tokens = pa.array([tokens.get(i, "") for i in range(self.size)])
        chars = byte_chars()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pair = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.by_pair = np.argsort(pair, kind="stable")
        self.pairs = pair[self.by_pair]
        self.rank_of = dict(zip(pair.tolist(), range(len(merges)), strict=True))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.plain = regex.compile(PLAIN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known: dict[str, bytes] = {}

    # -- words

    def split(self, text: str) -> list[str]:
        """The words of a text in order; a special string is a word with a leading NUL."""
        if "<|" in text and any(s in text for s in self.special):
            parts = self.specials.split(text)
            return list(chain.from_iterable(["\0" + p] if p in self.special else self.split(p) for p in parts))
        if self.plain.fullmatch(text):
            return self.words.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        cut = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in cut]

    # -- merging

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.by_pair[at], -1)

    def merge_one(self, word: bytes) -> list[int]:
        """Ids of one word by a segment tree in lists."""
        sym = self.inner[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.last[word[-1]])
        n = len(sym)
        width = 1 << max(n - 1, 1).bit_length()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [INF] * (2 * width)
        rank_of, size = self.rank_of, self.size

        def leaf(i: int) -> int:
            j = after[i]
            r = rank_of.get(sym[i] * size + sym[j], -1) if j < n else -1
            return INF if r < 0 else r * width + i

        for i in range(n):
            tree[width + i] = leaf(i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        while tree[1] < INF:
            rank, i = divmod(tree[1], width)
            j = after[i]
            sym[i] = int(self.merged[rank])
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, INF)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = after[i]
        return out

    def merge_many(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of words of at most width bytes (a power of two), all trees at once."""
        n = np.array([len(w) for w in words])
        rows = np.arange(len(words))
        # One more column than leaves: a symbol after the last, never merged.
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        sym = np.full((len(words), width + 1), -1, np.int64)
        sym[:, :width] = np.where(np.arange(width) < n[:, None], self.inner[text], -1)
        sym[rows, n - 1] = self.last[text[rows, n - 1]]
        after = np.minimum(np.tile(np.arange(1, width + 2), (len(words), 1)), width)
        after[:, :width] = np.where(after[:, :width] < n[:, None], after[:, :width], width)
        before = np.tile(np.arange(-1, width), (len(words), 1))
        there = np.ones((len(words), width), bool) & (np.arange(width) < n[:, None])

        tree = np.full((len(words), 2 * width), INF, np.int64)
        r = np.where((sym[:, :-1] >= 0) & (sym[:, 1:] >= 0), self.ranks(sym[:, :-1], sym[:, 1:]), -1)
        tree[:, width:] = np.where(r >= 0, r * width + np.arange(width), INF)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(w: np.ndarray, i: np.ndarray, value) -> None:
            k = i + width
            tree[w, k] = value
            while width > 1 and (k := k >> 1)[0] > 0:
                tree[w, k] = np.minimum(tree[w, 2 * k], tree[w, 2 * k + 1])

        def leaf(w: np.ndarray, i: np.ndarray) -> np.ndarray:
            b = sym[w, after[w, i]]
            r = np.where(b >= 0, self.ranks(sym[w, i], np.maximum(b, 0)), -1)
            return np.where(r >= 0, r * width + i, INF)

        live = rows[tree[:, 1] < INF]
        while len(live):
            rank, i = np.divmod(tree[live, 1], width)
            j = after[live, i]
            nxt = after[live, j]
            sym[live, i] = self.merged[rank]
            after[live, i] = nxt
            before[live, nxt] = i
            sym[live, j], there[live, j] = -1, False
            put(live, j, INF)
            put(live, i, leaf(live, i))
            p = before[live, i]
            has = p >= 0
            if has.any():
                put(live[has], p[has], leaf(live[has], p[has]))
            live = live[tree[live, 1] < INF]
        ids = sym[:, :width][there].astype("<i4")
        return np.split(ids, np.cumsum(there.sum(1))[:-1])

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        if len(self.known) + len(words) > REMEMBER:
            self.known.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            if w[0] == "\0" and w[1:] in self.special:
                self.known[w] = np.array([self.special[w[1:]]], "<i4").tobytes()
                continue
            b = w.encode()
            by_width.setdefault(1 << max(len(b) - 1, 1).bit_length(), []).append((w, b))
        for width, group in by_width.items():
            if len(group) < TOGETHER or width > LONG:
                for w, b in group:
                    self.known[w] = np.array(self.merge_one(b), "<i4").tobytes()
                continue
            step = max(TOGETHER, 400_000 // width)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                for (w, _), ids in zip(part, self.merge_many([b for _, b in part], width), strict=True):
                    self.known[w] = ids.tobytes()

    # -- texts

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's in them."""
        split = [self.split(t) for t in texts]
        every = set(chain.from_iterable(split))
        new = [w for w in every if w not in self.known]
        if new:
            if len(self.known) + len(new) > REMEMBER:
                new = list(every)
            self.learn(new)
        get = self.known.__getitem__
        parts = [b"".join(map(get, ws)) for ws in split]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        return np.frombuffer(b"".join(parts), "<i4"), offsets

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Token strings joined by a space, special ones included: what a file without decoder means."""
        rows = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), self.tokens.take(pa.array(ids)))
        return pc.binary_join(rows, " ")


_loaded: dict[str, SegmentTreeBpe] = {}


def loaded(path: str) -> SegmentTreeBpe:
    if path not in _loaded:
        _loaded[path] = SegmentTreeBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded, the text that decoding those ids gives."""
    path = path or default_path()

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            texts = b.column(1).fill_null("")
            for at, to in text_slices(texts, SLICE_BYTES):
                ids, offsets = bpe.encode_batch(texts.slice(at, to - at).to_pylist())
                arrays = [b.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), bpe.decode_batch(ids, offsets)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_bpe_segment_tree(spark, sf_dir: str) -> DataFrame:
    return digests(round_trip(table(spark, sf_dir, "documents")))
