"""Token-id files: byte-level BPE ids of all documents in one ordered, range-coded stream.

Documents are dealt out by ranges of doc_id and sorted, so shard after shard holds them in ascending
order.  A shard is a file in the shared folder: segments of a directory (ids of documents, their numbers of
tokens, their blocks with checksums, the coder's prior) and the range-coded blocks; see :mod:`rangecoder`.  Python cuts
and encodes words; the executor's JVM codes their ids and appends the segments to the shard, and decodes them
(:mod:`jvm_coder`).  Reading deals out segments; a document's start follows from the sums of the segments
before its own, of which there is one row each.

Words are cut in numpy, a slice of many texts at once, straight from their UTF-8 bytes, numbered by Arrow's
dictionary coder, and new words are encoded by the tokenizers library, a group in a call with a byte between
them that UTF-8 does not have and nothing merges with.  Texts with the tokenizer's
special strings, or characters outside Latin and common punctuation, go to the library whole.

Null texts are empty and have the end id alone.  Null ids come last.  Rows with equal ids follow one
another by text.  Extra columns are not read.  A shard with a very large text grows a segment, not the file
system's load; a segment holds whole documents.
"""

from __future__ import annotations

import struct
import unicodedata
import uuid
import zlib
from array import array
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import jvm_coder, rangecoder
from .common import bytes_of, cut, new_path, open_fs, spread, table, text_slices

SLICE_BYTES, SEGMENT_IDS, REMEMBER, GROUP = 4_000_000, 8_000_000, 400_000, 128
#: Bytes of text of a shard, about: so their number grows with the corpus.
SHARD_BYTES = 256_000_000
NO_ID = (1 << 63) - 1
MAGIC, HEAD = b"TIDS\x02", struct.Struct("<QQQQ")
SPACE, LETTER, DIGIT, OTHER, FAR = range(5)


def _class(c: int) -> int:
    kind = unicodedata.category(chr(c))
    if chr(c) in "\t\n\x0b\x0c\r \x85\xa0":
        return SPACE
    return LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else OTHER


#: Classes of the characters below U+0250; the tables of all Unicode versions in use agree on them.
CLASSES = np.array([_class(c) for c in range(0x250)], np.uint8)


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of the rows' texts start, by the rule of the byte-level pattern
    (contractions; runs of letters, digits or others with the blank before them; white space), and the rows
    that hold characters this does not know."""
    n = len(data)
    kind = np.where(data < 0x80, CLASSES[np.minimum(data, 0x7F)], FAR).astype(np.uint8)
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        b = data[lead]
        second = data[np.minimum(lead + 1, n - 1)].astype(np.int64)
        point = ((b.astype(np.int64) & 0x1F) << 6) | (second & 0x3F)
        two = (b < 0xE0) & (point < 0x250)
        dash = (b == 0xE2) & (second == 0x80)
        third = data[np.minimum(lead + 2, n - 1)]
        dash &= (third >= 0x90) & (third <= 0xA7)  # U+2010 to U+2027
        c = np.where(two, CLASSES[np.minimum(point, 0x24F)], np.where(dash, OTHER, FAR)).astype(np.uint8)
        kind[lead] = c
        kind[np.minimum(lead + 1, n - 1)[two | dash]] = c[two | dash]
        kind[(lead + 2)[dash]] = OTHER
    strange = np.unique(np.searchsorted(offsets, np.flatnonzero(kind == FAR), "right") - 1)
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a text starts here
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    blank = data == 0x20
    # The blank before a run of letters, digits or others belongs to it.
    run = start & (kind != SPACE) & ~first[:n]
    after = np.flatnonzero(run)
    mine = after[blank[after - 1]]
    # White space before a word: its last character stands alone, or goes with the word if a blank.
    edge = after[kind[after - 1] == SPACE]
    at = edge - 1
    wide = (data[at] & 0xC0) == 0x80  # second byte of U+0085 or U+00A0
    at = at - wide
    start[at] = True
    start[mine] = False
    # Contractions: an apostrophe that starts a word and letters after it.
    tick = np.flatnonzero((data == 0x27) & start)
    tick = tick[(tick + 1 < n)]
    tick = tick[(kind[tick + 1] == LETTER) & start[tick + 1] & ~first[tick + 1]]
    if len(tick):
        one = data[tick + 1]
        two = np.where((tick + 2 < n) & ~first[np.minimum(tick + 2, n)], data[np.minimum(tick + 2, n - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        start[tick[short | long] + 1] = False
        for picked, size in ((short, 2), (long, 3)):
            end = tick[picked] + size
            end = end[end < n]
            start[end[kind[end] == LETTER]] = True
    return np.flatnonzero(start), strange


class ByteBpe:
    """Texts to ids by a byte-level BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        from .bpe import byte_chars

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.chars = str.maketrans(dict(enumerate(byte_chars())))
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._forget()
        # New words go to the library a group at a time if a byte that no UTF-8 has can stand between them: its
        # character is in no other token, so nothing merges with it.
        vocab, m = self.library.get_vocab(with_added_tokens=False), self.model
        self.between = None
        if m.dropout is None and not (m.ignore_merges or m.continuing_subword_prefix or m.end_of_word_suffix):
            c = chr(0xFF).translate(self.chars)
            if [t for t in vocab if c in t] == [c]:
                self.between = vocab[c]

    def _forget(self) -> None:
        #: The number of each word remembered; of each number, where its ids are in flat and how many.
        self.known: dict[bytes, int] = {}
        self.flat, self.begin, self.size = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and their numbers."""
        model, chars, between, ids = self.model, self.chars, self.between, array("I")
        if between is None:
            each = [[t.id for t in model.tokenize(w.decode("latin-1").translate(chars))] for w in words]
            return np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int32)
        for k in range(0, len(words), GROUP):
            ids.extend([t.id for t in model.tokenize(b"\xff".join(words[k : k + GROUP]).decode("latin-1").translate(chars))])
            ids.append(between)
        flat = np.frombuffer(ids, np.uint32)
        ends = np.flatnonzero(flat == between)
        if len(ends) != len(words):
            raise ValueError("a text is not UTF-8")
        return np.delete(flat, ends), (np.diff(ends, prepend=-1) - 1).astype(np.int32)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of different words, new ones being encoded and remembered."""
        out = np.fromiter(map(self.known.get, words, repeat(-1)), np.int32, len(words))
        fresh = np.flatnonzero(out < 0)
        if len(fresh) and len(self.known) + len(fresh) > REMEMBER:
            self._forget()
            fresh = np.arange(len(words))
        if len(fresh):
            new, n = [words[k] for k in fresh.tolist()], len(self.known)
            ids, size = self._ids(new)
            out[fresh] = np.arange(n, n + len(new))
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size, dtype=np.int32) - size])
            self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, size])
        return out

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, each followed by end, and the offsets of each text's ids."""
        n = len(texts)
        if not n:
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        data, offsets = bytes_of(texts)
        starts, strange = word_starts(data, offsets) if len(data) else (np.empty(0, np.int64), np.empty(0, np.int64))
        odd = set(strange.tolist())
        for s in self.special:
            odd |= set(np.flatnonzero(pc.match_substring(texts, s.decode()).to_numpy(zero_copy_only=False)).tolist())
        edges = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        held, at = bytes_of(coded.dictionary)
        held, at = held.tobytes(), at.tolist()
        number = self._numbers([held[a:z] for a, z in pairwise(at)]).take(coded.indices.to_numpy())
        begin, size = self.begin.take(number), self.size.take(number)
        # A text ends with the end id, one with special strings or unknown characters with all its ids and that.
        flat, place, tail, tail_size = [self.flat, np.array([end], np.uint32)], len(self.flat) + 1, np.full(n, len(self.flat), np.int32), np.ones(n, np.int32)
        first = np.searchsorted(starts, offsets)  # the first word of each text
        whole = self.library.encode_batch([texts[k].as_py() for k in sorted(odd)], add_special_tokens=False) if odd else []
        for k, e in zip(sorted(odd), whole, strict=True):
            size[first[k] : first[k + 1]] = 0
            flat.append(np.array([*e.ids, end], np.uint32))
            tail[k], tail_size[k] = place, len(e.ids) + 1
            place += len(e.ids) + 1
        begin, size = np.insert(begin, first[1:], tail), np.insert(size, first[1:], tail_size)
        ends = np.cumsum(size, dtype=np.int32)  # a slice has far fewer ids than 2^31
        source = np.arange(ends[-1], dtype=np.int32)
        source += np.repeat(begin - (ends - size), size)
        return np.concatenate(flat).take(source).astype("<u4", copy=False), np.append(0, ends[first[1:] + np.arange(n)]).astype(np.int64)


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# -- the file format


def read_segment(url: str, at: int):
    """Doc ids, numbers of tokens, prior, blocks' table and blocks of the segment that begins there in a shard."""
    fs, path = open_fs(url)
    with fs.open_input_file(path) as f:
        f.seek(at)
        head = f.read(len(MAGIC) + HEAD.size + 4)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{url} is not a token file")
        n_docs, n_ids, n_blocks, size = HEAD.unpack_from(head, len(MAGIC))
        raw = f.read(size)
        if zlib.crc32(raw) != struct.unpack("<I", head[-4:])[0]:
            raise ValueError(f"{url}: damaged directory")
        raw = zlib.decompress(raw)
        docs, counts = np.frombuffer(raw, "<i8", 2 * n_docs).reshape(2, -1)
        at = 16 * n_docs + 12 * n_blocks
        sizes, lengths, _ = np.frombuffer(raw, "<u4", 3 * n_blocks, 16 * n_docs).reshape(3, n_blocks)
        if lengths.sum(dtype=np.int64) != n_ids or counts.sum() != n_ids:
            raise ValueError(f"{url}: a directory does not have {n_ids} ids")
        return docs, counts, raw[at:], raw[16 * n_docs : at], f.read(int(sizes.sum(dtype=np.int64)))


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and returns their segments (shard, segment, path, docs, ids, at), in order of doc_id."""
    path, spark = path or default_path(), docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Each range becomes a shard of whole documents; their number follows from the measured bytes.
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    names = ["shard", "segment", "path", "last", "docs", "ids", "doc_ids", "counts", "prior", "coded"]

    def run(batches):
        bpe, url, held, ready, n = loaded(path), f"{folder}/{uuid.uuid4().hex}.ids", [], None, 0

        def segment() -> list:
            docs, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if ids.max() > 0xFFFF:
                raise ValueError("ids must lie in 0..65535")
            return [len(docs), len(ids), docs.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), rangecoder.prior_of(ids), ids.astype("<u2").tobytes()]

        def batch(last: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), n, url, last, *ready)], names=names)

        for b in batches:
            for at, to in text_slices(b.column(1), SLICE_BYTES):
                ids, offsets = bpe.encode(b.column(1).slice(at, to - at), end)
                held.append((b.column(0).slice(at, to - at).to_numpy(), np.diff(offsets), ids))
                if sum(len(h[2]) for h in held) >= SEGMENT_IDS:
                    if ready:
                        yield batch(False)
                        n += 1
                    ready = segment()
        if held:
            if ready:
                yield batch(False)
                n += 1
            ready = segment()
        if ready:
            yield batch(True)

    segments = rows.mapInArrow(run, "shard bigint, segment bigint, path string, last boolean, docs bigint, ids bigint, doc_ids binary, counts binary, prior binary, coded binary")
    at = jvm_coder.store(spark, *map(F.col, ("path", "last", "doc_ids", "counts", "prior", "coded"))).alias("at")
    return cut(segments.select("shard", "segment", "path", "docs", "ids", at), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian 32-bit) of every document."""
    earlier = Window.orderBy("shard", "segment").rowsBetween(Window.unboundedPreceding, -1)  # one row a segment
    segments = spread(manifest.select("path", "at", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("first")))
    lists = pa.list_(pa.int64())

    def run(batches):
        for b in batches:
            for url, at, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs, counts, *coded = read_segment(url, at)
                numbers = (docs, first + np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays([*(pa.array([x], lists) for x in numbers), *(pa.array([x]) for x in (*coded, counts.tobytes()))], names=["doc_id", "start", "n_tokens", "prior", "facts", "blocks", "counts"])

    coded = segments.mapInArrow(run, "doc_id array<bigint>, start array<bigint>, n_tokens array<bigint>, prior binary, facts binary, blocks binary, counts binary")
    ids = jvm_coder.decode(manifest.sparkSession, *map(F.col, ("prior", "facts", "blocks", "counts"))).alias("ids")
    out = coded.select("doc_id", "start", "n_tokens", ids).select(F.inline(F.arrays_zip("doc_id", "start", "n_tokens", "ids")))
    return out.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))


def op2_token_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(table(spark, sf_dir, "documents"), new_path(spark, "tokens"))
    return read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
