"""Quality rules by repetition coverage.

Every text is measured once: its words are numbered by Arrow's dictionary coder, rolling hashes of
several n-gram lengths run over the numbers in numpy, and the characters that lie inside duplicated
n-grams and duplicated lines are counted, beside symbols.  Equal hashes are compared word by word before they count,
so the measures are exact.  Lines without a word count neither as lines nor as repeated ones.  Rows are independent: there is no shuffle, and a task holds one Arrow
batch, worked through in slices of a few MB.

Null and empty texts have no words and fail the base rules.  Repeated rows are judged alike.  Other
columns are ignored by :func:`measure` and kept by :func:`keep_good`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mixed, text_slices

#: n-gram length -> largest share of a text's word characters in n-grams seen earlier in the text.
#: The rule of Rae et al. 2021 (arXiv 2112.11446), table A1, each share raised by 0.05: there a good
#: short text that says one line twice would go.
NGRAM_SHARES = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
DUP_LINE_CHARS, DUP_LINES = 0.25, 0.35
#: Symbols a word at most, as in the same table.
SYMBOLS = 0.10
MIN_WORDS, BASE_NGRAM, BASE_PERCENT = 20, 8, 30
SLICE_BYTES = 2_000_000

MEASURES = pa.schema(
    [(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_lines", pa.int64()), ("line_chars", pa.int64()), ("dup_line_chars", pa.int64())]
    + [(f"dup_{n}gram_chars", pa.int64()) for n in NGRAM_SHARES]
)
DDL = ", ".join(f"{f.name} {'boolean' if f.type == pa.bool_() else 'bigint'}" for f in MEASURES)


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total words lie in one of the windows of n words at starts."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_windows(ids: np.ndarray, doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of n words that their document holds twice or more, and those of them
    that are not the first such window."""
    ends = len(ids) - n + 1
    none = np.empty(0, np.int64)
    if ends <= 1:
        return none, none
    at = np.flatnonzero(doc[:ends] == doc[n - 1 :])
    key = hashes[at] ^ mixed(doc[at])
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    same = key[1:] == key[:-1]
    if not same.any():
        return none, none
    k = np.flatnonzero(same)
    p, q = at[k], at[k + 1]
    equal = doc[p] == doc[q]
    for j in range(n):
        equal &= ids[p + j] == ids[q + j]
    if not equal.all():  # two texts share a 64-bit hash: count these windows by their words
        seen: dict[tuple, list[int]] = {}
        for i in np.sort(np.unique(np.concatenate([p, q]))).tolist():
            seen.setdefault((int(doc[i]), *ids[i : i + n].tolist()), []).append(i)
        groups = [v for v in seen.values() if len(v) > 1]
        return np.array([i for v in groups for i in v], np.int64), np.array([i for v in groups for i in v[1:]], np.int64)
    later = np.concatenate([[False], same])
    every = later | np.concatenate([same, [False]])
    return at[every], at[later]


def measures(texts: pa.Array) -> pa.RecordBatch:
    n = len(texts)
    texts = texts.fill_null("")
    total = lambda doc, x: np.bincount(doc, x, n).astype(np.int64)
    pieces = pc.ascii_split_whitespace(texts)
    doc = np.repeat(np.arange(n), np.diff(pieces.offsets.to_numpy()))
    flat = pieces.flatten()
    chars = pc.utf8_length(flat).to_numpy().astype(np.int64)
    real = chars > 0
    doc, chars, flat = doc[real], chars[real], flat.filter(pa.array(real))
    ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    out = {"n_words": np.bincount(doc, minlength=n).astype(np.int64), "word_chars": total(doc, chars)}
    out["n_symbols"] = pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy().astype(np.int64)

    lines = pc.split_pattern(texts, "\n")
    of = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    flat = lines.flatten()
    worded = pc.match_substring_regex(flat, WORD_RE2).to_numpy(zero_copy_only=False)
    long = pc.utf8_length(flat).to_numpy().astype(np.int64)
    line = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    of, line, long = of[worded], line[worded], long[worded]
    out["n_lines"], out["line_chars"] = np.bincount(of, minlength=n).astype(np.int64), total(of, long)
    order = np.lexsort((line, of))
    again = np.zeros(len(of), bool)
    again[order[1:]] = (of[order[1:]] == of[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    out["n_dup_lines"], out["dup_line_chars"] = total(of, again), total(of, again * long)

    value = mixed(ids)
    rolling = value.copy()
    for k in range(2, max(NGRAM_SHARES) + 1):
        rolling = rolling[:-1] * U64(0x9E3779B97F4A7C15 | 1) + value[k - 1 :] if len(rolling) else rolling
        if k in NGRAM_SHARES:
            every, later = repeated_windows(ids, doc, rolling, k)
            out[f"dup_{k}gram_chars"] = total(doc, _covered(later, k, len(ids)) * chars)
            if k == BASE_NGRAM:
                out["n_repeat_words"] = total(doc, _covered(every, k, len(ids)))
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * out["n_words"])
    bad = out["base_failed"] | (out["n_dup_lines"] > DUP_LINES * out["n_lines"])
    bad |= out["dup_line_chars"] > DUP_LINE_CHARS * out["line_chars"]
    bad |= out["n_symbols"] > SYMBOLS * out["n_words"]
    for k, most in NGRAM_SHARES.items():
        bad |= out[f"dup_{k}gram_chars"] > most * np.maximum(out["word_chars"], 1)
    out["kept"] = ~bad
    return pa.RecordBatch.from_arrays([pa.array(out[f.name]) for f in MEASURES], schema=MEASURES)


#: A word character as RE2 writes it.
WORD_RE2 = r"[^ \t-\r]"


def _sliced(column: pa.Array) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    for at, to in text_slices(column, SLICE_BYTES):
        yield at, to, measures(column.slice(at, to - at))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, the measures, base_failed and the verdict ``kept``."""

    def run(batches):
        for b in batches:
            for at, to, m in _sliced(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), *m.columns], names=[id_col, *MEASURES.names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {DDL}")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text the rules keep, with all columns as they are."""
    names = docs.columns

    def run(batches):
        for b in batches:
            for at, to, m in _sliced(b.column(names.index(text_col))):
                yield b.slice(at, to - at).filter(m.column("kept"))

    return docs.mapInArrow(run, docs.schema)


def op1_repetition_quality(spark, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("verdict", F.when(F.col("kept"), "keep").when(F.col("base_failed"), "base").when(F.col("n_symbols") > SYMBOLS * F.col("n_words"), "symbols").otherwise("repetition"))


def _grams(n: int) -> str:
    """Measures of n-grams in SQL: windows not the first of their words, and the characters that they cover."""
    repeat = ", count(*) FILTER (WHERE every_in) AS n_repeat_words" if n == BASE_NGRAM else ""
    return f"""
s{n} AS (SELECT doc_id, i, c, i + {n - 1} <= n AS whole, list_slice(t, i, i + {n - 1}) AS gram FROM wd),
w{n} AS (SELECT doc_id, i, c, whole AND row_number() OVER (PARTITION BY doc_id, whole, gram ORDER BY i) > 1 AS later,
                whole AND count(*) OVER (PARTITION BY doc_id, whole, gram) > 1 AS every FROM s{n}),
c{n} AS (SELECT doc_id, c, max(later::INT) OVER w = 1 AS later_in, max(every::INT) OVER w = 1 AS every_in FROM w{n}
         WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
g{n} AS (SELECT doc_id, coalesce(sum(c) FILTER (WHERE later_in), 0)::BIGINT AS dup_{n}gram_chars{repeat} FROM c{n} GROUP BY doc_id),"""


_LIMITS = " OR ".join(f"dup_{n}gram_chars > {most}::DOUBLE * greatest(word_chars, 1)" for n, most in NGRAM_SHARES.items())
SQL = (
    r"""
WITH tx AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
wd AS (SELECT doc_id, t, len(t) AS n, i, length(t[i]) AS c FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM tx) a),
wn AS (SELECT doc_id, count(*) AS n_words, sum(c)::BIGINT AS word_chars FROM wd GROUP BY doc_id),
li AS (SELECT doc_id, i, x[i] AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(x, chr(10)) AS x FROM tx) a) b
       WHERE regexp_matches(x[i], '[^\x20\x09-\x0D]')),
la AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM li),
lm AS (SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS line_chars, count(*) FILTER (WHERE again) AS n_dup_lines,
              coalesce(sum(length(line)) FILTER (WHERE again), 0)::BIGINT AS dup_line_chars FROM la GROUP BY doc_id),"""
    + "".join(map(_grams, NGRAM_SHARES))
    + f"""
al AS (SELECT tx.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols,
              coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
              coalesce(line_chars, 0) AS line_chars, coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n in NGRAM_SHARES)}
       FROM tx LEFT JOIN wn ON tx.doc_id = wn.doc_id LEFT JOIN lm ON tx.doc_id = lm.doc_id {" ".join(f"LEFT JOIN g{n} ON tx.doc_id = g{n}.doc_id" for n in NGRAM_SHARES)}),
ba AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM al),
ve AS (SELECT *, NOT (base_failed OR n_dup_lines > {DUP_LINES}::DOUBLE * n_lines OR dup_line_chars > {DUP_LINE_CHARS}::DOUBLE * line_chars
                      OR n_symbols > {SYMBOLS}::DOUBLE * n_words OR {_LIMITS}) AS kept FROM ba)
SELECT *, CASE WHEN kept THEN 'keep' WHEN base_failed THEN 'base' WHEN n_symbols > {SYMBOLS}::DOUBLE * n_words THEN 'symbols' ELSE 'repetition' END AS verdict FROM ve
"""
)
