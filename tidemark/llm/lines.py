"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of ``WINDOW`` neighbouring lines puts a boundary after a line where it
is smaller than at the line before and not larger than at the line after.  Boundaries follow the lines around
them and not their place in the text, so a passage that two texts share is cut alike in both; no two
are neighbours and none cuts off a first or last line, so every chunk has two lines or more but that of a text
of one line, which stays.  A chunk of two lines or more that occurs again, anywhere, is removed, all but its
first occurrence (smallest doc_id, then place).

Chunks are grouped by their text, so equality is equality of bytes, and partial aggregation shrinks a
passage with a million copies to a row a task before the shuffle.  The verdicts go back by the MD5 of
the chunk and carry no text; should two texts ever share an MD5, neither is removed.  That join is on
a skewed key, for which Spark splits the large side; no task gathers a group.

Rows with equal doc_id and equal text are one document and are treated alike.  Null texts stay null;
null ids count as the largest id.  Other columns pass through, whatever their names.  A text all of
whose chunks go becomes empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

WINDOW, MIN_LINES = 2, 2
PRIME, BASE = 2_147_483_647, 1_000_003
NO_ID = (1 << 63) - 1


def _hash31(text) -> F.Column:
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def let(value, body) -> F.Column:
    """body(value) with value worked out once a row: an expression inlined in a lambda would be worked
    out again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks_of(text, window: int = WINDOW) -> F.Column:
    """The chunks of a text column in order, each an array of lines; time linear in the lines."""

    def rolling(h, i):
        value = F.lit(0).cast("long")
        for back in range(window - 1, -1, -1):
            value = (value * F.lit(BASE) + F.coalesce(F.get(h, i - F.lit(1 + back)), F.lit(0))) % F.lit(PRIME)
        return value

    def cut_at(lines, ends):
        start = lambda k: F.coalesce(F.get(ends, k - F.lit(1)), F.lit(0))
        return F.transform(ends, lambda e, k: F.slice(lines, start(k) + F.lit(1), e - start(k)))

    def ends_of(r):
        n, at = F.size(r), lambda i: F.get(r, i - F.lit(1))
        least = lambda i: (at(i) < at(i - F.lit(1))) & (at(i) <= at(i + F.lit(1)))
        return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | ((i >= 2) & (i <= n - 2) & least(i)))

    roll = lambda h: F.transform(F.sequence(F.lit(1), F.size(h)), lambda i: rolling(h, i))
    return let(F.split(text, "\n", -1), lambda lines: let(F.transform(lines, _hash31), lambda h: let(roll(h), lambda r: let(ends_of(r), lambda ends: cut_at(lines, ends)))))


def _keys(id_col: str, text_col: str) -> list[F.Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_d"), F.md5(F.col(text_col)).alias("_m")]


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_d, _m (the document's key) and _drop, the 0-based numbers of the chunks to remove."""
    texts = docs.where(F.col(text_col).isNotNull()).select(*_keys(id_col, text_col), F.col(text_col).alias("_t"))
    rows = texts.select("_d", "_m", F.posexplode(chunks_of(F.col("_t"))).alias("_k", "_c")).where(F.size("_c") >= MIN_LINES).select("_d", "_m", "_k", F.array_join("_c", "\n").alias("_chunk"))
    place = F.struct("_d", "_m", "_k")
    firsts = rows.groupBy("_chunk").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    firsts = firsts.groupBy(F.md5("_chunk").alias("_key")).agg(F.min("_first").alias("_first"), F.count("*").alias("_texts")).where(F.col("_texts") == 1).select("_key", "_first")
    firsts = cut(firsts, "first-chunks")  # then the join below has two plain shuffles, which Spark can split
    again = rows.select("_d", "_m", "_k", F.md5("_chunk").alias("_key")).join(firsts, "_key").where(place != F.col("_first"))
    return again.groupBy("_d", "_m").agg(F.collect_set("_k").alias("_drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated chunks gone from the text, and n_lines, n_removed_lines, n_removed_chunks."""
    drop = repeated_chunks(docs, id_col, text_col)
    row = F.col("_row")
    # The row travels as one struct, so that no name of its columns can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[k.alias(n) for k, n in zip(_keys(id_col, text_col), ("_rd", "_rm"), strict=True)])
    joined = rows.join(drop, (F.col("_rd") == F.col("_d")) & (F.col("_rm") == F.col("_m")), "left")
    t = row[text_col]
    # Numbers that stay come from one hashed difference, so a text of many chunks takes time in proportion.
    stay = lambda c: F.array_except(F.sequence(F.lit(0), F.size(c) - 1), F.coalesce(F.col("_drop"), F.array().cast("array<int>")))
    kept = let(chunks_of(t), lambda c: F.transform(stay(c), lambda k: F.get(c, k)))
    n_lines = F.when(t.isNull(), 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"))) + 1).cast("long")
    new = F.when(F.col("_drop").isNull(), t).otherwise(F.array_join(F.flatten(kept), "\n"))
    left = F.when(F.col("_drop").isNull(), n_lines).otherwise(F.size(F.flatten(kept)).cast("long"))
    out = joined.select("_row", new.alias("_new"), left.alias("_left"), F.coalesce(F.size("_drop"), F.lit(0)).alias("_chunks"))
    return out.select(*[F.col("_new").alias(c) if c == text_col else row[c].alias(c) for c in docs.columns], n_lines.alias("_n_lines"), (n_lines - F.col("_left")).alias("_n_removed"), F.col("_chunks").alias("_n_chunks"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed_lines"), F.col("_n_chunks").cast("long").alias("n_removed_chunks"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("kept_md5"))


CLEAN_CTE = r"""
ln AS (SELECT doc_id, i, t[i] AS line, ('0x' || md5(t[i])[1:7])::BIGINT AS h FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM src WHERE text IS NOT NULL) a) b),
ro AS (SELECT *, (coalesce(lag(h) OVER w, 0) * 1000003 + h) % 2147483647 AS r, count(*) OVER (PARTITION BY doc_id) AS n_doc FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
en AS (SELECT *, i BETWEEN 2 AND n_doc - 2 AND r < lag(r) OVER w AND r <= lead(r) OVER w AS e FROM ro WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
nu AS (SELECT *, (coalesce(sum(e::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS k FROM en),
ch AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM nu GROUP BY doc_id, k),
rk AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY chunk, n >= 2 ORDER BY doc_id, k) > 1 AS gone FROM ch),
cleaned AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines, count(*) FILTER (gone) AS n_removed_chunks,
            coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept FROM rk GROUP BY doc_id)
"""
SQL = "WITH src AS (SELECT doc_id, text FROM documents)," + CLEAN_CTE + """
SELECT s.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed_lines, 0) AS n_removed_lines, coalesce(c.n_removed_chunks, 0) AS n_removed_chunks,
       length(c.kept) AS n_chars, md5(c.kept) AS kept_md5 FROM src s LEFT JOIN cleaned c ON s.doc_id = c.doc_id
"""
