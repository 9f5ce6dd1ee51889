"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order (MD5 of seed and id), served up to
``most_repeats`` times over.  A copy's virtual finish time is the words its source has queued up to
and including it, divided by the source's target.  All copies are range-sorted by finish time and cut
where the words of the whole mix reach the budget.  All sources are cut at one time, which overlong last documents
of others move: a source ends within its longest document, and its share of the other sources' longest
documents, of its target.

Nothing is gathered in one task: running sums are made in two levels.  Rows fall into buckets of the
shuffle order (or slices of the finish time) that hold about ``ROWS_IN_BUCKET`` rows, totals of the
buckets are summed first within blocks of ``FAN`` buckets and then over blocks, and a window runs only
inside a bucket.  A source with a third of all rows therefore spreads over all tasks.  Only the table of
sources itself, a row each, is ranked in one task.

Null sources are a source of their own, last in order; null texts have size 0.  Documents of size 0
take nothing.  Equal rows are told apart by nothing and are interchangeable: each is queued.  Null
ids are shuffled by their text.  Extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, n_words, table

ROWS_IN_BUCKET, FAN, MANY_SOURCES = 512, 256, 100_000
WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, "mix-1"


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) of one row a source.

    Water filling: with caps c = repeats * size and weights w, the share a unit of weight gets is
    the level at which capped sources give c and the others w * level, together the budget.  Sorted by
    c / w, the sources capped at the end are a prefix, which two running sums find.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int")).cast("double")
    s = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))).withColumn("w_all", F.sum("w").over(Window.partitionBy()))
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    level = (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
    # The level of a prefix rises while sources that belong in it join and falls after that.
    s = s.withColumn("level", F.max(level).over(Window.partitionBy()))
    return s.select("source", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def totals_before(totals: DataFrame, group: list[str], bucket: str, value: str) -> DataFrame:
    """Adds ``before``: the sum of value over the earlier buckets of the group, by blocks of FAN."""
    t = totals.withColumn("_block", F.floor(F.col(bucket) / FAN))
    blocks = t.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(g).alias(f"_b_{g}") for g in group], F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_far"))
    inside = Window.partitionBy(*group, "_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_near", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = F.col("_block") == F.col("_b")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_b_{g}"))
    return t.join(blocks, on).select(*totals.columns, (F.col("_near") + F.col("_far")).alias("before"))


def _digest(text_col: str) -> F.Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit("")))


def queue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> tuple[DataFrame, int]:
    """Documents with size, source_size, target and ``served``, the words their source has queued up
    to and including their first copy; and the number of rows."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-1:"), _digest(text_col))))).alias("shuffle"), _digest(text_col).alias("digest"))
    base = cut(base, "mix-sizes")
    rows = base.count()
    buckets = max(1, -(-rows // ROWS_IN_BUCKET))
    place = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long")
    base = base.withColumn("bucket", F.shiftright(place * F.lit(buckets), 32))
    sizes = cut(base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    aims = cut(targets(sizes.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, repeats), "mix-targets")
    aims = bounded_broadcast(aims.withColumnRenamed("source", "_s"), aims.count(), MANY_SOURCES)
    before = totals_before(sizes, ["source"], "bucket", "bucket_size").join(aims, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "before", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("_in", F.sum("size").over(inside))
    out = base.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")), "left")
    return out.select("doc_id", "source", "size", "digest", "source_size", "target", (F.col("before") + F.col("_in")).alias("served")), rows


def finish(e) -> F.Column:
    """Virtual finish time of copy e (0-based) of a document."""
    return (F.col("served") + e * F.col("source_size")).cast("double") / F.col("target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, digest, source_size, target, copies, taken: how often and for how many words the
    mix takes each document."""
    queued, rows = queue(docs, id_col, text_col, source_col, weights, repeats, seed)
    queued = cut(queued, "mix-queue")
    copies = queued.where((F.col("size") > 0) & (F.col("target") > 0)).select("source", "size", "served", F.explode(F.array(*[finish(F.lit(e)) for e in range(repeats)])).alias("finish"))
    # Slices of the finish time are the global range sort; only totals of slices leave the tasks.
    per_unit = max(1, -(-rows // ROWS_IN_BUCKET))
    copies = copies.withColumn("slice", F.floor(F.col("finish") * per_unit))
    budget = queued.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slices = totals_before(copies.groupBy("slice").agg(F.sum("size").alias("slice_size")).withColumn("_all", F.lit(0)), ["_all"], "slice", "slice_size")
    edge = slices.where((F.col("before") <= budget) & (F.col("before") + F.col("slice_size") > budget)).first()
    if edge is None:  # the budget takes all there is
        last = (float("inf"), "", 0)
    else:
        by = Window.partitionBy("slice").orderBy("finish", F.col("source").asc_nulls_last(), "served")
        inside = copies.where(F.col("slice") == edge["slice"]).withColumn("run", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)) + edge["before"])
        first_out = inside.where(F.col("run") > budget).orderBy("finish", F.col("source").asc_nulls_last(), "served").first()
        last = (first_out["finish"], first_out["source"], first_out["served"])
    # A copy is in if it stands before the first copy that is out.
    source = F.lit(last[1]).cast("string")
    name = F.col("source").cast("string")
    source_before = F.when(source.isNull(), name.isNotNull()).otherwise(F.coalesce(name < source, F.lit(False)))
    tie = source_before | (name.eqNullSafe(source) & (F.col("served") < last[2]))
    taken = sum(((finish(F.lit(e)) < last[0]) | ((finish(F.lit(e)) == last[0]) & tie)).cast("int") for e in range(repeats))
    n = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0)
    return queued.select("doc_id", "source", "size", "digest", "source_size", F.col("target"), n.cast("int").alias("copies"), (n * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.  Rows of one id, source and text share out what is
    taken of them, as evenly as it goes."""
    plan = mix(docs, id_col, text_col, source_col, **how).where(F.col("copies") > 0)
    plan = plan.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("digest").alias("_digest")).agg(F.sum("copies").alias("_taken"))
    plan = cut(plan, "mix-plan")
    # The row travels as one struct, so that no name of its columns can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_mine"), F.col(source_col).alias("_of"), _digest(text_col).alias("_text"))
    joined = rows.join(plan.hint("merge"), F.col("_mine").eqNullSafe(F.col("_id")) & F.col("_of").eqNullSafe(F.col("_source")) & (F.col("_text") == F.col("_digest")))
    # Only if equal rows occur are they counted off; a window then holds equal rows and no others.
    same = docs.groupBy(F.col(id_col), F.col(source_col), _digest(text_col)).agg(F.count("*").alias("_n"))
    if same.where("_n > 1").isEmpty():
        joined = joined.withColumn("_copies", F.col("_taken"))
    else:
        equal = Window.partitionBy("_mine", "_of", "_text")
        joined = joined.withColumn("_n", F.count("*").over(equal)).withColumn("_k", F.row_number().over(equal.orderBy(F.to_json("_row"))))
        joined = joined.withColumn("_copies", F.floor(F.col("_taken") / F.col("_n")) + (F.col("_k") <= F.col("_taken") % F.col("_n")).cast("long"))
    joined = joined.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    return joined.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix-1:' || coalesce(doc_id::VARCHAR, '-1:' || md5(coalesce(text, '')))) AS shuffle FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM sizes),
b AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER () AS w_all,
             coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT *, max((total - cap_before) / (w_all - w_before)) OVER () AS level FROM b),
aims AS (SELECT source, source_size, least(cap, w * level) AS target FROM lv),
q AS (SELECT d.doc_id, d.source, d.size, a.source_size, a.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffle, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS served
      FROM d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
c AS (SELECT q.*, (served + e * source_size)::DOUBLE / target AS finish FROM q CROSS JOIN (SELECT unnest([0, 1, 2]) AS e) x WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, served ROWS UNBOUNDED PRECEDING) AS run FROM c),
t AS (SELECT source, served, sum(CASE WHEN run <= (SELECT sum(size) FROM d) THEN size ELSE 0 END)::BIGINT AS taken FROM r GROUP BY source, served)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN t ON q.source IS NOT DISTINCT FROM t.source AND q.served = t.served AND q.size > 0
"""
