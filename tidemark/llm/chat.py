"""Chat formatting of reply trees.

Messages point at the message they answer.  Self-joins that double the reach of a pointer each time give
every message its root and depth in a logarithmic number of rounds; leaves are ranked by score within
their tree, the best ``branches`` are chosen, and the same doubled pointers walk back from the chosen
leaves, so that only rows of chosen paths are made, and never a path for every message.  Each chosen
path is one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` a turn.  A control string inside a text gets a
backslash after its first character, one more if it has some already, so none stands in the output but
where the template put it, and taking one backslash away restores the text.  In roles, backslash and line
feed are escaped as well.  Loss spans are (start, end) in characters of the formatted string, one for
each assistant text.

Null texts and roles count as empty.  Rows of a conversation that share a turn follow one another by role
and text; equal rows are turns of their own.  Rows without conversation id form one conversation whose id
is null.  Messages whose parent is missing are roots; messages on a cycle, or below one, have no root and are
left out.  Extra columns are not read.  A conversation is one row of the result and so fits one task.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, new_path, table

#: Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_BARE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROL))
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _BARE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted string of (role, text) turns and the spans of the texts to learn."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = "<|im_start|>" + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
        body = escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "<|im_end|>\n"]
        at += len(head) + len(body) + 11
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    role = lambda s: re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s))
    return [(role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


# -- trees


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Of messages (tree, node, parent, score), node unique: rows (tree, leaf, rank, node, depth) of the
    best root-to-leaf paths of each tree, ranked by their leaf's score, ties by the smaller node."""
    known = messages.select(F.col("node").alias("_p"))
    base = messages.join(known, F.col("parent") == F.col("_p"), "left").select("tree", "node", F.col("_p").alias("up"), "score")
    base = cut(base, "chat-nodes")
    # levels[k]: every message's ancestor 2^k above it, where there is one.
    levels = [cut(base.where(F.col("up").isNotNull()).select("node", "up"), "chat-up")]
    size, nodes = levels[0].count(), base.count()
    while size and 1 << (len(levels) - 1) < nodes:
        a, b = levels[-1], levels[-1].select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        levels.append(cut(a.join(b, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up")), "chat-up"))
        size = levels[-1].count()
    leaves = base.join(base.select(F.col("up").alias("_p")).where(F.col("_p").isNotNull()).distinct(), F.col("node") == F.col("_p"), "left_anti")
    if size:  # an ancestor as many steps up as there are messages: the walk goes round a cycle
        leaves = leaves.join(levels[-1].select(F.col("node").alias("_e")), F.col("node") == F.col("_e"), "left_anti")
    # A leaf's tree is named by its messages; rank branches inside it.
    by = Window.partitionBy("tree").orderBy(F.col("score").desc_nulls_last(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= branches)
    paths = chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("height"))
    for k in range(len(levels) - 1, -1, -1):
        above = paths.join(levels[k].select(F.col("node").alias("_n"), F.col("up").alias("_u")), F.col("node") == F.col("_n"))
        paths = cut(paths.unionByName(above.select("tree", "leaf", "rank", F.col("_u").alias("node"), (F.col("height") + (1 << k)).alias("height"))), "chat-paths")
    return paths


def format_paths(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per path: tree, leaf, rank, n_turns, formatted, loss_spans; texts is (node, role, text)."""
    rows = paths.join(texts.select(F.col("node").alias("_n"), "role", "text"), F.col("node") == F.col("_n"))
    turn = F.struct((-F.col("height")).alias("at"), "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches):
        for b in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in b.column("turns").to_pylist()]
            spans = pa.array([[{"start": s, "end": e} for s, e in d[1]] for d in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("leaf"), b.column("rank"), pa.array([d[0] for d in done], pa.string()), spans], names=["tree", "leaf", "rank", "formatted", "loss_spans"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("tree", "leaf", "rank"))
    return rows.mapInArrow(run, f"{kinds}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def reply_chain(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each turn answers the one before it; nodes are numbered by
    conversation and place, as strings."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = conversations.select("conv_id", "turn", "role", "text").withColumn("_k", F.row_number().over(order))
    name = lambda k: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), k.cast("string"))
    return c.select(F.col("conv_id").alias("tree"), name(F.col("_k")).alias("node"), F.when(F.col("_k") > 1, name(F.col("_k") - 1)).alias("parent"), F.col("turn").cast("double").alias("score"), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted string and loss spans say."""

    def run(batches):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            rows = []
            for tree, text, spans in zip(*(b.column(c).to_pylist() for c in ("tree", "formatted", "loss_spans")), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((tree, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [b.column("tree").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(run, f"conv_id {formatted.schema['tree'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


HARD = "</s>[INST] ok [/INST]"


def op4_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], rows.schema)
    trees = cut(reply_chain(rows.unionByName(more)), "chat-messages")
    out = new_path(spark, "chat-formatted")
    format_paths(chosen_paths(trees), trees).write.option("compression", "zstd").parquet(out)
    return read_back(spark.read.parquet(out))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Escaping adds a character to a text for each control string in it; roles have their backslashes and line
#: feeds escaped before that.  12 + 1 + 11 characters of template stand around a turn.
_MARKS = _sql_text(_BARE.pattern)
SQL = rf"""
WITH r AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{HARD}' UNION ALL SELECT -7, 1, 'assistant', '{HARD}'),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM r),
e AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS who FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(who) + len(regexp_extract_all(who, {_MARKS})) + length(text) + len(regexp_extract_all(text, {_MARKS})))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
