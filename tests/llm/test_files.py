"""WARC archives and chat formatting."""

import base64
import hashlib
import io
import random
import struct
import zipfile

import pytest

from tidemark.llm import chat, common, warc
from tidemark.llm.common import new_path

KIND = "page_id long, url string, html string"


def pages(rng):
    same = "<p>copy</p>" * 50
    out = [(0, "http://a/ é?x=1", None), (1, None, ""), (2, "http://b", same), (3, "http://c\r\nX: y", "<h1>ü\r\n\r\nWARC/1.1</h1>"), (None, "http://n", same)]
    out += [(10 + i, f"http://h/{i}", same if i % 3 == 0 else f"<p>{rng.random()}</p>") for i in range(60)]
    return [*out, (10, "http://h/again", same), (69, "http://big", "é" * 300_000), (69, "http://big", "é" * 300_000)]


def want(rows):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, u, h in rows:
        b, head = (h or "").encode(), top[h or ""]
        first = (-1 if i is None else i) == head
        out.append((i, u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else head, b if first else None))
    return sorted(out, key=repr)


def test_archives(spark):
    rows = pages(random.Random(1))
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS key", "2 AS payload").repartition(3)
    folder = new_path(spark, "warc")
    manifest = warc.write_archives(df, folder)
    got = sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in warc.read_archives(manifest).collect()), key=repr)
    assert got == want(rows)
    path = manifest.first()["path"].removeprefix("file://")
    with zipfile.ZipFile(path) as z:  # other readers take it as well
        assert {i.filename: i.compress_type for i in z.infolist()} == {warc.DATA: 0, warc.INDEX: 0} and z.testzip() is None
    none = warc.write_archives(df.limit(0), new_path(spark, "warc"))
    assert none.count() == 0 == warc.read_archives(none).count()


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], KIND)
    out = warc.read_archives(warc.write_archives(df, new_path(spark, "warc"), min_bytes=3))
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in out.collect()) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_urls_come_back_as_they_were(spark):
    urls = ["http://a/b%20c?x=%2F", "http://a/b c", "http://é/ü", "u\r\nInjected: 1", "", None, "%", "http://a/it's"]
    rows = [(k, u, f"page {k}") for k, u in enumerate(urls)] + [(0, "u", "other payload of the same page")]
    manifest = warc.write_archives(spark.createDataFrame(rows, KIND).repartition(2), new_path(spark, "warc"))
    assert sorted(((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in warc.read_archives(manifest).collect()), key=repr) == sorted(rows, key=repr)
    assert warc.record(1, "http://a/b%20c", b"", None, False).count(b"http://a/b%20c\r\n") == 1
    ids = {warc.record(i, u, t.encode(), None, False).split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for i, u, t in rows}
    assert len(ids) == len(rows)


def test_zip64_directory():
    """Sizes and places that are moved to the ZIP64 fields, as in packages over 4 GB."""
    data = b"hello"
    local = warc.LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + b"x" + struct.pack("<HHQQ", 1, 16, 5, 5)
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    entry = warc.ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"x" + extra
    start = len(local) + len(data)
    end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    tail = warc.LOCATOR64 + struct.pack("<IQI", 0, start + len(entry), 1) + warc.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = local + data + entry + end64 + tail
    at, size = warc.members(io.BytesIO(raw), len(raw))["x"]
    assert raw[at : at + size] == data


def test_damaged_records_are_found():
    raw = warc.record(1, "u", b"payload", None, False)
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r\n", b"pay10ad\r\n"))
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"x" * 100), 100)


# -- chat


NASTY = ["", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<\\s> <\\\\s>", "\\", "<", "<<SYS>>[/INST]", "a\nb", "[\\INST]", "<<s>/s>", "\\n"]


def test_escapes_are_reversible():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice([*NASTY, *"<>|/s\\[]I", "im_end"]) for _ in range(rng.randrange(8)))
        e = chat.escape(text)
        assert chat.unescape(e) == text and not any(c in e for c in chat.CONTROL)


def test_formats_are_reversible():
    rng = random.Random(3)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "sys\ntem", "<|im_end|>", "\\n", ""]), rng.choice(NASTY) + rng.choice(NASTY)) for _ in range(rng.randrange(6))]
        text, spans = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_linear_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "user", None), (2, 5, None, "x"), (2, 5, None, "x"), (None, 0, "user", "n"), (3, 0, "assistant", NASTY[1])]
    rows += [(9, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS node", "2 AS tree").repartition(3)
    trees = chat.reply_chain(df)
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_paths(chat.chosen_paths(trees), trees)).collect()}
    assert len(out) == 5
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in (1, 2, 3, 9, None):
        turns = [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert tuple(out[conv])[:5] == (conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    assert chat.format_paths(chat.chosen_paths(trees.limit(0)), trees).count() == 0


def test_branches_are_ranked_by_score(spark):
    nodes = [("r", None, 0.0), ("a", "r", 1.0), ("b", "r", 2.0), ("a1", "a", 5.0), ("b1", "b", 3.0), ("b2", "b", 3.0), ("x", "gone", None), ("c1", "c2", 9.0), ("c2", "c1", 9.0)]
    df = spark.createDataFrame([("t" if n[0][0] != "x" else "u", *n) for n in nodes], "tree string, node string, parent string, score double")
    got = {}
    for r in chat.chosen_paths(df, branches=2).collect():
        got.setdefault((r["tree"], r["rank"]), []).append((-r["height"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {("t", 1): ["r", "a", "a1"], ("t", 2): ["r", "b", "b1"], ("u", 1): ["x"]}


def test_messages_below_a_cycle_are_left_out(spark):
    """A leaf below a cycle, a longer cycle, a message that answers itself, and a deep chain."""
    nodes = [("a", "b", 9.0), ("b", "a", 9.0), ("leaf", "a", 99.0), ("r", None, 0.0), ("x", "r", 1.0), ("self", "self", 5.0), ("under", "self", 50.0)]
    nodes += [(f"c{k}", f"c{(k + 1) % 7}", 7.0) for k in range(7)] + [("tail0", "c3", 70.0), ("tail1", "tail0", 71.0)]
    nodes += [(f"d{k}", f"d{k - 1}" if k else None, float(k)) for k in range(40)]
    df = spark.createDataFrame([("t", *n) for n in nodes], "tree string, node string, parent string, score double")
    got = {}
    for r in chat.chosen_paths(df, branches=9).collect():
        got.setdefault(r["rank"], []).append((-r["height"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {1: [f"d{k}" for k in range(40)], 2: ["r", "x"]}


def test_branches_of_a_tree_read_back(spark):
    rng, rows = random.Random(6), []
    for tree in range(4):
        for k in range(12):
            rows.append((tree, f"{tree}.{k}", f"{tree}.{rng.randrange(k)}" if k else None, float(rng.randrange(5)), ("user", "assistant")[k % 2], rng.choice(NASTY)))
    df = spark.createDataFrame(rows, "tree long, node string, parent string, score double, role string, text string")
    formatted = chat.format_paths(chat.chosen_paths(df, branches=3), df)
    got = {(r["tree"], r["rank"]): chat.parse_turns(r["formatted"]) for r in formatted.collect()}
    by = {r[1]: r for r in rows}
    for tree in range(4):
        leaves = [r for r in rows if r[0] == tree and not any(o[2] == r[1] for o in rows)]
        for rank, leaf in enumerate(sorted(leaves, key=lambda r: (-r[3], r[1]))[:3], 1):
            path, at = [], leaf
            while at:
                path.append((at[4], at[5]))
                at = by.get(at[2])
            assert got.pop((tree, rank)) == path[::-1]
    assert not got


def test_clean_deletes_what_operators_left(spark, monkeypatch):
    monkeypatch.setattr(common, "_made", [])
    assert new_path(spark, "x") != new_path(spark, "x")
    kept = common.cut(spark.range(3), "rest")
    assert kept.count() == 3 and common.clean(spark) == 1 and common._made == []
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0])
