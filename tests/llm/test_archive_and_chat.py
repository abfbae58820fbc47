"""The archive's round trip and the views of dialogues."""

import base64
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from eddystream.llm import chat, warc

PAGE = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGE).withColumns({c: F.lit("x") for c in ("payload", "sha256", "head", "first")})


ROWS = [
    (1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (7, "http://a/7", "<p>é</p>"), (3, None, None), (4, "http://a/4", ""),
    (5, "http://a/5\r\nX: y", "x" * 300_000), (6, "http://a/6", "only"), (6, "http://a/6", "only"), (None, "http://a/n", "lone"), (None, "http://a/m", "<p>é</p>"),
    (8, "http://a/?WARC-Type: revisit", "only here"),
]


def test_the_archive_comes_back(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(pages(spark, ROWS), path)
    got = warc.read_archive(spark, path).collect()
    most: dict = {}
    for i, _, html in ROWS:
        most[html or ""] = max((x for x in (most.get(html or ""), i) if x is not None), default=None)
    want, done = [], set()
    for i, _, html in ROWS:
        data = (html or "").encode()
        response = i == most[html or ""] and (html or "") not in done  # one a payload
        done |= {html or ""} if response else set()
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else most[html or ""]))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    store = warc.read_payloads(spark, path)
    assert store.count() == len({h or "" for _, _, h in ROWS})
    records = {r["page_id"]: bytes(r["record"]) for r in warc.read_records(spark, path).collect()}
    whole = records[5]
    head, body = whole.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"X: y" not in head.split(b"\r\n")
    assert int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"]) == len(body) - 4
    ids = [warc.parse_record(bytes(r["record"]))[0]["WARC-Record-ID"] for r in warc.read_records(spark, path).collect()]
    assert len(set(ids)) == len(ROWS)
    fields, payload = warc.parse_record(records[8])
    assert fields["WARC-Type"] == "response" and payload == b"only here"
    assert body.endswith(b"x" * 300_000 + b"\r\n\r\n") and records[1].endswith(b"\r\n\r\n\r\n\r\n") and b"revisit" in records[1]


def test_small_payloads_can_all_be_responses(spark, tmp_path):
    warc.write_archive(pages(spark, ROWS), str(tmp_path / "a"), least_bytes=9)
    kinds = {r["page_id"]: r["record_type"] for r in warc.read_archive(spark, str(tmp_path / "a")).collect()}
    assert kinds[6] == kinds[4] == kinds[3] == "response" and kinds[1] == "revisit" and kinds[7] == "response"


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "b")
    warc.write_archive(pages(spark, ROWS), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("sha1", F.reverse("sha1"))
    bad.write.parquet(f"{path}/payloads2")
    (tmp_path / "b" / "payloads").rename(tmp_path / "b" / "old")
    (tmp_path / "b" / "payloads2").rename(tmp_path / "b" / "payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, path).collect()


def test_an_empty_archive(spark, tmp_path):
    warc.write_archive(pages(spark, []), str(tmp_path / "c"))
    assert warc.read_archive(spark, str(tmp_path / "c")).count() == 0


TURN = "conv_id long, turn long, role string, text string"
TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hé <|end|>"), (1, 3, "ann", None), (1, 70, "bob", "late"), (2, 0, "system", "alone"),
    (3, None, None, ""), (3, 1, "ann", "x"), (3, 1, "ann", "x"), (None, 0, "ann", "lost"), (4, 0, "ann", "y" * 100_000),
]


def turns(spark, rows):
    return spark.createDataFrame(rows, TURN).withColumns({c: F.lit("z") for c in ("said", "block", "participant", "parts", "conv", "mask")})


def test_every_participant_has_a_view(spark):
    got = {(r["conv_id"], r["participant"]): r for r in chat.perspectives(turns(spark, TURNS)).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (3, "unknown"), (3, "ann"), (None, "ann"), (4, "ann")}
    view = got[1, "ann"]
    assert view["text"] == "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi<|end|>\n<|user name=bob|>\nHé <|end|><|end|>\n<|assistant|>\n<|end|>\n<|user name=bob|>\nlate<|end|>\n"
    assert [view["text"][m["start"] : m["start"] + m["length"]] for m in view["mask"]] == ["Hi<|end|>\n", "<|end|>\n"]
    assert (view["n_turns"], view["n_own"]) == (5, 2) and got[3, "ann"]["n_turns"] == 3
    assert chat.perspectives(turns(spark, [])).count() == 0


def test_views_equal_their_sql(spark):
    rows = TURNS + [(9, i, ("u1", "u2", "system", "u3")[i % 4], f"turn {i}") for i in range(200)]
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = chat.perspectives(turns(spark, rows))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("+", m["start"].cast("string"), m["length"].cast("string"))), ",")
    got = got.withColumn("mask", spans)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({chat.OP4_SQL})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_a_long_dialogue_is_one_view_a_participant(spark):
    rows = TURNS + [(9, i * 3 - 90, ("u1", "u2", "system", "u3")[i % 4], f"turn {i}é") for i in range(200)] + [(9, None, "u2", "first"), (9, None, None, None)]
    rows += [(10, None, "ab"[i % 2], f"{i:03}") for i in range(300)]  # turns without a number, in bulk
    got = chat.perspectives(turns(spark, rows)).collect()
    views = {(r["conv_id"], r["participant"]): r for r in got}
    assert len(views) == len(got)
    want = set()
    for conv in {c for c, *_ in rows}:
        said = sorted(((t is not None, t or 0, r or "unknown", x or "") for c, t, r, x in rows if c == conv))
        for who in {r for _, _, r, _ in said} - {"system"}:
            want.add((conv, who))
            text, mask = "", []
            for _, _, r, x in said:
                text += "<|assistant|>\n" if r == who else "<|system|>\n" if r == "system" else f"<|user name={r}|>\n"
                mask += [(len(text), len(x) + 8)] if r == who else []
                text += x + "<|end|>\n"
            view = views[conv, who]
            assert view["text"] == text and [tuple(m) for m in view["mask"]] == mask
            assert (view["n_turns"], view["n_own"]) == (len(said), len(mask))
    assert set(views) == want and chat.perspectives(turns(spark, [])).count() == 0
