"""The pipeline stage by stage against brute force, and all registered queries of the subpackage."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from eddystream.llm import mixing, packing, quality, queries
from tests.llm.test_text_operators import brute_groups, brute_removal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_stages_do_what_their_operators_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    step = lambda name, docs: _written(spark, stages[name](spark, docs, SF), tmp_path / name)

    good = step("quality", docs)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, *quality.classifier(docs, labels)).collect()}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == {i for i, s in scores.items() if s >= 0.5}

    single = step("near_duplicates", good)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in good.collect()]
    assert single.columns == columns
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, _, root in brute_groups(rows, 5, 80, 100) if i == root)

    cut = step("repeats", single)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in single.collect()]
    gone = {k[0]: k for k in brute_removal(rows, 200)}
    got = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == columns
    for i, text, _ in rows:
        _, n, removed, _, _ = gone[i]
        if removed == 0:
            assert got[i]["text"] == text
        elif i in got:
            assert n - removed - 6 * gone[i][3] <= len(got[i]["text"].encode()) <= n - removed and got[i]["n_chars"] == len(got[i]["text"])
        else:
            assert removed > n - 10

    mixed = step("mix", cut)
    plan = Counter()
    for r in mixing.mix(cut).collect():
        plan[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 0
    assert mixed.columns == columns and Counter(r["doc_id"] for r in mixed.collect()) == +plan

    packed = step("packing", mixed)
    slow, _ = packing.encoders("byte_bpe_50k.json")
    want = sum(len(slow.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert sum(r["length"] for r in packed.collect()) == want
    run = corpus_pipeline.run(spark, SF)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[k] for k in key) for r in run.collect()) == Counter(tuple(r[k] for k in key) for r in packed.collect())


def _written(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_and_equal_their_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    rows = got.collect()
    assert rows
    if name in queries.oracle_sql():
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations", "embeddings", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
        short = lambda r: str(tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r))
        assert sorted(map(short, rows)) == sorted(map(short, want))


def test_documents_without_an_id_are_grouped_too(spark):
    words = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    rows = [(None, words(1), "a")] * 4 + [(None, words(1) + " more", "b"), (None, words(2), "a"), (7, words(3), "a"), (None, words(3), "b"), (8, words(4), "a"), (None, "short", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.one_of_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns and got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    left = sorted((r["doc_id"] or 0, r["text"].removesuffix(" more")) for r in got.collect())
    assert left == sorted([(0, words(1)), (0, words(2)), (7, words(3)), (8, words(4)), (0, "short")])
