"""Vector search, vector near-duplicates, components and the link graph against brute force."""

import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eddystream.llm import cap_filters, components, link_graph, stable_knn
from eddystream.llm.vectors import unit

VEC = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VEC)
    return df.withColumns({c: F.lit("x") for c in ("id", "v", "cls", "size", "dim", "cell", "f", "query_id", "score")})


def awkward(dim):
    return [(None, np.ones(dim)), (9001, None), (9002, np.zeros(dim)), (9003, [float("nan")] * dim), (9004, [None] * dim), (9005, []), (9006, np.ones(dim + 1)), (9020, np.ones(dim + 1))]


def family(n, dim, seed, near):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    out = [*base]
    for i in range(0, n, 3):
        out += [base[i] + near * rng.normal(size=dim) for _ in range(i % 5)]
    out += [base[0]] * 7 + [3 * base[1]]
    return [(i, v) for i, v in enumerate(np.float32(out))]


# ---- near-duplicates ---------------------------------------------------------


@pytest.mark.parametrize(("dim", "part"), [(64, 4096), (64, 16), (5, 4096), (1, 4096)])
def test_cap_filters_find_the_links(spark, dim, part):
    rows = family(150, dim, dim, 0.2)
    x = unit(np.array([v for _, v in rows], np.float64))
    ok = x @ x.T >= 0.9
    np.fill_diagonal(ok, False)
    got = {r["vec_id"]: r for r in cap_filters.near_vectors(vectors(spark, rows + awkward(dim)), part=part).collect()}
    assert len(got) == len(rows) + 8
    links = np.array([got[i]["n_links"] for i, _ in rows])
    assert (links <= ok.sum(1)).all() and links.sum() >= 0.95 * ok.sum()
    if (links == ok.sum(1)).all():
        up = np.arange(len(rows))
        while True:
            new = np.minimum(up, np.where(ok, up, len(rows)).min(1))
            if (new == up).all():
                break
            up = new
        assert [got[i]["component_id"] for i, _ in rows] == up.tolist()
    assert got[None]["n_links"] == 0 and got[None]["kept"] and got[9001]["component_id"] == 9001
    assert got[9006]["n_links"] == got[9020]["n_links"] == 1 and got[9020]["component_id"] == 9006 and not got[9020]["kept"]


def test_cap_filters_on_repeats_and_nothing(spark):
    v = np.arange(1, 65)
    got = cap_filters.near_vectors(vectors(spark, [(1, v), (1, v), (2, v), (3, -v)])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert cap_filters.near_vectors(vectors(spark, [])).count() == 0


def test_list_decoding_is_complete():
    code = cap_filters.Code(12, 3, 9, 0.3)
    x = unit(np.random.default_rng(0).normal(size=(40, 12)))
    row, number = code.decode(x)
    y = x @ code.turn
    want = set()
    for i in range(9):
        for j in range(9):
            for k in range(9):
                c = np.concatenate([code.code[0][i], code.code[1][j], code.code[2][k]])
                want |= {(int(r), (i * 9 + j) * 9 + k) for r in np.flatnonzero(y @ c >= 0.3)}
    assert set(zip(row.tolist(), number.tolist(), strict=True)) == want


@pytest.mark.parametrize("dim", [1, 2, 3, 5, 8, 10, 12, 16, 32, 64, 128])
@pytest.mark.parametrize("n", [1000, 51_000, 1_000_000, 100_000_000])
def test_pairs_at_the_threshold_meet_at_any_size(dim, n):
    rng = np.random.default_rng(77)
    x, side = unit(rng.normal(size=(1000, dim))), rng.normal(size=(1000, dim))
    side -= (side * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * unit(side) if dim > 1 else x
    code = cap_filters.make_code(dim, n, 0.9)
    seen = [set(zip(*(a.tolist() for a in code.decode(v)), strict=True)) for v in (x, y)]
    assert len({row for row, _ in seen[0] & seen[1]}) >= 0.97 * len(x)
    if dim >= 16:  # and caps stay small
        assert len(seen[0]) / len(x) / code.caps * n <= 2 * cap_filters.LOAD


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.sets(st.tuples(st.integers(0, 11), st.integers(0, 30))), st.sets(st.tuples(st.integers(0, 11), st.integers(0, 11))))
def test_pairs_that_share_a_cap(n, caps, pairs):
    caps, truth = sorted((r, c) for r, c in caps if r < n), np.zeros((n, n), bool)
    for a, b in pairs:
        if a < n and b < n and a != b:
            truth[a, b] = truth[b, a] = True
    got = cap_filters.sharing(truth, np.array([r for r, _ in caps], np.int64), np.array([c for _, c in caps], np.int64), 31)
    held = [{c for r, c in caps if r == i} for i in range(n)]
    assert all(got[a, b] == bool(held[a] & held[b]) for a, b in zip(*np.nonzero(truth), strict=True))


def test_many_close_pairs_of_short_vectors_are_found(spark):
    n = 10_000
    base = spark.range(n).select("id", F.array(*(F.randn(s) for s in range(8))).alias("x"))
    df = base.select(F.explode(F.array("id", F.col("id") + n)).alias("vec_id"), F.transform("x", lambda v: v.cast("float")).alias("embedding"))
    df = df.withColumn("embedding", F.when(F.col("vec_id") >= n, F.transform("embedding", lambda v: v * F.lit(1.01).cast("float") + F.lit(0.001).cast("float"))).otherwise(F.col("embedding")))
    got = cap_filters.near_vectors(df)
    assert got.where("vec_id >= 10000 and (n_links = 0 or kept)").count() <= 0.01 * n


# ---- nearest -----------------------------------------------------------------


@pytest.mark.parametrize(("dim", "cell", "block"), [(16, 16_384, 32_768), (16, 100, 40), (2, 50, 1000)])
def test_stable_projections_find_the_nearest(spark, monkeypatch, dim, cell, block):
    monkeypatch.setattr(stable_knn, "CELL", cell)
    monkeypatch.setattr(stable_knn, "BLOCK", block)
    rows = family(700, dim, 3, 0.1)
    x = np.array([v for _, v in rows], np.float64)
    got: dict = {}
    for r in stable_knn.nearest(vectors(spark, rows + awkward(dim))).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i, _ in rows if i % 20 == 0]
    assert sorted(got) == [*asked, 9020] and [v for _, v, _ in got[9020]] == [9006]
    hit = 0
    for q in asked:
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        score = x @ x[q]
        assert all(s == pytest.approx(score[v], rel=1e-12) for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        score[q] = -np.inf
        hit += len({v for _, v, _ in found} & set(np.lexsort((np.arange(len(x)), -score))[:20].tolist()))
    assert hit >= 0.95 * 20 * len(asked)


def test_rows_that_repeat_an_id_are_rows_of_their_own(spark):
    got = stable_knn.nearest(vectors(spark, [(1, [5, 0]), (1, [2, 0]), (20, [1, 0]), (20, [1, 0]), (40, [0, 1])])).collect()
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)
    of_20 = [(20, 1, 1, 5.0), (20, 2, 1, 2.0), (20, 3, 20, 1.0), (20, 4, 40, 0.0)]
    assert found == sorted(of_20 * 2 + [(40, 1, 1, 0.0), (40, 2, 1, 0.0), (40, 3, 20, 0.0), (40, 4, 20, 0.0)])
    got = cap_filters.near_vectors(vectors(spark, [(1, [5, 0]), (1, [0, 3]), (1, [0, 3]), (2, [2, 0]), (3, [1, 0]), (4, [0, 1])])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 1)]


def test_stable_projections_on_few_rows(spark):
    got = stable_knn.nearest(vectors(spark, [(0, [1, 0]), (1, [2, 0]), (2, [2, 0]), (40, [0, 1])])).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 40, 0.0), (40, 1, 0, 0.0), (40, 2, 1, 0.0), (40, 3, 2, 0.0)]
    assert stable_knn.nearest(vectors(spark, [])).count() == 0


def test_chi_square_bounds():
    for p, m, want in ((0.95, 8, 15.507), (0.99, 1, 6.635), (0.5, 2, 1.386)):
        assert stable_knn.chi_square_bound(p, m) == pytest.approx(want, abs=1e-3)


# ---- components --------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(300 + i, 301 + i) for i in range(60)] + [(5, 5), (None, 3)] + [(400, 500 + i) for i in range(50)]
    up = {x: x for e in edges for x in e if x is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = components.components(spark.createDataFrame(edges, "x long, y long"), "test").collect()
    assert {r["node"]: r["component"] for r in got} == {i: root(i) for i in linked} and len(got) == len(linked)


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "x long, y long"), "none").count() == 0


# ---- link graph --------------------------------------------------------------

PAGE = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGE).withColumns({c: F.lit("x") for c in ("host", "path", "rule", "trust", "src", "dst", "good")})


def linked_pages():
    a = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    return [
        (1, "http://spam.com/en/1", ""), (2, "http://Farm.xyz/a", a("http://spam.com/en/2", "//spam.com/x")),
        (3, "https://feeder.xyz/", a("http://farm.xyz/")), (4, "http://good.net/de/5?q#f", a("https://friend.xyz/p?x", "/local")),
        (5, "http://friend.xyz/p", a("HTTP://other.xyz")), (6, "http://other.xyz/", None), (7, None, a("http://spam.com/")), (8, "no host", ""),
        (9, "http://www.example.com/en/77", ""), (9, "http://www.example.com/en/77", ""), (10, "http://com/en/x", ""), (11, "http://x.example.net/de/88#t", ""),
        (12, "http:///en/", ""), (None, "http://notcom/en/1", ""), (13, "http://friend.xyz/en/", a("http://spam.com")),
    ]


def test_rules_and_links_decide(spark):
    got = {r["page_id"]: r for r in link_graph.judge(pages(spark, linked_pages())).collect()}
    rule = {i: (r["rule"], r["verdict"]) for i, r in got.items()}
    assert rule[1] == ("com/en/", "block") and rule[9] == ("example.com/en/7", "allow") and rule[4] == ("net/de/", "allow")
    assert rule[11] == ("example.net/de/8", "block") and rule[10] == ("com/en/", "block")
    assert rule[7] == rule[8] == rule[12] == rule[None] == (None, "allow")
    assert got[4]["host"] == "good.net" and got[4]["path"] == "/de/5" and got[2]["host"] == "farm.xyz"
    assert rule[2] == (None, "block") and got[3]["distrust"] > 0  # it links to what is blocked; distrust goes on against the links
    assert got[5]["trust"] > 0 and got[6]["trust"] > 0 and rule[6] == (None, "allow")
    assert len(link_graph.judge(pages(spark, linked_pages())).collect()) == len(linked_pages())


def test_link_graph_equals_its_sql(spark):
    rng = random.Random(1)
    hosts = [f"h{i}.{d}" for i in range(12) for d in ("com", "net", "org", "xyz")]
    rows = linked_pages()
    for i in range(20, 220):
        links = "".join(f'<a href="http://{rng.choice(hosts)}/en/{i}">' for _ in range(rng.randint(0, 5)))
        rows.append((i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es'])}/{i}", links))
    tolerance = link_graph.LEAST // 4  # fewer rounds
    got = link_graph.judge(pages(spark, rows), tolerance=tolerance)
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({link_graph.sql(tolerance)})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert any(r[3] is None and r[4] == "block" for r in want)


def test_farms_of_any_size_and_the_hosts_near_a_blocked_one_are_blocked(spark):
    a = lambda *to: "".join(f'<a href="http://{t}/">x</a>' for t in to)
    rows = [(0, "http://spam.com/en/1", ""), (1, "http://good.net/de/1", a("plain.xyz"))]
    rows += [(100 + i, f"http://farm{i}.xyz/", a("spam.com")) for i in range(400)]
    rows += [(1000 + i, f"http://chain{i}.xyz/", a(f"chain{i - 1}.xyz" if i else "spam.com")) for i in range(30)]
    rows += [(2000, "http://plain.xyz/", a("spam.com", *(f"other{i}.xyz" for i in range(9))))]
    judged = link_graph.judge(pages(spark, rows))
    got = {r["page_id"]: r for r in judged.collect()}
    assert {got[100 + i]["verdict"] for i in range(400)} == {"block"} and got[2000]["verdict"] == "allow"
    assert [got[1000 + i]["verdict"] for i in range(30)] == ["block"] * 9 + ["allow"] * 21
    score = link_graph.SCALE * 15 // 100
    for i in range(30):  # a hop takes 15 in 100, as far as rounds go
        score = 85 * score // 100
        assert 0 <= score - got[1000 + i]["distrust"] <= link_graph.LEAST // 100
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.sql(f"SELECT {', '.join(judged.columns)} FROM ({link_graph.OP1_SQL})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.values()))) == sorted(map(str, want))


def test_distrust_by_links_equals_brute_force(spark):
    rng = random.Random(4)
    hosts, S = [f"h{i}" for i in range(40)], link_graph.SCALE
    seeds = {h: rng.choice([(S, 0), (0, S), (0, 0), (S // 2, S // 3)]) for h in hosts[:30]}
    edges = sorted({(x, y) for x, y in ((rng.choice(hosts), rng.choice(hosts)) for _ in range(120)) if x != y})
    got = link_graph.propagate(spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, good long, bad long"), spark.createDataFrame(edges, "src string, dst string"), tolerance=S // 10)
    named = set(seeds) | {h for e in edges for h in e}
    out = {h: [y for x, y in edges if x == h] for h in named}
    now, moved = dict.fromkeys(named, (0, 0)), S
    while moved > S // 10:
        trust = {h: sum(now[x][0] // len(out[x]) for x, y in edges if y == h) for h in named}
        distrust = {h: sum(now[y][1] for y in out[h]) // max(len(out[h]), 1) for h in named}
        new = {h: tuple((15 * seeds.get(h, (0, 0))[k] + 85 * more[h]) // 100 for k, more in enumerate((trust, distrust))) for h in named}
        moved = max(abs(a - b) for h in named for a, b in zip(new[h], now[h], strict=True))
        now = new
    assert {r["host"]: (r["trust"], r["distrust"]) for r in got.collect()} == now


def test_link_graph_of_nothing(spark):
    assert link_graph.judge(pages(spark, [])).count() == 0
