"""Packing, mixing, quality, n-gram join and suffix deduplication against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eddystream.llm import mixing, ngram_join, packing, quality, suffix_dedup, textops

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns they must do no harm.
CLASHES = ("key", "n", "h", "c", "s", "size", "target", "at", "length", "did", "th", "spans", "score", "text_", "component", "_key", "_size")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def table(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared, rows = some(70), []
    for i in range(n):
        kind = i % 6
        text = some(rng.randint(0, 120))
        if kind == 1 and rows:
            text = rng.choice(rows)[1] or ""
        if kind == 2 and rows:
            old = (rng.choice(rows)[1] or "").split()
            for _ in range(min(2, len(old))):
                old[rng.randrange(len(old))] = "changed"
            text = " ".join(old)
        if kind == 3:
            text = some(20) + " " + shared + " " + some(20)
        rows.append((i, text, f"s{i % 4}"))
    rows += [(n, None, None), (n + 1, "", "s1"), (n + 2, " \t\n", "s2"), (n + 3, "one", "s1"), (n + 4, "ONE", "s0"), (n + 5, "ab " * 3000, "s3"), (n + 5, "ab " * 3000, "s3"), (None, some(40), "s1")]
    return rows


EMPTY: list = []


# ---- n-gram join -------------------------------------------------------------


def brute_groups(rows, k, num, den):
    sets = []
    for i, text, _ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = {i: i for i, _, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            a, b = rows[x][0], rows[y][0]
            inter = len(sets[x] & sets[y])
            if a is not None and b is not None and inter and den * inter >= num * (len(sets[x]) + len(sets[y]) - inter):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return Counter((i, len(s), None if i is None else root(i)) for (i, _, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize(("k", "num", "task"), [(4, 85, 10**6), (5, 80, 10**6), (2, 60, 300)])
def test_ngram_join_is_exact(spark, k, num, task):
    rows = corpus(k)
    got = ngram_join.near_duplicates(table(spark, rows), k, num, 100, task_shingles=task)
    assert Counter(tuple(r) for r in got.collect()) == brute_groups(rows, k, num, 100)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.near_duplicates(table(spark, EMPTY)).count() == 0
    assert ngram_join.distinct_documents(table(spark, EMPTY)).count() == 0


def test_distinct_documents_keep_one_of_each_group(spark):
    rows = corpus(5)
    docs = table(spark, rows)
    got = ngram_join.distinct_documents(docs)
    assert got.columns == docs.columns
    want = [i for i, _, root in brute_groups(rows, 5, 80, 100) if i == root]
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got.collect()) == sorted(-1 if i is None else i for i in want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), unique=True).map(sorted), max_size=12), st.integers(1, 12))
def test_divide_skip_finds_what_counting_finds(lists, want):
    counts = Counter(i for x in lists for i in x)
    ids = sorted(i for i, n in counts.items() if n >= want)
    got = ngram_join.divide_skip([np.array(x, np.int64) for x in lists], want)
    assert [x.tolist() for x in got] == [ids, [counts[i] for i in ids]]


def test_all_links_come_from_the_search(monkeypatch):
    sets = [np.unique(np.array([*range(100), 1000 + i], np.uint64)) for i in range(30)] + [np.arange(5000, 5100, dtype=np.uint64)] * 2
    searches = []
    search = ngram_join.divide_skip
    monkeypatch.setattr(ngram_join, "divide_skip", lambda lists, want: searches.append(search(lists, want)) or searches[-1])
    assert len(ngram_join.links_of(sets, 85, 100)) == 30 and 1 < len(searches) <= 3
    monkeypatch.setattr(ngram_join, "divide_skip", lambda lists, want: (np.zeros(0, np.int64),) * 2)
    assert ngram_join.links_of(sets, 85, 100) == []


def test_keys_of_sets_have_128_bits():
    sets = [np.unique(np.random.default_rng(i).integers(0, 50, 4).astype(np.uint64)) for i in range(5000)]
    keys = {ngram_join.set_key(s) for s in sets}
    assert len(keys) == len({tuple(s) for s in sets}) and all(len(k) == 16 for k in keys)
    assert len({k[:8] for k in keys}) == len({k[8:] for k in keys}) == len(keys)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_links_of_connect_all_that_is_linked(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(5, 40), replace=False), rng.integers(0, 99, rng.integers(0, 4)).astype(np.uint64)])) for _ in range(25)]
    sets.sort(key=len)
    got, want = ngram_join.Forest(25), ngram_join.Forest(25)
    for a, b in ngram_join.links_of(sets, 60, 100):
        got.join(a, b)
    for a in range(25):
        for b in range(a):
            inter = len(np.intersect1d(sets[a], sets[b]))
            if 100 * inter >= 60 * (len(sets[a]) + len(sets[b]) - inter):
                want.join(a, b)
    assert [got.root(i) for i in range(25)] == [want.root(i) for i in range(25)]


# ---- suffix deduplication ----------------------------------------------------


def brute_removal(rows, length):
    texts = [(t or "").encode() for _, t, _ in rows]
    starts = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = Counter()
    for (i, _, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if starts[t[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("length", "hot"), [(200, 50_000), (40, 50_000), (40, 2), (13, 5), (13, 1)])
def test_suffix_dedup_is_exact(spark, length, hot):
    rows = corpus(length)
    got = suffix_dedup.deduplicate(table(spark, rows), length, hot=hot).drop("kept")
    assert Counter(tuple(r) for r in got.collect()) == brute_removal(rows, length)


def test_suffix_dedup_of_nothing_and_as_texts(spark):
    assert suffix_dedup.deduplicate(table(spark, EMPTY)).count() == 0
    rows = [(1, "é" * 150, "a"), (2, "x" + "é" * 150, "a"), (3, "short", "b"), (4, None, None)]
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicated_documents(table(spark, rows)).collect()}
    assert sorted(got) == [2, 3, 4] and got[2]["text"] == "x" and got[2]["n_chars"] == 1 and got[3]["source"] == "b"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=45, max_size=45).map(lambda b: bytes(x % 3 for x in b[:40]) + b[40:]), min_size=1, max_size=40), st.sampled_from([8, 16, 32]))
def test_deep_shallow_sorts(strings, shallow):
    strings = [s[:20] + strings[0][20:38] + s[38:] if i % 2 else s for i, s in enumerate(strings)]
    group = np.array([i % 3 for i in range(len(strings))])
    order, shared = suffix_dedup.deep_shallow(np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), 45), group, shallow)
    assert [(group[i], strings[i]) for i in order] == sorted((g, s) for g, s in zip(group, strings, strict=True))
    for a, b, n in zip(order[:-1], order[1:], shared[1:], strict=True):
        same = next((k for k in range(45) if strings[a][k] != strings[b][k]), 45)
        assert n == (same if group[a] == group[b] else -1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 4), min_size=3, max_size=3)), max_size=60))
def test_multikey_quicksort_sorts_runs(rows):
    words = np.array([w for _, w in rows], np.uint64).reshape(-1, 3)
    group = np.array([g for g, _ in rows], np.int64)
    order = np.argsort(group, kind="stable")
    run = suffix_dedup.multikey_quicksort(words, order, group[order])
    got = [rows[i] for i in order]
    assert got == sorted(rows)
    assert all((run[i] == run[i - 1]) == (got[i] == got[i - 1]) for i in range(1, len(rows)))


# ---- packing -----------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plans_are_best_fit_and_gapless(counts):
    rows = packing.plan(counts, 32)
    filled: dict = {}
    for length, lo, hi, first, per, base in rows:
        for r in range(lo, hi):
            filled.setdefault(first + (r - lo) // per, []).append((base + (r - lo) % per * length, length))
    assert Counter(n for x in filled.values() for _, n in x) == Counter(counts)
    for slots in filled.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 32
    # plain best-fit decreasing, item by item, needs as many
    rooms: list = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        i = min((i for i, room in enumerate(rooms) if room >= n), key=lambda i: rooms[i], default=None)
        if i is None:
            rooms.append(32 - n)
        else:
            rooms[i] -= n
    assert len(filled) == len(rooms)


def test_packing_is_whole(spark):
    rows = [*corpus(1), (900, "word <|endoftext|> 漢字 " * 900, "s0"), (901, "q" * 5000, "s0")]
    got = packing.pack_documents(table(spark, rows), width=256).collect()
    slow, _ = packing.encoders("byte_bpe_50k.json")
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 256 + 1
        edges = [0, *range(first, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in sequences.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack_documents(table(spark, EMPTY)).count() == 0


_ODD_SPACE = st.sampled_from([" ", "  ", "   ", "\t", "\n", "\r\n", "\n\n ", "\x0b", "\x0c", "\x1f", "\x85", "\xa0", "\u200b", "\u2009", "\u3000", "'s", "'LL", "1234", "é", "ß.", "漢", "😀", "<|endoftext|>"])


@settings(max_examples=150, deadline=None)
@given(st.lists(_ODD_SPACE | st.text(max_size=12), max_size=60).map("".join))
def test_both_tokenizers_agree_on_odd_spaces(text):
    slow, _ = packing.encoders("byte_bpe_50k.json")
    assert packing.encode(text, "byte_bpe_50k.json") == slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from(["ab ", "aB9 .,'", "é ö\n", "a", " ", "x-_/ \t"]))
def test_both_tokenizers_agree_on_long_texts(seed, letters):
    text = "".join(random.Random(seed).choices(letters, k=20_000))
    slow, _ = packing.encoders("byte_bpe_50k.json")
    assert packing.encode(text, "byte_bpe_50k.json") == slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_both_tokenizers_agree(text):
    slow, _ = packing.encoders("byte_bpe_50k.json")
    assert packing.encode(text, "byte_bpe_50k.json") == slow.encode(text, add_special_tokens=False).ids


# ---- mixing ------------------------------------------------------------------


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 50), None if i % 40 == 0 else f"s{i % 7}") for i in range(4000)] + [(5000, None, "s1"), (5001, "a b", "tiny"), (5001, "a b", "tiny")]
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total, by = sum(r["size"] for r in got), {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        by.setdefault(r["source"], []).append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(r["size"] for r in by[s]) for s in names}
    target = {s: 0.0 for s in names}
    free, left = set(names), float(total)
    while True:  # fill, stop those above, share again
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    for s in names:
        assert by[s][0]["target"] == pytest.approx(target[s]) and by[s][0]["source_size"] == size[s]
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= max(r["size"] for r in by[s])
    assert sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str) == sorted(map(tuple, got), key=str)
    taken = Counter()
    for r in got:
        taken[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 0
    assert Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect()) == +taken
    assert mixing.mix(table(spark, EMPTY)).count() == 0 and mixing.mixed_documents(table(spark, EMPTY)).count() == 0


def test_larger_budgets_keep_what_smaller_ones_keep(spark):
    docs = table(spark, [(i, "w " * (1 + i % 9), f"s{i % 2}") for i in range(500)])
    few = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, (1.0, 3.0)).collect() if r["doc_id"] % 2 == 0}
    more = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, (1.0, 2.0)).collect() if r["doc_id"] % 2 == 0}
    assert all(more[i] >= few[i] for i in few) and sum(more.values()) > sum(few.values())


# ---- quality -----------------------------------------------------------------


def test_quality_learns_and_never_sees_the_held_out_fold(spark):
    rng = random.Random(0)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "quiet", "house", "lamp"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW!!", "$$$", "win###"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), "s") for i in range(300)]
    docs = table(spark, [*rows, (1000, None, "s"), (1001, "", "s"), (None, good(), "s"), (5, rows[5][1], "s")])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (7, None, 0), (4000, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    lies = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    first = {(r["doc_id"]): r["score"] for r in quality.score(docs, *quality.classifier(docs, labels)).collect()}
    again = {(r["doc_id"]): r["score"] for r in quality.score(docs, *quality.classifier(docs, lies)).collect()}
    assert first == again
    held = [i for i in range(300) if quality.crc_fold(i) == 1]
    assert all((first[i] >= 0.5) == (i % 3 > 0) for i in held)
    assert all(0 <= s <= 1 for s in first.values()) and first[1000] == first[1001]


def test_word_vectors_and_pooling_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["Ab", "cd!", "e9", "FG", "hé", "ii", "--"]
    texts = [None, "", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(25))]
    terms, dim = 256, 8

    def two(word):  # a word's terms, by the word alone
        raw = np.frombuffer(word.encode(), np.uint8)
        return tuple(quality.terms_of(raw, np.array([0, len(raw)]), terms)[0][0].tolist())

    place, sign = quality.index_vectors(terms, dim)
    index = np.zeros((terms, dim))
    for t in range(terms):
        for p, x in zip(place[t], sign[t], strict=True):
            index[t, p] += x
    sums = np.zeros((terms, dim))
    for text in texts:
        said = [two(w) for w in (text or "").split()]
        for i, (letters, shape) in enumerate(said):
            sums[letters] += index[shape]
            sums[shape] += index[letters]
            for j in (i - 1, i + 1):
                if 0 <= j < len(said):
                    sums[letters] += index[said[j][0]]
                    sums[shape] += index[said[j][1]]
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = quality.word_vectors(docs.repartition(3), terms, dim)
    assert np.allclose(got, want, atol=1e-6)
    import pyarrow as pa

    features = quality.pooled(*textops.raw(pa.array(texts)), got)
    for text, row in zip(texts, features, strict=True):
        said = [two(w) for w in (text or "").split()]
        if not said:
            assert row.tolist() == [0.0] * (2 * dim + 2) + [1.0]
            continue
        v = np.array([want[a] + want[b] for a, b in said])
        full = [*v.mean(0), *v.std(0), len({a for a, _ in said}) / len(said), np.log1p(len(said)), 0.0]
        assert np.allclose(row, full, atol=1e-3)


def test_of_several_texts_of_one_id_training_takes_the_same(spark):
    rows = [(i % 40, f"{'good words here' if i % 2 else 'BAD !!! $$$'} {i} " * 5, "s") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    first, again = (quality.classifier(d, labels)[1] for d in (docs, docs.orderBy(F.desc("text")).repartition(3)))
    assert np.array_equal(first.w1, again.w1) and first.temperature == again.temperature


def test_quality_without_documents_or_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = table(spark, [(1, "a", "s"), (2, None, None)])
    assert [r["score"] for r in quality.score(some, *quality.classifier(some, labels)).collect()] == [0.5, 0.5]
    none = table(spark, EMPTY)
    assert quality.score(none, *quality.classifier(none, labels)).count() == 0


def test_temperature_makes_scores_probabilities():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    chance = 1 / (1 + np.exp(-2 * x[:, 0]))
    net = quality.fit(x, (rng.random(4000) < chance).astype(float))
    z = rng.normal(size=(4000, 5))
    assert abs(net.score(z) - 1 / (1 + np.exp(-2 * z[:, 0]))).mean() < 0.05


# ---- words -------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aA \n\t\x0b\x1fé\x85", max_size=30), min_size=1, max_size=8))
def test_words_are_what_the_pattern_finds(texts):
    import pyarrow as pa

    buf, off = textops.raw(pa.array(texts))
    hashes, starts, bounds = textops.words(buf, off, lower=True)
    seen: dict = {}
    for i, t in enumerate(texts):
        words = re.findall(rb"[^\x20\x09-\x0D]+", t.translate(LOWER).encode())
        own = hashes[bounds[i] : bounds[i + 1]].tolist()
        assert len(own) == len(words)
        for w, h in zip(words, own, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_texts_without_an_id_that_share_a_short_hash_are_rows_of_their_own(spark):
    # rows were once named by F.hash of their text
    texts = spark.range(300_000).select(F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2((-F.col("id") - 1).cast("string"), 512)).alias("text"))
    pair = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("both")).where("size(both) = 2").orderBy("both").first()["both"]
    for a, b in (pair, pair[::-1]):
        docs = spark.createDataFrame([(None, a), (None, b), (5, a)], "doc_id long, text string")
        got = {(r["doc_id"], r["n_removed"], bytes(r["kept"]).decode()) for r in suffix_dedup.deduplicate(docs).collect()}
        assert got == {(None, 256, ""), (None, 0, b), (5, 256, "")}
