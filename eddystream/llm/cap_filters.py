"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a structured code: each is made of one word of each of a
few small random codes on blocks of the (rotated) coordinates, so there are
words**blocks of them, and list decoding finds those whose cap holds a vector
without trying all. Vectors that share a cap meet in a task, which verifies
their cosines. How small a cap: so that it holds about ``LOAD`` vectors of an
even crowd, by its exact share of the sphere. How many caps: so that simulated
pairs exactly at the threshold miss one another as seldom as ``MISS``. If one
code can't do that, several with turns of their own do; if that takes more than
``MOST`` caps a vector, caps are twice as large, and so on up to a single one
that holds all. Both numbers are met at any number of vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddystream.llm.common import plain, small_batches, stored, tidy
from eddystream.llm.components import smallest_ids
from eddystream.llm.vectors import by_group, kind_of, matrix, unit, valid_vectors

LOAD, MISS, SEED = 1024, 0.01, 9
#: A cap with more vectors is compared part by part, in several tasks.
PART = 2048
#: A cap's number among all: its own below, a mark of the vectors' length above.
CAP_MASK = (1 << 46) - 1
#: Codes at most that are laid over one another, and caps a vector at most, before caps are made larger.
TURNS, MOST = 8, 600
#: Words of a block's code at most; more directions need more blocks.
WORDS = 1500
#: Pairs that are simulated to see how many miss one another.
PAIRS = 1500


class Code:
    """The directions for vectors of ``dim`` numbers: ``words`` in each of ``blocks`` blocks, caps from ``least`` on; ``again`` numbers the turn."""

    def __init__(self, dim: int, blocks: int, words: int, least: float, again: int = 0) -> None:
        self.dim, self.blocks, self.words, self.least, self.caps = dim, blocks, words, least, words**blocks
        rng = np.random.Generator(np.random.PCG64([SEED, dim, blocks, again] if again else [SEED, dim, blocks]))
        self.turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.parts = np.array_split(np.arange(dim), blocks)
        self.code = [unit(rng.normal(size=(words, len(p)))) / math.sqrt(blocks) for p in self.parts]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of every cap that holds a row of ``x``: block by block, dropping what the best of the rest can't lift."""
        y = x @ self.turn
        scores = [y[:, p] @ c.T for p, c in zip(self.parts, self.code, strict=True)]
        best = np.stack([s.max(1) for s in scores], 1)
        row, number, sum_ = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for i, s in enumerate(scores):
            rest = best[:, i + 1 :].sum(1)
            out = []
            for k in range(0, len(row), 20_000):
                r = row[k : k + 20_000]
                total = sum_[k : k + 20_000, None] + s[r]
                a, w = np.nonzero(total + rest[r][:, None] >= self.least)
                out.append((r[a], number[k : k + 20_000][a] * self.words + w, total[a, w]))
            row, number, sum_ = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (row, number, sum_)
        return row, number


class Codes:
    """Several codes, each turned anew: pairs that one of them misses have other chances."""

    def __init__(self, codes: list[Code]) -> None:
        self.codes, self.caps = codes, sum(c.caps for c in codes)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As of one code; a later code's directions are numbered after those of the earlier ones."""
        rows, numbers, before = [], [], 0
        for c in self.codes:
            row, number = c.decode(x)
            rows.append(row)
            numbers.append(number + before)
            before += c.caps
        return np.concatenate(rows), np.concatenate(numbers)


def apart(code: Code, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` share no cap with the same row of ``y``."""
    (ra, fa), (rb, fb) = code.decode(x), code.decode(y)
    out = np.ones(len(x), bool)
    out[np.intersect1d(ra * code.caps + fa, rb * code.caps + fb) // code.caps] = False
    return out


class Sphere:
    """What share of the unit sphere in ``dim`` (at least 2) dimensions lies how near to a direction, by its exact density."""

    def __init__(self, dim: int) -> None:
        self.angle = np.linspace(0, math.pi / 2, 200_001)
        density = np.sin(self.angle) ** (dim - 2)
        sum_ = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
        self.dim, self.share = dim, sum_ / sum_[-1] / 2

    def least(self, share: float) -> float:
        """The product with a direction that this share of the sphere reaches."""
        return math.cos(float(np.interp(share, self.share, self.angle)))

    def both(self, share: float, cosine: float, rng: np.random.Generator, n: int = 20_000) -> float:
        """Of the directions whose cap of this share holds a vector, the part whose cap holds one at ``cosine`` to it as well."""
        along = np.cos(np.interp(rng.random(n) * share, self.share, self.angle))
        across = rng.normal(size=(n, self.dim - 1))
        across = across[:, 0] / np.linalg.norm(across, axis=1)
        return float((cosine * along + math.sqrt(1 - cosine * cosine) * np.sqrt(1 - along * along) * across >= self.least(share)).mean())


def one_turn(sphere: Sphere, share: float, both: float, x: np.ndarray, y: np.ndarray) -> Code:
    """A code whose caps are ``share`` of the sphere, of as many as the pairs (x, y) need, or of as many as a share of MOST allows."""
    want, dim = 6.0, sphere.dim
    while True:
        total = want / (share * both)
        blocks = min(max(dim // 2, 1), max(2, math.ceil(math.log(total) / math.log(WORDS))))
        words = min(max(2, math.ceil(total ** (1 / blocks))), WORDS)
        code = Code(dim, blocks, words, sphere.least(share))
        if 1.25 * want / both > MOST / TURNS or words == WORDS or apart(code, x, y).mean() <= MISS:
            return code
        want *= 1.25


def make_code(dim: int, n: int, cosine: float) -> Codes:
    """The codes for ``n`` vectors: caps of about LOAD/n of the sphere, and as many as pairs at ``cosine`` need to meet.

    Where one code doesn't bring the simulated pairs together, up to TURNS of
    them do; where these don't either, or take more than MOST caps a vector,
    caps are twice as large, and so on. No code is returned that misses more
    than ``MISS`` of these pairs: the last resort is one cap that holds all
    vectors, which compares every pair.
    """
    if dim == 1:  # vectors are 1 or -1
        sign = Code(1, 1, 2, 0.5)
        sign.code = [np.array([[1.0], [-1.0]])]
        return Codes([sign])
    rng = np.random.Generator(np.random.PCG64([SEED, 1]))
    x, side = unit(rng.normal(size=(PAIRS, dim))), rng.normal(size=(PAIRS, dim))
    side = side - (side * x).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine * cosine) * unit(side)
    sphere, share = Sphere(dim), min(0.1, LOAD / max(n, 1))
    while share < 0.5:
        both = sphere.both(share, cosine, rng)
        if both * MOST >= 6:  # else these caps are too small for such pairs, however many there are
            first = one_turn(sphere, share, both, x, y)
            codes, left = [], np.ones(len(x), bool)
            while len(codes) < TURNS and (len(codes) + 1) * first.caps * share <= MOST and first.caps <= CAP_MASK // TURNS:
                codes.append(Code(dim, first.blocks, first.words, first.least, len(codes)))
                left[left] = apart(codes[-1], x[left], y[left])
                if left.mean() <= MISS:
                    return Codes(codes)
        share *= 2
    return Codes([Code(dim, 1, 1, -2.0)])


def classes(vectors: DataFrame) -> DataFrame:
    """(id, cls) with the digest of each vector's numbers: copies are one class."""
    return vectors.select("id", F.unhex(F.md5("v")).alias("cls"))


def marked(rows: DataFrame, kind: str) -> DataFrame:
    """(vec_id, digest) of every row (vec_id, embedding): the digest that :func:`classes` has for its numbers, or null."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [hashlib.md5(v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes()).digest() if v.is_valid and len(v.values) and not v.values.null_count else None for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "digest"])

    return rows.mapInArrow(tidy(digest), "vec_id long, digest binary")


def sharing(pairs: np.ndarray, row: np.ndarray, cap: np.ndarray, n_caps: int) -> np.ndarray:
    """Which of ``pairs`` (a symmetric matrix of truth) share one of the caps that ``row``, ``cap`` list, by whichever of two ways costs less."""
    n, out = len(pairs), np.zeros(pairs.shape, bool)
    if not len(row):
        return out
    a, b = np.nonzero(np.triu(pairs))
    most = int(np.bincount(row, minlength=n).max())
    if len(a) * most * 200 > float(n) * n * n_caps:  # nearly all pairs: a product of matrices, so many caps at once that memory has a bound
        for k in range(0, n_caps, 4096):
            at = (cap >= k) & (cap < k + 4096)
            caps = np.zeros((n, min(4096, n_caps - k)), np.float32)
            caps[row[at], cap[at] - k] = 1
            for i in range(0, n, 1024):
                out[i : i + 1024] |= caps[i : i + 1024] @ caps.T > 0
        return out
    # few pairs: each one's two lists side by side, padded with numbers that occur once
    order = np.argsort(row, kind="stable")
    row, cap = row[order], cap[order]
    lists = np.tile(-1 - np.arange(most), (n, 1))
    lists[row, np.arange(len(row)) - np.searchsorted(row, row)] = cap
    for i in range(0, len(a), 20_000):
        x, y = lists[a[i : i + 20_000]], lists[b[i : i + 20_000]]
        both = np.sort(np.concatenate([x, np.where(y < 0, y - most, y)], 1), axis=1)
        hit = (both[:, 1:] == both[:, :-1]).any(1)
        out[a[i : i + 20_000][hit], b[i : i + 20_000][hit]] = out[b[i : i + 20_000][hit], a[i : i + 20_000][hit]] = True
    return out


def met(parts: DataFrame, cosine: float, codes, kind: str) -> DataFrame:
    """(cls, links, root) for vectors that meet: linked vectors of the pairs that no earlier cap has, and one they hang on."""
    size_of = int(kind[-1])

    def verify(t: pa.Table) -> pa.RecordBatch:
        n, f = len(t), t.column("f")[0].as_py()
        cls, size = np.array(t.column("cls").to_pylist(), object), t.column("size").to_numpy().astype(np.float64)
        half = t.column("half").to_numpy()
        x = unit(matrix(t.column("v"), kind))
        new = np.zeros((n, n), bool)
        for i in range(0, n, 1024):
            ok = x[i : i + 1024] @ x.T >= cosine
            if half.any():
                ok &= half[i : i + 1024, None] != half
            new[i : i + 1024] = ok
        np.fill_diagonal(new, False)
        some = np.flatnonzero(new.any(1))
        # caps before this one that two vectors share have seen the pair already
        row, flat = codes.value[len(t.column("v")[0].as_py()) // size_of].decode(x[some])
        below = flat < f & CAP_MASK
        known, place, times = np.unique(flat[below], return_inverse=True, return_counts=True)
        shared = times[place] > 1
        row, place, n_caps = row[below][shared], (np.cumsum(times > 1) - 1)[place[shared]], int((times > 1).sum())
        new[np.ix_(some, some)] &= ~sharing(new[np.ix_(some, some)], row, place, n_caps)
        np.fill_diagonal(new, False)
        parts_of = [slice(i, i + 512) for i in range(0, n, 512)]
        links, root = np.concatenate([new[at] @ size for at in parts_of]), np.arange(n)
        while True:  # the smallest row reachable
            low = np.minimum(root, np.concatenate([np.where(new[at], root, n).min(1) for at in parts_of]))
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(cls[some], pa.binary()), pa.array(links[some].astype(np.int64)), pa.array(cls[root[some]], pa.binary())], ["cls", "links", "root"])

    keys = ("f", "low", "high")
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(by_group(keys, verify)), "cls binary, links long, root binary")


def near_vectors(table: DataFrame, cosine: float = 0.9, part: int = PART) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``table`` (vec_id, embedding).

    Pairs link at ``cosine`` or more, in double precision; every link that is
    reported was verified, and pairs at the threshold are missed as seldom as
    ``MISS``. Copies are one vector with a count: they link with each other
    and with all that any of them links with. Vectors of different lengths
    never link. Null, empty and zero vectors, ones with null or non-finite
    numbers and rows without an id link with nothing and are kept. A row that
    repeats an id and a vector counts once, and each such row has that vector's
    links. Of an id with several vectors each row has its own vector's links,
    and all have one component. An empty table gives no rows.
    """
    spark = table.sparkSession
    small_batches(spark)
    kind = kind_of(table)
    size_of = int(kind[-1])
    all_ = stored(valid_vectors(table), "vectors")
    members = classes(all_)
    sizes = members.groupBy("cls").agg(F.count("*").alias("size"), F.min("id").alias("id"))
    reps = sizes.join(all_.select("id", "v", F.unhex(F.md5("v")).alias("cls")), ["id", "cls"]).select("cls", "size", "v")
    reps = stored(reps, "distinct-vectors")
    counts = {int(r[0]) // size_of: int(r[1]) for r in reps.groupBy(F.length("v")).count().collect()}
    codes = {dim: make_code(dim, n, cosine) for dim, n in counts.items() if n > 1}
    shared = spark.sparkContext.broadcast(codes)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lens = np.array([len(v) // size_of for v in b.column("v").to_pylist()], np.int64)
            for dim in np.unique(lens):
                if int(dim) not in shared.value:
                    continue
                rows = np.flatnonzero(lens == dim)
                sub = b.take(pa.array(rows))
                row, caps = shared.value[int(dim)].decode(unit(matrix(sub.column("v"), kind)))
                order = np.argsort(row, kind="stable")
                row, caps = row[order], caps[order]
                # vectors of another length get other numbers
                tag = int(dim) << 46
                ends = np.searchsorted(row, np.arange(len(rows) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(caps + tag))
                yield pa.RecordBatch.from_arrays([sub.column("cls"), sub.column("size"), sub.column("v"), lists], ["cls", "size", "v", "caps"])

    capped = stored(reps.mapInArrow(tidy(decode), "cls binary, size long, v binary, caps array<long>"), "capped")
    load = capped.select(F.explode("caps").alias("f")).groupBy("f").agg(F.count("*").alias("k")).where("k > 1")
    load = load.select("f", F.ceil(F.col("k") / part).cast("int").alias("parts"))
    each = capped.select("cls", "size", "v", F.explode("caps").alias("f")).join(load, "f")
    mine = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    # a cap in several parts: every two parts meet, and each part meets itself
    each = each.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    each = each.select("cls", "size", "v", "f", low.alias("low"), high.alias("high"), F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("half"))
    found = stored(met(each, cosine, shared, kind), "vector-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    first = smallest_ids(members.select("id", "cls"), found.select("cls", "root"), "vectors")
    # a row's own vector decides its links, its id the component
    own = members.join(sizes.select("cls", "size"), "cls").join(links, "cls", "left").select("id", "cls", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = stored(marked(plain(table, "vec_id", "embedding"), kind), "vector-rows")
    out = out.join(own, (out["vec_id"] == own["id"]) & (out["digest"] == own["cls"]), "left").select("vec_id", "n_links")
    out = out.join(first, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("first", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op9_cap_filters(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
