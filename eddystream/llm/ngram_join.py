"""N-gram Jaccard join by T-occurrence search (DivideSkip), spread over Spark.

Linking is the same as reaching an overlap: sets of sizes a and b with
``den * overlap >= num * union`` overlap by at least ``num*(a+b)/(num+den)``.

1. Each document becomes its set of distinct shingles (64-bit hashes); documents
   with equal sets (128-bit hashes) are one class, of which one document stands
   for all.
2. Prefix filter: two linking sets share at least m shingles among the first
   ``a - least overlap + m`` of each in any fixed order of all shingles. The
   order puts shingles last that many sets hold (a bounded list of the most
   frequent; any list gives the same result), then goes by hash. Sets of whose
   prefix fewer than m shingles are anybody else's drop out. Of the others,
   those that meet at a shingle and are about as large (a band of sizes) are a
   star around one of them, and stars of neighbouring bands are tied, which
   keeps one edge a set however many meet.
3. The components of the stars are groups in which all links lie. A group's
   sets meet in one task, or, if the group is large, block by block in several:
   there sets search the inverted lists of their shingles for sets that occur T
   times, merging short lists by a heap and probing long ones by binary search.
   Sets of the class that is the largest in the end needn't search: any link to
   another class is found from its other end.
4. Found links and equal sets make the components.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddystream.llm import textops
from eddystream.llm.common import dropped, give_back, plain, small_batches, stored, tidy
from eddystream.llm.components import components, smallest_ids
from eddystream.llm.vectors import by_group

#: Shingles that go last in the order: as many at most, a bounded broadcast.
FREQUENT = 300_000
#: A task names a shingle frequent if so many of its own sets hold it.
LOCAL_FREQUENT = 2
#: Hundredths of a set's shingles that a partner must share of its prefix, which is longer by as many.
MORE = 8
#: Bytes at most of what is sought in the documents by a broadcast; more by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Shingles of all sets that meet in one task; larger groups meet block by block.
TASK_SHINGLES = 1_000_000


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    return -(-num * (a + b) // (num + den))


def fits(a: int, b: int, num: int, den: int) -> bool:
    """Whether sets of these sizes can link at all."""
    return den * min(a, b) >= num * max(a, b)


def shared_prefix(n: int) -> int:
    return max(1, n * MORE // 100)


# ---- sets of documents -------------------------------------------------------


def doc_sets(batch_text: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    buf, off = textops.raw(batch_text)
    for a, b in textops.pieces(off):
        hashes, _, bounds = textops.words(buf[off[a] : off[b]], off[a : b + 1] - off[a], lower=True)
        yield from enumerate(textops.shingles(hashes, bounds, k), a)


def set_key(s: np.ndarray) -> bytes:
    """128 bits of a set, equal for equal sets (as good as never for others)."""
    if not len(s):
        return bytes(16)
    with np.errstate(over="ignore"):
        sums = np.array([textops.mix(s + textops.BASE).sum(dtype=np.uint64), textops.mix(s ^ textops.BASE).sum(dtype=np.uint64)], np.uint64)
        both = np.stack([textops.mix(sums + np.uint64(len(s))), textops.mix(sums[::-1] * textops.BASE + sums)])
        return (both[0] ^ both[1]).astype(">u8").tobytes()


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, key, n) of each row: the key of its set and the number of its shingles."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(set_key(s), len(s)) for _, s in doc_sets(b.column("text"), k)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int64())], ["doc_id", "key", "n"])

    return docs.mapInArrow(tidy(keys), "doc_id long, key binary, n long")


def frequent_shingles(docs: DataFrame, k: int, most: int = FREQUENT) -> np.ndarray:
    """Shingles that most sets hold, as far as tasks see: at most ``most``, sorted. Only the order of shingles depends on it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        seen: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            some = n >= LOCAL_FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(n[some])], ["s", "n"])

        size = 0
        for b in batches:
            for _, s in doc_sets(b.column("text"), k):
                key = set_key(s)
                if key not in seen:
                    seen.add(key)
                    waiting.append(s)
                    size += len(s)
            if size > 2_000_000:
                yield flush()
                waiting, size = [], 0
                seen.clear()
        yield flush()

    # without a sort: the step of counts down to which ``most`` shingles are enough, by a histogram of few steps
    step = F.floor(F.log2("n") * 8).cast("int")
    counts = stored(docs.mapInArrow(tidy(count), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).withColumn("step", step), "shingles")
    low, have = 1 << 30, 0
    for at, n in sorted(counts.groupBy("step").count().collect(), reverse=True):
        have += n
        if have > most:
            break
        low = at
    top = counts.where(F.col("step") >= low).select("s").toPandas()["s"].to_numpy(np.int64)
    dropped(counts)
    return np.sort(top.view(np.uint64))


def postings(docs: DataFrame, frequent: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """(s, n, k1, k2, late): each set's prefix in the order that puts ``frequent`` shingles last, which are marked; k1 and k2 are the halves of its key."""
    last = docs.sparkSession.sparkContext.broadcast(frequent)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = last.value
        for b in batches:
            parts, sizes, keys = [], [], []
            done: set[bytes] = set()
            for _, s in doc_sets(b.column("text"), k):
                key = set_key(s)
                if not len(s) or key in done:
                    continue
                done.add(key)
                n = len(s)
                if len(rare):
                    at = np.searchsorted(rare, s)
                    late = rare[np.minimum(at, len(rare) - 1)] == s
                    s = np.concatenate([s[~late], s[late]]) if late.any() else s
                parts.append(s[: n + (-num * n // den) + shared_prefix(n)])
                sizes.append(n)
                keys.append(key)
            lens = [len(x) for x in parts]
            full = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            half = np.repeat(np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2), lens, axis=0)
            late = rare[np.minimum(np.searchsorted(rare, full), len(rare) - 1)] == full if len(rare) else np.zeros(len(full), bool)
            cols = [full.view(np.int64), np.repeat(np.array(sizes, np.int32), lens), half[:, 0].copy(), half[:, 1].copy(), late]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["s", "n", "k1", "k2", "late"])

    return docs.mapInArrow(tidy(prefixes), "s long, n int, k1 long, k2 long, late boolean")


def met_by_others(posts: DataFrame) -> DataFrame:
    """The rows of ``posts`` whose shingle is in another set's prefix too.

    Frequent shingles are known to be several sets', so they are not counted
    but dealt out one by one: no task has all rows of a common shingle.
    """
    at = Window.partitionBy("s", F.when(F.col("late"), F.struct("k1", "k2")))
    seen = posts.withColumns({f"{f}{c}": getattr(F, f)(c).over(at) for c in ("k1", "k2") for f in ("min", "max")})
    return seen.where("late or mink1 <> maxk1 or mink2 <> maxk2").select("s", "n", "k1", "k2", "late")


# ---- search in one task ------------------------------------------------------


def divide_skip(lists: list[np.ndarray], want: int, ratio: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """Ids that are in at least ``want`` of the sorted ``lists``, and in how many.

    The longest lists are set aside; the short ones are merged by a heap, and
    ids that they hold often enough are probed for in the long ones by binary
    search, as long as they can still reach the count. While too few short
    lists could reach it, the heap's smallest are popped and skip ahead to the
    next possible id.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(lists) < want:
        return none
    n_long = min(want - 1, int(want / (ratio * np.log2(len(lists[-1]) + 1) + 1)))
    while n_long and len(lists[len(lists) - n_long]) <= 1:  # lists of one id are never worth a probe
        n_long -= 1
    long, need, m = lists[len(lists) - n_long :], want - n_long, len(lists) - n_long
    # an entry is its id times the number of lists, plus its list
    short = [(x * m + i).tolist() for i, x in enumerate(lists[:m])]
    found: list[int] = []
    counts: list[int] = []
    at = [0] * m
    heap = [x[0] for x in short]
    heapq.heapify(heap)
    while len(heap) >= need:
        id_ = heap[0] // m
        have, beyond = 0, (id_ + 1) * m
        while heap and heap[0] < beyond:
            have += 1
            i = heap[0] % m
            at[i] += 1
            if at[i] < len(short[i]):
                heapq.heapreplace(heap, short[i][at[i]])
            else:
                heapq.heappop(heap)
        if have >= need:
            found.append(id_)
            counts.append(have)
        elif need > 1:  # with need-1 lists out of the way, nothing below the next head can be found
            popped = [heapq.heappop(heap) for _ in range(min(need - 1, len(heap)))]
            if not heap:
                break
            target = heap[0] // m * m
            for entry in popped:
                i = entry % m
                at[i] = bisect_left(short[i], target, at[i])
                if at[i] < len(short[i]):
                    heapq.heappush(heap, short[i][at[i]])
    ids, have = np.array(found, np.int64), np.array(counts, np.int64)
    for j, x in enumerate(long):
        alive = have + len(long) - j >= want
        if not alive.all():
            ids, have = ids[alive], have[alive]
        if not len(ids):
            return none
        have = have + (x[np.minimum(np.searchsorted(x, ids), len(x) - 1)] == ids)
    return ids[have >= want], have[have >= want]


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links_of(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what all links of ``sets`` connect, each found by T-occurrence search.

    The set that shares most with others searches first. Then one after the
    other searches that isn't in the largest class, until all outside it have
    done so: a link between two classes would have been found from one of them.
    """
    n = len(sets)
    forest, found = Forest(n), []
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    owner = np.repeat(np.arange(n), np.diff(bounds))
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], np.arange(len(values) + 1))
    ids, held = owner[order], np.diff(ends)
    shares = np.add.reduceat(held[place], bounds[:-1])
    size, done, largest = [1] * n, [False] * n, int(np.argmax(shares))  # sizes hold for roots

    def search(i: int) -> None:
        nonlocal largest
        done[i], a = True, len(sets[i])
        mine, want = place[bounds[i] : bounds[i + 1]], least_overlap(a, -(-num * a // den), num, den)
        mine = mine[held[mine] > 1]
        if len(mine) < want:  # too few shingles are anybody else's
            return
        lists = [ids[ends[t] : ends[t + 1]] for t in mine.tolist()]
        for j, overlap in zip(*(x.tolist() for x in divide_skip(lists, want)), strict=True):
            if j == i or den * overlap < num * (a + len(sets[j]) - overlap):
                continue
            both = size[forest.root(i)] + size[forest.root(j)]
            if forest.join(i, j):
                found.append((i, j))
                size[forest.root(i)] = both
        if size[forest.root(i)] > size[forest.root(largest)]:
            largest = i

    search(largest)
    outside = lambda i: forest.root(i) != forest.root(largest)
    while todo := [i for i in np.argsort(-shares, kind="stable").tolist() if not done[i] and outside(i)]:
        for i in todo:
            if outside(i):
                search(i)
    return found


# ---- the join ----------------------------------------------------------------


def band_of(num: int, den: int) -> Column:
    """``band`` of a size ``n``: sizes that can link are in one band or in two neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / (F.log(F.lit(den / num)) * 1.000001)).cast("long").alias("band")


def group_links(docs: DataFrame, chosen: DataFrame, k: int, num: int, den: int, task_shingles: int) -> DataFrame:
    """(a, b): links between the sets of ``chosen`` (doc_id, key, n, grp), found group by group."""
    # blocks of a group by size: a block meets itself and every later one that sizes let it link with
    total = chosen.groupBy("grp").agg(F.sum("n").alias("total"))
    sized = chosen.join(total, "grp").withColumn("large", F.col("total") > task_shingles).withColumn("band", band_of(num, den))
    parts = sized.where("large").groupBy("grp", "band").agg(F.ceil(F.sum("n") / (task_shingles / 2)).cast("long").alias("parts"))
    sized = sized.join(parts, ["grp", "band"], "left")
    part = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)))
    sized = sized.withColumn("block", F.when(F.col("large"), F.concat_ws(".", F.col("band").cast("string"), part.cast("string"))).otherwise(""))
    # pairs of blocks in one band or in neighbouring bands
    blocks = sized.where("large").select("grp", "band", "block").distinct()
    x, y = blocks.select("grp", F.col("band").alias("b1"), F.col("block").alias("k1")), blocks.select("grp", F.col("band").alias("b2"), F.col("block").alias("k2"))
    meets = x.join(y, "grp").where("(b1 = b2 and k1 <= k2) or b2 = b1 + 1")
    met = meets.select("grp", F.concat_ws("/", "k1", "k2").alias("task"), F.explode(F.array_distinct(F.array("k1", "k2"))).alias("block"))
    small = sized.where("not large").select("doc_id", "key", "grp", F.lit("").alias("task"))
    big = sized.where("large").select("doc_id", "key", "grp", "block").join(met, ["grp", "block"]).select("doc_id", "key", "grp", "task")
    where = small.union(big).groupBy("doc_id").agg(F.collect_list(F.struct("key", "grp", "task")).alias("tasks"))
    where = stored(where, "sought")
    # a task's entry: two keys of 16 bytes and its name, with what a row needs beside them
    size = where.agg(F.coalesce(F.sum(F.lit(64) + F.size("tasks") * 96), F.lit(0))).first()[0]
    texts = docs.join(F.broadcast(where) if size <= BROADCAST_BYTES else where, "doc_id").select("text", "tasks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tasks = b.column("tasks").to_pylist()
            rows = []
            for i, s in doc_sets(b.column("text"), k):
                key = set_key(s)
                rows += [(t["grp"], t["task"], key, s.tobytes()) for t in tasks[i] if t["key"] == key]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["grp", "task", "key", "s"])

    def search(t: pa.Table) -> pa.RecordBatch:
        held = dict(zip(t.column("key").to_pylist(), t.column("s").to_pylist(), strict=True))
        keys, forest = list(held), Forest(len(held))
        for i, j in links_of([np.frombuffer(s, np.uint64) for s in held.values()], num, den) if len(held) > 1 else ():
            forest.join(i, j)
        # what hangs together goes out as a star, which needs no more rounds to be joined to others
        out = [(keys[i], keys[forest.root(i)]) for i in range(len(keys)) if forest.root(i) != i]
        if len(keys) > 1000:
            give_back()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["a", "b"])

    found = texts.mapInArrow(tidy(sets), "grp binary, task string, key binary, s binary")
    return found.repartition("grp", "task").sortWithinPartitions("grp", "task").mapInArrow(tidy(by_group(("grp", "task"), search)), "a binary, b binary")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Two documents link when ``den * intersection >= num * union`` of their sets
    of distinct ``k``-word shingles (A-Z lower-cased; all words as one shingle
    if there are fewer). Texts without words have no shingles and link with
    nothing; a null text is such a text. ``component_id`` is the smallest
    doc_id reachable by links, itself included. Rows that repeat an id each
    keep a row and the id stands for all of them; a null id is linked with
    nothing and is its own component (null). Texts of any length are read
    whole; their sets go from task to task as one value. An empty table gives
    no rows.
    """
    small_batches(docs.sparkSession)
    docs = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = stored(set_table(docs, k), "sets")
    posts = postings(docs, frequent_shingles(docs, k), k, num, den)
    sizes = base.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"))
    shared = stored(met_by_others(posts).distinct(), "postings")
    for _ in range(2):  # a set that drops out can leave others alone with a shingle
        need = F.greatest(F.lit(1), F.floor(F.col("n") * MORE / 100))
        live = shared.groupBy("k1", "k2", "n").agg(F.count("*").alias("k")).where(F.col("k") >= need).select("k1", "k2")
        left = stored(met_by_others(shared.join(live, ["k1", "k2"])), "postings")
        dropped(shared)
        shared = left
    half = lambda c: F.lpad(F.hex(c), 16, "0")
    shared = stored(shared.select("s", band_of(num, den), F.unhex(F.concat(half("k1"), half("k2"))).alias("key")), "meetings")
    dropped(left)
    # sets that can link are in one band or in two neighbouring ones: a star a shingle and band, and stars tied
    heads = stored(shared.groupBy("s", "band").agg(F.min("key").alias("head")), "heads")
    stars = shared.join(heads, ["s", "band"]).select("head", "key")
    after = heads.select("s", (F.col("band") + 1).alias("band"), F.col("head").alias("key"))
    meets_at = stars.union(heads.join(after, ["s", "band"]).select("head", "key")).where("head <> key").distinct()
    near = components(meets_at, "groups")
    chosen = stored(near.join(sizes, near["node"] == sizes["key"]).select("doc_id", "key", "n", F.col("component").alias("grp")), "chosen")
    found = stored(group_links(docs, chosen, k, num, den, task_shingles), "links")
    dropped(chosen)
    # documents of one set, and sets that link; ids repeated with other texts link these as well
    same = base.where("doc_id is not null and n > 0").select(F.col("doc_id").alias("id"), F.col("key").alias("cls")).distinct()
    joined = smallest_ids(same, found, "documents").select(F.col("id").alias("doc_id"), "first")
    return base.join(joined, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def distinct_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the one with the smallest id stays, and all rows without an id."""
    groups = stored(near_duplicates(docs, k, num, den), "groups")
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() * 32 <= BROADCAST_BYTES else gone
    left = docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    twice = groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.limit(1).count():
        return left
    # ids that repeat: one row each, the least of those rows
    once = left.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("r")).select("r.*")
    return left.join(twice, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(once)


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity 0.85, as its contract has it."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=85, den=100)
