"""Suffix-array deduplication: every byte of a long string that occurs elsewhere goes.

A string of ``length`` bytes that starts at two places has, at both, the same
smallest hash among its ``seed``-byte windows. Only such places, the anchors
(about one in eighty bytes), are compared, and they decide exactly:

1. Anchors are counted by seed hash, and by the hash of all bytes around them
   that a string through them can have (``length - seed`` before, ``length``
   after). Where all surroundings are equal, every string through them repeats.
2. Of different surroundings with one seed, one copy each is sorted twice, by
   what follows the anchor and by what precedes it read backwards: sparse
   suffix arrays with their common prefixes. Deep-shallow: a multikey quicksort
   orders them to a shallow depth, a word of bytes at a time, in three parts
   around a pivot; the groups that are still equal there are ordered by blind
   tries, which look at one byte of each branch and compare in full once.
3. A string that starts d bytes before its anchor repeats if another anchor
   shares d bytes before and ``length - d`` after, that is, if both lie in one
   run of both arrays. A seed with very many surroundings is parted by what
   strings through it must share besides the seed: those that start in the
   nearer half of the places before it share more of what follows, the others
   more of what precedes. Surroundings that are equal as far as the strings of
   a part reach repeat there and go on as one. Parts that are still too large
   are halved again, down to strings of one start, which are all equal.
4. Covered bytes are joined to the documents and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddystream.llm import textops
from eddystream.llm.common import dropped, small_batches, stored, tidy

LENGTH = 200
#: Bytes that the multikey quicksort looks at, in steps of a word, before blind tries take over.
SHALLOW, WORD = 32, 8
#: A seed, or a part of one, with more different surroundings isn't sorted in one task.
HOT = 50_000
#: Surroundings that a task sorts at once, whole groups.
AT_ONCE = 20_000


def seed_of(length: int) -> int:
    """Bytes of a seed: the largest power of two up to a third of ``length``."""
    return 1 << max(0, (length // 3).bit_length() - 1)


# ---- anchors -----------------------------------------------------------------


def anchors(buf: np.ndarray, off: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors in rows of ``buf``, and their seed hashes."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(buf) < length:
        return none
    width = length - seed + 1
    v = textops.rolling(buf, seed)
    least = textops.sliding(v, width, np.minimum)
    edge = np.zeros(len(buf) + 1, np.int32)
    long = np.diff(off) >= length
    np.add.at(edge, off[:-1][long], 1)
    np.add.at(edge, off[1:][long] - length + 1, -1)
    inside = np.cumsum(edge)[: len(least)] > 0
    least[~inside] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero((textops.sliding(padded, width, np.maximum) == v) & (v != 0))
    return at, v[at]


_inverse = np.uint64(pow(int(textops.BASE), -1, 1 << 64))


def _inverse_powers(n: int) -> np.ndarray:
    full = np.full(n, _inverse, np.uint64)
    full[:1] = 1
    return np.multiply.accumulate(full)


class Hashes:
    """Hashes of any stretch of a buffer, from running sums."""

    def __init__(self, buf: np.ndarray) -> None:
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(textops.BYTE[buf] * textops.powers(len(buf) + 1)[: len(buf)], out=self.sums[1:])
        self.back = _inverse_powers(len(buf) + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return textops.mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))


def surroundings(at: np.ndarray, off: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bytes before and bytes after of each anchor, as far as strings through it can reach."""
    row = np.searchsorted(off, at, "right") - 1
    return row, np.minimum(at - off[row], length - seed), np.minimum(off[row + 1] - at, length)


def anchor_table(docs: DataFrame, length: int) -> DataFrame:
    """(h, c, r1, r2, at) of every anchor: hashes of its seed and of its surroundings, its row's name, its place there."""
    seed = seed_of(length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = textops.raw(b.column("text"))
            r1, r2 = b.column("r1").to_numpy(), b.column("r2").to_numpy()
            for i, j in textops.pieces(off):
                part, po = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                at, h = anchors(part, po, length, seed)
                if not len(at):
                    continue
                row, before, after = surroundings(at, po, length, seed)
                c = Hashes(part).of(at - before, at + after)
                c = textops.mix(c + (before * 4096 + after).astype(np.uint64))
                where = (at - po[row]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(r1[i + row]), pa.array(r2[i + row]), pa.array(where)], ["h", "c", "r1", "r2", "at"])

    return docs.mapInArrow(tidy(find), "h long, c long, r1 long, r2 long, at int")


# ---- deep-shallow sorting ----------------------------------------------------


class BlindTrie:
    """Orders byte strings of one width: inner nodes keep a depth and branches by the byte there, leaves a string."""

    def __init__(self, strings: list[bytes], width: int) -> None:
        self.strings, self.width = strings, width
        self.numbers: list[int] = [int.from_bytes(s, "big") for s in strings]
        self.root: list | int | None = None
        self.equal: dict[int, list[int]] = {}
        for i in range(len(strings)):
            self.insert(i)

    def common(self, i: int, j: int) -> int:
        return self.width - ((self.numbers[i] ^ self.numbers[j]).bit_length() + 7) // 8

    def insert(self, i: int) -> None:
        """Down by branching bytes alone to some leaf; one full comparison; up to where the new branch leaves."""
        if self.root is None:
            self.root = i
            return
        s, node, path = self.strings[i], self.root, []
        while isinstance(node, list):
            path.append(node)
            branches = node[1]
            node = branches.get(s[node[0]])
            if node is None:
                node = next(iter(branches.values()))
        deep = self.common(i, node)
        if deep == self.width:
            self.equal.setdefault(node, []).append(i)
            return
        above = None
        for at in path:
            if at[0] >= deep:
                break
            above = at
        under = self.root if above is None else above[1].get(s[above[0]])
        if isinstance(under, list) and under[0] == deep:
            under[1][s[deep]] = i
            return
        split = [deep, {self.strings[node][deep]: under, s[deep]: i}]
        if above is None:
            self.root = split
        else:
            above[1][s[above[0]]] = split

    def ordered(self) -> list[int]:
        order: list[int] = []
        stack: list[list | int | None] = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            elif node is not None:
                order += [node, *self.equal.get(node, ())]
        return order


def multikey_quicksort(words: np.ndarray, order: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Sorts ``order``, places in the rows of ``words``, within its runs (ascending numbers ``run``); gives the runs of rows that are equal.

    Each run is parted in three by the word at its depth, against the median of
    three of its words: smaller, equal, larger; the equal part goes on one word
    deeper. All runs that are still open take their next step together.
    """
    n, width = words.shape
    first = np.flatnonzero(np.diff(run, prepend=-1))
    size = np.diff(np.append(first, len(run)))
    deep = np.zeros(len(first), np.int64)
    closed: list[tuple[np.ndarray, np.ndarray]] = []
    while len(first):
        over = (size < 2) | (deep >= width)
        closed.append((first[over], size[over]))
        first, size, deep = first[~over], size[~over], deep[~over]
        if not len(first):
            break
        of = np.repeat(np.arange(len(first)), size)
        at = np.arange(len(of)) + np.repeat(first - (np.cumsum(size) - size), size)
        word = words[order[at], deep[of]]
        three = [words[order[p], deep] for p in (first, first + size // 2, first + size - 1)]
        pivot = np.sort(np.stack(three), axis=0)[1][of]
        part = of * 3 + (word >= pivot) + (word > pivot)
        order[at] = order[at[np.argsort(part, kind="stable")]]
        count = np.bincount(part, minlength=3 * len(first)).reshape(-1, 3)
        start = first[:, None] + np.cumsum(count, 1) - count
        some = count > 0
        first, size, deep = start[some], count[some], (deep[:, None] + np.array([0, 1, 0]))[some]
    starts = np.concatenate([f for f, _ in closed]) if closed else np.zeros(0, np.int64)
    mark = np.zeros(len(order), np.int64)
    mark[starts] = 1
    return np.cumsum(mark)


def deep_shallow(table: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``table`` (bytes, of one width) within each group, and bytes shared with the row before.

    Groups come in ascending order; the first row of each shares -1.
    """
    n, width = table.shape
    order = np.argsort(group, kind="stable")
    if not n:
        return order, np.zeros(0, np.int64)
    shallow = min(shallow, width)
    padded = np.zeros((n, -(-shallow // WORD) * WORD), np.uint8)
    padded[:, :shallow] = table[:, :shallow]
    run = multikey_quicksort(padded.view(f">u{WORD}").astype(np.uint64), order, np.cumsum(np.diff(group[order], prepend=group[order[:1]]) != 0))
    if width > shallow:
        edges = np.append(np.flatnonzero(np.diff(run, prepend=-1)), n)
        for a in np.flatnonzero(np.diff(edges) > 1).tolist():
            rows = order[edges[a] : edges[a + 1]]
            order[edges[a] : edges[a + 1]] = rows[BlindTrie([table[r, shallow:].tobytes() for r in rows], width - shallow).ordered()]
    shared = np.full(n, -1, np.int64)
    for i in range(1, n, 10_000):
        a, b = order[i - 1 : min(i + 9_999, n - 1)], order[i : i + 10_000]
        differ = table[a] != table[b]
        shared[i : i + 10_000] = np.where(group[a] == group[b], np.where(differ.any(1), differ.argmax(1), width), -1)
    return order, shared


def repeats(group: np.ndarray, before: np.ndarray, after: np.ndarray, nb: np.ndarray, na: np.ndarray, twice: np.ndarray, length: int, seed: int) -> np.ndarray:
    """For each anchor and each d, whether its string from d bytes before it occurs elsewhere.

    ``before`` has the bytes before the anchors read backwards, ``after`` those
    after the seed; ``nb`` and ``na`` say how many there are; ``twice`` marks
    surroundings that several anchors have.
    """
    n, width = len(group), length - seed + 1
    out = np.zeros((n, width), bool)
    right, shared_r = deep_shallow(after, group)
    left, shared_l = deep_shallow(before, group)
    weight = 1 + twice.astype(np.int64)
    run_l, run_r = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(width):
        need = length - d
        run_r[right] = np.cumsum(shared_r < need - seed)
        run_l[left] = np.cumsum(shared_l < d)
        rows = np.flatnonzero((nb >= d) & (na >= need))
        if len(rows):
            key = run_r[rows] * (n + 1) + run_l[rows]
            by = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[by], prepend=-1))
            many = np.add.reduceat(weight[rows][by], first) > 1
            out[rows[by], d] = np.repeat(many, np.diff(np.append(first, len(by))))
    return out


def covered(found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated strings as (anchor, first byte, end), relative to the anchor."""
    padded = np.zeros((found.shape[0], found.shape[1] + 2), np.int8)
    padded[:, 1:-1] = found
    step = np.diff(padded, axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)  # runs are d = low .. high-1
    return row, -(high - 1), length - low


# ---- the operator ------------------------------------------------------------


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(r1, r2, did, text, m0, m1, ...): r1 and r2 name a row by 128 bits of its id, or of having none, and text; rows of one name are equal and so have equal results."""
    id_, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    names = [F.xxhash64(F.lit(n), id_.isNull(), id_, text).alias(f"r{n}") for n in (1, 2)]
    return docs.select(*names, id_.alias("did"), text.alias("text"), *(F.col(f"`{m}`").alias(f"m{i}") for i, m in enumerate(more)))


def contexts(texts: DataFrame, length: int) -> DataFrame:
    """(h, c, twice, nb, na, around) for rows of ``texts`` (text, reps): the bytes around each anchor named in ``reps``."""
    seed = seed_of(length)
    reach = length - seed

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = textops.raw(b.column("text"))
            out: list[tuple] = []
            reps = b.column("reps").to_pylist()
            for i, rows in enumerate(reps):
                text = buf[off[i] : off[i + 1]].tobytes()
                for r in rows:
                    at = r["at"]
                    nb, na = min(at, reach), min(len(text) - at, length)
                    out.append((r["h"], r["c"], r["twice"], nb, na, text[at - nb : at + na]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["h", "c", "twice", "nb", "na", "around"])

    return texts.mapInArrow(tidy(cut), "h long, c long, twice boolean, nb int, na int, around binary")


def _tables(b: pa.Table, length: int, seed: int) -> tuple:
    nb, na = b.column("nb").to_numpy().astype(np.int64), b.column("na").to_numpy().astype(np.int64)
    buf, off = textops.raw(b.column("around"))
    n, reach = len(nb), length - seed
    step = np.arange(reach)
    buf = np.append(buf, np.uint8(0))
    place = (off[:-1] + nb)[:, None] - 1 - step
    before = np.where(step < nb[:, None], buf[np.maximum(place, 0)], 0).astype(np.uint8)
    place = (off[:-1] + nb + seed)[:, None] + step
    after = np.where(step < (na - seed)[:, None], buf[np.minimum(place, len(buf) - 1)], 0).astype(np.uint8)
    return b.column("h").to_numpy(), before.reshape(n, reach), after.reshape(n, reach), nb, na, b.column("twice").to_numpy(zero_copy_only=False)


AROUND = "g long, same binary, lo int, hi int, h long, c long, twice boolean, nb int, na int, around binary"


def sections(around: DataFrame, length: int) -> DataFrame:
    """Each row of ``around`` (of AROUND), which stands for the strings that start ``lo`` to ``hi - 1`` bytes before its anchor, once for each half of these.

    ``g`` is what the strings of a half share: all from the nearest start to
    the end of the farthest. ``same`` is the digest of all that they cover.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for lo, hi, h, c, twice, nb, na, text in zip(*(b.column(x).to_pylist() for x in ("lo", "hi", "h", "c", "twice", "nb", "na", "around")), strict=True):
                mid = (lo + hi + 1) // 2
                for x, y in ((lo, mid), (mid, hi)):
                    if max(x, length - na) > min(y - 1, nb):
                        continue  # no string of this half lies in the text
                    before, after = min(nb, y - 1), min(na, length - x)
                    some, all_ = text[nb - x : nb + length - y + 1], text[nb - before : nb + after]
                    name = f"{h} {x} {y} ".encode()
                    g = int.from_bytes(hashlib.md5(name + some).digest()[:8], "big", signed=True)
                    out.append((g, hashlib.md5(name + f"{before} ".encode() + all_).digest(), x, y, h, c, twice, before, after, all_))
            cols = list(zip(*out, strict=True)) if out else [[]] * 10
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["g", "same", "lo", "hi", "h", "c", "twice", "nb", "na", "around"])

    return around.mapInArrow(tidy(part), AROUND)


def sorted_repeats(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (g, h, c, twice, nb, na, around) sorted by g: (h, c, lo, hi) of the bytes that repeat around each anchor, whole groups at a time."""
    seed = seed_of(length)

    def answer(t: pa.Table) -> pa.RecordBatch:
        g, before, after, nb, na, twice = _tables(t, length, seed)
        group = np.cumsum(np.diff(g, prepend=g[:1]) != 0)
        found = repeats(group, before, after, nb, na, twice, length, seed)
        found[twice] = False  # these are covered whole in any case
        row, lo, hi = covered(found, length)
        return pa.RecordBatch.from_arrays([*(pa.array(t.column(x).to_numpy()[row]) for x in ("h", "c")), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["h", "c", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            waiting.append(b)
            n += len(b)
            if n >= AT_ONCE:
                t = pa.Table.from_batches(waiting)
                g = t.column("g").to_numpy()
                others = np.flatnonzero(g != g[-1])
                if len(others):
                    whole = int(others[-1]) + 1
                    yield answer(t.slice(0, whole).combine_chunks())
                    waiting, n = t.slice(whole).combine_chunks().to_batches(), len(t) - whole
        if n:
            yield answer(pa.Table.from_batches(waiting).combine_chunks())

    return run


def removed(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(r1, r2, spans): for rows of :func:`_keyed` in which something repeats, arrays of (lo, hi) of covered bytes, overlapping ones included."""
    seed = seed_of(length)
    slim = docs.select("r1", "r2", "did", "text")
    all_ = stored(anchor_table(slim, length), "anchors")
    # stored, as are the sides of other joins below: Spark splits a hot key only where nothing but shuffles lies under a join
    often = stored(all_.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "repeated-seeds")
    some = stored(all_.join(often, "h"), "repeated-anchors")
    dropped(often)
    dropped(all_)
    classes = stored(some.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(F.struct("r1", "r2", "at")).alias("rep")), "surroundings")
    mixed = stored(classes.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "mixed-seeds")

    def around(seeds: DataFrame) -> DataFrame:
        """The different surroundings of ``seeds``, from one row each that has them."""
        reps = classes.join(seeds, "h").select("rep.r1", "rep.r2", F.struct("h", "c", (F.col("m") > 1).alias("twice"), F.col("rep.at").alias("at")).alias("r"))
        by_row = reps.groupBy("r1", "r2").agg(F.collect_list("r").alias("reps"))
        # rows of one name are equal: one of them will do; with did, so that the texts' shuffle is that of the last join
        return contexts(slim.join(by_row, ["r1", "r2"]).dropDuplicates(["r1", "r2"]).select("did", "text", "reps"), length)

    columns = ("g", "h", "c", "twice", "nb", "na", "around")
    parts = around(mixed.where(F.col("k") <= hot).select("h")).withColumn("g", F.col("h")).select(*columns).repartition("g")
    found = []
    open_ = around(mixed.where(F.col("k") > hot).select("h")).select(F.lit(0).alias("lo"), F.lit(length - seed + 1).alias("hi"), "h", "c", "twice", "nb", "na", "around")
    more = bool(mixed.where(F.col("k") > hot).limit(1).count())
    while more:
        halves = stored(sections(open_, length), "sections")
        alike = stored(halves.groupBy("g", "same").agg(F.count("*").alias("m"), F.max("twice").alias("before"), F.min(F.struct("h", "c")).alias("rep")), "alike")
        repeated = halves.where("not twice").join(alike.where("m > 1 or before").select("g", "same"), ["g", "same"])
        # from the farthest start that is in the text to the end of the nearest
        found.append(repeated.select("h", "c", (-F.least(F.col("hi") - 1, "nb")).alias("lo"), F.least(F.lit(length) - F.col("lo"), "na").alias("hi")))
        ones = halves.join(alike.withColumn("again", F.expr("m > 1 or before")).select("g", "same", "rep", "again"), ["g", "same"]).where("h = rep.h and c = rep.c")
        ones = stored(ones.withColumn("twice", F.col("again")).drop("rep", "again", "same"), "section-classes")
        sizes = stored(ones.groupBy("g").agg(F.count("*").alias("k")).where("k > 1"), "section-sizes")
        parts = parts.unionByName(ones.join(sizes.where(F.col("k") <= hot).select("g"), "g").select(*columns).repartition("g"))
        open_ = ones.join(sizes.where(F.col("k") > hot).select("g"), "g").drop("g")
        more = bool(sizes.where(F.col("k") > hot).limit(1).count())
    # surroundings that occur twice are covered from end to end
    found.append(classes.where("m > 1").select("h", "c", F.lit(seed - length).alias("lo"), F.lit(length).alias("hi")))
    marks = parts.sortWithinPartitions("g").mapInArrow(tidy(sorted_repeats(length)), "h long, c long, lo int, hi int")
    for spans in found:
        marks = marks.unionByName(spans)
    at = F.col("at")
    spans = some.join(marks, ["h", "c"]).select(
        "r1", "r2", F.struct(F.greatest(at + F.col("lo"), F.lit(0)).cast("int").alias("lo"), (at + F.col("hi")).cast("int").alias("hi")).alias("s")
    )
    return spans.groupBy("r1", "r2").agg(F.collect_set("s").alias("spans"))


def keep(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of ``text``, the bytes removed, and the removed runs."""
    if not spans:
        return text, 0, 0
    left: list[bytes] = []
    end = gone = runs = 0
    for lo, hi in sorted((s["lo"], min(s["hi"], len(text))) for s in spans):
        if lo > end or not runs:
            left.append(text[end:lo])
            runs += 1
            gone += hi - lo
            end = hi
        elif hi > end:
            gone += hi - end
            end = hi
    left.append(text[end:])
    return b"".join(left), gone, runs


def deduplicate(docs: DataFrame, length: int = LENGTH, more: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, *more) of every row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes, a null one none. Bytes covered by a ``length``-byte
    string that starts anywhere else as well, in the same or another row, are
    removed; rows that repeat an id are rows like others, and equal rows remove
    each other. ``kept`` are the remaining bytes; cuts can part a character.
    A text shorter than ``length`` stays, one of any length is read whole. A row
    without an id is a row like others. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = _keyed(docs, *more)
    joined = rows.join(removed(rows, length, hot), ["r1", "r2"], "left")
    carried = [*more]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = textops.raw(b.column("text"))
            spans = b.column("spans").to_pylist()
            out = []
            for i, s in enumerate(spans):
                text = buf[off[i] : off[i + 1]].tobytes()
                kept, gone, runs = keep(text, s)
                out.append((len(text), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["did", *(f"m{i}" for i in range(len(carried))), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([b.column("did"), *(b.column(f"m{i}") for i in range(len(carried))), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    slim = joined.select("did", "text", "spans", *(f"m{i}" for i in range(len(carried))))
    kinds = dict(slim.dtypes)
    schema = ", ".join(["did long", *(f"m{i} {kinds[f'm{i}']}" for i in range(len(carried))), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"])
    done = slim.mapInArrow(tidy(cut), schema)
    return done.select(
        F.col("did").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept",
        *(F.col(f"m{i}").alias(m) for i, m in enumerate(carried)),
    )


def deduplicated_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with what :func:`deduplicate` leaves as text, n_chars with it; characters that a cut parts go, and texts of which nothing but white space is left."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = deduplicate(docs, length, others)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], b.schema.names[:-1] + ["text"])

    slim = out.select("doc_id", *(F.col(f"`{c}`").alias(f"m{i}") for i, c in enumerate(others)), "n_removed", "kept")
    kinds = dict(slim.dtypes)
    schema = ", ".join(["doc_id long", *(f"m{i} {kinds[f'm{i}']}" for i in range(len(others))), "n_removed long, text string"])
    done = slim.mapInArrow(tidy(whole), schema).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    named = {c: F.col(f"m{i}") for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*(named[c].alias(c) for c in docs.columns))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
