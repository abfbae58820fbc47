"""Best-fit packing planned on the histogram of lengths.

Documents become token pieces of at most ``width``; a piece's length is all
that packing needs, so best-fit decreasing runs over the counts of the lengths
(at most ``width`` numbers) on the driver. Its plan says which ranks of a length
go to which sequences at which place; pieces take their slots by joining on
their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddystream.llm.common import partitions, plain, small_batches, stored, tidy

WIDTH = 2048
END_ID = 0
#: A plan of more rows than this is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 50_000
#: Characters whose classes no Unicode version has changed; other texts take the slower library.
_STABLE = re.compile(r"[^\x00-ɏ‐-‧]|<\|endoftext\|>")
_encoders: dict = {}


def encoders(name: str):
    """The vocabulary ``name`` in the tokenizers library, and in tiktoken where the same ranks are there.

    Both give equal ids (a test compares them); tiktoken takes a quarter of the time.
    """
    if name not in _encoders:
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(public_tokenizers.path(name))
        fast = None
        try:
            import tiktoken

            with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, OSError):
            pass
        _encoders[name] = slow, fast
    return _encoders[name]


def encode(text: str, name: str) -> list[int]:
    slow, fast = encoders(name)
    if fast is None or _STABLE.search(text):
        return slow.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def token_pieces(docs: DataFrame, tokenizer: str, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of ``docs`` (doc_id, text): ids and an end id, cut if longer than ``width``.

    All pieces of a cut document are full but the first. A null text is empty: one end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or "", tokenizer), end_id], "<u4")
                first = (len(ids) - 1) % width + 1
                edges = [0, *range(first, len(ids) + 1, width)]
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    out.append((doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    docs = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], width: int = WIDTH) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, rank_from, rank_to, first_sequence, per_sequence, offset).

    Ranks ``rank_from <= r < rank_to`` of a length lie, ``per_sequence`` by
    ``per_sequence``, in sequences from ``first_sequence`` on, from ``offset``
    on. Sequences of one fill are kept as runs, so the work follows the number
    of runs, not of documents. An item goes where the least room is left; the
    sequence that takes one is then again the tightest, so a run is filled
    sequence by sequence.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
    rooms: list[int] = []
    made = 0

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                per = width // length
                first, n, room = made, -(-left // per), width
                made += n
            else:
                room = rooms[i]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[i]
                per = room // length
            whole = min(n, left // per)
            if whole:
                rows.append((length, rank, rank + whole * per, first, per, width - room))
                keep(room - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            if whole < n and left:  # fewer than one sequence's share are left
                rows.append((length, rank, rank + left, first + whole, left, width - room))
                keep(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            keep(room, first + whole, n - whole)
    return rows


def pack(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset.

    Ranks within a length are counted in salted parts whose sizes are summed
    first, so a length that a third of all pieces have is spread over tasks.
    Equal rows take different slots. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    n_salts = max(partitions(spark), 8)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_salts)))
    # 2048 lengths at most, so this fits the driver whatever the input
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    slots = spark.createDataFrame(plan(histogram, width), "length long, rank_from long, rank_to long, first long, per long, base long")
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(within) - 1)
    ranked = ranked.join(parts, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("skip"))
    if slots.count() <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    at: Column = F.col("rank") - F.col("rank_from")
    placed = ranked.join(slots, (ranked["length"] == slots["length"]) & F.expr("rank >= rank_from and rank < rank_to"))
    return placed.select(
        *(ranked[c] for c in pieces.columns),
        (F.col("first") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("base") + at % F.col("per") * ranked["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", width: int = WIDTH) -> DataFrame:
    """Pieces of all documents with their places; the pieces are written once, as tokenizing is the dear part."""
    return pack(stored(token_pieces(docs, tokenizer, width), "pieces"), width)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
