"""Best-fit packing: large-item matching, then best fit of the small ones, decided on the counts of the sizes.

Piece sizes lie between 1 and the capacity, so the packing of any corpus is a table over at most `capacity` sizes: how many
pieces of each size, and in which kinds of sequences they go. That table is bounded by the capacity, not by the
corpus; the pieces then look their place up by (size, rank among the pieces of that size).
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.encoder import encoder, with_end
from fathomline.llm.storage import staged
from fathomline.llm.text import lean, slices

CAPACITY = 1024
END_ID = 2
PIECES = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, place long"


@lean
def cut_pieces(batches, vocabulary: str, capacity: int, end_id: int):
    """Pieces of each document, with their place among this partition's pieces of that length."""
    encode, part = encoder(vocabulary), TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    for batch in batches:
        doc_ids = batch.column("doc_id").cast(pa.int64())
        for first, _, data, at in slices(batch.column("text"), 1 << 20):
            ids, where = with_end(*encode(data, at), end_id)
            size = np.diff(where)
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            short = size - (n - 1) * capacity  # of the first piece
            start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, short[doc], capacity)
            raw, begin = memoryview(ids.tobytes()), 4 * (where[doc] + start)
            crc = [zlib.crc32(raw[b : b + 4 * k]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            counts = np.bincount(length, minlength=capacity + 1)
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
            place += seen[length]
            seen += counts
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), part, np.int32)), doc_ids.take(pa.array(first + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64()), pa.array(place)], ["part", "doc_id", "piece", "start", "length", "ids_crc32", "place"])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of (size, from rank, to rank, first sequence, pieces in each sequence, offset of the first).

    Pieces above a third of the capacity go at most two to a sequence: the largest open one takes the largest that still
    fits. Smaller ones, from the largest down, go where the least room is left over. Sequences filled
    alike are kept as one run, so the work and the result are bounded by the number of sizes.
    """
    left = {s: n for s, n in counts.items() if n}
    used: dict[int, int] = defaultdict(int)  # ranks given away
    runs, gaps = [], defaultdict(list)  # room -> [(first sequence, number)]
    sequences = 0

    def give(size: int, first: int, number: int, each: int, offset: int) -> None:
        runs.append((size, used[size], used[size] + number * each, first, each, offset))
        used[size] += number * each
        left[size] -= number * each

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1
        if i < 0:
            number = left[a]
            give(a, sequences, number, 1, 0)
            gaps[capacity - a].append((sequences, number))
        else:
            b = large[i]
            number = left[a] // 2 if a == b else min(left[a], left[b])
            if a == b and not number:
                number = 1
                give(a, sequences, 1, 1, 0)
                other = large[i - 1] if i else 0
                if other:
                    give(other, sequences, 1, 1, a)
                gaps[capacity - a - other].append((sequences, 1))
                b = other or a
            elif a == b:
                give(a, sequences, number, 2, 0)
                gaps[capacity - 2 * a].append((sequences, number))
            else:
                give(a, sequences, number, 1, 0)
                give(b, sequences, number, 1, a)
                gaps[capacity - a - b].append((sequences, number))
            if b != a and not left[b]:
                large.remove(b)
        if not left[a]:
            large.remove(a)
        sequences += number
    rooms = sorted(r for r in gaps if r)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                number = -(-left[s] // each)
                first, room, sequences = sequences, capacity, sequences + number
            else:
                room = rooms[i]
                first, number = gaps[room].pop()
                if not gaps[room]:
                    rooms.pop(i)
                each = room // s
            whole = min(number, left[s] // each)
            for begin, n, k in ((first, whole, each), (first + whole, 1, left[s] - whole * each)):
                if n and 0 < k <= each and begin < first + number:
                    give(s, begin, n, k, capacity - room)
                    if rest := room - k * s:
                        if not gaps[rest]:
                            bisect.insort(rooms, rest)
                        gaps[rest].append((begin, n))
                    whole = begin + n - first
            if whole < number and room < capacity:
                if not gaps[room]:
                    bisect.insort(rooms, room)
                gaps[room].append((first + whole, number - whole))
    return runs


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document with the sequence and the offset that each is packed at.

    Null text counts as empty (one piece, the end id); repeated rows are packed as often as they come; an empty table
    gives no rows. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    pieces = staged(docs.select("doc_id", "text").mapInArrow(lambda b: cut_pieces(b, vocabulary, capacity, end_id), PIECES), "pieces")
    parts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(plan(counts, capacity), "length int, lo long, hi long, first long, each long, at long")
    ranked = pieces.join(before.drop("n"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "place", "part")
    nth = F.col("rank") - F.col("lo")
    fits = (ranked["length"] == runs["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(F.broadcast(runs), fits).select("doc_id", "piece", "start", ranked["length"].cast("long").alias("length"), "ids_crc32", (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("at") + nth % F.col("each") * ranked["length"]).alias("offset"))
