"""Token-ID / binary output: patched frame-of-reference blocks.

File format (little endian): the blocks; then for each document its id, first id's place in the file and number of ids
(int64 each); then each block's start (int64); then a tail of five int64: MAGIC, ids, documents, blocks, length of the blocks.
A block holds up to BLOCK ids: minimum (u4), count (u2), width (u1), pad (u1), exceptions (u2), pad (u2); `width` bit planes of the
offsets from the minimum, BLOCK/8 bytes each; then exceptions: places (u2) and high parts (u4). The width is the
bits that WIDTH_SHARE of the block's offsets need; larger offsets keep their low bits in the planes, the rest as exceptions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.encoder import encoder, with_end
from fathomline.llm.storage import new_path
from fathomline.llm.text import lean, slices

MAGIC = 0x0130524F4650
BLOCK = 512
WIDTH_SHARE = 0.9
END_ID = 0
HEAD = np.dtype([("least", "<u4"), ("count", "<u2"), ("width", "u1"), ("_", "u1"), ("exceptions", "<u2"), ("__", "<u2")])
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack(ids: np.ndarray, share: float = WIDTH_SHARE) -> list[bytes]:
    """Blocks of these ids; all but the last hold BLOCK of them."""
    n = len(ids)
    if not n:
        return []
    full = np.concatenate([ids, np.full(-n % BLOCK, ids[-1])]).astype(np.uint32).reshape(-1, BLOCK)
    least = full.min(1)
    offset = full - least[:, None]
    at_share = np.partition(offset, int(np.ceil(share * BLOCK)) - 1, axis=1)[:, int(np.ceil(share * BLOCK)) - 1]
    width = np.where(at_share > 0, np.floor(np.log2(np.maximum(at_share, 1))).astype(np.int64) + 1, 0)
    planes = np.stack([np.packbits(((offset >> np.uint32(j)) & 1).astype(np.uint8), axis=1) for j in range(int(width.max()))], 1) if width.max() else np.zeros((len(full), 0, BLOCK // 8), np.uint8)
    high = (offset.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    head = np.zeros(len(full), HEAD)
    head["least"], head["width"], head["count"] = least, width, BLOCK
    head["count"][-1] = n - (len(full) - 1) * BLOCK
    head["exceptions"] = (high > 0).sum(1)
    blocks = []
    for b in range(len(full)):
        odd = np.flatnonzero(high[b]) if head["exceptions"][b] else ()
        blocks.append(head[b].tobytes() + planes[b, : width[b]].tobytes() + (odd.astype("<u2").tobytes() + high[b][odd].astype("<u4").tobytes() if len(odd) else b""))
    return blocks


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start there."""
    out = np.zeros((len(starts), BLOCK), np.uint32)
    counts = np.zeros(len(starts), np.int64)
    heads = [np.frombuffer(data, HEAD, 1, int(s))[0] for s in starts]
    widths = np.array([h["width"] for h in heads])
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        planes = np.stack([np.frombuffer(data, np.uint8, int(w) * BLOCK // 8, int(starts[b]) + HEAD.itemsize) for b in own]).reshape(len(own), int(w), BLOCK // 8)
        value = np.zeros((len(own), BLOCK), np.uint32)
        for j in range(int(w)):
            value |= np.unpackbits(planes[:, j], axis=1).astype(np.uint32) << np.uint32(j)
        out[own] = value
    for b, h in enumerate(heads):
        counts[b] = h["count"]
        if k := int(h["exceptions"]):
            at = int(starts[b]) + HEAD.itemsize + int(h["width"]) * BLOCK // 8
            out[b, np.frombuffer(data, "<u2", k, at)] |= np.frombuffer(data, "<u4", k, at + 2 * k) << np.uint32(h["width"])
    out += np.array([h["least"] for h in heads], np.uint32)[:, None]
    return out.reshape(-1)[(np.arange(BLOCK) < counts[:, None]).reshape(-1)]


@lean
def write_part(batches, folder: str, vocabulary: str, end_id: int):
    """Encodes the documents of one partition into one file; a repeated attempt renames its own file over the first's."""
    store, root = fs.FileSystem.from_uri(folder)
    task = TaskContext.get()
    part = task.partitionId()
    own, name = f"{root}/.{part}-{task.taskAttemptId()}", f"{root}/part-{part:06d}.pfor"
    encode, out, rest = encoder(vocabulary), None, np.zeros(0, "<u4")
    docs, sizes, starts, place, total = [], [], [], 0, 0
    for batch in batches:
        ids_of = batch.column("doc_id").cast(pa.int64())
        for first, end, data, at in slices(batch.column("text"), 1 << 20):
            if out is None:
                store.create_dir(root)
                out = store.open_output_stream(own)
            ids, where = with_end(*encode(data, at), end_id)
            docs.append(ids_of.slice(first, end - first))
            sizes.append(np.diff(where))
            total += len(ids)
            ids = np.concatenate([rest, ids])
            cut = len(ids) // BLOCK * BLOCK
            rest = ids[cut:]
            blocks = pack(ids[:cut])
            starts.append(place + np.cumsum([0, *map(len, blocks)])[:-1])
            place += sum(map(len, blocks))
            out.write(b"".join(blocks))
    if out is None:
        return
    blocks = pack(rest)
    starts.append(place + np.cumsum([0, *map(len, blocks)])[:-1])
    place += sum(map(len, blocks))
    out.write(b"".join(blocks))
    doc_ids = pa.chunked_array(docs)
    size = np.concatenate(sizes)
    nulls = np.asarray(doc_ids.is_null())
    starts = np.concatenate(starts)
    out.write(np.stack([np.asarray(doc_ids.fill_null(0)), np.cumsum(size) - size, np.where(nulls, -size, size)], 1).astype("<i8").tobytes())
    out.write(starts.astype("<i8").tobytes())
    out.write(np.array([MAGIC, total, len(size), len(starts), place], "<i8").tobytes())
    out.close()
    store.move(own, name)
    yield pa.RecordBatch.from_pylist([{"part": part, "path": name, "n_documents": len(size), "n_ids": total}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_documents", pa.int64()), ("n_ids", pa.int64())]))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> list:
    """Writes `docs` (doc_id, text) in ascending doc_id order (null first; ties by text) into files of one folder.

    Null text counts as empty; repeated rows are written as often as they come. Returns the files' rows (part, path,
    n_documents, n_ids) in order, one for each partition that had rows.
    """
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return sorted(parts.mapInArrow(lambda batches: write_part(batches, folder, vocabulary, end_id), "part int, path string, n_documents long, n_ids long").collect())


def read_part(folder: str, path: str, base: int, step: int = 4096):
    """Rows of one file's documents, its blocks read `step` at a time."""
    store, _ = fs.FileSystem.from_uri(folder)
    with store.open_input_file(path) as file:
        size = file.size()
        magic, _, n_docs, n_blocks, place = np.frombuffer(file.read_at(40, size - 40), "<i8")
        assert magic == MAGIC, path
        index = np.frombuffer(file.read_at(int(24 * n_docs), int(place)), "<i8").reshape(-1, 3)
        starts = np.frombuffer(file.read_at(int(8 * n_blocks), int(place + 24 * n_docs)), "<i8")
        ends = np.append(starts[1:], place)
        sizes, crcs, done, got, crc = np.abs(index[:, 2]), [], 0, 0, 0
        for b in range(0, int(n_blocks), step):
            e = min(b + step, int(n_blocks))
            raw = memoryview(unpack(file.read_at(int(ends[e - 1] - starts[b]), int(starts[b])), starts[b:e] - starts[b]).astype("<u4").tobytes())
            at = 0
            while at < len(raw):
                take = min(len(raw) - at, 4 * (int(sizes[done]) - got))
                crc = zlib.crc32(raw[at : at + take], crc)
                at, got = at + take, got + take // 4
                if got == sizes[done]:
                    crcs.append(crc)
                    done, got, crc = done + 1, 0, 0
    return pa.RecordBatch.from_arrays([pa.array(index[:, 0], mask=index[:, 2] < 0), pa.array(base + index[:, 1]), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark, folder: str, files: list) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    rows, base = [], 0
    for f in files:
        rows.append((f.part, f.path, base))
        base += f.n_ids
    table = spark.createDataFrame(rows, "part int, path string, base long").repartition(max(1, len(rows)), "part")

    @lean
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield read_part(folder, row["path"], row["base"])

    return table.mapInArrow(read, RESULT)


def token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the documents' ids and reads them back; an empty table gives no file and no row."""
    folder = new_path(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, vocabulary))
