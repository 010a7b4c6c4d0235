"""Token-id files in patched frame-of-reference blocks.

A file holds the ids of consecutive documents as blocks of a fixed number of ids. A block stores its smallest id,
then every id less that minimum, packed at the width that a percentile of the block's ids needs. The high bits of
the others go to the block's exception list. The byte offset of every block is in the file's index, so any range
of ids is read without what stands before it.

Layout, all little-endian: magic; blocks; block offsets (u64, one more than blocks); document ids (i64); ids of each
document (u32); footer of counts, CRC-32 of all before it, and magic. A block is minimum (u32), width (u8), zero
(u8), ids (u16), exceptions (u16), packed bits, exception places (u16), exception high parts (u32).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import get_range, id_and_text, map_batches, new_folder, place, put_file, spread_out
from lectern.llm.tokens import encoder

MAGIC = b"LECPFOR1"
BLOCK_IDS = 1024
PERCENTILE = 0.95
#: Ids after which a task starts another file; a file exceeds it by one document at most.
FILE_IDS = 1 << 22
_HEAD = struct.Struct("<IBBHH")
_FOOT = struct.Struct("<QQQQI8s")
MANIFEST = "part int, seq int, file string, n_docs long, n_ids long, first_doc long"


def pack_rows(rows: np.ndarray, width: int) -> np.ndarray:
    """Pack each row's values at ``width`` bits."""
    kind, bits = ("<u2", 16) if width <= 16 else ("<u4", 32)
    raw = np.ascontiguousarray(rows.astype(kind)).view(np.uint8).reshape(*rows.shape, bits // 8)
    wide = np.unpackbits(raw, axis=2, bitorder="little")[:, :, :width]
    return np.packbits(wide.reshape(len(rows), -1), axis=1, bitorder="little")


def unpack(packed: np.ndarray, count: int, width: int) -> np.ndarray:
    """Undo :func:`pack_rows` for one row."""
    if not width:
        return np.zeros(count, dtype=np.uint32)
    bits = np.unpackbits(packed, count=count * width, bitorder="little").reshape(count, width)
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def encode_rows(rows: np.ndarray, percentile: float) -> list[bytes]:
    """The blocks of a matrix with one block's values a row."""
    low = rows.min(axis=1)
    delta = rows - low[:, None]
    needed = np.frexp(delta.astype(np.float64))[1].astype(np.uint8)
    at = int(np.ceil(percentile * (rows.shape[1] - 1)))
    widths = np.partition(needed, at, axis=1)[:, at]
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        which = np.flatnonzero(widths == width)
        for some in np.array_split(which, -(-len(which) // 256)):
            part = delta[some]
            packed = pack_rows(part & np.uint32((1 << width) - 1), width) if width else None
            for k, row in enumerate(some.tolist()):
                odd = np.flatnonzero(needed[row] > width)
                high = part[k][odd] >> np.uint32(width) if width < 32 else part[k][odd]
                head = _HEAD.pack(int(low[row]), width, 0, rows.shape[1], len(odd))
                body = packed[k].tobytes() if width else b""
                out[row] = head + body + odd.astype("<u2").tobytes() + high.astype("<u4").tobytes()
    return out


def encode_blocks(ids: np.ndarray, block: int = BLOCK_IDS, percentile: float = PERCENTILE) -> list[bytes]:
    """All blocks of an id sequence; only the last may be short."""
    full = len(ids) // block
    blocks = []
    for start in range(0, full, 1024):
        stop = min(full, start + 1024)
        blocks += encode_rows(ids[start * block : stop * block].reshape(-1, block), percentile)
    if len(ids) % block:
        blocks += encode_rows(ids[full * block :].reshape(1, -1), percentile)
    return blocks


def decode_block(raw: bytes) -> np.ndarray:
    low, width, _, count, odd = _HEAD.unpack_from(raw)
    size = -(-count * width // 8)
    at = _HEAD.size
    values = unpack(np.frombuffer(raw, np.uint8, size, at), count, width)
    if odd:
        places = np.frombuffer(raw, "<u2", odd, at + size)
        high = np.frombuffer(raw, "<u4", odd, at + size + 2 * odd)
        values[places] |= high << np.uint32(width)
    return values + np.uint32(low)


def file_bytes(doc_ids: list[int], counts: list[int], ids: np.ndarray, block: int, percentile: float) -> bytes:
    blocks = encode_blocks(ids, block, percentile)
    starts = np.zeros(len(blocks) + 1, dtype="<u8")
    np.cumsum([len(b) for b in blocks], out=starts[1:])
    starts += len(MAGIC)
    body = b"".join(
        [MAGIC, *blocks, starts.tobytes(), np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<u4").tobytes()]
    )
    return body + _FOOT.pack(len(blocks), block, len(doc_ids), len(ids), zlib.crc32(body), MAGIC)


class TokenFile:
    """One file, open for reading its document table and ranges of its ids."""

    def __init__(self, uri: str):
        self.uri = uri
        system, path = place(uri)
        size = system.get_file_info(path).size
        blocks, self.block, docs, self.n_ids, self.crc, magic = _FOOT.unpack(get_range(uri, size - _FOOT.size, _FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token-id file")
        self.body = size - _FOOT.size
        table = get_range(uri, self.body - 8 * (blocks + 1) - 12 * docs, 8 * (blocks + 1) + 12 * docs)
        self.starts = np.frombuffer(table, "<u8", blocks + 1)
        self.doc_ids = np.frombuffer(table, "<i8", docs, 8 * (blocks + 1))
        self.counts = np.frombuffer(table, "<u4", docs, 8 * (blocks + 1) + 8 * docs)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only the blocks that hold them are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        base = int(self.starts[first])
        raw = get_range(self.uri, base, int(self.starts[last + 1]) - base)
        parts = [
            decode_block(raw[int(self.starts[b]) - base : int(self.starts[b + 1]) - base]) for b in range(first, last + 1)
        ]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def check(self) -> None:
        if zlib.crc32(get_range(self.uri, 0, self.body)) != self.crc:
            raise ValueError(f"{self.uri} is damaged")


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
    file_ids: int = FILE_IDS,
    block: int = BLOCK_IDS,
    percentile: float = PERCENTILE,
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the ids in ascending id order.

    Returns the manifest, one row a file with ``start``, the ids in all files before it. It is a written table:
    a file that a lost or repeated task left is in no manifest and is never read. A missing text is an empty one
    (its only id is ``end_id``), rows without an id are left out, repeated ids stay as often as they come.
    """
    spark = docs.sparkSession
    target = folder or new_folder(spark, "token-files")

    def write(batches):
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int] = []
        counts: list[int] = []
        held: list[bytes] = []
        total = 0

        def flush():
            nonlocal seq, total
            ids = np.frombuffer(b"".join(held), "<u4")
            uri = put_file(target, f"ids-{part:06d}-{seq:06d}", file_bytes(names, counts, ids, block, percentile))
            row = [[part], [seq], [uri], [len(names)], [total], [names[0]]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds)],
                names=["part", "seq", "file", "n_docs", "n_ids", "first_doc"],
            )
            names.clear(), counts.clear(), held.clear()
            seq, total = seq + 1, 0
            return out

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1).to_pylist())):
                names.append(doc)
                counts.append(len(raw) // 4 + 1)
                held += (raw, end)
                total += counts[-1]
                if total >= file_ids:
                    yield flush()
        if names:
            yield flush()

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = new_folder(spark, "token-manifest")
    map_batches(ordered, write, MANIFEST).write.parquet(manifest)
    files = spark.read.schema(MANIFEST).parquet(manifest)
    # One row a task here, so the running total is short even over very many files.
    tasks = files.groupBy("part").agg(F.sum("n_ids").alias("ids"), F.min("first_doc").alias("low"))
    ahead = Window.orderBy("low", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = tasks.select("part", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        files.withColumn("inner", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(base, "part")
        .select("file", "n_docs", "n_ids", "first_doc", (F.col("base") + F.col("inner")).cast("long").alias("start"))
    )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the files: ``doc_id``, ``start``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit)."""
    names = ["doc_id", "start", "n_tokens", "ids"]

    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source = TokenFile(uri)
                source.check()
                ends = np.cumsum(source.counts, dtype=np.int64)
                for some in np.array_split(np.arange(len(ends)), -(-len(ends) // 256)):
                    first = int(ends[some[0]] - source.counts[some[0]])
                    ids = source.ids(first, int(ends[some[-1]])).astype("<u4")
                    stops = ends[some] - first
                    begins = stops - source.counts[some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(source.doc_ids[some], pa.int64()),
                            pa.array(begins + first + base, pa.int64()),
                            pa.array(source.counts[some].astype(np.int64), pa.int64()),
                            pa.array([ids[a:b].tobytes() for a, b in zip(begins, stops)], pa.binary()),
                        ],
                        names=names,
                    )

    work = spread_out(manifest.select("file", "start"), "file")
    return map_batches(work, read, "doc_id long, start long, n_tokens long, ids binary")
