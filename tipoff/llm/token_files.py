"""Token ids in binary files, packed by a static range asymmetric numeral system.

A folder holds ``table`` (one frequency table for all blocks, as Parquet), ``data`` (binary files of independent blocks in
ascending document order) and ``index`` (where each block is and which tokens and documents it has, as Parquet).

A block has up to ``BLOCK_TOKENS`` ids of consecutive documents, dealt in turn to ``LANES`` states of 64 bits. The writer goes
backwards, the reader forwards, all states at once; a state that falls below 2**31 takes the next 32-bit word. Before every
``CHECKPOINT_STEPS``-th step the states and the place in the words are stored, so reading may begin in the middle of a block.
Two checksums cover a block: one its bytes, one its ids. Layout, little-endian:

    head      magic, version, lanes, scale bits, bytes of the block, file number, tokens, words, checkpoints, pieces,
              first token within the file, crc32 of the ids, crc32 of the table
    pieces    for each piece of a document: doc_id, whether it is not null, whether a document begins, number of ids
    restarts  for each checkpoint: word offset, the states
    words     32-bit words
    crc32     of all bytes before

Spark's own text writer puts the files in place (each block is followed by a line feed), so a task that is run again leaves
no second copy. Nothing here is read or written through local paths.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm.chunks import Words, chunked
from tipoff.llm.common import packed, row_batches
from tipoff.scratch import stage

LANES = 256
BLOCK_TOKENS = 1 << 17
CHECKPOINT_STEPS = 128
SCALE_BITS = 20
# tokens of a file: as many files as keep all cores busy, between these bounds
LEAST_FILE, LARGEST_FILE = 1 << 20, 1 << 26

MAGIC = b"TOKB"
HEAD = struct.Struct("<4sHHIIIIIIIQII")
HEAD_SIZE = HEAD.size
LOW = 1 << 31


class Table:
    """Frequencies of all ids, scaled so that they add up to 2**bits and every id has at least one slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        total = int(self.freq.sum())
        self.bits = total.bit_length() - 1
        if total != 1 << self.bits or not freq.all():
            raise ValueError("frequencies have to be positive and add up to a power of two")
        self.start = np.cumsum(self.freq) - self.freq
        self.owner = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    def __reduce__(self):
        return Table, (self.freq.astype(np.int64),)

    @classmethod
    def scaled(cls, counts: np.ndarray) -> Table:
        """From counts of all ids: one slot each, the rest in proportion, what is left to the most frequent id."""
        bits = max(SCALE_BITS, (4 * len(counts)).bit_length())
        spare, total = (1 << bits) - len(counts), max(int(counts.sum()), 1)
        freq = np.array([1 + int(c) * spare // total for c in counts.tolist()], np.int64)
        freq[int(counts.argmax())] += (1 << bits) - int(freq.sum())
        return cls(freq)


def pack(ids: np.ndarray, table: Table) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The words of ``ids`` and, by checkpoint, (word offset, states). States are below 2**63."""
    steps = -(-len(ids) // LANES)
    freq, start = table.freq.view(np.int64)[ids], table.start.view(np.int64)[ids]
    most, rest = freq.view(np.uint64) << np.uint64(63 - table.bits), (1 << table.bits) - freq
    states = np.full(LANES, LOW, np.int64)
    words: list[np.ndarray] = []
    marks, written = [], 0
    for step in range(steps - 1, -1, -1):
        a = step * LANES
        f = freq[a : a + LANES]
        x = states[: len(f)]
        over = (x.view(np.uint64) >= most[a : a + LANES]).nonzero()[0]
        if len(over):
            out = x[over]
            words.append(out.astype(np.uint32))
            written += len(out)
            x[over] = out >> 32
        # (q << bits) + (x - q * f) + start
        q = x // f
        q *= rest[a : a + LANES]
        x += q
        x += start[a : a + LANES]
        if step % CHECKPOINT_STEPS == 0:
            marks.append((written, states.astype(np.uint64)))
    flat = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return flat, [(written - have, s) for have, s in reversed(marks)]


def unpack(words: np.ndarray, states: np.ndarray, n: int, table: Table) -> np.ndarray:
    """``n`` ids from the states at a checkpoint and the words from its offset on."""
    out = np.empty(n, np.uint32)
    mask, bits = (1 << table.bits) - 1, table.bits
    freq, start = table.freq.view(np.int64), table.start.view(np.int64)
    states, words, at = states.astype(np.int64), words.astype(np.int64), 0
    for a in range(0, n, LANES):
        x = states[: min(LANES, n - a)]
        slot = x & mask
        found = table.owner.take(slot)
        out[a : a + LANES] = found
        slot -= start.take(found)
        x >>= bits
        x *= freq.take(found)
        x += slot
        low = (x < LOW).nonzero()[0]
        if len(low):
            x[low] = x[low] << 32 | words[at : at + len(low)]
            at += len(low)
    return out


class Block:
    """One block from its bytes; ``ValueError`` if a checksum or the table is not as written."""

    def __init__(self, data: bytes, table: Table):
        (magic, self.version, self.lanes, bits, size, self.file, self.n, n_words, n_marks, n_pieces, self.first, self.crc, table_crc) = HEAD.unpack_from(data)
        if magic != MAGIC or self.version != 1 or self.lanes != LANES or size != len(data):
            raise ValueError("not a block of this format")
        if zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("block is damaged")
        if bits != table.bits or table_crc != table.crc:
            raise ValueError("block was written with another table")
        self.table, at = table, HEAD_SIZE

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, kind, k, at)
            at += part.nbytes
            return part

        self.doc_id, self.known, self.begins, self.sizes = take("<i8", n_pieces), take("u1", n_pieces), take("u1", n_pieces), take("<u4", n_pieces)
        self.offsets, self.states = take("<u4", n_marks), take("<u8", n_marks * LANES).reshape(n_marks, LANES)
        self.words = take("<u4", n_words)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids first..last-1 of the block, read from the nearest checkpoint before; a whole block is checked."""
        last = self.n if last is None else min(last, self.n)
        if first >= last:
            return np.zeros(0, np.uint32)
        mark = first // (LANES * CHECKPOINT_STEPS)
        at = mark * LANES * CHECKPOINT_STEPS
        out = unpack(self.words[self.offsets[mark] :], self.states[mark], last - at, self.table)[first - at :]
        if len(out) == self.n and zlib.crc32(out.astype("<u4").tobytes()) != self.crc:
            raise ValueError("ids are not as written")
        return out


def block_bytes(file: int, first: int, pieces: list[tuple[int | None, bool, int]], ids: np.ndarray, table: Table) -> bytes:
    """The bytes of a block of (doc_id, begins, number of ids) pieces."""
    words, marks = pack(ids, table)
    known = np.array([p[0] is not None for p in pieces], np.uint8)
    body = b"".join([
        np.array([p[0] or 0 for p in pieces], "<i8").tobytes(), known.tobytes(),
        np.array([p[1] for p in pieces], np.uint8).tobytes(), np.array([p[2] for p in pieces], "<u4").tobytes(),
        np.array([m[0] for m in marks], "<u4").tobytes(), b"".join(m[1].astype("<u8").tobytes() for m in marks),
        words.astype("<u4").tobytes(),
    ])
    head = HEAD.pack(
        MAGIC, 1, LANES, table.bits, HEAD_SIZE + len(body) + 4, file, len(ids), len(words), len(marks), len(pieces),
        first, zlib.crc32(ids.astype("<u4").tobytes()), table.crc,
    )
    return head + body + zlib.crc32(head + body).to_bytes(4, "little")


def head_at(content: memoryview, at: int) -> tuple:
    return HEAD.unpack_from(content, at)


def blocks_in(content: memoryview):
    """(offset, bytes) of every block of a file."""
    at = 0
    while at < len(content):
        if bytes(content[at : at + 4]) != MAGIC:
            raise ValueError("file is damaged")
        size = head_at(content, at)[4]
        yield at, bytes(content[at : at + size])
        at += size + 1


def id_kind(size: int) -> str:
    """How ids of a vocabulary of ``size`` are held between jobs: little-endian, 16 or 32 bits."""
    return "<u2" if size <= 1 << 16 else "<u4"


def encoded(text: Column, path: str, end_id: int | None = None) -> Column:
    """Token ids of a text by the tokenizers library, with ``end_id`` behind them, as binary numbers of ``id_kind``. Null is an
    empty text."""
    kind = id_kind(chunked(Words, path).size)
    tail = np.array([] if end_id is None else [end_id], kind).tobytes()

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        out: list[bytes] = []
        for part in row_batches([pa.RecordBatch.from_arrays([column], ["text"])], 1 << 22, text=0):
            ids, ends = chunked(Words, path).encode_column(part.column(0))
            ids, ends = ids.astype(kind), ends.tolist()
            out.extend(ids[a:b].tobytes() + tail for a, b in zip(ends, ends[1:]))
        return pa.array(out, pa.binary())

    return run(text)


def _counts(batches, kind):
    total = np.zeros(0, np.int64)
    for batch in batches:
        got = np.bincount(packed(batch.column(0))[0].view(kind))
        if len(got) > len(total):
            total, got = got, total
        total[: len(got)] += got
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id 0..size-1 occurs in binary column ``ids``; the vocabulary bounds what comes to the driver."""
    kind = id_kind(size)
    found = rows.select("ids").mapInArrow(lambda b: _counts(b, kind), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def write(docs: DataFrame, path: str, size: int) -> None:
    """Write columns doc_id (bigint or null) and ids (binary numbers of ``id_kind``, below ``size``) to folder ``path``, by ascending doc_id, nulls first; rows of one doc_id follow each other in an order of their ids' hash.

    Frequencies cover all rows. Documents are dealt to files by ranges, so no task or file gets more than its share, equal rows
    included; a document stays in one file. Ids are held in memory by block and document. Other columns are left out.
    """
    spark = docs.sparkSession
    rows = stage(docs.select("doc_id", "ids", F.xxhash64("ids").alias("h")), "tokens")
    counts = frequencies(rows, size)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(Table.scaled(counts).freq)], "id int, freq bigint").coalesce(1).write.parquet(f"{path}/table")
    table = read_table(spark, path)
    kind = id_kind(size)
    share = int(counts.sum()) // (4 * spark.sparkContext.defaultParallelism)
    files = 1 + int(counts.sum()) // min(max(share, LEAST_FILE), LARGEST_FILE)

    def put(batches):
        file, at = TaskContext.get().partitionId(), 0
        pieces: list[tuple[int | None, bool, int]] = []
        held: list[np.ndarray] = []
        room = BLOCK_TOKENS

        def close():
            nonlocal pieces, held, room, at
            ids = np.concatenate(held).astype(np.uint32)
            out = block_bytes(file, at, pieces, ids, table)
            at, pieces, held, room = at + len(ids), [], [], BLOCK_TOKENS
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["block"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                left, begins = np.frombuffer(ids.as_buffer(), kind), True
                while begins or len(left):
                    part, left = left[:room], left[room:]
                    pieces.append((doc_id, begins, len(part)))
                    held.append(part)
                    room, begins = room - len(part), False
                    if room == 0 or len(pieces) == BLOCK_TOKENS:
                        yield close()
        if pieces:
            yield close()

    keys = ["doc_id", "h", "place"]
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    blocks = dealt.select("doc_id", "ids").mapInArrow(put, "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.text(f"{path}/data")
    _write_index(spark, path)


def read_table(spark: SparkSession, path: str) -> Table:
    """The frequency table of a folder; its length is the vocabulary's."""
    rows = spark.read.parquet(f"{path}/table").toPandas().sort_values("id")
    return Table(rows["freq"].to_numpy(np.int64))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/data").select("path", "content")


def _write_index(spark: SparkSession, path: str) -> None:
    """One row a block, from the heads alone: file, place, and the numbers of its first token, of its tokens and of the documents that begin in it."""

    def heads(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = memoryview(content.as_buffer())
                at = 0
                while at < len(whole):
                    head = head_at(whole, at)
                    begins = np.frombuffer(whole, np.uint8, head[9], at + HEAD_SIZE + 9 * head[9])
                    out.append((head[5], name, at, head[4], head[10], head[6], int(begins.sum())))
                    at += head[4] + 1
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] or [pa.array([], pa.int64())] * 7, names)

    names = ["file", "path", "at", "size", "first_in_file", "n_tokens", "n_docs"]
    kinds = "file bigint, path string, at bigint, size bigint, first_in_file bigint, n_tokens bigint, n_docs bigint"
    found = stage(_files(spark, path).mapInArrow(heads, kinds), "heads")
    before, bases = 0, []  # one number a file
    for file, n in sorted((r[0], r[1]) for r in found.groupBy("file").agg(F.sum("n_tokens")).collect()):
        bases.append((file, before))
        before += n
    base = spark.createDataFrame(bases, "file bigint, base bigint")
    placed = found.join(base, "file").select("file", "path", "at", "size", (F.col("base") + F.col("first_in_file")).alias("first"), "first_in_file", "n_tokens", "n_docs")
    placed.coalesce(max(1, len(bases) // 1000)).write.parquet(f"{path}/index")


def documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """All documents of a folder: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids (binary).

    Every block is checked against both checksums. Files are decoded side by side, a block at a time; without ``with_ids`` no
    document is held whole.
    """
    table = read_table(spark, path)
    kinds = "file bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")

    def read(batches):
        for batch in batches:
            for content in batch.column(1):
                out, file = [], 0
                for _, data in blocks_in(memoryview(content.as_buffer())):
                    block = Block(data, table)
                    file, ids = block.file, block.ids().astype("<u4").tobytes()
                    ends = np.cumsum(block.sizes, dtype=np.int64)
                    for doc_id, known, begins, n, end in zip(block.doc_id.tolist(), block.known.tolist(), block.begins.tolist(), block.sizes.tolist(), ends.tolist()):
                        part = ids[4 * (end - n) : 4 * end]
                        if begins:
                            if out and len(out) >= 10_000:
                                last = out.pop()
                                yield rows_of(file, out)
                                out = [last]
                            out.append([doc_id if known else None, block.first + end - n, n, zlib.crc32(part), [part] if with_ids else []])
                        else:
                            out[-1][2] += n
                            out[-1][3] = zlib.crc32(part, out[-1][3])
                            if with_ids:
                                out[-1][4].append(part)
                if out:
                    yield rows_of(file, out)

    def rows_of(file, rows):
        columns = [pa.array([file] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))]
        if with_ids:
            columns.append(pa.array([b"".join(r[4]) for r in rows], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, [k.split()[0] for k in kinds.split(", ")])

    base = spark.read.parquet(f"{path}/index").groupBy("file").agg(F.min("first").alias("base"))
    found = _files(spark, path).mapInArrow(read, kinds).join(base, "file")
    return found.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def tokens_between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The ids first..last-1 of a folder as (first, ids binary), a row a block: only files that hold some are opened, and blocks
    are read from the nearest checkpoint."""
    table = read_table(spark, path)
    wanted = spark.read.parquet(f"{path}/index").where((F.col("first") < last) & (F.col("first") + F.col("n_tokens") > first))
    places = wanted.groupBy("path").agg(F.collect_list(F.struct("at", "size", "first")).alias("blocks"))

    def read(batches):
        for batch in batches:
            for content, blocks in zip(batch.column(0), batch.column(1).to_pylist()):
                whole = memoryview(content.as_buffer())
                for b in blocks:
                    block = Block(bytes(whole[b["at"] : b["at"] + b["size"]]), table)
                    a = max(first - b["first"], 0)
                    ids = block.ids(a, last - b["first"]).astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([b["first"] + a]), pa.array([ids], pa.binary())], ["first", "ids"])

    paths = [r[0] for r in places.select("path").collect()]  # the files of the range asked for
    if not paths:
        return spark.createDataFrame([], "first bigint, ids binary")
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.join(places, "path").select("content", "blocks").mapInArrow(read, "first bigint, ids binary")
