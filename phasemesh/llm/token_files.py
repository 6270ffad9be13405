"""Token-id files: canonical length-limited Huffman coding of ids, decoded by table in independent blocks.

A file set is a folder of shards in ascending doc_id order.  Each shard holds, in this order: the bit stream (32-bit
big-endian words, blocks of ``BLOCK`` ids), the bit offset of every block (the checkpoints), the documents' ids, null
flags and lengths, the code length of every token id (deflated), and a footer with the sizes.  Codes are canonical, so
lengths alone restore them; no code is longer than ``limit`` bits, so one table lookup decodes an id; blocks start at
checkpoints, so many are decoded at a time and any one can be read alone.

Null texts count as empty; null doc_ids sort first and come back as null; documents with equal doc_ids keep one row
each; an empty table gives no shards and an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import store, tokens

BLOCK = 1024
#: Blocks that are decoded at a time (so many times BLOCK ids are in memory), and that are coded at a time (so few that
#: the work stays in the processor's cache).
GROUP, CODED = 2048, 32
#: Tasks whose counts of ids one task adds up.
TASKS_SUMMED = 64
MAGIC = b"PHTK1\n"
FOOTER = struct.Struct("<QQQQQ6s")


# --- the code ---------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur.

    ``limit`` defaults to one bit more than a fixed-length code needs, 16 at least.  A single id gets one bit.
    """
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    limit = max(limit or 16, int(n - 1).bit_length() + (limit is None))
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order]
    leaf_levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        leaf_levels.append(at < n)
        both = both[at]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(leaf_levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), counted upwards."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        size = lengths[order].astype(np.int64)
        top = int(size[-1])
        steps = np.concatenate([[0], np.cumsum(1 << (top - size))[:-1]])
        codes[order] = steps >> (top - size)
    return codes


class Coder:
    """Codes blocks of ids to bits and back."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.width = max(1, int(self.lengths.max(initial=0)))
        self.packed = (canonical_codes(self.lengths).astype(np.int64) << 5) | self.lengths  # code and length of every id
        self._table: np.ndarray | None = None

    @property
    def table(self) -> np.ndarray:
        """For every ``width`` bits: id * 32 + code length."""
        if self._table is None:
            used = np.flatnonzero(self.lengths)
            order = used[np.lexsort((used, self.lengths[used]))]
            size = self.lengths[order].astype(np.int64)
            made = np.repeat((order.astype(np.uint32) << 5) | size.astype(np.uint32), 1 << (self.width - size))
            self._table = np.zeros(1 << self.width, np.uint32)
            self._table[: len(made)] = made
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes, a whole number of 32-bit words, and the bit offset of each block."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        both = self.packed[ids]
        size = both & 31
        ends = np.cumsum(size)
        at = ends - size
        word = at >> 5
        value = ((both >> 5) << (64 - size - (at & 31))).view(np.uint64)
        out = np.zeros(int(ends[-1] + 31 >> 5) + 1, np.uint64)
        first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        into = word[first]  # each word once; codes of a word do not overlap, so adding sets their bits
        out[into] += np.add.reduceat(value >> np.uint64(32), first)
        out[into + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out[: int(ends[-1] + 31 >> 5)].astype(">u4").tobytes(), at[::BLOCK].copy()

    def decode(self, data: bytes, starts: np.ndarray, total: int) -> np.ndarray:
        """``total`` ids of the blocks that start at these bits; all blocks but the last are full."""
        words = np.concatenate([np.frombuffer(data, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
        pairs = (words[:-1] << np.uint64(32)) | words[1:]  # any 33 bits and more that begin within a word
        table, keep, down = self.table, np.int64((1 << self.width) - 1), np.int64(64 - self.width)
        at = np.asarray(starts, np.int64).copy()
        last = total - BLOCK * (len(at) - 1)
        out = np.zeros((min(BLOCK, total), len(at)), np.uint32)
        for i in range(len(out)):
            if i == last:
                at = at[:-1]
            window = (pairs[at >> 5] >> (down - (at & 31)).astype(np.uint64)).astype(np.int64) & keep
            found = table[window]
            out[i, : len(at)] = found >> np.uint32(5)
            at += (found & np.uint32(31)).astype(np.int64)
        return out.T.reshape(-1)[:total]


# --- shards -----------------------------------------------------------------------------------------------------------


def write_shard(fs, path: str, coder: Coder, docs: tuple[Sequence, Sequence, Sequence], ids: Iterator[np.ndarray]) -> None:
    """``ids``: the ids in order, in pieces of any size; ``docs``: doc_ids, null flags, lengths, read once all ids are."""
    with fs.open_output_stream(path) as f:
        f.write(MAGIC)
        bits, starts, rest = 0, [], np.zeros(0, np.uint32)

        def put(some: np.ndarray) -> None:
            nonlocal bits
            data, at = coder.encode(some)
            f.write(data)
            starts.append(at + bits)
            bits += 8 * len(data)

        for more in ids:
            rest = np.concatenate([rest, more]) if len(rest) else more
            whole = len(rest) // (CODED * BLOCK) * CODED * BLOCK
            for at in range(0, whole, CODED * BLOCK):
                put(rest[at : at + CODED * BLOCK])
            rest = rest[whole:]
        put(rest)
        starts_b = np.concatenate(starts).astype("<i8").tobytes()
        docs_b = b"".join(np.asarray(d, t).tobytes() for d, t in zip(docs, ("<i8", "u1", "<u8")))
        book = zlib.compress(coder.lengths.tobytes(), 6)
        f.write(starts_b + docs_b + book)
        f.write(FOOTER.pack(bits // 8, len(starts_b) // 8, len(docs[0]), len(book), int(sum(docs[2])), MAGIC))


class Shard:
    """Range-reads one shard."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        end = self.file.size()
        tail = self.file.read_at(FOOTER.size, end - FOOTER.size)
        size, blocks, docs, book, self.total, magic = FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard of token ids")
        at = len(MAGIC) + size
        self.bytes = size
        self.starts = np.frombuffer(self.file.read_at(8 * blocks, at), "<i8")
        rest = self.file.read_at(17 * docs + book, at + 8 * blocks)
        self.doc_ids = np.frombuffer(rest, "<i8", docs)
        self.nulls = np.frombuffer(rest, "u1", docs, 8 * docs).astype(bool)
        self.lengths = np.frombuffer(rest, "<u8", docs, 9 * docs).astype(np.int64)
        self.coder = Coder(np.frombuffer(zlib.decompress(rest[17 * docs :]), np.uint8))

    def blocks(self, first: int, n: int) -> np.ndarray:
        """The ids of ``n`` blocks from block ``first`` on; only their bytes are read."""
        starts = self.starts[first : first + n]
        if not len(starts):
            return np.zeros(0, np.uint32)
        base = int(starts[0]) >> 5 << 2
        nxt = first + len(starts)
        end = (int(self.starts[nxt]) + 31 >> 5 << 2) if nxt < len(self.starts) else self.bytes
        total = min(self.total - first * BLOCK, len(starts) * BLOCK)
        return self.coder.decode(self.file.read_at(end - base, len(MAGIC) + base), starts - 8 * base, total)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and token ids, in order; a group of blocks is in memory at a time."""
        rest, at = np.zeros(0, np.uint32), 0
        for doc, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.lengths.tolist()):
            if len(rest) < n:
                parts, have = [rest], len(rest)
                while have < n:
                    parts.append(self.blocks(at, GROUP))
                    at += GROUP
                    have += len(parts[-1])
                rest = np.concatenate(parts)
            yield (None if null else doc), rest[:n]
            rest = rest[n:]


# --- operators --------------------------------------------------------------------------------------------------------


class _Encode:
    """Documents as ids of two or four bytes, and at the end of each task one row with the counts of its ids."""

    def __init__(self, tokenizer: str, end_id: int | None):
        self.tokenizer, self.end_id = tokenizer, end_id

    def __call__(self, batches):
        import pyarrow as pa

        encode = tokens.encoder(self.tokenizer)
        end = b"" if self.end_id is None else np.array([self.end_id], "<u4").tobytes()
        small = max(encode.tokenizer.get_vocab_size(), self.end_id or 0) < 1 << 16
        counts = np.zeros(0, np.int64)
        none = pa.nulls(256, pa.list_(pa.int64()))
        names = ["doc_id", "ids", "used", "counts"]
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                piece = batch.slice(part, 256)
                coded = [encode(t) + end for t in piece.column(1).to_pylist()]
                ids = np.frombuffer(b"".join(coded), "<u4")
                if len(ids):
                    more = np.bincount(ids)
                    if len(more) > len(counts):
                        counts = np.pad(counts, (0, len(more) - len(counts)))
                    counts[: len(more)] += more
                kept = [np.frombuffer(c, "<u4").astype("<u2").tobytes() for c in coded] if small else coded
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(kept, pa.binary()), none[: len(kept)], none[: len(kept)]], names=names)
        used = np.flatnonzero(counts)
        if len(used):
            lists = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (used, counts[used])]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([b"\2" if small else b"\4"], pa.binary()), *lists], names=names)


def _sum_counts(batches):
    """Adds up the counts of all tasks that one task is given, and tells how wide the ids are."""
    import pyarrow as pa

    total, width = np.zeros(0, np.int64), 0
    for batch in batches:
        ids, counts = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
        if len(ids):
            width = batch.column(2)[0].as_py()[0]
            total = np.pad(total, (0, max(0, int(ids.max()) + 1 - len(total))))
            np.add.at(total, ids, counts)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64()), "width": pa.array(np.full(len(used), width, np.int32))})


#: Packed bytes of ids of a shard, about, where there are more of them than shuffle partitions, and documents that are
#: given at a time.
SHARD_BYTES, GIVEN = 128 << 20, 16_384


class _Code:
    """Codes one sorted partition into a shard as its documents come."""

    def __init__(self, base: str, lengths, width: int):
        self.base, self.lengths, self.width = base, lengths, width

    def __call__(self, batches):
        import pyarrow as pa

        rows = (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256))
        head = next(rows, None)
        if head is None:
            return
        docs = (array("q"), bytearray(), array("q"))

        def pieces() -> Iterator[np.ndarray]:
            for some in itertools.chain([head], rows):
                coded = some.column(2).to_pylist()
                known = some.column(0)
                docs[0].extend(known.fill_null(0).to_pylist())
                docs[1].extend(map(int, known.is_null().to_pylist()))
                docs[2].extend([len(c) // self.width for c in coded])
                yield np.frombuffer(b"".join(coded), f"<u{self.width}").astype(np.uint32)

        fs, folder = store.filesystem(self.base)
        fs.create_dir(folder, recursive=True)
        name = f"shard-{uuid.uuid4().hex}.ids"
        write_shard(fs, f"{folder}/{name}", Coder(np.frombuffer(zlib.decompress(self.lengths.value), np.uint8)), docs, pieces())
        yield pa.RecordBatch.from_pydict(
            {
                "shard": [f"{self.base}/{name}"],
                "n_docs": [len(docs[0])],
                "n_tokens": [sum(docs[2])],
                "first_doc": head.column(0).slice(0, 1),
                "first_row": head.column(1).slice(0, 1),
            }
        )


def write(docs: DataFrame, base: str, tokenizer: str, end_id: int | None = 0, shards: int | None = None, limit: int | None = None) -> DataFrame:
    """Write ``docs(doc_id, text)`` as token-id files below ``base``; returns the manifest of shards.

    The texts are encoded once, where they are, and the ids, mostly two bytes each, are kept as a table together with
    their counts; the counts, one row for each id of the vocabulary, make the code.  Then the ids are range-partitioned
    and sorted by doc_id (rows of one doc_id, or of none, may fill many partitions) and each partition is coded into a
    shard as it comes.  Files of failed attempts are in no manifest and so never read.
    """
    spark = docs.sparkSession
    store.bounded_batches(spark)
    rows = store.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    with Scratch(spark, "token-files") as tmp:
        made = rows.mapInArrow(_Encode(tokenizer, end_id), "doc_id long, ids binary, used array<long>, counts array<long>")
        made = tmp.save(made.withColumn("row", F.monotonically_increasing_id()), "ids", compression="zstd")
        told = made.where("counts is not null").select("used", "counts", "ids")
        sums = told.repartition(-(-max(1, told.count()) // TASKS_SUMMED)).mapInArrow(_sum_counts, "id long, n long, width int")
        found = sums.groupBy("id").agg(F.sum("n").alias("n"), F.max("width").alias("width")).toPandas()  # at most one row for each id of the vocabulary
        counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
        counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
        book = spark.sparkContext.broadcast(zlib.compress(code_lengths(counts, limit).tobytes(), 6))
        ids = made.where("counts is null").select("doc_id", "row", "ids")
        held = int(str(made._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if not shards and -(-held // SHARD_BYTES) > int(spark.conf.get("spark.sql.shuffle.partitions")):
            shards = -(-held // SHARD_BYTES)
        ids = ids.repartitionByRange(shards, "doc_id", "row") if shards else ids.repartitionByRange("doc_id", "row")
        coded = ids.sortWithinPartitions("doc_id", "row").mapInArrow(
            _Code(base, book, int(found["width"].max()) if len(found) else 4), "shard string, n_docs long, n_tokens long, first_doc long, first_row long"
        )
        return tmp.result(coded)


class _Read:
    def __call__(self, batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(*store.filesystem(row["shard"]))
                out, start = [], row["start"]

                def rows(out):
                    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

                for doc, ids in shard.documents():
                    out.append((doc, start, len(ids), store.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == GIVEN:
                        yield rows(out)
                        out = []
                yield rows(out)


class _ReadIds:
    def __call__(self, batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                shard, out, held = Shard(*store.filesystem(row["shard"])), [], 0

                def rows(out):
                    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])

                for doc, ids in shard.documents():
                    out.append((doc, ids.astype(np.int64)))
                    held += len(ids)
                    if held > GROUP * BLOCK:
                        yield rows(out)
                        out, held = [], 0
                yield rows(out)


def _placed(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per shard with the number of ids before it; as many rows as shards."""
    rows = sorted(manifest.select("shard", "n_tokens", "first_doc", "first_row").collect(), key=lambda r: (r["first_doc"] is not None, r["first_doc"] or 0, r["first_row"]))
    starts = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])]).astype(int).tolist()
    placed = spark.createDataFrame([(r["shard"], s) for r, s in zip(rows, starts)], "shard string, start long")
    return placed.repartition(max(1, len(rows)))


def read_digests(manifest: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens and ids_crc32, all from the files."""
    return _placed(manifest.sparkSession, manifest).mapInArrow(_Read(), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document: doc_id and its token ids, from the files."""
    return _placed(manifest.sparkSession, manifest).mapInArrow(_ReadIds(), "doc_id long, ids array<long>")
