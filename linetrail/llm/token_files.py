"""Token ids in directly addressable codes.

An id is split into chunks of ``CHUNK_BITS`` bits.  Level 0 holds the lowest
chunk of every id; a bitmap beside it marks the ids that continue, and those
alone have a chunk in level 1, and so on.  A rank directory (marks before
every block of ``RANK_BLOCK`` entries) finds an id's place on the next level,
so any id is read with a few look-ups and no block is decoded.

The file format is a folder ``part=P`` for each range of documents, with
Parquet files written by Spark so that
retried tasks and lost executors leave no partial files.  One row is one
segment: a run of documents in ascending ``doc_id`` order with its levels, which are
stored as they are, without compression, so a look-up unpacks nothing.
``part`` is the place of a folder in that order, ``seg`` that of a segment in
it.  Look-ups read the segments' document ids first, then the levels in the folders that hold a wanted one (dynamic partition
pruning), and visit a segment once for all its wanted places.

Defined results: a null text has the end id alone; null ``doc_id`` come
first; rows that share a ``doc_id`` stay separate documents in the order
read; an empty table gives no segment; columns other than the two named are
not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import tidy, written
from .tokens import WordEncoder

CHUNK_BITS = 8
RANK_BLOCK = 512
SEGMENT_TOKENS = 1 << 17

SEGMENT_SCHEMA = ("part int, seg int, n_tokens long, doc_ids array<long>, doc_starts array<long>, "
                  "levels array<struct<n: long, chunks: binary, more: binary, ranks: binary>>")
_ARROW = pa.schema([
    ("part", pa.int32()), ("seg", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_starts", pa.list_(pa.int64())),
    ("levels", pa.list_(pa.struct([("n", pa.int64()), ("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])))])


def pack(ids: np.ndarray) -> list[dict]:
    """Levels of one run of non-negative ids."""
    rest, levels = ids.astype(np.uint64), []
    while len(rest) or not levels:
        more = rest >> np.uint64(CHUNK_BITS) > 0
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK)))]) if len(more) else [0]
        levels.append({"n": len(rest), "chunks": (rest & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes(),
                       "more": bits.tobytes(), "ranks": np.asarray(ranks, dtype="<u4").tobytes()})
        rest = rest[more] >> np.uint64(CHUNK_BITS)
        if not len(rest):
            break
    return levels


class Codes:
    """Reads ids from the levels of one segment."""

    def __init__(self, levels: list[dict]):
        self.levels = [(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8),
                        np.frombuffer(x["ranks"], "<u4")) for x in levels]
        self.n = levels[0]["n"] if levels else 0

    def _rank(self, level: int, i: int) -> int:
        """Marks before entry ``i`` of a level: the directory, then less than one block of bits."""
        _, more, ranks = self.levels[level]
        block = i // RANK_BLOCK
        bits = np.unpackbits(more[block * RANK_BLOCK // 8:(i + 7) // 8], bitorder="little")
        return int(ranks[block]) + int(bits[:i - block * RANK_BLOCK].sum())

    def get(self, i: int) -> int:
        """Id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = shift = 0
        for level, (chunks, more, _) in enumerate(self.levels):
            out |= int(chunks[i]) << shift
            if not more[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(level, i), shift + CHUNK_BITS
        return out

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids of places ``start`` to ``stop`` (not included)."""
        out = np.zeros(max(0, stop - start), dtype=np.uint32)
        at, shift = None, 0
        for level, (chunks, more, _) in enumerate(self.levels):
            if stop <= start:
                break
            part = chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            if at is None:
                out[:] = part
            else:
                out[at] |= part
            bits = np.unpackbits(more[start >> 3:(stop + 7) >> 3], bitorder="little")[start & 7:][:stop - start]
            go = np.flatnonzero(bits)
            at, shift = go if at is None else at[go], shift + CHUNK_BITS
            start = self._rank(level, start) if len(go) else 0
            stop = start + len(go)
        return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, write the segments to ``path``.

    The texts are range-partitioned by id (rows that share an id are told
    apart by their place in the input, so no key fills one task) and encoded
    after that, so only texts cross the network.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    width = WordEncoder.load(tokenizer).dtype

    def segment(seg, ids, parts):
        lengths = np.array([len(p) for p in parts]) // width.itemsize
        tokens = np.frombuffer(b"".join(parts), width)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return pa.RecordBatch.from_pylist([{
            "part": TaskContext.get().partitionId(), "seg": seg, "n_tokens": len(tokens), "doc_ids": ids,
            "doc_starts": starts, "levels": pack(tokens)}], schema=_ARROW)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = WordEncoder.load(tokenizer), np.array([end_id], dtype=width).tobytes()
        seg, n, ids, parts = 0, 0, [], []
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), enc.stream(texts)):
                ids.append(doc)
                parts.append(tokens + end)
                n += len(parts[-1]) // width.itemsize
                if n >= SEGMENT_TOKENS:
                    yield segment(seg, ids, parts)
                    seg, n, ids, parts = seg + 1, 0, [], []
        if ids:
            yield segment(seg, ids, parts)

    rows.mapInArrow(tidy(encode), SEGMENT_SCHEMA).write.mode("overwrite").option("compression", "uncompressed").partitionBy("part").parquet(path)


def _bases(segments: DataFrame) -> DataFrame:
    """``(part, seg, base)``: tokens before each segment in the whole order.  One number a
    file is summed over all files, the rest within each file."""
    by_file = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")) \
        .select("part", F.coalesce(F.sum("n").over(by_file), F.lit(0)).alias("file_base"))
    within = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return segments.select("part", "seg", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("b")) \
        .join(files, "part").select("part", "seg", (F.col("b") + F.col("file_base")).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files alone.

    ``start`` counts the ids of all documents before it; the checksum is over
    the ids as little-endian unsigned 32-bit integers.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):  # one segment at a time as Python values
                row = batch.slice(r, 1).to_pylist()[0]
                ids = Codes(row["levels"]).slice(0, row["n_tokens"]).astype("<u4")
                cuts = [*row["doc_starts"], row["n_tokens"]]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * len(row["doc_ids"]), pa.int32()),
                    "seg": pa.array([row["seg"]] * len(row["doc_ids"]), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "first": pa.array(row["doc_starts"], pa.int64()),
                    "n_tokens": pa.array(np.diff(cuts).astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])], pa.int64())})

    docs = segments.mapInArrow(tidy(decode), "part int, seg int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return docs.join(_bases(segments.select("part", "seg", "n_tokens")), ["part", "seg"]) \
        .select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def wanted_segments(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Segments that hold a document of ``wanted(doc_id, i)``, with ``asks``: its place there and the tokens asked for.  The
    levels of other folders are not opened."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    asked = wanted.where("doc_id is not null and i >= 0").select("doc_id", F.col("i").cast("long").alias("i"))
    asks = segments.select("part", "seg", F.posexplode("doc_ids").alias("k", "doc_id")).join(asked, "doc_id") \
        .groupBy("part", "seg", "doc_id", "k").agg(F.collect_set("i").alias("places")) \
        .groupBy("part", "seg").agg(F.collect_list(F.struct("doc_id", "k", "places")).alias("asks"))
    asks = written(asks, "token-asks")
    # One row for each folder at most, so its broadcast is bounded by the number of files.
    folders = asks.where("size(asks) > 0").select("part").distinct()
    return segments.join(F.broadcast(folders), "part", "left_semi").join(asks, ["part", "seg"])


def read_tokens(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Random access: ``wanted(doc_id, i)`` -> ``(doc_id, i, token_id)``, each place once for each document of that id.  Places outside
    the document, null ids and null places give no row."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                codes, starts = Codes(row["levels"]), [*row["doc_starts"], row["n_tokens"]]
                out = [(ask["doc_id"], i, codes.get(starts[ask["k"]] + i)) for ask in row["asks"]
                       for i in sorted(ask["places"]) if i < starts[ask["k"] + 1] - starts[ask["k"]]]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], ["doc_id", "i", "token_id"])

    return wanted_segments(spark, path, wanted).select("levels", "doc_starts", "n_tokens", "asks") \
        .mapInArrow(tidy(look), "doc_id long, i long, token_id long")
