"""Token ids as flat binary files with 64-bit document offsets."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm.arrays import blocks
from sessionloom.llm.storage import batch_settings, fresh_path, parts_for, store, target
from sessionloom.llm.tokens import encoder, with_end

PART_BYTES = 24 << 20
KEEP = 1_200_000  # distinct parts held by a worker, which does little else here
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id in the files
SHARDS = "shard int, file string, width int, docs long, ids long"


class Shard:
    """A part's files: NAME.bin (ids), NAME.off (offsets, one more than documents), NAME.doc (doc_ids).

    Local files are memory-mapped; those of other stores are read by ranges.
    """

    def __init__(self, file: str, width: int, docs: int, ids: int) -> None:
        fs, path = target(file)
        self.local = isinstance(fs, pafs.LocalFileSystem)
        self.fs, self.path, self.kind = fs, path, np.dtype(f"<u{width}")
        self.offsets = self.part("off", np.dtype("<i8"), 0, docs + 1)
        self.docs = self.part("doc", np.dtype("<i8"), 0, docs)
        self.count = ids

    def part(self, end: str, kind: np.dtype, low: int, high: int) -> np.ndarray:
        if high <= low:
            return np.zeros(0, kind)
        if self.local:
            return np.memmap(
                f"{self.path}.{end}", kind, "r", offset=low * kind.itemsize, shape=(high - low,)
            )
        with self.fs.open_input_file(f"{self.path}.{end}") as file:
            return np.frombuffer(file.read_at((high - low) * kind.itemsize, low * kind.itemsize), kind)

    def ids(self, low: int, high: int) -> np.ndarray:
        return self.part("bin", self.kind, low, high)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, text: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending doc_id order; one row per part.

    Rows are range-partitioned by doc_id (null first) and each task writes the files of its part
    under a name of its own and then renames them, so a repeated task replaces whole files. Ids are
    16-bit where the vocabulary allows, else 32-bit. Rows of one doc_id stand in the order of their
    texts; a null text is an empty one. The result has shard, file, width, docs, ids, and ``start``:
    the ids before the part, a prefix sum over the parts.
    """
    spark = docs.sparkSession
    batch_settings(spark)
    folder = folder or fresh_path(spark, "tokens")
    size = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = parts_for(size, PART_BYTES)
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(tokenizer, keep=KEEP), TaskContext.get().partitionId()
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        kind = np.dtype(f"<u{width}")
        fs, place = target(folder)
        fs.create_dir(place, recursive=True)
        name, own = f"part-{shard:06d}", f"{place}/.{uuid.uuid4().hex}"
        out, total, count = None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                out = {end: fs.open_output_stream(f"{own}.{end}") for end in ("bin", "off", "doc")}
                out["off"].write(np.zeros(1, "<i8").tobytes())
            for low, high, data, edges in blocks(batch.column("text")):
                ids, first = with_end(*coder.encode(data, edges), end_id)
                out["bin"].write(ids.astype(kind).tobytes())
                out["off"].write((first[1:] + total).astype("<i8").tobytes())
                keys = batch.column("doc_id").slice(low, high - low).fill_null(int(NO_ID))
                out["doc"].write(keys.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                total, count = total + len(ids), count + high - low
        if out is None:
            return
        for end, file in out.items():
            file.close()
            fs.move(f"{own}.{end}", f"{place}/{name}.{end}")
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "file": f"{folder}/{name}", "width": width, "docs": count, "ids": total}],
            pa.schema([("shard", pa.int32()), ("file", pa.string()), ("width", pa.int32()),
                       ("docs", pa.int64()), ("ids", pa.int64())]),
        )

    shards = store(ordered.mapInArrow(write, SHARDS), "shards")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from the files of ``shards``: doc_id, start, n_tokens, ids_crc32, and the
    ids themselves where asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["file"], row["width"], row["docs"], row["ids"])
                offsets = shard.offsets
                for low in range(0, row["docs"], 1000):
                    high = min(low + 1000, row["docs"])
                    edges = np.asarray(offsets[low : high + 1])
                    ids = np.asarray(shard.ids(edges[0], edges[-1])).astype("<u4")
                    cuts = edges - edges[0]
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                    keys = np.asarray(shard.docs[low:high])
                    columns = {
                        "doc_id": pa.array(keys, mask=keys == NO_ID),
                        "start": pa.array(edges[:-1] + row["start"]),
                        "n_tokens": pa.array(np.diff(edges)),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.ListArray.from_arrays(
                            pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int64))
                        )
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    count = max(1, shards.count())
    spread = shards.repartition(count, "shard") if count > 1 else shards
    return spread.mapInArrow(read, schema)
