"""Training-order materialisation of token ids as fixed-stride binary shards.

1. Documents become unsigned 16-bit ids, each followed by an end id; the tasks
   fill sequences of ``seq_len`` ids with them and write these, compressed, to
   a table. Only the last sequence of a task is padded.
2. Sequence counts per task give every sequence an index from 0 to N - 1. A
   keyed Feistel network on the smallest even power of two over N, walked until
   it falls below N, turns the index into its global slot: a permutation that
   needs no sort and no table.
3. Rows are dealt by range of slots and sorted inside a task, which streams them
   into shard files: shard = slot // rows, byte = slot % rows * stride. A shard
   is written under a name of the attempt and then renamed, so a lost executor
   or a second attempt leaves whole shards with the same bytes.

Reading from any slot on is one seek (``read_shard``). Text is read whole; null
and empty texts give the end id alone. Null ids and repeated rows are kept. An
empty table writes no shard and gives an empty manifest. Only ``doc_id`` and
``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package, staged
from .registry import read_table, register
from .tokens import encode_texts, tokenizer, vocabulary_path

SEQ_LEN = 2048
ROWS = 4096                  # sequences in a shard: 16 MiB
END_ID = 2
KEY = 0x5EED0A11
ROUNDS = 6
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def feistel(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of sequence numbers below ``n``: a permutation of 0 .. n - 1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right, key, r) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _mix(x: np.ndarray, key: int, r: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def sequences(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Fixed-length sequences in reading order: ``part, seq, n_ids, first_doc, payload``."""
    ship_package(docs.sparkSession)

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=3)
        size = 2 * seq_len
        end = np.asarray([end_id], dtype="<u2").tobytes()
        rest, first, seq = b"", None, 0

        def rows(items: list) -> pa.RecordBatch:
            p, s, n, f, d = zip(*items)
            return pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int32()), pa.array(f, pa.int64()), pa.array(d, pa.binary())],
                names=["part", "seq", "n_ids", "first_doc", "payload"])
        for b in batches:
            ids, texts, at = b.column(0).to_pylist(), b.column(1), 0
            while at < len(ids):
                made = []
                for doc, data in zip(ids[at:at + 256], encode_texts(texts.slice(at, 256).to_pylist(), path)):
                    if not rest:
                        first = doc
                    rest += np.frombuffer(data, "<u4").astype("<u2").tobytes() + end
                    cut = 0
                    while len(rest) - cut >= size:
                        made.append((part, seq, seq_len, first, pack.compress(rest[cut:cut + size])))
                        cut, seq, first = cut + size, seq + 1, doc
                    rest = rest[cut:] if cut else rest
                at += 256
                if made:
                    yield rows(made)
        if rest:
            full = rest + end * ((size - len(rest)) // 2)
            yield rows([(part, seq, len(rest) // 2, first, pack.compress(full))])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        fill, "part int, seq long, n_ids int, first_doc long, payload binary")


def write_shards(docs: DataFrame, path: str, uri: str, key: int = KEY, seq_len: int = SEQ_LEN, rows: int = ROWS,
                 end_id: int = END_ID) -> DataFrame:
    """Writes the shards under ``uri`` and returns the manifest, one row per
    sequence: ``slot, shard, byte_offset, sequence_id, n_ids, first_doc, ids_crc32``."""
    spark = docs.sparkSession
    if tokenizer(path).get_vocab_size() > 1 << 16:
        raise ValueError("ids are written as 16 bits; the vocabulary has more than 65,536")
    table = staged(sequences(docs, path, seq_len, end_id), "token-sequences")
    # one row per task that read documents
    per = staged(table.groupBy("part").count(), "token-parts")
    n = per.agg(F.sum("count").alias("n")).first()["n"] or 0
    before = per.select("part", F.coalesce(F.sum("count").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    shards = max(1, -(-n // rows))
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 8))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            index = b.column(0).to_numpy(zero_copy_only=False)
            slot = feistel(index, n, key)
            task = (slot // rows) * tasks // shards
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(task.astype(np.int32)), *b.columns],
                names=["slot", "task", "sequence_id", "n_ids", "first_doc", "payload"])

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext
        target, root = fs.FileSystem.from_uri(uri)
        unpack = zstandard.ZstdDecompressor()
        tag = TaskContext.get().taskAttemptId()
        shard, out = -1, None

        def finish() -> None:
            if out is not None:
                out.close()
                target.move(f"{root}/.{shard:08d}-{tag}.part", f"{root}/{shard:08d}.bin")
        for b in batches:
            slots = b.column(0).to_pylist()
            crcs = []
            for s, data in zip(slots, b.column(5)):
                if s // rows != shard:
                    finish()
                    shard = s // rows
                    out = target.open_output_stream(f"{root}/.{shard:08d}-{tag}.part")
                raw = unpack.decompress(data.as_py())
                crcs.append(zlib.crc32(raw))
                out.write(raw)
            at = np.asarray(slots, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(at // rows), pa.array(at % rows * (2 * seq_len)), b.column(2), b.column(3), b.column(4), pa.array(crcs, pa.int64())],
                names=["slot", "shard", "byte_offset", "sequence_id", "n_ids", "first_doc", "ids_crc32"])
        finish()

    _make_dir(spark, uri)
    indexed = (table.join(before, "part")
               .select((F.col("before") + F.col("seq")).alias("sequence_id"), "n_ids", "first_doc", "payload"))
    dealt = (indexed.mapInArrow(place, "slot long, task int, sequence_id long, n_ids int, first_doc long, payload binary")
             .repartitionById(tasks, "task").sortWithinPartitions("slot"))
    return staged(dealt.mapInArrow(write, "slot long, shard long, byte_offset long, sequence_id long, n_ids int, first_doc long, ids_crc32 long"), "token-manifest")


def _make_dir(spark, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def read_shard(uri: str, slot: int, count: int, seq_len: int = SEQ_LEN, rows: int = ROWS) -> np.ndarray:
    """Up to ``count`` sequences from ``slot`` on, of its shard: one seek, one read."""
    from pyarrow import fs
    source, root = fs.FileSystem.from_uri(uri)
    with source.open_input_file(f"{root}/{slot // rows:08d}.bin") as f:
        f.seek(slot % rows * 2 * seq_len)
        data = f.read(count * 2 * seq_len)
    return np.frombuffer(data, "<u2").reshape(-1, seq_len)


@register("op1_token_shards")
def op1_token_shards(spark, sf_dir):
    return write_shards(read_table(spark, sf_dir, "documents"), vocabulary_path(), scratch_uri(spark))


def scratch_uri(spark) -> str:
    """A new folder for shards under the shared folder, as a URI."""
    path = scratch_path(spark, "token-shards")
    return path if ":/" in path else f"file://{path}"
