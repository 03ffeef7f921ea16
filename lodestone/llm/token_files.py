"""Token files: frequency-ranked ids in a byte-aligned variable-length code.

Frequent ids get small ranks, and a rank takes 1 to 4 bytes.  Two control bits
per rank (its bytes less one) stand apart from the data bytes, so a numpy table
over control bytes gives all lengths of a block, and four gathers its ranks.

The container is Parquet, so any store that Spark reaches can hold it: `blocks`
has one row per block of whole documents, in ascending doc_id order, whose `part`
and `before` (tokens ahead of the block in its part) give global positions;
`ranks` has the id of each rank, so the files can be read without anything else.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, reachable, shared_dir, written
from .tokens import byte_lengths, id_type, tokenized, unpacked, vocabulary_path

BLOCK_TOKENS = 1 << 18
#: Lengths of the four values of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1).astype(np.uint8)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks below 2^32."""
    ranks = ranks.astype(np.uint32)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = extra
    control = (codes.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))).sum(axis=1, dtype=np.uint8)
    wide = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = wide[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    own = np.frombuffer(data, np.uint8)
    ranks = own[starts].astype(np.uint32)
    for k in range(1, 4):
        at = np.flatnonzero(lengths > k)
        if len(at):
            ranks[at] |= own[starts[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def id_counts(tokens: DataFrame, path: str) -> DataFrame:
    """(id, n) over all documents, counted in tasks before the shuffle."""

    def run(batches):
        import pyarrow as pa

        kind, total = id_type(path), np.zeros(len(byte_lengths(path)), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                ids = np.concatenate([unpacked(x, kind) for x in batch.column("ids").slice(at, 1024).to_pylist()])
                total += np.bincount(ids, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def rank_table(counts: DataFrame) -> np.ndarray:
    """Ids by falling count, then id.  A vocabulary at most comes to the driver."""
    rows = counts.collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


BLOCK = "part int, seq long, before long, doc_ids array<long>, lengths array<long>, n long, control binary, data binary"
BLOCK_FIELDS = [x.split()[0] for x in BLOCK.split(", ")]
RANKS = "rank long, id long"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str | None = None) -> None:
    """Write the ranks, and the blocks of all documents, under path."""
    vocabulary = tokenizer_path or vocabulary_path()
    tokens = written(tokenized(docs, vocabulary))
    by_rank = rank_table(id_counts(tokens, vocabulary))
    # a row for each id of the vocabulary that occurs
    spark = docs.sparkSession
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], RANKS).coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))

    def run(batches):
        import pyarrow as pa

        kind = id_type(vocabulary)
        part, before, seq, ids, own, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def block():
            control, data = pack_ranks(rank_of[np.concatenate(own)])
            values = [part, seq, before, list(ids), [len(x) for x in own], held, control, data]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()])], BLOCK_FIELDS)

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids.append(doc_id)
                own.append(unpacked(data, kind))
                held += len(own[-1])
                if held >= BLOCK_TOKENS:
                    yield block()
                    before, seq, ids, own, held = before + held, seq + 1, [], [], 0
        if own:
            yield block()

    ordered = tokens.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, BLOCK).write.parquet(f"{path}/blocks")
    dropped(tokens)


def read_token_files(spark, path: str, digest) -> DataFrame:
    """Per document of the files under path: doc_id, start, n_tokens, and digest(ids) as ids_crc32."""
    reachable(spark)
    # a vocabulary at most
    ranks = spark.read.schema(RANKS).parquet(f"{path}/ranks").collect()
    by_rank = np.zeros(len(ranks), np.uint32)
    by_rank[[r["rank"] for r in ranks]] = [r["id"] for r in ranks]
    files = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # tokens ahead of each part: as many rows as the writing job had tasks, so it is broadcast
    totals = files.groupBy("part").agg(F.sum("n").alias("n"))
    ahead = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                ids = by_rank[unpack_ranks(r["control"], r["data"], r["n"])]
                ends = np.cumsum(r["lengths"])
                starts = ends - r["lengths"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + (r["ahead"] + r["before"]), pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array([digest(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.join(F.broadcast(ahead), "part").select("ahead", "before", "doc_ids", "lengths", "n", "control", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def round_trip(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write all documents' ids in the file format and give what reading them back finds.

    Null text is empty: its document has the end id alone.  Rows that repeat a
    doc_id stand side by side, null ids come first, an empty table gives no
    rows, other columns are ignored.
    """
    path = shared_dir(docs.sparkSession)
    write_token_files(docs, path, tokenizer_path)
    return read_token_files(docs.sparkSession, path, crc32_of)
