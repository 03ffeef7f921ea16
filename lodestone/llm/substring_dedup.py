"""Repeated 20-word windows by a log-structured index of window hashes.

A window is stood for by the least hash of its 13 eight-word runs, so equal
windows share it wherever they lie, and about one hash in seven words is kept.

The index lives under a path.  Each batch of documents adds blocks of packed
words, and an immutable run: the blocks' distinct hashes, sorted, in rows of one
shard each that name the segment (file of blocks) they come from.  Runs are
merge-joined with those of the next batch, shard by shard; after FAN runs they
are compacted into one, which replaces them.

Hashes that a new batch holds twice, or shares with an earlier run, go into a
Bloom filter of bounded size.  What passes it, in the batch and in those old
segments that hold such a hash (no others are read), is verified: all 20-word
windows that it stands for are hashed in full, by two hashes of the words' bytes
that know nothing of each other (96 bits), and the first of equal windows is
found by shards.  The filter's false hits only add windows to verify.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import BASES, Filter, U, bloom_add, hash_bytes, member, mix, packed, segment_size, shard_of, unpacked
from .shared import files_of, remove, shared_dir, slices, texts

WINDOW, RUN = 20, 8
#: Bits of a Bloom filter at most (32 MB), and of the number of its segments.
MOST_BITS, FILTER_SHARDS = 1 << 28, 8
#: Bytes of words in a block, and of text for each shard, about.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 8 << 20
#: Runs that are compacted into one.
FAN = 4
NO_ID = -(1 << 63)
#: Blocks of a task, and tasks of a batch, at most, in bits.
BLOCK_BITS, TASK_BITS = 20, 24
P1, P2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


# ---- hashes of windows ----------------------------------------------------


def rolled(h: np.ndarray, size: int, factor) -> np.ndarray:
    """Hash of each run of size words."""
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * factor + h[i : i + n]
    return mix(out)


def slid(v: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each width values in a row, by doubling."""
    span = 1
    while span * 2 <= width:
        v = pick(v[:-span], v[span:])
        span *= 2
    if span < width:
        v = pick(v[: len(v) - (width - span)], v[width - span :])
    return v


def least_hashes(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of several texts: (starts of windows that are one text's, the least hash of each, as 48 bits, whether a place begins there).

    Least hashes are small, so they are mixed once more to spread over shards.
    Windows whose least hash is that of the same run, the first if several have
    it, are one place.  Equal windows are never one place, even side by side (in
    a text that repeats itself at once, or at the end of one and the start of
    the next).
    """
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    runs = rolled(h, RUN, P1)
    least = slid(runs, WINDOW - RUN + 1, np.minimum)
    starts = np.flatnonzero(np.arange(len(least)) + WINDOW <= np.repeat(np.cumsum(counts), counts)[: len(least)])
    least = least[starts]
    # a window that starts with its least run leaves it behind
    begins = np.append(True, (starts[1:] != starts[:-1] + 1) | (least[1:] != least[:-1]) | (runs[starts[:-1]] == least[:-1]))[: len(starts)]
    return starts, mix(least) >> U(16), begins


def shards(h: np.ndarray, bits: int) -> np.ndarray:
    """Shard of a hash of 48 bits."""
    return shard_of(h << U(16), bits)


def by_shard(h: np.ndarray, bits: int):
    """(shard, slice) of each shard that has some of the sorted hashes of 48 bits."""
    edges = np.searchsorted(shards(h, bits), np.arange((1 << bits) + 1))
    for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield s, slice(edges[s], edges[s + 1])


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted integers as differences, whose upper bytes are mostly zero."""
    return packed(np.diff(h, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.copy())


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


# ---- blocks ---------------------------------------------------------------

BLOCK = "block long, doc_ids array<long>, n_words array<long>, digests binary, words binary"


def blocks_of(docs: DataFrame, batch: int) -> DataFrame:
    """BLOCK rows: the packed words of documents, single spaces between words and a line for each document, by ascending doc_id."""

    def run(batches):
        import pyarrow as pa

        task = (batch << TASK_BITS) + TaskContext.get().partitionId()
        held, size, seq = [], 0, 0

        def row():
            held.sort(key=lambda r: r[0])
            values = [(task << BLOCK_BITS) + seq, [None if r[0] == NO_ID else r[0] for r in held], [r[1] for r in held], b"".join(r[2] for r in held), packed(np.frombuffer(b"\n".join(r[3] for r in held), np.uint8))]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["block", "doc_ids", "n_words", "digests", "words"])

        for big in batches:
            for part in slices(big, "text", BLOCK_BYTES):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    words = text.split()
                    joined = b" ".join(words)
                    held.append((NO_ID if doc_id is None else doc_id, len(words), hashlib.sha256(joined).digest(), joined))
                    size += len(joined) + 1
                    if size >= BLOCK_BYTES:
                        yield row()
                        held, size, seq = [], 0, seq + 1
        if held:
            yield row()

    return texts(docs).mapInArrow(run, BLOCK)


def inflated(data: bytes) -> bytes:
    return unpacked(data, np.uint8).tobytes()


# ---- runs -----------------------------------------------------------------

#: owners: of each hash its place in segments; twice: whether a block held it twice.
RUN_ROW = "shard long, segments array<long>, hashes binary, owners binary, twice binary, n long"
RUN_FIELDS = [x.split()[0] for x in RUN_ROW.split(", ")]


def run_row(rows: list[tuple]):
    """An Arrow batch of RUN_ROW values."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], RUN_FIELDS)


def run_of(blocks: DataFrame, bits: int) -> DataFrame:
    """RUN_ROW rows of blocks: the distinct hashes that stand for their windows, by shard."""

    def run(batches):
        for batch in batches:
            for block, counts, data in zip(batch.column("block").to_pylist(), batch.column("n_words").to_pylist(), batch.column("words").to_pylist()):
                _, least, begins = least_hashes(hash_bytes(inflated(data))[0], np.array(counts, np.int64))
                h, n = np.unique(least[begins], return_counts=True)  # a hash at two places may stand for equal windows
                yield run_row([(s, [block >> BLOCK_BITS], pack_sorted(h[at]), packed(np.zeros(len(h[at]), np.uint32)), packed((n[at] > 1).astype(np.uint8)), len(h[at])) for s, at in by_shard(h, bits)])

    return blocks.select("block", "n_words", "words").mapInArrow(run, RUN_ROW)


def finer(run: DataFrame, bits: int) -> DataFrame:
    """The rows of a run dealt to more shards."""

    def split(batches):
        for batch in batches:
            for r in batch.to_pylist():
                h, owners, twice = unpack_sorted(r["hashes"]), unpacked(r["owners"], np.uint32), unpacked(r["twice"], np.uint8)
                yield run_row([(s, r["segments"], pack_sorted(h[at]), packed(owners[at]), packed(twice[at]), len(h[at])) for s, at in by_shard(h, bits)])

    return run.mapInArrow(split, RUN_ROW)


def rows_of(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(hashes, place of each one's segment, twice, row, segments) of RUN_ROW rows."""
    segments: dict[int, int] = {}
    hashes, owners, twice, row = ([] for _ in range(4))
    for i, (own, h, o, t) in enumerate(zip(*(table.column(c).to_pylist() for c in ("segments", "hashes", "owners", "twice")))):
        names = np.array([segments.setdefault(s, len(segments)) for s in own], np.uint32)
        hashes.append(unpack_sorted(h))
        owners.append(names[unpacked(o, np.uint32)])
        twice.append(unpacked(t, np.uint8))
        row.append(np.full(len(hashes[-1]), i, np.int32))
    return *(np.concatenate(x) for x in (hashes, owners, twice, row)), list(segments)


def merge_rows(table):
    """One RUN_ROW of all rows of a shard: each hash once for each segment."""
    import pyarrow as pa

    h, owners, twice, _, segments = rows_of(table)
    order = np.lexsort((owners, h))
    h, owners, twice = h[order], owners[order], twice[order]
    at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owners[1:] != owners[:-1])))
    many = np.diff(np.append(at, len(h))) > 1
    return pa.Table.from_batches([run_row([(table.column("shard")[0].as_py(), segments, pack_sorted(h[at]), packed(owners[at]), packed((np.maximum.reduceat(twice, at) | many).astype(np.uint8)), len(at))])])


def join_runs(table):
    """(shard, hashes, n, segments): hashes that the new rows of a shard hold twice or share with old ones, and the old segments that hold them."""
    import pyarrow as pa

    new_row = table.column("new").to_numpy()
    h, owners, twice, row, segments = rows_of(table)
    new = new_row[row]
    order = np.argsort(h, kind="stable")
    h, owners, twice, new = h[order], owners[order], twice[order].astype(bool), new[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(at, len(h)))
    found = np.logical_or.reduceat(new, at) & ((size > 1) | np.logical_or.reduceat(twice & new, at))
    hit = np.unique(owners[np.repeat(found, size) & ~new])
    return pa.table({"shard": table.column("shard").slice(0, 1), "hashes": pa.array([pack_sorted(h[at[found]])], pa.binary()), "n": pa.array([int(found.sum())], pa.int64()), "segments": pa.array([[segments[i] for i in hit]], pa.list_(pa.int64()))})


def filter_of(found: DataFrame, bits: int) -> Filter:
    """A Bloom filter of bounded size of the hashes that join_runs found."""
    total = found.agg(F.sum("n")).first()[0] or 0
    few = min(bits, FILTER_SHARDS)
    size = segment_size(total, few, MOST_BITS)

    def fill(table):
        import pyarrow as pa

        own = np.zeros(size // 8, np.uint8)
        for data in table.column("hashes").to_pylist():
            bloom_add(own, size, member(mix(unpack_sorted(data)), 1))
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([own.tobytes()], pa.binary())})

    parts = found.where("n > 0").select(F.shiftright("shard", bits - few).alias("part"), "hashes").groupBy("part").applyInArrow(fill, "part long, bits binary")
    whole = np.zeros((size // 8) << few, np.uint8)
    for r in parts.toLocalIterator():
        whole[r["part"] * (size // 8) : (r["part"] + 1) * (size // 8)] = np.frombuffer(r["bits"], np.uint8)
    return Filter(whole, few, size)


def passes(f: Filter, h: np.ndarray) -> np.ndarray:
    return f.levels(mix(h), shards(h, f.shard_bits), 2) > 0 if len(h) else np.zeros(0, bool)


# ---- windows --------------------------------------------------------------

#: A block's windows of one shard: their two hashes, and in the new batch their doc_ids and places.  Rows without hashes hold places that are gone.
WINDOWS = "shard long, block long, first binary, second binary, ids binary, places binary"
WINDOW_FIELDS = [x.split()[0] for x in WINDOWS.split(", ")]


def windows_of(blocks: DataFrame, found, bits: int, new: bool) -> DataFrame:
    """WINDOWS rows of all windows that pass the broadcast filter; of equal ones in a block the first stands for all."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4
        for batch in batches:
            for block, ids, counts, data in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_ids", "n_words", "words"))):
                text, counts = inflated(data), np.array(counts, np.int64)
                h = hash_bytes(text)[0]
                starts, least, _ = least_hashes(h, counts)
                values, at = np.unique(least, return_inverse=True)
                starts = starts[passes(found.value, values)[at]]
                if not len(starts):
                    continue
                first = rolled(h, WINDOW, P1)[starts]
                second = (rolled(hash_bytes(text, BASES[1])[0], WINDOW, P2)[starts] >> U(32)).astype(np.uint32)
                order = np.lexsort((second, first))  # stable: of equal windows the first in the block leads
                first, second, starts = first[order], second[order], starts[order]
                lead = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
                gone = np.sort(starts[~lead])
                first, second, starts = first[lead], second[lead], starts[lead]
                own = np.array([NO_ID if i is None else i for i in ids], np.int64)[np.searchsorted(np.cumsum(counts), starts, side="right")]
                rows = []
                for s, k in by_shard(first >> U(16), bits):
                    rows.append((s, block, pack_sorted(first[k]), packed(second[k]), packed(own[k]) if new else None, packed(starts[k].astype(np.uint32)) if new else None))
                if new and len(gone):
                    rows.append((rows[0][0], block, None, None, None, pack_sorted(gone.astype(np.uint64))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], WINDOW_FIELDS)

    return blocks.select("block", "doc_ids", "n_words", "words").mapInArrow(run, WINDOWS)


def later_windows(table):
    """(block, gone): places of the new batch's windows of a shard that an old window or one with a smaller id equals."""
    import pyarrow as pa

    out: dict[int, list[np.ndarray]] = {}
    first, second, ids, places, blocks = ([] for _ in range(5))
    for block, f, s, i, p in zip(*(table.column(c).to_pylist() for c in WINDOW_FIELDS[1:])):
        if f is None:
            out.setdefault(block, []).append(unpack_sorted(p))
            continue
        first.append(unpack_sorted(f))
        second.append(unpacked(s, np.uint32))
        n = len(first[-1])
        ids.append(np.zeros(n, np.int64) if i is None else unpacked(i, np.int64))
        places.append(np.zeros(n, np.uint32) if p is None else unpacked(p, np.uint32))
        blocks.append(np.full(n, -1 if p is None else block, np.int64))
    if first:
        f, s, i, p, b = (np.concatenate(x) for x in (first, second, ids, places, blocks))
        order = np.lexsort((s, f))
        f, s, i, p, b = f[order], s[order], i[order], p[order], b[order]
        at = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (s[1:] != s[:-1])))
        size = np.diff(np.append(at, len(f)))
        old = np.logical_or.reduceat(b < 0, at)
        # the least id leads, of equal ids the least block
        least = i == np.repeat(np.minimum.reduceat(i, at), size)
        lead = least & (b == np.repeat(np.minimum.reduceat(np.where(least, b, np.iinfo(np.int64).max), at), size))
        gone = (b >= 0) & (np.repeat(old, size) | ~lead)
        p, b = p[gone], b[gone]
        order = np.lexsort((p, b))
        p, b = p[order], b[order]
        edges = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b)) if len(b) else np.zeros(1, np.int64)
        for x, y in zip(edges, edges[1:]):
            out.setdefault(int(b[x]), []).append(p[x:y].astype(np.uint64))
    rows = [(k, pack_sorted(x)) for k, v in out.items() for x in v]
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "gone": pa.array([r[1] for r in rows], pa.binary())})


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def cut(rows: DataFrame, with_text: bool) -> DataFrame:
    """Documents of blocks without the words that windows at the places in gone (a list of packed ones, or null) cover."""
    schema = OUT + (", kept string" if with_text else "")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, counts, digests, data, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "n_words", "digests", "words", "gone"))):
                counts = np.array(counts, np.int64)
                ends = np.cumsum(counts)
                cover = np.zeros(ends[-1] + 1, np.int32)
                for g in gone or ():
                    places = unpack_sorted(g).astype(np.int64)
                    np.add.at(cover, places, 1)
                    np.add.at(cover, places + WINDOW, -1)
                keep = np.cumsum(cover[:-1]) == 0
                left = np.diff(np.append(0, np.cumsum(keep))[np.append(0, ends)])
                sha = [digests[k : k + 32].hex() for k in range(0, len(digests), 32)]
                lines = inflated(data).split(b"\n") if with_text or (left < counts).any() else []
                for k in np.flatnonzero(left < counts).tolist():
                    lines[k] = b" ".join(compress(lines[k].split(b" "), keep[ends[k] - counts[k] : ends[k]].tolist()))
                    sha[k] = hashlib.sha256(lines[k]).hexdigest()
                cols = [pa.array(ids, pa.int64()), pa.array(counts), pa.array(counts - left), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(lines, pa.binary()).cast(pa.string())] if with_text else []), [x.split()[0] for x in schema.split(", ")])

    return rows.select("doc_ids", "n_words", "digests", "words", "gone").mapInArrow(run, schema)


# ---- the index ------------------------------------------------------------


class WindowIndex:
    """The index under a path; opening it again goes on where it stood.

    Documents of a later batch count as later than those of earlier ones.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan

    def runs(self) -> list[tuple[int, int, int]]:
        """(first batch, last batch, bits of shards) of the complete runs that no compacted one replaces."""
        named = sorted({tuple(map(int, f.split("/")[-2].split("-"))) for f in files_of(self.spark, f"{self.path}/runs") if f.endswith("/_SUCCESS")}, key=lambda r: (r[0], -r[1]))
        out: list[tuple[int, int, int]] = []
        for r in named:
            if not out or r[0] > out[-1][1]:
                out.append(r)
        return out

    def _run(self, run: tuple[int, int, int]) -> DataFrame:
        return self.spark.read.schema(RUN_ROW).parquet(self._name(run))

    def _name(self, run: tuple[int, int, int]) -> str:
        return f"{self.path}/runs/{run[0]}-{run[1]}-{run[2]}"

    def _blocks(self, batch: int, segments: set[int] | None = None) -> DataFrame | None:
        """Blocks of a batch, or of some of its segments: a segment is the file that one task wrote."""
        reader, folder = self.spark.read.schema(BLOCK), f"{self.path}/blocks/{batch}"
        if segments is None:
            return reader.parquet(folder)
        names = [f for f in files_of(self.spark, folder) if f.rpartition("/")[2].startswith("part-") and int(f.rpartition("/")[2].split("-")[1]) in segments]
        return reader.parquet(*names) if names else None

    def add(self, docs: DataFrame, with_text: bool = False) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 (and the kept words) of a new batch; the index takes it in."""
        runs = self.runs()
        batch = runs[-1][1] + 1 if runs else 0
        blocks_of(docs, batch).write.mode("overwrite").option("compression", "none").parquet(f"{self.path}/blocks/{batch}")
        blocks = self._blocks(batch)
        size = blocks.agg(F.sum(F.octet_length("words"))).first()[0] or 0
        bits = max([r[2] for r in runs] + [int(np.ceil(np.log2(max(1, 3 * size / SHARD_BYTES))))])
        run_of(blocks, bits).write.option("compression", "none").mode("overwrite").parquet(self._name((batch, batch, bits)))
        rows = self._run((batch, batch, bits)).withColumn("new", F.lit(True))
        for r in runs:
            old = self._run(r)
            rows = rows.unionByName((old if r[2] == bits else finer(old, bits)).withColumn("new", F.lit(False)))
        joined = f"{self.path}/found/{batch}"
        rows.groupBy("shard").applyInArrow(join_runs, "shard long, hashes binary, n long, segments array<long>").write.mode("overwrite").parquet(joined)
        found = self.spark.read.schema("shard long, hashes binary, n long, segments array<long>").parquet(joined)
        shared = self.spark.sparkContext.broadcast(filter_of(found, bits))
        windows = windows_of(blocks, shared, bits, True)
        # as many segments as tasks have written
        hit = [r[0] for r in found.select(F.explode("segments").alias("s")).distinct().collect()]
        for b in sorted({s >> TASK_BITS for s in hit}):
            old = self._blocks(b, {s & ((1 << TASK_BITS) - 1) for s in hit if s >> TASK_BITS == b})
            if old is not None:
                windows = windows.unionByName(windows_of(old, shared, bits, False))
        gone = windows.groupBy("shard").applyInArrow(later_windows, "block long, gone binary").groupBy("block").agg(F.collect_list("gone").alias("gone"))
        out = cut(blocks.join(gone, "block", "left"), with_text)
        if len(runs) + 1 >= self.fan:
            self.compact()
        return out

    def compact(self) -> None:
        """Merge all runs into one, which replaces them."""
        runs = self.runs()
        if len(runs) > 1:
            bits, rows = max(r[2] for r in runs), None
            for r in runs:
                own = self._run(r) if r[2] == bits else finer(self._run(r), bits)
                rows = own if rows is None else rows.unionByName(own)
            rows.groupBy("shard").applyInArrow(merge_rows, RUN_ROW).write.mode("overwrite").option("compression", "none").parquet(self._name((runs[0][0], runs[-1][1], bits)))
            for r in runs:
                remove(self.spark, self._name(r))


def remove_repeats(docs: DataFrame, batches: int = 2, with_text: bool = False, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and with_text the kept words) of all documents, taken in as batches of ascending doc_id.

    A word goes if a window of 20 words covers it whose words also start earlier
    (smaller doc_id, or earlier in the document).  Null text is empty.  Rows that
    repeat a doc_id are documents of their own, one of them the first; a null
    doc_id stands before all others.  An empty table gives no rows; other
    columns are ignored.  path: where the index is kept; by default a folder of
    the job's own.
    """
    index = WindowIndex(docs.sparkSession, path or shared_dir(docs.sparkSession))
    edges = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)] or [0.5], 1000)).first()[0]
    cuts = sorted(set(edges or [])) if batches > 1 else []
    out, own = None, F.col("doc_id").cast("long")
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = docs if low is None else docs.where(own > low)
        if high is not None:
            part = part.where((own <= high) | own.isNull() if low is None else own <= high)
        got = index.add(part, with_text)
        out = got if out is None else out.unionByName(got)
    return out
