"""Duplicate suppression over chunks and pages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import runs, settled, ship
from ..functions.text import content_hash, shingles, simple_tokens


def exact_dedupe(docs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row, by order, of each key.  The aggregate combines before the shuffle, so hot keys stay cheap."""
    rest = [c for c in docs.columns if c not in keys]
    first = docs.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*docs.columns)


def by_content(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(content_hash, first_id, copies) of each normalised text."""
    return docs.select(id_col, content_hash(F.col(text)).alias("content_hash")).groupBy("content_hash").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))


#: Places of the table that orders shingles by rarity; driver and tasks hold one number for each.
PLACES = 1 << 20


def _arrays(batch, column: str, most: int = 1 << 15):
    """(first row, offsets from 0, flat values) of runs of rows of an Arrow batch, of about `most` values each."""
    at = batch.column(column).offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    at = at - at[0]
    for a, b in runs(np.diff(at).tolist(), most):
        yield a, at[a : b + 1] - at[a], values[at[a] : at[b]]


def rarity(sets: DataFrame) -> np.ndarray:
    """How many of the hashes in sets (h) fall on each of PLACES places."""

    def run(batches):
        import pyarrow as pa

        count = np.zeros(PLACES, np.int64)
        for batch in batches:
            for _, _, h in _arrays(batch, "h", 1 << 20):
                count += np.bincount(h & (PLACES - 1), minlength=PLACES)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(count[held])], ["at", "n"])

    found = sets.select("h").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(PLACES, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, n, x): of each set of hashes (doc_id, h) the rarest ones, of which two sets that are alike share one, and the set's size.

    Rarity is that of a hash's place in a table of fixed size, ties by hash: an
    order of all hashes, so the filter stays exact whatever falls on one place.
    """
    count = rarity(sets)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, at, h in _arrays(batch, "h"):
                n = np.diff(at)
                row, rare = np.repeat(np.arange(len(n)), n), count[h & (PLACES - 1)]
                order = np.lexsort((h, rare, row))
                head = (n - np.ceil(n * threshold) + 1).astype(np.int64)
                keep = order[(np.arange(len(h)) - at[row] < head[row]) & (rare[order] > 1)]
                ids = batch.column("doc_id").slice(first, len(n)).take(pa.array(row[keep]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[row[keep]].astype(np.int32)), pa.array(h[keep])], ["doc_id", "n", "x"])

    return sets.select("doc_id", "h").mapInArrow(run, f"doc_id {dict(sets.dtypes)['doc_id']}, n int, x long")


def shingle_pairs(docs: DataFrame, n: int = 5, threshold: float = 0.9) -> DataFrame:
    """(a, b, similarity): documents whose n-word shingle sets are alike by threshold, exact copies once.

    Prefix filter: with shingles in order of rarity, two sets that are alike
    share one among the first (1 - threshold) of each, so only those are joined;
    candidates are verified on the whole sets.  Copies, told by 128 bits of the
    sets, are left out of the join but for the first, so a large group of equal
    sets has one member there.
    """
    ship()
    hashes = F.array_sort(F.transform(shingles(simple_tokens(F.col("text")), n), lambda x: F.xxhash64(x)))
    # settled before it is filtered: a filter on the hashes would be pushed down and make them twice
    sets = settled(docs.where("doc_id is not null").select("doc_id", hashes.alias("h"))).where(F.size("h") > 0).withColumn("g", F.struct(F.xxhash64("h").alias("a"), F.xxhash64(F.lit(1), "h").alias("b")))
    firsts = sets.groupBy("g").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = sets.select("doc_id", "g").join(firsts, "g").where("doc_id <> first").select("doc_id")
    keyed = prefixes(sets, threshold).join(copies, "doc_id", "left_anti")
    a, b = keyed.alias("a"), keyed.alias("b")
    near = (F.col("a.doc_id") < F.col("b.doc_id")) & (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n"))
    cand = a.join(b, (F.col("a.x") == F.col("b.x")) & near).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()
    left = sets.select(F.col("doc_id").alias("a"), F.col("h").alias("ha"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("h").alias("hb"))
    both = cand.join(left, "a").join(right, "b").withColumn("c", F.size(F.array_intersect("ha", "hb")))
    similarity = F.col("c") / (F.size("ha") + F.size("hb") - F.col("c"))
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    return h


def _turned(h: np.ndarray, n: int) -> np.ndarray:
    return h << np.uint64(n) | h >> np.uint64(64 - n)


def hash_long(x: np.ndarray, seed) -> np.ndarray:
    """Spark's xxhash64 of a long after a seed, both unsigned."""
    h = _turned(x * np.uint64(0xC2B2AE3D27D4EB4F), 31) * np.uint64(0x9E3779B185EBCA87) ^ seed + np.uint64(0x27D4EB2F165667C5 + 8)
    return _mixed(_turned(h, 27) * np.uint64(0x9E3779B185EBCA87) + np.uint64(0x85EBCA77C2B2AE63))


def hash_int(i: int, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int of 0 or more after a seed."""
    h = seed + np.uint64(0x27D4EB2F165667C5 + 4) ^ np.uint64(i * 0x9E3779B185EBCA87 & (1 << 64) - 1)
    return _mixed(_turned(h, 23) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))


def minhash_candidates(docs: DataFrame, n: int = 5, bands: int = 16, rows: int = 4) -> DataFrame:
    """(band, key, first_id, doc_id): documents that share a band of minima with the first of its bucket (a star, not all pairs).

    Minimum i is that of xxhash64(hash of a shingle, i), a key the xxhash64 of a band's minima.
    """
    ship()
    h = F.transform(shingles(simple_tokens(F.col("text")), n), lambda x: F.xxhash64(x))
    sets = docs.select("doc_id", h.alias("h"))

    def run(batches):
        import pyarrow as pa

        seed = np.uint64(42)
        for batch in batches:
            for first, at, x in _arrays(batch, "h"):
                held = np.flatnonzero(np.diff(at))  # texts without a word have no minima
                if not len(held):
                    continue
                once, keys = hash_long(x.view(np.uint64), seed), []
                for band in range(bands):
                    key = seed
                    for i in range(band * rows, (band + 1) * rows):
                        key = hash_long(np.minimum.reduceat(hash_int(i, once).view(np.int64), at[held]).view(np.uint64), key)
                    keys.append(key.view(np.int64))
                ids = batch.column("doc_id").slice(first, len(at) - 1).take(pa.array(np.repeat(held, bands)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(bands, dtype=np.int32), len(held))), pa.array(np.stack(keys, axis=1).ravel())], ["doc_id", "band", "key"])

    each = settled(sets.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, band int, key long"))
    firsts = each.groupBy("band", "key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return each.join(firsts, ["band", "key"]).where("doc_id <> first_id")


def host_boilerplate(blocks: DataFrame, least_pages: int = 2) -> DataFrame:
    """blocks (host, url, text): content hashes that stand on several pages of one host, with their pages."""
    hashed = blocks.select("host", "url", content_hash(F.col("text")).alias("content_hash"), F.length("text").alias("n"))
    per_page = hashed.groupBy("host", "content_hash", "url").agg(F.max("n").alias("n"))
    return per_page.groupBy("host", "content_hash").agg(F.count("*").alias("pages"), F.max("n").alias("n_chars")).where(F.col("pages") >= least_pages)


def shingle_boilerplate(chunks: DataFrame, n: int = 8, share: float = 0.8) -> DataFrame:
    """chunks (session, host, url, seq, chunk_id, text): (dropped, earlier) pairs that share most shingles both ways across pages of a host."""
    s = chunks.select("host", "url", "seq", "chunk_id", shingles(simple_tokens(F.col("text")), n).alias("s")).where(F.size("s") >= 5)
    each = s.select("host", "url", "seq", "chunk_id", F.size("s").alias("n"), F.explode("s").alias("x"))
    a, b = each.alias("a"), each.alias("b")
    hit = a.join(b, (F.col("a.host") == F.col("b.host")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.url") != F.col("b.url")) & (F.col("a.seq") > F.col("b.seq")))
    both = hit.groupBy(F.col("a.chunk_id").alias("dropped"), F.col("b.chunk_id").alias("earlier")).agg(F.count("*").alias("c"), F.first("a.n").alias("na"), F.first("b.n").alias("nb"))
    return both.where((F.col("c") >= share * F.col("na")) & (F.col("c") >= share * F.col("nb"))).select("dropped", "earlier")


def page_verdict(chunks: DataFrame, dropped: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """Pages of at least `least` chunks of which `share` are dropped: whole-page duplicates."""
    marked = chunks.join(dropped.select(F.col("dropped").alias("chunk_id")).distinct().withColumn("gone", F.lit(1)), "chunk_id", "left")
    per = marked.groupBy("url").agg(F.count("*").alias("chunks"), F.count("gone").alias("matched"))
    return per.where((F.col("chunks") >= least) & (F.col("matched") >= share * F.col("chunks")))


def corroboration(chunks: DataFrame, threshold: float = 0.25, n: int = 3) -> DataFrame:
    """chunks (query_id, doc_id, domain, text): other domains with a passage alike, plus one."""
    s = chunks.select("query_id", "doc_id", "domain", F.transform(shingles(simple_tokens(F.col("text")), n), lambda x: F.xxhash64(x)).alias("s"))
    each = s.select("query_id", "doc_id", "domain", F.size("s").alias("n"), F.explode("s").alias("x"))
    a, b = each.alias("a"), each.alias("b")
    hit = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.domain") != F.col("b.domain")))
    pair = hit.groupBy(F.col("a.query_id").alias("query_id"), F.col("a.doc_id").alias("doc_id"), F.col("b.doc_id").alias("other"), F.col("b.domain").alias("domain")).agg((F.count("*") / (F.first("a.n") + F.first("b.n") - F.count("*"))).alias("j"))
    return pair.where(F.col("j") >= threshold).groupBy("query_id", "doc_id").agg((F.count_distinct("domain") + 1).alias("domains"))


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct character trigrams in order, their counts)."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:], return_counts=True)


def trigram_f1(a: str, b: str) -> float:
    (ga, na), (gb, nb) = trigram_counts(a), trigram_counts(b)
    _, at_a, at_b = np.intersect1d(ga, gb, assume_unique=True, return_indices=True)
    return 2.0 * float(np.minimum(na[at_a], nb[at_b]).sum()) / float(na.sum() + nb.sum())


def trigram_scores(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, f1): multiset overlap of character trigrams of white-space-normalised texts for pairs (a, b); texts without a trigram have no row.

    Trigrams are counted where the two texts meet, as one row for each character
    of long texts is too many to shuffle.
    """
    norm = F.trim(F.regexp_replace("text", "[ \\t-\\r]+", " "))

    def side(docs: DataFrame, key: str) -> DataFrame:
        return docs.select(F.col("doc_id").alias(key), norm.alias(f"t{key}")).where(F.length(f"t{key}") >= 3)

    rows = pairs.join(side(left, "a"), "a").join(side(right, "b"), "b").select("a", "b", "ta", "tb")

    ship()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            f1 = [trigram_f1(x.as_py(), y.as_py()) for x, y in zip(batch.column("ta"), batch.column("tb"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(f1, pa.float64())], ["a", "b", "f1"])

    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, f"a {kind['a']}, b {kind['b']}, f1 double")


def first_of_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
