"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within distance r meet: some point lies within ceil(r/2) of the
one and floor(r/2) of the other.  For r = 3 a full ball of radius 2 has 2081
points, so balls are first drawn in halves of the word: of two fingerprints at
distance 3 or less, one 32-bit half differs in one bit at most.  Every distinct
fingerprint therefore emits, per half, the ball of radius 1 (33 variants) and
its own half as a centre; a shuffle on variants brings the pairs together, which
are deduplicated and verified on all 64 bits.

Halves that many fingerprints share would give all pairs of a group.  Those
fingerprints (and only those) go through the full balls instead: whatever lies
within 1 of a point is within 3 of whatever lies within 2 of it, so one star for
each point links them all, with no pair loop and no verification.  Both ways are
exact, and together they find every link's component.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, texts, written

BITS = 64
RADIUS = 3
#: Fingerprints that may reach one variant before they take the full balls.  A
#: full ball has 561 rows on average, so up to about as many pairs for each
#: fingerprint cost less than its ball.  It changes the cost, never the result.
CROWD = 512
LOWER = bytes(range(256)).lower()  # lower-cases A-Z in bytes and nothing else


def fingerprint_of(text: bytes, size: int = 3, seed: int = 42) -> int:
    """SimHash over the XXH64 of word shingles, repeats included; zero without words."""
    import xxhash

    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    h64 = xxhash.xxh64_intdigest
    if n < size:
        return h64(b" ".join(words), seed)
    joined = b" ".join(words)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
    a, b = starts[: n - size + 1].tolist(), (starts[size:] - 1).tolist()
    hashes = np.fromiter([h64(joined[i:j], seed) for i, j in zip(a, b)], np.uint64, n - size + 1)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * total > len(hashes))
    return sum(1 << int(i) for i in set_bits)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; null text is empty."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = [fingerprint_of(x, size) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(own, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def half_balls(batches):
    """Per fingerprint and half: its centre, and the ball of radius 1 around it."""
    import pyarrow as pa

    flips = np.concatenate([[0], 1 << np.arange(32, dtype=np.uint64)]).astype(np.uint64)
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for side in (0, 1):
            own = (fp >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)
            points = ((own[:, None] ^ flips[None, :]) << np.uint64(1)) | np.uint64(side)
            yield pa.RecordBatch.from_arrays(
                [pa.array(points.ravel().view(np.int64)), pa.array(np.repeat(fp, 33).view(np.int64)), pa.array(np.tile(np.arange(33) == 0, len(fp)))],
                ["point", "fp", "centre"],
            )


def full_balls(batches):
    """Per fingerprint: all points within 1 of it (near) and, for odd parity, those at 2 of it in one half.

    At distance 1 or 3 the parities differ, so the odd one's wide ball meets the
    even one's near ball; at distance 2 two near balls meet.  Of three differing
    bits two lie in the same half, so wide balls need no bits of different halves.
    """
    import pyarrow as pa

    one = 1 << np.arange(BITS, dtype=np.uint64)
    i, j = np.triu_indices(BITS, 1)
    i, j = i[i // 32 == j // 32], j[i // 32 == j // 32]
    close = np.concatenate([[np.uint64(0)], one]).astype(np.uint64)
    wide = (one[i] | one[j]).astype(np.uint64)
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        odd = fp[(np.bitwise_count(fp) & 1).astype(bool)]
        for near, own, flips in ((True, fp, close), (False, odd, wide)):
            for at in range(0, len(own), 64):
                part = own[at : at + 64]
                points = (part[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(points.view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64)), pa.array(np.full(len(points), near))], ["point", "fp", "near"]
                )


def fingerprint_links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links within distance 3 whose components are those of all links.

    distinct: one column fp.  crowd: see CROWD.
    """
    points = distinct.mapInArrow(half_balls, "point long, fp long, centre boolean")
    # a variant matters only where it is some fingerprint's own half
    own = distinct.select(F.explode(F.array(*[F.shiftleft(F.shiftright("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF)), 1).bitwiseOR(F.lit(k)) for k in (0, 1)])).alias("point")).distinct()
    met = written(points.join(own, "point", "left_semi"))
    sizes = met.groupBy("point").agg(F.count("*").alias("n"), F.count_if("centre").alias("centres")).where("n > 1")
    met = met.join(sizes, "point")
    # of a crowded variant all that reach it go to the full balls
    hot = met.where(F.col("n") > crowd).select("fp").distinct()
    few = met.where(F.col("n") <= crowd)
    pairs = (
        few.select("point", F.col("fp").alias("a")).join(few.where("centre").select("point", F.col("fp").alias("b")), "point")
        .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    balls = hot.mapInArrow(full_balls, "point long, fp long, near boolean")
    # one star for each point: whatever is near it links with all that reach it
    hubs = balls.where("near").groupBy("point").agg(F.min("fp").alias("b"))
    stars = balls.join(hubs, "point").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.unionByName(stars)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that links (a, b) reach; nodes without links are not listed.

    Each round takes the least root among neighbours and then the root's root,
    so paths halve; every round is a written table, and only its count of
    changes comes to the driver.  Roots only ever fall, so the rounds end.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
    while True:
        seen = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        step = roots.join(seen, "node").select("node", F.least("root", "low").alias("low"), "root")
        jump = roots.select(F.col("node").alias("low"), F.col("root").alias("over"))
        after = written(step.join(jump, "low", "left").select("node", F.least("low", "over").alias("root"), (F.least("low", "over") < F.col("root")).alias("moved")))
        moved = after.where("moved").limit(1).count()
        dropped(roots)
        roots = after.select("node", "root")
        if not moved:
            dropped(both)
            return roots


def near_duplicates(docs: DataFrame, size: int = 3, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links reach.

    Null and empty texts have fingerprint zero and link like any other.
    Repeated rows give repeated results.  A null doc_id stays null and never
    names a component unless all its ids are null.  An empty table gives no rows.
    """
    marks = written(fingerprints(docs, size))
    firsts = marks.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = fingerprint_links(marks.select("fp").distinct(), crowd)
    roots = components(links)
    grouped = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(names, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, size: int = 3, crowd: int = CROWD) -> DataFrame:
    """The rows of docs whose document stands first in its component, one for each.

    Of rows that repeat a doc_id one with the least text stays; rows with a null
    doc_id stay, as nothing tells which documents they are.
    """
    known = docs.where("doc_id is not null")
    heads = near_duplicates(known, size, crowd).where("doc_id = component_id").select("doc_id").distinct()
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = known.join(heads, known["doc_id"].cast("long") == heads["doc_id"], "left_semi").groupBy("doc_id").agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("_row"))
    return one.select("_row.*").unionByName(docs.where("doc_id is null"))
