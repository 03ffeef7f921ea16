"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each word shingle is hashed once; the top 7 bits choose one of 128 bins and the
least hash of a bin stands for it.  Empty bins are filled by optimal
densification: bin i takes the value of that filled bin j whose mix(i, j) is
least, which for every i is a random order of the bins that all documents share.
The low 8 bits of the 128 values are the fingerprint (256 hex digits); chance
agreement of low bits is taken out of the likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, let, shuffle_width

BINS, LOW_BITS, SHINGLE = 128, 8, 5
_SHIFT = 64 - 7
_TOP = (1 << _SHIFT) - 1


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _shingle_hashes(text: Column, size: int) -> Column:
    """XXH64 of each run of size word hashes; of the whole sequence if it is shorter; none without words."""

    def of(hashes: Column) -> Column:
        runs = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (size - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[hashes[i + k] for k in range(1, size)]))
        return F.when(F.size(hashes) >= size, runs).when(F.size(hashes) > 0, F.array(F.xxhash64(F.lit(0), hashes))).otherwise(F.array().cast("array<long>"))

    return let(F.transform(_words(text), lambda w: F.xxhash64(w)), of)


def _minima(hashes: Column) -> Column:
    """128 values in bin order: the least hash of a filled bin, or the bin's top value if it is empty.

    The top value of every bin joins the hashes, so the first of each bin in
    sorted order is its minimum and all bins are present.
    """
    tops = F.array(*[F.lit(((b - BINS // 2) << _SHIFT) | _TOP) for b in range(BINS)])
    ordered = F.sort_array(F.concat(hashes, tops))
    return let(ordered, lambda s: F.filter(s, lambda h, i: (i == 0) | (F.shiftright(h, _SHIFT) != F.shiftright(s[F.greatest(i - 1, F.lit(0))], _SHIFT))))


def _is_top(h: Column) -> Column:
    return h.bitwiseAND(F.lit(_TOP)) == _TOP


def _filled(minima: Column) -> Column:
    """Low bytes of all bins, the empty ones filled; null if no bin is filled."""
    mask = (1 << LOW_BITS) - 1

    def of(m: Column) -> Column:
        full = F.filter(m, lambda h: ~_is_top(h))

        def filled(donors: Column) -> Column:
            # the least mix decides; the donor's low bits ride in its last bits
            def best(i: Column) -> Column:
                return F.array_min(F.transform(donors, lambda h: F.xxhash64(i, F.shiftright(h, _SHIFT)).bitwiseAND(F.lit(~mask)).bitwiseOR(h.bitwiseAND(F.lit(mask)))))

            return F.transform(m, lambda h, i: F.when(_is_top(h), best(i)).otherwise(h).bitwiseAND(F.lit(mask)))

        return let(full, filled)

    return let(minima, of)


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """256 hex digits; without words all zero."""
    low = _filled(_minima(_shingle_hashes(text, size)))
    digits = F.array_join(F.transform(low, lambda v: F.lpad(F.lower(F.hex(F.coalesce(v, F.lit(0)))), LOW_BITS // 4, "0")), "")
    return digits


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints: the share of equal bytes, less what chance gives."""
    chance = 1.0 / (1 << LOW_BITS)
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * 2 + 1, F.lit(2)) == F.substring(b, i * 2 + 1, F.lit(2))))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), (same / float(BINS) - chance) / (1 - chance)))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, fingerprint) with the next row's text and fingerprint, ascending doc_id, the first after the last.

    Rows go to buckets of consecutive ids, whose edges are ids of the table; the
    first row of a bucket also visits the bucket before it (the first of all the
    last one), so one shuffle serves and no bucket holds more than its share.
    """
    spark = docs.sparkSession
    n = max(64, 4 * shuffle_width(spark))
    ids = docs.select("doc_id").where("doc_id is not null")
    found = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(n)], 100 * n).alias("q"), F.min("doc_id").alias("low")).first()
    if found["low"] is None:
        edges = []
    else:
        edges = sorted({found["low"], *found["q"]})
    # bucket: edges at or below the id; null ids stand before all others
    below = F.array(*[F.lit(e).cast("long") for e in edges]) if edges else F.array().cast("array<long>")
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(below, lambda e: e <= F.col("doc_id")))).cast("int")
    own = docs.withColumn("bucket", bucket).withColumn("guest", F.lit(0))
    heads = docs.where(F.col("doc_id").isin(edges)) if edges else docs.where("false")
    guests = heads.withColumn("bucket", bucket - 1).withColumn("guest", F.lit(1))
    last = len(edges)
    wrapped = docs.where((F.col("doc_id") == edges[0]) if edges else F.lit(True)).withColumn("bucket", F.lit(last)).withColumn("guest", F.lit(2))
    order = [F.col("guest"), F.col("doc_id").asc_nulls_first(), F.col("text")]
    window = Window.partitionBy("bucket").orderBy(*order)
    rows = own.unionByName(guests).unionByName(wrapped)
    ahead = rows.select("*", F.lead("text").over(window).alias("next_text"), F.lead("fingerprint").over(window).alias("next_fingerprint"))
    return ahead.where("guest = 0").drop("bucket", "guest")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likenesses to that and to the next document.

    The edited text has its last quarter replaced by the beginning of the next
    document.  Null text is empty.  Rows that repeat a doc_id stand in the order
    of their texts; rows with a null doc_id come first (only among themselves
    the last of them is followed by the first with an id, and the first with an
    id still follows the last).  A table of one row has itself as next.  An
    empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = base.withColumn("fingerprint", fingerprint(F.col("text"), size))
    pairs = with_next(marked).withColumn("n_chars", F.length("text").cast("long"))
    cut = (F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.coalesce("next_text", "text"), F.lit(1), cut))
    out = pairs.select("doc_id", "n_chars", "fingerprint", F.coalesce("next_fingerprint", "fingerprint").alias("next_fingerprint"), edited.alias("edited"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", fingerprint(F.col("edited"), size).alias("edited_fingerprint"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
