"""Language-model scores from a log-frequency Bloom filter.

Texts become packed blocks of tokens.  The words and word pairs of a block go to
hash shards, with their counts in the training documents (zero if none).  A shard
merges the counts, quantises them on a logarithmic scale, and puts them into its
segment of a Bloom filter: level l of an n-gram is held by l members (n-gram,
1..l), so repeated membership probes read it back.  The shard probes its segment
for every n-gram asked for, and the levels go back to the blocks.

Segments are sized by their members, and the number of shards grows with the
text; no filter is broadcast or sent to the driver, so nothing bounds what the
model keeps: every word and every pair, also those seen once.

Probability: absolute discounting.  A stored pair gets its discounted share of
its first word, and the mass that the stored pairs of that word leave goes to
the smoothed word distribution.  How much they take is held, quantised upwards,
in a second filter, beside the first word's shard.

The base score needs exact counts; they come back with the levels.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import BITS_EACH, Filter, U, bloom_add, members_of, merged, mix, packed, shard_of, unpacked
from .shared import slices, texts, written

LOWER = bytes(range(256)).lower()
#: The end of a document; no word holds a space.
END_WORD = b" end"
DISCOUNT = 0.75
#: Tokens that a task gathers before it merges equal ones and passes them on.
FLUSH = 1_500_000
#: Bytes of text that are split into words at once.
SLICE_BYTES = 4 << 20
#: Characters of text for each shard, about.
SHARD_CHARS = 3_000_000


def thresholds(least: int) -> np.ndarray:
    """Counts at which the levels start: single counts up to 4, then steps of the square root of 2."""
    steps = [1, 2, 3, 4] + [round(4 * 2 ** (i / 2)) for i in range(1, 80)]
    return np.array([x for x in steps if x >= least], np.int64)


def middle(least: int) -> np.ndarray:
    """Count that a level stands for; 0 for level 0."""
    t = thresholds(least).astype(np.float64)
    return np.concatenate([[0.0], np.sqrt(t * np.append(t[1:] - 1, t[-1]))])


def pairs_of(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, spread): the first word's upper 32 bits, which name its shard, and 32 of the pair; spread deals pairs to shards."""
    with np.errstate(over="ignore"):
        x = mix(first ^ (second * U(0x9E3779B97F4A7C15)))
    return (first >> U(32) << U(32)) | (x & U(0xFFFFFFFF)), x


def hashed(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: hashes of their distinct words, the tokens as indexes into them, and the tokens of each text (its end is index 0)."""
    index: dict[bytes, int] = {END_WORD: 0}
    tokens, sizes = [], []
    put = index.setdefault
    for text in batch:
        words = text.translate(LOWER).split()
        tokens.extend([put(w, len(index)) for w in words])
        tokens.append(0)
        sizes.append(len(words) + 1)
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index)), np.array(tokens, np.int64), np.array(sizes, np.int64)


def first_words(tokens: np.ndarray) -> np.ndarray:
    """The token before each one; before the first of a text stands the end, the last token of all."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]  # behind another text's end the token before is that end
    before[:1] = tokens[-1:]
    return before


def blocks_of(docs: DataFrame, train: Column | None) -> DataFrame:
    """(block, n_bytes, doc_ids, learned, sizes, words, tokens): packed texts of what a task read, some tokens at a time.

    words: hashes of the distinct words in order; tokens: indexes into them.
    """

    def run(batches):
        import pyarrow as pa

        block = TaskContext.get().partitionId() << 40
        ids, learned, parts = [], [], []
        size = n_bytes = 0

        def row():
            words, at = np.unique(np.concatenate([h for h, _, _ in parts]), return_inverse=True)
            edges = np.cumsum([0] + [len(h) for h, _, _ in parts])
            tokens = np.concatenate([at[a:][t] for a, (_, t, _) in zip(edges, parts)]).astype(np.uint32)
            values = [block, n_bytes, ids, packed(np.concatenate(learned)), packed(np.concatenate([s for _, _, s in parts])), packed(words), packed(tokens)]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["block", "n_bytes", "doc_ids", "learned", "sizes", "words", "tokens"])

        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                part = rows.column("text").cast(pa.binary()).to_pylist()
                parts.append(hashed(part))
                ids.extend(rows.column("doc_id").to_pylist())
                learned.append(rows.column("learned").to_numpy(zero_copy_only=False).astype(np.uint8))
                n_bytes += sum(map(len, part))
                size += len(parts[-1][1])
                if size >= FLUSH:
                    yield row()
                    ids, learned, parts, size, n_bytes, block = [], [], [], 0, 0, block + 1
        if size:
            yield row()

    flag = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    return texts(docs, flag.alias("learned")).mapInArrow(run, "block long, n_bytes long, doc_ids array<long>, learned binary, sizes binary, words binary, tokens binary")


def block_pairs(words: np.ndarray, tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the distinct pairs by shard, their shards, the pair of each token and the one before it)."""
    key, spread = pairs_of(words[first_words(tokens)], words[tokens])
    shard = shard_of(spread, bits)
    del spread
    order = np.lexsort((key, shard)) if bits else np.argsort(key)
    key, shard = key[order], shard[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return key[new], shard[new], number


def dealt(shards: np.ndarray, bits: int):
    """(shard, slice) of each shard that has rows; shards are in order."""
    edges = np.searchsorted(shards, np.arange((1 << bits) + 1))
    for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield s, slice(edges[s], edges[s + 1])


REQUEST = "shard long, block long, keys binary, counts binary"


def requests(blocks: DataFrame, bits: int, of_pairs: bool) -> DataFrame:
    """REQUEST rows: the distinct words or pairs of each block, and how often its training documents hold them."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                words, tokens = unpacked(r["words"], np.uint64), unpacked(r["tokens"], np.uint32)
                learned = np.repeat(unpacked(r["learned"], np.uint8), unpacked(r["sizes"], np.int64)) > 0
                keys, shards, number = block_pairs(words, tokens, bits) if of_pairs else (words, shard_of(words, bits), tokens)
                counts = np.bincount(number[learned], minlength=len(keys))
                rows = [(s, r["block"], packed(keys[at]), packed(counts[at])) for s, at in dealt(shards, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 2 + [pa.binary()] * 2)], ["shard", "block", "keys", "counts"])

    return blocks.select("block", "learned", "sizes", "words", "tokens").mapInArrow(run, REQUEST)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of their counts, and where each key is among them."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64), at


def filled(grams: np.ndarray, levels: np.ndarray) -> Filter:
    """One segment of a log-frequency Bloom filter, with BITS_EACH bits for each of its members."""
    size = max(64, -(-BITS_EACH * int(levels.sum()) // 64) * 64)
    bits = np.zeros(size // 8, np.uint8)
    bloom_add(bits, size, members_of(grams, levels))
    return Filter(bits, 0, size)


def probed(f: Filter, grams: np.ndarray) -> np.ndarray:
    return f.levels(grams, np.zeros(len(grams), np.int64)).astype(np.uint8)


def made(rows: list[tuple], schema: str):
    """A table of rows in a schema of longs, doubles and binaries."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(fields)})


def split(values: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(x) for x in parts])[:-1])


PAIRS = "block long, shard long, levels binary, firsts binary, masses binary"


def answer_pairs(table):
    """Levels of the pairs of each block in one shard; its first row holds what the shard's pairs take from their first words."""
    keys, counts = [[unpacked(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("keys", np.uint64), ("counts", np.int64))]
    pairs, m, at = summed(keys, counts)
    levels = np.searchsorted(thresholds(1), m, "right")
    got = probed(filled(mix(pairs), levels), mix(pairs))[at]
    stored = m > 0
    firsts, mass = merged(pairs[stored] >> U(32), middle(1)[levels[stored]] - DISCOUNT)
    shard = table.column("shard")[0].as_py()
    taken = [(packed(firsts), packed(mass))] + [(None, None)] * (len(keys) - 1)
    return made([(b, shard, packed(x), *t) for b, x, t in zip(table.column("block").to_pylist(), split(got, keys), taken)], PAIRS)


def masses_of(pairs: DataFrame, bits: int) -> DataFrame:
    """(shard, firsts, masses): what pairs take from first words, by the first word's shard; summed in tasks."""

    def run(batches):
        import pyarrow as pa

        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def rows():
            firsts, mass = merged(np.concatenate(held[0]), np.concatenate(held[1]))
            out = [(s, packed(firsts[at]), packed(mass[at])) for s, at in dealt(shard_of(firsts << U(32), bits), bits)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate([pa.int64(), pa.binary(), pa.binary()])], ["shard", "firsts", "masses"])

        for batch in batches:
            for r in batch.to_pylist():
                held[0].append(unpacked(r["firsts"], np.uint64))
                held[1].append(unpacked(r["masses"], np.float64))
                size += len(held[0][-1])
                if size >= FLUSH:
                    yield rows()
                    held, size = [[], []], 0
        if size:
            yield rows()

    return pairs.where("firsts is not null").select("firsts", "masses").mapInArrow(run, "shard long, firsts binary, masses binary")


WORDS = "block long, shard long, counts binary, levels binary, masses binary, n_tokens long, n_words long, total double"


def answer_words(table):
    """Counts, levels and mass levels of the words of each block in one shard; its first row holds the shard's sums."""
    asked = [r for r in table.to_pylist() if r["block"] is not None]
    taken = [r for r in table.to_pylist() if r["block"] is None]
    keys = [unpacked(r["keys"], np.uint64) for r in asked]
    words, n, at = summed(keys, [unpacked(r["counts"], np.int64) for r in asked])
    levels = np.searchsorted(thresholds(1), n, "right")
    got = probed(filled(words, levels), words)[at]
    firsts, mass = merged(np.concatenate([np.zeros(0, np.uint64)] + [unpacked(r["firsts"], np.uint64) for r in taken]), np.concatenate([np.zeros(0)] + [unpacked(r["masses"], np.float64) for r in taken]))
    # upwards: the least level whose count is no less than the mass
    mass_levels = np.searchsorted(thresholds(1), mass, "left") + 1
    mass_got = probed(filled(mix(firsts), mass_levels), mix(words >> U(32)))[at]
    shard = table.column("shard")[0].as_py()
    sums = [(int(n.sum()), int((n > 0).sum()), float(middle(1)[levels].sum()))] + [(0, 0, 0.0)] * (len(keys) - 1)
    rows = zip(asked, split(n[at], keys), split(got, keys), split(mass_got, keys), sums)
    return made([(r["block"], shard, packed(c), packed(x), packed(y), *z) for r, c, x, y, z in rows], WORDS)


def log_probabilities(n_words: int, total: float, tokens: np.ndarray, levels: np.ndarray, mass_levels: np.ndarray, pair_levels: np.ndarray) -> np.ndarray:
    """log10 probability of each token after the one before it; levels and mass_levels by word, pair_levels by token."""
    count = middle(1)[levels]
    word_p = (count + 0.5) / (total + 0.5 * (n_words + 1))
    mass = np.append(0, thresholds(1))[np.minimum(mass_levels, len(thresholds(1)))].astype(np.float64)
    # where quantised counts contradict each other, the first word's count gives way
    context = np.maximum(np.maximum(count, mass * 16 / 15), 1.0)
    left = 1 - mass / context
    before = first_words(tokens)
    # without mass no pair of the word is stored
    pair = np.where(mass[before] > 0, np.maximum(middle(1)[pair_levels] - DISCOUNT, 0), 0)
    return np.log10(np.minimum(pair / context[before] + left[before] * word_p[tokens], 1.0))


def score(docs: DataFrame, train: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document.

    train: condition on doc_id for documents to learn from.  Null text is empty
    (its end is its one token).  Repeated rows are scored each, and learned from
    each; a null doc_id stays null.  With nothing to learn from all counts are
    zero.  An empty table gives no rows; other columns are ignored.
    """
    blocks = written(blocks_of(docs, train))
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, n_bytes / SHARD_CHARS))))
    pairs = written(requests(blocks, bits, True).groupBy("shard").applyInArrow(answer_pairs, PAIRS))
    asked = requests(blocks, bits, False).unionByName(masses_of(pairs, bits), allowMissingColumns=True)
    words = written(asked.groupBy("shard").applyInArrow(answer_words, WORDS))
    sums = words.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum("total")).first()
    n_tokens, n_words, total = sums[0] or 0, sums[1] or 0, sums[2] or 0.0
    unit = math.log10(n_tokens + 0.5 * (n_words + 1))
    fields = "doc_id long, n_tokens long, n_known long, base_score double, score double"

    def run(block, answers):
        import pyarrow as pa

        words, tokens, sizes = [unpacked(block.column(c)[0].as_py(), k) for c, k in (("words", np.uint64), ("tokens", np.uint32), ("sizes", np.int64))]
        rows = sorted(answers.to_pylist(), key=lambda r: r["shard"])
        of_pairs = np.concatenate([unpacked(r["levels"], np.uint8) for r in rows if r["counts"] is None])
        own = [r for r in rows if r["counts"] is not None]
        counts, levels, masses = [np.concatenate([unpacked(r[c], k) for r in own]) for c, k in (("counts", np.int64), ("levels", np.uint8), ("masses", np.uint8))]
        pair_levels = of_pairs[block_pairs(words, tokens, bits)[2]]
        logs = log_probabilities(n_words, total, tokens, levels, masses, pair_levels)
        starts = np.cumsum(sizes) - sizes
        values = [sizes, np.add.reduceat((counts > 0)[tokens], starts, dtype=np.int64), np.add.reduceat(np.log10(counts + 0.5)[tokens], starts) - sizes * unit, np.add.reduceat(logs, starts)]
        return pa.table([block.column("doc_ids").combine_chunks().flatten(), *map(pa.array, values)], names=[x.split()[0] for x in fields.split(", ")])

    none = F.lit(None).cast("binary")
    answers = pairs.select("block", "shard", "levels", none.alias("counts"), none.alias("masses")).unionByName(words.select("block", "shard", "levels", "counts", "masses"))
    kept = blocks.select("block", "doc_ids", "sizes", "words", "tokens")
    scored = kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, fields)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
