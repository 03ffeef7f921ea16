"""Token ids of whole documents, by a public tokenizer.

The tokenizer's pattern never joins a character to a single space behind it, to
a line's end, or a letter to punctuation behind it, so a text may be cut there;
the ids of the cuts, joined, are the ids of the text.  Cuts are offsets into the
texts' bytes, so Arrow tells the distinct ones without an object for each, and
its take puts the ids of all texts together.  A worker remembers the ids of
parts, packed in Arrow arrays of bounded bytes; the tokenizers library encodes
the others, many at a time.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .shared import slices, texts

VOCABULARY = "byte_bpe_50k.json"
END = 0
#: Bytes of text that are told apart and encoded together; a longer text is a slice of its own.
SLICE_BYTES = 6 << 20
#: Bytes of distinct parts that the library encodes as one text.
JOINED = 1 << 14
#: Parts whose ids are put together at once.
TAKEN = 1 << 19
#: Bytes of parts and ids that a worker remembers, and the longest part that it does.
MEMORY_BYTES, REMEMBERED = 12 << 20, 32
PUNCTUATION = np.array([chr(b).isascii() and chr(b).isprintable() and not chr(b).isalnum() and b != 32 for b in range(256)])
LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=1)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=1)
def byte_lengths(path: str) -> np.ndarray:
    """Bytes of text that each id stands for (one character of a vocabulary entry is one byte)."""
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    own = np.zeros(max(vocabulary.values()) + 1, np.int64)
    own[list(vocabulary.values())] = [len(x) for x in vocabulary]
    return own


def id_type(path: str) -> type:
    """The narrowest type that holds all ids of the vocabulary."""
    return np.uint16 if len(byte_lengths(path)) <= 1 << 16 else np.uint32


def _space_like(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Whether bytes may begin a white-space character; true for a few others too, which costs a cut and nothing else."""
    ascii_ = ((first >= 9) & (first <= 13)) | ((first >= 28) & (first <= 32))
    two = (first == 0xC2) & ((second == 0x85) | (second == 0xA0))
    three = ((first == 0xE1) & (second == 0x9A)) | ((first == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((first == 0xE3) & (second == 0x80) & (third == 0x80))
    return ascii_ | two | three


def _follows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space may begin at each place."""
    last = len(data) - 1
    return _space_like(data[at], data[np.minimum(at + 1, last)], data[np.minimum(at + 2, last)])


def _precedes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space may end right before each place (which is above 0)."""
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    none = np.zeros_like(one)
    return ((one < 0x80) & _space_like(one, none, none)) | ((one >= 0x80) & (_space_like(two, one, none) | _space_like(three, two, one)))


def part_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the parts of texts start: data holds the texts' bytes, edges where each begins and the end."""
    n = len(data)
    mark, bound = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    bound[edges] = True
    # a space or a line's end between two other characters
    at = np.flatnonzero((data[1:-1] == 32) | (data[1:-1] == 10)) + 1
    at = at[~bound[at] & ~bound[at + 1]]
    at = at[~_follows(data, at + 1) & ~_precedes(data, at)]
    mark[at] = True
    mark[at[data[at] == 10] + 1] = True
    # punctuation behind a letter: ASCII, or one of the first two Latin blocks beyond it
    at = np.flatnonzero(PUNCTUATION[data[1:]]) + 1
    at = at[~bound[at]]
    one, two = data[at - 1], data[np.maximum(at - 2, 0)]
    mark[at[LETTER[one] | ((one >= 0x80) & (((two == 0xC3) & (one != 0x97) & (one != 0xB7)) | (two == 0xC4) | (two == 0xC5)))]] = True
    mark[edges] = True
    return np.flatnonzero(mark[:n])


def can_join(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which parts are one space, something else, and no white space at the end: those can stand behind each other in one text."""
    first, end = starts[:-1], starts[1:]
    out = (data[first] == 32) & (end - first > 1)
    at = np.flatnonzero(out)
    out[at] = ~_follows(data, first[at] + 1) & ~_precedes(data, end[at])
    return out


def encode_parts(data: np.ndarray, starts: np.ndarray, joins: int, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all parts in order, number of ids of each); starts: where each part begins and the end.

    The first `joins` parts are encoded as joined texts, whose ids the parts'
    lengths tell apart.
    """
    t, lengths, kind = tokenizer(path), byte_lengths(path), id_type(path)
    counts, ids = np.zeros(len(starts) - 1, np.int64), [np.zeros(0, kind)]
    view, at = data.tobytes(), starts.tolist()
    cuts = np.unique(np.searchsorted(starts[: joins + 1], np.arange(0, starts[joins] + JOINED, JOINED))).clip(max=joins).tolist() if joins else [0]
    groups = [(i, j) for i, j in zip(cuts, [*cuts[1:], joins]) if i < j] + [(i, i + 1) for i in range(joins, len(at) - 1)]
    for k in range(0, len(groups), 256):
        part = groups[k : k + 256]
        for (i, j), e in zip(part, t.encode_batch_fast([view[at[i] : at[j]].decode() for i, j in part], add_special_tokens=False)):
            own = np.array(e.ids, kind)
            ids.append(own)
            counts[i:j] = np.diff(np.searchsorted(np.cumsum(lengths[own]), starts[i : j + 1] - at[i], side="right")) if j - i > 1 else len(own)
    return np.concatenate(ids), counts


class Memory:
    """Parts whose ids are known, as packed arrays that grow up to MEMORY_BYTES."""

    def __init__(self, path: str):
        import pyarrow as pa

        self.path, self.parts = path, pa.array([], pa.large_binary())
        self.lists = pa.array([], pa.large_list(pa.from_numpy_dtype(id_type(path))))

    def ids_of(self, distinct):
        """(lists of ids, where each distinct part is among them); the last list is the end id."""
        import pyarrow as pa
        import pyarrow.compute as pc

        place = pc.index_in(distinct, value_set=self.parts)
        unknown = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        new = distinct.take(pa.array(unknown))
        joins = can_join(bytes_of(new), offsets_of(new))
        order = np.argsort(~joins, kind="stable")
        new, unknown = new.take(pa.array(order)), unknown[order]
        starts = offsets_of(new)
        flat, counts = encode_parts(bytes_of(new), starts, int(joins.sum()), self.path)
        # the end id is one more list
        fresh = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.append(counts, 1))), pa.int64()), pa.array(np.append(flat, id_type(self.path)(END))))
        lists = pa.concat_arrays([self.lists, fresh])
        at = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        at[unknown] = len(self.parts) + np.arange(len(new))
        if self.parts.nbytes + self.lists.nbytes < MEMORY_BYTES:
            short = pa.array(np.diff(starts) <= REMEMBERED)
            self.parts, self.lists = pa.concat_arrays([self.parts, new.filter(short)]), pa.concat_arrays([self.lists, fresh.slice(0, len(new)).filter(short)])
        return lists, at


@lru_cache(maxsize=1)
def memory(path: str) -> Memory:
    return Memory(path)


def offsets_of(column) -> np.ndarray:
    """Offsets of an array of large strings or binaries."""
    n = len(column)
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)


def bytes_of(column) -> np.ndarray:
    offsets = offsets_of(column)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def encode(column, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, lengths) of runs of the texts of an Arrow column without nulls; every text ends with END."""
    import pyarrow as pa

    n = len(column)
    column = column.cast(pa.large_string())
    data, edges = bytes_of(column), offsets_of(column) - offsets_of(column)[0]
    starts = part_starts(data, edges) if len(data) else np.zeros(0, np.int64)
    parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    lists, place = memory(path).ids_of(parts.dictionary)
    ends = np.searchsorted(starts, edges[1:])
    index = np.insert(place[parts.indices.to_numpy(zero_copy_only=False)], ends, len(lists) - 1)
    ends = ends + np.arange(1, n + 1)  # behind the end id of each text
    sizes = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())[index]))
    a = 0
    while a < n:
        begin = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, begin + TAKEN, side="right")))
        ids = lists.take(pa.array(index[begin : ends[b - 1]])).flatten().to_numpy(zero_copy_only=False)
        yield ids, np.diff(sizes[np.append(begin, ends[a:b])])
        a = b


def encoded(batches, path: str) -> Iterator[tuple]:
    """(rows of an Arrow batch, ids of each row's text with its end id), in slices of bounded bytes."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            at = 0
            for ids, lengths in encode(part.column("text"), path):
                own = np.split(ids, np.cumsum(lengths)[:-1])
                yield part.slice(at, len(own)), own
                at += len(own)


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids are zstd-packed integers of id_type, the end id included.

    Null text is empty and has the end id alone.  Repeated rows give repeated results.
    """
    path = path or vocabulary_path()

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for rows, ids in encoded(batches, path):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([pack(x.data) for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def unpacked(data: bytes, kind: type = np.uint16) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)
