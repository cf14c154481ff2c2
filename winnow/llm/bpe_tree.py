"""Byte-level BPE as a tree reduction over a monoid of token sequences.

Every match of the split pattern is encoded by itself.  Its two halves are
encoded recursively and joined: the tokens of a window around the boundary are
encoded anew, and the window doubles until the tokens beside it are stable.  A
sequence is the BPE encoding of its bytes exactly if every two neighbours
encode to themselves, so checking the two pairs at the window's rims proves
that nothing outside can change.  Joining is associative; a text of one word
without a blank costs n log n.

A block of texts is worked on at once: its matches are spans, of which each
distinct one is looked up once by a hash in a sorted memory and only new ones go
through the tree.  Ids and their bytes are then gathered from tables, so the
decoded block is joined level by level: tokens to matches, matches to texts.  It
is compared with the block itself, which also proves that no two matches were
taken for one.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.scan import Spans, blocks, mix, release

#: entries of one generation of a memory: of byte strings (some 3 MB each), and of matches (some 5 MB)
REMEMBERED, REMEMBERED_MATCHES = 20_000, 1 << 17
#: longest byte strings remembered inside the tree, as nodes and as windows
REMEMBERED_BYTES, REMEMBERED_WINDOW = 4, 12
_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


class Recent(dict):
    """key -> ``make(key)``, in two generations: a full one becomes the old one, from which what is met again comes back."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class TreeEncoder:
    """Encoder and decoder of single matches for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._windows, self._halves = Recent(self._merge), Recent(self._joined)
        self._stable = Recent(lambda pair: self.merge(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == pair)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Plain merging by lowest rank, leftmost first; for windows."""
        if len(data) <= REMEMBERED_WINDOW:
            return self._windows[data]
        return self._merge_by_heap(data) if len(data) > 64 else self._merge(data)

    def _merge(self, data: bytes) -> tuple[int, ...]:
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_by_heap(self, data: bytes) -> tuple[int, ...]:
        """The same for windows that had to grow long: pairs wait in a heap by (rank, place)."""
        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))  # of the token that starts here; 0 where none does
        before = list(range(-1, n))  # start of the token that ends here

        def pair(i: int) -> tuple[int, int, int] | None:
            j = end[i]
            rank = ranks.get(data[i : end[j]]) if j < n else None
            return None if rank is None else (rank, i, end[j])

        waiting = [x for x in map(pair, range(n - 1)) if x]
        heapify(waiting)
        while waiting:
            _, i, to = heappop(waiting)
            j = end[i]
            if not j or j >= n or end[j] != to:
                continue  # one of the two has been merged since
            end[j], end[i], before[to] = 0, to, i
            for x in (pair(i), pair(before[i]) if i else None):
                if x:
                    heappush(waiting, x)
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side encode to themselves."""
        return self._stable[a, b]

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left or right
        stable = self._stable
        if stable[left[-1], right[0]]:
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            middle = self.merge(b"".join([self.bytes_of[i] for i in left[a:] + right[:b]]))
            if (a == 0 or stable[left[a - 1], middle[0]]) and (b == len(right) or stable[middle[-1], right[b]]):
                return left[:a] + middle + right[b:]
            width *= 2

    def _reduce(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= 2:
            return self._windows[data]
        return self._halves[data] if len(data) <= REMEMBERED_BYTES else self._joined(data)

    def _joined(self, data: bytes) -> tuple[int, ...]:
        """Both halves, joined; the left one is the largest power of two below, so that words of one beginning share it."""
        half = 1 << ((len(data) - 1).bit_length() - 1)
        return self.join(self._reduce(data[:half]), self._reduce(data[half:]))

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The token ids of one match, as the library gives them: a match that is a token stays whole."""
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self._reduce(data)

    def decode(self, ids: tuple[int, ...]) -> bytes:
        """The bytes of the ids, joined up a tree."""
        parts = [self.bytes_of[i] for i in ids]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 16]) for i in range(0, len(parts), 16)]
        return parts[0] if parts else b""


class _Generation:
    """Sorted hashes of matches, and where their ids lie in ``flat``."""

    def __init__(self, hashes, first, counts, flat):
        self.hashes, self.first, self.counts, self.flat = hashes, first, counts, flat

    @classmethod
    def empty(cls) -> _Generation:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 for those that are not here."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def with_more(self, hashes: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> _Generation:
        first = np.concatenate([self.first, np.cumsum(counts) - counts + len(self.flat)])
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        return _Generation(hashes[order], first[order], np.concatenate([self.counts, counts])[order], np.concatenate([self.flat, flat]))


def _gather(flat: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges flat[first[i]:first[i] + counts[i]]."""
    ends = np.cumsum(counts)
    return flat[np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


class Coder:
    """Encodes blocks of texts with one table of ranks; remembers the matches met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tree, self.pattern = TreeEncoder(ranks), regex.compile(pattern)
        size = max(ranks.values()) + 1
        tokens = [self.tree.bytes_of.get(i, b"") for i in range(size)]
        self.tokens = pa.array(tokens, pa.large_binary())
        self.decimals = pa.array([f"{i},".encode() for i in range(size)], pa.large_binary())
        self.new, self.old = _Generation.empty(), _Generation.empty()

    def spans(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (bytes) of the matches of a block, and their number per text."""
        starts, ends, counts = [], [], np.zeros(len(texts), dtype=np.int64)
        ascii_only = not len(data) or data.max() < 128
        points = None if ascii_only else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        at = 0
        for r, text in enumerate(texts):
            to = np.cumsum(np.fromiter(map(len, self.pattern.findall(text)), dtype=np.int64))
            if len(to) and to[-1] == len(text):
                starts.append(np.concatenate([[0], to[:-1]]) + at)
                ends.append(to + at)
                counts[r] = len(to)
            elif text:  # a pattern that leaves something out
                found = np.array([m.span() for m in self.pattern.finditer(text)], dtype=np.int64).reshape(-1, 2) + at
                starts.append(found[:, 0])
                ends.append(found[:, 1])
                counts[r] = len(found)
            at += len(text)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, ends))
        return (a, b, counts) if ascii_only else (points[a], points[b], counts)

    def remembered(self, hashes: np.ndarray, match: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, number) of distinct matches by hash; ``match(k)`` are the bytes of the k-th."""
        at = self.new.find(hashes)
        old = np.where(at < 0, self.old.find(hashes), -1)
        fresh = np.flatnonzero((at < 0) & (old < 0))
        encoded = [self.tree.encode(match(k)) for k in fresh.tolist()]
        back = np.flatnonzero(old >= 0)
        counts = np.concatenate([self.old.counts[old[back]], np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))])
        flat = np.concatenate([_gather(self.old.flat, self.old.first[old[back]], self.old.counts[old[back]]), np.fromiter(chain.from_iterable(encoded), dtype=np.int32)])
        if len(self.new.hashes) >= REMEMBERED_MATCHES:
            seen = np.flatnonzero(at >= 0)
            held = self.new
            self.old, self.new = held, _Generation.empty()
            ids = _gather(held.flat, held.first[at[seen]], held.counts[at[seen]])
            counts, flat = np.concatenate([held.counts[at[seen]], counts]), np.concatenate([ids, flat])
            self.new = self.new.with_more(hashes[np.concatenate([seen, back, fresh])], counts, flat)
        elif len(counts):
            self.new = self.new.with_more(hashes[np.concatenate([back, fresh])], counts, flat)
        at = self.new.find(hashes)
        return self.new.flat, self.new.first[at], self.new.counts[at]

    def encode(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(ids of a block, where each text's begin, bytes of each id)."""
        starts, ends, counts = self.spans(texts, data, offsets)
        hashes = Spans(_BYTES[data]).hashes(starts, ends)
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        flat, first, number = self.remembered(hashes[one], lambda k: data[starts[one[k]] : ends[one[k]]].tobytes())
        ids = _gather(flat, first[which], number[which])
        decoded = self.tokens.take(pa.array(ids))
        covered = data if int((ends - starts).sum()) == len(data) else _gather(data, starts, ends - starts)
        if not np.array_equal(_raw(decoded), covered):  # two matches of one hash: each by itself
            each = [self.tree.encode(data[a:b].tobytes()) for a, b in zip(starts, ends)]
            ids, per = np.fromiter(chain.from_iterable(each), dtype=np.int32), np.fromiter(map(len, each), dtype=np.int64)
            decoded = self.tokens.take(pa.array(ids))
        else:
            per = number[which]
        bounds = np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, bounds, decoded


def _raw(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column, one value after the other."""
    offsets = _offsets(column)
    raw = column.buffers()[2]
    return np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]


def _digests(column: pa.Array, bounds: np.ndarray, cut: int = 0) -> list[str]:
    """sha256 of every row's values joined, without the last ``cut`` bytes where there are any."""
    raw, at = memoryview(_raw(column)), (_offsets(column) - _offsets(column)[0])[bounds].tolist()
    return [hashlib.sha256(raw[a : max(a, b - cut)]).hexdigest() for a, b in zip(at[:-1], at[1:])]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", ids: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns the id column, n_tokens, ids (array of int, unless ``ids`` is
    false), ids_sha256 of the decimal ids joined by commas, decoded_sha256 of
    the decoded bytes.  A null text is an empty one: no tokens.  Rows are
    independent, so repeated and null ids are kept as they are; other columns
    are ignored; an empty table gives an empty one.  Texts may be of any length:
    one longer than a block is a block, in memory that grows with it.  The ranks
    (a fixed vocabulary file) go to the workers in one broadcast.
    """
    table = load_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the memories live as long as the task: a worker serves other stages afterwards
        coder = Coder(shared.value, pattern)
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                part = batch.slice(first, len(offsets) - 1)
                flat, bounds, decoded = coder.encode([t or "" for t in part.column(1).to_pylist()], data, offsets)
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))] * ids
                written = _digests(coder.decimals.take(pa.array(flat)), bounds, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), *lists, pa.array(written, pa.string()), pa.array(_digests(decoded, bounds), pa.string())], names)
        del coder
        gc.collect()
        release()

    kind = docs.schema[id_column].dataType.simpleString()
    names = [id_column, "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256"]
    schema = f"`{id_column}` {kind}, n_tokens long, " + "ids array<int>, " * ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_column), F.col(text_column).alias("_text")).mapInArrow(run, schema)
