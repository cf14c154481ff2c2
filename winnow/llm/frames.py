"""Fill-in-the-middle over seekable compressed texts.

A text is stored as independent zstandard frames, each with the units and code
points up to its end.  Units are words with the white space before them, and the
white space at the end of a text.  A frame ends where a unit ends, but for those
inside a unit longer than a frame.  To cut after k units only the frame that
holds the k-th unit's end is decompressed; digests stream the frames in order.
So a text of any length takes its compressed bytes and one frame of memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.scan import SPACES, Words, blocks, fresh

#: bytes of text in a frame
FRAME = 64 << 10
LEVEL = 3
MARKS = (b"<P>", b"<S>", b"<M>")
FRAMES = "frames array<struct<units:long,chars:long,bytes:long,data:binary>>"


def _points(data: np.ndarray) -> int:
    """Code points that begin in the bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _cuts(data: np.ndarray, ends: np.ndarray, size: int) -> list[int]:
    """Ends of the frames of a text whose units end at ``ends``: at the last unit's end that fits, else inside the unit."""
    cuts, at = [], 0
    while at < len(data):
        to = at + size
        if to >= len(data):
            to = len(data)
        else:
            k = int(np.searchsorted(ends, to, side="right")) - 1
            if k >= 0 and ends[k] > at:
                to = int(ends[k])
            else:
                while data[to] & 0xC0 == 0x80:
                    to += 1
                    if to == len(data):
                        break
        cuts.append(to)
        at = to
    return cuts


def stored(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """The documents with n_units, marked (whether the text holds one of ``MARKS``) and frames in place of text.

    A frame has the units and code points that end in the text up to its end,
    its own bytes, and the compressed data; an empty or null text has none.
    Other columns are kept, those named like the new ones replaced.
    """
    others = [c for c in docs.columns if c not in ("text", "n_units", "marked", "frames")]
    fields = {f.name: f for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in others), "n_units long, marked boolean", FRAMES])
    names = [*others, "n_units", "marked", "frames"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress
        for batch in batches:
            for first, data, offsets in blocks(batch.column(len(others))):
                rows = len(offsets) - 1
                words = Words(data, offsets)
                last = np.maximum(offsets[1:] - 1, 0)
                tail = (np.diff(offsets) > 0) & (SPACES[data[last]] if len(data) else False)
                units, chars, sizes, packed, counts = [], [], [], [], np.zeros(rows, dtype=np.int64)
                marked = np.zeros(rows, dtype=bool)
                for r in range(rows):
                    a, b = int(offsets[r]), int(offsets[r + 1])
                    if a == b:
                        continue
                    text = data[a:b]
                    ends = words.ends[words.bounds[r] : words.bounds[r + 1]] - a
                    if tail[r]:
                        ends = np.append(ends, b - a)
                    raw = text.tobytes()
                    marked[r] = any(m in raw for m in MARKS)
                    at = total = 0
                    for to in [b - a] if b - a <= frame else _cuts(text, ends, frame):
                        total += _points(text[at:to])
                        units.append(int(np.searchsorted(ends, to, side="right")))
                        chars.append(total)
                        sizes.append(to - at)
                        packed.append(pack(raw[at:to]))
                        counts[r] += 1
                        at = to
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                inner = pa.StructArray.from_arrays([pa.array(units, pa.int64()), pa.array(chars, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["units", "chars", "bytes", "data"])
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], pa.array(words.counts + tail), pa.array(marked), pa.ListArray.from_arrays(pa.array(bounds), inner)], names)

    return docs.select(*others, F.col("text").alias(fresh(docs, "_text"))).mapInArrow(run, schema)


class Text:
    """A stored text: bytes by range and cuts by units, one decompressed frame at a time."""

    def __init__(self, frames: list[dict], unpack):
        self.frames, self.unpack, self.held = frames, unpack, (-1, b"")
        self.ends = np.cumsum([f["bytes"] for f in frames], dtype=np.int64)
        self.size = int(self.ends[-1]) if frames else 0

    def frame(self, i: int) -> bytes:
        if self.held[0] != i:
            self.held = i, self.unpack(self.frames[i]["data"])
        return self.held[1]

    def read(self, a: int, b: int) -> Iterator[bytes]:
        """The bytes from a to b, a frame at a time."""
        i = int(np.searchsorted(self.ends, a, side="right"))
        while a < b:
            begin = int(self.ends[i - 1]) if i else 0
            piece = self.frame(i)[a - begin : b - begin]
            yield piece
            a += len(piece)
            i += 1

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first k units."""
        if k <= 0:
            return 0, 0
        i = next(i for i, f in enumerate(self.frames) if f["units"] >= k) if len(self.frames) < 16 else int(np.searchsorted([f["units"] for f in self.frames], k))
        before = self.frames[i - 1]["units"] if i else 0
        begin, points = (int(self.ends[i - 1]), self.frames[i - 1]["chars"]) if i else (0, 0)
        if self.frames[i]["units"] == k:
            return int(self.ends[i]), self.frames[i]["chars"]
        data = np.frombuffer(self.frame(i), dtype=np.uint8)
        to = int(Words(data, np.array([0, len(data)])).ends[k - before - 1])
        return begin + to, points + _points(data[:to])


@dataclass
class Output:
    """A transformed text: literals and ranges of the stored text, read like one."""

    text: Text
    pieces: list

    def stream(self, a: int = 0, b: int | None = None) -> Iterator[bytes]:
        """The bytes from a to b."""
        at = 0
        for p in self.pieces:
            n = len(p) if isinstance(p, bytes) else p[1] - p[0]
            lo, hi = max(a - at, 0), n if b is None else min(b - at, n)
            if lo < hi:
                if isinstance(p, bytes):
                    yield p[lo:hi]
                else:
                    yield from self.text.read(p[0] + lo, p[0] + hi)
            at += n

    def marks(self) -> tuple[dict[bytes, int], int]:
        """Where the markers stand in the bytes of the output, and its length."""
        found, at, rest = {}, 0, b""
        for piece in self.stream():
            seen = rest + piece
            for m in MARKS:
                k = seen.find(m)
                if k >= 0:
                    found.setdefault(m, at - len(rest) + k)
            at += len(piece)
            rest = seen[-2:]
        return found, at


def arranged(text: Text, form: str, a: int, b: int) -> Output:
    prefix, middle, suffix = (0, a), (a, b), (b, text.size)
    if form == "psm":
        return Output(text, [MARKS[0], prefix, MARKS[1], suffix, MARKS[2], middle])
    if form == "spm":
        return Output(text, [MARKS[1], suffix, MARKS[0], prefix, MARKS[2], middle])
    return Output(text, [(0, text.size)])


def restored(output: Output, form: str) -> Iterator[bytes]:
    """The original text from an output and its form alone, by the places of the markers."""
    if form == "plain":
        yield from output.stream()
        return
    at, size = output.marks()
    ends = sorted([*at.values(), size])
    for m in (MARKS[0], MARKS[2], MARKS[1]):
        yield from output.stream(at[m] + 3, ends[ends.index(at[m]) + 1])


def _digest(pieces: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p)
    return h.hexdigest()


def draws(seed: int = 42, column: str = "doc_id") -> Column:
    """Four numbers of 32 bits from the seed and the decimal id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def transformed(framed: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, texts: bool = False) -> DataFrame:
    """Fill-in-the-middle of stored texts (from ``stored``).

    Returns doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars,
    output_sha256, restored_sha256 and, if ``texts``, output.  Cuts are after
    units drawn from the id, so rows of one id are cut by the same draws and all
    rows without one as if their id were the empty text.  A text that is empty or holds a marker is
    plain, and so are ``100 - rate`` of 100 others; of the rest ``spm`` of 100 begin with the suffix.  Every row gives one
    row, whatever its other columns hold; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for i, n, marked, h, frames in zip(*(batch.column(k).to_pylist() if k < 4 else batch.column(k) for k in range(5))):
                text = Text(frames.as_py(), reader.decompress)
                form = "plain" if not text.size or marked or h[2] % 100 >= rate else "spm" if h[3] % 100 < spm else "psm"
                k1, k2 = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                (a, p), (b, q) = (text.cut(k1), text.cut(k2)) if form != "plain" else ((0, 0), (0, 0))
                output = arranged(text, form, a, b)
                cut = form != "plain"
                values = [i, n, form, p if cut else None, q - p if cut else None, _digest(output.stream()), _digest(restored(output, form))]
                for column, v in zip(out, [*values, b"".join(output.stream()).decode()] if texts else values):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out[1:], types[1:]))], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *["output"] * texts]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * (2 + texts)]
    kind = framed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * texts
    return framed.select("doc_id", "n_units", "marked", draws(seed).alias("draws"), "frames").mapInArrow(run, schema)


#: the same in DuckDB's SQL
FIM_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
c AS (SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
    WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(list_slice(u, 1, least(a, b)), ''), '') AS pre, coalesce(array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), ''), '') AS mid, coalesce(array_to_string(list_slice(u, greatest(a, b) + 1, n), ''), '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(output, 4, strpos(output, '<S>') - 4) || substr(output, strpos(output, '<M>') + 3) || substr(output, strpos(output, '<S>') + 3, strpos(output, '<M>') - strpos(output, '<S>') - 3)
    ELSE substr(output, strpos(output, '<P>') + 3, strpos(output, '<M>') - strpos(output, '<P>') - 3) || substr(output, strpos(output, '<M>') + 3) || substr(output, 4, strpos(output, '<P>') - 4) END) AS restored_sha256
FROM o"""
