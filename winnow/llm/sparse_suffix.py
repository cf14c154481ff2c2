"""Repeated passages by sparse suffixes.

Of all suffixes of a text only those are retained that begin at a minimiser: the
least of the ``PHRASE``-word phrases in any ``LEAST`` consecutive words, chosen
by content alone.  So two equal passages of ``LEAST`` words retain the same
suffix.  Spark sorts the suffixes by their first phrase; neighbours that agree
are matches, which are then extended left and right: a suffix carries its run,
all windows of ``LEAST`` words of which it is the minimiser, and runs of one
phrase are compared whole first and then, only where their ends differ, window
by window.  A passage is repeated where each of its windows occurs again,
anywhere.

Counts are combined before every shuffle, so a passage that a third of all
documents share reaches its reducer as one row per task.  Equal texts are one
node, named by its smallest doc_id and two hashes of the text, so rows of one
doc_id with different texts are different nodes; its copies are repeated as a
whole.  Words are runs of other than ASCII
white space, without regard to case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.scan import Spans, Words, blocks, fresh, mix, ngrams, release, staged

LEAST = 50
PHRASE = 25
_ORDER = np.uint64(0x6A09E667F3BCC909)
#: a text: its first document and two hashes, in the order of "earlier"
NODE = "struct<doc:long,h1:long,h2:long>"


def _runs(grams: np.ndarray, sizes: np.ndarray, least: int, phrase: int) -> tuple[np.ndarray, ...]:
    """Row, place of the minimiser, first window and number of windows of every run, places counted in the row's words."""
    width = least - phrase + 1
    if len(grams) < width:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    starts = np.cumsum(sizes) - sizes
    rows = np.repeat(np.arange(len(sizes)), sizes)
    order = mix(grams ^ _ORDER)
    view = np.lib.stride_tricks.sliding_window_view(order, width)
    valid = np.flatnonzero(rows[: len(view)] == rows[width - 1 :])
    best = valid + np.concatenate([view[valid[at : at + 65_536]].argmin(axis=1) for at in range(0, len(valid), 65_536)] or [np.zeros(0, dtype=np.int64)])
    change = np.ones(len(valid), dtype=bool)
    change[1:] = (best[1:] != best[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(change)
    row = rows[valid[first]]
    return row, best[first] - starts[row], valid[first] - starts[row], np.diff(np.append(first, len(valid)))


def _suffixes(docs: DataFrame, least: int, phrase: int) -> DataFrame:
    """key, n_words and the first phrases of the retained suffixes of every row (_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1), fold=True):
                words = Words(data, offsets)
                grams, sizes = ngrams(words.hashes(), words.counts, phrase, short=False)
                row, place, _, _ = _runs(grams, sizes, least, phrase)
                found = grams[(np.cumsum(sizes) - sizes)[row] + place] if len(row) else np.zeros(0, dtype=np.uint64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=words.rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, words.rows), pa.array(words.counts), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int64)))], ["key", "n_words", "phrases"])
        release()

    return docs.select("_key", "text").mapInArrow(run, f"key {NODE}, n_words long, phrases array<long>")


def _windows(matched: DataFrame, least: int, phrase: int) -> DataFrame:
    """The runs of the suffixes whose first phrase is repeated: hashes of the whole run and of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(2), fold=True):
                words = Words(data, offsets)
                hashes = words.hashes()
                grams, sizes = ngrams(hashes, words.counts, phrase, short=False)
                row, place, begin, n = _runs(grams, sizes, least, phrase)
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                wanted = batch.column(1).slice(first, words.rows)
                lists = wanted.value_lengths().to_numpy()
                keep = np.isin(row << 32 | nth, np.repeat(np.arange(words.rows), lists) << 32 | wanted.flatten().to_numpy().astype(np.int64))
                row, place, begin, n = row[keep], place[keep], begin[keep], n[keep]
                spans, at = Spans(hashes), words.bounds[row]
                ends = np.cumsum(n)
                each = np.repeat(at + begin, n) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
                windows = spans.hashes(each, each + least) if len(each) else np.zeros(0, dtype=np.uint64)
                whole = spans.hashes(at + begin, at + begin + n - 1 + least) if len(row) else np.zeros(0, dtype=np.uint64)
                phrases = grams[(np.cumsum(sizes) - sizes)[row] + place] if len(row) else np.zeros(0, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, words.rows).take(pa.array(row)),
                        pa.array(phrases.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                        pa.array(begin),
                        pa.array((place - begin).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(windows.view(np.int64))),
                    ],
                    ["key", "phrase", "whole", "begin", "left", "windows"],
                )

        release()

    return matched.select("_key", "wanted", "text").mapInArrow(run, f"key {NODE}, phrase long, whole long, begin long, left int, windows array<long>")


def _spans(marks: DataFrame, least: int) -> DataFrame:
    """key, spans (start, end, removable words) from the marked runs of a text; ``cuts`` are the spans to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], []]
            for n, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                covered, later = np.zeros(n + 1, dtype=np.int32), np.zeros(n + 1, dtype=np.int32)
                for r in runs:
                    for k in range(r["n"]):
                        bit = 1 << (r["left"] - k)
                        for mask, into in ((r["again"], covered), (r["later"], later)):
                            if mask & bit:
                                into[r["begin"] + k] += 1
                                into[r["begin"] + k + least] -= 1
                covered, later = np.cumsum(covered) > 0, np.cumsum(later) > 0
                out[0].append([{"start": a, "end": b, "removable": int(later[a:b].sum())} for a, b in _true(covered)])
                out[1].append([{"start": a, "end": b} for a, b in _true(later)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], spans), pa.array(out[1], cuts)], ["key", "spans", "cuts"])

    pair = [("start", pa.int64()), ("end", pa.int64())]
    spans, cuts = pa.list_(pa.struct([*pair, ("removable", pa.int64())])), pa.list_(pa.struct(pair))
    return marks.mapInArrow(run, f"key {NODE}, spans array<struct<start:long,end:long,removable:long>>, cuts array<struct<start:long,end:long>>")


def _true(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def _repeats(keyed: DataFrame, least: int, phrase: int) -> tuple[DataFrame, DataFrame]:
    """(key, twin, n_words, copies) of all documents, and (key, spans, cuts) of one of each equal texts, the twin.

    ``keyed`` has _key (``NODE``: the row's own document and its text's hashes) and text; equal rows are one document.
    """
    if least - phrase + 1 > 62:
        raise ValueError("a run's windows are bits of one number: take a longer phrase")
    known = staged(_suffixes(keyed, least, phrase), "suffixes")
    each = known.select("key", "n_words", F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2")).distinct()
    twins = each.groupBy("h1", "h2").agg(F.min("key").alias("twin"), F.count(F.lit(1)).alias("copies"))
    texts = each.join(twins, ["h1", "h2"]).select("key", "twin", "n_words", "copies")
    single = known.join(twins.select(F.col("twin").alias("key")), "key", "left_semi").select("key", F.posexplode("phrases").alias("nth", "phrase"))
    # written, so that both sides of the join are plain shuffles, of which Spark splits a hot phrase
    repeated = staged(single.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("phrase"), "phrases")
    wanted = single.join(repeated, "phrase", "left_semi").groupBy("key").agg(F.collect_set("nth").alias("wanted"))
    matched = keyed.join(wanted, keyed["_key"] == wanted["key"])
    runs = staged(_windows(matched, least, phrase), "runs").dropDuplicates(["key", "phrase", "begin"])
    place = F.struct("key", "begin").alias("place")
    alike = staged(runs.groupBy("phrase", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"), F.first("left").alias("left"), F.first("windows").alias("windows")), "alike")
    several = alike.groupBy("phrase").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("phrase")
    each = alike.join(several, "phrase", "left_semi").select("phrase", "whole", "n", "at", "left", F.posexplode("windows").alias("k", "window"))
    each = each.select("phrase", "whole", "n", (F.col("left") - F.col("k")).alias("offset"), "window", F.struct("at.key", (F.col("at.begin") + F.col("k")).alias("begin")).alias("at"))
    equal = each.groupBy("phrase", "offset", "window").agg(F.sum("n").alias("times"), F.min("at").alias("first")).where("times > 1")
    bit = F.expr("shiftleft(1L, offset)")
    met = each.join(equal, ["phrase", "offset", "window"]).groupBy("phrase", "whole")
    masks = met.agg(F.sum(bit).alias("some"), F.sum(F.when(F.col("at") == F.col("first"), F.lit(0).cast("long")).otherwise(bit)).alias("elsewhere"))
    full = F.expr("aggregate(sequence(0, size(windows) - 1), 0L, (m, k) -> m | shiftleft(1L, left - k))")
    judged = alike.join(masks, ["phrase", "whole"], "left").select(
        "phrase",
        "whole",
        F.col("at").alias("first"),
        F.when(F.col("n") > 1, full).otherwise(F.coalesce("some", F.lit(0).cast("long"))).alias("again"),
        F.coalesce("elsewhere", F.lit(0).cast("long")).alias("elsewhere"),
    )
    marks = runs.select("key", "phrase", "whole", "begin", "left", F.size("windows").alias("n")).join(staged(judged.where("again <> 0"), "judged"), ["phrase", "whole"])
    later = F.when(F.struct("key", "begin") == F.col("first"), F.col("elsewhere")).otherwise(F.col("again"))
    marks = marks.select("key", F.struct("begin", "left", "n", "again", later.alias("later")).alias("run")).groupBy("key").agg(F.collect_list("run").alias("runs"))
    lengths = texts.groupBy("key").agg(F.max("n_words").alias("n_words"))
    return texts, _spans(marks.join(lengths, "key").select("key", "n_words", "runs"), least)


def _key() -> Column:
    """The row's document (a null doc_id: a hash of its text) and text."""
    text = [F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")]
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("doc"), *text)


def repeats(docs: DataFrame, least: int = LEAST, phrase: int = PHRASE) -> DataFrame:
    """doc_id, start_word, end_word (past the last), removable_words of every repeated passage.

    A passage is a maximal stretch of a text whose windows of ``least`` words
    all occur again, in another text or elsewhere in this one.  ``removable``
    counts its words in windows that have an earlier occurrence (by doc_id, then
    a hash of the text, and place).  Of equal texts of at least ``least`` words each is one passage, all
    but the first removable.  Null, empty and shorter texts have none.  Equal
    rows of one doc_id are one document; different texts of one doc_id are
    documents of their own, whose rows have that doc_id.  Null ids are told
    apart by their texts.  Texts may be of any length.
    """
    keyed = docs.select("doc_id", "text", _key().alias("_key"))
    texts, spans = _repeats(keyed, least, phrase)
    own = spans.select("key", F.explode("spans").alias("s")).select("key", "s.start", "s.end", "s.removable")
    copied = texts.where((F.col("copies") > 1) & (F.col("n_words") >= least))
    whole = copied.join(spans.select(F.col("key").alias("twin"), F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + c["end"] - c["start"]).alias("cut")), "twin", "left")
    whole = whole.select("key", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), F.when(F.col("key") == F.col("twin"), F.coalesce("cut", F.lit(0).cast("long"))).otherwise(F.col("n_words")).alias("removable"))
    part = own.join(copied.select("key"), "key", "left_anti")
    ids = keyed.select("_key", "doc_id").distinct()
    return part.unionByName(whole).join(ids, F.col("key") == F.col("_key")).select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("removable").alias("removable_words"))


def without_repeats(docs: DataFrame, least: int = LEAST, phrase: int = PHRASE) -> DataFrame:
    """The documents with every removable passage cut out of their texts, all columns kept.

    The first occurrence of a passage stays.  ``n_chars``, where there is such a
    column, is counted anew for a changed text.  A document of which only white
    space is left is left out, and so are later copies of a text of at least ``least``
    words; untouched documents, empty ones too, stay as they are.  Documents are
    told apart as in ``repeats``: texts of one doc_id are cut each by itself, and equal
    rows alike.  Only touched texts go through Python.
    """
    key, cut, gone, new = (fresh(docs, c) for c in ("_key", "_cuts", "_gone", "_new"))
    keyed = docs.withColumn(key, _key())
    texts, spans = _repeats(keyed.select(F.col(key).alias("_key"), "text"), least, phrase)
    later = (F.col("key") != F.col("twin")) & (F.col("n_words") >= least)
    orders = texts.join(spans.select("key", "cuts"), "key", "left").where(later | (F.size("cuts") > 0)).select(F.col("key").alias(key), later.alias(gone), "cuts")
    orders = orders.withColumnRenamed("cuts", cut)

    @F.arrow_udf("string")
    def left(column: pa.Array, cuts: pa.Array) -> pa.Array:
        out = [None if t is None else _cut(t, [(c["start"], c["end"]) for c in k]) for t, k in zip(column.to_pylist(), cuts.to_pylist())]
        release()
        return pa.array([t if t and t.strip() else None for t in out], pa.string())

    some = F.col(cut).isNotNull()
    joined = keyed.join(orders, key, "left").where(~F.coalesce(F.col(gone), F.lit(False)))
    # a row without cuts sends two nulls
    done = joined.withColumn(new, left(F.when(some, F.col("text")), F.col(cut))).where(~some | F.col(new).isNotNull())
    changed = {"text": F.when(some, F.col(new)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(some, F.length(new).cast(kind)).otherwise(F.col("n_chars"))
    return done.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def _cut(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the words of the cuts; the white space before each stays."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words = Words(data, np.array([0, len(data)]))
    keep, at = [], 0
    for a, b in cuts:
        if a >= len(words.starts):
            break
        keep.append(data[at : words.starts[a]].tobytes())
        at = words.starts[b] if b < len(words.starts) else words.ends[-1]
    return b"".join([*keep, data[at:].tobytes()]).decode()
