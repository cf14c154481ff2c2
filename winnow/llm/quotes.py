"""Conversations from messages that quote each other.

Every line of a message has a quote level, its leading ``>`` signs.  A quoted
passage is the words of consecutive lines of one level (lines without words do
not end it), so line breaks play no part.  It is cut into windows of ``WINDOW``
words, the last one aligned to its end; shorter passages are one window.  Hashes of
the windows are joined to the messages whose own words hold them, anywhere:

* in the same conversation every earlier message that wrote a window counts
  (a window of more than ``COMMON`` writers there by classes of messages that wrote the same such windows);
* a window without earlier writer there counts for the first message that wrote
  it, if that is of a conversation with a smaller id (so replies never form a circle).

A message replies to the one that most words of its level-one windows come from,
the nearest of equals; without such words, to the one before it.  Only own windows that pass a Bloom
filter of the quoted ones leave their task.  Roots and depths of the reply trees come from pointer doubling, so a
conversation is never one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.llm.scan import _BASE, _ODD, BYTE_VALUES, SPACES, Words, blocks, mix, span_hashes, staged

PREFIX = r"^\s*((?:>[ \t]?)+)"
ATTRIBUTION = r"^\s*(On\s.+\swrote|Am\s.+\sschrieb\s.+|Le\s.+\sa écrit|El\s.+\sescribió)\s*:\s*$"
#: turns of a conversation in one bucket when the turn before is looked up
BUCKET = 1024
#: words of a window
WINDOW = 5
#: a window of more writers in a conversation is not joined to each of them, but to their classes; with the same result
COMMON = 64
#: bits of the Bloom filter for a window, and at most (8 MB); a fuller filter lets more windows pass, with the same result
BITS_PER_KEY = 16
MAX_BITS = 1 << 26

_OTHER = mix(BYTE_VALUES ^ np.uint64(0xA0761D6478BD642F))


def level(line: Column) -> Column:
    """Number of leading quote signs."""
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 1), "[^>]", ""))


def unquoted(text: Column) -> Column:
    """The text without quoted lines and without attributions right before them; texts without quotes stay as they are."""
    lines = F.split(text, "\n", -1)
    quoted = F.exists(lines, lambda x: level(x) > 0)
    own = F.filter(lines, lambda x, i: (level(x) == 0) & ~(x.rlike(ATTRIBUTION) & (level(F.coalesce(F.get(lines, i + 1), F.lit(""))) > 0)))
    return F.when(quoted, F.regexp_replace(F.array_join(own, "\n"), r"^\s*\n|\s+$", "")).otherwise(text)


def _identity() -> Column:
    """A digest of the whole row, 16 bytes."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role = F.when(F.col("role").isNull(), "n").otherwise(F.concat(F.lit("r"), "role"))
    return F.unhex(F.substring(F.sha2(F.concat_ws("\0", number("conv_id"), number("turn"), role, "text"), 256), 1, 32))


def _before(messages: DataFrame) -> DataFrame:
    """mid, prev: the message before, by (turn, mid), in its conversation; within buckets of turns, then over buckets."""
    keyed = messages.select("mid", "conv_id", "turn", F.floor(F.coalesce("turn", F.lit(0)) / BUCKET).alias("bucket"))
    order = W.partitionBy("conv_id", "bucket").orderBy("turn", "mid")
    near = keyed.withColumn("prev", F.lag("mid").over(order))
    last = keyed.groupBy("conv_id", "bucket").agg(F.max(F.struct("turn", "mid"))["mid"].alias("last"))
    last = last.select("conv_id", "bucket", F.lag("last").over(W.partitionBy("conv_id").orderBy("bucket")).alias("far"))
    both = near.join(last, near["conv_id"].eqNullSafe(last["conv_id"]) & (near["bucket"] == last["bucket"]))
    return both.select("mid", F.coalesce("prev", "far").alias("prev"))


class Quoted:
    """Words of a block of texts without quote signs: two hashes, row and quote level of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
        starts = starts[starts < len(data)]
        shown = np.flatnonzero(~SPACES[data])
        heads = shown[np.minimum(np.searchsorted(shown, starts), max(len(shown) - 1, 0))] if len(shown) else starts
        ends = np.append(starts[1:], len(data))
        levels = np.zeros(len(starts), dtype=np.int64)
        clean = data.copy()
        for line in np.flatnonzero((heads >= starts) & (heads < ends) & (data[heads] == 62)) if len(starts) else ():
            at, end = int(heads[line]), int(ends[line])
            while at < end and data[at] == 62:
                levels[line] += 1
                at += 2 if at + 1 < end and data[at + 1] in (32, 9) else 1
            clean[heads[line] : at] = 32
        words = Words(clean, offsets)
        self.row = words.row_of()
        self.level = levels[np.searchsorted(starts, words.starts, side="right") - 1] if len(starts) else np.zeros(0, dtype=np.int64)
        self.hashes = [span_hashes(values[clean], words.starts, words.ends) for values in (BYTE_VALUES, _OTHER)]


def _windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words."""
    out, factor = np.zeros(max(len(hashes) - n + 1, 0), dtype=np.uint64), 1
    for k in range(n if len(out) else 0):
        out += hashes[k : k + len(out)] * np.uint64(factor)
        factor = factor * _BASE & (2**64 - 1)
    return mix(out + np.uint64(n * int(_ODD) & (2**64 - 1)))


def _quoted(ids: DataFrame) -> DataFrame:
    """(mid, conv_id, turn, level, size, h1, h2, words): windows of quoted passages, and how many words each stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(3), fold=True):
                q = Quoted(data, offsets)
                new = np.ones(len(q.row), dtype=bool)
                new[1:] = (q.row[1:] != q.row[:-1]) | (q.level[1:] != q.level[:-1])
                begin = np.flatnonzero(new)
                length = np.diff(np.append(begin, len(q.row)))
                keep = q.level[begin] > 0
                begin, length = begin[keep], length[keep]
                parts = -(-length // WINDOW)
                run_of = np.repeat(np.arange(len(begin)), parts)
                nth = np.arange(len(run_of)) - np.repeat(np.cumsum(parts) - parts, parts)
                begin, length = begin[run_of], length[run_of]
                size = np.minimum(length, WINDOW)
                at = begin + np.minimum(nth * WINDOW, length - size)
                h = np.zeros((2, len(at)), dtype=np.uint64)
                for n in np.unique(size):
                    for k in (0, 1):
                        h[k, size == n] = _windows(q.hashes[k], int(n))[at[size == n]]
                rows = pa.array(q.row[at] + first)
                numbers = (q.level[at], size, h[0].view(np.int64), h[1].view(np.int64), np.minimum(WINDOW, length - nth * WINDOW))
                columns = [batch.column(k).take(rows) for k in range(3)] + [pa.array(x.astype(np.int64)) for x in numbers]
                yield pa.RecordBatch.from_arrays(columns, ["mid", "conv_id", "turn", "level", "size", "h1", "h2", "words"])

    return ids.select("mid", "conv_id", "turn", "text").mapInArrow(run, f"{_keys(ids)}, level long, size long, h1 long, h2 long, words long")


def _keys(ids: DataFrame) -> str:
    return ", ".join(f"{c} {ids.schema[c].dataType.simpleString()}" for c in ("mid", "conv_id", "turn"))


def _bloom(wanted: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of h1: two bits a key, merged by Spark in words of 64; and its number of bits."""
    bits = 1 << 16
    while bits < min(MAX_BITS, wanted.count() * BITS_PER_KEY):
        bits *= 2
    mask = F.lit(bits - 1).cast("long")
    place = F.explode(F.array(F.col("h1").bitwiseAND(mask), F.shiftrightunsigned("h1", 32).bitwiseAND(mask)))
    places = wanted.select(place.alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table, bits


def _own(ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """(mid, conv_id, turn, h1, h2): distinct windows of messages' own words that may be quoted."""
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())
    table, bits = _bloom(wanted)
    shared = ids.sparkSession.sparkContext.broadcast(table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = np.frombuffer(shared.value, dtype=np.uint64), np.uint64(bits - 1)
        for batch in batches:
            for first, data, offsets in blocks(batch.column(3), fold=True):
                q = Quoted(data, offsets)
                own = q.level == 0
                row, hashes = q.row[own], [h[own] for h in q.hashes]
                found = [np.zeros((3, 0), dtype=np.uint64)]
                for n in sizes:
                    h1 = _windows(hashes[0], n)
                    hit = row[: len(h1)] == row[len(row) - len(h1) :]
                    for at in (h1 & mask, (h1 >> np.uint64(32)) & mask):
                        hit &= ((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
                    found.append(np.stack([row[: len(h1)][hit].astype(np.uint64), h1[hit], _windows(hashes[1], n)[hit]]))
                found = np.unique(np.concatenate(found, axis=1), axis=1)
                rows = pa.array(found[0].astype(np.int64) + first)
                columns = [batch.column(k).take(rows) for k in range(3)] + [pa.array(found[k].view(np.int64)) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(columns, ["mid", "conv_id", "turn", "h1", "h2"])

    return ids.select("mid", "conv_id", "turn", "text").mapInArrow(run, f"{_keys(ids)}, h1 long, h2 long")


def _same(a: DataFrame, b: DataFrame) -> Column:
    """The same window in the same conversation; ``b`` has c, w1, w2."""
    return (a["h1"] == b["w1"]) & (a["h2"] == b["w2"]) & a["conv_id"].eqNullSafe(b["c"])


def _nearest(quoted: DataFrame, own: DataFrame) -> DataFrame:
    """``quoted`` with the last message of the conversation that wrote the window before: within buckets of turns, then over buckets."""
    keys = ["conv_id", "h1", "h2"]
    bucket = F.floor(F.col("turn") / BUCKET).alias("bucket")
    asked = quoted.where("turn is not null").select(*keys, bucket, "turn", F.lit(0).alias("kind"), "mid", "level", "words")
    wrote = own.where("turn is not null").select(*keys, bucket, "turn", F.lit(1).alias("kind"), "mid", F.lit(None).cast("long").alias("level"), F.lit(None).cast("long").alias("words"))
    events = asked.unionByName(wrote)
    writer = F.when(F.col("kind") == 1, F.struct("turn", "mid"))
    within = W.partitionBy(*keys, "bucket").orderBy("turn", "kind", "mid").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = events.withColumn("near", F.last(writer, ignorenulls=True).over(within)).where("kind = 0")
    last = events.groupBy(*keys, "bucket").agg(F.max(writer).alias("last"))
    over = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    far = last.select(F.col("conv_id").alias("c"), F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("bucket").alias("b"), F.last("last", ignorenulls=True).over(over).alias("far"))
    both = near.join(far, _same(near, far) & (near["bucket"] == far["b"]))
    return both.withColumn("at", F.coalesce("near", "far")).select("mid", "level", "h1", "h2", "words", F.col("conv_id").alias("to_conv"), F.col("at.turn").alias("to_turn"), F.col("at.mid").alias("target"))


def _common_votes(asked: DataFrame, own: DataFrame, common: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Votes by windows that many wrote, with messages of a conversation that wrote the same set of them as one class.

    (votes: mid, conv_id, turn, h1, h2, n, for every class (h1, h2) that wrote an asked window; members: conv_id, turn, mid,
    h1, h2 of their class).  So the rows grow with the number of classes, not with the number of writers.
    """
    wrote = own.where("turn is not null").join(common, _same(own, common), "left_semi")
    # a set's digest: the exclusive or of its windows' 128 bits
    members = staged(wrote.groupBy("conv_id", "turn", "mid").agg(F.bit_xor("h1").alias("k1"), F.bit_xor("h2").alias("k2")), "members")
    shown = members.groupBy("conv_id", "k1", "k2").agg(F.min("mid").alias("mid")).select("k1", "k2", "mid")
    held = wrote.join(shown, "mid").select(F.col("conv_id").alias("c"), F.col("h1").alias("w1"), F.col("h2").alias("w2"), "k1", "k2")
    votes = asked.join(held, _same(asked, held)).groupBy("mid", "conv_id", "turn", "k1", "k2").agg(F.sum("words").alias("n"))
    names = {"k1": "h1", "k2": "h2"}
    return staged(votes.withColumnsRenamed(names), "common"), members.withColumnsRenamed(names)


def link(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages with mid and text; linked: mid, words of every quoted window that someone wrote before; votes: mid, n,
    target with its to_conv and to_turn).

    A vote says that ``n`` of a message's words of level one may come from ``target``; of the targets with the same n
    the nearest is always there, others that it beats may be missing.
    ``messages`` has conv_id, turn, role, text.
    """
    text = F.coalesce("text", F.lit(""))
    ids = messages.select("conv_id", "turn", "role", text.alias("text"))
    ids = staged(ids.groupBy(*ids.columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("mid", _identity()), "messages")
    window = ["mid", "conv_id", "turn", "level", "size", "h1", "h2"]
    quoted = staged(_quoted(ids).groupBy(*window).agg(F.sum("words").alias("words")), "quoted")
    wanted = quoted.select("size", "h1", "h2").distinct()
    own = staged(_own(ids, wanted), "own")
    writers = own.groupBy(F.col("conv_id").alias("c"), F.col("h1").alias("w1"), F.col("h2").alias("w2")).agg(F.count(F.lit(1)).alias("writers"), F.min("turn").alias("since"))
    asked = staged(quoted.join(writers, _same(quoted, writers), "left").select(quoted["*"], "writers", "since"), "asked")
    here = asked.where("since < turn")
    few, many = here.where(f"level = 1 and writers <= {COMMON}"), here.where(f"level = 1 and writers > {COMMON}")
    by = own.select(F.col("conv_id").alias("c"), F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("turn").alias("to_turn"), F.col("mid").alias("target"))
    pair = ["mid", "to_conv", "to_turn", "target"]
    votes = few.join(by, _same(few, by) & (by["to_turn"] < few["turn"])).select("mid", F.col("c").alias("to_conv"), "to_turn", "target", "words").groupBy(*pair).agg(F.sum("words").alias("n"))
    if not many.isEmpty():
        common, members = _common_votes(many, own, writers.where(f"writers > {COMMON}"))
        # a target has the votes of its class; the nearest of a class beats those of it without other votes
        nearest = _nearest(common.withColumn("level", F.lit(1)).withColumnRenamed("n", "words"), members).where("target is not null")
        of = members.select(F.col("mid").alias("target"), "h1", "h2")
        more = common.select("mid", "h1", "h2", F.col("n").alias("more"))
        votes = votes.join(of, "target", "left").join(more, ["mid", "h1", "h2"], "left").select(*pair, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        votes = votes.unionByName(nearest.select(*pair, F.col("words").alias("n")))
    left = asked.where("since is null or turn is null or since >= turn")
    first = own.groupBy("h1", "h2").agg(F.min(F.struct("conv_id", "turn", "mid")).alias("first"))
    there = staged(left.join(first, ["h1", "h2"]).where("first.conv_id < conv_id").select("mid", "level", "words", "first"), "there")
    far = there.where("level = 1").groupBy("mid", "first").agg(F.sum("words").alias("n"))
    votes = votes.unionByName(far.select("mid", F.col("first.conv_id").alias("to_conv"), F.col("first.turn").alias("to_turn"), F.col("first.mid").alias("target"), "n"))
    return ids, here.select("mid", "words").unionByName(there.select("mid", "words")), votes


def conversations(messages: DataFrame) -> DataFrame:
    """Reply-ordered conversations without quotes.

    Returns conv_id, turn, role, text (unquoted), quoted_lines, linked_words
    (quoted words, of any level, that a message before or of another conversation wrote), reply_conv, reply_turn, root_conv, root_turn, depth (0 for a root), copies,
    in reply order: by tree, depth and turn, so that a message comes after what
    it replies to.  The order is a range sort, whatever the size of a tree.
    Equal rows are one message with their number in ``copies``.  A null text is empty; null
    conversations are one conversation; null turns come first.  A message whose turn is null
    is neither before nor after others, so only other conversations quote it or are quoted by it.  Quotes that no
    message wrote are removed but link nothing; a message never replies to a
    later one of its conversation.
    """
    ids, linked, votes = link(messages)
    best = votes.groupBy("mid").agg(F.max(F.struct("n", "to_conv", "to_turn", "target"))["target"].alias("target"))
    linked = linked.groupBy("mid").agg(F.sum("words").alias("linked_words"))
    parents = ids.select("mid").join(best, "mid", "left").join(_before(ids), "mid", "left").select("mid", F.coalesce("target", "prev").alias("parent"))
    parents = staged(parents.join(linked, "mid", "left"), "parents")
    # up: an ancestor and how far it is; the distances double each round
    up = parents.select("mid", F.coalesce("parent", "mid").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    while True:
        higher = up.select(F.col("mid").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        up = staged(up.join(higher, "up").select("mid", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "ancestors")
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    names = ids.select(F.col("mid").alias("m"), F.struct("conv_id", "turn").alias("at"))
    out = ids.join(parents, "mid").join(up.select("mid", "up", "depth"), "mid")
    out = out.join(names.select(F.col("m").alias("parent"), F.col("at").alias("reply")), "parent", "left").join(names.select(F.col("m").alias("up"), F.col("at").alias("root")), "up")
    lines = F.split("text", "\n", -1)
    return out.select(
        "conv_id",
        "turn",
        "role",
        unquoted(F.col("text")).alias("text"),
        F.size(F.filter(lines, lambda x: level(x) > 0)).alias("quoted_lines"),
        F.coalesce("linked_words", F.lit(0)).cast("long").alias("linked_words"),
        F.col("reply.conv_id").alias("reply_conv"),
        F.col("reply.turn").alias("reply_turn"),
        F.col("root.conv_id").alias("root_conv"),
        F.col("root.turn").alias("root_turn"),
        "depth",
        "copies",
    ).orderBy("root_conv", "root_turn", "depth", "conv_id", "turn", "text")


#: the same in DuckDB's SQL
CONVERSATIONS_SQL = rf"""
WITH RECURSIVE ids AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, count(*) AS copies,
    substr(sha256(concat(coalesce(CAST(conv_id AS VARCHAR), ''), chr(0), coalesce(CAST(turn AS VARCHAR), ''), chr(0), CASE WHEN role IS NULL THEN 'n' ELSE 'r' || role END, chr(0), coalesce(text, ''))), 1, 32) AS mid
  FROM conversations GROUP BY conv_id, turn, role, text),
lines AS (SELECT mid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM ids),
parsed AS (
  SELECT mid, conv_id, turn, no, length(regexp_replace(regexp_extract(line, '{PREFIX}', 1), '[^>]', '', 'g')) AS level,
    list_filter(string_split_regex(lower(regexp_replace(line, '{PREFIX}', '')), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words
  FROM lines),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY mid ORDER BY no) - row_number() OVER (PARTITION BY mid, level ORDER BY no) AS run
  FROM parsed WHERE len(words) > 0),
passages AS (SELECT mid, conv_id, turn, level, flatten(list(words ORDER BY no)) AS words FROM runs WHERE level > 0 GROUP BY mid, conv_id, turn, level, run),
parts AS (SELECT *, len(words) AS n, unnest(range(0, CAST(ceil(len(words) / {WINDOW}.0) AS BIGINT))) AS part FROM passages),
quoted AS (
  SELECT mid, conv_id, turn, level, words[greatest(0, least(part * {WINDOW}, n - {WINDOW})) + 1 : greatest(0, least(part * {WINDOW}, n - {WINDOW})) + {WINDOW}] AS gram,
    sum(least({WINDOW}, n - part * {WINDOW})) AS words
  FROM parts GROUP BY ALL),
written AS (SELECT mid, conv_id, turn, flatten(list(words ORDER BY no)) AS words FROM runs WHERE level = 0 GROUP BY ALL),
sized AS (SELECT w.*, unnest(range(1, least({WINDOW}, len(words)) + 1)) AS k FROM written w),
placed AS (SELECT *, unnest(range(1, len(words) - k + 2)) AS p FROM sized),
own AS (SELECT DISTINCT mid, conv_id, turn, words[p : p + k - 1] AS gram FROM placed),
here AS (
  SELECT q.mid, q.level, q.gram, q.words, o.conv_id AS to_conv, o.turn AS to_turn, o.mid AS target
  FROM quoted q JOIN own o ON o.gram = q.gram AND o.conv_id IS NOT DISTINCT FROM q.conv_id AND o.turn < q.turn),
firsts AS (
  SELECT gram, conv_id AS to_conv, turn AS to_turn, mid AS target FROM own
  QUALIFY row_number() OVER (PARTITION BY gram ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, mid) = 1),
links AS (
  SELECT * FROM here
  UNION ALL SELECT q.mid, q.level, q.gram, q.words, f.to_conv, f.to_turn, f.target FROM quoted q JOIN firsts f ON f.gram = q.gram AND f.to_conv < q.conv_id
  WHERE NOT EXISTS (SELECT 1 FROM here h WHERE h.mid = q.mid AND h.level = q.level AND h.gram = q.gram)),
votes AS (SELECT mid, to_conv, to_turn, target, sum(words) AS n FROM links WHERE level = 1 GROUP BY ALL),
best AS (SELECT mid, first(target ORDER BY n DESC, to_conv DESC NULLS LAST, to_turn DESC NULLS LAST, target DESC) AS target FROM votes GROUP BY mid),
linked AS (SELECT mid, sum(words) AS linked_words FROM (SELECT DISTINCT mid, level, gram, words FROM links) GROUP BY mid),
before AS (SELECT mid, lag(mid) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mid) AS prev FROM ids),
parents AS (SELECT b.mid, coalesce(t.target, b.prev) AS parent FROM before b LEFT JOIN best t USING (mid)),
tree AS (
  SELECT mid, mid AS root, 0 AS depth FROM parents WHERE parent IS NULL
  UNION ALL SELECT p.mid, t.root, t.depth + 1 FROM parents p JOIN tree t ON p.parent = t.mid),
split AS (SELECT mid, string_split(text, chr(10)) AS l FROM ids),
counted AS (
  SELECT mid, len(list_filter(l, lambda x: regexp_matches(x, '{PREFIX}'))) AS quoted_lines,
    regexp_replace(array_to_string(list_filter(l, lambda x, i: NOT regexp_matches(x, '{PREFIX}')
      AND NOT (regexp_matches(x, '{ATTRIBUTION}') AND regexp_matches(coalesce(l[i + 1], ''), '{PREFIX}'))), chr(10)), '^\s*\n|\s+$', '', 'g') AS bare
  FROM split)
SELECT i.conv_id, i.turn, i.role, CASE WHEN c.quoted_lines > 0 THEN c.bare ELSE i.text END AS text, CAST(c.quoted_lines AS INT) AS quoted_lines,
  CAST(coalesce(l.linked_words, 0) AS BIGINT) AS linked_words,
  r.conv_id AS reply_conv, r.turn AS reply_turn, o.conv_id AS root_conv, o.turn AS root_turn, CAST(t.depth AS BIGINT) AS depth, i.copies
FROM ids i JOIN counted c USING (mid) JOIN parents p USING (mid) JOIN tree t USING (mid) JOIN ids o ON o.mid = t.root LEFT JOIN ids r ON r.mid = p.parent LEFT JOIN linked l ON l.mid = i.mid"""
