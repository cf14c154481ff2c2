"""Merkle manifest of a document table, by sibling-shift self-joins.

Leaves are numbered per source without ever sorting a source in one task: rows
are range-partitioned, numbered inside their partition, and shifted by the counts
of the partitions before.  A level's nodes (group, place, digest) are equijoined
with themselves on computed sibling places: place's slot moved on by one, by two,
... modulo the arity.  Rows of slot zero then hold their whole run and emit the
parents.  Proofs come down the same levels: a node's path is its own siblings,
then its parent's path.  All joins are on (group, place), of which every key is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.scan import staged

ARITY = 3
PART = 33  # bits of the place inside a partition in monotonically_increasing_id
PATH = "array<struct<before:string,after:string>>"


def digest(*parts) -> Column:
    """Lowercase hex sha256 of the concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[str], **replaced: Column) -> Column:
    """The digest of a row's fields, some replaced."""
    return digest(*[field(replaced.get(c, F.col(c))) for c in fields])


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with place (from 0 in its group, by ``order``) and n (rows of the group).

    Equal rows are told apart by where they were read, so no key is too hot for a range.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*group, *order, "_tie"]
    ranged = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    ranged = staged(ranged.withColumn("_part", F.shiftright("_at", PART)), name)
    counts = ranged.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_count"))
    every = Window.partitionBy(*group)
    before = F.sum("_count").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_count")
    keys = ["_part", *group]
    counts = counts.select(*[F.col(c).alias(f"_of_{c}") for c in keys], (before - F.col("_first")).alias("_shift"), F.sum("_count").over(every).alias("n"))
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    return ranged.join(counts, met).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"), "n")


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """Nodes (g, place, n, digest) with before and after: the digests of their run's others on either side, joined."""
    slot = F.col("place") % arity
    others = []
    out = nodes
    for k in range(1, arity):
        other = nodes.select(F.col("g").alias(f"_g{k}"), F.col("place").alias(f"_p{k}"), F.col("digest").alias(f"_d{k}"))
        wanted = F.col("place") - slot + (slot + k) % arity
        out = out.withColumn(f"_w{k}", wanted).join(other, (F.col("g") == F.col(f"_g{k}")) & (F.col(f"_w{k}") == F.col(f"_p{k}")), "left")
        others.append((F.col(f"_p{k}"), F.col(f"_d{k}")))

    def side(before: bool) -> Column:
        some = F.array(*[F.when((p < F.col("place")) if before else (p > F.col("place")), F.struct(p.alias("p"), d.alias("d"))) for p, d in others])
        return F.array_join(F.transform(F.array_sort(F.array_compact(some)), lambda x: x["d"]), "")

    return out.select(*nodes.columns, side(True).alias("before"), side(False).alias("after"))


def levels(nodes: DataFrame, name: str, arity: int = ARITY) -> list[DataFrame]:
    """Every level of the trees of all groups, leaves first, each written once; a group's last node has n = 1.

    ``nodes`` has g, place, n, digest; the leaves keep whatever else it has.
    """
    out = [staged(nodes, f"{name}_0")]
    largest = out[0].agg(F.max("n")).head()[0] or 0
    while largest > 1:
        level = staged(with_siblings(out[-1].where("n > 1"), arity), f"{name}_{len(out)}s")
        single = out[-1].where("n = 1").select("*", F.lit("").alias("before"), F.lit("").alias("after"))
        out[-1] = level.unionByName(single)
        up = level.where(F.col("place") % arity == 0)
        out.append(up.select("g", F.floor(F.col("place") / arity).alias("place"), F.ceil(F.col("n") / arity).alias("n"), digest("digest", "after").alias("digest")))
        largest = -(-largest // arity)
    out[-1] = out[-1].select("*", F.lit("").alias("before"), F.lit("").alias("after"))
    return out


def roots(tree: list[DataFrame]) -> DataFrame:
    """(g, digest) of the node that is left of every group."""
    return reduce(DataFrame.unionByName, [t.where("n = 1").select("g", "digest") for t in tree])


def paths(tree: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with subroot and path: siblings up to the group's root, then the path in ``tops`` (g, subroot, path)."""
    down = None
    for level in reversed(tree):
        kept = [c for c in level.columns if c not in ("before", "after")]
        last = level.where("n = 1").select(*kept).join(tops, "g").select(*kept, "subroot", "path")
        if down is None:
            down = last
            continue
        up = down.select("g", F.col("place").alias("_up"), "subroot", F.col("path").alias("_path"))
        inner = level.where("n > 1").withColumn("_up", F.floor(F.col("place") / arity)).join(up, ["g", "_up"])
        own = F.array(F.struct("before", "after"))
        down = inner.select(*kept, "subroot", F.concat(own, "_path").alias("path")).unionByName(last)
    return down


def folded(start: Column, path: Column) -> Column:
    """The root recomputed from a leaf and the siblings on its path; a run of one is hashed alone, like any run."""
    return F.aggregate(path, start, lambda d, s: digest(s["before"], d, s["after"]))


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    A row is a leaf over doc_id, source, lang, n_chars and text; other columns
    are ignored.  Leaves ascend per source by doc_id, null first, rows of one
    doc_id by their leaves; equal rows are leaves of their own.  Runs of
    ``arity`` neighbours become parents until one node is left, the subroot;
    the subroots by source (null first) likewise the root.  ``proof_sha256`` is
    the digest of all siblings up to the root.  Where the crc32 of the decimal
    doc_id (empty for null) is even, line feeds are deleted from the text
    (tampering), and ``folded_root`` is what the siblings make of that leaf;
    ``verified`` tells whether it is the root.  Texts may be empty, null or of any
    length and are read once; an empty table gives an empty one.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    cut = even & F.contains("text", F.lit("\n"))
    rows = docs.select("doc_id", "source", leaf(fields).alias("leaf"), F.when(cut, leaf(fields, text=F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("tampered"))
    rows = numbered(staged(rows, "leaves"), ["source"], ["doc_id", "leaf"], "ordered")
    sources = numbered(rows.where("place = 0").select("source").withColumn("all", F.lit(0)), ["all"], ["source"], "sources")
    sources = staged(sources.select("source", F.col("place").alias("g"), F.col("n").alias("n_sources")), "groups")
    named = rows.join(sources.select(F.col("source").alias("_source"), "g"), rows["source"].eqNullSafe(F.col("_source")))
    tree = levels(named.select("doc_id", "tampered", "g", "place", "n", F.col("leaf").alias("digest")), "level", arity)
    subroots = roots(tree).join(sources.select("g", "n_sources"), "g")
    top = levels(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("place"), F.col("n_sources").alias("n"), "digest"), "top", arity)
    whole = roots(top).head()
    root = F.lit(whole["digest"] if whole else None).cast("string")
    tops = paths(top, top[-1].select("g", F.lit("").alias("subroot"), F.array().cast(PATH).alias("path")), arity)
    tops = tops.select(F.col("place").alias("g"), "path").join(subroots.select("g", F.col("digest").alias("subroot")), "g").select("g", "subroot", "path")
    proven = paths(tree, staged(tops, "tops"), arity)
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""))
    fold = folded(F.coalesce("tampered", "digest"), F.col("path"))
    out = proven.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: the same in DuckDB's SQL
MANIFEST_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM generate_series(0, 255) g(i)),
d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NOT NULL AS named, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x))) AS b FROM documents),
l AS (
  SELECT doc_id, s, named, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 2 = 0
      THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS tampered
  FROM d CROSS JOIN crc),
o AS (SELECT *, row_number() OVER (PARTITION BY named, s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY named, s) AS n FROM l),
tree AS (
  SELECT 0 AS level, named, s, place, n, leaf AS node FROM o
  UNION ALL SELECT level + 1, named, s, place // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM tree WHERE n > 1 GROUP BY level, named, s, place // 3, n),
subs AS (SELECT named, s, level AS height, node AS subroot, row_number() OVER (ORDER BY named, s) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, place, n, subroot AS node FROM subs
  UNION ALL SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // 3, n),
sib AS (
  SELECT 0 AS kind, named, s, level, place, n, string_agg(node, '') OVER (PARTITION BY named, s, level, place // 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    string_agg(node, '') OVER (PARTITION BY named, s, level, place // 3 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM tree
  UNION ALL SELECT 1, true, '', level, place, n, string_agg(node, '') OVER (PARTITION BY level, place // 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    string_agg(node, '') OVER (PARTITION BY level, place // 3 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) FROM top),
walk AS (
  SELECT 0 AS level, x.height, o.named, o.s, o.place AS at, x.place AS sub, o.doc_id, o.leaf, x.subroot, '' AS proof, o.tampered AS node FROM o JOIN subs x ON x.named = o.named AND x.s = o.s
  UNION ALL
  SELECT w.level + 1, w.height, r.named, r.s, r.place // 3, w.sub, w.doc_id, w.leaf, w.subroot, w.proof || coalesce(r.before, '') || coalesce(r.after, ''), sha256(coalesce(r.before, '') || w.node || coalesce(r.after, ''))
  FROM walk w JOIN sib r ON r.kind = 0 AND r.n > 1 AND r.named = w.named AND r.s = w.s AND r.level = w.level AND r.place = w.at),
climb AS (
  SELECT 0 AS level, sub AS at, doc_id, leaf, subroot, proof, node FROM walk WHERE level = height
  UNION ALL
  SELECT w.level + 1, r.place // 3, w.doc_id, w.leaf, w.subroot, w.proof || coalesce(r.before, '') || coalesce(r.after, ''), sha256(coalesce(r.before, '') || w.node || coalesce(r.after, ''))
  FROM climb w JOIN sib r ON r.kind = 1 AND r.n > 1 AND r.level = w.level AND r.place = w.at)
SELECT c.doc_id, c.leaf, c.subroot, t.node AS root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = t.node AS verified
FROM climb c JOIN (SELECT level, node FROM top WHERE n = 1) t ON t.level = c.level"""
