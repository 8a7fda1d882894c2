"""Merkle manifest of a table: a proof for every row against one root.

Rows are leaves, numbered without gaps in each group. ``FANOUT`` consecutive
nodes become their hash until one is left, the group's root; the groups' roots
become the table's root in the same way.

Siblings come from lag and lead columns at fixed offsets over a block of
``FANOUT ** LEVELS`` consecutive nodes: the nodes of a level stand on the rows
of their first leaves, so at level j the siblings are multiples of FANOUT ** j
rows away. Slots and run lengths, both arithmetic on the position, mask the
columns that reach out of the run. Rows of first children hash the parents. A
block's top node goes on to the next round, whose blocks are FANOUT ** LEVELS
times as long; the number of rounds follows from the largest group's size.

No window is longer than a block, whatever the groups' sizes: numbering goes by
range partitions with carried counts. A row's path is put together top-down by
joins of a block's rows with the path of the block's top node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

FANOUT, LEVELS = 8, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Columns of a document that its leaf covers, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as byte length, ``:`` and value; null as ``-``."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in their group ``g`` by ``order``
    (from 0), and ``n``, the group's size. A group may span any number of range
    partitions; no window holds more than one partition's share of it."""
    ranged = cut_lineage(rows.repartitionByRange("g", *order).withColumn("pid", F.spark_partition_id()))
    share = ranged.groupBy("pid", "g").agg(F.count("*").alias("rows"))
    whole = Window.partitionBy("g")
    base = share.select(
        "pid", "g", F.coalesce(F.sum("rows").over(whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.sum("rows").over(whole).alias("n"))
    local = F.row_number().over(Window.partitionBy("pid", "g").orderBy(*order))
    return ranged.withColumn("local", local).join(base, ["pid", "g"]).withColumn("pos", F.col("base") + F.col("local") - 1).drop("pid", "base", "local")


def with_paths(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Nodes (g, pos, n, digest, ...) with ``blk`` and, for ``levels`` levels or
    as many as the group has, ``path``: the siblings before and after the node
    and its ancestors, as hex text. ``top`` is the block's node after those
    levels, on the block's first row; null on the others."""
    block = fanout**levels
    rows = nodes.withColumn("blk", F.floor(F.col("pos") / block)).withColumn("top", F.col("digest"))
    within = Window.partitionBy("g", "blk").orderBy("pos")
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = []
    for level in range(levels):
        step = fanout**level
        count = F.ceil(F.col("n") / step)
        index = F.floor(F.col("pos") / step)
        slot = index % fanout
        length = F.least(F.lit(fanout), count - (index - slot))
        lags = [F.when(slot >= i, F.lag("top", i * step).over(within)).otherwise("") for i in range(fanout - 1, 0, -1)]
        leads = [F.when(slot + i < length, F.lead("top", i * step).over(within)).otherwise("") for i in range(1, fanout)]
        rows = rows.withColumns({"before": F.concat(*lags), "after": F.concat(*leads)})
        is_node, first, more = F.col("pos") % step == 0, F.col("pos") % (step * fanout) == 0, count > 1
        step_of = F.last(F.when(is_node, F.struct("before", "after")), ignorenulls=True).over(so_far)
        rows = rows.withColumns({
            f"step{level}": F.when(more, step_of),
            "top": F.when(~first, F.lit(None).cast("string")).when(more, F.sha2(F.concat("top", "after"), 256)).otherwise(F.col("top"))})
        steps.append(f"step{level}")
    path = F.filter(F.array(*steps), lambda s: s.isNotNull())
    return rows.withColumn("path", path).drop("before", "after", *steps)


def tree(leaves: DataFrame, order: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): ``leaves`` (g, digest, ...) with ``path`` up to their
    group's root, and (g, digest) of the roots."""
    nodes = cut_lineage(numbered(leaves, order))
    size = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [nodes]
    while True:
        above = (with_paths(rounds[-1], fanout, levels).where(F.col("pos") % fanout**levels == 0)
                 .select("g", F.col("blk").alias("pos"), F.ceil(F.col("n") / fanout**levels).alias("n"), F.col("top").alias("digest")))
        rounds.append(cut_lineage(above))
        size = -(-size // fanout**levels)
        if size <= 1:
            break
    roots = rounds.pop().select("g", "digest")
    path = None
    for now in reversed(rounds):
        here = with_paths(now, fanout, levels)
        if path is not None:
            upper = path.select("g", F.col("pos").alias("blk"), F.col("path").alias("upper"))
            here = here.join(upper, ["g", "blk"]).withColumn("path", F.concat("path", "upper")).drop("upper")
        path = here.drop("blk", "top", "n") if now is nodes else here.select("g", "pos", "path")
    return path, roots


def fold(digest: Column, path: Column) -> Column:
    """The root that a node's digest and its path lead to."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as hex text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, fields: list[str], id_col: str, group_col: str, changed: dict[str, Column] | None = None,
             fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc_id, digest, changed_digest, path, subroot, root) of every row.

    Leaves cover ``fields``; within a group (null first, then by UTF-8 bytes)
    they ascend by id (null first), rows of the same id by their hash.
    ``path`` leads from the leaf by its group's subroot to the root.
    ``changed`` names fields with other values; ``changed_digest`` is the leaf
    that they would give. Nulls are values of their own; repeated rows are
    leaves of their own; an empty table gives an empty result, and columns that
    are not named here do not matter."""
    changed = changed or {}
    leaf = leaf_hash([F.col(f) for f in fields])
    other = leaf_hash([changed.get(f, F.col(f)) for f in fields])
    group = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    # The last key parts equal rows, so that any number of them can be dealt to many partitions.
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), group.alias("g"), leaf.alias("digest"), other.alias("changed_digest"), F.monotonically_increasing_id().alias("row")))
    paths, subroots = tree(rows, ["doc_id", "digest", "row"], fanout, levels)
    groups = subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    group_paths, root = tree(groups, ["name"], fanout, levels)
    of_group = group_paths.join(root.withColumnRenamed("digest", "root"), "g").select(
        F.col("name").alias("g"), F.col("path").alias("upper"), F.col("digest").alias("subroot"), "root")
    return paths.join(of_group, "g").select("doc_id", "digest", "changed_digest", F.concat("path", "upper").alias("path"), "subroot", "root")


def document_proofs(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of
    every document; where 3 divides the crc32 of the decimal id (a null id
    counts as empty) the folded leaf is that of the text with A-Z lowered."""
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    text = F.col("text").cast("string")
    proofs = manifest(docs, FIELDS, "doc_id", "lang", {"text": F.when(tampered, F.translate(text, UPPER, LOWER)).otherwise(text)}, fanout, levels)
    folded = proofs.withColumn("folded_root", fold(F.col("changed_digest"), F.col("path")))
    return folded.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 by its definition: eight shifts a byte, polynomial 0xEDB88320.
_CRC = """
xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)
"""
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR END"
_BEFORE = " || ".join(_FIELD.format(c) for c in FIELDS[:-1])
SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, sha256({_BEFORE} || {_FIELD.format('text')}) AS h,
         CASE WHEN {_CRC} % 3 = 0 THEN sha256({_BEFORE} || {_FIELD.format(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS changed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
lower AS (
  SELECT lang, 0 AS level, pos, h, n FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM lower WHERE n > 1 GROUP BY lang, level, pos // 8, n),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lower WHERE n = 1),
upper AS (
  SELECT 0 AS level, pos, h, n FROM sub
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM upper WHERE n > 1 GROUP BY level, pos // 8, n),
top AS (SELECT h FROM upper WHERE n = 1),
low_path AS (
  SELECT p.lang, p.pos, l.level, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < p.pos // (8 ** l.level)::BIGINT), '') AS b,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > p.pos // (8 ** l.level)::BIGINT), '') AS a
  FROM placed p JOIN (SELECT DISTINCT lang, level FROM lower WHERE n > 1) l ON p.lang IS NOT DISTINCT FROM l.lang
  JOIN lower s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = l.level AND s.pos // 8 = p.pos // (8 ** (l.level + 1))::BIGINT
  GROUP BY p.lang, p.pos, l.level),
high_path AS (
  SELECT p.lang, l.level, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < p.pos // (8 ** l.level)::BIGINT), '') AS b,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > p.pos // (8 ** l.level)::BIGINT), '') AS a
  FROM sub p, (SELECT DISTINCT level FROM upper WHERE n > 1) l JOIN upper s ON s.level = l.level AND s.pos // 8 = p.pos // (8 ** (l.level + 1))::BIGINT
  GROUP BY p.lang, p.pos, l.level),
steps AS (
  SELECT lang, pos, level, b, a FROM low_path
  UNION ALL
  SELECT p.lang, p.pos, 100 + h.level, h.b, h.a FROM placed p JOIN high_path h ON p.lang IS NOT DISTINCT FROM h.lang),
paths AS (SELECT lang, pos, list(b ORDER BY level) AS bs, list(a ORDER BY level) AS af, string_agg(b || a, '' ORDER BY level) AS proof FROM steps GROUP BY lang, pos),
folded AS (
  SELECT p.doc_id, p.lang, p.pos, p.h, coalesce(p.changed, p.h) AS f, 0 AS k, coalesce(bs, []) AS bs, coalesce(af, []) AS af, coalesce(proof, '') AS proof
  FROM placed p LEFT JOIN paths q ON p.lang IS NOT DISTINCT FROM q.lang AND p.pos = q.pos
  UNION ALL
  SELECT doc_id, lang, pos, h, sha256(bs[k + 1] || f || af[k + 1]), k + 1, bs, af, proof FROM folded WHERE k < len(bs))
SELECT f.doc_id, f.h AS leaf, s.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.f AS folded_root, f.f = t.h AS verified
FROM folded f JOIN sub s ON f.lang IS NOT DISTINCT FROM s.lang, top t WHERE f.k = len(f.bs)
"""
