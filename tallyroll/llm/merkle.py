"""A manifest of a dataset as a hash tree per group, with a proof for every row.

A row's leaf is the digest of its columns, each with its length before it.  In a group (here: a
language) the leaves ascend by id; every ``FAN`` consecutive nodes become the digest of theirs until
one is left, the group's subroot; the subroots become the root in the same way.

1. Leaves are sorted by range over all tasks and numbered by the counts of the parts before theirs,
   so a group of any size is ranked without passing through one task.
2. Each level is stored as rows that are linked to their parent: own place, parent's place, digests of
   the siblings to the left and to the right.
3. A recursive query climbs from the leaves to the root over these rows.  The up to ``FAN`` leaves of
   one run climb together, in one row: above their run they have the same siblings, which are appended
   once, while each leaf's own digest is folded with them.

Nulls: a null value is ``-``; rows with a null group are a group, which comes first; rows with a null
id come first in theirs.  Ties of ids go by leaf, and repeated rows are leaves of their own.  Very long
texts are digested whole.  An empty table gives an empty result.  Columns beside those named are not
part of a leaf and are not returned.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settings, written
from .line_dedup import ascii_lower

#: How many nodes become one.
FAN = 8
#: The tree over the subroots; the groups' trees are numbered from 0.
TOP = -1
#: Spark ends a recursion at this many rows or levels unless told otherwise; a tree of 100 levels doesn't exist.
ANY_SIZE = {"spark.sql.cteRecursionRowLimit": "-1"}

CLIMB = """
WITH RECURSIVE climb (grp, run, tree, level, idx, folds, above) AS (
  SELECT grp, run, tree, level, idx, folds, '' FROM {starts}
  UNION ALL
  SELECT c.grp, c.run, n.up_tree, n.up_level, n.up_idx,
    transform(c.folds, f -> sha2(concat(n.lefts, f, n.rights), 256)), concat(c.above, n.lefts, n.rights)
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.idx = n.idx
)
SELECT grp, run, folds, above FROM climb WHERE tree = {tree} AND level = {level} AND idx = 0
"""


def leaf(columns: list[Column]) -> Column:
    """Hex digest of ``columns``: ``-`` for a null, else byte count, colon, value."""

    def told(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[told(c) for c in columns]), 256)


def ranked(df: DataFrame, group: str, order: list[str], tag: str) -> DataFrame:
    """``df`` with ``pos``: the row's number, from 0, in its group in ascending order, nulls first.

    Sorted by range and written; the number is the row's place in its part and group plus the rows of
    the group in earlier parts.  Only a count for each part and group is summed in order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    dealt = written(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), tag)
    counts = written(dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from")), f"{tag}-counts")
    if counts.isEmpty():
        return dealt.drop("_part", "_at").withColumn("pos", F.lit(0).cast("long"))
    earlier = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_n")
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    earlier = earlier.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    starts = counts.join(earlier, counts[group].eqNullSafe(earlier["_g"]) & (counts["_part"] == earlier["_p"])).select("_g", "_p", "_from", "_before")
    both = dealt.join(starts, dealt[group].eqNullSafe(starts["_g"]) & (dealt["_part"] == starts["_p"]))
    return both.withColumn("pos", F.col("_at") - F.col("_from") + F.col("_before")).drop("_part", "_at", "_g", "_p", "_from", "_before")


def _levels(nodes: DataFrame, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """From (tree, idx, digest) of level 0: the linked rows of every level, and (tree, level, digest) of the roots.

    Each level is a written table, an eighth of the one below it; trees of one node end there.
    """
    linked, roots, level = [], [], 0
    while True:
        counts = nodes.groupBy("tree").agg(F.max("idx").alias("_last"))
        alone = counts.where("_last = 0").select("tree")
        roots.append(nodes.join(alone, "tree").select("tree", F.lit(level).alias("level"), "digest"))
        runs = nodes.join(alone, "tree", "left_anti").groupBy("tree", F.floor(F.col("idx") / FAN).alias("run"))
        runs = written(runs.agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("of")), f"{tag}-level")
        if runs.isEmpty():
            return linked, written(reduce(DataFrame.unionByName, roots), f"{tag}-roots")
        one = runs.select("tree", "run", "of", F.posexplode("of").alias("k", "own"))
        text = lambda part: F.array_join(F.transform(part, lambda x: x["digest"]), "")
        linked.append(
            one.select(
                "tree", F.lit(level).alias("level"), "own.idx",
                F.col("tree").alias("up_tree"), F.lit(level + 1).alias("up_level"), F.col("run").alias("up_idx"),
                text(F.slice("of", F.lit(1), F.col("k"))).alias("lefts"), text(F.slice("of", F.col("k") + 2, F.lit(FAN))).alias("rights"),
            )
        )
        nodes = runs.select("tree", F.col("run").alias("idx"), F.sha2(text(F.col("of")), 256).alias("digest"))
        level += 1


def manifest(docs: DataFrame, columns: tuple[str, ...], doc_id: str = "doc_id", group: str = "lang", tampered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    ``columns`` make the leaf.  ``tampered`` gives other values of some of them; the leaf of these is
    folded with the untampered siblings to ``folded_root``, which is the root if nothing was changed.
    """
    spark = docs.sparkSession
    own = [F.col(f"`{c}`") for c in columns]
    other = [(tampered or {}).get(c, F.col(f"`{c}`")) for c in columns]
    changed = reduce(Column.__or__, [~a.eqNullSafe(b) for a, b in zip(own, other)])
    told = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{group}`").cast("string").alias("_group"),
        leaf(own).alias("leaf"), F.when(changed, leaf(other)).alias("now"),
    )
    told = written(told.withColumn("now", F.coalesce("now", "leaf")), "digests")
    placed = ranked(told, "_group", ["doc_id", "leaf"], "leaves")
    discard(told)
    names = ranked(placed.select("_group").distinct().withColumn("_all", F.lit(0)), "_all", ["_group"], "trees").select(F.col("_group").alias("_g"), F.col("pos").alias("tree"))
    names = written(names, "trees")
    placed = placed.join(names, placed["_group"].eqNullSafe(names["_g"])).select("doc_id", "leaf", "now", "tree", F.col("pos").alias("idx"))
    # The leaves of a run climb together: digest, what it is now, and its siblings in the run.
    runs = placed.groupBy("tree", F.floor(F.col("idx") / FAN).alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "leaf", "now", "doc_id"))).alias("of"))
    runs = written(runs, "leaf-runs")
    if runs.isEmpty():
        empty = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return spark.createDataFrame([], empty)
    sizes = runs.groupBy("tree").agg(F.max("run").alias("_last"), F.max(F.size("of")).alias("_most"))
    lone = sizes.where("_last = 0 AND _most = 1").select("tree", F.lit(True).alias("lone"))
    runs = written(runs.join(lone, "tree", "left").withColumn("lone", F.coalesce("lone", F.lit(False))), "leaf-runs-of")
    leaves = lambda part: F.array_join(F.transform(part, lambda x: x["leaf"]), "")
    whole = F.when(F.col("lone"), F.col("of")[0]["leaf"]).otherwise(F.sha2(leaves(F.col("of")), 256))
    linked, roots = _levels(runs.select("tree", F.col("run").alias("idx"), whole.alias("digest")), "nodes")
    # Subroots are the leaves of the top tree; their rows in it are linked under their own place.
    tops, top_root = _levels(roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest"), "top")
    root = top_root.first()
    if tops:
        first = roots.select(F.col("tree").alias("_t"), F.col("level").alias("_l"))
        lowest = tops[0].join(first, F.col("idx") == F.col("_t"))
        tops[0] = lowest.select(F.col("_t").alias("tree"), F.col("_l").alias("level"), F.lit(0).cast("long").alias("idx"), "up_tree", "up_level", "up_idx", "lefts", "rights")
        end = (TOP, root["level"])
    else:
        only = roots.first()
        end = (only["tree"], only["level"])
    nodes = reduce(DataFrame.unionByName, [*linked, *tops]) if linked or tops else None
    folded = F.transform(
        F.sequence(F.lit(0), F.size("of") - 1),
        lambda i: F.when(F.col("lone"), F.get("of", i)["now"]).otherwise(
            F.sha2(F.concat(leaves(F.slice("of", F.lit(1), i)), F.get("of", i)["now"], leaves(F.slice("of", i + 2, F.lit(FAN)))), 256)
        ),
    )
    starts = runs.select(F.col("tree").alias("grp"), "run", "tree", F.lit(0).alias("level"), F.col("run").alias("idx"), folded.alias("folds"))
    if nodes is None:
        climbed = starts.select("grp", "run", "folds", F.lit("").alias("above"))
    else:
        climbed = _climb(written(starts, "climb-starts"), written(nodes, "climb-nodes"), end)
    subroots = roots.select(F.col("tree").alias("_t"), F.col("digest").alias("subroot"))
    out = runs.join(climbed, (F.col("tree") == F.col("grp")) & (runs["run"] == climbed["run"])).join(subroots, F.col("tree") == F.col("_t"))
    out = out.select("of", "folds", "above", "lone", "subroot", F.posexplode("of").alias("k", "own"))
    siblings = F.when(F.col("lone"), F.lit("")).otherwise(F.concat(leaves(F.slice("of", F.lit(1), F.col("k"))), leaves(F.slice("of", F.col("k") + 2, F.lit(FAN)))))
    out = out.select(
        "own.doc_id", "own.leaf", "subroot", F.lit(root["digest"]).alias("root"),
        F.sha2(F.concat(siblings, "above"), 256).alias("proof_sha256"), F.get("folds", F.col("k")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _climb(starts: DataFrame, nodes: DataFrame, end: tuple[int, int]) -> DataFrame:
    """The recursive query; it ends where no stored row is linked further, which is the root."""
    spark = starts.sparkSession
    names = {"starts": f"starts_{uuid.uuid4().hex}", "nodes": f"nodes_{uuid.uuid4().hex}"}
    starts.createOrReplaceTempView(names["starts"])
    nodes.createOrReplaceTempView(names["nodes"])
    try:
        with settings(spark, ANY_SIZE):
            return written(spark.sql(CLIMB.format(**names, tree=end[0], level=end[1])), "climbed")
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def lower_case_tampering(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text with A-Z lower-cased in rows where 3 divides the crc32 of the decimal id; null ids stay as they are."""
    struck = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3 == 0
    return F.when(struck, ascii_lower(F.col(f"`{text}`"))).otherwise(F.col(f"`{text}`"))
