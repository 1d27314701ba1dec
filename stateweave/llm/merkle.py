"""A manifest of a dataset as a tree of digests, with a proof for each row.

Rows of a partition (a language, say) are leaves in the order of their ids; two consecutive nodes become one until one
is left, and the partitions' tops likewise become the root.  The tree is built bottom-up, ten levels at a time: 1,024
consecutive nodes are one row of a persisted level, whatever partition they belong to, so a partition that holds all
rows is as many rows as any.  Proofs are pushed top-down: each persisted level is joined to the level above, and a child
puts its own siblings before those that its parent has inherited.  All of it is DataFrame code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .store import stored

#: Levels that one persisted row spans: 2 ** 10 nodes.
SPAN = 10


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts' concatenation; null parts count as nothing."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(x: Column) -> Column:
    """A value such that fields can't run into each other: ``-`` if null, else UTF-8 byte count, colon, value."""
    text = x.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _levels(nodes: Column, height: Column) -> Column:
    """The nodes' level and the ``height`` levels above it, each an array of digests."""

    def above(levels: Column, _: Column) -> Column:
        def join(top: Column) -> Column:
            pairs = F.sequence(F.lit(0), F.floor((F.size(top) - 1) / 2).cast("int"))
            return F.transform(pairs, lambda i: digest(F.get(top, 2 * i), F.get(top, 2 * i + 1)))

        return F.concat(levels, F.transform(F.slice(levels, -1, 1), join))

    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), above)


def _siblings(levels: Column, place: Column, height: Column) -> Column:
    """For each level below the top: the sibling's digest, or null for the last of an odd run."""
    steps = F.when(height > 0, F.sequence(F.lit(0), height - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.get(F.get(levels, k), F.call_function("shiftright", place, k).bitwiseXOR(F.lit(1))))


def fold(leaf: Column, siblings: Column, place: Column) -> Column:
    """The top that follows from a leaf at ``place`` (long) and its siblings."""

    def step(node: Column, k: Column) -> Column:
        other, right = F.get(siblings, k), F.call_function("shiftright", place, k).bitwiseAND(F.lit(1)) == 1
        return F.when(right, digest(other, node)).otherwise(digest(node, other))

    steps = F.when(F.size(siblings) > 0, F.sequence(F.lit(0), F.size(siblings) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, leaf, step)


@dataclass
class Forest:
    """A tree over each group of leaves: what is persisted of it, and its top."""

    groups: list[str]
    blocks: list[DataFrame]
    tops: DataFrame

    @staticmethod
    def build(leaves: DataFrame, groups: list[str], place: str, node: str, carry: list[str]) -> Forest:
        """Trees over the groups (columns without nulls) of ``leaves`` by their ``place`` (from 0); ``carry``: columns that stay with the leaves."""
        level = leaves.select(*groups, F.col(place).alias("place"), F.col(node).alias("node"), F.struct(*carry).alias("own"))
        blocks, tops = [], None
        while True:
            n = (F.max("place") + 1).alias("n")  # of the whole group: how many levels are left
            counts = level.groupBy(*groups).agg(n)
            below = level.groupBy(*groups, F.shiftright("place", SPAN).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "node", "own"))).alias("members"))
            rows = below.join(counts, groups)
            # the smallest number of levels after which one node is left, SPAN at most
            height = F.when(F.col("n") == 1, F.lit(0)).otherwise(F.least(F.lit(SPAN), F.length(F.bin(F.col("n") - 1))))
            rows = rows.withColumn("height", height).withColumn("levels", _levels(F.col("members.node"), F.col("height")))
            rows = stored(rows.select(*groups, "block", "n", "height", F.col("members.own").alias("own"), "levels"))
            blocks.append(rows)
            top = rows.select(*groups, F.col("block").alias("place"), F.get(F.element_at("levels", -1), F.lit(0)).alias("node"), "n")
            done = top.where(F.col("n") <= 1 << SPAN).select(*groups, "node")
            tops = done if tops is None else tops.unionByName(done)
            level = top.where(F.col("n") > 1 << SPAN).select(*groups, "place", "node", F.struct(F.lit(0).alias("none")).alias("own"))
            if not level.limit(1).count():
                return Forest(groups, blocks, tops)

    def proofs(self) -> DataFrame:
        """The groups' columns, the carried ones, ``place`` and ``siblings`` (from the leaf's up) of every leaf."""
        inherited, out = None, None
        for depth in range(len(self.blocks) - 1, -1, -1):
            rows = self.blocks[depth]
            if inherited is not None:
                rows = rows.join(inherited, [*self.groups, "block"], "left").withColumn("suffix", F.coalesce("suffix", F.array().cast("array<string>")))
            else:
                rows = rows.withColumn("suffix", F.array().cast("array<string>"))
            size = F.size("own")

            def members(levels: Column) -> Column:
                # bound once for all members of the block
                return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(i.cast("bigint").alias("i"), F.get(F.col("own"), i).alias("own"), F.concat(_siblings(levels, i, F.col("height")), F.col("suffix")).alias("siblings")))  # noqa: B023

            each = F.explode(F.get(F.transform(F.array(F.col("levels")), members), F.lit(0))).alias("m")
            out = rows.select(*self.groups, "block", each)
            place = F.shiftleft(F.col("block"), SPAN) + F.col("m.i")
            if depth:
                inherited = stored(out.select(*self.groups, place.alias("block"), F.col("m.siblings").alias("suffix")))
            else:
                out = out.select(*self.groups, place.alias("place"), F.col("m.own").alias("own"), F.col("m.siblings").alias("siblings"))
        return out


def manifest(docs: DataFrame, id_col: str = "doc_id", part_col: str = "lang", fields: list[str] | None = None, tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """Digests and proof of every row: ``id_col``, leaf, subroot, root, proof_sha256, folded_root, verified, proof.

    ``fields``: the columns that a leaf covers, in order (``doc_id, source, lang, n_chars, text``).  ``tampered``: what
    some of them are replaced by where ``when`` is true; ``folded_root`` is then recomputed from the tampered leaf and
    the siblings of the true tree, and ``verified`` says whether it is the root.  ``proof`` is the list of siblings from
    the leaf's up (null where a run was odd), with ``place`` and ``part_place`` the leaf's and its part's places.

    Scale: rows are digested where they are read and only digests travel.  Leaves are numbered by ranges, not by a
    window over a part.  Each further step handles a thousandth of the rows of the one before.

    Nulls in any column are a value of their own: a null part comes first, null ids come first in a part, and null
    fields stay null when tampered with.  Rows that repeat have equal leaves and places of their own; rows that share an
    id are ordered by leaf.  An empty table gives an empty result.  Other columns are ignored.
    """
    fields = fields or [id_col, "source", part_col, "n_chars", "text"]
    cover = lambda change: digest(*[field(change.get(c, F.col(f"`{c}`"))) for c in fields])
    part = F.col(f"`{part_col}`").cast("string")
    other = F.when(when, cover(tampered)) if tampered else F.lit(None).cast("string")
    leaves = docs.select(part.isNotNull().alias("named"), F.coalesce(part, F.lit("")).alias("part"), F.col(f"`{id_col}`").alias("id"), cover({}).alias("leaf"), other.alias("other"))
    leaves = numbered(leaves, [F.col("id").asc_nulls_first(), F.col("leaf")], "place", ["named", "part"])
    parts = Forest.build(leaves, ["named", "part"], "place", "leaf", ["id", "leaf", "other"])
    subroots = stored(parts.tops.withColumnRenamed("node", "subroot"))
    ordered = numbered(subroots, [F.col("named"), F.col("part")], "place").withColumn("all", F.lit(0))
    whole = Forest.build(ordered, ["all"], "place", "subroot", ["named", "part", "subroot"])
    above = whole.proofs().join(whole.tops.withColumnRenamed("node", "root"), "all")
    above = stored(above.select("own.*", F.col("place").alias("part_place"), F.col("siblings").alias("above"), "root"))
    rows = parts.proofs().join(above, ["named", "part"]).select("own.*", "place", "siblings", "part_place", "above", "subroot", "root")
    folded = fold(fold(F.coalesce("other", "leaf"), F.col("siblings"), F.col("place")), F.col("above"), F.col("part_place"))
    rows = rows.withColumn("folded_root", folded).withColumn("proof", F.concat("siblings", "above"))
    return rows.select(F.col("id").alias(id_col), "leaf", "subroot", "root", digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "proof", "place", "part_place")

