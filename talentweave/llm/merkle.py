"""Merkle manifest of a dataset by superblock reduction.

Every row is a leaf of its group's tree; leaves stand in key order. With a fanout f, the nodes of a level are dealt to
buckets by index div f^k; applyInPandas collapses k levels in each bucket, and the buckets' roots are the nodes of the
next round. A proof is the lower part inside a row's bucket followed by the proof of the bucket's root. The groups'
roots, in the groups' order, are the leaves of the tree on top.

A bucket holds f^k nodes at most, whatever share of the rows a group has; indices come from counts of range partitions,
so no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.llm.common import cut

#: Children of a node; levels that a bucket collapses.
FANOUT, LEVELS = 16, 2
#: A proof from below: the digests on the left and on the right of the node in its run, level by level.
PROOF = "array<struct<before: array<string>, after: array<string>>>"


def digest(*columns: str | Column) -> Column:
    """Lowercase hex SHA-256 of the values: "-" for a null, else UTF-8 byte count, a colon and the value as text."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _hash(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def collapse(nodes: list[str], fanout: int, levels: int) -> list[list[str]]:
    """The levels of a bucket from its nodes up: `levels` of them above the lowest."""
    out = [nodes]
    for _ in range(levels):
        low = out[-1]
        out.append([_hash(low[i : i + fanout]) for i in range(0, len(low), fanout)])
    return out


def height(n: int, fanout: int) -> int:
    """Levels above n leaves until one node remains."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def manifest(df: DataFrame, leaf: Column, key: str, group: str, tampered: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(key, group, leaf, index, subroot, root, proof) of every row, and `tampered`, another digest of the row, if given.

    Leaves of a group ascend by key, null first, then by digest, so repeated rows stand beside each other. While several
    nodes remain, every `fanout` consecutive ones become their digest (the last run may be shorter, even one node); what
    remains is the group's subroot. The subroots by group, null first, in the order of UTF-8 bytes, likewise give the
    root. proof: PROOF from the leaf to the root; a run of one node has an empty entry. An empty table gives no rows;
    other columns go.
    """
    # Rows are digested once; what follows reads digests, not texts.
    own = cut(df.select(F.col(group).alias("grp"), F.col(key).alias("key"), leaf.alias("node"), *([tampered.alias("tampered")] if tampered is not None else [])))
    leaves = _numbered(own, ["grp"], ["key", "node"])
    subroots, lower = _reduce(leaves, fanout, levels)
    tops = _numbered(subroots.select(F.lit(0).alias("one"), "grp", "node"), ["one"], ["grp"])
    roots, upper = _reduce(tops.withColumnsRenamed({"grp": "member", "one": "grp"}), fanout, levels)
    # A row a group: its subroot, the root and the proof between them.
    crown = upper(None).select(F.col("member").alias("of"), F.col("node").alias("subroot"), F.col("proof").alias("above"))
    crown = crown.join(F.broadcast(roots.select(F.col("node").alias("root"))), how="cross")
    rows = lower(crown)
    kept = ["subroot", "root", "proof", *(["tampered"] if tampered is not None else [])]
    return rows.select(F.col("key").alias(key), F.col("grp").alias(group), F.col("node").alias("leaf"), F.col("idx").alias("index"), *kept)


def folded(node: str = "leaf", proof: str = "proof") -> Column:
    """The root that a leaf and its proof give."""
    return F.expr(f"aggregate({proof}, {node}, (n, p) -> sha2(concat(array_join(p.before, ''), n, array_join(p.after, '')), 256))")


def siblings(proof: str = "proof") -> Column:
    """The digests of a proof, level by level, from left to right."""
    return F.expr(f"array_join(flatten(transform({proof}, p -> concat(p.before, p.after))), '')")


def changed(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """(group, old_root, new_root): groups whose subroots differ between two manifests; null where one lacks the group."""
    roots = lambda m, name: m.groupBy(F.col(group).alias("g")).agg(F.min("subroot").alias(name))
    both = roots(old, "old_root").alias("o").join(roots(new, "new_root").alias("n"), F.col("o.g").eqNullSafe(F.col("n.g")), "full")
    differ = ~F.col("old_root").eqNullSafe(F.col("new_root"))
    return both.where(differ).select(F.coalesce("o.g", "n.g").alias(group), "old_root", "new_root")


def _numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows with idx, their place in the group from 0, and n, the group's rows; written to the shared folder.

    Rows are ranged by group and order, and counted a range and group: places follow from those counts, so a group of
    any share of the rows is numbered by many tasks.
    """
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    at = F.monotonically_increasing_id()
    placed = cut(ranged.withColumns({"part": F.shiftright(at, 33).cast("int"), "pos": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    # A row for each group and range that it is in.
    same = [F.col(c).alias(f"_{c}") for c in by]
    counts = placed.groupBy(*same, F.col("part").alias("_part")).agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("first"))
    w = Window.partitionBy(*[f"_{c}" for c in by])
    before = F.coalesce(F.sum("c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumns({"shift": before - F.col("first"), "n": F.sum("c").over(w)}).drop("c", "first")
    meet = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    joined = placed.join(starts, [F.col("part") == F.col("_part"), *meet])
    return cut(joined.withColumn("idx", F.col("pos") + F.col("shift")).drop("part", "pos", "shift", "_part", *[f"_{c}" for c in by]))


def _reduce(leaves: DataFrame, fanout: int, levels: int) -> tuple[DataFrame, Callable[[DataFrame | None], DataFrame]]:
    """(roots, proofs): the root of each group (grp, node), and a function that gives the leaves with their proofs from a
    table (of, subroot, root, above) of what lies above the groups' roots, or from None."""
    wide = fanout**levels
    rounds = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        rounds.append(cut(_roots(rounds[-1], fanout, levels)))
        most = -(-most // wide)
    roots = rounds[-1].select("grp", "node") if len(rounds) > 1 else leaves.select("grp", "node")

    def proofs(crown: DataFrame | None) -> DataFrame:
        # Groups of one node carry their row up unchanged, so every group stands in the last round.
        top = rounds[-1]
        above = top.withColumn("proof", F.lit(None).cast(PROOF)) if crown is None else None
        if crown is not None:
            above = top.join(crown, top["grp"].eqNullSafe(crown["of"])).withColumnRenamed("above", "proof").drop("of")
        above = above.withColumn("proof", F.coalesce("proof", F.expr(f"cast(array() as {PROOF})")))
        for low in reversed(rounds[:-1]):
            above = _below(low, above, fanout, levels)
        return above

    return roots, proofs


def _height(n: int, fanout: int, levels: int) -> int:
    """Levels that a bucket of a group of n nodes collapses: all, or those until one node remains."""
    return levels if n > fanout**levels else height(n, fanout)


def _roots(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(grp, idx, n, node): the roots of all buckets, numbered as nodes of the next round."""
    wide = fanout**levels
    kind = dict(nodes.dtypes)["grp"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        n = int(frame["n"].iloc[0])
        root = collapse(frame["node"].tolist(), fanout, _height(n, fanout, levels))[-1][0]
        return pd.DataFrame({"grp": [frame["grp"].iloc[0]], "idx": [int(frame["idx"].iloc[0]) // wide], "n": [-(-n // wide)], "node": [root]})

    keyed = nodes.select("grp", "idx", "n", "node", F.expr(f"idx div {wide}").alias("bucket"))
    return keyed.groupBy("grp", "bucket").applyInPandas(run, f"grp {kind}, idx long, n long, node string")


def _below(low: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The rows of a round with their proofs: inside their bucket, then that of the bucket's root."""
    wide = fanout**levels
    extra = [f for f in low.schema if f.name not in ("grp", "idx", "n", "node")]
    schema = ", ".join([f"grp {dict(low.dtypes)['grp']}, idx long, n long, node string, inner {PROOF}", *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        tree = collapse(frame["node"].tolist(), fanout, _height(int(frame["n"].iloc[0]), fanout, levels))
        inner = []
        for place in range(len(frame)):
            steps = []
            for level in tree[:-1]:
                a = place // fanout * fanout
                steps.append({"before": level[a:place], "after": level[place + 1 : a + fanout]})
                place //= fanout
            inner.append(steps)
        return frame.drop(columns="bucket").assign(inner=inner)

    rows = low.withColumn("bucket", F.expr(f"idx div {wide}")).groupBy("grp", "bucket").applyInPandas(run, schema)
    carried = [c for c in above.columns if c in ("subroot", "root")]
    upper = above.select(F.col("grp").alias("_g"), F.col("idx").alias("_b"), F.col("proof").alias("_above"), *carried)
    met = rows.join(upper, [F.col("grp").eqNullSafe(F.col("_g")), F.expr(f"idx div {wide}") == F.col("_b")])
    return met.withColumn("proof", F.concat("inner", "_above")).drop("_g", "_b", "_above", "inner")
