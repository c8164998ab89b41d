"""Merkle manifest of a dataset: a tree per group, a tree over the groups' roots, and a proof for every row.

The upper levels are a butterfly exchange. Rows stand in aligned partitions; in each round the partitions below one parent swap the
roots of their subtrees and all hash the parent, so that after the last round each of them holds the root and every sibling on its own
way up. Nothing is sent down again.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.common import ordered_scan

from .common import stored

FANOUT = 8
#: Leaves of a partition: a power of the fanout, so that a partition is a whole subtree.
LEAVES = FANOUT**4
#: Parts over which the partitions of one group are spread where they are told the place of their group.
SALT = 64


def field(column: str | Column) -> Column:
    """A value as a part of a leaf: `-` for null, else its bytes in UTF-8 (integers as decimals) after their number and a colon."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[str | Column]) -> Column:
    """Lower-case hex SHA-256 of a row."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(leaves: list[str], fanout: int, heights: int | None) -> list[list[str]]:
    """The levels of a subtree from its leaves up, `heights` of them above, or up to a single node."""
    levels = [leaves]
    while len(levels) - 1 < heights if heights is not None else len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([digest(now[i : i + fanout]) for i in range(0, len(now), fanout)])
    return levels


def _subtree(block: int, leaves: list[str], fanout: int, size: int) -> list[list[str]]:
    """The levels of one partition: all of its height, or only up to one node where it is the whole of its group."""
    height = 0
    while fanout**height < size:
        height += 1
    return _levels(leaves, fanout, None if block == 0 and len(leaves) < size else height)


def _exchange(state: DataFrame, fanout: int, round_: int) -> DataFrame:
    """One round: every partition sends the root of its subtree to partitions below the same parent, and hashes what it receives.

    `sizes[round_]` of a partition holds how many partitions stand below each child of its parent, `mine[round_]` its own child and
    `spot[round_]` its place there. Place p of a child sends to the places p, p + n, p + 2n ... of a sibling, n the size of its own
    child: each partition gets one root from every sibling, and where a sibling is small its few members share the sending.
    """
    mine, spot, sizes = F.get("mine", F.lit(round_)), F.get("spot", F.lit(round_)), F.get("sizes", F.lit(round_))
    open_ = state.filter(F.size("sizes") > round_)
    targets = F.filter(F.transform(sizes, lambda n, j: F.struct(j.alias("child"), n.alias("n"))), lambda t: (t["child"] != mine) & (t["n"] > spot))
    sent = open_.select(
        F.get("base", F.lit(round_)).alias("_base"), mine.cast("int").alias("_child"), spot.alias("_spot"), sizes.alias("_sizes"), F.col("root").alias("_root"), F.explode(targets).alias("_to")
    )
    before = F.aggregate(F.slice("_sizes", F.lit(1), F.col("_to")["child"]), F.lit(0).cast("long"), lambda a, x: a + x)
    places = F.explode(F.sequence(F.col("_spot"), F.col("_to")["n"] - 1, F.element_at("_sizes", F.col("_child") + 1)))
    spread = sent.select((F.col("_base") + before).alias("_start"), F.struct(F.col("_child").alias("child"), F.col("_root").alias("root")).alias("got"), places.alias("_place"))
    messages = spread.select((F.col("_start") + F.col("_place")).alias("id"), "got")
    heard = messages.groupBy("id").agg(F.sort_array(F.collect_list("got")).alias("heard"))  # one from each sibling, fewer than the fanout
    known = F.sort_array(F.concat(F.coalesce("heard", F.array().cast("array<struct<child:int,root:string>>")), F.array(F.struct(mine.cast("int").alias("child"), F.col("root").alias("root")))))
    roots = F.transform(known, lambda x: x["root"])
    live = F.size("sizes") > round_
    step_up = F.struct(mine.cast("int").alias("place"), roots.alias("run"))
    joined = state.join(heard, "id", "left").withColumn("_known", F.when(live, step_up))
    path = F.when(live, F.concat("path", F.array(F.col("_known")))).otherwise(F.col("path"))
    parent = F.when(live, F.sha2(F.array_join(F.col("_known")["run"], ""), 256)).otherwise(F.col("root"))
    return joined.select("g", "block", "id", "sizes", "mine", "spot", "base", parent.alias("root"), path.alias("path"), *(["subroot"] if "subroot" in state.columns else []))


def _rounds(count: Column, at: Column, size_of, fanout: int, depth: int) -> Column:
    """The rounds of a tree of `count` nodes for the node `at`: structs (child, sizes of the children as numbers of nodes, first node).

    In round r the node's subtree covers fanout^r nodes; siblings are the subtrees below the same parent. `size_of(a, b)` says how many
    partitions stand in the nodes a to b - 1.
    """

    def one(r):
        span = F.pow(F.lit(fanout), r).cast("long")
        first = F.floor(at / (span * fanout)).cast("long") * span * fanout
        ends = F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda j: first + j * span)
        real = F.filter(ends, lambda a: a < count)
        return F.struct(
            F.floor((at - first) / span).cast("long").alias("child"), F.transform(real, lambda a: size_of(a, F.least(a + span, count))).alias("sizes"),
            first.alias("first"), F.floor(at / span).cast("long").alias("node"), span.alias("span"),
        )

    need = F.filter(F.sequence(F.lit(0), F.lit(depth)), lambda r: F.pow(F.lit(fanout), r).cast("long") < count)
    return F.transform(need, one)


def _depth(n: int, fanout: int) -> int:
    depth = 0
    while fanout**depth < n:
        depth += 1
    return depth


def _places(groups: DataFrame, fanout: int, leaves: int) -> tuple[DataFrame, int, int]:
    """(g, n, blocks, before, total, higher) per group in order, and the rounds that groups and the tree over them take.

    `higher` tells for each round of the tree over the groups which child the group is below and how many partitions stand below each.
    """
    counted = groups.withColumn("blocks", F.ceil(F.col("n") / leaves).cast("long"))
    ranked = stored(ordered_scan(counted, ["g"], sums={"before": "blocks"}).withColumn("at", F.col("rn") - 1).drop("rn"), "merkle-groups")
    count, total, most = ranked.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    depth = _depth(count, fanout)
    out = ranked.withColumn("higher", F.array().cast("array<struct<child:bigint,sizes:array<bigint>,first:bigint,start:bigint>>"))
    for r in range(depth):  # a round: the groups below one parent, by sums of the groups below each child
        span = fanout**r
        nodes = ranked.groupBy(F.floor(F.col("at") / span).alias("node")).agg(F.sum("blocks").alias("size"), F.min("before").alias("start"))
        runs = nodes.groupBy(F.floor(F.col("node") / fanout).alias("parent")).agg(F.sort_array(F.collect_list(F.struct("node", "size"))).alias("run"), F.min("start").alias("base"))
        own = nodes.select("node", "start", F.floor(F.col("node") / fanout).alias("parent")).join(runs, "parent")
        told = own.select(
            F.col("node").alias("_node"), F.struct(F.pmod("node", F.lit(fanout)).cast("long").alias("child"), F.transform("run", lambda x: x["size"]).alias("sizes"), F.col("base").alias("first"), F.col("start").alias("start")).alias("_told")
        )
        out = out.join(told, F.floor(F.col("at") / span) == F.col("_node")).withColumn("higher", F.concat("higher", F.array("_told"))).drop("_node", "_told")
    return stored(out, "merkle-places") if depth else out, _depth(most, fanout), depth


def manifest(
    rows: DataFrame, order: list[str], leaf_col: str = "leaf", group: str = "g", check: str | None = None, fanout: int = FANOUT, leaves: int = LEAVES
) -> DataFrame:
    """`rows` with (position, subroot, root, proof_sha256, folded_root, verified): a tree per `group`, and one over the groups' roots.

    `leaf_col` holds the leaves, `check` (else `leaf_col`) those that the proofs are tried with: `folded_root` is what they lead to by the
    siblings of the way up, and `verified` says whether that is the root. Leaves stand in `order` within their group (nulls first, ties by
    the leaf; rows that are equal in all this have the same proof whichever comes first). Every `fanout` consecutive nodes of a level
    become their digest, a last shorter run too, even one node, until one node is left; a lone leaf is itself the root of its group.
    Groups are ordered bytewise, null first. `proof_sha256` is the digest of all siblings of the way up, of an empty text if there are none.
    An empty table gives no rows. Names of the result that `rows` has are replaced.

    `leaves`, a power of `fanout`, is the size of a partition: rows are dealt by (group, position div leaves), so that a group of a third
    of all rows is many partitions. Only partitions (one row for `leaves` rows) take part in the exchange.
    """
    made = ["position", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    held = rows.select(*[c for c in rows.columns if c not in made])
    ranked = ordered_scan(held, [*order, leaf_col], [group])
    placed = ranked.select(
        *held.columns, (F.col("rn") - 1).alias("position"), F.floor((F.col("rn") - 1) / leaves).cast("long").alias("_block"),
        F.coalesce(F.concat(F.lit("+"), F.col(group)), F.lit("")).alias("_g"), F.col(leaf_col).alias("_leaf"), F.col(check or leaf_col).alias("_tried"),
    )

    def root_of(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["_block"].iloc[0])
        top = _subtree(block, list(pdf.sort_values("position")["_leaf"]), fanout, leaves)[-1][0]
        return pd.DataFrame({"g": [pdf["_g"].iloc[0]], "block": [block], "root": [top], "held": [len(pdf)]})

    blocks = stored(placed.select("_g", "_block", "position", "_leaf").groupBy("_g", "_block").applyInPandas(root_of, "g string, block long, root string, held long"), "merkle-blocks")
    groups, low_rounds, high_rounds = _places(blocks.groupBy("g").agg(F.sum("held").alias("n")), fanout, leaves)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    known = blocks.withColumn("salt", F.pmod("block", F.lit(SALT)).cast("int")).join(salted, ["g", "salt"])
    low = _rounds(F.col("blocks"), F.col("block"), lambda a, b: b - a, fanout, max(low_rounds - 1, 0))
    state = known.select(
        "g", "block", (F.col("before") + F.col("block")).alias("id"), "root", F.array().cast("array<struct<place:int,run:array<string>>>").alias("path"),
        low.alias("_low"), "higher", "before",
    ).select(
        "g", "block", "id", "root", "path", "higher", F.transform("_low", lambda x: x["sizes"]).alias("sizes"), F.transform("_low", lambda x: x["child"]).alias("mine"),
        F.transform("_low", lambda x: F.col("block") - x["node"] * x["span"]).alias("spot"), F.transform("_low", lambda x: F.col("before") + x["first"]).alias("base"),
    )
    upper = state.select("id", "higher")
    state = state.drop("higher")
    for r in range(low_rounds):
        state = stored(_exchange(state, fanout, r), "merkle-round")
    state = state.withColumn("subroot", F.col("root")).select("g", "block", "id", "root", "path", "subroot").join(upper, "id").select(
        "g", "block", "id", "root", "path", "subroot", F.transform("higher", lambda x: x["sizes"]).alias("sizes"), F.transform("higher", lambda x: x["child"]).alias("mine"),
        F.transform("higher", lambda x: F.col("id") - x["start"]).alias("spot"), F.transform("higher", lambda x: x["first"]).alias("base"),
    )
    for r in range(high_rounds):
        state = stored(_exchange(state, fanout, r), "merkle-round")
    ways = state.select(F.col("g").alias("_g"), F.col("block").alias("_block"), "subroot", "root", "path")

    kept = [*held.columns, "position"]

    def prove(mine: pa.Table, way: pa.Table) -> pa.Table:
        mine, w = mine.sort_by("position"), way.to_pylist()[0]
        levels = _subtree(mine["_block"][0].as_py(), mine["_leaf"].to_pylist(), fanout, leaves)
        above = [(s["place"], s["run"]) for s in w["path"]]
        proofs, folded = [], []
        for i, now in enumerate(mine["_tried"].to_pylist()):
            siblings = []
            for level in levels[:-1]:
                start = i // fanout * fanout
                run, at = level[start : start + fanout], i - start
                i //= fanout
                siblings += run[:at] + run[at + 1 :]
                now = digest([*run[:at], now, *run[at + 1 :]])
            for at, run in above:
                siblings += run[:at] + run[at + 1 :]
                now = digest([*run[:at], now, *run[at + 1 :]])
            proofs.append(digest(siblings))
            folded.append(now)
        n = mine.num_rows
        out = {"subroot": [w["subroot"]] * n, "root": [w["root"]] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [f == w["root"] for f in folded]}
        return pa.table([mine[c] for c in kept] + [pa.array(v) for v in out.values()], names=[*kept, *out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    schema = f"{kinds}, position long, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return placed.groupBy("_g", "_block").cogroup(ways.groupBy("_g", "_block")).applyInArrow(prove, schema)


def document_manifest(docs: DataFrame, doc_id: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, g, leaf, tried, ...) of `manifest` for whole rows: leaves of `columns`, by group in the order of ids.

    `tampered` maps columns to what they are replaced by before the proofs are tried. Other columns of `docs` are not read; a text of
    any length is digested whole. Rows that repeat an id, also a null one, are leaves of their own.
    """
    tried = leaf([(tampered or {}).get(c, F.col(c)) for c in columns])
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(group).alias("g"), leaf(list(columns)).alias("leaf"), tried.alias("tried"))
    return manifest(stored(base, "merkle-leaves"), ["doc_id"], check="tried")
