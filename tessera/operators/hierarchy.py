"""Parent-child links into full hierarchies.

Leaves are peeled from the bottom up, round by round; each sends the size of its subtree to its parent
and leaves for good. So that a chain of length h does not cost h rounds, links of a chain (nodes with
one child left) are spliced out in the same rounds: the child takes over the link to the grandparent,
with the number, the names and the subtree sizes of what it skips. What is never peeled are cycles;
splicing shrinks each to one node that is its own parent. The rounds shrink geometrically, and what
has left is written once. In reverse order of leaving every node then gets root, depth, size and path
from one node that left later: a peeled one from its parent, a spliced one from the child below it.
Once at most ``core`` nodes remain (they are counted as they are written) one task peels those.

Defined results: ids are compared without case and outer blanks and shown as stored; an empty or
null parent is none; a node that is its own parent is a cycle of one; rows with a null id are left
out; of several rows of an id the one of highest ``valid_by`` counts; of several stored spellings of
one id the smallest is linked to. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.references import BLANKS
from tessera.session import cut_lineage, cut_lineage_counting, release

#: Nodes left from which one task peels the rest; a constant, whatever the size of the input.
CORE = 8192
_FOUND = "k string, root string, depth bigint, size bigint, state string, path array<string>, ring array<string>"


def _link(name: str) -> Column:
    text = F.lower(F.btrim(F.col(name), F.lit(BLANKS)))
    return F.when(text != "", text)


def _spread(key: str, own: str) -> Column:
    """A join key whose nulls match nothing and do not all meet in one partition."""
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.col(own)))


def links(rows: DataFrame, node: str, parent: str, valid_by: tuple[str, ...]) -> DataFrame:
    """(id, k, p, known): stored id, its link form, that of its parent, and whether the parent exists."""
    rank = F.struct(*valid_by)
    valid = rows.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.max_by(parent, rank).alias("parent"))
    valid = valid.select("id", F.coalesce(_link("id"), F.lit("")).alias("k"), _link("parent").alias("p")).withColumn("_at", _spread("p", "k"))
    keys = valid.select(F.col("k").alias("_at")).distinct().withColumn("known", F.lit(True))
    return valid.join(keys, "_at", "left").select("id", "k", "p", F.coalesce("known", F.lit(False)).alias("known"))


def _coin(key: str, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(turn)), F.lit(2)) == 1


def _start(one: DataFrame, paths: bool) -> DataFrame:
    """The nodes before the first round. one: k, id, p, known.

    p: the node the link leads to; kids: children left; w: size of the node with all that was peeled
    below it; e, steps, least, names: what the link skips: their sizes, its length, the smallest id,
    the ids from the top down.
    """
    kids = one.where("known").groupBy(F.col("p").alias("k")).agg(F.count(F.lit(1)).alias("kids"))
    names = F.expr("cast(array() as array<string>)") if paths else F.lit(None).cast("array<string>")
    zero, first = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return one.join(kids, "k", "left").select(
        "k", "id", F.when(F.col("known"), F.col("p")).alias("p"), (F.col("p").isNotNull() & ~F.col("known")).alias("dangling"), F.coalesce("kids", zero).alias("kids"),
        first.alias("w"), zero.alias("e"), first.alias("steps"), F.lit(None).cast("string").alias("least"), names.alias("names"),
    )


def _peel_round(state: DataFrame, turn: int) -> DataFrame:
    """One round: the nodes with ``left`` telling how they leave it (peeled, cycle or null), and on a child
    the node spliced out above it as ``cut``."""
    sent = state.where("p is not null and p <> k").groupBy(F.col("p").alias("k")).agg(F.count(F.when(F.col("kids") == 0, 1)).alias("gone"), F.sum(F.when(F.col("kids") == 0, F.col("w") + F.col("e"))).alias("below"))
    up = state.where((F.col("kids") == 1) & F.col("p").isNotNull() & _coin("k", turn) & ~_coin("p", turn))
    above = up.select(F.col("k").alias("_at"), F.struct("k", "id", "p", "w", "e", "steps", "least", "names").alias("cut"))
    at = F.when(F.col("kids") > 0, F.col("p"))
    seen = state.withColumn("_want", at).withColumn("_at", _spread("_want", "k")).join(above, "_at", "left").drop("_at", "_want").join(sent, "k", "left")
    gone = F.coalesce("gone", F.lit(0))
    spliced = (F.col("kids") == 1) & (gone == 0) & F.col("p").isNotNull() & _coin("k", turn) & ~_coin("p", turn)
    return seen.where(~spliced).select(
        "k",
        "id",
        F.when(F.col("cut").isNotNull(), F.col("cut.p")).otherwise(F.col("p")).alias("p"),
        "dangling",
        (F.col("kids") - gone).alias("kids"),
        (F.col("w") + F.coalesce("below", F.lit(0))).alias("w"),
        (F.col("e") + F.coalesce(F.col("cut.w") + F.col("cut.e"), F.lit(0))).alias("e"),
        (F.col("steps") + F.coalesce("cut.steps", F.lit(0))).alias("steps"),
        F.least("least", "cut.least", "cut.id").alias("least"),
        F.when(F.col("cut").isNotNull(), F.concat("cut.names", F.array("cut.id"), "names")).otherwise(F.col("names")).alias("names"),
        F.when(F.col("kids") == 0, "peeled").when((F.col("p") == F.col("k")) & (F.col("kids") == 1), "cycle").alias("left"),
        # what the reverse pass needs of a spliced node: who it is and how far above this node it sat
        F.when(F.col("cut").isNotNull(), F.struct("cut.k", "cut.id", "cut.w", F.col("e").alias("between"), F.col("steps").alias("above"))).alias("cut"),
    )


def _loops(left: DataFrame) -> DataFrame:
    """The results of the nodes cycles have shrunk to."""
    ring = F.when(F.col("names").isNotNull(), F.concat(F.array("id"), "names"))
    path = F.when(F.col("names").isNotNull(), F.array("id"))
    return left.select("k", F.least("id", "least").alias("root"), F.lit(0).cast("bigint").alias("depth"), (F.col("w") + F.col("e")).alias("size"), F.lit("cycle").alias("state"), path.alias("path"), ring.alias("ring"))


def _resolve(gone: DataFrame, later: DataFrame) -> DataFrame:
    """The results of the nodes that left in a round, from those of the nodes that left after it."""
    peeled = gone.where(F.col("left") == "peeled").select(
        "k", "id", F.col("p").alias("via"), "dangling", "w", F.lit(0).cast("bigint").alias("between"), "steps", "names", F.lit(False).alias("is_cut")
    )
    cut = gone.where("cut is not null").select(
        "cut.k", "cut.id", F.col("k").alias("via"), F.lit(False).alias("dangling"), "cut.w", "cut.between", F.col("cut.above").alias("steps"), F.lit(None).cast("array<string>").alias("names"), F.lit(True).alias("is_cut")
    )
    asked = peeled.unionByName(cut).withColumn("_at", _spread("via", "k"))
    known = later.select(F.col("k").alias("_at"), *[F.col(c).alias(f"_{c}") for c in ("root", "depth", "size", "state", "path", "ring")])
    both = asked.join(known, "_at", "left")
    is_root, is_cut, in_cycle = F.col("via").isNull(), F.col("is_cut"), F.col("_state") == "cycle"
    path = F.when(is_root | (is_cut & in_cycle), F.array("id")).when(~is_cut, F.concat("_path", "names", F.array("id"))).otherwise(F.slice("_path", F.lit(1), (F.col("_depth") - F.col("steps") + 1).cast("int")))
    found = both.select(
        "k",
        F.when(is_root, F.col("id")).otherwise(F.col("_root")).alias("root"),
        F.when(is_root | (is_cut & in_cycle), F.lit(0)).when(is_cut, F.col("_depth") - F.col("steps")).otherwise(F.col("_depth") + F.col("steps")).cast("bigint").alias("depth"),
        F.when(is_cut & in_cycle, F.col("_size")).when(is_cut, F.col("w") + F.col("between") + F.col("_size")).otherwise(F.col("w")).alias("size"),
        F.when(is_root & F.col("dangling"), "dangling").when(is_root, "tree").when(in_cycle & ~is_cut, "below_cycle").otherwise(F.col("_state")).alias("state"),
        F.when(F.col("names").isNotNull() | F.col("_path").isNotNull(), path).alias("path"),
        F.lit(None).cast("array<string>").alias("ring"),
    )
    return found.unionByName(_loops(gone.where(F.col("left") == "cycle"))).unionByName(later)


class _Core:
    """The last nodes, peeled in one task: rows (k, id, p, dangling, w, e, steps, least, names)."""

    def __init__(self, rows: list[dict]) -> None:
        self.at = {r["k"]: r for r in rows}
        self.found: dict[str, tuple] = {}

    def run(self) -> list[tuple]:
        at = self.at
        kids = Counter(r["p"] for r in at.values() if r["p"] is not None)
        leaves = [k for k in at if not kids[k]]
        for k in leaves:  # grows as parents become leaves: the peel order
            r = at[k]
            if (p := r["p"]) is not None:
                at[p]["w"] += r["w"] + r["e"]
                kids[p] -= 1
                if not kids[p]:
                    leaves.append(p)
        for k in set(at).difference(leaves):
            if k not in self.found:
                self._cycle(k)
        for k in reversed(leaves):
            self._place(at[k])
        return [(k, *x) for k, x in self.found.items()]

    def _cycle(self, k: str) -> None:
        members = [k]
        while (up := self.at[members[-1]]["p"]) != k:
            members.append(up)
        rows = [self.at[m] for m in members]
        size = sum(r["w"] + r["e"] for r in rows)
        root = min(x for r in rows for x in (r["id"], r["least"]) if x is not None)
        ring = None
        if rows[0]["names"] is not None:
            upwards = [x for r, above in zip(rows, [*rows[1:], None]) for x in (*reversed(r["names"]), *([above["id"]] if above else []))]
            ring = [rows[0]["id"], *reversed(upwards)]
        for r in rows:
            # one of the members holds the ring, so that it is there once
            self.found[r["k"]] = (root, 0, size, "cycle", None if ring is None else [r["id"]], ring if r is rows[0] else None)

    def _place(self, r: dict) -> None:
        path = None
        if r["p"] is None:
            if r["names"] is not None:
                path = [r["id"]]
            self.found[r["k"]] = (r["id"], 0, r["w"], "dangling" if r["dangling"] else "tree", path, None)
            return
        root, depth, _, state, above, _ = self.found[r["p"]]
        if above is not None:
            path = [*above, *r["names"], r["id"]]
        self.found[r["k"]] = (root, depth + r["steps"], r["w"], "below_cycle" if state == "cycle" else state, path, None)


def _core_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in batch.to_pylist()]
    found = _Core(rows).run()
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _FOUND.split(", ")])


def _found(one: DataFrame, paths: bool, core: int) -> DataFrame:
    """(k, root, depth, size, state, path, ring) of each node; one: k, id, p, known. ring: on one node of each cycle, its ids from the top down."""
    state, n = cut_lineage_counting(_start(one, paths), F.lit(True))
    rounds = []
    while n > core:
        after, n = cut_lineage_counting(_peel_round(state, len(rounds)), F.col("left").isNull())
        release(state)
        rounds.append(after)
        state = after.where("left is null").drop("left", "cut")
    rest = state.select("k", "id", "p", "dangling", "w", "e", "steps", "least", "names").coalesce(1)
    found = cut_lineage(rest.mapInArrow(_core_batches, _FOUND))
    for gone in reversed(rounds):
        grown = cut_lineage(_resolve(gone, found))
        release(gone, found)
        found = grown
    return found


def _nodes(rows: DataFrame, node: str, parent: str, valid_by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    nodes = cut_lineage(links(rows, node, parent, valid_by))
    one = nodes.groupBy("k").agg(F.min_by(F.struct("id", "p", "known"), "id").alias("x")).select("k", "x.id", "x.p", "x.known")
    return nodes, one


def hierarchy(rows: DataFrame, node: str, parent: str, valid_by: tuple[str, ...], core: int = CORE) -> DataFrame:
    """(id, root_id, depth, n_desc, state) of each node; see the head of this module.

    state: ``tree`` or ``dangling`` by how the way up ends, ``cycle`` for members of one and
    ``below_cycle`` for nodes that lead into one; depth counts the steps to that end.
    """
    nodes, one = _nodes(rows, node, parent, valid_by)
    found = _found(one, paths=False, core=core)
    return nodes.select("k", "id").join(found, "k").select("id", F.col("root").alias("root_id"), "depth", (F.col("size") - 1).alias("n_desc"), "state")


def paths(rows: DataFrame, node: str, parent: str, valid_by: tuple[str, ...], core: int = CORE) -> DataFrame:
    """(id, root_id, depth, n_desc, state, path): the same with the ids from the root, or the first member of a cycle, down to the node."""
    nodes, one = _nodes(rows, node, parent, valid_by)
    return _with_ids(nodes, _found(one, paths=True, core=core)).drop("k", "ring")


def _with_ids(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The results of every stored id, each at the end of its own path."""
    own = F.concat(F.slice("path", F.lit(1), F.col("depth").cast("int")), F.array("id"))
    return nodes.select("k", "id").join(found, "k").select("k", "id", F.col("root").alias("root_id"), "depth", (F.col("size") - 1).alias("n_desc"), "state", own.alias("path"), "ring")


def ancestor_pairs(rows: DataFrame, node: str, parent: str, valid_by: tuple[str, ...], core: int = CORE) -> DataFrame:
    """(id, ancestor_id, distance): every node with each of its ancestors; for cycles once around, a member last reaching itself.

    As many rows as the depths of all nodes together, read off their paths; read by ancestor it lists
    the descendants. Nodes at or below a cycle get its members from the ring its shrinking left.
    """
    nodes, one = _nodes(rows, node, parent, valid_by)
    found = cut_lineage(_with_ids(nodes, _found(one, paths=True, core=core)))
    on_path = found.where("depth > 0").select("id", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth").cast("int"))).alias("at", "ancestor_id"))
    pairs = on_path.select("id", "ancestor_id", (F.col("depth") - F.col("at")).alias("distance"))
    rings = found.where("ring is not null").select("ring", F.posexplode("ring").alias("at", "first")).select("first", "at", "ring")
    # the way into a cycle begins at the first member; a member's own entry is its spelling that is linked to
    named = one.select("k", F.col("id").alias("linked"))
    into = found.where(F.col("state").isin("cycle", "below_cycle")).join(named, "k").select("id", "depth", F.when(F.col("depth") == 0, F.col("linked")).otherwise(F.col("path")[0]).alias("first"))
    around = into.join(rings, "first").select("id", "depth", "at", F.size("ring").alias("length"), F.posexplode("ring").alias("there", "ancestor_id"))
    further = F.pmod(F.col("at") - F.col("there"), F.col("length"))
    around = around.where((further > 0) | (F.col("depth") == 0)).select("id", "ancestor_id", (F.col("depth") + F.when(further == 0, F.col("length")).otherwise(further)).cast("bigint").alias("distance"))
    return reduce(DataFrame.unionByName, [pairs, around])
