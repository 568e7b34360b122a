"""Parent-child rows to full hierarchies, with cycles named."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstrata.operators.skew import HOT_FLOOR, skew_join
from packstrata.session import Scratch


def clean_edges(edges: DataFrame, parent: str, name: str, child: str, order: str | None = None) -> DataFrame:
    """Distinct edges as _p, _name (binary), _c, keyed by (_p, _name).

    Rows with a null parent or name are no entries. Of rows that differ for one
    (parent, name) the one of greatest ``order``, then of greatest child, stands.
    """
    rank = [F.col(c) for c in ([order] if order else []) + [child]]
    best = F.max(F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(rank)))).alias("_b")
    rows = edges.where(F.col(parent).isNotNull() & F.col(name).isNotNull())
    return rows.groupBy(F.col(parent).alias("_p"), F.col(name).cast("binary").alias("_name")).agg(best).select("_p", "_name", F.col(f"_b._o{len(rank) - 1}").alias("_c"))


#: Steps along the chains that one plan takes before its result is written.
STEPS = 3
_STATE = ["node", "head", "dist", "path", "shared", "done"]


class Chains:
    """Pointer doubling of ``links`` (node, up, seg, shared, and any other columns; up null at terminals).

    In round k every open node holds a pointer to its ancestor 2^k above and
    the path text between; it takes over the pointer of that ancestor. Nodes
    that arrive at a terminal are done and only looked up from then on, so a
    round moves the open ones. Rounds end when no node is open, or when one
    resolves none: an open node with a chain that ends has an ancestor which
    ends it one round earlier, so then all that are open lead into cycles.
    Those go on, without texts, until pointers are longer than any way to a
    cycle: what they point to is then exactly the nodes on cycles.

    ``table``: the links, written; ``n_shared`` of them are shared.
    ``done``: node, head (its terminal), dist, path, shared (of the head).
    ``open``: node, head of nodes on or below cycles, ``n_open`` of them.
    ``jumps``: (node, head) of each round.
    """

    def __init__(self, links: DataFrame, scratch: Scratch, floor: int | None):
        self.scratch = scratch
        top = F.col("up").isNull()
        state = links.select(
            "*", F.coalesce("up", "node").alias("head"), F.when(top, 0).otherwise(1).cast("long").alias("dist"), F.when(top, "").otherwise(F.col("seg")).alias("path"), top.alias("done")
        )
        self.table, n_open, self.n_shared = scratch.keep_counted(state, F.when(F.col("done"), 0).otherwise(1), F.col("shared").cast("int"))
        rounds, self.jumps, cyclic = [self.table], [], False
        fresh = self.table.select(*_STATE).where("not done")
        while n_open:
            self.jumps.append(fresh.select("node", "head"))
            if cyclic and 1 << len(self.jumps) - 1 >= n_open:
                break
            ends = fresh if cyclic else fresh.unionByName(scratch.read(*rounds, columns=_STATE).where("done"))
            target = ends.select(F.col("node").alias("head"), F.col("head").alias("_h"), F.col("dist").alias("_d"), F.col("path").alias("_q"), F.col("shared").alias("_s"), F.col("done").alias("_f"))
            moved = skew_join(fresh, target, ["head"], "inner", floor, n_open).select(
                "node", F.col("_h").alias("head"), (F.col("dist") + F.col("_d")).alias("dist"), F.lit("").alias("path") if cyclic else F.concat("_q", "path").alias("path"), F.col("_s").alias("shared"), F.col("_f").alias("done")
            )
            kept, left = scratch.keep_counted(moved, F.when(F.col("done"), 0).otherwise(1))
            fresh = kept.where("not done")
            if not cyclic:
                rounds.append(kept)
                cyclic = left == n_open
            n_open = left
        self.done = scratch.read(*rounds, columns=_STATE).where("done").drop("done")
        self.open, self.n_open = fresh.select("node", "head"), n_open

    def above(self, marks: DataFrame, carry: list[str] = []) -> DataFrame:  # noqa: B006
        """``marks`` (node, carry) and, with the same carry, all nodes above them in their chains, each once."""
        return self._along(marks, lambda rows: rows.select("node", *carry).distinct())

    def below(self, weights: DataFrame) -> DataFrame:
        """``weights`` (node, w) summed over each node and all that hang below it in chains: in round k, what is 2^k below is added."""
        return self._along(weights, lambda rows: rows.groupBy("node").agg(F.sum("w").alias("w")))

    def _along(self, rows: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Each row also at the node that its node's pointer of round k points to, merged; for all rounds in turn."""
        columns = [c for c in rows.columns if c != "node"]
        for k, jump in enumerate(self.jumps, 1):
            both = F.explode(F.array_compact(F.array("node", "head"))).alias("node")
            rows = merge(rows.join(jump, "node", "left").select(both, *columns))
            if k % STEPS == 0 and k < len(self.jumps):
                rows = self.scratch.keep(rows)
        return rows


class Forest:
    """A graph of edges as chains that end at roots or at nodes of several parents (shared nodes).

    Nodes are those that have children. A node of one parent follows it; the
    few nodes of several parents (a shared directory, or a tree edge into a
    cycle) have no single pointer. They end the chains below them and form a
    graph of their own, which is closed by doubling: it tells which of them
    lie on a cycle or below one, and what is reachable across them.
    """

    def __init__(self, rows: DataFrame, n_rows: int, scratch: Scratch, floor: int | None = None):
        """``rows``: _p, _name, _c as ``clean_edges`` has them, written, n_rows of them. Runs jobs."""
        self.scratch, self.floor, self.spark = scratch, floor, rows.sparkSession
        self.rows, self.n_rows = rows, n_rows
        out = rows.groupBy(F.col("_p").alias("node")).agg(F.count(F.lit(1)).alias("weight"))
        # in-edges of nodes that have children; all else is a leaf of the edge that names it
        self.into, self.n_into = scratch.keep_counted(skew_join(rows, out.select(F.col("node").alias("_c")), ["_c"], "left_semi", floor, n_rows), F.lit(1))
        degree = self.into.groupBy(F.col("_c").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min(F.struct("_p", "_name")).alias("_e"))
        nodes = out.join(degree, "node", "left").select("node", "weight", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.col("_e._p").alias("_p"), F.col("_e._name").alias("_name"))
        one = F.col("n_in") == 1
        self.chains = Chains(nodes.select("*", F.when(one, F.col("_p")).alias("up"), F.when(one, segment()).alias("seg"), (F.col("n_in") > 1).alias("shared")), scratch, floor)
        self.nodes, self.n_shared = self.chains.table.select("node", "weight", "n_in", "_p", "_name"), self.chains.n_shared

    @cached_property
    def shared(self) -> DataFrame:
        return self.nodes.where("n_in > 1").select("node", "_p", "_name")

    @cached_property
    def entries(self) -> DataFrame:
        """Edges into shared nodes (_p, _name, _c) with the head of _p's chain, _h (null if that never ends), and _hs, whether it is shared."""
        into = skew_join(self.into, self.shared.select(F.col("node").alias("_c")), ["_c"], "left_semi", self.floor, self.n_into)
        heads = self.chains.done.select(F.col("node").alias("_p"), F.col("head").alias("_h"), F.col("shared").alias("_hs"))
        return self.scratch.keep(skew_join(into, heads, ["_p"], "left", self.floor, self.n_into))

    @cached_property
    def closed(self) -> DataFrame:
        """(x, y) of shared nodes: y can be reached from x by one edge or more. Closed by doubling."""
        closed, size = self.scratch.keep_counted(self.entries.where("_hs").select(F.col("_h").alias("x"), F.col("_c").alias("y")).distinct(), F.lit(1))
        while size:
            step = closed.select("x", F.col("y").alias("_m")).join(closed.select(F.col("x").alias("_m"), "y"), "_m").select("x", "y")
            grown, now = self.scratch.keep_counted(closed.unionByName(step).distinct(), F.lit(1))
            self.scratch.drop(closed)
            closed, done, size = grown, now == size, now
            if done:
                break
        return closed

    @cached_property
    def reach(self) -> DataFrame:
        """``closed``, and every shared node with itself."""
        return self.closed.where("x <> y").unionByName(self.shared.select(F.col("node").alias("x"), F.col("node").alias("y")))

    @cached_property
    def bad(self) -> DataFrame:
        """Shared nodes on or below a cycle."""
        seeds = self.closed.where("x = y").select("x").unionByName(self.entries.where("_h is null").select(F.col("_c").alias("x"))).distinct()
        return self.scratch.keep(self.reach.join(seeds, "x", "left_semi").select(F.col("y").alias("node")).distinct())

    @cached_property
    def back(self) -> DataFrame:
        """Edges into shared nodes that lead back to where they start."""
        return self.entries.where("_hs").join(self.reach.select(F.col("x").alias("_c"), F.col("y").alias("_h")), ["_c", "_h"], "left_semi").select("_p", "_name", "_c")

    @cached_property
    def marks(self) -> DataFrame:
        """(node, y): the shared nodes y that a sound chain node reaches, and with a null y the nodes whose edge lies on a cycle through shared nodes."""
        none = F.lit(None).cast(self.entries.schema["_c"].dataType)
        loops = self.back.select(F.col("_p").alias("node"), none.alias("y"))
        sound = self.entries.where("_h is not null").join(self.bad.select(F.col("node").alias("_h")), "_h", "left_anti")
        met = sound.select(F.col("_p").alias("node"), F.col("_c").alias("x")).distinct().join(self.reach, "x").select("node", "y")
        return self.scratch.keep(self.chains.above(loops.unionByName(met).distinct(), ["y"]))

    def on_cycle(self) -> DataFrame:
        """Nodes of one parent whose edge lies on a cycle, each once, and shared nodes at the head of such chains."""
        found = self.chains.open.select(F.col("head").alias("node")).distinct()
        return found.unionByName(self.marks.where("y is null").select("node")).distinct() if self.n_shared else found

    def damaged(self) -> DataFrame:
        """Nodes on or below a cycle."""
        found = self.chains.open.select("node")
        if not self.n_shared:
            return found
        return found.unionByName(self.chains.done.join(self.bad.select(F.col("node").alias("head")), "head", "left_semi").select("node"))

    def below(self, weights: DataFrame) -> DataFrame:
        """node, w: ``weights`` (node, w) summed over the node and all nodes reachable from it, each once. Nothing is said of damaged nodes.

        Across shared nodes each is counted once for all that reach it, which
        takes the pairs of chain nodes and the shared nodes they reach.
        """
        own = self.chains.below(weights)
        if not self.n_shared:
            return own
        own = self.scratch.keep(own)
        total = self.shared.select(F.col("node").alias("y")).join(own.select(F.col("node").alias("y"), F.col("w").alias("_t")), "y")
        across = self.marks.join(total, "y").groupBy("node").agg(F.sum("_t").alias("_more"))
        # a shared node's own chain is among what it reaches
        within = self.reach.join(total, "y").groupBy(F.col("x").alias("node")).agg(F.sum("_t").alias("_all"))
        return own.join(across, "node", "left").join(within, "node", "left").select("node", F.coalesce("_all", F.col("w") + F.coalesce("_more", F.lit(0))).alias("w"))

    def paths(self) -> DataFrame:
        """node, root, depth, path of sound nodes; across shared nodes the path of the smallest (parent, name)."""
        done = self.chains.done
        if not self.n_shared:
            return done.select("node", F.col("head").alias("root"), F.col("dist").alias("depth"), "path")
        done = done.join(self.bad.select(F.col("node").alias("head")), "head", "left_anti")
        hops = self.shared.select("node", "_p", segment().alias("seg")).join(done.select(F.col("node").alias("_p"), "head", "dist", "path"), "_p")
        hops = hops.select("node", F.col("head").alias("up"), F.concat("path", "seg").alias("seg"), (F.col("dist") + 1).alias("hop")).join(self.bad, "node", "left_anti")
        lifted = _lift(hops, self.scratch).select(F.col("node").alias("head"), F.col("head").alias("_r"), F.col("hop").alias("_d"), F.col("path").alias("_q"))
        zero = F.lit(0).cast("long")
        return done.join(self.scratch.keep(lifted), "head", "left").select("node", F.coalesce("_r", "head").alias("root"), (F.col("dist") + F.coalesce("_d", zero)).alias("depth"), F.concat(F.coalesce("_q", F.lit("")), "path").alias("path"))

    def ancestors(self, nodes: DataFrame) -> DataFrame:
        """The nodes from which one of ``nodes`` (node) can be reached, and those themselves, damage included."""
        up = self.chains.above(nodes.select("node").distinct())
        if not self.n_shared:
            return up
        up = self.scratch.keep(up)
        met = up.join(self.shared.select("node"), "node", "left_semi").select(F.col("node").alias("y")).distinct()
        over = self.scratch.keep(self.reach.join(met, "y", "left_semi").select(F.col("x").alias("node")).distinct())
        parents = self.entries.join(over.select(F.col("node").alias("_c")), "_c", "left_semi").select(F.col("_p").alias("node")).distinct()
        return up.unionByName(over).unionByName(self.chains.above(parents)).distinct()

    def descendants(self, nodes: DataFrame) -> DataFrame:
        """The nodes that can be reached from ``nodes`` (node), and those themselves, damage included."""
        met = self._hanging(nodes.select("node").distinct())
        if not self.n_shared:
            return met
        first = self.entries.join(met.select(F.col("node").alias("_p")), "_p", "left_semi").select(F.col("_c").alias("x")).unionByName(met.join(self.shared.select("node"), "node", "left_semi").select(F.col("node").alias("x"))).distinct()
        over = self.scratch.keep(self.reach.join(first, "x", "left_semi").select(F.col("y").alias("node")).distinct())
        return met.unionByName(self._hanging(over)).distinct()

    def _hanging(self, marks: DataFrame) -> DataFrame:
        """``marks`` and what hangs below them in chains: by the longest jumps first, so that each later one halves what is left."""
        for jump in reversed(self.chains.jumps):
            marks = self.scratch.keep(marks.unionByName(jump.join(marks.select(F.col("node").alias("head")), "head", "left_semi").select("node")).distinct())
        return marks


def segment() -> Column:
    return F.concat(F.lit("/"), F.col("_name").cast("string"))


def forest(edges: DataFrame, parent: str = "parent", name: str = "name", child: str = "inode", order: str | None = "generation", floor: int | None = None) -> Forest:
    """The forest of a table of edges; see ``clean_edges`` for what counts."""
    scratch = Scratch(edges.sparkSession)
    return Forest(*scratch.keep_counted(clean_edges(edges, parent, name, child, order), F.lit(1)), scratch, floor)


def hierarchy(edges: DataFrame, parent: str = "parent", name: str = "name", child: str = "inode", order: str | None = None, floor: int | None = None) -> DataFrame:
    """Path, depth, root, state and number of descendants of every edge.

    Pointer doubling over the nodes that have children (``Chains``); nodes that
    no round resolves lie on or below a cycle. Nodes of several parents are
    treated as ``Forest`` says: what is reachable across them is counted once.
    Outside damage, the path of such a node is that of its smallest (parent,
    name).

    Returns parent, inode, root, depth, path, state, n_below, one row for each
    distinct (parent, name); see ``clean_edges`` for repeated and null rows. A
    null child is an entry with nothing below. Names are read as UTF-8. An
    empty table gives no rows. Runs jobs while it is called.
    """
    own = edges.schema[parent].dataType
    f = forest(edges, parent, name, child, order, floor)
    below = f.below(f.nodes.select("node", F.col("weight").alias("w")))
    child_info = f.scratch.keep(below).select(F.col("node").alias("_c"), F.col("w").alias("_below"))
    above = f.paths().select(F.col("node").alias("_p"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
    loop = F.lit(False)
    if f.chains.n_open or f.n_shared:
        on = f.on_cycle().select(F.col("node").alias("_c"), F.lit(True).alias("_on"))
        # an edge into a shared node is looked up by itself
        several = f.shared.select(F.col("node").alias("_c"), F.lit(True).alias("_several"))
        child_info = child_info.join(on, "_c", "left").join(several, "_c", "left")
        loop = F.coalesce("_on", F.lit(False)) & F.col("_several").isNull()
    # a join that splits hot keys reads its right side twice
    once = f.scratch.keep if f.n_rows > (HOT_FLOOR if floor is None else floor) else lambda df: df
    told = skew_join(f.rows, once(child_info), ["_c"], "left", floor, f.n_rows)
    if f.n_shared:
        told = told.join(f.back.select("_p", "_name", F.lit(True).alias("_back")), ["_p", "_name"], "left")
        loop = loop | F.coalesce("_back", F.lit(False))
    told = told.select("_p", "_name", "_c", loop.alias("_loop"), F.coalesce("_below", F.lit(0)).alias("_below"))
    told = skew_join(told, once(above), ["_p"], "left", floor, f.n_rows)
    kind = F.when(F.col("_loop"), "cycle").when(F.col("_root").isNull(), "below_cycle").otherwise("tree")
    return told.withColumn("state", kind).select(
        F.col("_p").cast(own).alias(parent), F.col("_c").alias(child), _tree(F.col("_root"), 0, own.simpleString()).alias("root"), _tree(F.col("_depth") + 1, 0, "long").alias("depth"),
        _tree(F.concat("_path", segment()), "", "string").alias("path"), "state", _tree(F.col("_below"), 0, "long").alias("n_below"),
    )


def tree_paths(edges: DataFrame, parent: str = "parent", name: str = "name", child: str = "inode", order: str | None = None, floor: int | None = None) -> DataFrame:
    """parent and path of the edges that ``hierarchy`` calls tree, with none of its sums and states.

    An edge is on or below a cycle exactly if its parent has no path, so this
    takes the chains and their paths only. Runs jobs while it is called.
    """
    f = forest(edges, parent, name, child, order, floor)
    above = f.paths().select(F.col("node").alias("_p"), F.col("path").alias("_path"))
    # as in ``hierarchy``: the right side may be read twice
    if f.n_rows > (HOT_FLOOR if floor is None else floor):
        above = f.scratch.keep(above)
    told = skew_join(f.rows.select("_p", "_name"), above, ["_p"], "inner", floor, f.n_rows)
    return told.select(F.col("_p").cast(edges.schema[parent].dataType).alias(parent), F.concat("_path", segment()).alias("path"))


def _tree(value: Column, otherwise, kind: str) -> Column:  # noqa: ANN001
    return F.when(F.col("state") == "tree", value).otherwise(F.lit(otherwise).cast(kind)).cast(kind)


def _lift(hops: DataFrame, scratch: Scratch) -> DataFrame:
    """Doubling of weighted hops (node, up, seg, hop) to what none leads on from: node, head, hop, path."""
    tops = hops.select(F.col("up").alias("node")).distinct().join(hops.select("node"), "node", "left_anti")
    start = tops.select("node", F.col("node").alias("head"), F.lit(0).cast("long").alias("hop"), F.lit("").alias("path"), F.lit(True).alias("done"))
    waits = F.when(F.col("done"), 0).otherwise(1)
    state, left = scratch.keep_counted(start.unionByName(hops.select("node", F.col("up").alias("head"), "hop", F.col("seg").alias("path"), F.lit(False).alias("done"))), waits)
    while left:
        target = state.select(F.col("node").alias("head"), F.col("head").alias("_h"), F.col("hop").alias("_d"), F.col("path").alias("_p"), F.col("done").alias("_f"))
        moved = state.where("not done").join(target, "head").select("node", F.col("_h").alias("head"), (F.col("hop") + F.col("_d")).alias("hop"), F.concat("_p", "path").alias("path"), F.col("_f").alias("done"))
        before = state
        state, left = scratch.keep_counted(state.where("done").unionByName(moved), waits)
        scratch.drop(before)
    return state.select("node", "head", "hop", "path")
