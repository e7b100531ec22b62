"""Parent-child links to full hierarchies, by pointer doubling (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeweft.operators.references import hot_keys
from codeweft.sources.tables import cut_lineage

#: Parents with this share of all links and no parent of their own are told before the joins; at most 1/share of them.
HOT_SHARE = 0.01
#: Rows that one task takes without trouble, and that may be broadcast.
MAX_HOT_ROWS = 200_000


def parent_links(edges: DataFrame) -> DataFrame:
    """Distinct (child, parent) of the CONTAINS rows with two non-null endpoints; repeated rows count once."""
    return (
        edges.where((F.upper("rel_type") == "CONTAINS") & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
        .select(F.col("target_id").alias("child"), F.col("source_id").alias("parent"))
        .distinct()
    )


def hot_roots(links: DataFrame) -> list[str]:
    """Parents of at least HOT_SHARE of all links that are nobody's child. What hangs below them is resolved without sending it to one task."""
    hot = hot_keys(links, "parent", HOT_SHARE)
    if not hot:
        return []
    below = {r[0] for r in links.where(F.col("child").isin(hot)).select("child").distinct().collect()}  # at most 1/HOT_SHARE
    return [x for x in hot if x not in below]


def _meet(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right joined on ``key``; keys with HOT_SHARE of the left rows are set apart.

    These are inner nodes with much below them: there are at most 1/HOT_SHARE of
    them, and their rows on the right are broadcast if there are no more than
    MAX_HOT_ROWS; beyond that all rows are shuffled.
    """
    total = left.count()
    if total < MAX_HOT_ROWS:  # no key can weigh on a task
        return left.join(right, key)
    hot = [r[0] for r in left.groupBy(key).count().where(F.col("count") >= HOT_SHARE * total).select(key).collect()]
    few = right.where(F.col(key).isin(hot)) if hot else None
    if few is None or few.limit(MAX_HOT_ROWS + 1).count() > MAX_HOT_ROWS:
        return left.join(right, key)
    set_apart = left.where(F.col(key).isin(hot)).join(F.broadcast(few), key)
    return left.where(~F.col(key).isin(hot)).join(right, key).unionByName(set_apart)


def _endless(links: DataFrame) -> DataFrame:
    """(node): nodes from which walks along child -> parent never end.

    Round i holds the pairs (node, ancestor at exactly 2**i steps); joining it
    with itself doubles the distance, and nodes nearer to a root drop out.  The
    depths of the finite nodes have no gaps, so when a doubling drops nobody the
    remaining nodes lie on or under a cycle: log2(depth) + 1 rounds.
    """
    jump = links.where(~F.col("parent").isin(hot_roots(links))).select(F.col("child").alias("a"), F.col("parent").alias("b"))
    left = None
    while True:
        nxt = _meet(jump, jump.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        jump = cut_lineage(nxt)
        now = jump.select("a").distinct().count()
        if not now or now == left:
            return jump.select(F.col("a").alias("node")).distinct()
        left = now


def _inside(links: DataFrame, nodes: DataFrame) -> DataFrame:
    both = links.join(nodes.withColumnRenamed("node", "child"), "child", "left_semi")
    return both.join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi").select("child", "parent")


def _outside(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links neither end of which is among the nodes."""
    rest = links.join(nodes.select(F.col("node").alias("child")), "child", "left_anti")
    return rest.join(nodes.select(F.col("node").alias("parent")), "parent", "left_anti").select("child", "parent")


def _rings(one: DataFrame) -> DataFrame:
    """(child, parent) of the links of ``one``, which has one parent for each child, that lie on its cycles.

    Where pointers lead after ever more steps are in the end the nodes on cycles:
    doubling them until there are no fewer of these.
    """
    ptr, before = one.select(F.col("child").alias("node"), F.col("parent").alias("ptr")), None
    while True:
        ends = ptr.select(F.col("ptr").alias("node")).distinct()
        now = ends.count()
        if now == before:
            return _inside(one, ends)
        before = now
        ptr = cut_lineage(_meet(ptr, ptr.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2")), "ptr").select("node", F.col("ptr2").alias("ptr")))


def cycle_nodes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, cycle_id) of the nodes on a cycle, links among nodes on or under cycles)."""
    under = cut_lineage(_inside(links, _endless(links)))
    rest, rings = under, None
    while True:
        # On a cycle, or between two cycles: endless downwards too.
        core = cut_lineage(_inside(rest, _endless(rest.select(F.col("parent").alias("child"), F.col("child").alias("parent")))))
        if not core.limit(1).count():
            break
        if not core.groupBy("child").count().where("count > 1").limit(1).count():
            rings = core if rings is None else rings.unionByName(core)
            break
        # A cycle hangs below another one.  With one parent for each node some cycles stay whole, at least those that hang below
        # no other; they are taken out, and the rest is looked at again.
        ring = cut_lineage(_rings(cut_lineage(core.groupBy("child").agg(F.min("parent").alias("parent")))))
        rings = ring if rings is None else rings.unionByName(ring)
        rest = _outside(core, ring.select(F.col("child").alias("node")))
        rest = cut_lineage(_inside(rest, _endless(rest)))
    rings = cut_lineage(rings) if rings is not None else under.limit(0)
    # Now each node has one parent and each component is one cycle: least id by doubling pointers.
    ptr = rings.select(F.col("child").alias("node"), F.col("parent").alias("ptr"), F.least("child", "parent").alias("low"))
    before = None
    while True:
        hop = ptr.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        ptr = cut_lineage(ptr.join(hop, "ptr").select("node", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low")))
        # Lows only fall; a doubling that changes no low of any node has gone all the way round.
        now = ptr.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return ptr.select("node", F.col("low").alias("cycle_id")), under


def cycle_members(links: DataFrame) -> DataFrame:
    """(node_id, cycle_id): every node on a cycle or a descendant of one, with the least id on that cycle.

    links: (child, parent), distinct; links with a null end are ignored.  A link
    from an id to itself is a cycle of one.  A node under several cycles gets a
    row for each.  No cycles, or no links: no rows.
    """
    links = cut_lineage(links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()))  # read several times
    on, under = cycle_nodes(links)
    on = cut_lineage(on)
    rep_c = on.select(F.col("node").alias("child"), F.col("cycle_id").alias("rc"))
    rep_p = on.select(F.col("node").alias("parent"), F.col("cycle_id").alias("rp"))
    # Cycles shrunk to their least id; pointers that reach one stay, the others double.
    up = (
        under.join(rep_c, "child", "left").join(rep_p, "parent", "left")
        .select(F.coalesce("rc", "child").alias("a"), F.coalesce("rp", "parent").alias("b"), F.col("rp").isNotNull().alias("hit"))
        .where("a <> b").distinct()
    )
    up = cut_lineage(up)
    open_left, pairs = up.where("not hit").limit(1).count(), -1
    while True:
        nxt = up.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("hit").alias("hit2"))
        step = _meet(up, nxt, "b").select("a", F.col("c").alias("b"), F.col("hit2").alias("hit"))
        up = cut_lineage(up.where("hit").union(step).distinct())
        n, open_left = up.count(), up.where("not hit").limit(1).count()
        if not open_left and n == pairs:
            break
        pairs = n
    below = up.where("hit").select(F.col("a"), F.col("b").alias("cycle_id"))
    direct = below.join(on.select("cycle_id").distinct().withColumnRenamed("cycle_id", "a"), "a", "left_anti").select(F.col("a").alias("node_id"), "cycle_id")
    # A cycle that hangs below another one: its nodes are descendants of that too.
    lower = on.select("node", F.col("cycle_id").alias("a")).join(below, "a").select(F.col("node").alias("node_id"), "cycle_id")
    return on.select(F.col("node").alias("node_id"), "cycle_id").union(direct).union(lower).distinct()


def hierarchy(links: DataFrame) -> DataFrame:
    """(node_id, root_id, depth, path ARRAY): a row for each node and each way from a root down to it.

    path runs from the root to the node, depth is its length less one (0 for a
    root).  Pointers double: unresolved rows join the rows of the ancestor they
    have reached and take over its pointer and path.  Nodes on or under a cycle
    have no root and are left out here; ``all_paths`` has them too.  A node
    with several parents has a row for each path.  Empty input: no rows.
    """
    links = cut_lineage(links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()))  # read several times
    endless = cut_lineage(_endless(links))
    roots = links.select(F.col("parent").alias("node")).distinct().join(links.select(F.col("child").alias("node")).distinct(), "node", "left_anti")
    return _paths(links.join(endless.withColumnRenamed("node", "child"), "child", "left_anti"), roots, F.col("parent").isin(hot_roots(links)))


def _paths(links: DataFrame, roots: DataFrame, hot: Column) -> DataFrame:
    """The rows of ``hierarchy`` for links without cycles; hot: which links hang on a root that is not to be joined with."""
    roots = roots.select(F.col("node").alias("node_id"), F.col("node").alias("top"), F.array("node").alias("path"), F.lit(True).alias("done"))
    state = links.select(F.col("child").alias("node_id"), F.col("parent").alias("top"), F.array("parent", "child").alias("path"), hot.alias("done")).union(roots)
    while True:
        up = state.select(F.col("node_id").alias("top"), F.col("top").alias("top2"), F.col("path").alias("path2"), F.col("done").alias("done2"))
        moved = (
            _meet(state.where("not done"), up, "top")
            .select("node_id", F.col("top2").alias("top"), F.concat("path2", F.slice("path", F.lit(2), F.size("path"))).alias("path"), F.col("done2").alias("done"))
        )
        state = cut_lineage(state.where("done").union(moved))
        if not state.where("not done").limit(1).count():
            break
    return state.select("node_id", F.col("top").alias("root_id"), (F.size("path") - 1).cast("long").alias("depth"), "path")


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance): every proper descendant at whatever depth, from the paths of ``hierarchy``."""
    return (
        tree.select("node_id", "depth", F.posexplode("path").alias("pos", "ancestor_id"))
        .where(F.col("pos") < F.col("depth"))
        .select("ancestor_id", "node_id", (F.col("depth") - F.col("pos")).alias("distance"))
        .distinct()
    )


def _unrolled(links: DataFrame, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links without cycles, their roots, (node, cycle_id) of the nodes on a cycle).

    Nodes become (node, start).  A cycle becomes a chain for each start: all of
    its nodes if ``every``, else the nodes with a parent outside, or its least id
    if there is none; start is the empty string for nodes on no cycle.  Ways down
    the chains are the ways down the links that repeat no node.
    """
    on = cut_lineage(cycle_nodes(links)[0])
    rep_c = on.select(F.col("node").alias("child"), F.col("cycle_id").alias("rc"))
    rep_p = on.select(F.col("node").alias("parent"), F.col("cycle_id").alias("rp"))
    told = cut_lineage(links.join(rep_c, "child", "left").join(rep_p, "parent", "left"))
    same = F.coalesce(F.col("rc") == F.col("rp"), F.lit(False))
    if every:
        starts = on.select("cycle_id", F.col("node").alias("start"))
    else:
        entered = told.where(F.col("rc").isNotNull() & ~same).select(F.col("rc").alias("cycle_id"), F.col("child").alias("start")).distinct()
        closed = on.select("cycle_id").distinct().join(entered, "cycle_id", "left_anti")
        starts = entered.union(closed.select("cycle_id", F.col("cycle_id").alias("start")))
    starts = cut_lineage(starts)

    def at(node: str, start) -> Column:
        return F.struct(F.col(node).alias("node"), start.alias("start"))

    around = (
        told.where(same).join(starts.withColumnRenamed("cycle_id", "rc"), "rc").where("child <> start")
        .select(at("child", F.col("start")).alias("child"), at("parent", F.col("start")).alias("parent"))
    )
    into = F.when(F.col("rc").isNull(), F.lit("")).otherwise(F.col("child"))
    across = (
        told.where(~same).join(starts.withColumnRenamed("cycle_id", "rp"), "rp", "left")
        .select(at("child", into).alias("child"), at("parent", F.coalesce("start", F.lit(""))).alias("parent"))
    )
    out = cut_lineage(around.union(across))
    heads = out.select(F.col("parent").alias("node")).union(starts.select(at("start", F.col("start")).alias("node"))).distinct()
    return out, heads.join(out.select(F.col("child").alias("node")).distinct(), "node", "left_anti"), on


def all_paths(links: DataFrame) -> DataFrame:
    """(node_id, root_id, depth, path ARRAY, rooted): ``hierarchy`` for every id of the links, those on and under cycles too.

    A row for each way down from a root that repeats no node.  A cycle that no
    link enters from outside has no root above it: its least id stands for one,
    and rooted is false.  Cycles that share a node are not provided for, as in
    ``cycle_members``.  Empty input: no rows.
    """
    links = cut_lineage(links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()))
    out, roots, on = _unrolled(links, False)
    tree = _paths(out, roots, F.col("parent.node").isin(hot_roots(links)))
    tree = tree.select("node_id.node", F.col("root_id.node").alias("root_id"), "depth", F.col("path.node").alias("path"))
    return tree.join(on.select(F.col("node").alias("root_id"), "cycle_id"), "root_id", "left").select(
        F.col("node").alias("node_id"), "root_id", "depth", "path", F.col("cycle_id").isNull().alias("rooted")
    )


def all_descendants(links: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance): every descendant of every id, inside and below cycles too.

    distance is the length of a way down that repeats no node; a pair has a row
    for each.  A node on a cycle descends from itself, once around.
    """
    links = cut_lineage(links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()))
    out, roots, on = _unrolled(links, True)
    pairs = descendants(_paths(out, roots, F.col("parent.node").isin(hot_roots(links))))
    around = on.join(on.groupBy("cycle_id").agg(F.count(F.lit(1)).alias("distance")), "cycle_id").select("node", F.col("node").alias("n"), "distance")
    return pairs.select(F.col("ancestor_id.node").alias("ancestor_id"), F.col("node_id.node").alias("node_id"), "distance").distinct().union(around)
