"""Parent-child rows of unknown depth as full hierarchies.

1. Rows without children are set aside: they can't be on a path between others, so that all rounds run over the rest alone.
2. Pointer doubling finds roots, depths and subtree sizes: in round k a row points 2^k steps up, and its count within 2^(k+1) steps is
   its count within 2^k plus the counts of the rows that point to it. A round in which no row arrives proves that every remaining
   row leads into a cycle, as a forest of depth d has a row at each depth below d.
3. Heavy-path decomposition: each row continues the chain of its parent if its subtree is the largest among the siblings. Any path
   crosses at most log2(n) chains. With the heavy child first, each chain is an interval of the preorder, and so is each subtree.
4. Paths and positions are settled for the rows at which chains hang (hooks), one level of chains after another; every other row takes
   its hook's and goes on along its own chain.

The number of rounds is logarithmic in the depth, and in the number of rows for the levels of chains. Siblings are ordered in hashed
buckets, as many as their number asks for, and groupings combine on the map side. A chain's keys are one value, no longer than the
path of its last row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.plans.lineage import Cuts
from docspark.sources.tables import earliest

#: Siblings that are ordered in one bucket.
SIBLINGS = 20_000


def parent_rows(df: DataFrame, key: str, parent: str, at: str | None) -> DataFrame:
    """(v, p): one row for each key. An empty parent is none, and of a key's several rows the earliest counts."""
    df = df.select(F.col(key).alias("v"), F.nullif(F.col(parent), F.lit("")).alias("p"), (F.col(at) if at else F.lit(0)).alias("recorded_at"))
    return earliest(df, "v", ["p"])


def _cyclic(nodes: DataFrame, cuts: Cuts) -> DataFrame:
    """(v, p, j): the rows whose path never ends; j is an ancestor on the cycle. A table joined with itself is merged, not broadcast,
    as it grows with the data."""
    live = cuts.cut(nodes.where("p is not null").select("v", "p", F.col("p").alias("j")))
    before = -1
    while (count := live.count()) and count != before:
        before = count
        step = live.select(F.col("v").alias("j"), F.col("j").alias("jj"))
        after = cuts.cut(live.join(step.hint("merge"), "j").select("v", "p", F.col("jj").alias("j")))
        cuts.drop(live)
        live = after
    if not count:
        return live
    image = -1
    while (now := live.select("j").distinct().count()) != image:  # the image of the jump shrinks until it is the cycles
        image = now
        step = live.select(F.col("v").alias("j"), F.col("j").alias("jj"))
        after = cuts.cut(live.join(step.hint("merge"), "j").select("v", "p", F.col("jj").alias("j")))
        cuts.drop(live)
        live = after
    return live


def _inner(nodes: DataFrame) -> DataFrame:
    """The rows of (v, p) that have children."""
    return nodes.join(nodes.where("p is not null").select(F.col("p").alias("v")).distinct().hint("merge"), "v", "left_semi")


def cycles(nodes: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """(v, cycle_id, place) of the rows of (v, p) from which p leads into a cycle.

    place is `on` or `under`; cycle_id is the smallest v on the cycle. A p without a row ends the path. No rows give no rows.
    """
    cuts = cuts or Cuts(nodes.sparkSession)
    led = _cyclic(cuts.cut(_inner(nodes)), cuts)
    on = led.join(led.select(F.col("j").alias("v")).distinct().hint("merge"), "v", "left_semi")
    ring = cuts.cut(on.select("v", F.col("p").alias("j"), F.least("v", "p").alias("m"), F.lit(True).alias("changed")))
    while not ring.where("changed").isEmpty():
        step = ring.select(F.col("v").alias("j"), F.col("j").alias("jj"), F.col("m").alias("mm"))
        after = cuts.cut(ring.join(step.hint("merge"), "j").select("v", F.col("jj").alias("j"), F.least("m", "mm").alias("m"), (F.col("mm") < F.col("m")).alias("changed")))
        cuts.drop(ring)
        ring = after
    ids = ring.select("v", F.col("m").alias("cycle_id"))
    placed = led.select("v", "j").join(ids.select("v", F.lit(True).alias("on")), "v", "left")
    inner = cuts.cut(placed.join(ids.select(F.col("v").alias("j"), "cycle_id"), "j").select("v", "cycle_id", F.when(F.col("on"), "on").otherwise("under").alias("place")))
    above = inner.select(F.col("v").alias("p"), "cycle_id")
    return inner.unionByName(nodes.join(above, "p").join(inner.select("v"), "v", "left_anti").select("v", "cycle_id", F.lit("under").alias("place")))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _resolve(rows: DataFrame, cuts: Cuts, sizes: bool) -> DataFrame:
    """(v, top, up[, size]) of the rows of (v, j[, size]) whose j leads to an end (a j that is null): the last row on the way, the
    steps to it, and the sum of the sizes of all rows that come by. Each j must have a row. Rows that never arrive are left out.

    Rows that have arrived are written once and only read by later rounds; a sum is the row's own size and what each round added.
    """
    size = [F.col("size").alias("size"), F.col("size").alias("own")] if sizes else []
    start = cuts.cut(rows.select("v", "j", F.when(F.col("j").isNull(), 0).otherwise(1).cast("long").alias("up"), *size, F.when(F.col("j").isNull(), F.col("v")).alias("top")))
    carried = ["size", "own"] if sizes else []
    done, gained, live = [start.where("j is null")], [], start.where("j is not null")
    count, before = live.count(), -1
    while count and count != before:
        step = _union([*done, live]).select(F.col("v").alias("j"), F.col("j").alias("jj"), F.col("up").alias("more"), F.col("top").alias("there"))
        moved = live.join(step, "j").select("v", F.col("jj").alias("j"), (F.col("up") + F.col("more")).alias("up"), *carried, F.col("there").alias("top"))
        if sizes:
            below = cuts.cut(live.groupBy(F.col("j").alias("v")).agg(F.sum("size").alias("below")))
            gained.append(below)
            moved = moved.join(below, "v", "left").select("v", "j", "up", (F.col("size") + F.coalesce("below", F.lit(0))).alias("size"), "own", "top")
        after = cuts.cut(moved)
        done.append(after.where("j is null"))
        live = after.where("j is not null")
        before, count = count, live.count()
    out = _union(done)
    if not sizes:
        return out.select("v", "top", "up")
    total = _union([out.select("v", F.col("own").alias("n")), *[g.select("v", F.col("below").alias("n")) for g in gained]]).groupBy("v").agg(F.sum("n").alias("size"))
    return out.select("v", "top", "up").join(total, "v")


def labels(nodes: DataFrame, cuts: Cuts) -> tuple[DataFrame, DataFrame]:
    """(rows, hung) of an acyclic part of (v, p), rows that lead into a cycle left out.

    rows: (v, p, root, depth, size, head, at, inner), one for each row that has a root: its chain's first row, its place on it, and
    whether it has children; p is null for roots. hung: (head, hook, skip, root, depth, size, inner) of each chain that hangs at a row,
    the latter four of its head: how far behind that row in preorder it begins.
    """
    nodes = cuts.cut(nodes)
    inner = cuts.cut(_inner(nodes))
    leaves = nodes.join(inner.select("v"), "v", "left_anti")
    bare = cuts.cut(leaves.where("p is not null").groupBy("p").agg(F.count("*").alias("leaves"), F.max("v").alias("last")))
    linked = inner.join(inner.select(F.col("v").alias("p"), F.col("v").alias("j")), "p", "left")
    sized = linked.join(bare.select(F.col("p").alias("v"), "leaves"), "v", "left").select("v", "j", (F.coalesce("leaves", F.lit(0)) + 1).alias("size"))
    whole = _resolve(sized, cuts, sizes=True)
    tree = cuts.cut(linked.select("v", F.col("j").alias("p")).join(whole, "v").select("v", "p", F.col("top").alias("root"), F.col("up").alias("depth"), "size"))
    first = tree.where("p is not null").groupBy("p").agg(F.max(F.struct("size", "v")).alias("h"), F.count("*").alias("branches"))
    # the child that goes on with the chain: the largest branch, where there is none the last leaf; and how many children there are
    heavy = tree.select(F.col("v").alias("p")).join(first, "p", "left").join(bare, "p", "left")
    heavy = cuts.cut(heavy.select("p", F.coalesce("h.v", "last").alias("heavy"), F.coalesce("h.size", F.lit(1)).alias("heavy_size"), (F.coalesce("branches", F.lit(0)) + F.coalesce("leaves", F.lit(0))).alias("children")))
    chain = tree.join(heavy.select("p", F.col("heavy").alias("v"), F.col("p").alias("j")), ["p", "v"], "left").select("v", "j")
    chained = cuts.cut(tree.join(_resolve(chain, cuts, sizes=False), "v").select("v", "p", "root", "depth", "size", F.col("top").alias("head"), F.col("up").alias("at"), F.lit(True).alias("inner")))
    above = chained.select(F.col("v").alias("p"), F.col("p").alias("known"), "root", F.col("depth").alias("d"), F.col("head").alias("h"), F.col("at").alias("a")).join(heavy.select("p", "heavy"), "p")
    goes_on = F.col("heavy") == F.col("v")
    below = leaves.join(above, "p").select("v", "p", "root", (F.col("d") + 1).alias("depth"), F.lit(1).cast("long").alias("size"), F.when(goes_on, F.col("h")).otherwise(F.col("v")).alias("head"), F.when(goes_on, F.col("a") + 1).otherwise(F.lit(0)).alias("at"), F.lit(False).alias("inner"))
    alone = leaves.join(inner.select(F.col("v").alias("p")), "p", "left_anti").select("v", F.lit(None).cast("string").alias("p"), F.col("v").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("size"), F.col("v").alias("head"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("inner"))
    rows = cuts.cut(_union([chained, below, alone]))
    # the other siblings, summed in hashed buckets so that a parent of very many children is no single task; few parents have several
    facts = heavy.select("p", "heavy_size", "children")
    light = rows.where("p is not null and at = 0").select("v", "p", "root", "depth", "size", "inner")
    bucket = F.pmod(F.xxhash64("v"), F.ceil(F.col("children") / SIBLINGS))
    inside = F.sum("size").over(Window.partitionBy("p", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    totals = light.join(facts.where(F.col("children") > SIBLINGS), "p").withColumn("b", bucket).groupBy("p", "b").agg(F.sum("size").alias("s"))
    ahead = F.sum("s").over(Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("p", "b", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    hung = light.join(facts, "p").withColumn("b", bucket).withColumn("inside", F.coalesce(inside, F.lit(0))).join(totals, ["p", "b"], "left").withColumn("ahead", F.coalesce("ahead", F.lit(0)))
    hung = cuts.cut(hung.select(F.col("v").alias("head"), F.col("p").alias("hook"), (1 + F.col("heavy_size") + F.col("ahead") + F.col("inside")).alias("skip"), "root", "depth", "size", "inner"))
    return rows, hung


def hierarchy(nodes: DataFrame, cuts: Cuts | None = None, separator: str = "/", paths: bool = True) -> DataFrame:
    """(v, root, depth, path, start, stop, descendants) of every row of (v, p) that has a root.

    path holds the keys from the root down to v, between separators; without `paths` it is null, and no value grows with the depth.
    start and stop number the rows of a tree from 0 in preorder: the descendants of v are the rows of the same root with
    start < their start < stop. A p without a row makes v a root. Rows that lead into a cycle have no root and are left out (see
    `cycles`). Empty input gives no rows.
    """
    cuts = cuts or Cuts(nodes.sparkSession)
    before = list(cuts.live)
    rows, hung = labels(nodes, cuts)
    cuts.keep_only(before, rows, hung)
    no_text = F.lit(None).cast("string")
    # chains of several rows with their keys, and where they hang: rows with children have one that goes on
    long = rows.where("inner or at > 0").select("v", "root", "depth", "size", "head", "at")
    keys = F.array_sort(F.collect_list(F.struct("at", "v")))["v"] if paths else F.lit(None).cast("array<string>")
    chains = cuts.cut(long.groupBy("head").agg(keys.alias("keys")).join(hung.where("inner").select("head", "hook", "skip"), "head", "left"))
    upto = lambda n: F.array_join(F.slice("keys", F.lit(1), (n + 1).cast("int")), separator) if paths else no_text
    hooks = hung.select(F.col("hook").alias("v")).distinct().join(long.select("v", "head", "at"), "v").join(chains.withColumnRenamed("hook", "up"), "head")
    hooks = cuts.cut(hooks.select(F.col("v").alias("hook"), "up", (F.coalesce("skip", F.lit(0)) + F.col("at")).alias("further"), upto(F.col("at")).alias("own")))
    level = hooks.where("up is null").select("hook", F.col("further").alias("place"), F.col("own").alias("prefix"))
    levels, rest = [level], hooks.where("up is not null")
    while not level.isEmpty():
        on = level.select(F.col("hook").alias("up"), F.col("place").alias("from"), F.col("prefix").alias("before"))
        level = cuts.cut(rest.join(on, "up").select("hook", (F.col("from") + F.col("further")).alias("place"), F.concat("before", F.lit(separator), "own").alias("prefix")))
        levels.append(level)
    settled = _union(levels)
    # what is as long as a path comes to each row with its chain or hook, and isn't shuffled with the rows
    along = long.join(chains.join(settled, "hook", "left"), "head").select("v", "root", "depth", "size", "at", "place", "skip", "prefix", upto(F.col("at")).alias("own"))
    zero, key = F.lit(0).cast("long"), (F.col("v") if paths else no_text).alias("own")
    single = hung.where("not inner").join(settled, "hook").select(F.col("head").alias("v"), "root", "depth", "size", zero.alias("at"), "place", "skip", "prefix").withColumn("own", key)
    alone = rows.where("p is null and not inner").select("v", "root", "depth", "size", "at", zero.alias("place"), zero.alias("skip"), no_text.alias("prefix"), key)
    out = _union([along, single, alone])
    start = F.coalesce(F.col("place") + F.col("skip"), F.lit(0)) + F.col("at")
    path = F.concat_ws(separator, "prefix", "own") if paths else no_text
    return out.select("v", "root", F.col("depth").cast("long").alias("depth"), path.alias("path"), start.alias("start"), (start + F.col("size")).alias("stop"), (F.col("size") - 1).alias("descendants"))
