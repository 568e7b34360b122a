"""The namespace: lookups, listings, directory facts, and what lies above or below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packstrata.functions.scalar import DIRECTORY, ENTRY_WEIGHT, FILE, INLINE_MAX, SYMLINK
from packstrata.operators.hierarchy import forest


def head_of(node: DataFrame) -> int | None:
    """The highest generation of ``node``, from file statistics and one number to the driver."""
    return node.agg(F.max("generation")).first()[0]


def at_generation(node: DataFrame, generation: int | None) -> DataFrame:
    """The nodes of one generation, each once (time travel)."""
    return node.where(F.col("generation") == F.lit(generation)).distinct()


def entries(edge: DataFrame) -> DataFrame:
    """Directory entries, each delivery once."""
    return edge.select("parent", "name", "inode", "type", "generation").distinct()


def lookup(edge: DataFrame, nested: DataFrame) -> DataFrame:
    """Every (parent, name) of either relation with both halves: an entry exists unless both are absent."""
    e = entries(edge).select("parent", "name", "inode", "type")
    n = nested.select("parent", "name", "catalog_identity").distinct()
    return e.join(n, ["parent", "name"], "full")


def listing(edge: DataFrame) -> DataFrame:
    """Entries with their place in the directory, in the order of name bytes."""
    place = F.row_number().over(Window.partitionBy("parent").orderBy("name"))
    return entries(edge).select("parent", "name", "inode", "type", place.cast("long").alias("place"))


def listing_with_stat(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries joined with the attributes of their inodes."""
    return entries(edge).select("parent", "name", "inode").join(nodes.select("inode", "type", "mode", "uid", "gid", "length", "mtime_ns"), "inode")


def directory_links(edge: DataFrame) -> DataFrame:
    """Link count of each directory: 2 and one for each subdirectory."""
    return entries(edge).groupBy("parent").agg((F.lit(2) + F.count_if(F.col("type") == DIRECTORY)).alias("nlink"), F.count(F.lit(1)).alias("entries"))


def entry_weight(length: Column, kind: Column) -> Column:
    """Catalog bytes of an entry: a constant, and the content of a file small enough to be inline."""
    return F.lit(ENTRY_WEIGHT) + F.when((kind == FILE) & (length <= INLINE_MAX), length).otherwise(0)


def own_weights(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, w: the weight of each directory's own entries."""
    e = entries(edge).join(nodes.select("inode", "length"), "inode", "left")
    return e.groupBy(F.col("parent").alias("node")).agg(F.sum(entry_weight(F.coalesce("length", F.lit(0)), F.col("type"))).alias("w"))


def subtree_weights(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Catalog weight of each directory with all that can be reached below it: inode, own, weight, damaged.

    What several ways lead to counts once. A directory on or below a cycle is
    damaged; its weight is its own. Runs jobs.
    """
    f = forest(edge)
    own = f.scratch.keep(own_weights(edge, nodes))
    told = own.withColumnRenamed("w", "own").join(f.below(own), "node", "left").join(f.damaged().withColumn("_bad", F.lit(True)), "node", "left")
    bad = F.coalesce("_bad", F.lit(False))
    return told.select(F.col("node").alias("inode"), "own", F.when(bad, F.col("own")).otherwise(F.col("w")).alias("weight"), bad.alias("damaged"))


def ancestors_of(edge: DataFrame, inodes: DataFrame) -> DataFrame:
    """The directories above ``inodes`` (and the inodes): the scope that a walk for changes must visit.

    By the jumps that doubling has found, so in as many joins as the depth has
    bits; cycles end. Runs jobs.
    """
    asked = inodes.select("inode").dropna().distinct()
    parents = edge.join(asked, "inode", "left_semi").select(F.col("parent").alias("node")).dropna().distinct()
    return asked.unionByName(forest(edge).ancestors(parents).select(F.col("node").alias("inode"))).distinct()


def moves_refused(edge: DataFrame, moves: DataFrame) -> DataFrame:
    """src, dst, refused of each move of a directory src into a directory dst: refused if src is dst or above it.

    Each move climbs from dst by the jumps of doubling; a chain that ends at a
    directory of several parents goes on by what reaches that one.
    """
    f = forest(edge)
    asked = f.scratch.keep(moves.select("src", "dst").dropna().distinct())
    climbed = f.chains.above(asked.select(F.col("dst").alias("node"), "src", "dst"), ["src", "dst"])
    if f.n_shared:
        climbed = f.scratch.keep(climbed)
        met = climbed.join(f.shared.select("node"), "node", "left_semi")
        over = met.join(f.reach.select("x", F.col("y").alias("node")), "node").select("x", "src", "dst").distinct()
        parents = over.join(f.entries.select(F.col("_c").alias("x"), F.col("_p").alias("node")), "x").select("node", "src", "dst").distinct()
        climbed = climbed.unionByName(over.withColumnRenamed("x", "node")).unionByName(f.chains.above(parents, ["src", "dst"]))
    hit = climbed.where("node = src").select("src", "dst").distinct().withColumn("_hit", F.lit(True))
    return asked.join(hit, ["src", "dst"], "left").select("src", "dst", (F.coalesce("_hit", F.lit(False)) | (F.col("src") == F.col("dst"))).alias("refused"))


def outside_scope(edge: DataFrame, scope: DataFrame) -> DataFrame:
    """Entries of directories that no change lies below: they can be carried over unread."""
    return entries(edge).join(scope.select(F.col("inode").alias("parent")), "parent", "left_anti")


def unplaced(edge: DataFrame, inodes: DataFrame) -> DataFrame:
    """Those of ``inodes`` that edge knows neither as an entry nor as a directory."""
    known = edge.select("inode").unionByName(edge.select(F.col("parent").alias("inode"))).dropna().distinct()
    return inodes.select("inode").dropna().distinct().join(known, "inode", "left_anti")


def inside(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths at or below each root path, by prefix: path, root.

    An equi-join on the root's leading components: each path is spread over
    its own prefixes, as many as it has components, so no pair is tried that
    does not match.
    """
    parts = F.split(F.col("path"), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    return paths.select("path", F.explode(prefixes).alias("root")).join(roots.select("root").distinct(), "root").select("path", "root")


def chunk_offsets(refs: DataFrame) -> DataFrame:
    """Chunk references with their logical offset: the lengths before them in the file."""
    w = Window.partitionBy("inode").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return refs.withColumn("off", (F.sum("llen").over(w) - F.col("llen")).cast("long"))


def overlapping(refs: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """References whose bytes meet [lo, hi); holes (null identity) are left out."""
    return refs.where((F.col("off") + F.col("llen") > lo) & (F.col("off") < hi) & F.col("identity").isNotNull())


def read_range(refs: DataFrame, lo: int, hi: int) -> DataFrame:
    """Bytes [lo, hi) of each file from its chunks (inode, off, llen, data); holes read as zeros.

    Chunks are cut to the range and joined in offset order; a gap before a
    chunk, or after the last up to the file's length, is filled.
    """
    w = Window.partitionBy("inode").orderBy("off")
    size = F.max(F.col("off") + F.col("llen")).over(Window.partitionBy("inode"))
    cut = refs.withColumn("_end", F.least(F.lit(hi), size)).where((F.col("off") + F.col("llen") > lo) & (F.col("off") < hi))
    a, b = F.greatest("off", F.lit(lo)), F.least(F.col("off") + F.col("llen"), F.col("_end"))
    zeros = lambda n: F.repeat(F.lit("\0"), n.cast("int")).cast("binary")
    body = F.coalesce(F.substring(F.col("data"), (a - F.col("off") + 1).cast("int"), (b - a).cast("int")), zeros(b - a))
    cut = cut.select("inode", "off", a.alias("_a"), b.alias("_b"), body.alias("_d"))
    gap = F.col("_a") - F.coalesce(F.lag("_b").over(w), F.lit(lo))
    cut = cut.withColumn("_d", F.concat(zeros(F.greatest(gap, F.lit(0))), F.col("_d")))
    return cut.groupBy("inode").agg(F.expr("listagg(_d) within group (order by _a)").alias("bytes"))


def xattr_names(xattrs: DataFrame) -> DataFrame:
    """inode and the sorted names of its attributes; inodes without any have no row."""
    return xattrs.groupBy("inode").agg(F.array_sort(F.collect_set("name")).alias("names"))


def xattr_values(asked: DataFrame, xattrs: DataFrame) -> DataFrame:
    """The value of each asked (inode, name); ``present`` tells an absent attribute from an empty one."""
    held = xattrs.select("inode", "name", "value", F.lit(True).alias("_has"))
    return asked.join(held, ["inode", "name"], "left").select("inode", "name", "value", F.coalesce("_has", F.lit(False)).alias("present"))


def link_targets(links: DataFrame, kinds: DataFrame) -> DataFrame:
    """``links`` with target and state: 'ok', 'not-a-link' if the inode is of another kind, 'missing' if it is not known; the target only of the first."""
    told = links.join(kinds.select("inode", F.col("type").alias("_t")), "inode", "left")
    ok = F.coalesce(F.col("_t") == SYMLINK, F.lit(False))
    return told.withColumn("target", F.when(ok, F.col("target"))).withColumn("state", F.when(F.col("_t").isNull(), "missing").when(ok, "ok").otherwise("not-a-link")).drop("_t")
