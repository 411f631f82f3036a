"""Prefix trie of conversations: members, subtrees and the tokens that shared prefixes save.

A turn of a rebuilt conversation adds a hash of (depth, role, text) to a 128-bit running sum,
which names the prefix that ends there.  Running sums go over range parts, so that a huge
conversation is cut over many tasks, and texts stay behind as digests.

Subtree totals roll up by depth bands.  Within a band of ``BAND`` levels every node adds its
values to its ancestors there, at most BAND of them.  Band roots then are a trie
of their own, BAND times less deep, which is rolled up in the same way; completed
band-root totals go down again to the band above.  So a row makes at most BAND rows,
and the rounds grow with the logarithm of the depth."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.operators.running import running_sums

from .common import written

BAND = 8
LANES = ["s0", "s1", "s2", "s3"]
#: Ends joined into one string on average.
ENDS_PER_PART = 100_000


def _long(c) -> Column:
    return c.cast("long")


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums])))


def _lanes(depth: Column, digest: Column) -> list[Column]:
    """128 bits of a turn at its depth as four 32-bit numbers, whose sums cannot overflow."""
    halves = [F.xxhash64(F.lit(salt), depth, digest) for salt in (1, 2)]
    return [part for x in halves for part in (x.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(x, 32))]


def rebuilt(turns: DataFrame, *, conv_col: str, turn_col: str, role_col: str, text_col: str, block: int,
            shared: int) -> tuple[DataFrame, DataFrame]:
    """((conv, depth, digest, chars) of every rebuilt turn, (conv, total) of every conversation).

    The first h turns come from the first conversation of the block of ``block`` ids; h = crc32 of the id mod ``shared``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        _long(F.col(conv_col)).alias("conv"), F.col(turn_col).alias("turn"), F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        _long(F.length(text)).alias("chars"), _long(F.lit(1)).alias("one"))
    placed = written(running_sums(written(rows, "turns"), ["conv"], ["turn", "digest", "row"], ["one"], prefix="upto_").select(
        "conv", F.col("upto_one").alias("pos"), "digest", "chars"), "placed-turns")
    own = placed.groupBy("conv").agg(F.max("pos").alias("len"))
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    convs = own.select("conv", "len", taken.alias("h"), (F.col("conv") - F.col("conv") % block).alias("base"))
    convs = written(convs.join(own.select(F.col("conv").alias("base"), F.col("len").alias("have")), "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("have", F.lit(0))).alias("given"),
        F.greatest(F.col("len") - F.col("h"), F.lit(0)).alias("kept")), "conversations")
    first = placed.where((F.col("conv") % block == 0) & (F.col("pos") < shared)).withColumnRenamed("conv", "base")
    front = convs.join(first, "base").where("pos <= h").select("conv", F.col("pos").alias("depth"), "digest", "chars")
    back = placed.join(convs, "conv").where("pos > h").select(
        "conv", (F.col("given") + F.col("pos") - F.col("h")).alias("depth"), "digest", "chars")
    return front.unionByName(back), convs.select("conv", (F.col("given") + F.col("kept")).alias("total"))


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Written (conv, depth, node, parent, chars): every prefix of every conversation, the empty one included."""
    laned = turns.select("*", *[x.alias(s) for s, x in zip(LANES, _lanes(F.col("depth"), F.col("digest")), strict=True)])
    summed = running_sums(written(laned.drop("digest"), "rebuilt-turns"), ["conv"], "depth", LANES, prefix="upto_")
    here = [F.col("upto_" + s) for s in LANES]
    depth = _long(F.col("depth"))
    named = summed.select(
        "conv", depth.alias("depth"), _name(depth, here).alias("node"),
        _name(depth - 1, [x - F.col(s) for x, s in zip(here, LANES, strict=True)]).alias("parent"), "chars")
    zero = _long(F.lit(0))
    roots = convs.select("conv", zero.alias("depth"), _name(zero, [zero] * 4).alias("node"),
                         F.lit(None).cast("binary").alias("parent"), zero.alias("chars"))
    return written(named.unionByName(roots), "prefixes")


def _bands(prefixes: DataFrame, level: int) -> DataFrame:
    """Written (node, inside, up): the nodes of a level with their ancestors in its band, themselves
    included (``inside``), and band roots once more with all of the band above."""
    step = BAND ** level
    idx = F.expr(f"depth div {step}")
    rows = prefixes.where(F.col("depth") % step == 0).select("conv", "node", idx.alias("idx"))
    member = F.struct(F.expr(f"idx div {BAND}").alias("band"), F.lit(True).alias("inside"))
    leaving = F.struct(F.expr(f"idx div {BAND} - 1").alias("band"), F.lit(False).alias("inside"))
    both = rows.select("conv", "node", "idx", F.explode(F.when((F.col("idx") % BAND == 0) & (F.col("idx") > 0), F.array(
        member, leaving)).otherwise(F.array(member))).alias("m")).select("conv", "node", "idx", "m.*")
    runs = both.groupBy("conv", "band").agg(F.sort_array(F.collect_list(F.struct("idx", "inside", "node"))).alias("run"))
    each = runs.select("run", F.posexplode("run").alias("at", "x"))
    up = F.slice("run", F.lit(1), F.when(F.col("x.inside"), F.col("at") + 1).otherwise(F.col("at")))["node"]
    each = each.select(F.col("x.node").alias("node"), F.col("x.inside").alias("inside"), up.alias("up"))
    return written(each.groupBy("node", "inside").agg(F.first("up").alias("up")), f"bands-{level}")


def _added(bands: DataFrame, values: DataFrame, sums: list[str]) -> DataFrame:
    """Values of nodes summed over the ancestors in ``up``."""
    spread = bands.join(values, "node").select(F.explode("up").alias("node"), *sums)
    return spread.groupBy("node").agg(*[F.sum(s).alias(s) for s in sums])


def subtree_sums(prefixes: DataFrame, values: DataFrame, sums: list[str], deepest: int) -> DataFrame:
    """(node, sums) over every node's subtree, from the nodes' own ``values``."""
    bands, inside, level = [], [], 0
    while True:
        bands.append(_bands(prefixes, level))
        inside.append(written(_added(bands[-1].where("inside"), values, sums), f"inside-{level}"))
        level += 1
        if BAND ** level > deepest:
            break
        roots = prefixes.where(F.col("depth") % BAND ** level == 0).select("node").distinct()
        values = inside[-1].join(roots, "node", "left_semi")
    whole = inside[-1]
    for level in reversed(range(len(bands) - 1)):
        below = _added(bands[level].where("not inside"), whole, sums)
        whole = written(inside[level].unionByName(below).groupBy("node").agg(*[F.sum(s).alias(s) for s in sums]),
                        f"whole-{level}")
    return whole


def _hashed_lists(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv): conversations joined in order within range parts,
    and the parts' strings hashed one after the other as they stream by."""
    ends = written(ends, "ends")
    parts = -(-ends.count() // ENDS_PER_PART) or 1
    dealt = ends.repartitionByRange(parts, "node", "conv").withColumn("part", F.spark_partition_id())
    strings = dealt.groupBy("node", "part").agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    strings = strings.select("node", F.col("ids")[0].alias("first"),
                             F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if n != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    streamed = strings.repartition("node").sortWithinPartitions("node", "first").select("node", "text")
    return streamed.mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", block: int = 100, shared: int = 6) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node.

    Turns go by number, null first, then by a digest of role and text, so equal
    numbers have one order; repeated rows are turns of their own.  Null roles and
    texts are empty.  Rows without a conversation id belong to none and are left out.
    A conversation whose turns are all replaced by nothing ends at the root.  Very
    long texts count whole; an empty table gives no node, not even a root."""
    made, convs = rebuilt(turns, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col,
                          block=block, shared=shared)
    prefixes = _prefixes(made, convs)
    nodes = written(prefixes.groupBy("node").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("depth").alias("depth"),
        F.max("parent").alias("parent"), F.max("chars").alias("chars")), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "node", "left").fillna(0, "n_children"), "nodes-and-children")
    values = nodes.select("node", _long(F.col("n_children") == 0).alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    totals = subtree_sums(prefixes, values, ["n_leaves", "saved_tokens"], deepest)
    ended = prefixes.join(convs.withColumnRenamed("total", "depth"), ["conv", "depth"]).select("node", "conv")
    lists = _hashed_lists(ended)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, "node").join(lists, "node", "left").join(parents, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
