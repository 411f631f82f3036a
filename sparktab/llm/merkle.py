"""Merkle manifest of a table, and the climb that verifies every row against its root.

A row is a leaf; the leaves of a language, by id, are hashed in runs of eight, level by
level, to the language's subroot, and the subroots, by language, in the same way to the
root.  Built levels are stored as rows linked to their parents: a node holds its
children's digests and knows its parent and its place there.

The climb is one recursive query.  A step joins the climbing rows with the parents'
rows, folds the climbing hash among its siblings and appends those to the proof.
Leaves of one run have the same siblings from there on, so the run climbs as one
row with one fold per leaf: an eighth of the rows, and siblings are carried once.

Near the root all climbs meet in a few nodes.  A node is therefore stored once for each block of
``BLOCK_RUNS`` runs beneath it and joined on (node, block), so that no key has more rows than a block.
Digests are 32 bytes everywhere and hashed as hex text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.operators.running import running_sums

from .common import written

FAN = 8
#: Runs (FAN ** 3) that climb through the same copy of a node: what a node of level BLOCK_LEVEL covers.
BLOCK_LEVEL = 4
BLOCK_RUNS = FAN ** (BLOCK_LEVEL - 1)
TOP = -1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

CLIMB = """
WITH RECURSIVE climb(home, run, block, grp, level, pos, place, folds, proof) AS (
  SELECT home, run, block, grp, level, pos, place, folds, CAST('' AS BINARY) FROM {starts}
  UNION ALL
  SELECT c.home, c.run, c.block, n.up_grp, n.up_level, n.up_pos, n.up_place,
         transform(c.folds, f -> unhex(sha2(lower(hex(concat(
             substring(n.kids, 1, 32 * c.place), f, substring(n.kids, 32 * c.place + 33)))), 256))),
         concat(c.proof, substring(n.kids, 1, 32 * c.place), substring(n.kids, 32 * c.place + 33))
  FROM climb c JOIN {nodes} n
    ON c.grp = n.grp AND c.level = n.level AND c.pos = n.pos AND c.home = n.home AND c.block = n.block)
SELECT home, run, folds, proof FROM climb WHERE grp IS NULL
"""


def field(c: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def tampered_text(id_col: Column, text: Column) -> Column:
    """The text with A-Z in lower case where 3 divides the crc32 of the id's text."""
    chosen = F.crc32(id_col.cast("string").cast("binary")) % 3 == 0
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.when(chosen, low).otherwise(text)


def _digest(kids: str) -> Column:
    return F.unhex(F.sha2(F.lower(F.hex(kids)), 256))


def _joined(kids: Column) -> Column:
    return F.aggregate(kids, F.lit(b""), lambda a, k: F.concat(a, k["hash"]))


def _levels(first: DataFrame, most: int, first_level: int) -> list[DataFrame]:
    """Written nodes (grp, level, pos, n, hash, kids), level by level, above the nodes
    ``first`` (grp, pos, n, hash) of level ``first_level``; n counts a group's nodes there."""
    out, below, level = [], first, first_level
    while most > 1:
        most, level = -(-most // FAN), level + 1
        runs = below.where("n > 1").groupBy("grp", F.expr(f"pos div {FAN}").alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("kids"), F.first("n").alias("n"))
        out.append(written(runs.select(
            "grp", F.lit(level).alias("level"), F.col("up").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"),
            _joined(F.col("kids")).alias("kids")).withColumn("hash", _digest("kids")), f"level-{level}"))
        below = out[-1]
    return out


def _linked(nodes: DataFrame, languages: int) -> DataFrame:
    """Nodes (grp, level, pos, n, ...) with their parents, null above the root, and their places there."""
    inner = F.col("n") > 1
    to_top = (F.col("grp") != TOP) & F.lit(languages > 1)
    return nodes.withColumns({
        "up_grp": F.when(inner, F.col("grp")).when(to_top, F.lit(TOP).cast("long")),
        "up_level": F.when(inner, F.col("level") + 1).when(to_top, F.lit(1)),
        "up_pos": F.when(inner, F.expr(f"pos div {FAN}")).when(to_top, F.expr(f"grp div {FAN}")),
        "up_place": F.when(inner, F.col("pos") % FAN).when(to_top, F.col("grp") % FAN).cast("int")})


def _copied(nodes: DataFrame, blocks: DataFrame, depth: int, top_depth: int) -> DataFrame:
    """Node rows with the (home, block) of the climbs that pass: one for each block beneath."""
    low = nodes.where((F.col("grp") != TOP) & (F.col("level") <= BLOCK_LEVEL)).select(
        "*", F.col("grp").alias("home"),
        F.floor(F.col("pos") / F.pow(F.lit(float(FAN)), F.lit(BLOCK_LEVEL) - F.col("level"))).alias("block"))
    passed = [F.struct(F.col("home").alias("grp"), F.lit(x).alias("level"),
                       F.expr(f"block div {FAN ** (x - BLOCK_LEVEL)}").alias("pos"))
              for x in range(BLOCK_LEVEL + 1, depth + 1)]
    passed += [F.struct(F.lit(TOP).cast("long").alias("grp"), F.lit(x).alias("level"),
                        F.expr(f"home div {FAN ** x}").alias("pos")) for x in range(1, top_depth + 1)]
    if not passed:
        return low
    wanted = blocks.select("home", "block", F.explode(F.array(*passed)).alias("p")).select("home", "block", "p.*")
    high = nodes.where((F.col("grp") == TOP) | (F.col("level") > BLOCK_LEVEL)).join(wanted, ["grp", "level", "pos"])
    return low.unionByName(high)


def _climbed(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every run's folds and proof at the root; written at once, as the query's row limit is a session's."""
    spark = starts.sparkSession
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return written(spark.sql(CLIMB, starts=starts, nodes=nodes), "climbed")
    finally:
        spark.conf.set(limit, before)


def verify_manifest(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang",
                    chars_col: str = "n_chars", text_col: str = "text") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per input row.

    Null fields are hashed as ``-``; null ids come first in their language, null
    languages are one that comes first, and null texts stay when tampered with.  Rows
    of one id go by leaf digest, so repeated rows are leaves of their own.  Empty and
    very long texts are hashed whole; a language's lone leaf is its subroot, a lone
    subroot the root; an empty table gives an empty result."""
    row_id, text = F.col(id_col), F.col(text_col)
    rest = [F.col(c) for c in (source_col, lang_col, chars_col)]
    leaves = written(docs.select(
        F.monotonically_increasing_id().alias("row"), row_id.cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"), leaf(row_id, *rest, text).alias("leaf"),
        leaf(row_id, *rest, tampered_text(row_id, text)).alias("used"), F.lit(1).cast("long").alias("one")), "leaves")
    langs = leaves.groupBy("lang").agg(F.count("*").alias("n")).withColumn("one", F.lit(1).cast("long"))
    groups = written(running_sums(langs, [], "lang", ["one"], prefix="upto_").select(
        "lang", "n", (F.col("upto_one") - 1).alias("grp")), "languages")
    languages, most = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()

    placed = running_sums(leaves, ["lang"], ["doc_id", "leaf", "row"], ["one"], prefix="upto_").alias("l").join(
        groups.alias("g"), F.col("l.lang").eqNullSafe(F.col("g.lang"))).select(
        "grp", "n", (F.col("upto_one") - 1).alias("pos"), "doc_id", F.col("leaf").alias("hash"), "used")
    runs = written(placed.groupBy(F.col("grp").alias("home"), F.expr(f"pos div {FAN}").alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "doc_id", "hash", "used"))).alias("leaves"), F.first("n").alias("n"))
        .withColumn("block", F.expr(f"run div {BLOCK_RUNS}")), "runs")

    kids = _joined(F.col("leaves"))
    first = written(runs.where("n > 1").select(
        F.col("home").alias("grp"), F.lit(1).alias("level"), F.col("run").alias("pos"),
        F.ceil(F.col("n") / FAN).alias("n"), kids.alias("kids")).withColumn("hash", _digest("kids")), "level-1")
    inside = [first, *_levels(first, -(-most // FAN), 1)]
    lone = runs.where("n = 1").select(F.col("home").alias("grp"), F.col("leaves")[0]["hash"].alias("hash"))
    subroots = lone
    for level in inside:
        subroots = subroots.union(level.where("n = 1").select("grp", "hash"))
    subroots = written(subroots, "subroots")
    above = _levels(subroots.select(F.lit(TOP).cast("long").alias("grp"), F.col("grp").alias("pos"),
                                    F.lit(languages).cast("long").alias("n"), "hash"), languages, 0)
    nodes = inside[0]
    for level in [*inside[1:], *above]:
        nodes = nodes.unionByName(level)
    nodes = _linked(nodes, languages).drop("n", "hash")
    blocks = runs.where(f"run % {BLOCK_RUNS} = 0").select("home", "block")
    copies = written(_copied(nodes, blocks, len(inside), len(above)), "nodes")

    own = F.transform("leaves", lambda x, i: F.when(F.col("size") == 1, x["used"]).otherwise(F.unhex(F.sha2(F.lower(F.hex(
        F.concat(F.substr("kids", F.lit(1), 32 * i), x["used"], F.substr("kids", 32 * i + 33)))), 256))))
    starts = _linked(runs.select("home", "run", "block", F.col("home").alias("grp"), F.lit(1).alias("level"),
                                 F.col("run").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), "leaves",
                                 kids.alias("kids"), F.col("n").alias("size")), languages)
    done = _climbed(starts.select("home", "run", "block", F.col("up_grp").alias("grp"), F.col("up_level").alias("level"),
                                  F.col("up_pos").alias("pos"), F.col("up_place").alias("place"), own.alias("folds")),
                    copies)

    top = (subroots if languages <= 1 else above[-1]).select("hash").first()
    root = F.lit(top["hash"].hex() if top else None).cast("string")
    at = F.col("at")
    others = F.concat(F.slice("leaves", F.lit(1), at), F.slice("leaves", at + 2, F.lit(FAN)))
    out = runs.select("home", "run", "leaves").join(done, ["home", "run"]).join(
        subroots.select(F.col("grp").alias("home"), F.col("hash").alias("sub")), "home").select(
        "leaves", "folds", "proof", "sub", F.posexplode("leaves").alias("at", "own"))
    return out.select(
        F.col("own.doc_id").alias("doc_id"), F.lower(F.hex("own.hash")).alias("leaf"),
        F.lower(F.hex("sub")).alias("subroot"), root.alias("root"),
        F.sha2(F.lower(F.hex(F.concat(_joined(others), "proof"))), 256).alias("proof_sha256"),
        F.lower(F.hex(F.get("folds", at))).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
