"""The trie of conversation prefixes, rolled up by depth bands.

Conversations are rebuilt (the first turns of one in each hundred, then their own) and every distinct sequence of
first turns is a node. Depths are cut into bands of HEIGHT turns. A conversation's turns in one band are a bounded
list, from which the nodes' digests, their parents and their ancestors within the band come; each whole band is one
turn of a conversation of bands, to which the same is done, so a conversation of n turns takes log n rounds to the base
HEIGHT and no list is longer than HEIGHT. Sums over subtrees go the same way: each node explodes to its ancestors
within its band alone; what hangs below each band's root is summed up in the trie of bands, and the completed totals
are added to the ancestors within the band above.

No conversation, node or host is gathered in one task: turns are numbered by a range order with a carry for each part
of a conversation, members of a node are counted before the shuffle. The SHA-256 of a node's members is one chain by
its definition: ids are sorted by ranges, joined to pieces of PIECE bytes there, and a task reads a node's pieces one
by one. Nodes are named by 128 bits of SHA-256.

Results for odd input: rows without conv_id are in no conversation; null role and text are empty; a null turn comes
first, turns with the same number are in the order of the first 64 code points of role, then of text, then of a digest
of both, and repeated rows are as many turns; other columns are left alone; a table without conversations gives no
rows, not even a root.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from torquil.llm import common as C

#: Turns of a band: what a list or an explosion has at most.
HEIGHT = 4
#: One conversation in so many lends its first turns, at most LENT - 1.
HUNDRED, LENT = 100, 6
#: Bytes of ids that a row of the members' chains has at most, but for the last id.
PIECE = 1 << 16


def _root() -> Column:
    """The node of no turns."""
    return F.unhex(F.lit(""))


def _digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: turns (conv_id, h, points, at), at being their places in the order of all, and parts (conv_id, part, first, n, before, total)."""
    spark = conversations.sparkSession
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).where("conv_id is not null")
    h = _digest(F.length("role").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("role").cast("binary"), F.col("text").cast("binary"))
    short = turns.select("conv_id", "turn", *[F.substring(c, 1, 64).alias(c) for c in ("role", "text")], h.alias("h"), F.length("text").cast("long").alias("points"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "text", "h", "row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = C.written(short.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "h", "points", F.monotonically_increasing_id().alias("at")), "turns")
    per = turns.groupBy("conv_id", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("conv_id")  # no more rows than the order has ranges
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns, C.written(per.select("*", before.alias("before"), F.sum("n").over(w).alias("total")), "parts")


def rebuilt(turns: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, i, h, points, ends) of the rebuilt turns, and (conv_id, length) of every conversation."""
    place = lambda t: t.withColumn("part", F.shiftright("at", 33))
    pos = F.col("at") - F.col("first") + F.col("before") + 1
    hosts = f"conv_id % {HUNDRED} = 0"
    heads = place(turns.where(hosts)).join(parts.where(hosts).where(F.col("before") < LENT - 1), ["conv_id", "part"]).select("conv_id", pos.alias("i"), "h", "points").where(F.col("i") < LENT)
    heads = heads.groupBy(F.col("conv_id").alias("host")).agg(F.sort_array(F.collect_list(F.struct("i", "h", "points"))).alias("head"))
    convs = parts.where("before = 0").select("conv_id", "total", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT).cast("int").alias("taken"), F.expr(f"conv_id - conv_id % {HUNDRED}").alias("host"))
    convs = convs.join(heads, "host", "left").withColumn("lent", F.least("taken", F.coalesce(F.size("head"), F.lit(0))))
    convs = convs.withColumn("lent", F.greatest("lent", F.lit(0))).withColumn("length", F.col("lent") + F.greatest(F.col("total") - F.col("taken"), F.lit(0)))
    convs = C.written(convs.select("conv_id", "taken", "lent", "length", F.when(F.col("lent") > 0, F.slice("head", 1, F.col("lent"))).alias("head")), "convs")
    lent = convs.where("lent > 0").select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", "t.i", "t.h", "t.points", (F.col("t.i") == F.col("length")).alias("ends"))
    known = parts.select("conv_id", "part", "first", "before").join(convs.select("conv_id", "taken", "lent", "length"), "conv_id")
    own = place(turns).join(known, ["conv_id", "part"]).where(pos > F.col("taken")).withColumn("i", pos - F.col("taken") + F.col("lent"))
    items = own.select("conv_id", "i", "h", "points", (F.col("i") == F.col("length")).alias("ends")).union(lent.select("conv_id", "i", "h", "points", "ends"))
    return C.written(items, "rebuilt"), convs


def prefixes(items: DataFrame, height: int) -> list[DataFrame]:
    """Written tables (conv_id, i, node, parent, up, top) of the turns, of the whole bands, of the whole bands of bands, and so on.

    node is the digest of the first i items, up the nodes of its band down to it, top the node above the band.
    """
    bands = items.groupBy("conv_id", F.floor((F.col("i") - 1) / height).alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("xs"))
    joined = lambda xs, start: F.aggregate(xs, start, lambda a, x: F.concat(a, x["h"]))
    above: list[DataFrame] = []
    kept: list[DataFrame] = []
    if (items.agg(F.max("i")).first()[0] or 0) > height:
        bands = C.written(bands, "bands")
        kept = [bands]
        above = prefixes(bands.select("conv_id", (F.col("b") + 1).alias("i"), _digest(joined(F.col("xs"), _root())).alias("h")), height)
        bands = bands.join(above[0].select("conv_id", (F.col("i") - 1).alias("b"), F.col("parent").alias("top"), F.col("node").alias("whole")), ["conv_id", "b"])
    else:
        bands = bands.withColumns({"top": _root(), "whole": _root()})
    node = lambda j: F.when((j == height) & (F.length("whole") > 0), F.col("whole")).otherwise(_digest(joined(F.slice("xs", F.lit(1), j), F.col("top"))))
    ids = bands.withColumn("ids", F.transform(F.sequence(F.lit(1), F.size("xs")), node))
    j = F.col("j") + 1
    rows = ids.select("conv_id", "b", "top", "ids", F.posexplode("ids").alias("j", "node"))
    out = rows.select("conv_id", (F.col("b") * height + j).alias("i"), "node", F.when(F.col("j") > 0, F.col("ids")[F.col("j") - 1]).otherwise(F.col("top")).alias("parent"), F.slice("ids", F.lit(1), j).alias("up"), "top")
    out = C.written(out, "prefixes")
    C.drop(*kept)
    return [out, *above]


def rolled_up(levels: list[DataFrame], own: DataFrame, values: list[str]) -> DataFrame:
    """(node, values), written: sums over each node's subtree, and over all of them for the root, of own (node, values) of the first level's nodes (node, up, top)."""
    here = levels[0].join(own, "node")
    total = lambda df: C.written(df.groupBy("node").agg(*[F.sum(v).alias(v) for v in values]), "sums")
    within = here.select(F.explode("up").alias("node"), *values)
    under = total(here.select(F.col("top").alias("node"), *values))
    parts, used = [within, under.where(F.col("node") == _root())], [under]
    if len(levels) > 1:
        whole = rolled_up(levels[1:], under.where(F.col("node") != _root()), values)
        parts += [levels[0].join(whole, "node").select(F.explode("up").alias("node"), *values), whole.where(F.col("node") == _root())]
        used.append(whole)
    out = total(reduce(DataFrame.union, parts))
    C.drop(*used)
    return out


def _pieces(batches):
    """(node, first, piece) of rows sorted by node and conv_id: ids joined by commas."""
    node, first, ids, size = None, 0, [], 0
    row = lambda: pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "first": pa.array([first]), "piece": pa.array([",".join(ids).encode()])})
    for batch in batches:
        for x, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (x != node or size >= PIECE):
                yield row()
                ids, size = [], 0
            if not ids:
                node, first = x, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        yield row()


def _chained(batches):
    """(node, ends_sha256) of pieces sorted by node and first id."""
    node, state, out = None, None, []
    rows = lambda: pa.RecordBatch.from_pydict({"node": pa.array([n for n, _ in out], pa.binary()), "ends_sha256": pa.array([s for _, s in out], pa.string())})
    for batch in batches:
        for x, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist()):
            if x == node:
                state.update(b",")
            else:
                if state:
                    out.append((node, state.hexdigest()))
                node, state = x, hashlib.sha256()
            state.update(piece)
        yield rows()
        out = []
    if state:
        out = [(node, state.hexdigest())]
        yield rows()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ends (node, conv_id)."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node binary, first long, piece binary")
    return pieces.repartition(parts, "node").sortWithinPartitions("node", "first").mapInArrow(_chained, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    turns, parts = numbered(conversations)
    items, convs = rebuilt(turns, parts)
    levels = prefixes(items, height)
    rows = levels[0].join(items.select("conv_id", "i", "points", "ends"), ["conv_id", "i"])
    same = lambda *names: [F.first(c).alias(c) for c in names]
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("i").alias("depth"), F.count("*").alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"), F.min("points").alias("points"), *same("parent", "up", "top"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum((F.col("length") == 0).cast("long")).alias("n_ends")).where("n_convs > 0")
    root = root.select(_root().alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", "n_ends", F.lit(0).cast("long").alias("points"), F.lit(None).cast("binary").alias("parent"), F.array().cast("array<binary>").alias("up"), F.lit(None).cast("binary").alias("top"))
    nodes = C.written(nodes.union(root).withColumns({"leaves": (F.col("n_ends") == F.col("n_convs")).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("points")}), "nodes")
    below = nodes.where("depth > 0")
    bands = [level.groupBy("node").agg(*same("up", "top")) for level in levels[1:]]
    values = ["leaves", "saved"]
    sums = rolled_up([below.select("node", "up", "top"), *bands], below.select("node", *values), values).select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    children = below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    ends = levels[0].join(items.where("ends").select("conv_id", "i"), ["conv_id", "i"]).select("node", "conv_id").union(convs.where("length = 0").select(_root().alias("node"), "conv_id"))
    ends = C.written(ends_digests(ends), "ends")
    C.drop(turns, parts, items, convs, *levels)
    # a node that very many nodes hang from: both sides are plain tables, so that its rows can be split
    named = nodes.select("node", "conv_id", "depth", "n_convs", "leaves", "parent").join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    out = named.join(sums, "node", "left").join(children, "node", "left").join(ends, "node", "left")
    none = F.lit(hashlib.sha256().hexdigest())
    out = out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("depth") == 0, F.greatest(F.coalesce("n_leaves", F.lit(0)), F.col("leaves"))).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    return out


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The unsigned CRC-32 of decimal digits, bit by bit.
_CRC = """4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({s})), lambda i: ascii(substr({s}, i + 1, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""

SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce("text", '') AS txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
orig AS (SELECT conv_id, list({{'role': role, 'txt': txt}} ORDER BY pos) AS xs FROM t GROUP BY 1),
h AS (SELECT conv_id, xs, conv_id - conv_id % 100 AS host, ({_CRC.format(s="conv_id::VARCHAR")}) % 6 AS h FROM orig),
c AS (SELECT h.conv_id, coalesce(list_slice(o.xs, 1, h.h), []) || list_slice(h.xs, h.h + 1, len(h.xs)) AS xs FROM h LEFT JOIN orig o ON o.conv_id = h.host),
m AS (SELECT conv_id, len(xs) AS n, unnest(range(len(xs) + 1)) AS depth, xs FROM c),
nodes AS (SELECT list_slice(xs, 1, depth) AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256, bool_and(n = depth) AS leaf FROM m GROUP BY 1, 2),
w AS (SELECT *, leaf::INT AS l, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(p[depth].txt) END AS s FROM nodes),
up AS (SELECT list_slice(p, 1, a) AS q, a, l, s FROM (SELECT p, l, s, unnest(range(depth + 1)) AS a FROM w)),
sums AS (SELECT q, a, sum(l) AS n_leaves, sum(s) AS saved FROM up GROUP BY 1, 2),
kids AS (SELECT list_slice(p, 1, depth - 1) AS q, depth - 1 AS a, count(*) AS n FROM w WHERE depth > 0 GROUP BY 1, 2)
SELECT w.conv_id, w.depth, par.conv_id AS parent_conv_id, w.n_convs, coalesce(kids.n, 0) AS n_children, sums.n_leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN sums ON sums.a = w.depth AND sums.q = w.p LEFT JOIN kids ON kids.a = w.depth AND kids.q = w.p LEFT JOIN w par ON w.depth > 0 AND par.depth = w.depth - 1 AND par.p = list_slice(w.p, 1, w.depth - 1)"""
