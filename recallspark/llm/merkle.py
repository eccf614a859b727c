"""A Merkle manifest of a table, level by level with joins of siblings.

Rows are leaves; the leaves of each group form a tree, and the roots of the groups form one more tree.  Every level is a table of nodes, numbered
within their tree: each node asks for its siblings (its own index XOR 1 in a binary tree, its slot shifted by each offset within
its run otherwise) and an equijoin with the same table brings their digests; the rows in slot zero emit the parents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from recallspark.llm._common import require, saved, table

#: Nodes that become one parent.
FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Binary sha256 of strings, one after the other."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def row_digest(*fields: Column) -> Column:
    """Digest of a row: of each field its length in UTF-8 bytes, a colon and the value, or a hyphen for null."""
    text = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def lowered(c: Column) -> Column:
    """A-Z in lower case, and no other letter."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with g, the number of their group (nulls first, then bytewise), i, their place in it by `order`, and n, the rows of the group.

    Rows are dealt by ranges of group and order, and equal ones by their place in the table, so a group of any size spreads; one row for each
    range and group says where the range begins in the group.
    """
    own = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(F.asc_nulls_first(group), *[F.asc_nulls_first(c) for c in order], F.asc("_row"))
    own = own.sortWithinPartitions(F.asc_nulls_first(group), *[F.asc_nulls_first(c) for c in order], F.asc("_row"))
    own = saved(own.select(*rows.columns, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "leaves")
    parts = own.groupBy("_range", F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before, whole = W.Window.partitionBy("_group").orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1), W.Window.partitionBy("_group")
    parts = saved(parts.withColumns({"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(whole)}), "ranges")
    groups = parts.where("_start = 0").select(F.col("_group").alias("_key"))
    if group == "_all":
        numbers = groups.withColumn("g", F.lit(0).cast("long"))
    else:
        numbers = placed(groups.withColumn("_all", F.lit(0)), "_all", ["_key"]).select("_key", F.col("i").alias("g"))
    numbers = numbers.select(F.col("_key").alias("_named"), "g")
    parts = parts.join(numbers, F.col("_group").eqNullSafe(F.col("_named"))).select(F.col("_range").alias("_part"), F.col("_group").alias("_owner"), "_first", "_start", "n", "g")
    out = own.join(parts, (F.col("_range") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_owner")))
    return out.select(*rows.columns, "g", (F.col("_at") - F.col("_first") + F.col("_start")).alias("i"), "n")


def levels(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the trees of nodes (g: the tree, i: 0 to n - 1, n, digest, and columns that only the first level keeps).

    Each level is a written table with the digests of the whole run of a node, in order, as `run`.  A node with n = 1 is the root of its
    tree.  There are as many levels as the logarithm of the largest tree says; no level looks at anything but its own nodes.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = []
    more = [c for c in nodes.columns if c not in ("g", "i", "n", "digest")]
    while True:
        # Nodes of one run share a partition, and the join and the grouping keep it: what is shuffled is each node twice, not its siblings.
        own = nodes.withColumn("block", F.expr(f"i div {fanout}")).repartition("g", "block")
        asks = own.select("g", "block", "i", "n", *more, F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("shift"))
        has = own.select(F.col("g").alias("g2"), F.col("block").alias("block2"), F.col("i").alias("sibling"), "digest")
        if fanout == 2:
            shifted = F.col("sibling").bitwiseXOR(F.col("i"))
        else:
            shifted = F.pmod(F.col("sibling") - F.col("i"), F.lit(fanout))
        met = asks.join(has, (F.col("g") == F.col("g2")) & (F.col("block") == F.col("block2")) & (shifted == F.col("shift").cast("long")))
        level = met.groupBy("g", "block", "i").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("sibling", "digest"))).alias("_run"), *[F.first(c).alias(c) for c in more])
        level = saved(level.select("g", "block", "i", "n", F.transform("_run", lambda x: x["digest"]).alias("run"), *more), "level")
        out.append(level)
        if most <= 1:
            return out
        parent = digest(hexed(_joined(F.col("run"))))
        nodes = level.where((F.col("n") > 1) & (F.col("i") % fanout == 0)).select("g", F.col("block").alias("i"), F.ceil(F.col("n") / fanout).alias("n"), parent.alias("digest"))
        most, more = -(-most // fanout), []


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def paths(own: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The nodes of the first level with their way to the top: `above` has g and what the roots of the trees go on with, first of all `path`.

    path is an array of (before, after): for each level the digests of the siblings left and right of the node's ancestor.
    """
    rest = [c for c in above.columns if c not in ("g", "path")]
    empty = F.array().cast("array<struct<before:binary,after:binary>>")
    found = None
    for depth in range(len(own) - 1, -1, -1):
        more = [c for c in own[depth].columns if c not in ("g", "block", "i", "n", "run")]
        node = own[depth].withColumn("_slot", (F.col("i") % fanout).cast("int")).withColumn("digest", F.element_at("run", F.col("_slot") + 1))
        tops = node.where("n = 1").join(above, "g").select("g", "i", "digest", *more, "path", *rest)
        if found is None:
            found = tops
            continue
        step = F.struct(_joined(F.slice("run", 1, F.col("_slot"))).alias("before"), _joined(F.slice("run", F.col("_slot") + 2, F.greatest(F.size("run") - F.col("_slot") - 1, F.lit(0)))).alias("after"))
        inner = node.where("n > 1").join(found.select("g", F.col("i").alias("block"), "path", *rest), ["g", "block"])
        inner = inner.select("g", "i", "digest", *more, F.concat(F.array(step), F.coalesce("path", empty)).alias("path"), *rest)
        found = inner.union(tops)
        if depth:
            found = found.repartition("g", "i")
    return found


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(hexed(s["before"]), hexed(h), hexed(s["after"])))


def proof(path: Column) -> Column:
    """Digest of all siblings on a path, level by level, left to right."""
    return digest(F.aggregate(path, F.lit(""), lambda a, s: F.concat(a, hexed(s["before"]), hexed(s["after"]))))


def manifest(rows: DataFrame, group: str = "lang", order: tuple[str, ...] = ("doc_id",), fanout: int = FANOUT) -> DataFrame:
    """rows (with their binary `digest`) with g, i, subroot, root and path, all digests binary.

    The trees of the groups hold the rows by `order`, nulls first, rows of equal order by their digest; a null group comes first and is one of its own.  Equal rows are leaves
    of their own.  A group of one row has that leaf as its subroot, one group its subroot as the root.  A table without rows gives none.
    Other columns come along; g, i, n, block, run, path, subroot and root are taken.
    """
    require(rows, group, "digest", *order)
    leaves = saved(placed(rows, group, [*order, "digest"]), "placed")
    own = levels(leaves, fanout)
    size = reduce(DataFrame.union, [t.where("n = 1").select("g", F.element_at("run", 1).alias("digest")) for t in own])
    heads = saved(size, "subroots")
    count = heads.count()
    tops = levels(heads.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(count).cast("long").alias("n"), "digest"), fanout)
    root = tops[-1].where("n = 1").select("g", F.element_at("run", 1).alias("root"))
    above = paths(tops, root.withColumn("path", F.array().cast("array<struct<before:binary,after:binary>>")), fanout)
    above = saved(above.select(F.col("i").alias("g"), F.col("digest").alias("subroot"), "root", "path"), "tops")
    return paths(own, above, fanout)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = {c: F.col(c) for c in FIELDS}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    now = F.when(hit, row_digest(*(field | {"text": lowered(field["text"])}).values()))
    rows = docs.select("doc_id", "lang", row_digest(*field.values()).alias("digest"), now.alias("now"))
    rows = saved(rows, "digests")  # texts are read once, not again for the ranges
    out = manifest(rows).withColumn("folded", folded(F.coalesce("now", "digest"), F.col("path")))
    return out.select(
        "doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), hexed(proof(F.col("path"))).alias("proof_sha256"),
        hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def _tree_sql(name: str, nodes: str, depth: int) -> str:
    """Tables name0 to name{depth} of nodes (g, i, n, d), and for each level the siblings of every node."""
    out = [f"{name}0 AS ({nodes})"]
    for k in range(depth):
        out.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS i, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k} GROUP BY g, i // 8)")
        out.append(f"{name}s{k} AS (SELECT x.g, x.i, any_value(x.n) AS n, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS b, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS a FROM {name}{k} x JOIN {name}{k} y ON x.g = y.g AND x.i // 8 = y.i // 8 GROUP BY x.g, x.i)")
    return ",\n".join(out)


def _oracle(depth: int = 6, tops: int = 2) -> str:
    part = lambda c: f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')"
    row = lambda t: "sha256(" + " || ".join(part(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", t)) + ")"
    bits = "list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: CASE WHEN xor(c, e) & 1 = 1 THEN xor(xor(c, e) >> 1, 3988292384::BIGINT) ELSE xor(c, e) >> 1 END)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"""WITH rows AS (SELECT doc_id, lang, {row("text")} AS leaf, CASE WHEN xor({bits}, 4294967295::BIGINT) % 3 = 0 THEN {row(low)} ELSE {row("text")} END AS now FROM documents),
      leaves AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM rows),
      {_tree_sql("t", "SELECT g, i, n, leaf AS d FROM leaves", depth)},
      {_tree_sql("u", f"SELECT 0 AS g, g AS i, (SELECT count(*) FROM t{depth}) AS n, d FROM t{depth}", tops)},
      f0 AS (SELECT leaves.*, now AS f, '' AS p, i AS k FROM leaves)"""
    at = 0
    for name, k in [*(("t", k) for k in range(depth)), *(("u", k) for k in range(tops))]:
        tree, place = ("f.g", "f.k") if name == "t" else ("0", "f.g" if k == 0 else "f.k")
        out += f""",
      f{at + 1} AS (SELECT f.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.b || f.f || s.a) ELSE f.f END AS f, CASE WHEN s.n > 1 THEN f.p || s.b || s.a ELSE f.p END AS p, {place} // 8 AS k) FROM f{at} f JOIN {name}s{k} s ON s.g = {tree} AND s.i = {place})"""
        at += 1
    return f"""{out}
      SELECT doc_id, leaf, t.d AS subroot, u.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = u.d AS verified FROM f{at} f JOIN t{depth} t ON t.g = f.g, u{tops} u"""


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES = {"op11_merkle_manifest": _oracle()}
