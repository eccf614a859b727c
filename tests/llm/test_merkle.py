"""The Merkle manifest against a plain version in Python."""

import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from recallspark.llm import merkle

SF = "/root/testdata/sf0.01"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, fanout):
    """Root, and for each leaf the siblings left and right of it on each level."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for way, k in zip(ways, at):
            first = k // fanout * fanout
            way.append((level[first:k], level[k + 1 : first + fanout]))
        level, at = [h("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)], [k // fanout for k in at]
    return level[0], ways


def plain(rows, fanout=8):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in order]
    root, tops = tree([t[0] for t in trees], fanout)
    out = []
    for g, (sub, ways), top in zip(order, trees, tops):
        for (_, _, own, r), way in zip(sorted(groups[g], key=lambda x: x[:3]), ways):
            way = way + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            at = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if hit else own
            for a, b in way:
                at = h("".join([*a, at, *b]))
            out.append((r[0], own, sub, root, h("".join(x for a, b in way for x in [*a, *b])), at, at == root))
    return sorted(out, key=repr)


def odd_rows():
    rows = [(k, f"s{k % 3}", "en", k, f"Text {k} É") for k in range(200)]
    rows += [(1000 + k, None, None, None, None if k % 2 else "") for k in range(9)]
    rows += [(7, "s1", "en", 7, "Text 7 É"), (7, "s1", "en", 7, "another Seven"), (None, "x", "en", 1, "No Id"), (None, "x", "en", 1, "No Id")]
    rows += [(2000 + k, "x", f"lang {k}", 1, "A B C") for k in range(20)] + [(3000, "x", "", 1, "ONE")]
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, run string, path int"


def query(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, merkle.op11_merkle_manifest(spark, path).collect()), key=repr)


def test_equals_plain_version(spark, tmp_path):
    rows = odd_rows()
    got = query(spark, tmp_path, rows)
    assert got == plain(rows)
    assert {r[6] for r in got} == {True, False}


def test_small_tables(spark, tmp_path):
    assert query(spark, tmp_path / "a", []) == []
    one = [(3, "s", "en", 1, "a")]
    assert query(spark, tmp_path / "b", one) == plain(one) and plain(one)[0][1] == plain(one)[0][3]
    nine = [(k, "s", None, 1, "A") for k in range(9)]
    assert query(spark, tmp_path / "c", nine) == plain(nine)


def test_binary_and_other_widths(spark):
    rows = odd_rows()[:60]
    df = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA).drop("run", "path")
    leaves = df.select("doc_id", "lang", merkle.row_digest(*[F.col(c) for c in merkle.FIELDS]).alias("digest"))
    for fanout in (2, 3):
        got = merkle.manifest(leaves, fanout=fanout).select("doc_id", merkle.hexed(F.col("root")), merkle.hexed(merkle.proof(F.col("path"))), merkle.hexed(merkle.folded(F.col("digest"), F.col("path")))).collect()
        want = {(r[0], r[3], r[4], r[3]) for r in plain(rows, fanout)}
        assert set(map(tuple, got)) == want


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = merkle.op11_merkle_manifest(spark, SF)
    result = con.execute(merkle.ORACLES["op11_merkle_manifest"])
    assert [c[0] for c in result.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(result.fetchall())
