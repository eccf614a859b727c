"""Lattice hashing against all cosines."""

import math
import random

import duckdb
import numpy as np

from recallspark.llm import lattice

SF = "/root/testdata/sf0.01"


def plain(rows, cosine=0.95):
    """{row: (id, links, component, kept)} by brute force."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: lattice.scaled(np.array([rows[k][1]], float))[0] for k in good}
    near = {k: {j for j in good if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] / math.sqrt((unit[j] @ unit[j]) * (unit[k] @ unit[k])) >= cosine} for k in good}
    out, seen = [], {}
    for k, (own, _) in enumerate(rows):
        if k not in seen:
            part, todo = {k}, [k]
            while todo:
                new = near.get(todo.pop(), set()) - part
                part |= new
                todo += new
            least = min((rows[j][0] for j in part if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(part, least)
        out.append((own, len(near.get(k, ())), seen[k], own is not None and own == seen[k]))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<double>, n_links int, cell string").repartition(3)


def clusters(seed=5, dim=32):
    r = np.random.default_rng(seed)
    rows = [(k, v.tolist()) for k, v in enumerate(r.standard_normal((150, dim)))]
    for c, (size, noise) in enumerate([(90, 0.02), (60, 0.16), (40, 0.2), (30, 0.25)]):
        centre = r.standard_normal(dim)
        rows += [(1000 * (c + 1) + k, (centre + noise * r.standard_normal(dim)).tolist()) for k in range(size)]
    rows += [(9000 + k, list(rows[3][1])) for k in range(30)]  # copies
    rows += [(8000, [3 * x for x in rows[3][1]]), (8001, [-x for x in rows[3][1]]), (8002, [1e300 * x for x in rows[3][1]]), (8003, [1e-300 * x for x in rows[3][1]])]
    rows += [(7000, None), (7001, []), (7002, [0.0] * dim), (7003, [1.0] * (dim - 1) + [None]), (7004, [math.nan] * dim), (7005, [math.inf] + [0.0] * (dim - 1)), (7006, [1.0, 2.0]), (7007, [2.0, 4.0])]
    rows += [(None, list(rows[3][1])), (None, [5.0] * dim), (3, list(rows[3][1])), (5, list(rows[9][1])), (6, list(rows[6][1]))]
    return rows


def test_lattice_points_are_the_nearest():
    r = np.random.default_rng(1)
    x = r.integers(-3 << lattice.BITS, 3 << lattice.BITS, (300, 8))
    found = lattice.nearest_point(x)
    whole = found % 2 == 0
    assert (whole.all(1) | (~whole).all(1)).all() and (found.sum(1) % 4 == 0).all()
    rest = x / (1 << lattice.BITS) - found / 2
    # No neighbour is nearer, which for this lattice means that no point is.
    assert all(((rest - n / 2) ** 2).sum(1).min() >= (rest**2).sum(1).min() and (((rest - n / 2) ** 2).sum(1) >= (rest**2).sum(1) - 1e-9).all() for n in lattice.neighbours())


def test_cells_do_not_depend_on_the_batch():
    plan = lattice.Tables.fitted(5000, 0.95, 2.0)
    v = np.random.default_rng(2).standard_normal((500, 64)).astype(np.float32).astype(float)
    whole = plan.cells(v)
    assert all((plan.cells(v[k : k + n]) == whole[k : k + n]).all() for k, n in ((0, 1), (17, 3), (100, 333)))
    assert (plan.cells(v * 2.0**40) == whole).all()


def test_pairs_at_the_threshold_are_found():
    plan = lattice.Tables.fitted(50_000, 0.95, 2.0)
    r = np.random.default_rng(3)
    a = r.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = r.standard_normal(a.shape)
    o -= (o * a).sum(1)[:, None] * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * o / np.linalg.norm(o, axis=1)[:, None]
    x, y = plan.cells(a), plan.cells(b)
    assert ((x == y[:, :, :1]).any((1, 2)) | (y == x[:, :, :1]).any((1, 2))).mean() >= 0.985


def test_equals_brute_force(spark):
    rows = clusters()
    df = frame(spark, rows)
    want = plain(rows)
    for block in (2048, 16):  # whole cells, and cells in many blocks
        got = sorted(map(tuple, lattice.near_copies(df, recall=0.99999, block=block).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
        assert got == want
    assert max(x[1] for x in want) > lattice.SMALL


def test_small_tables(spark):
    assert lattice.near_copies(frame(spark, []).limit(0)).count() == 0
    assert [tuple(r) for r in lattice.near_copies(frame(spark, [(4, None)])).collect()] == [(4, 0, 4, True)]
    rows = [(4, [1.0] * 70_000), (5, [1.0] * 70_000), (2, [2.0] * 69_999 + [2.5])]  # long vectors
    assert sorted(map(tuple, lattice.near_copies(frame(spark, rows)).collect())) == plain(rows)


def test_equals_sql_with_planted_copies(spark, tmp_path):
    r = random.Random(7)
    rows = [(x.vec_id, list(x.embedding)) for x in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    for k in range(120):
        own = rows[r.randrange(40)][1]
        rows.append((10_000 + k, [x + r.gauss(0, 0.02) for x in own]))
    path = str(tmp_path)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    got, result = lattice.op12_lattice_dedup(spark, path), con.execute(lattice.ORACLES["op12_lattice_dedup"])
    assert [c[0] for c in result.description] == got.columns
    found, want = sorted(map(tuple, got.collect())), sorted(result.fetchall())
    assert sum(x[1] for x in found) >= 0.98 * sum(x[1] for x in want) > 0 and sum(x[2:] == y[2:] for x, y in zip(found, want)) >= 0.99 * len(want)
