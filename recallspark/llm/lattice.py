"""Near copies of embeddings by lattice hashing: random projections decoded to E8 lattice points in some tables, neighbouring cells probed.

A table projects a unit vector to blocks of eight coordinates at random, shifts them at random and takes the nearest point of the E8 lattice in
each block; the points of all blocks are the vector's cell.  Besides its own cell a vector asks the next nearest ones, found by moving blocks to
neighbours of their points (the 240 shortest vectors of the lattice).  Vectors that meet in a cell are compared by cosine in double precision.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recallspark.llm._common import map_batches, require, saved, slices, table
from recallspark.llm.blocks import WIDE, rows_of, usable
from recallspark.llm.components import HUBS, LEAST, components

#: Share of the pairs at the threshold that the tables are to find, cells that each table asks besides a vector's own, and strangers in a cell.
RECALL, PROBES, STRANGERS, SEED = 0.995, 8, 0.05, 88
#: Rows of a cell that are compared as one block, rows of a task, and rows up to which groups are compared together.
BLOCK, BUNDLE, SMALL = 2048, 4096, 24
#: Projected coordinates are integers with so many bits behind the point, so a cell is the same wherever it is computed.
BITS, VECTOR_BITS, MATRIX_BITS = 20, 20, 12
#: Components of a vector that are projected at a time.
CHUNK = 4096


@functools.cache
def neighbours() -> np.ndarray:
    """Twice the 240 shortest vectors of E8: two coordinates of plus or minus 1, or all plus or minus a half with an even number of minuses."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out, np.int64)


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Twice the E8 point nearest to each row of eight integers in units of 2**-BITS; equally near ones go by a fixed rule."""
    one = 1 << BITS

    def even(y: np.ndarray) -> np.ndarray:
        """The nearest row of whole numbers with an even sum."""
        whole = (y + one // 2) >> BITS
        rest = y - (whole << BITS)
        at = np.abs(rest).argmax(-1)
        rows = np.flatnonzero(whole.sum(-1) & 1)
        whole[rows, at[rows]] += np.where(rest[rows, at[rows]] >= 0, 1, -1)
        return whole

    a, b = 2 * even(x), 2 * even(x - one // 2) + 1
    far = lambda p: ((x - p * (one // 2)) ** 2).sum(-1)
    return np.where((far(a) <= far(b))[:, None], a, b)


def best_cells(x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of blocks of eight coordinates (n, blocks, 8): hashes of the probes + 1 nearest cells, the own one first, and its points.

    What a move of a block adds to the squared distance is known from the rest of its decoding; the moves of all blocks together are
    ranked by their sum.
    """
    n, blocks, _ = x.shape
    points = nearest_point(x.reshape(-1, 8)).reshape(n, blocks, 8)
    rest = x - points * (1 << (BITS - 1))
    cost, cells = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.uint64)
    for k in range(blocks):
        gain = rest[:, k] @ neighbours().T
        moves = np.argpartition(-gain, probes - 1, axis=1)[:, :probes] if probes else np.zeros((n, 0), int)
        moves = np.sort(moves, axis=1)
        # Squared distance to a neighbour's point less that to the own one, over 2**(BITS + 1); neighbours() are doubled.
        more = np.concatenate([np.zeros((n, 1), np.int64), (1 << BITS) - (np.take_along_axis(gain, moves, 1) >> 1)], axis=1)
        own = np.concatenate([points[:, None, k], points[:, None, k] + neighbours()[moves]], axis=1)
        code = np.full((n, own.shape[1]), np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64))
        for c in range(8):
            code = mixed(code ^ own[:, :, c].astype(np.uint64))
        cost = (cost[:, :, None] + more[:, None, :]).reshape(n, -1)
        cells = mixed(cells[:, :, None] ^ code[:, None, :]).reshape(n, -1)
        # The own cell is the first of each list and stays there.
        order = np.concatenate([np.zeros((n, 1), int), 1 + np.argsort(cost[:, 1:], axis=1, kind="stable")[:, :probes]], axis=1)
        cost, cells = np.take_along_axis(cost, order, 1), np.take_along_axis(cells, order, 1)
    return cells, points


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(32))


class Tables:
    """The tables of one search: `spread` is the standard deviation of a projected coordinate's difference for a pair at the threshold."""

    def __init__(self, cosine: float, spread: float, blocks: int, tables: int, probes: int = PROBES, seed: int = SEED):
        self.cosine, self.spread, self.blocks, self.tables, self.probes, self.seed = cosine, spread, blocks, tables, probes, seed

    @classmethod
    def fitted(cls, rows: int, cosine: float, apart: float, recall: float = RECALL, probes: int = PROBES, seed: int = SEED) -> Tables:
        """Tables for so many rows whose squared distance is `apart` on average.

        For each number of blocks the width of a cell follows from the strangers that it may hold on average; of these the one counts
        at which a pair at the threshold meets most often, which a simulation of fixed size tells, and there are as many tables as recall asks for.
        """
        near = math.sqrt(max(2 - 2 * cosine, 1e-9))
        ratio = max(math.sqrt(max(apart, 0)) / near, 1.5)
        best, best_rate = None, 0.0
        for blocks in range(1, 9):
            spread = math.sqrt(max(rows / STRANGERS, 2.0) ** (1 / (4 * blocks)) / (2 * math.pi)) / ratio
            rate = cls(cosine, spread, blocks, 1, probes, seed).rate()
            if rate > best_rate:
                best, best_rate = cls(cosine, spread, blocks, max(2, math.ceil(math.log(1 - recall) / math.log(max(1e-9, 1 - rate)))), probes, seed), rate
        return best

    def rate(self, n: int = 2000) -> float:
        """Share of pairs at the threshold that meet in one table."""
        random = np.random.default_rng([self.seed, self.blocks])
        x = random.uniform(-8, 8, (n, self.blocks, 8))
        y = x + random.normal(0, self.spread, x.shape)
        a, b = (best_cells(np.rint(v * (1 << BITS)).astype(np.int64), self.probes)[0] for v in (x, y))
        return float(((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean())

    def projected(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables, blocks, 8) integers; products of integers in doubles are exact in any order."""
        n, dim = unit.shape
        width = self.tables * self.blocks * 8
        whole, scale = np.rint(unit * (1 << VECTOR_BITS)), self.spread / math.sqrt(max(2 - 2 * self.cosine, 1e-9)) * (1 << MATRIX_BITS)
        out = np.zeros((n, width))
        for at in range(0, dim, CHUNK):
            part = np.random.default_rng([self.seed, dim, at]).standard_normal((min(CHUNK, dim - at), width)) if dim > CHUNK else _matrix(self.seed, dim, width)
            out += whole[:, at : at + CHUNK] @ np.rint(part * scale)
        shift = np.random.default_rng([self.seed, 1]).integers(0, 2 << BITS, width)
        return ((out.astype(np.int64) >> (VECTOR_BITS + MATRIX_BITS - BITS)) + shift).reshape(n, self.tables, self.blocks, 8)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """(n, tables, probes + 1) hashes of the cells that each vector stands in (the first of a table) or asks."""
        n, dim = vectors.shape
        x = self.projected(scaled(vectors) / norms(scaled(vectors))[:, None])
        found = best_cells(x.reshape(n * self.tables, self.blocks, 8), self.probes)[0].reshape(n, self.tables, -1)
        return mixed(mixed(found ^ np.uint64(dim)) ^ np.arange(1, self.tables + 1, dtype=np.uint64)[None, :, None])


@functools.lru_cache(maxsize=4)
def _matrix(seed: int, dim: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, width))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, the largest component around 1, so that no square overflows or vanishes."""
    most = np.abs(vectors).max(1)
    return np.ldexp(vectors, -np.frexp(np.where(most > 0, most, 1))[1][:, None])


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(1))


_ENTRY = T.StructType([T.StructField("cell", T.LongType()), T.StructField("t", T.IntegerType()), T.StructField("home", T.BooleanType()), T.StructField("key", T.LongType())])
_FOUND = T.StructType([T.StructField("key", T.LongType()), T.StructField("links", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("key2", T.LongType()), T.StructField("rep2", T.LongType())])


def entries(classes: DataFrame, plan: Tables) -> DataFrame:
    """Each vector (key, v) once for each cell that it stands in or asks."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, 1024):
            keys, rows = part.column(0).to_numpy(), rows_of(part.column(1))
            lengths = np.array([len(r) for r in rows])
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                step = max(1, 1024 * WIDE // max(int(dim), WIDE))
                for k in range(0, len(at), step):
                    own = at[k : k + step]
                    cells = plan.cells(np.array([rows[a] for a in own], float))
                    n, tables, each = cells.shape
                    place = np.tile(np.arange(each), n * tables)
                    yield {"cell": cells.view(np.int64).ravel(), "t": np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), n), "home": place == 0, "key": np.repeat(keys[own], tables * each)}

    return map_batches(classes.select("key", "v"), run, _ENTRY)


class Met:
    """The rows that meet in the cells of one task, all of one dimension: one row of vectors and codes for each key."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, plan: Tables):
        self.keys, self.plan, self.vectors = keys, plan, scaled(vectors)
        self.length = norms(self.vectors)
        self._cells: np.ndarray | None = None

    def cosines(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cosines of pairs of rows."""
        out = np.zeros(len(a))
        step = max(1, (1 << 20) // self.vectors.shape[1])
        for k in range(0, len(a), step):
            s = slice(k, k + step)
            out[s] = (self.vectors[a[s]] * self.vectors[b[s]]).sum(1) / (self.length[a[s]] * self.length[b[s]])
        return out

    def owned(self, a: np.ndarray, b: np.ndarray, t: int, kind: np.ndarray) -> np.ndarray:
        """Pairs (the smaller key in a) that meet nowhere before: tables in their order; in one, both at home before b's home asked by a before a's asked by b."""
        if self._cells is None:
            step = max(1, 4096 * 64 // self.vectors.shape[1])
            self._cells = np.concatenate([self.plan.cells(self.vectors[k : k + step]) for k in range(0, len(self.keys), step)])
        cells, alive = self._cells, np.ones(len(a), bool)
        for s in range(t + 1):
            left = np.flatnonzero(alive)
            for k in range(0, len(left), 1 << 16):
                own = left[k : k + (1 << 16)]
                x, y = cells[a[own], s], cells[b[own], s]
                met = np.stack([x[:, 0] == y[:, 0], (x[:, 1:] == y[:, :1]).any(1), (y[:, 1:] == x[:, :1]).any(1)])
                if s == t:
                    met &= np.arange(3)[:, None] < kind[own][None]
                alive[own[met.any(0)]] = False
        return alive


def compare(met: Met, rows: np.ndarray, home: np.ndarray, roles: np.ndarray, group: np.ndarray, table_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, counted, tree) of the linked pairs of rows in groups, where rows are sorted by group: counted pairs are found here first, and pairs
    of the tree together connect whatever the pairs connect.  Pairs need one row at home that is not only asked for (roles: 0 left, 1 right, 2 both)."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    small = np.repeat(sizes <= SMALL, sizes)
    pairs = []
    for lag in range(1, min(SMALL, len(rows))):
        same = (group[lag:] == group[:-lag]) & small[lag:]
        if not same.any():
            break
        left = np.flatnonzero(same)
        pairs.append(np.stack([left, left + lag]))
    if pairs:
        i, j = np.concatenate(pairs, axis=1)
        fit = (home[i] & home[j]) | (home[i] & ~home[j] & (roles[i] != 1) & (roles[j] != 0)) | (home[j] & ~home[i] & (roles[j] != 1) & (roles[i] != 0))
        # In a cell of many blocks a pair needs a left and a right row, and two rows at home meet in the one block where the larger key is right.
        keys = met.keys[rows]
        ahead = np.where(roles[i] == 0, keys[i] < keys[j], keys[j] < keys[i])
        fit &= (roles[i] == 2) | ((roles[i] != roles[j]) & (ahead | ~(home[i] & home[j])))
        i, j = i[fit], j[fit]
        for k in range(0, len(i), 1 << 18):
            a, b = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            linked = met.cosines(rows[a], rows[b]) >= met.plan.cosine
            yield from _ordered(met, rows, home, a[linked], b[linked], table_of, None)
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        own = np.arange(start, start + size)
        left, right = own[home[own] & (roles[own] != 1)], own[roles[own] != 0]
        if not len(left) or not len(right):
            continue
        near = np.zeros((len(left), len(right)), bool)
        y = met.vectors[rows[right]] / met.length[rows[right]][:, None]
        for k in range(0, len(left), 256):
            about = (met.vectors[rows[left[k : k + 256]]] / met.length[rows[left[k : k + 256]]][:, None]) @ y.T
            found = about >= met.plan.cosine
            x, z = np.nonzero(np.abs(about - met.plan.cosine) < 1e-9)  # these by the sum over the pair alone
            found[x, z] = met.cosines(rows[left[k + x]], rows[right[z]]) >= met.plan.cosine
            # Two rows at home are one pair, whichever comes first.
            both = home[right][None, :] & (met.keys[rows[right]][None, :] <= met.keys[rows[left[k : k + 256]]][:, None])
            near[k : k + 256] = found & ~both
        edges = tree(near)
        for k in range(0, len(left), 256):
            x, z = np.nonzero(near[k : k + 256])
            yield from _ordered(met, rows, home, left[k + x], right[z], table_of, np.zeros(len(x), bool))
        a, b = left[edges[:, 0]], right[edges[:, 1]]
        yield rows[a], rows[b], np.zeros(len(a), bool), np.ones(len(a), bool)


def _ordered(met: Met, rows: np.ndarray, home: np.ndarray, a: np.ndarray, b: np.ndarray, table_of: np.ndarray, in_tree: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Linked pairs with the smaller key first, and whether they are found here first, table by table."""
    if not len(a):
        return
    turned = met.keys[rows[a]] > met.keys[rows[b]]
    a, b = np.where(turned, b, a), np.where(turned, a, b)
    kind = np.where(home[a] & home[b], 0, np.where(home[b], 1, 2))
    for t in np.unique(table_of[a]):
        own = np.flatnonzero(table_of[a] == t)
        first = met.owned(rows[a[own]], rows[b[own]], int(t), kind[own])
        yield rows[a[own]], rows[b[own]], first, first if in_tree is None else in_tree[own]


def tree(near: np.ndarray) -> np.ndarray:
    """Pairs (row, column) of a matrix of links that connect the same rows and columns, as few as can be."""
    out = []
    rows, columns = near.any(1), near.any(0)
    while rows.any():
        first = int(rows.argmax())
        rows[first] = False
        todo = [(first, True)]
        while todo:
            at, is_row = todo.pop()
            others = columns if is_row else rows
            reached = np.flatnonzero((near[at] if is_row else near[:, at]) & others)
            others[reached] = False
            out.append(np.stack([np.full(len(reached), at), reached] if is_row else [reached, np.full(len(reached), at)], axis=1))
            todo += [(int(r), not is_row) for r in reached]
    return np.concatenate(out) if out else np.zeros((0, 2), int)


def _dealt(left: DataFrame, right: DataFrame, key: str, size: str, limit: int, salt: list[str]) -> DataFrame:
    """left join right on key, where right has a row for each key and says with `size` how many rows of left it meets; keys with more than
    limit, of which there are few, are dealt into parts."""
    parts = F.greatest(F.lit(1), F.ceil(F.col(size) / limit)).cast("int")
    hubs = F.broadcast(right.where(F.col(size) > limit).select(key, parts.alias("_parts")))
    a = left.join(hubs, key, "left").withColumn("_part", F.pmod(F.xxhash64(*salt), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    b = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return a.join(b, [key, "_part"]).drop("_part")


def near_copies(items: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, probes: int = PROBES, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row for each row of items: the id, n_links, component_id and kept.

    n_links counts the other rows at a cosine of at least `cosine` that the tables find (a pair at the threshold is found with the probability `recall`,
    nearer ones more often, and none below the threshold counts); component_id is the smallest id that links lead to, its own included, and kept is true
    for the row of that id.  Equal vectors are compared as one and count each other; rows of one id are rows of their own.  Vectors that are null, empty, zero or hold
    anything null or not finite link with nothing, and vectors of different lengths do not link.  A row without an id links like any other, is never kept,
    and its component_id is null where no linked row has one.  Other columns are left out; an empty table gives no rows.

    Cells of any number of rows are compared in blocks of `block` rows, and what comes back of a block are counts and the pairs of a spanning tree.
    """
    require(items, id_col, vec_col)
    kind = "array<float>" if items.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    own = items.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"), F.monotonically_increasing_id().alias("_row"))
    own = own.withColumn("v", F.when(usable("v") & F.exists("v", lambda x: x != 0), F.col("v")))
    own = saved(own, "vectors")
    last = (1 << 63) - 1
    classes = own.where("v is not null").groupBy("v").agg(F.coalesce(F.min("id"), F.lit(last)).alias("rep"), F.count("*").alias("size"))
    classes = saved(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    n, width = classes.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    alone = own.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not n:
        return alone.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").isNotNull().alias("kept"))
    plan = Tables.fitted(n, cosine, 2.0 * (1 - _mean_square(classes)), recall, probes, seed)
    rows = n * plan.tables * (probes + 1)
    each = saved(entries(classes, plan), "cells")
    busy = each.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("homes")).where("n > 1 and homes > 0")
    busy = saved(busy, "busy")
    met = _dealt(each, busy, "cell", "n", max(LEAST, rows // HUBS), ["key"])
    met = met.join(classes, "key")
    # A cell of few rows is one block; of others each block of rows at home meets each block of all rows.
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    spot = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    left = F.when(F.col("home"), F.transform(every(blocks("n")), lambda j: F.struct(spot(blocks("homes")).alias("i"), j.alias("j"), F.lit(0).alias("role"))))
    right = F.transform(every(blocks("homes")), lambda i: F.struct(i.alias("i"), spot(blocks("n")).alias("j"), F.lit(1).alias("role")))
    both = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("role")))
    dealt = F.when(F.col("n") <= block, both).otherwise(F.concat(F.coalesce(left, F.array().cast("array<struct<i:int,j:int,role:int>>")), right))
    copies = F.when(F.col("n") <= block, F.col("n")).otherwise(F.col("homes") * blocks("n") + F.col("n") * blocks("homes"))
    shared = busy.agg(F.sum(copies)).first()[0] or 0
    bundles = int(min(max(1, -(-shared * max(1, width // n) // (BUNDLE * 64))), 100_000))
    met = met.select("cell", "t", "home", "key", "v", "rep", "size", F.explode(dealt).alias("b")).select("cell", "t", "home", "key", "v", "rep", "size", "b.*")
    met = met.withColumn("bundle", F.pmod(F.xxhash64("cell", "i", "j"), F.lit(bundles)).cast("int"))
    arrow = to_arrow_schema(_FOUND)

    def local(part: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 5]
        vectors = rows_of(part["v"])
        lengths = np.array([len(v) for v in vectors])
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            own = part.take(pa.array(at)) if len(at) < part.num_rows else part
            cell, t, i, j, role, home, key, size, rep = (own[c].to_numpy() for c in ("cell", "t", "i", "j", "role", "home", "key", "size", "rep"))
            order = np.lexsort((role, key, j, i, t, cell))
            cell, t, i, j, role, home, key = (c[order] for c in (cell, t, i, j, role, home, key))
            keys, first, rows = np.unique(key, return_index=True, return_inverse=True)
            seen = Met(keys, np.array([vectors[at[order[f]]] for f in first], float), plan)
            size, rep = size[order][first], rep[order][first]
            change = (cell[1:] != cell[:-1]) | (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            group = np.cumsum(np.append(0, change))
            links = np.zeros(len(keys), np.int64)
            for a, b, counted, joins in compare(seen, rows, home, role, group, t):
                np.add.at(links, a[counted], size[b[counted]])
                np.add.at(links, b[counted], size[a[counted]])
                a, b = a[joins], b[joins]
                out.append([keys[a], np.zeros(len(a), np.int64), rep[a], keys[b], rep[b]])
            some = np.flatnonzero(links)
            out.append([keys[some], links[some], rep[some], np.full(len(some), -1), rep[some]])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    found = saved(met.groupBy("bundle").applyInArrow(local, _FOUND), "links")
    node = lambda rep, key: F.struct(F.col(rep).alias("rep"), F.col(key).alias("key"))
    counts = found.where("key2 = -1").groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.where("key2 <> -1").select(node("rep", "key").alias("a"), node("rep2", "key2").alias("b")))
    roots = roots.select(F.col("node.key").alias("key"), F.col("root.rep").alias("root"))
    known = classes.join(counts, "key", "left").join(roots, "key", "left")
    known = known.select("v", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.nullif(F.coalesce("root", "rep"), F.lit(last)).alias("component_id"))
    linked = _dealt(own.where("v is not null"), known, "v", "size", max(LEAST, n // HUBS), ["_row"]).select("id", "n_links", "component_id")
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _mean_square(classes: DataFrame) -> float:
    """Squared length of the mean of all unit vectors of the commonest length: how far they lie to one side.  One row for each component comes back,
    from sums that tasks make of their rows."""
    dim = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    schema = T.StructType([T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = [r for r in rows_of(batch.column(0)) if len(r) == dim]
        if rows:
            x = scaled(np.array(rows, float))
            yield {"sums": [(x / norms(x)[:, None]).sum(0)], "n": [len(rows)]}

    parts = map_batches(classes.select("v"), run, schema)
    mean = parts.select(F.posexplode("sums").alias("at", "x"), "n").groupBy("at").agg((F.sum("x") / F.sum("n")).alias("m"))
    return mean.agg(F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0.0))).first()[0]


def op12_lattice_dedup(spark, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_lattice_dedup": op12_lattice_dedup}
ORACLES = {
    "op12_lattice_dedup": """
        WITH RECURSIVE good AS (
            SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.len * b.len) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id"""
}
