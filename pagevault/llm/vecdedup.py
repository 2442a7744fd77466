"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are normalised in double precision and rotated; the rotation's coordinates are split into blocks. Unit vectors
with cosine c are at squared distance 2 - 2c, so two vectors above the threshold are, in some block, within that block's
proportional share of the squared-distance budget. Each block is range-joined: some of its coordinates are cut into cells of four
times the block's radius, a vector is stored in its own cell and asks at every later cell that its ball reaches (the earlier ones
ask at its own). Cells that hold very many vectors, and only these, are cut along further coordinates of the block. Within
a cell the join goes on in memory, on a finer grid of twice the radius. What meets is tested against the block's budget, and what
passes is verified exactly, on the vectors as given; a pair belongs to the first block whose budget it keeps, so the union of the
cells counts each pair once.

Scale: equal vectors of a label are one class first. Vectors travel once for each cell they are stored or ask in, in the
precision they are given in: 8 times in a small label (64 coordinates), 22 in one of half a million, as the fine grid costs no rows. A cell that further coordinates do not
make smaller holds many near copies of each other, whose links must all be counted: its stored vectors are dealt to several tasks,
each asked by all of its askers. Tasks emit a count for each vector and the links that join components within the task, never
pairs. Lists of large cells are broadcast if they have at most LARGE_CELLS rows and joined by shuffling otherwise.

Defined results: null labels and vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are their own components; vectors of different lengths do not link; rows that share an id are told apart in
counts and joined in one component; rows with a null id count as links of others and have component null; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, mix

#: Coordinates of a block, stored vectors of a cell in one task, vectors of a cell in memory that the fine grid aims at.
BLOCK_WIDTH, STORED, AIM = 8, 60_000, 700
#: Coordinates that a large cell is cut along at a time, and the width of cells that are dealt out, in diameters of a block's ball.
FURTHER, WIDE = 2, 2
LARGE_CELLS = 50_000
#: Vectors that ask together, and cells of a matrix of distances.
ASKING, PAIRS = 2048, 1 << 20
#: Room for rounding in the tests that come before the exact one.
SLACK = 1e-9
_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(width: int) -> np.ndarray:
    if width not in _ROTATIONS:
        _ROTATIONS[width] = np.linalg.qr(np.random.default_rng(17).standard_normal((width, width)))[0]
    return _ROTATIONS[width]


def unit(raw: list[bytes], width: int) -> np.ndarray:
    """Normalised vectors from packed components of 4 or 8 bytes."""
    x = np.frombuffer(b"".join(raw), dtype="<f4" if len(raw[0]) == 4 * width else "<f8").astype(np.float64).reshape(len(raw), width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of large or tiny components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spans(width: int) -> list[tuple[int, int]]:
    return [(i, min(i + BLOCK_WIDTH, width)) for i in range(0, width, BLOCK_WIDTH)]


def reached(near: np.ndarray, gap: np.ndarray, budget: float, later: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows, and the steps to other cells (to later ones only) that their balls reach. A ball of at most half a cell's width reaches,
    in each coordinate, the own cell and at most the nearer neighbour; near is that neighbour's step, gap the distance to it."""
    n, g = near.shape
    for choice in range(1, 1 << g):
        step = np.array([(choice >> i) & 1 for i in range(g)], dtype=bool)
        good = (gap[:, step] ** 2).sum(axis=1) <= budget + SLACK
        if later:
            good &= near[:, int(step.argmax())] > 0
        rows = np.flatnonzero(good)
        yield rows, near[rows] * step


def places(x: np.ndarray, budget: float, role: int, wide: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Rows, cells and roles in a grid of x's coordinates under a squared-distance budget. Vectors with role 0 are stored in
    their own cell (role 0) and ask at later ones (role 1); those with role 1 ask at every cell they reach. wide: a cell's width, in
    diameters of the budget's ball."""
    side = 2 * wide * np.sqrt(budget)
    at = x / side
    cell = np.floor(at).astype(np.int64)
    within = at - cell
    near, gap = np.where(within < 0.5, -1, 1), np.minimum(within, 1 - within) * side
    for rows, c, r in [(np.arange(len(x)), cell, role), *((rows, cell[rows] + step, 1) for rows, step in reached(near, gap, budget, role == 0))]:
        key = np.zeros(len(rows), dtype=np.int64)
        for i in range(x.shape[1]):
            key = key * 1_000_003 + c[:, i]
        yield rows, key, r


def share(budget: float, width: int, block: int) -> float:
    """A block's part of the budget, in proportion to its coordinates."""
    lo, hi = spans(width)[block]
    return budget * (hi - lo) / width


GIVEN = ["label", "width", "rep", "copies", "v"]
PLACED = "label long, width int, rep long, copies long, v binary, block int, cell long, role int"


def batch_of(part: pa.RecordBatch, rows: np.ndarray, **columns: np.ndarray | int) -> pa.RecordBatch:
    """Some rows of part, as rows of PLACED."""
    kinds = {"block": pa.int32(), "cell": pa.int64(), "role": pa.int32()}
    take = part.take(pa.array(rows))
    values = [pa.array(np.broadcast_to(columns[n], len(rows)), k) for n, k in kinds.items()]
    return pa.RecordBatch.from_arrays([*(take.column(n) for n in GIVEN), *values], names=[*GIVEN, *kinds])


def cells(rows: DataFrame, budget: float, grid: int) -> DataFrame:
    """For each class and block, where it is stored (role 0) and where it asks (role 1)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("width").to_numpy()
            for width in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == width))
                turned = unit(part.column("v").to_pylist(), width) @ rotation(width)
                for b, (lo, hi) in enumerate(spans(width)):
                    for some, key, role in places(turned[:, lo : lo + min(grid, hi - lo)], share(budget, width, b), 0, WIDE):
                        yield batch_of(part, some, block=b, cell=key, role=role)

    return rows.select(*GIVEN).mapInArrow(run, PLACED)


def finer(rows: DataFrame, budget: float, grid: int) -> DataFrame:
    """Rows of PLACED whose cells are cut along the coordinates after the first `grid`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.stack([batch.column(c).to_numpy() for c in ("width", "block", "role")], axis=1)
            for width, b, role in np.unique(kinds, axis=0).tolist() if len(kinds) else []:
                part = batch.filter(pa.array((kinds == (width, b, role)).all(axis=1)))
                cell = part.column("cell").to_numpy()
                turned = unit(part.column("v").to_pylist(), width) @ rotation(width)
                lo, hi = spans(width)[b]
                for some, key, as_role in places(turned[:, min(lo + grid, hi) : min(lo + grid + FURTHER, hi)], share(budget, width, b), role, WIDE):
                    yield batch_of(part, some, block=b, cell=mix((cell[some] * 31 + key).view(np.uint64)).view(np.int64), role=as_role)

    return rows.select(*[x.split()[0] for x in PLACED.split(", ")]).mapInArrow(run, PLACED)


class Cell:
    """The vectors stored in one cell, or a share of them, on a fine grid: compared with each other, and asked by others."""

    def __init__(self, block: int, width: int, threshold: float, reps: list[int], copies: list[int], raw: list[bytes]) -> None:
        self.block, self.threshold, self.budget = block, threshold, 2 - 2 * threshold
        self.reps, self.copies = np.array(reps), np.array(copies)
        self.x, self.spans, self.width = unit(raw, width), spans(width), width
        self.turned = self.x @ rotation(width)
        self.found = np.zeros(len(reps), dtype=np.int64)
        self.up: dict[int, int] = {}
        lo, hi = self.spans[block]
        self.grid = 0
        while self.grid < hi - lo and len(reps) / 2.5**self.grid > AIM:
            self.grid += 1
        _, key, _ = next(self.placed(self.turned, 0))
        self.order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[self.order], return_index=True)
        self.first = np.append(first, len(key))

    def placed(self, turned: np.ndarray, role: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        lo, _ = self.spans[self.block]
        return places(turned[:, lo : lo + self.grid], share(self.budget, self.width, self.block), role)

    def top(self, x: int) -> int:
        while x in self.up:
            x = self.up[x]
        return x

    def within(self, p: np.ndarray, q: np.ndarray, b: int) -> np.ndarray:
        """Whether rows of p and q keep block b's share of the budget."""
        lo, hi = self.spans[b]
        d = p[:, lo:hi] - q[:, lo:hi]
        return (d * d).sum(axis=1) <= share(self.budget, self.width, b) + SLACK

    def meet(self, turned: np.ndarray, after: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Askers and stored vectors that meet in a cell of the fine grid and may keep the block's budget, each pair once."""
        lo, hi = self.spans[self.block]
        for rows, key, role in self.placed(turned, 1 if after is None else 0):
            by_key = np.argsort(key, kind="stable")
            asked, start = np.unique(key[by_key], return_index=True)
            at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            for n in np.flatnonzero(self.keys[at] == asked).tolist():
                own = rows[by_key[start[n] : start[n + 1] if n + 1 < len(start) else None]]
                held = self.order[self.first[at[n]] : self.first[at[n] + 1]]
                step = max(1, PAIRS // len(held))
                q = self.turned[held, lo:hi]
                for i in range(0, len(own), step):
                    some = own[i : i + step]
                    p = turned[some, lo:hi]
                    apart = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * p @ q.T
                    a, b = np.nonzero(apart <= share(self.budget, self.width, self.block) + 2 * SLACK)
                    a, b = some[a], held[b]
                    if role == 0:  # stored vectors in their own cell
                        a, b = a[b > a + after], b[b > a + after]
                    yield a, b

    def ask(self, reps: np.ndarray, copies: np.ndarray, x: np.ndarray, after: int | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """How many vectors (copies counted) each asker links with here, and links that join components. Stored vectors
        count their askers. after: the askers are stored themselves, from this place on."""
        turned, counts, links = x @ rotation(self.width), np.zeros(len(x), dtype=np.int64), []
        for i, j in self.meet(turned, after):
            for e in range(self.block + 1):  # else an earlier block has the pair
                good = self.within(turned[i], self.turned[j], e) == (e == self.block)
                i, j = i[good], j[good]
            good = np.einsum("ij,ij->i", x[i], self.x[j]) >= self.threshold
            i, j = i[good], j[good]
            for a, b in zip(reps[i].tolist(), self.reps[j].tolist(), strict=True):
                ta, tb = self.top(a), self.top(b)
                if ta != tb:
                    self.up[max(ta, tb)] = min(ta, tb)
                    links.append((a, b))
            self.found += np.bincount(j, weights=copies[i], minlength=len(self.x)).astype(np.int64)
            counts += np.bincount(i, weights=self.copies[j], minlength=len(x)).astype(np.int64)
        return counts, links


KEY = ["label", "width", "block", "cell"]


def asked(rows: DataFrame, threshold: float) -> DataFrame:
    """rep, n, a, b: what vectors found in a cell, and links (a, b) with rep null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n_key = ["rep", "n", "a", "b"], len(KEY) + 1

        def emitted(reps: np.ndarray, counts: np.ndarray, links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            some = np.flatnonzero(counts)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(counts[some]), *[pa.nulls(len(some), pa.int64())] * 2], names=names)
            if links:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(links), pa.int64())] * 2, *(pa.array(x, pa.int64()) for x in zip(*links, strict=True))], names=names)

        def opened(at: tuple, stored: list[tuple]) -> Iterator[pa.RecordBatch]:
            cell = Cell(at[2], at[1], threshold, *map(list, zip(*stored, strict=True)))
            cells_held.append(cell)
            for start in range(0, len(cell.x), ASKING):
                part = slice(start, start + ASKING)
                yield from emitted(cell.reps[part], *cell.ask(cell.reps[part], cell.copies[part], cell.x[part], after=start))

        at, stored, cells_held = None, [], []

        def closed() -> Iterator[pa.RecordBatch]:
            if stored and not cells_held:
                yield from opened(at, stored)
            if cells_held:
                yield from emitted(cells_held[0].reps, cells_held[0].found, [])
            stored.clear()
            cells_held.clear()

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (*KEY, "part", "role", "rep", "copies", "v")]
            i, n = 0, batch.num_rows
            while i < n:
                now = tuple(c[i] for c in cols[:n_key])
                if now != at:
                    yield from closed()
                    at = now
                stop = i
                while stop < n and stop < i + ASKING and cols[n_key][stop] == cols[n_key][i] and tuple(c[stop] for c in cols[:n_key]) == now:
                    stop += 1
                reps, copies, raw = (c[i:stop] for c in cols[n_key + 1 :])
                if cols[n_key][i] == 0:
                    stored += zip(reps, copies, raw, strict=True)
                elif stored:
                    if not cells_held:
                        yield from opened(at, stored)
                    yield from emitted(np.array(reps), *cells_held[0].ask(np.array(reps), np.array(copies), unit(raw, now[1])))
                i = stop
        yield from closed()

    return rows.mapInArrow(run, "rep long, n long, a long, b long")


def large_cells(rows: DataFrame, most_cells: int) -> tuple[DataFrame, int, int]:
    """Cells that store more than one task compares, with the number of tasks; how many there are, and the largest number."""
    sizes = rows.where("role = 0").groupBy(*KEY).agg(F.ceil(F.count("*") / STORED).cast("int").alias("parts"))
    large = cut(sizes.where("parts > 1"), most_cells)
    n, most = large.agg(F.count("*"), F.max("parts")).first()
    return F.broadcast(large) if n <= LARGE_CELLS else large, n, most or 0


def dealt(packed: DataFrame, budget: float, grid: int, vectors: int) -> DataFrame:
    """For the classes of so many vectors: rows of PLACED and the part of a cell, those of each part together, stored ones first."""
    rows, done = cells(packed, budget, grid), []
    large, n, before = large_cells(rows, 10 * vectors)
    while n and grid < BLOCK_WIDTH:
        joined = rows.join(large, KEY, "left")
        again = finer(joined.where("parts is not null"), budget, grid)
        grid += FURTHER
        large, n, most = large_cells(again, 10 * vectors)
        done.append(joined.where("parts is null").drop("parts"))
        rows, stuck, before = again, most > before / 2, most
        if stuck:  # further coordinates tell these vectors hardly apart
            break
    rows = rows.join(large, KEY, "left") if n else rows.withColumn("parts", F.lit(None).cast("int"))
    for part in done:
        rows = rows.unionByName(part.withColumn("parts", F.lit(None).cast("int")))
    rows = rows.select(*KEY, "role", "rep", "copies", "v", F.coalesce("parts", F.lit(1)).alias("parts"))
    # a stored vector also asks in the later shares of its own cell; others ask in all
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    where = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.when((F.col("role") == 0) & (p == own), 0).otherwise(1).alias("as")))
    where = F.filter(where, lambda x: (F.col("role") == 1) | (x["part"] >= own))
    rows = rows.select(*KEY, "rep", "copies", "v", F.explode(where).alias("at")).select(*KEY, "at.part", F.col("at.as").alias("role"), "rep", "copies", "v")
    return rows.repartition(*KEY, "part").sortWithinPartitions(*KEY, "part", "role", "rep")


def near_duplicates(df: DataFrame, *, threshold: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id (the smallest id reachable over links), kept (it is its own)."""
    kind = "<f4" if df.schema[vector_column].dataType.simpleString() == "array<float>" else "<f8"
    vector = F.col(vector_column).cast("array<double>")
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    # a number for each distinct vector and label: -0.0 equals 0.0
    rows = rows.select("vec_id", "label", F.when(usable, F.transform("vector", lambda x: x + F.lit(0.0))).alias("vector"))
    classes = rows.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    n = df.count()
    classes = cut(classes.select("label", "vector", "least", "copies", F.monotonically_increasing_id().alias("rep")), 10 * n)  # long rows

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([len(v) for v in vectors], pa.int32()), batch.column("rep"), batch.column("copies"), pa.array([np.array(v, dtype=kind).tobytes() for v in vectors], pa.binary())], names=["label", "width", "rep", "copies", "v"])

    packed = classes.select("label", "vector", "rep", "copies").mapInArrow(pack, "label long, width int, rep long, copies long, v binary")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    grid = 0
    while grid < 3 and largest / 2**grid > STORED:
        grid += 1
    found = cut(asked(dealt(packed, 2 - 2 * threshold, grid, n), threshold))
    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    names = classes.select("rep", "least")
    links = found.where("a is not null").select("a", "b").distinct()
    links = links.join(names.select(F.col("rep").alias("a"), F.col("least").alias("x")), "a").join(names.select(F.col("rep").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    known = cut(rows.join(classes, ["label", "vector"], "left").select("vec_id", "least", "copies", "rep"), n)
    same = known.where("vec_id is not null and least is not null").groupBy("vec_id").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("low < high")
    same = known.join(same, "vec_id").where("least != low").select(F.col("low").alias("a"), F.col("least").alias("b"))
    roots = components(links.where("a is not null and b is not null").unionAll(same))
    out = known.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "least"), "least", "left")
    n_links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "least", "vec_id")).alias("component_id")
    out = out.select("vec_id", n_links.cast("long").alias("n_links"), component)
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
