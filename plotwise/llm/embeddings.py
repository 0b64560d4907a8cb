"""Embedding near-duplicates: an epsilon grid order join over leading principal dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import cut
from plotwise.llm.components import components


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0)))


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first, so that squares neither overflow nor vanish."""
    if not v.size:
        return v
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def principal(vectors: DataFrame, dims: int) -> np.ndarray:
    """The ``dims`` leading principal directions of all unit vectors; each task sends one matrix of sums, added up in tasks, and the driver gets one row."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch.column(0)):
                v = _matrix(batch.column(0))
                v = np.column_stack([np.ones(len(v)), v])
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            yield pa.record_batch([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "s"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            matrix = np.zeros(sum(len(c) for c, _ in got))
            for cell, value in got:
                matrix[cell] = value
            yield pa.record_batch([pa.array([matrix.astype("<f8").tobytes()])], names=["matrix"])

    row = vectors.select("embedding").mapInArrow(sums, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).repartition(1).mapInArrow(whole, "matrix binary").first()
    if row is None:
        return np.zeros((0, dims))
    total = np.frombuffer(row["matrix"], "<f8")
    size = round(len(total) ** 0.5)
    total = total.reshape(size, size) / max(1.0, total[0])
    covariance = total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:])
    directions = np.linalg.eigh((covariance + covariance.T) / 2)[1][:, ::-1][:, :dims]
    return directions * np.sign(directions[np.abs(directions).argmax(0), range(directions.shape[1])])


class Block:
    """A stretch of the epsilon grid order: ids, copies and unit vectors, with their principal coordinates."""

    def __init__(self, ids, copies, vectors, directions):
        self.ids, self.copies, self.vectors, self.points = ids, copies, vectors, vectors @ directions

    def part(self, a: int, b: int) -> Block:
        new = object.__new__(Block)
        new.ids, new.copies, new.vectors, new.points = self.ids[a:b], self.copies[a:b], self.vectors[a:b], self.points[a:b]
        return new


def apart(a: np.ndarray, b: np.ndarray, epsilon: float) -> bool:
    """Whether all points of the two intervals are provably farther apart: the boxes around them are."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap) > epsilon * epsilon + 1e-9


class Joiner:
    """Recursive join of two intervals. Gathers weighted degrees and a forest, never pairs."""

    def __init__(self, threshold: float, leaf: int = 512):
        self.threshold, self.leaf, self.epsilon = threshold, leaf, (2 - 2 * threshold) ** 0.5
        self.degree: dict[int, int] = {}
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent.setdefault(up, up)
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def join(self, a: Block, b: Block, same: bool) -> None:
        if not same and apart(a.points, b.points, self.epsilon):
            return
        n, m = len(a.ids), len(b.ids)
        if max(n, m) <= self.leaf:
            self.compare(a, b, same)
        elif same:
            low, high = a.part(0, n // 2), a.part(n // 2, n)
            self.join(low, low, True)
            self.join(high, high, True)
            self.join(low, high, False)
        elif n >= m:
            self.join(a.part(0, n // 2), b, False)
            self.join(a.part(n // 2, n), b, False)
        else:
            self.join(a, b.part(0, m // 2), False)
            self.join(a, b.part(m // 2, m), False)

    def compare(self, a: Block, b: Block, same: bool) -> None:
        linked = a.vectors @ b.vectors.T >= self.threshold
        if same:
            np.fill_diagonal(linked, False)
        rows = np.flatnonzero(linked.any(1))
        if not len(rows):
            return
        columns = np.flatnonzero(linked.any(0))
        linked = linked[np.ix_(rows, columns)]
        self._count(a.ids[rows], linked @ b.copies[columns])
        if not same:
            self._count(b.ids[columns], a.copies[rows] @ linked)
        # Smallest position among what is linked, handed to and fro until it settles; then one edge for each node.
        place = np.arange(len(rows))
        while True:
            low = np.where(linked, place[:, None], len(rows)).min(0)
            new = np.minimum(place, np.where(linked, low[None, :], len(rows)).min(1))
            if (new == place).all():
                break
            place = new
        for x, p in zip(a.ids[rows].tolist(), place.tolist(), strict=True):
            self.union(x, int(a.ids[rows[p]]))
        for x, p in zip(b.ids[columns].tolist(), low.tolist(), strict=True):
            self.union(x, int(a.ids[rows[p]]))

    def _count(self, ids: np.ndarray, n: np.ndarray) -> None:
        for x, k in zip(ids.tolist(), n.tolist(), strict=True):
            self.degree[x] = self.degree.get(x, 0) + int(k)

    def rows(self) -> pa.RecordBatch:
        ids = list(self.degree)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array([self.degree[x] for x in ids], pa.int64()), pa.array([self.root(x) for x in ids], pa.int64())], names=["head", "n", "root"])


def _width(valid: DataFrame) -> str:
    """The bytes in which components travel: as they are, floats in four, others in eight."""
    return "<f4" if valid.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def _blocks(valid: DataFrame, directions: np.ndarray, size: int, epsilon: float) -> DataFrame:
    """(block, ids, copies, vectors, low, high): the vectors in epsilon grid order, cut every ``size``.

    A range sort on the grid cells of the leading dimensions, checkpointed; one count for each sorted partition
    gives every row its place, and rows of one block, at most ``size``, meet in one task.
    """
    order = [f"c{i}" for i in range(directions.shape[1])]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = np.floor(_matrix(batch.column(2)) @ directions / epsilon).astype(np.int32)
            yield pa.record_batch([*batch.columns, *(pa.array(np.ascontiguousarray(grid[:, i])) for i in range(grid.shape[1]))], names=["head", "copies", "embedding", *order])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = len(batch.column(0))
            yield pa.record_batch([*batch.columns[:3], pa.array([part] * n, pa.int32()), pa.array(range(done, done + n), pa.int64())], names=["head", "copies", "embedding", "part", "at"])
            done += n

    kind, width = valid.schema["embedding"].dataType.simpleString(), _width(valid)
    base = f"head long, copies long, embedding {kind}"
    parts = max(1, int(valid.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = valid.select("head", "copies", "embedding").mapInArrow(cells, base + "".join(f", {c} int" for c in order))
    ordered = cut(ordered.repartitionByRange(parts, *order, "head").sortWithinPartitions(*order, "head").mapInArrow(place, base + ", part int, at long"))
    before, offsets = 0, {}
    for row in sorted(ordered.groupBy("part").count().collect()):
        offsets[row["part"]] = before
        before += row["count"]
    starts = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]) if offsets else F.create_map(F.lit(0), F.lit(0))
    numbered = ordered.select(F.floor((F.element_at(starts, F.col("part")) + F.col("at")) / size).cast("long").alias("block"), (F.element_at(starts, F.col("part")) + F.col("at")).alias("at"), "head", "copies", "embedding")

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        v = _matrix(table["embedding"].combine_chunks())
        points = v @ directions
        return pa.table(
            {
                "block": table["block"].slice(0, 1),
                "ids": [table["head"].to_numpy().astype("<i8").tobytes()],
                "copies": [table["copies"].to_numpy().astype("<i8").tobytes()],
                "vectors": [table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(width).tobytes()],
                "low": pa.array([points.min(0).tolist()], pa.list_(pa.float64())),
                "high": pa.array([points.max(0).tolist()], pa.list_(pa.float64())),
            }
        )

    return cut(numbered.groupBy("block").applyInArrow(gather, "block long, ids binary, copies binary, vectors binary, low array<double>, high array<double>"))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, dims: int = 4, block: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; pairs with cosine >= ``threshold`` link.

    Equal vectors become one with a number of copies (map-side first). Distinct ones are sorted into epsilon grid
    order on ``dims`` principal dimensions and cut into blocks of ``block``; pairs of blocks whose boxes come
    within epsilon meet, by an equi-join on the cells of the first dimension, each in one task that holds two
    blocks and joins their intervals recursively, skipping those provably apart. A task sends one degree and one
    tree edge for each of its vectors, never pairs. Cosines are of unit vectors in double precision.

    Each length present is joined by itself, one after another, as lengths are few. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing: no links, their own component, kept. Repeated
    rows link with each other. An empty table gives an empty result; other columns are ignored.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding"))
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))) & F.exists(x, lambda c: c.cast("double") != 0.0)
    rows = rows.withColumn("length", F.coalesce(F.when(finite, F.size(x)), F.lit(0)))
    found = rows.where("length = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for row in rows.where("length > 0").select("length").distinct().orderBy("length").collect():
        found = found.unionAll(_linked(rows.where(F.col("length") == row["length"]).drop("length"), row["length"], threshold, dims, block))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _linked(rows: DataFrame, d: int, threshold: float, dims: int, block: int) -> DataFrame:
    """vec_id, n_links and component_id of (vec_id, embedding), all of length ``d``, finite and not zero."""
    spark = rows.sparkSession
    valid = cut(rows.groupBy("embedding").agg(F.min("vec_id").alias("head"), F.count("*").alias("copies")).where("head is not null"))
    directions = principal(valid, dims)
    if not len(directions):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    epsilon = (2 - 2 * threshold) ** 0.5
    blocks = _blocks(valid, directions, block, epsilon)

    boxes = blocks.select("block", "low", "high")
    cell = lambda c: F.floor(c / F.lit(epsilon)).cast("int")
    left = boxes.select(F.col("block").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"), F.explode(F.sequence(cell(F.col("low")[0]) - 1, cell(F.col("high")[0]) + 1)).alias("cell"))
    right_ = boxes.select(F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"), F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))).alias("cell"))
    gap = F.lit(0.0)
    for k in range(directions.shape[1]):
        side = F.greatest(F.lit(0.0), F.col("low_i")[k] - F.col("high_j")[k], F.col("low_j")[k] - F.col("high_i")[k])
        gap = gap + side * side
    pairs = left.join(right_, (left["cell"] == right_["cell"]) & (F.col("i") <= F.col("j")) & (gap <= epsilon * epsilon + 1e-9)).select("i", "j").distinct()
    one, two = (blocks.select(F.col("block").alias(s), F.col("ids").alias(f"ids_{s}"), F.col("copies").alias(f"copies_{s}"), F.col("vectors").alias(f"vectors_{s}")) for s in "ij")
    work = pairs.join(one, "i").join(two, "j").select("i", "j", "ids_i", "copies_i", "vectors_i", "ids_j", "copies_j", "vectors_j")
    work = work.repartition(F.col("i"), F.col("j"))

    width = _width(valid)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                i, j, *raw = (c[r].as_py() for c in batch.columns)
                sides = [Block(np.frombuffer(a, "<i8"), np.frombuffer(c, "<i8"), _unit(np.frombuffer(v, width).astype(np.float64).reshape(-1, d)), directions) for a, c, v in (raw[:3], raw[3:])]
                joiner = Joiner(threshold)
                joiner.join(sides[0], sides[0] if i == j else sides[1], i == j)
                if joiner.degree:
                    yield joiner.rows()

    # A row holds two blocks, so batches are of one row.
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual_batch = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        found = cut(work.mapInArrow(join, "head long, n long, root long"))
    finally:
        spark.conf.set(name, usual_batch)
    degrees = found.groupBy("head").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("head").alias("a"), F.col("root").alias("b")))
    named = valid.join(degrees, "head", "left").join(groups.withColumnRenamed("node", "head"), "head", "left").select(
        "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "head").alias("component_id")
    )
    salts = 16
    copies = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    return salted.join(copies, ["embedding", "salt"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
