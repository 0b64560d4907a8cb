"""Connected components of an edge table, without collecting links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import cut

#: Edges in a file of a round's checkpoint, or that one task merges alone; and the least number of files (and so of tasks) in a round.
PER_FILE, LEAST_FILES = 100_000, 12


def _roots(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, int]]:
    """(node, the smallest node of its group) of every node of the batches' edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent]


def _pairs(rows: list[tuple[int, int]], names: list[str]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges replaced by stars onto the smallest node of each of its groups: never more rows than came in."""
    for batch in batches:
        yield from _pairs([(x, r) for x, r in _roots(iter([batch])) if r != x], ["high", "low"])


def _alone(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of few edges, which one task merges."""
    return cut(edges.coalesce(1).mapInArrow(lambda batches: _pairs(_roots(batches), ["node", "component"]), "node long, component long"))


def _contract(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_forest, "high long, low long")


def _with_least(rows: DataFrame, key: str, other: str, least: DataFrame, salts: int) -> DataFrame:
    """Rows joined to their key's one row of ``least`` (key, m); the rows of a hub are dealt over ``salts`` keys."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(salts)).cast("int"))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "salt"])


def components(edges: DataFrame, most_rounds: int = 100, salts: int = 16, forest: bool = False, most_alone: int = PER_FILE) -> DataFrame:
    """(node, component) for every node of the edges ``(a, b)``; component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), each edge batch first reduced to a
    forest in its own task, unless the edges are a ``forest`` from a Python function already: a second one behind
    it would hold a second worker in each task. Every round ends in a reliable checkpoint. Minima are aggregated map-side, and
    joined back over ``salts`` keys a node, so a hub's neighbours never meet in one task. A round's checkpoint has a
    file for each ``PER_FILE`` edges of the last one, not for each shuffle partition. Once ``most_alone`` edges at
    most are left, counted, one task merges them, as each round costs the driver a large plan and tasks for every
    partition, however few the edges. Self-loops, repeated and reversed edges do no harm; without edges the result
    is empty.
    """
    now = edges.select(F.greatest("a", "b").cast("long").alias("high"), F.least("a", "b").cast("long").alias("low")).where("high <> low")
    now = cut(now if forest else _contract(now))
    before, n = None, now.count()
    for _ in range(most_rounds):
        if n <= most_alone:
            return _alone(now)
        # Large star: each node hands its larger neighbours the smallest node it knows. An edge (high, low) is low's
        # larger neighbour; the smallest that low knows is itself or the least low of its own edges as a high.
        own = now.groupBy("high").agg(F.min("low").alias("m")).withColumnRenamed("high", "low")
        heard = now.select("low").distinct().join(own, "low", "left").select("low", F.coalesce("m", "low").alias("m"))
        large = _with_least(now, "low", "high", heard, salts).select("high", F.col("m").alias("low")).distinct()
        # Small star: each node hands its smaller neighbours, and itself, the smallest of them.
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = _with_least(large, "high", "low", least, salts).select(F.explode(F.array(F.struct("high", F.col("m").alias("low")), F.struct(F.col("low").alias("high"), F.col("m").alias("low")))).alias("e")).select("e.*").where("high <> low")
        now = cut(_contract(small.distinct().coalesce(max(LEAST_FILES, -(-n // PER_FILE)))))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, n = state, state[0]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    tree = now.groupBy("high").agg(F.min("low").alias("low"))
    return tree.select(F.explode(F.array(F.struct(F.col("high").alias("node"), F.col("low").alias("component")), F.struct(F.col("low").alias("node"), F.col("low").alias("component")))).alias("n")).select("n.*").distinct()
