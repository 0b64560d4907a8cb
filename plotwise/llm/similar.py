"""Near copies: SimHash groups and min-hash bands propose, whole sets of word shingles confirm, one row a group stays."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from plotwise.llm import simhash
from plotwise.llm.common import at, cut, named, placed
from plotwise.llm.components import components

#: A pair of similarity s shares a band with probability 1 - (1 - s^DEPTH)^BANDS: all but 5e-7 at 0.8, fewer missed above.
BANDS, DEPTH = 48, 6
_FACTOR, _SHIFT = np.random.default_rng(7).integers(0, 1 << 63, (2, BANDS * DEPTH), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 of the text's word shingles, words as in simhash.fingerprint; a shorter text is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    width = min(width, len(words))
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    shingles = [line[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles)))


def bands(found: np.ndarray) -> np.ndarray:
    """One key a band: a hash of the band's number and its DEPTH minima of the set under random multipliers."""
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max)
    for start in range(0, len(found), 512):
        least = np.minimum(least, (found[start : start + 512, None] * _FACTOR + _SHIFT).min(0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, DEPTH).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common + 1e-9 >= least * (len(a) + len(b) - common)


class Linker:
    """Groups of the sets added one after another: two are linked if they share a band and are similar.

    Sets beyond 64 MB lie in a temporary file. A set is never compared with a member of a group it has joined.
    """

    def __init__(self, least: float):
        self.least, self.parent, self.places, self.cells = least, [], [], {}
        self.store = tempfile.SpooledTemporaryFile(max_size=64 << 20)

    def root(self, x: int) -> int:
        while (up := self.parent[x]) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def read(self, x: int) -> np.ndarray:
        at, n = self.places[x]
        self.store.seek(at)
        return np.frombuffer(self.store.read(8 * n), np.uint64)

    def add(self, found: np.ndarray, keys: list[int]) -> None:
        me, tried = len(self.parent), set()
        self.parent.append(me)
        self.places.append((self.store.seek(0, 2), len(found)))
        self.store.write(found.tobytes())
        for key in keys:
            cell = self.cells.setdefault(key, {})
            for old in [r for r in cell if self.root(r) != r]:  # groups that were joined since
                cell.setdefault(self.root(old), []).extend(cell.pop(old))
            for other, members in list(cell.items()):
                if self.root(other) == self.root(me):
                    continue
                for x in members:
                    if x not in tried:
                        tried.add(x)
                        if similar(found, self.read(x), self.least):
                            a, b = sorted((self.root(me), self.root(x)))
                            self.parent[b] = a
                            break
            cell.setdefault(self.root(me), []).append(me)


def _verified(members: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b): a tree of true links for each set of (group, i, j, node, text, bands) with one group, i and j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((key.as_py(), n.as_py(), t, k) for b in batches for key, n, t, k in zip(*b.columns, strict=True))
        for _, group in groupby(rows, lambda r: r[0]):
            linker, nodes = Linker(least), []
            for _, node, text, keys in group:
                nodes.append(node)
                linker.add(shingle_set(text.as_py(), width), keys.as_py())
            links = [(n, nodes[r]) for i, n in enumerate(nodes) if (r := linker.root(i)) != i]
            if links:
                a, b = zip(*links, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    key = F.struct("group", "i", "j")
    dealt = members.select(key.alias("key"), "node", "text", "bands").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a long, b long")


def simhash_cells(prints: DataFrame) -> DataFrame:
    """(fp, cell) of the distinct ``prints.fp``: one cell a component of fingerprints linked by op7's grid join; a fingerprint without links is its own."""
    linked = components(simhash.near_pairs(prints)).withColumnRenamed("node", "fp")
    return prints.join(linked, "fp", "left").select("fp", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("cell"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, most: int = 1024) -> DataFrame:
    """One row of each group of near copies: the least by id (nulls last), hash of the text, and place in the table.

    Rows whose sets of ``width``-word shingles have a Jaccard similarity of ``least`` or more are linked; groups are
    the links' components. Equal sets become one row first, map-side, whatever their ids. Rows whose SimHash
    fingerprints (of the same shingles) the segment-popcount grid of ``simhash.near_pairs`` links are candidates, and
    so are rows that share a min-hash band, as similar sets mostly lie further apart than any grid over 64 bits reaches. The candidates' components are found without texts; each meets in a task, where whole sets
    decide, and one of over ``most`` rows is dealt into blocks, of which every two meet in a task of their own, so no
    task holds more than about twice ``most`` rows. ``docs`` must read in the same order each time, as files do.

    Null, empty and blank texts have no words and are one group; very long texts are read whole; a null id is the
    last choice of its group; repeated rows leave one; an empty table gives an empty result; other columns stay as
    they are, whatever their names.
    """
    rows = placed(docs).withColumn("row", F.monotonically_increasing_id())
    text = F.coalesce(at(docs, text_col).cast("string"), F.lit(""))
    own = rows.select("row", text.alias("text"), at(docs, id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(t.as_py(), width) for t in batch.column(1))
            found = [(xxh3_128_digest(s.tobytes()), bands(s), simhash.digest(s)) for s in sets]
            keys = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * BANDS, np.concatenate([k for _, k, _ in found]) if found else np.zeros(0, np.int64))
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array([d for d, _, _ in found], pa.binary()), keys, pa.array(np.array([p for _, _, p in found], np.uint64).view(np.int64))], names=["row", "doc_id", "hash", "same", "bands", "fp"])

    known = own.mapInArrow(run, "row long, doc_id long, hash long, same binary, bands array<long>, fp long")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash", "row")
    alike = known.groupBy("same").agg(F.min(F.struct(rank.alias("rank"), "bands", "fp")).alias("head"))
    heads = cut(alike.select("head.rank.row", "head.rank", "head.bands", "head.fp").withColumnRenamed("row", "node"))
    prints = cut(simhash_cells(heads.select("fp").distinct()))
    marked = heads.join(prints, "fp").select("node", F.concat("bands", F.array("cell")).alias("bands"))
    cells = marked.select("node", F.explode("bands").alias("cell"))
    links = cells.select("node", F.lag("node").over(Window.partitionBy("cell").orderBy("node")).alias("last")).where("last is not null").distinct()
    candidates = cut(components(links.toDF("a", "b")).withColumnRenamed("component", "group"))
    sizes = candidates.groupBy("group").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = candidates.join(sizes, "group").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0)))))
    # With two blocks or more a row also meets its own block in each of its pairs, so (block, block) is left out.
    pairs = pairs.where("blocks = 1 or other <> block").select("node", "group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    members = own.select(F.col("row").alias("node"), "text").join(pairs.join(marked, "node"), "node")
    same = components(_verified(members, width, least), forest=True)
    groups = heads.join(same, "node", "left").select(F.coalesce("component", "node").alias("component"), "rank")
    kept = groups.groupBy("component").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("row"))
    return named(rows.join(kept, "row", "left_semi"), docs)
