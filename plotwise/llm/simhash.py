"""SimHash near-duplicates: fingerprints, a segment-popcount embedding, a grid range-join, exact checks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from plotwise.llm.common import at, cut, id_and_text, named, placed, slices
from plotwise.llm.components import components


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit hashes have each bit set, lowest bit first."""
    lanes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    total = np.zeros(64, np.int64)
    for start in range(0, len(lanes), 255):  # a lane of eight bits holds sums up to 255
        total += np.add.reduce(lanes[start : start + 255], axis=0).view(np.uint8)
    return total


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """SimHash of one text: each bit is set if it is set in over half of the shingles' XXH64; zero without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and splits on space, tab to carriage return
    if not words:
        return 0
    line = b" ".join(words)
    width = min(width, len(words))
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    shingles = [line[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
    return digest(hashes)


def digest(hashes: np.ndarray) -> int:
    """The fingerprint of hashed shingles: each bit is set if it is set in over half of them; zero without any."""
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) of every whole text; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            values = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(values)], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """The popcounts of the 32 two-bit segments in one long, each in its own two bits, in unary: 00, 01, 11."""
    odd = F.lit(0x5555555555555555)
    next_bit = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(next_bit).bitwiseAND(odd), fp.bitwiseAND(next_bit).bitwiseAND(odd)
    return some.bitwiseOR(F.shiftleft(both, 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two such vectors: unary codes differ in as many bits as the counts differ."""
    return F.bit_count(a.bitwiseXOR(b))


def _masks(groups: int, radius: int) -> list[int]:
    """For every choice of ``groups - radius`` groups of segments, the bits that these hold, as signed longs."""
    edges = [round(32 * i / groups) for i in range(groups + 1)]
    own = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(own[i] for i in chosen) for chosen in combinations(range(groups), groups - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_pairs(prints: DataFrame, *, radius: int = 2, groups: int = 4, heavy: int = 4096, blocks: int = 16) -> DataFrame:
    """(a, b) with a < b: every pair of the distinct fingerprints in ``prints.fp`` that differ in at most ``radius`` bits.

    Embedding: the popcounts of 32 two-bit segments, whose Manhattan distance bounds the Hamming distance from
    below. Grid: the segments form ``groups`` groups; vectors within distance ``radius`` agree entirely on
    ``groups - radius`` of them at least, so they share a grid cell (of width one) for one of those choices.
    The equi-join on cells checks the lower bound, then the exact distance, and lets a pair through only for
    the first choice that it shares; it emits true links alone, each once. Cells with over ``heavy``
    fingerprints are joined in ``blocks`` x 1 blocks: one side is dealt out, the other repeated.
    """
    masks = _masks(groups, radius)
    cells = prints.select("fp", segment_counts(F.col("fp")).alias("v")).select(
        "fp", "v", F.posexplode(F.array(*[F.col("v").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "cell")
    )
    crowded = cells.groupBy("choice", "cell").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("choice", "cell", F.lit(blocks).alias("split"))
    cells = cells.join(crowded, ["choice", "cell"], "left").withColumn("split", F.coalesce("split", F.lit(1)))
    left = cells.select("choice", "cell", F.pmod(F.xxhash64("fp"), F.col("split")).cast("int").alias("block"), F.col("fp").alias("a"), F.col("v").alias("va"))
    right = cells.select("choice", "cell", F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("block"), F.col("fp").alias("b"), F.col("v").alias("vb"))
    va, vb = F.col("va"), F.col("vb")
    earlier = F.lit(False)
    for i, m in enumerate(masks):
        earlier = earlier | ((F.col("l.choice") > i) & (va.bitwiseXOR(vb).bitwiseAND(F.lit(m)) == 0))
    near = (F.col("a") < F.col("b")) & (manhattan(va, vb) <= radius) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & ~earlier
    same = (F.col("l.choice") == F.col("r.choice")) & (F.col("l.cell") == F.col("r.cell")) & (F.col("l.block") == F.col("r.block"))
    return left.alias("l").join(right.alias("r"), same & near).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Fingerprints within ``radius`` bits link; component_id is the smallest doc_id reachable, itself included.
    Rows are first reduced to distinct fingerprints with their smallest doc_id, map-side, so a group of copies
    costs one row per task; links and components are found among those alone.

    Null and empty texts have fingerprint zero and link like any other; repeated rows come out each; a null id
    keeps its fingerprint and takes part with no id of its own; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = cut(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    heads = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("head")))
    pairs = near_pairs(heads, radius=radius)
    found = components(pairs)
    groups = (
        heads.join(found.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "head", F.coalesce("component", "fp").alias("component"))
    )
    smallest = groups.groupBy("component").agg(F.min("head").alias("component_id"))
    named = groups.join(smallest, "component").select("fp", "component_id")
    return _name_rows(rows, named)


def _name_rows(rows: DataFrame, named: DataFrame, salts: int = 16) -> DataFrame:
    """Each row with its fingerprint's component; the rows of a very common fingerprint are dealt over ``salts`` keys."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    copies = named.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, ["fp", "salt"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near-duplicates: the least by id (nulls last), hash of the text, and place in the table.

    Rows are followed by their place, so null and repeated ids neither join groups nor lose them. ``docs`` must
    read in the same order each time, as files do. Null, empty and very long texts are treated as in
    ``near_duplicates``; an empty table gives an empty result; other columns stay as they are, whatever their names.
    """
    rows = placed(docs).withColumn("row", F.monotonically_increasing_id())
    text = at(docs, text_col).cast("string")
    groups = near_duplicates(rows.select("row", text.alias("text")), id_col="row", text_col="text", **options).select(F.col("doc_id").alias("row"), "component_id")
    own = rows.select("row", at(docs, id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"))
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash", "row")
    kept = own.join(groups, "row").groupBy("component_id").agg(F.min(rank).alias("rank")).select("rank.row")
    return named(rows.join(kept, "row", "left_semi"), docs)
