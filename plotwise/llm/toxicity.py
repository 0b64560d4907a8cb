"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import at, cut, id_and_text, placed, slices

ORDERS = (3, 4, 5, 6)
#: Characters whose n-grams are held at once; n-grams that begin in one window are distinct there.
WINDOW = 1 << 18
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def windows_of(text: str) -> Iterator[np.ndarray]:
    """Window by window, the sorted distinct n-grams of the lower-cased text's characters, with a space before and after.

    n as in ORDERS. An n-gram is a 64-bit hash of n and its characters; windows overlap by what an n-gram needs.
    """
    whole = f" {text.lower()} "
    for start in range(0, max(1, len(whole) - ORDERS[0] + 1), WINDOW):
        raw = np.frombuffer(whole[start : start + WINDOW + ORDERS[-1] - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        out = []
        for n in ORDERS:
            begins = min(WINDOW, len(raw) - n + 1)
            if begins <= 0:
                continue
            key = np.full(begins, n, np.uint64)
            for i in range(n):
                key = key * _FACTOR + raw[i : begins + i]
            out.append((key ^ (key >> np.uint64(32))) * _MIX)
        if out:
            found = np.sort(np.concatenate(out))
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]


def buckets(found: np.ndarray, bits: int) -> np.ndarray:
    return ((found * _FACTOR) >> np.uint64(64 - bits)).astype(np.int64)


def places(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of the sorted ``keys`` are in the sorted ``found``."""
    if not len(keys) or not len(found):
        return np.zeros(0, np.int64)
    spot = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    return np.flatnonzero(found[spot] == keys)


def deviations(counts: np.ndarray, base: float) -> np.ndarray:
    """How many standard deviations each toxic count lies from what the base rate predicts; ``counts`` has a row a label."""
    every = counts.sum(0)
    return np.where(every >= 3, np.abs(counts[1] - every * base) / np.sqrt(np.maximum(every * base * (1 - base), 1e-9)), 0.0)


def bucket_counts(pairs: Iterator[tuple[str, int]], bits: int) -> np.ndarray:
    """For each label, how many texts hold an n-gram of each of the 2^bits buckets."""
    counts = np.zeros((2, 1 << bits), np.int32)
    for text, label in pairs:
        own = [np.unique(buckets(found, bits)) for found in windows_of(text)]
        if own:
            counts[label, own[0] if len(own) == 1 else np.unique(np.concatenate(own))] += 1
    return counts


def held_grams(text: str, opened: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """The text's distinct n-grams in opened buckets, and its size: the sum of its windows' numbers of distinct n-grams."""
    own, size = [np.zeros(0, np.uint64)], 0
    for found in windows_of(text):
        own.append(found[opened[buckets(found, bits)]])
        size += len(found)
    return np.unique(np.concatenate(own)), size


def fit_held(held: list[np.ndarray], sizes: np.ndarray, y: np.ndarray, *, rounds: int = 80, least_z: float = 6.0, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature n-grams (sorted), their weights and a bias: logistic regression on ratio-scaled presence.

    The ratio of an n-gram is log((p + smooth) / |p|) - log((q + smooth) / |q|) with p and q the numbers of toxic
    and other texts that hold it. N-grams of three texts or more whose toxic count is ``least_z`` standard
    deviations from what the base rate predicts are features. A text's sum is divided by the root of its size, as long
    texts hold more features by chance. Without both classes there are no features and the bias is the base rate's.
    """
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    none = np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return none
    base = y.mean()
    keys, owner_counts = np.unique(np.concatenate(held), return_inverse=True)
    labels = np.repeat(y, [len(h) for h in held])
    exact = np.stack([np.bincount(owner_counts[labels == k], minlength=len(keys)) for k in (0, 1)])
    keep = deviations(exact, base) >= least_z
    if not keep.any():
        return none
    keys, (other, toxic) = keys[keep], exact[:, keep]
    scaled = np.log((toxic + smooth) / (y.sum() + 2 * smooth)) - np.log((other + smooth) / (n - y.sum() + 2 * smooth))
    rows = [places(keys, h) for h in held]
    root = np.sqrt(np.maximum(sizes, 1))
    index, owner = np.concatenate(rows), np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    scaled = scaled / np.sqrt(np.maximum((np.bincount(owner, scaled[index] ** 2, n) / root**2).mean(), 1e-9))
    balance = np.where(y > 0, 0.5 / base, 0.5 / (1 - base))
    v, bias = np.ones(len(scaled)), 0.0
    step_v, step_b = np.zeros(len(scaled)), 0.0
    for _ in range(rounds):  # gradient descent with momentum on the balanced log-loss, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, (scaled * v)[index], n) / root + bias, -30, 30)))
        error = balance * (p - y) / n
        step_v = 0.9 * step_v - (scaled * np.bincount(index, (error / root)[owner], len(scaled)) + 1e-5 * v)
        step_b = 0.9 * step_b - error.sum()
        v, bias = v + step_v, bias + step_b
    return keys, scaled * v, float(bias)


def opened_buckets(counts: np.ndarray, base: float, least_z: float) -> np.ndarray:
    """Buckets that may hold a feature: a rare n-gram's bucket deviates less than the n-gram if others share it, so half the deviation opens it."""
    return deviations(counts, base) >= least_z / 2


def fit(pairs: list[tuple[str, int]], bits: int, *, least_z: float = 6.0, **options) -> tuple[np.ndarray, np.ndarray, float]:
    """``fit_held`` from (text, label) pairs: texts are counted in 2^bits buckets, and n-grams by themselves in those that deviate."""
    y = np.array([label for _, label in pairs], np.int64)
    opened = opened_buckets(bucket_counts(iter(pairs), bits), y.mean() if len(y) else 0.5, least_z)
    held = [held_grams(text, opened, bits) for text, _ in pairs]
    return fit_held([h for h, _ in held], np.array([n for _, n in held]), y, least_z=least_z, **options)


def logit(text: str, keys: np.ndarray, weights: np.ndarray, bias: float) -> float:
    present, size = np.zeros(len(keys), bool), 0
    for found in windows_of(text):
        present[places(keys, found)] = True
        size += len(found)
    return float(weights[present].sum() / np.sqrt(max(size, 1)) + bias)


def train(docs: DataFrame, labels: DataFrame, *, bits: int = 22, least_z: float = 6.0, most_rows: int = 16_000, most_bytes: int = 64 << 20, ranges: int = 64, tasks: int = 16, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on a sample of the labelled rows outside the held-out fold.

    About ``most_rows`` rows and ``most_bytes`` bytes of text at most, picked by a hash of the id whatever the label;
    their ids, a few dozen KB, are broadcast to one scan of the documents, and their texts, checkpointed, dealt to
    ``tasks`` tasks. Those count buckets, in ``ranges`` stretches that are added up in tasks; a bit a bucket comes back.
    Then they send each text's n-grams in opened buckets, from which one task fits.
    Ids labelled more than once count as toxic if any label says so; null ids and labels are left out.
    """
    known = placed(labels).select(at(labels, id_col).cast("long").alias("doc_id"), at(labels, label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
    picked = lambda share: known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    share = min(1.0, most_rows / max(1, known.count()))
    texts = id_and_text(docs, id_col, text_col)
    read = lambda: texts.join(F.broadcast(picked(share)), "doc_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    found = read()
    if found["bytes"] > most_bytes:
        share *= most_bytes / found["bytes"]
        found = read()
    rows = cut(texts.join(F.broadcast(picked(share)), "doc_id").select("text", "label", "doc_id").repartition(tasks, "doc_id", "text"))
    base, width = found["toxic"] / max(1, found["n"]), (1 << bits) // ranges

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                yield text.as_py(), label.as_py()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bucket_counts(pairs(batches), bits).reshape(2, ranges, width)
        sent = [pa.compress(np.ascontiguousarray(counts[:, r]).tobytes(), codec="zstd", asbytes=True) for r in range(ranges)]
        yield pa.record_batch([pa.array(range(ranges), pa.int32()), pa.array(sent, pa.binary())], names=["range", "counts"])

    def opens(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(pa.decompress(c.as_py(), decompressed_size=8 * width, codec="zstd"), np.int32) for c in table["counts"])
        return pa.table({"range": table["range"].slice(0, 1), "bits": [np.packbits(opened_buckets(total.reshape(2, width), base, least_z)).tobytes()]})

    bits_of = rows.select("text", "label").mapInArrow(count, "range int, counts binary").groupBy("range").applyInArrow(opens, "range int, bits binary").collect()
    opened = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in sorted(bits_of)), np.uint8)).astype(bool)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, label in pairs(batches):
            held, size = held_grams(text, opened, bits)
            yield pa.record_batch([pa.array([held.astype("<u8").tobytes()]), pa.array([size], pa.int64()), pa.array([label], pa.int32())], names=["held", "size", "label"])

    def regress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.frombuffer(h, "<u8"), n, y) for b in batches for h, n, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        keys, weights, bias = fit_held([h for h, _, _ in got], np.array([n for _, n, _ in got]), np.array([y for *_, y in got]), least_z=least_z)
        yield pa.record_batch([pa.array([keys.astype("<u8").tobytes()]), pa.array([weights.astype("<f8").tobytes()]), pa.array([bias])], names=["keys", "weights", "bias"])

    held = rows.select("text", "label").mapInArrow(hold, "held binary, size long, label int").repartition(1).sortWithinPartitions("size", "label", "held")
    model = held.mapInArrow(regress, "keys binary, weights binary, bias double").first() if found["n"] else None
    if model is None:
        return np.zeros(0, np.uint64), np.zeros(0), 0.0
    return np.frombuffer(model["keys"], "<u8"), np.frombuffer(model["weights"], "<f8"), model["bias"]


def score(docs: DataFrame, keys: np.ndarray, weights: np.ndarray, bias: float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every whole text, in one narrow pass; the features travel with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            z = np.array([logit(t, keys, weights, bias) for t in texts])
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, from a classifier fitted on ``labels``.

    held_out: the CRC-32 of the id as text leaves 0 over 5; those rows' labels are never used. Null and empty
    texts are scored like any other (they hold no toxic n-gram); repeated rows are scored each; a null id is not
    held out; without labels of both kinds every score is the base rate; an empty table gives an empty result.
    """
    keys, weights, bias = train(docs, labels, **options)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, keys, weights, bias).select("doc_id", held.alias("held_out"), "score", "predicted")
