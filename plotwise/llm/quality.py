"""Quality rules: plain counts, then robust multivariate outliers by minimum-covariance-determinant estimates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.llm.common import at, cut, held, named, placed, slices

# Characters that count as symbols, and the white space that parts words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

_MARKS = re.compile(r"[!?;:()\[\]{}=_~^\\/\"@+0-9]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")

#: The transformed statistics, each with the least standard deviation that an estimate of it may have.
FEATURES = {"f_word": 0.06, "f_symbol": 0.25, "f_mark": 0.25, "f_upper": 0.25, "f_line": 0.25, "f_repeat": 0.25}


def counts(text: str) -> tuple[int, int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, marks and capitals of one text."""
    words = text.encode().split()  # bytes: splits on space, tab to carriage return
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    repeated = 0
    if len(words) > 3:
        number = {w: i for i, w in enumerate(set(words))}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        size = len(number)
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:] if size < 2_000_000 else np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            at = np.isin(windows, twice)
            covered = np.zeros(len(words), bool)
            for shift in range(3):
                covered[shift : shift + len(at)] |= at
            repeated = int(covered.sum())
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(_MARKS.findall(text)),
        len(_UPPER.findall(text)),
    )


def _row_hash(text: Column, lang: Column, source: Column) -> Column:
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("")) for c in (text, lang, source)])


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One narrow pass over the texts: the counts, the base rule and the transformed statistics.

    The transforms are logs of rates, with pseudo-counts that shrink short texts to a typical rate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = batch.columns[2:]
            done = 0
            for ids, texts in slices(iter([batch])):
                got = np.array([counts(t) for t in texts], np.int64).reshape(-1, 8)
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), *(m.slice(done, len(ids)) for m in meta), *(pa.array(got[:, i]) for i in range(8))],
                    names=["doc_id", "lang", "source", "row_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper"],
                )
                done += len(ids)

    rows = placed(docs).select(
        at(docs, id_col).cast("long").alias("doc_id"),
        *[F.coalesce(at(docs, c).cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))],
        _row_hash(at(docs, text_col), at(docs, lang_col), at(docs, source_col)).alias("row_hash"),
    ).mapInArrow(run, "doc_id long, lang string, source string, row_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, n_upper long")
    n = F.col("n_words")

    def rate(part: str, of: Column, weight: float, typical: float) -> Column:
        return F.log((F.col(part) + F.lit(weight * typical)) / (of + F.lit(weight)))

    return rows.select(
        "doc_id", "lang", "source", "row_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        F.log((F.col("word_chars") + 100.0) / (n + 20.0)).alias("f_word"),
        rate("n_symbols", n, 50.0, 0.02).alias("f_symbol"),
        rate("n_marks", n, 50.0, 0.05).alias("f_mark"),
        rate("n_upper", n, 50.0, 0.2).alias("f_upper"),
        rate("n_dup_lines", F.col("n_lines"), 10.0, 0.05).alias("f_line"),
        rate("n_repeat_words", n, 50.0, 0.1).alias("f_repeat"),
    )


def _bin_edges(rows: DataFrame, key: list[str], bin_col: str, shares: dict[str, float]) -> DataFrame:
    """For each key, the first bin at which the cumulative count reaches each share. Grouped rows only reach the window."""
    hist = rows.groupBy(*key, bin_col).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*key)
    hist = hist.withColumn("upto", F.sum("n").over(by.orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(by))
    return hist.groupBy(*key).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col(bin_col))).alias(name) for name, q in shares.items()])


def _with(rows: DataFrame, estimates: DataFrame, few: bool, salts: int = 16, on: tuple[str, ...] = ("key",)) -> DataFrame:
    """Rows joined to their key's estimates. Few keys (counted) are broadcast, so rows stay where they are; otherwise a
    key's rows are dealt over ``salts`` keys, its one estimate repeated."""
    if few:
        return rows.join(F.broadcast(estimates), list(on))
    copies = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(copies, [*on, "salt"])


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance from the estimate's mean and inverse Cholesky factor (row-major, lower)."""
    total, k = F.lit(0.0), 0
    for i in range(len(names)):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col("factor")[k] * (F.col(names[j]) - F.col("mean")[j])
            k += 1
        total = total + part * part
    return total


def _estimate(moments: DataFrame, floors: list[float]) -> DataFrame:
    """(key, start, mean, factor, logdet) from each key's and start's summed moments: one row of a few dozen numbers each.

    factor: the inverse Cholesky factor of the covariance (row-major, lower). logdet: the log of its determinant.
    """
    p = len(floors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, factors, logs = [], [], []
            for sums in batch.column(2).to_pylist():
                n, first, second = sums[0], np.array(sums[1 : p + 1]), sums[p + 1 :]
                mean, cov = first / n, np.zeros((p, p))
                cov[np.tril_indices(p)] = second
                cov = (cov + np.tril(cov, -1).T) / n - np.outer(mean, mean)
                cov[np.diag_indices(p)] = np.maximum(cov[np.diag_indices(p)], 0) + np.array(floors) ** 2
                lower = np.linalg.cholesky((cov + cov.T) / 2)
                means.append(mean.tolist())
                factors.append(np.linalg.inv(lower)[np.tril_indices(p)].tolist())
                logs.append(float(2 * np.log(np.diag(lower)).sum()))
            kind = pa.list_(pa.float64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(means, kind), pa.array(factors, kind), pa.array(logs, pa.float64())], names=["key", "start", "mean", "factor", "logdet"])

    return moments.mapInArrow(run, "key string, start int, mean array<double>, factor array<double>, logdet double")


def _moments(names: list[str]) -> list[Column]:
    return [F.lit(1.0), *map(F.col, names), *(F.col(names[i]) * F.col(names[j]) for i in range(len(names)) for j in range(i + 1))]


def _step(rows: DataFrame, distance: Column, share: float, names: list[str], floors: list[float], few: bool) -> DataFrame:
    """A concentration step: the estimate of each key and start from its ``share`` of rows with the smallest distances.

    Distances fall into bins of 1/64 in log, and whole bins are taken until they hold the share. First the rows of each
    bin are counted, which tells the last bin of each key and start; then the moments of the rows up to it are summed by
    key and start map-side. So no key's rows meet in one task, and only counts are shuffled by bin.
    """
    binned = rows.withColumn("bin", F.floor(64 * F.log(distance + 1e-9)))
    by = Window.partitionBy("key", "start")
    counted = binned.groupBy("key", "start", "bin").agg(F.count("*").alias("n"))
    counted = counted.withColumn("before", F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("all", F.sum("n").over(by))
    last = counted.where(F.col("before") < F.ceil(F.col("all") * share)).groupBy("key", "start").agg(F.max("bin").alias("last"))
    inner = _with(binned, last, few, on=("key", "start")).where(F.col("bin") <= F.col("last"))
    return _estimate(inner.groupBy("key", "start").agg(F.array(*[F.sum(m) for m in _moments(names)]).alias("sums")), floors)


def _quantile(p: int, z: float) -> float:
    """Wilson-Hilferty quantile of chi-squared with p degrees of freedom at the normal deviate z."""
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


def _starts(keyed: DataFrame, names: list[str], floors: list[float], starts: int) -> DataFrame:
    """First estimates (key, start, mean, factor): start 0 from medians and quartile ranges, the others from a row of
    a hash order each, with the same spreads: the row of a key that comes first under the start's seed."""
    long = keyed.select("key", F.posexplode(F.array(*[F.floor(F.col(n) * 1000) for n in names])).alias("dim", "bin"))
    edges = _bin_edges(long, ["key", "dim"], "bin", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    listed = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("dim", v.alias("v")))), lambda s: s.v)
    centre = edges.groupBy("key").agg(
        listed(F.col("q2") / 1000.0).alias("mean"),
        listed(F.sqrt(F.pow((F.col("q3") - F.col("q1")) / 1349.0, F.lit(2)) + F.pow(F.element_at(F.array(*map(F.lit, floors)), F.col("dim") + 1), F.lit(2)))).alias("spread"),
    )
    point = F.array(*map(F.col, names))
    picked = keyed.groupBy("key").agg(*[F.min(F.struct(F.xxhash64(F.lit(s), "row_id").alias("h"), point.alias("v")))["v"].alias(f"p{s}") for s in range(1, starts)])
    both = centre.join(picked, "key").select("key", "spread", F.posexplode(F.array("mean", *[f"p{s}" for s in range(1, starts)])).alias("start", "mean"))
    p = len(names)
    factor = F.array(*[1 / F.col("spread")[i] if i == j else F.lit(0.0) for i in range(p) for j in range(i + 1)])
    return both.select("key", F.col("start").cast("int").alias("start"), "mean", factor.alias("factor"))


def _fall(old: DataFrame, new: DataFrame, few: bool) -> float | None:
    """By how much the log determinant of a key falls at most; estimates of few keys are the driver's own already and need no job."""
    if not few:
        return new.alias("new").join(old.alias("old"), "key").agg(F.max(F.col("old.logdet") - F.col("new.logdet"))).first()[0]
    before, after = ({r["key"]: r["logdet"] for r in e.select("key", "logdet").collect()} for e in (old, new))
    falls = [before[k] - after[k] for k in before.keys() & after.keys()]
    return float(np.max(falls)) if falls else None


def outliers(rows: DataFrame, features: dict[str, float] = FEATURES, *, share: float = 0.75, starts: int = 4, short: int = 2, most_steps: int = 20, z: float = 10.0, least: int = 100, most_broadcast: int = 10_000) -> DataFrame:
    """(row_id, distance) of the outlying rows of ``(row_id, lang, source, features...)``.

    Minimum covariance determinant per language and source: ``starts`` first estimates (medians and quartile ranges;
    rows picked by a hash) each get ``short`` concentration steps over the ``share`` of rows nearest to the last one;
    the one of the least determinant goes on until no key's determinant falls by more than 1e-6 in log (at most
    ``most_steps``). Its distances are scaled so that the median is that of chi-squared, the rows within the 97.5 %
    quantile give the reweighted mean and covariance, and distances from that are scaled likewise. A row is outlying
    if its squared distance exceeds the chi-squared quantile at ``z`` deviates. Groups under ``least`` rows, too few to
    estimate from, use their language's rows, and languages under ``least`` all rows. ``features`` gives each
    statistic's least standard deviation. Distances are told apart to 1/64 in log where rows are ranked by them.
    Up to ``most_broadcast`` languages and sources, counted, their estimates (about 1 kB a key and start) pass through
    the driver and are broadcast; beyond that they are checkpointed and joined over salted keys. Rows get their keys
    once, and are checkpointed with them for the steps to read.
    """
    names, floors = list(features), list(features.values())
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    in_lang = sizes.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    keys = sizes.join(in_lang, "lang").select(
        "lang", "source", "n",
        F.when(F.col("n") >= least, F.to_json(F.array("lang", "source"))).when(F.col("n_lang") >= least, F.to_json(F.array("lang"))).otherwise(F.lit("[]")).alias("key"),
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(16)).cast("int"))
    kept = held(keys, most_broadcast)
    if few := kept is not None:
        # Made once, as every step reads it, in files of some 50,000 rows, however many partitions the rows have.
        files = max(12, (kept.agg(F.sum("n")).first()[0] or 0) // 50_000)
        keyed = cut(salted.join(F.broadcast(kept), ["lang", "source"]).select("key", "salt", "row_id", *names).coalesce(files))
    else:
        copies = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        keyed = cut(salted.join(copies, ["lang", "source", "salt"]).select("key", "salt", "row_id", *names))

    def settled(estimate: DataFrame) -> DataFrame:
        # A key belongs to a pair, a language or all: at most twice the pairs and one.
        return held(estimate, (2 * most_broadcast + 1) * starts) if few else cut(estimate)

    estimate = settled(_starts(keyed, names, floors, starts))
    for _ in range(short):
        estimate = settled(_step(_with(keyed, estimate, few), _distance(names), share, names, floors, few))
    chosen = estimate.groupBy("key").agg(F.min(F.struct("logdet", "start", "mean", "factor")).alias("e")).select("key", "e.start", "e.mean", "e.factor", "e.logdet")
    estimate = settled(chosen)
    for _ in range(most_steps):
        nearer = settled(_step(_with(keyed, estimate, few), _distance(names), share, names, floors, few))
        fell = _fall(estimate, nearer, few)
        estimate = nearer
        if fell is None or fell <= 1e-6:
            break
    within = _scaled(keyed, estimate, names, few, keep=names).where(F.col("distance") <= _quantile(len(names), 1.96))
    reweighted = within.withColumn("start", F.lit(0)).groupBy("key", "start").agg(F.array(*[F.sum(m) for m in _moments(names)]).alias("sums"))
    return _scaled(keyed, settled(_estimate(reweighted, floors)), names, few).select("row_id", "distance").where(F.col("distance") > _quantile(len(names), z))


def _scaled(keyed: DataFrame, estimate: DataFrame, names: list[str], few: bool, keep: list[str] = ()) -> DataFrame:
    """key, row_id, distance and ``keep`` of every row, each key's squared distances divided so that their median is that of chi-squared, if it is above."""
    measured = _with(keyed, estimate, few).select("key", "salt", "row_id", *keep, _distance(names).alias("distance"))
    middle = _bin_edges(measured.withColumn("bin", F.floor(64 * F.log(F.col("distance") + 1e-9))), ["key"], "bin", {"half": 0.5})
    middle = middle.select("key", F.greatest(F.lit(1.0), F.exp((F.col("half") + 1) / 64.0) / _quantile(len(names), 0.0)).alias("scale"))
    return _with(measured, middle, few).select("key", "row_id", *keep, (F.col("distance") / F.col("scale")).alias("distance"))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance and row_hash of every row.

    The base rule rejects texts under 50 words or with over half their words in repeated 3-word windows; of the
    rest, ``outliers`` rejects those far from their language and source. ``distance`` is null for rows that it
    keeps or never sees.

    Null and empty texts have zero counts and fail the base rule; null languages and sources count as empty
    names; repeated rows are judged each; a table without rows gives an empty result; other columns are ignored.
    """
    stats = statistics(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col)
    stats = cut(stats.withColumn("row_id", F.monotonically_increasing_id()))
    far = outliers(stats.where("not base_failed").select("row_id", "lang", "source", *FEATURES), **options)
    return stats.join(far, "row_id", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("distance").isNull()).alias("kept"), "distance", "row_hash",
    )


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects: one anti-join against the rejected, by id and a hash of all that the verdict rests on.

    Null, empty and very long texts, null ids, languages and sources are judged as ``judge`` says; repeated rows share
    a verdict; an empty table gives an empty result; other columns stay as they are, whatever their names.
    """
    verdicts = judge(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col, **options)
    bad = verdicts.where("not kept").select(F.col("doc_id").alias("bad_id"), F.col("row_hash").alias("bad_hash")).distinct()
    same = at(docs, id_col).cast("long").eqNullSafe(F.col("bad_id")) & (_row_hash(*(at(docs, c) for c in (text_col, lang_col, source_col))) == F.col("bad_hash"))
    return named(placed(docs).join(bad, same, "left_anti"), docs)
