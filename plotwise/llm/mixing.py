"""Mixing sources to target weights by Poisson replication and a global shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import at, cut, named, placed


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts: the first 52 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, *, source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0) -> DataFrame:
    """(mix_source, rate, cdf, powers): each source's mean number of copies, its Poisson distribution function, and the steps of a search in it.

    A source's share of the result is proportional to its weight, or without ``weights`` to its number of rows
    to the power ``temperature``; sources that ``weights`` doesn't name get none. The expected result has
    ``size`` times the rows. Counts are summed map-side; one row a source remains.
    """
    counts = cut(docs.groupBy(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("mix_source")).agg(F.count("*").cast("double").alias("n")))
    if weights is None:
        weight = F.pow("n", F.lit(temperature))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair] or [F.lit(""), F.lit(0.0)]), F.col("mix_source")).cast("double"), F.lit(0.0))
    counts = counts.withColumn("weight", weight)
    rows, total = counts.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rate = F.lit(size * rows / total if total else 0.0) * F.col("weight") / F.col("n")
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int")
    # Cumulative probabilities of 0, 1, ..., from logs, so that no rate underflows.
    step = lambda acc, k: F.struct(
        (acc["log"] + F.log("rate") - F.log(k)).alias("log"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(acc["log"] + F.log("rate") - F.log(k)))).alias("cdf"),
    )
    start = F.struct((-F.col("rate")).alias("log"), F.array(F.exp(-F.col("rate"))).alias("cdf"))
    found = counts.withColumn("rate", rate).select("mix_source", "rate", F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0))).alias("cdf"))
    return found.withColumn("powers", F.transform(F.sequence(F.floor(F.log2(F.size("cdf"))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k)))


def _copies(docs: DataFrame, id_col: str, source_col: str, weights: dict[str, float] | None, temperature: float, size: float, seed: int, most_broadcast: int) -> DataFrame:
    """The placed columns of ``docs`` with mix_copy and mix_key, a row a copy, in the order of the key."""
    spark = docs.sparkSession
    source = F.coalesce(at(docs, source_col).cast("string"), F.lit(""))
    table = cut(rates(placed(docs).select(source.alias("source")), weights=weights, temperature=temperature, size=size))
    own = placed(docs).columns
    rows = placed(docs).select(*own, F.coalesce(at(docs, id_col).cast("string"), F.lit("")).alias("mix_id"), source.alias("mix_source"))
    if table.count() <= most_broadcast:
        joined = rows.join(F.broadcast(table), "mix_source")
    else:
        salted = table.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = rows.withColumn("mix_salt", F.pmod(F.xxhash64("mix_id"), F.lit(64)).cast("int")).join(salted, ["mix_source", "mix_salt"])
    u = uniform(F.lit(str(seed)), F.col("mix_id"))
    # How many of the sorted probabilities are at most u: a binary search over powers of two, the largest first.
    number = F.aggregate("powers", F.lit(0), lambda n, p: F.when((n + p <= F.size("cdf")) & (F.get("cdf", n + p - 1) <= u), n + p).otherwise(n))
    copies = joined.withColumn("mix_n", number).where("mix_n > 0").select(*own, "mix_id", F.explode(F.sequence(F.lit(1), F.col("mix_n"))).alias("mix_copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("mix_id"), F.col("mix_copy"))), 1, 15), 16, 10).cast("long")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    width = -(-(1 << 60) // parts)
    return (
        copies.select(*own, "mix_copy", key.alias("mix_key"))
        .repartitionById(parts, F.floor(F.col("mix_key") / F.lit(width)).cast("int"))
        .sortWithinPartitions("mix_key")
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0, seed: int = 42, most_broadcast: int = 10_000) -> DataFrame:
    """``docs`` with each row repeated a Poisson number of times, in a global random order.

    The number is the Poisson distribution of the source's rate inverted at a hash of seed and id, so it
    depends on neither partitions nor retries. Adds ``mix_copy`` (from 1) and ``mix_key``, a 60-bit hash of
    seed, id and copy: rows are dealt to as many ranges of it as there are shuffle partitions and sorted by it,
    so partition by partition they stand in its order. The only shuffle of the rows is that one; the rates are
    broadcast up to ``most_broadcast`` sources, else joined over salted keys.

    A null source counts as an empty name, a null id as an empty one; texts are not read, so null, empty and very
    long ones are copied like any other; repeated rows get equal numbers of copies and equal keys; an empty table
    gives an empty result; other columns stay as they are, but those called mix_copy or mix_key are replaced.
    """
    rows = _copies(docs, id_col, source_col, weights, temperature, size, seed, most_broadcast)
    return rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in ("mix_copy", "mix_key")], "mix_copy", "mix_key")


def remix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0, seed: int = 42, most_broadcast: int = 10_000) -> DataFrame:
    """As ``mix``, with the columns of ``docs`` alone, whatever their names."""
    return named(_copies(docs, id_col, source_col, weights, temperature, size, seed, most_broadcast), docs)
