"""Mixing sources to target weights by Poisson replication.

Every document of a source is repeated a Poisson number of times whose mean is the source's target repetition rate,
target weight x documents / documents of the source. The number comes from inverting the distribution at a uniform
value hashed from key and seed, so a rerun, a retry or another partitioning gives the same mix. Copies are exploded
and shuffled globally by a hashed order key. The keys are uniform, so a copy's partition is its key's place among them:
one shuffle, no sample, and counts are worked out once.

The inverse needs no table per source: the distribution's running sum is carried in a fold over as many terms as have
a sum over the largest uniform value (1 - 2^-52), by each row's own rate. From ``LARGE`` on, where exp(-rate) comes near
the least double, the fold starts at twelve deviations below the rate, with that term from Stirling's series; the terms
before it sum to less than 2^-52, so only a uniform value of exactly 0 sees the difference. Rates are joined by broadcast as
long as the sources number at most ``BROADCAST_SOURCES``, else by shuffle with the hot sources' rows split by AQE.

Cases: a null source is a source of its own; equal keys get equal counts; a null key hashes as its own value; a null
or empty text is repeated like any other; the copies of rows of one key and source have equal order keys, and among these the order is open; sources without a target keep rate 0 if targets are given; an empty table
stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.frames import free
from lexmill.session import table

BROADCAST_SOURCES = 10_000
#: Target weights follow counts to this power: 1 keeps the mix, 0 makes sources equal.
TEMPERATURE = 0.5
#: Rates above this are summed from near the least counts that occur, not from 0.
LARGE = 500.0
#: Copies that a partition of the result should hold at most; it has at least ``spark.sql.shuffle.partitions``.
PARTITION_ROWS = 50_000


def uniform(key: Column, seed: str) -> Column:
    """52 hashed bits as a double from 0 to 1, 1 left out."""
    text = F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def poisson_count(u: Column, rate: Column) -> Column:
    """The least k with u < P(X <= k) for X of Poisson law, by a running sum of terms."""
    wide = F.sqrt(rate) * 12 + 30
    large = rate > LARGE
    least = F.when(large, F.floor(rate - wide)).otherwise(F.lit(0)).cast("int")
    # ln of rate^k exp(-rate) / k! with ln k! from Stirling's series
    log_term = least * F.log(rate / least) + (least - rate) - F.log(least * (2 * math.pi)) / 2 - 1 / (12.0 * least) + 1 / (360.0 * F.pow(least.cast("double"), F.lit(3.0)))
    zero = F.exp(F.when(large, log_term).otherwise(-rate))
    start = F.struct(zero.alias("term"), zero.alias("sum"), least.alias("k"))

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * rate / k
        more = a["sum"] <= u
        return F.struct(term.alias("term"), F.when(more, a["sum"] + term).otherwise(a["sum"]).alias("sum"), F.when(more, k.cast("int")).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(least + 1, F.ceil(rate + wide).cast("int")), start, step)["k"]


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", key_col: str = "doc_id", seed: str = "mix", temperature: float = TEMPERATURE, prefix: str = "") -> DataFrame:
    """``docs`` with each row repeated, plus ``copy`` (from 0) and ``order_key`` (named with ``prefix``), in global order of the key.

    Columns of these names are replaced. ``weights`` are target shares by source; without them, shares follow the sources' counts to the power ``temperature``.
    """
    copy, order = f"{prefix}copy", f"{prefix}order_key"
    docs = docs.drop(copy, order)
    rate, n, key_name = free(docs, "_rate", "_n", "_key")
    name = F.coalesce(F.col(source_col).cast("string"), F.lit("\0null"))
    counts = docs.groupBy(name.alias(key_name)).agg(F.count(F.lit(1)).alias("_count"))
    if weights is None:
        share = F.pow(F.col("_count").cast("double"), F.lit(float(temperature)))
    else:
        given = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]) if weights else None
        share = F.coalesce(F.element_at(given, F.col(key_name)), F.lit(0.0)) if weights else F.lit(0.0)
    counts = counts.withColumn("_share", share)
    total = counts.agg(F.count(F.lit(1)), F.sum("_count"), F.sum("_share")).first()
    if not total[0] or not total[2]:
        return docs.limit(0).withColumn(copy, F.lit(0)).withColumn(order, F.lit(""))
    scale = total[1] / total[2]
    rates = counts.select(key_name, (F.col("_share") / F.col("_count") * F.lit(scale)).alias(rate))
    if total[0] <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    counted = docs.withColumn(key_name, name).join(rates, key_name).withColumn(n, poisson_count(uniform(F.col(key_col), seed), F.col(rate)))
    copies = counted.filter(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed} order"), F.coalesce(F.col(key_col).cast("string"), F.lit("null")), F.col(copy)))
    mixed = copies.withColumn(order, key).drop(key_name, rate, n)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total[1] // PARTITION_ROWS))
    place = F.shiftright(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * parts, 32).cast("int")
    return mixed.repartitionById(parts, place).sortWithinPartitions(order)


def op10_poisson_mix(spark, sf_dir: str) -> DataFrame:
    """Every copy of every document that the mix has: the columns of documents, copy and order_key."""
    return mix_sources(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH c AS (SELECT coalesce(source, chr(1)) AS s, count(*)::DOUBLE AS n FROM documents GROUP BY 1),
r AS (SELECT s, pow(n, 0.5) / n * ((SELECT sum(n) FROM c) / (SELECT sum(pow(n, 0.5)) FROM c)) AS rate FROM c),
d AS (SELECT documents.*, rate, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM documents JOIN r ON coalesce(source, chr(1)) = r.s),
t AS (SELECT s, rate, k::INT AS k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS term FROM r, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS g(k)),
cdf AS (SELECT s, k, sum(term) OVER (PARTITION BY s ORDER BY k) AS p FROM t),
n AS (SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.s = coalesce(d.source, chr(1)) AND cdf.p <= d.u) AS n FROM d)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
       md5('mix order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy::VARCHAR) AS order_key
FROM (SELECT *, unnest(range(0, n)) AS copy FROM n WHERE n > 0)
"""
