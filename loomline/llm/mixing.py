"""Mixing sources to target weights (native).

Tokens are summed per source, a repetition rate is derived from each source's target, and every document is taken
floor(rate) times plus one Bernoulli copy whose probability is the rate's fraction and whose draw is a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, placed, spread_join, stage

#: Seed of the draws.
SEED = 0


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """Uniform in [0, 1) from the id and the seed: 52 bits of MD5. Rows without an id share one draw."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52)


def source_targets(sums: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size, n) to (source, source_size, n, target).

    Sources take the weights in turn, by code point with null last, and share the total. A target stops at `most` times
    its source's size; the rest is shared anew by weight until none is above. Ranks come from range partitions and their
    counts, so no task holds all sources; only sums reach the driver.
    """
    null = F.col("source").isNull()
    ranged = stage(sums.repartitionByRange(null, F.col("source")).withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    in_part = Window.partitionBy("part").orderBy(null, "source")
    rank = F.col("offset") + F.row_number().over(in_part) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = stage(
        ranged.join(F.broadcast(offsets), "part").select("source", "source_size", "n", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")),
        "ranked",
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, share, n_capped = 0.0, F.lit(0.0), -1
    while total:
        is_capped = F.lit(False) if n_capped < 0 else share > F.col("cap")
        n, capped, open_weight = ranked.agg(
            F.count_if(is_capped), F.coalesce(F.sum(F.when(is_capped, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~is_capped, F.col("weight")))
        ).first()
        if n == n_capped or not open_weight:
            break
        n_capped, level = n, (total - capped, open_weight)
        share = F.col("weight") * F.lit(float(level[0])) / F.lit(float(level[1]))
    return ranked.select("source", "source_size", "n", F.least(share, F.col("cap")).alias("target"))


def mixing_rates(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source, size) to one row per source: source, source_size, n (rows), target, whole (sure copies), fraction (chance of one more)."""
    sums = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sums")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    targets = source_targets(sums, weights, most).withColumn("rate", rate)
    return stage(targets.select("source", "source_size", "n", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("fraction")), "rates")


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows and, in _rate, what their source has in rates; null is a source of its own."""
    of, none, rate = (free(c, rows.columns) for c in ("_of", "_none", "_rate"))
    key = lambda c: (F.coalesce(c.cast("string"), F.lit("")).alias(of), c.isNull().alias(none))
    own = rates.select(*key(F.col("source")), F.col("n").alias(free("_n", rows.columns)), F.struct("source_size", "target", "whole", "fraction").alias(rate))
    joined = spread_join(rows.select("*", *key(F.col("source"))), own, [of, none], own.columns[2])
    return joined.select(*rows.columns, F.col(rate).alias(rate))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _copies(rate: Column) -> Column:
    return rate["whole"] + F.when(draw(F.col("doc_id")) < rate["fraction"], 1).otherwise(0)


def mixture_report(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """Per row of docs(doc_id, text, source): doc_id, size, source_size, target, taken.

    Null text has size 0; null sources form one source; a null id draws as the empty id; repeated rows are rows of their
    own and draw alike. A source whose sizes sum to 0 has target 0. No rows give no rows. Other columns are not read.

    The copies by chance are independent, so a source's taken words have the target as their mean and deviate from it by
    sqrt(f (1 - f) * sum of size^2), f being the rate's fraction: by one part in sqrt(rows) or so, more where few long
    documents make up a source, and a source of one document takes it whole or not at all.
    """
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    joined = _with_rates(sized, mixing_rates(sized, weights, most))
    rate = F.col(joined.columns[-1])
    return joined.select("doc_id", "size", rate["source_size"].alias("source_size"), rate["target"].alias("target"), (F.col("size") * _copies(rate)).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """docs' own columns, each row as often as the mixture takes it, with the number of the copy as mix_copy (from 1).

    Rules as in mixture_report: null and empty texts have size 0 and follow their source's rate, null sources form one, a
    null id draws as the empty id, repeated rows draw alike, no rows give no rows. Columns of any name are carried along; if
    mix_copy is taken, the number's name gets underscores. Rates are joined by broadcast, of sources too many for that only
    the large ones', so no source's texts meet in one task.
    """
    docs = docs if placed(docs) else stage(docs, "docs")
    joined = _with_rates(docs, mixing_rates(docs.select("source", word_count(F.col("text")).alias("size")), weights, most))
    copies = _copies(F.col(joined.columns[-1]))
    return joined.filter(copies > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), copies.cast("bigint"))).alias(free("mix_copy", docs.columns)))


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sums as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select source, source_size, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w,
    source_size * 3.0::double as cap from sums),
ordered as (
  select *, row_number() over (order by cap / w, w, source nulls last) as k, (select sum(source_size) from weighed)::double as total from weighed),
prefix as (
  select *, coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0) as cap_before,
    sum(w) over (order by k rows between current row and unbounded following) as w_left from ordered),
first_open as (
  select total - cap_before as mass, w_left from prefix where w * (total - cap_before) / w_left <= cap order by k limit 1),
targets as (
  select source, source_size, case when total > 0 then least(w * mass / w_left_open, cap) else 0.0 end as target
  from ordered left join (select mass, w_left as w_left_open from first_open) on true),
rates as (
  select *, case when source_size > 0 then least(target / source_size, 3.0::double) else 0.0::double end as rate from targets),
parts as (select *, floor(rate)::bigint as whole, rate - floor(rate) as fraction from rates),
draws as (select distinct doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':0'), 1, 13))::bigint / 4503599627370496.0::double as u from sized)
select d.doc_id, d.size, p.source_size, p.target,
  (d.size * (p.whole + case when r.u < p.fraction then 1 else 0 end))::bigint as taken
from sized d
join parts p on d.source is not distinct from p.source
join draws r on r.doc_id is not distinct from d.doc_id
"""
