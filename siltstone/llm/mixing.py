"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. A source takes each of its documents
``floor(target / source_size)`` times and, once more, those whose hash lies
below the source's threshold; of the document at the threshold it takes as many
words as the budget still has. The threshold is found without sorting rows:
sizes are summed by source and hash bucket, a running sum over at most
``2 ** bits`` buckets finds the bucket in which the budget ends, and only that
boundary bucket is summed again by its next hash bits, down to whole hashes.
Thresholds for a smaller budget lie lower, so smaller mixes nest in larger ones.

Cases: null or empty text has size 0 and takes 0; very long texts count whole; a null source is a source of
its own, sorted last; rows of equal hash (repeated rows) at the threshold
share what is left; an empty
table gives an empty result. Extra columns are kept and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, documents, hash60, materialize, n_words

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MAX_EPOCHS = 3
#: Hash bits read at each level, the highest first; 60 together.
LEVELS = (16, 16, 28)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): the total size shared by weight, no source above max_epochs times its size.

    What a capped source can't take is shared again by weight. With sources
    ordered by cap / weight the cut is the first at which an equal share per
    weight fits. One row per source, so the windows here are over the source
    list, not the corpus.
    """
    every, by_cap = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    per_rank = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    total = W.partitionBy(F.lit(0))
    s = sizes.withColumn("weight", per_rank).withColumn("fill", F.col("source_size") * max_epochs / F.col("weight").cast("double"))
    s = s.withColumn("all", F.sum("source_size").over(total)).withColumn("all_w", F.sum("weight").over(total))
    s = s.withColumn("cap_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_epochs).withColumn("w_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", (F.col("all") - F.col("cap_before")).cast("double") / (F.col("all_w") - F.col("w_before")).cast("double"))
    level = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(total)
    target = F.least(F.coalesce(level, F.lit(float("inf"))) * F.col("weight"), (F.col("source_size") * max_epochs).cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def _boundary(rows: DataFrame, budgets: DataFrame, shift: int, key: list[str]) -> DataFrame:
    """Per source, the bucket of hash >> shift in which the budget ends: (source, left, base, cut, inside).

    base: the size below the bucket; left: the budget. Sources whose budget is
    never passed have no row.
    """
    sums = rows.groupBy("source", F.shiftright("hash", shift).alias("cut")).agg(F.sum("size").alias("part"))
    sums = sums.join(budgets, sums["source"].eqNullSafe(budgets["_source"]))
    upto = F.sum("part").over(W.partitionBy("source").orderBy("cut").rowsBetween(W.unboundedPreceding, 0)) + F.col("base")
    passed = sums.withColumn("upto", upto).where("upto > budget AND upto - part <= budget")
    return passed.groupBy(F.col("source").alias("_source")).agg(F.first("budget").alias("budget"), F.min(F.struct("cut", (F.col("upto") - F.col("part")).alias("base"), "part")).alias("b")).select("_source", "budget", F.col("b.cut").alias("cut"), F.col("b.base").alias("base"), F.col("b.part").alias("part"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, rest, taken) for every row of docs; rest: words of one more, cut copy."""
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("hash")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    targets = materialize(targets.withColumn("budget", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")))

    at = targets.select(F.col("source").alias("_source"), "budget", F.lit(0).cast("bigint").alias("base"))
    inside, bits = rows.where("size > 0"), 60
    for level in LEVELS:
        bits -= level
        found = materialize(_boundary(inside, at, bits, ["source"]))
        at = found.select("_source", "budget", "base")
        if bits:
            near = found.select(F.col("_source").alias("_in"), F.col("cut").alias("_cut"))
            inside = inside.join(near, inside["source"].eqNullSafe(near["_in"]) & (F.shiftright("hash", bits) == F.col("_cut"))).select(*rows.columns)
            inside = materialize(inside)
    edge = found.select(F.col("_source"), F.col("cut").alias("threshold"), ((F.col("budget") - F.col("base").cast("double")) / F.col("part").cast("double")).alias("share"))
    plan = targets.join(edge, targets["source"].eqNullSafe(edge["_source"]), "left")
    plan = plan.select(F.col("source").alias("_source"), "source_size", "target", "whole", F.when(F.col("budget") > 0, F.coalesce("threshold", F.lit(1 << 60))).otherwise(F.lit(-1)).alias("threshold"), F.coalesce("share", F.lit(0.0)).alias("share"))
    out = rows.join(plan, rows["source"].eqNullSafe(plan["_source"]))
    copies = F.col("whole") + (F.col("hash") < F.col("threshold")).cast("bigint")
    rest = F.when(F.col("hash") == F.col("threshold"), F.floor(F.col("size") * F.col("share"))).otherwise(F.lit(0)).cast("bigint")
    out = out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("bigint")).withColumn("rest", F.when(F.col("size") > 0, rest).otherwise(F.lit(0)).cast("bigint"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "rest", (F.col("copies") * F.col("size") + F.col("rest")).alias("taken"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with every row repeated as often as the mix takes it, all columns kept.

    The one document of a source at which its budget ends comes once more with
    its first words only, joined by single spaces. Rows that share doc_id and
    source are taken alike.
    """
    per = mix_sources(docs).groupBy(F.col("doc_id").alias("_doc"), F.col("source").alias("_from"))
    taken = per.agg(F.max("copies").alias("_copies"), F.max("rest").alias("_rest")).where("_copies > 0 OR _rest > 0")
    out = docs.join(taken, docs["doc_id"].eqNullSafe(taken["_doc"]) & docs["source"].eqNullSafe(taken["_from"]))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("_rest").cast("int")), " ")
    whole = F.when(F.col("_copies") > 0, F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_piece", F.explode(F.concat(whole, F.when(F.col("_rest") > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))))
    out = out.withColumn("text", F.when(F.col("_piece") == 1, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_piece") == 1, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN '-' ELSE '=' || doc_id::VARCHAR END), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (SELECT *, source_size * 3 / weight::DOUBLE AS fill FROM w),
c AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_w,
    coalesce(sum(source_size) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3 AS cap_before,
    coalesce(sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before FROM f),
l AS (SELECT *, (total - cap_before)::DOUBLE / (all_w - w_before)::DOUBLE AS level FROM c),
t AS (SELECT source, source_size, least(coalesce(max(CASE WHEN level <= fill THEN level END) OVER (), 'inf'::DOUBLE) * weight, (source_size * 3)::DOUBLE) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT *, target - (whole * source_size)::DOUBLE AS budget FROM b),
h AS (SELECT source, hash, sum(size) AS part, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS upto FROM d WHERE size > 0 GROUP BY source, hash),
i AS (SELECT h.source, h.hash, g.budget > 0 AND upto <= budget AS full_in, (budget - (upto - part)::DOUBLE) / part::DOUBLE AS share
    FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source WHERE g.budget > 0 AND upto - part <= budget)
SELECT d.doc_id, d.size, g.source_size, g.target,
    (d.size * (g.whole + CASE WHEN i.full_in THEN 1 ELSE 0 END) + CASE WHEN NOT i.full_in THEN floor(d.size * i.share) ELSE 0 END)::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN i ON d.source IS NOT DISTINCT FROM i.source AND d.hash = i.hash AND d.size > 0
"""
