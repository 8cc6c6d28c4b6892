"""Quality classifier by importance resampling.

Two generative models over hashed word and word-pair n-grams are counted: one
of target text (documents labelled good), one of all raw text. A document's log weight is
the log likelihood ratio of its n-grams, the sum over all of them; for one of
more than ``LENGTH`` n-grams it is that of ``LENGTH`` of them at its mean, so
that a long text counts as a sample of that size. Raw text is mostly target
text, which shifts every ratio a n-gram by the same amount; the cut that best
separates labelled good from bad documents is that amount and is taken off.

Gumbel noise, drawn from a hash of the document, is added to the log weight and
the k largest keys are kept: a sample of k without replacement in proportion to
the weights. ``keep`` gives k, as a number or a share of the documents with
n-grams; without it k is the number of documents that the target model explains
better (a log weight of 0 or more). Noise decides among documents whose texts
say little, short ones above all.

The k-th largest key is found from histograms of the key's bits, most
significant first, so rows are never sorted.

Bounds: at most ``fit_rows`` labelled rows, those with the smallest hashed ids,
are read to mark the target text; raw text is counted over every document. The
model has ``BUCKETS`` counts, whatever the input.

Cases: null, empty or blank text has no n-grams, weight 0, and is rejected;
very long texts count whole in the models and by their mean in the weight;
labels that are null, repeated or of unknown documents are harmless (a document
is good if any of its labels says so); without labels of both kinds nothing is
taken off and, unless ``keep`` says otherwise, everything with n-grams is kept.
Rows that share id and text get the same noise, and rows of equal keys at the
k-th place are all kept. Extra columns are kept and never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import documents, fresh, materialize, slices

BUCKETS = 1 << 16
FIT_ROWS = 50_000
SMOOTH = 4.0
#: N-grams that a text's weight counts at most.
LENGTH = 1000
SEED = 17

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Token to 64-bit hash; stops growing at a bound."""

    def __missing__(self, token: str) -> int:
        h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        if len(self) < 100_000:
            self[token] = h
        return h


_hashes = _Hashes()


def ngram_buckets(text: str | None) -> np.ndarray:
    """The bucket of every word and word pair of the lower-cased text."""
    tokens = _TOKEN.findall((text or "").lower())
    one = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    two = (one[:-1] * _P + one[1:]) * _P
    return (np.concatenate([one, two]) >> np.uint64(48)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in slices(batches):
        for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = np.bincount(ngram_buckets(text), minlength=BUCKETS) if len(text or "") > 50_000 else None
            if found is not None:
                raw += found
                if good:
                    target += found
            else:
                b = ngram_buckets(text)
                np.add.at(raw, b, 1)
                if good:
                    np.add.at(target, b, 1)
    at = np.nonzero(raw)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """The log ratio of each bucket, target over raw scaled to the target's size, both smoothed by SMOOTH counts."""
    best = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good")).where("good IS NOT NULL")
    some = best.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select(F.col("doc_id").alias("_doc"), (F.col("good") > 0).alias("_good"))
    marked = docs.join(F.broadcast(some), docs["doc_id"] == some["_doc"], "left").select("text", "_good")  # fit_rows bounds the broadcast
    sums = marked.mapInArrow(_counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in sums.collect():  # BUCKETS rows at most
        raw[bucket] += r
        target[bucket] += t
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log((target + SMOOTH) / (expected + SMOOTH))


def score(docs: DataFrame, ratios: np.ndarray, columns: list[str], seed: int = SEED, names: tuple[str, str, str] = ("n_grams", "mean_ratio", "noise")) -> DataFrame:
    """columns of docs and, under these names, the number of n-grams, their mean log ratio (0 without any) and the document's Gumbel noise."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    schema = docs.select(*columns).schema.add(names[0], "long").add(names[1], "double").add(names[2], "double")

    more = [c for c in ("doc_id", "text") if c not in columns]  # no text travels twice
    width, (doc_at, text_at) = len(columns), ([*columns, *more].index(c) for c in ("doc_id", "text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in slices(batches):
            n, mean, noise = [], [], []
            for doc, text in zip(batch.column(doc_at).to_pylist(), batch.column(text_at).to_pylist(), strict=True):
                b = ngram_buckets(text)
                n.append(len(b))
                mean.append(float(ratio[b].mean()) if len(b) else 0.0)
                u = (xxhash.xxh3_64_intdigest(f"{doc}\x1f{text}".encode("utf-8", "surrogatepass"), seed=seed) + 0.5) / 2**64
                noise.append(-float(np.log(-np.log(min(u, 1 - 1e-16)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(n, pa.int64()), pa.array(mean, pa.float64()), pa.array(noise, pa.float64())], names=schema.names)

    return docs.select(*columns, *more).mapInArrow(scored, schema)


def log_weight(n_grams: Column, mean_ratio: Column, cut: float) -> Column:
    return F.least(n_grams, F.lit(LENGTH)) * (mean_ratio - F.lit(cut))


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest double, by histograms of 16 bits at a time; null if there are fewer than k values."""
    ordered = _ordered(F.col(column))
    rows, prefix, left = values.where(F.col(column).isNotNull()).select(ordered.alias("o"), F.col(column).alias("v")), None, k
    for shift in (48, 32, 16, 0):
        inside = rows if prefix is None else rows.where(F.shiftright("o", shift + 16) == prefix)
        found = inside.groupBy(F.shiftright("o", shift).alias("b")).agg(F.count("*").alias("n"), F.max("v").alias("v"))
        above = F.sum("n").over(W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, 0))  # 65,536 rows at most
        hit = found.withColumn("upto", above).where(F.col("upto") >= left).orderBy("upto").first()
        if hit is None:
            return None
        prefix, left = hit["b"], left - (hit["upto"] - hit["n"])
    return hit["v"]


def _ordered(c):
    """A long that sorts as the double does: fixed point with 23 fraction bits, enough to tell keys apart; ties share it."""
    return F.round(F.greatest(F.least(c, F.lit(5e11)), F.lit(-5e11)) * F.lit(float(1 << 23))).cast("bigint")


def best_cut(scores: DataFrame, labels: DataFrame) -> float | None:
    """The mean ratio that best separates labelled good from bad documents (balanced accuracy), to 1/64."""
    mean = F.col("mean_ratio")
    best = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good")).where("good IS NOT NULL")
    step = F.floor(F.greatest(F.least(mean, F.lit(20.0)), F.lit(-20.0)) * 64).cast("long")
    rows = scores.where("n_grams > 0").join(best, "doc_id").groupBy(step.alias("step")).agg(F.count_if(F.col("good") > 0).alias("good"), F.count_if(F.col("good") <= 0).alias("bad")).collect()  # 2,561 rows at most
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return None
    below_good = below_bad = 0
    best_at = (-1.0, 0.0, None)
    by_step = sorted(rows, key=lambda r: r["step"])
    for i, r in enumerate(by_step):
        # a cut at this step's lower edge; of a run of equal cuts the middle of the gap below it
        gap = (r["step"] - by_step[i - 1]["step"]) if i else 0
        best_at = max(best_at, (below_bad / bad + 1 - below_good / good, gap, (r["step"] - gap / 2 + (0.5 if gap else 0)) / 64), key=lambda x: x[:2])
        below_good, below_bad = below_good + r["good"], below_bad + r["bad"]
    return best_at[2]


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, fit_rows: int = FIT_ROWS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents that are kept with all their columns, narrow scores of every row with kept and by_weight).

    by_weight: whether the row would be kept without noise.
    """
    ratios = fit(docs, labels, fit_rows)
    plain = materialize(score(docs, ratios, ["doc_id"], seed))
    cut = best_cut(plain, labels)
    weight = lambda n, mean: log_weight(F.col(n), F.col(mean), cut or 0.0)
    narrow = plain.where("n_grams > 0").select(weight("n_grams", "mean_ratio").alias("w"), (weight("n_grams", "mean_ratio") + F.col("noise")).alias("key"))
    n, positive = narrow.agg(F.count("*"), F.count_if(F.col("w") >= 0)).first()
    k = (n if cut is None else positive) if keep is None else min(n, round(keep * n) if isinstance(keep, float) else keep)
    least, least_weight = (kth_largest(narrow, c, k) if k else None for c in ("key", "w"))
    enough = lambda size, value, bound: F.lit(False) if bound is None else (F.col(size) > 0) & (_ordered(value) >= _ordered(F.lit(bound)))
    own = tuple(fresh(docs, f"_{c}") for c in ("n_grams", "mean_ratio", "noise"))
    kept = score(docs, ratios, docs.columns, seed, own).where(enough(own[0], weight(own[0], own[1]) + F.col(own[2]), least)).select(*docs.columns)
    w = weight("n_grams", "mean_ratio")
    key = F.when(F.col("n_grams") > 0, w + F.col("noise"))
    return kept, plain.select("doc_id", "n_grams", w.alias("log_weight"), key.alias("key"), enough("n_grams", w + F.col("noise"), least).alias("kept"), enough("n_grams", w, least_weight).alias("by_weight"))


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))[1]
