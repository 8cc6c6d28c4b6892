"""Document fingerprints by consistent weighted sampling.

A text's terms are its lower-cased words, weighted by their number. For each of
64 samples every term gets r and c from Gamma(2, 1) and a uniform b, all drawn
from the term's hash; with t = floor(ln weight / r + b) the sample is the term
and t for which ln c - r * (t - b) - r is least. Two texts then agree in a
sample with a probability of their generalised Jaccard similarity, the sum of
smaller over the sum of larger weights.

Draws come from tables of exponential and uniform variates, indexed by
independent parts of the hash: two exponentials make Gamma(2, 1).

Cases: null text counts as empty; a text without words has a fingerprint of its
own, alike to others without words (1) and to none with words (0); equal texts
have equal fingerprints; documents that share a doc_id follow each other by
text; a null doc_id comes last in descending order; a single document is its
own next. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import documents

SAMPLES = 64
#: Text of one range of documents.
BUCKET_BYTES = 16 << 20
_ROWS = 1 << 10
_RNG = np.random.default_rng(424242)
_EXP = _RNG.exponential(size=(4, _ROWS, SAMPLES)).astype(np.float32)
_UNI = _RNG.random(size=(2, _ROWS, SAMPLES)).astype(np.float32)
_MIX = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64) | np.uint64(1)
#: Fingerprint of a text without words.
EMPTY = np.zeros(SAMPLES, np.uint32)


class _Hashes(dict):
    """Word to 64-bit hash; stops growing at a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 400_000:
            self[word] = h
        return h


_hashes = _Hashes()


def weighted_terms(text: str) -> Counter:
    return Counter(text.lower().encode("utf-8", "surrogatepass").split())


def fingerprint(terms: Counter) -> np.ndarray:
    """SAMPLES 32-bit codes of the sampled (term, t)."""
    if not terms:
        return EMPTY
    h = np.fromiter(map(_hashes.__getitem__, terms), np.uint64, len(terms))
    log_weight = np.log(np.fromiter(terms.values(), np.float32, len(terms)))[:, None]
    least, code = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    for k in range(0, len(h), 512):
        part = h[k : k + 512]
        i = [((part >> np.uint64(10 * j)) & np.uint64(_ROWS - 1)).astype(np.int64) for j in range(6)]
        r = _EXP[0][i[0]]
        r += _EXP[1][i[1]]
        c = _EXP[2][i[2]]
        c += _EXP[3][i[3]]
        b = _UNI[0][i[4]]
        b += _UNI[1][i[5]]
        b -= b >= 1
        t = np.floor(log_weight[k : k + 512] / r + b)
        a = np.log(c)
        a -= r * (t - b + 1)
        at = a.argmin(axis=0)
        cols = np.arange(SAMPLES)
        won, value = a[at, cols], (part[at] ^ (t[at, cols].astype(np.int64).view(np.uint64) << np.uint64(40))) * _MIX
        lower = won < least
        least, code = np.where(lower, won, least), np.where(lower, value, code)
    out = (code >> np.uint64(32)).astype(np.uint32)
    return np.where(out == 0, np.uint32(1), out)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of samples that agree: an estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the first code points of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket in order, the last one a copy of the next bucket's first; each row meets the one after it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    last = None
    for batch in batches:
        out = []
        for bucket, doc, text in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("bucket", "doc_id", "text")), strict=True):
            text = text or ""
            now = (bucket, doc, text, fingerprint(weighted_terms(text)))
            if last is not None and last[0] == bucket:
                changed = edited(last[2], text)
                mark = fingerprint(weighted_terms(changed))
                out.append((last[1], len(last[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), last[3].tobytes().hex(), mark.tobytes().hex(), likeness(last[3], mark), likeness(last[3], now[3])))
            last = now
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) if out else [[]] * 7, schema.types, strict=True)], schema=schema)


def _bucket(cuts: list[int]) -> Column:
    """The number of cuts that are not below doc_id. Cuts descend; first their groups are looked at, then one group."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    whole = F.size(F.filter(F.lit([g[-1] for g in groups]), lambda p: F.col("doc_id") <= p))
    inside = F.coalesce(F.get(F.array(*[F.lit(g) for g in groups]), whole), F.array().cast("array<bigint>"))
    return whole * width + F.size(F.filter(inside, lambda p: F.col("doc_id") <= p))


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Rows are dealt by ranges of doc_id, in descending order, each range a task
    of about ``bucket_bytes`` of text; the first row of each range is also sent,
    once, to the end of the range before it. Rows with a null doc_id, and rows
    that share one, stay together.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = size // bucket_bytes + 1
    points = own.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], max(10_000, 10 * buckets)).alias("p")).first()["p"] if buckets > 1 else []
    cuts = sorted(set(points or []), reverse=True)
    # bucket 0 has the largest ids; null ids go to the last one
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(_bucket(cuts))
    order = F.struct(F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1)).alias("o"), F.coalesce("text", F.lit("")).alias("t"))
    dealt = own.withColumn("bucket", bucket.cast("int")).withColumn("end", F.lit(0))
    firsts = dealt.groupBy("bucket").agg(F.max("doc_id").alias("_top"), F.count("*").alias("_n")).collect()  # one row a bucket
    there = sorted((r["bucket"], r["_top"]) for r in firsts)
    if not there:
        return dealt.mapInArrow(_streamed, _SCHEMA)
    before = {b: there[k - 1][0] for k, (b, _) in enumerate(there)}  # the first follows the last
    tops = [(b, t, before[b]) for b, t in there]
    table = spark.createDataFrame(tops, "b int, top long, goes int")
    ahead = dealt.join(F.broadcast(table), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("top")))
    ahead = ahead.groupBy("b", "goes").agg(F.min(order).alias("m"), F.first("doc_id").alias("doc_id")).select("doc_id", F.col("m.t").alias("text"), F.col("goes").alias("bucket"), F.lit(1).alias("end"))
    both = dealt.unionByName(ahead).withColumn("_order", F.when(F.col("end") == 1, F.lit((1 << 63) - 1)).otherwise(F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 2))))
    sorted_ = both.repartitionById(max(b for b, _ in there) + 1, "bucket").sortWithinPartitions("bucket", "end", "_order", "text")
    return sorted_.select("bucket", "doc_id", "text").mapInArrow(_streamed, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op9_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_next(documents(spark, sf_dir))
