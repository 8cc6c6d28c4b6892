"""MinHash near-duplicate detection with odd sketches.

1. Each document's set of five-word shingles becomes 512 MinHash samples. The
   first ones form bands of 6; all 512 are folded into a 2,048-bit parity
   bitmap, the odd sketch.
2. Documents with the same set form a class; only its smallest doc_id goes on.
3. Candidates share a band. They come in rounds, so that a group of copies
   never gives all its pairs: each document with the smallest of its bucket in
   the first 4 bands; then, in all bands but only in buckets that still hold
   several components, with the first of the bucket; then with the most alike
   one of another component there; then what is left between different
   components. No pair is tested twice.
4. XOR population counts of the sketches estimate the Jaccard similarity and
   drop candidates far below the threshold; all others are confirmed on full
   sets. Links never rest on an estimate.

A pair at the threshold t shares none of n bands with a probability of
(1 - t ** 6) ** n; n follows from t so that this is under 3e-7: 32 bands at
0.85, 50 at 0.80.

Cases: null, empty or blank text has no shingles and links with nothing; with
fewer words than five the whole sequence is the one shingle; rows that share a
doc_id count as one document and share its component; a null doc_id links with
nothing, has a null component and is kept. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import documents, materialize, slices

SHINGLE = 5
SAMPLES, ROWS = 512, 6
#: Bands of the first round.
FIRST_BANDS = 4
SKETCH_BITS = 2048
#: Members of a bucket that are compared with as many others in one task.
BLOCK = 4096
#: Bits of the filter of documents whose texts are compared: for each of them, and at most. With fewer for each, more texts reach the join, which drops them.
FILTER_BITS, FILTER_MOST = 16, 1 << 26
#: Links need 100 * intersection >= threshold * union; this is op2's threshold.
THRESHOLD = 85
#: A pair at the threshold shares no band with at most this probability.
BAND_MISS = 3e-7
#: Candidates whose estimate is so many standard deviations below the threshold are dropped.
ERRORS = 4.7

_RNG = np.random.default_rng(20240601)
_A = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_SLOT = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_hashes(text: str | bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. bytes.lower() changes A-Z alone, bytes.split() splits at ASCII white space alone."""
    h = xxhash.xxh3_64_intdigest
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = np.array([h(w) for w in raw.lower().split()], dtype=np.uint64)
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    out = words[: len(words) - width + 1].copy()
    for k in range(1, width):
        out *= _P
        out += words[k : len(words) - width + 1 + k]
    out ^= out >> np.uint64(29)
    out *= _M
    out ^= out >> np.uint64(32)
    return np.unique(out)


def minhash(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 512):
        part = _A[:, None] * x[None, k : k + 512]
        part += _B[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> bytes:
    """Each sample flips the bit that its index and value hash to."""
    v = (samples ^ _SLOT) * np.uint32(0x85EBCA6B)
    v ^= v >> np.uint32(13)
    v = v * np.uint32(0xC2B2AE35)
    bits = (np.bincount(v >> np.uint32(21), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).tobytes()


def estimate(xor_counts: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of differing sketch bits."""
    share = np.minimum(2.0 * xor_counts / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4.0 * SAMPLES) * np.log1p(-share)


def n_bands(threshold: int) -> int:
    return math.ceil(math.log(BAND_MISS) / math.log1p(-((threshold / 100) ** ROWS)))


def deviation(t: float) -> float:
    """Standard deviation of a sketch's estimate at similarity t: of the samples that agree, and of the bits that as many flips leave odd."""
    flips = 2 * SAMPLES * (1 - t)
    even = math.exp(-2 * flips / SKETCH_BITS)
    bits = SKETCH_BITS / 4 * (1 - even**2) - flips * even**2
    return math.sqrt(t * (1 - t) / SAMPLES + bits / (2 * SAMPLES * even) ** 2)


def max_xor(threshold: int) -> int:
    """Differing bits up to which a candidate is confirmed on full sets."""
    t, counts = threshold / 100, np.arange(SKETCH_BITS // 2)
    return int(counts[estimate(counts) >= t - ERRORS * deviation(t)].max())


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _signatures(n: int):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, s1, s2, bands, sketches = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text)
                sizes.append(len(hashes))
                if not len(hashes):
                    for to in (s1, s2, bands, sketches):
                        to.append(None)
                    continue
                whole = xxhash.xxh3_128_intdigest(hashes.tobytes())
                s1.append(_long(whole >> 64))
                s2.append(_long(whole & (1 << 64) - 1))
                samples = minhash(hashes)
                bands.append([_long(xxhash.xxh3_64_intdigest(samples[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k)) for k in range(n)])
                sketches.append(odd_sketch(samples))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"])

    return signatures


def _places(node: str, bits: int) -> list[Column]:
    """A node's two places in a filter of so many bits, a power of two."""
    h = F.xxhash64(node)
    return [h.bitwiseAND(bits - 1), F.shiftright(h, 32).bitwiseAND(bits - 1)]


def _filter_of(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of distinct nodes, as 64-bit words: all of them pass, and about one of 70 others up to FILTER_MOST bits."""
    bits = min(1 << max(10, (FILTER_BITS * nodes.count()).bit_length()), FILTER_MOST)
    at = nodes.select(F.explode(F.array(*_places("node", bits))).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[found.column("word").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
    return words


def _packed(wanted: np.ndarray):
    """(doc_id, text, place, place) to whole texts, compressed: a third of what their sets of hashes take in a shuffle. Only those that pass the filter."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            one, two = (batch.column(k).to_numpy() for k in (2, 3))
            keep = (wanted[one >> 6] >> (one & 63).astype(np.uint64)) & (wanted[two >> 6] >> (two & 63).astype(np.uint64)) & np.uint64(1)
            batch = batch.select([0, 1]).filter(pa.array(keep.astype(bool)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "body"])

    return packed


def _confirmed(threshold: int):
    """(a, b, body_a, body_b) to the (a, b) that are linked. One side repeats in runs, so its last set is kept."""

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last: dict[int, tuple[bytes, np.ndarray]] = {}

        def full(side: int, body: bytes) -> np.ndarray:
            if side not in last or last[side][0] != body:
                last[side] = body, shingle_hashes(unpack(body))
            return last[side][1]

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = full(0, x), full(1, y)
                if 100 * min(len(p), len(q)) < threshold * max(len(p), len(q)):
                    keep.append(False)
                    continue
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(100 * both >= threshold * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return confirmed


def confirm(pairs: DataFrame, sketches: DataFrame, bodies: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Distinct candidate pairs (a, b) to links: by sketch, then on full sets."""
    one, two = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("p")), sketches.select(F.col("node").alias("b"), F.col("sketch").alias("q"))
    near = pairs.join(one, "a").join(two, "b").mapInArrow(_near(max_xor(threshold)), "a long, b long")
    x, y = bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), bodies.select(F.col("node").alias("b"), F.col("body").alias("y"))
    return near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirmed(threshold), "a long, b long")


def _near(most: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.select(["a", "b", "p", "q"])
            if batch.num_rows:
                p, q = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(np.bitwise_count(p ^ q).sum(axis=1) <= most))

    return near


def _between(best: bool, most: int):
    """Pairs of two blocks of a bucket, or within one, between different components: the nearest of each member outside the bucket's largest component, or all within `most` differing bits.

    A pair between two components has a member outside the largest one, so that
    one's members are compared with the others but never with each other. All
    within `most`: in the first of the buckets that the two share, no other.
    """

    def pairs(table: pa.Table) -> pa.Table:
        node, comp = (table.column(k).to_numpy() for k in ("node", "comp"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        key = table.column("key")[0].as_py() if len(node) else 0
        band = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        names, counts = np.unique(comp, return_counts=True)
        rest = np.flatnonzero(comp != names[counts.argmax()])
        block = table.column("block").to_numpy()
        across = len(node) > 0 and table.column("p")[0].as_py() != table.column("q")[0].as_py()
        a, b = [], []
        for i in range(0, len(rest), 512):
            own = rest[i : i + 512]
            near_d, near_j = np.full(len(own), most + 1), np.zeros(len(own), np.int64)
            for j in range(0, len(node), 2048):
                d = np.bitwise_count(sketch[own, None] ^ sketch[None, j : j + 2048]).sum(axis=2, dtype=np.int64)
                d[comp[own, None] == comp[None, j : j + 2048]] = most + 1
                if across:  # each block alone is another task's
                    d[block[own, None] == block[None, j : j + 2048]] = most + 1
                if best:
                    k = d.argmin(axis=1)
                    v = d[np.arange(len(k)), k]
                    near_j = np.where(v < near_d, k + j, near_j)
                    near_d = np.minimum(near_d, v)
                else:
                    p, q = np.nonzero(d <= most)
                    for k in range(0, len(p), 1 << 16):
                        x, y = own[p[k : k + (1 << 16)]], q[k : k + (1 << 16)] + j
                        here = band[x, (band[x] == band[y]).argmax(axis=1)] == key
                        a.append(node[x[here]])
                        b.append(node[y[here]])
            if best:
                ok = near_d <= most
                a.append(node[own[ok]])
                b.append(node[near_j[ok]])
        a, b = (np.concatenate(x) if x else node[:0] for x in (a, b))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        two = np.unique(np.stack([lo, hi], 1)[lo != hi], axis=0)
        return pa.table({"a": pa.array(two[:, 0], pa.int64()), "b": pa.array(two[:, 1], pa.int64())})

    return pairs


def components(links: DataFrame) -> DataFrame:
    """(node, comp) with the smallest node of each component, for the nodes that have links.

    Alternating large and small stars: each round hangs every node's larger
    neighbours, then its smaller ones, on its smallest. No round collects a
    neighbourhood; every step is an aggregate and a join.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct()
        edges = materialize(small)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.countDistinct("u")).first()
        if last == now:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
        last = now


def _ends(member: DataFrame) -> DataFrame:
    """(key, lo, n) of the buckets that hold several components, with their first member and their size."""
    return member.groupBy("key").agg(F.min(F.struct("comp", "node")).alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo.comp < hi").select("key", "lo", "n")


def _open(nodes: DataFrame) -> DataFrame:
    """(key, node, comp, lo, n) of the buckets that hold several components; lo is the (comp, node) that comes first, n their size."""
    member = nodes.select("node", "comp", F.explode("bands").alias("key"))
    return member.join(_ends(member), "key").select("key", "node", "comp", "lo", "n")


def _with_first(open_: DataFrame) -> DataFrame:
    """Each member with its bucket's first, where their components differ."""
    return open_.where("comp <> lo.comp").select(F.least("node", "lo.node").alias("a"), F.greatest("node", "lo.node").alias("b")).distinct()


def _in_buckets(open_: DataFrame, sketches: DataFrame, best: bool, threshold: int) -> DataFrame:
    """Pairs within buckets. A bucket is dealt out as blocks of about BLOCK members, each two of them a task's group, so that no task holds a whole large one."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = open_.select("key", "node", "comp", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("key", "node", "comp", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")).join(sketches, "node")
    return dealt.select("key", "p", "q", "block", "node", "comp", "bands", "sketch").groupBy("key", "p", "q").applyInArrow(_between(best, max_xor(threshold)), "a long, b long").distinct()


def _bodies(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The packed texts of the documents in pairs. Few documents are, so that the others are left out before the join deals the texts."""
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    wanted = _filter_of(nodes)
    packed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", *[c.alias(f"at{k}") for k, c in enumerate(_places("doc_id", 64 * len(wanted)))]).mapInArrow(_packed(wanted), "node long, body binary")
    return materialize(packed.join(nodes, "node").select("node", "body").distinct())  # distinct where the join has dealt them


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(own.mapInArrow(_signatures(n_bands(threshold)), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"))
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
    nodes = materialize(usable.join(classes.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "node"), (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("doc_id") == F.col("node"))).select("node", "bands", "sketch").dropDuplicates(["node"]))
    # A few bands first: they link most of a group, so that the others hold little that isn't yet in one component.
    few = _open(nodes.select("node", F.slice("bands", 1, FIRST_BANDS).alias("bands"), F.col("node").alias("comp")))
    tested = materialize(_with_first(few))
    bodies = _bodies(own, tested)
    links = materialize(confirm(tested, nodes, bodies, threshold))
    comp = components(links)

    member = materialize(_open(nodes.select("node", "bands").join(comp, "node", "left").select("node", "bands", F.coalesce("comp", "node").alias("comp"))))
    sketches = materialize(nodes.select("node", "bands", "sketch").join(member.select("node").distinct(), "node"))
    bodies = _bodies(own, sketches.select(F.col("node").alias("a"), F.col("node").alias("b")))
    for pick in (_with_first, lambda now: _in_buckets(now, sketches, True, threshold), lambda now: _in_buckets(now, sketches, False, threshold)):
        now = member.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
        pairs = materialize(pick(now.join(_ends(now), "key")).join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionByName(pairs)
        links = materialize(links.union(confirm(pairs, sketches, bodies, threshold)))
        comp = components(links)

    of = signed.join(classes.select("s1", "s2", "node"), ["s1", "s2"], "left").join(comp, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "node", "doc_id"))
    return of.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


#: Every two documents that share a shingle, and all that each can reach.
ORACLE = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(sh) AS sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {THRESHOLD} * (a.n + b.n - c)),
t AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (SELECT x, y FROM t UNION SELECT r.doc_id, t.y FROM r JOIN t ON t.x = r.other),
m AS (SELECT doc_id, least(doc_id, min(other)) AS component FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""


def without_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs without the rows that aren't kept. All columns stay."""
    gone = near_duplicates(docs, threshold=threshold).where("NOT kept").select(F.col("doc_id").alias("_doc")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_doc"], "left_anti")
