"""Suffix-array deduplication: remove bytes covered by 200-byte strings that start elsewhere too.

Sorting all suffixes of a corpus together isn't needed to find these strings.
Every 200-byte window picks an anchor, the 32-byte string in it with the
smallest hash, by a rule that reads nothing outside the window. Equal windows
therefore have equal anchors at equal places. A run of windows with the same
anchor is a segment.

1. Segments are counted by (hash of the anchor, hash of the segment). An anchor
   seen once has no repeated window. A segment seen twice is repeated whole.
2. Of anchors with different segments one copy of each segment goes on, with
   its bytes, dealt by anchor, if it agrees with another on one side of the
   anchor as far as every window reaches on one side or the other. Their suffixes are sorted in two stages: suffixes
   smaller than their successors directly, all others by scanning the buckets.
   Windows whose common prefix with a neighbour reaches 200 bytes are repeated.
   Anchors with more than ``HOT`` different segments are first cut in ``PARTS``
   by the anchor's place in the window and dealt by the 179 bytes or more that
   equal windows of a part share, so that no anchor brings all its
   surroundings to one task.
3. Repeated windows come back to their documents, which lose what they cover.

Anchors and segments are told by 64 bits each, 128 together; that two different
segments of one anchor share them is as good as impossible, and their bytes are
not compared again.

Cases: null text counts as empty; texts under 200 bytes stay whole; very long
ones are hashed in chunks of 1 MB; rows that are equal are copies of each other,
and all copies lose what they share; an empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import documents, materialize, slices

SPAN = 200
GRAM = 32
_WINDOW = SPAN - GRAM + 1
#: Bytes sorted together; the segments of one key are never split.
SORTED = 1 << 19
#: Different segments of an anchor above which they are dealt by what surrounds it too.
HOT = 256
#: Parts of a window's length by which such segments are cut.
PARTS = 8

_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = np.uint64(pow(base, filled, 1 << 64))
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * step
        filled += take
    return out


_POW, _POW_INV = _powers(_P, _CHUNK + SPAN), _powers(_INV, _CHUNK + SPAN)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at each place."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POW[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _POW_INV[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every width neighbours: prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window, place of the anchor) of each run of windows with one anchor."""
    keys, firsts, lasts, places, at = [], [], [], [], 0
    while len(data) - at >= SPAN:
        part = np.frombuffer(data, np.uint8, min(_CHUNK, len(data) - at), at)
        h = gram_hashes(part)
        # smallest upper half, then the leftmost
        anchor = (window_minima((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), _WINDOW) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        change = np.nonzero(np.diff(anchor))[0] + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change, [len(anchor)]]) - 1
        keys.append(h[anchor[first]])
        firsts.append(first + at)
        lasts.append(last + at)
        places.append(anchor[first] + at)
        at += len(anchor)
    if not keys:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(lasts), np.concatenate(places)


def suffix_array(texts: list[bytes], depth: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the texts in order of their first `depth` bytes, by two-stage sorting: (starts, which text).

    Places count through all texts laid end to end. A suffix ends with its text.
    """
    joined = b"".join(texts)
    n = len(joined)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends_of = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    data = np.frombuffer(joined, np.uint8)
    last = np.zeros(n, bool)
    last[ends_of[sizes > 0] - 1] = True
    # smaller than its successor: by the next differing byte of its text, if there is one
    differs = np.ones(n, bool)
    differs[:-1] = (data[:-1] != data[1:]) | last[:-1]
    at = np.arange(n)
    jump = np.where(differs, at, n)
    jump = np.minimum.accumulate(jump[::-1])[::-1]
    follows = np.minimum(jump + 1, n - 1)
    rising = ~last[jump] & (data[jump] < data[follows])
    # stage 1: sort these directly
    limit = np.minimum(at + depth, ends_of[owner]) if n else at
    some = np.nonzero(rising)[0].tolist()
    stop = limit.tolist()
    some.sort(key=lambda i: joined[i : stop[i]])
    # stage 2: buckets by first byte; the others stand before the rising ones and are induced from left to right
    counts = np.bincount(data, minlength=256)
    heads = (np.cumsum(counts) - counts).tolist()
    order = [-1] * n
    tail_counts = np.bincount(data[rising], minlength=256)
    tails = np.cumsum(counts) - tail_counts
    some_arr = np.array(some, np.int64)
    if len(some):
        first_byte = data[some_arr]
        rank = np.arange(len(some)) - np.repeat(np.cumsum(tail_counts) - tail_counts, tail_counts)
        for place, i in zip((tails[first_byte] + rank).tolist(), some, strict=True):
            order[place] = i
    induces = np.zeros(n, bool)  # the suffix one to the left belongs to the same text and isn't smaller than this one
    induces[1:] = ~rising[:-1] & ~last[:-1]
    induces = induces.tobytes()
    for e, size in zip(ends_of.tolist(), sizes.tolist(), strict=True):  # the ends of the texts are the smallest suffixes of all
        if size:
            c = joined[e - 1]
            order[heads[c]] = e - 1
            heads[c] += 1
    for i in order:
        if induces[i]:
            c = joined[i - 1]
            order[heads[c]] = i - 1
            heads[c] += 1
    out = np.array(order, np.int64)
    return out, owner[out] if n else owner


def adjacent_lcp(joined: bytes, order: np.ndarray, ends: np.ndarray, depth: int = SPAN, least: int = 0) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, `depth` at most; 0 where one of them is shorter than `least`."""
    data = np.frombuffer(joined, np.uint8)
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b = order[:-1], order[1:]
    most = np.minimum(np.minimum(ends[a] - a, ends[b] - b), depth)
    common, live, step = np.zeros(len(a), np.int64), np.nonzero(most >= least)[0], 0
    while len(live) and step < depth:
        width = min(16 if step < 16 else 184, depth - step)
        cols = np.arange(step, step + width)
        same = padded[a[live, None] + cols] == padded[b[live, None] + cols]
        run = np.where(same.all(axis=1), width, same.argmin(axis=1))
        common[live] += run
        live = live[run == width]
        step += width
    out[1:] = np.minimum(common, most)
    return out


def repeated_windows(texts: list[bytes], depth: int = SPAN) -> list[np.ndarray]:
    """For each text the places at which a string of `depth` bytes starts that starts elsewhere too."""
    joined = b"".join(texts)
    order, owner = suffix_array(texts, depth)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    lcp = adjacent_lcp(joined, order, ends, depth, depth)
    deep = lcp >= depth
    deep[:-1] |= deep[1:]
    hit, who = order[deep], owner[deep]
    sort = np.lexsort((hit, who))
    hit, who = hit[sort], who[sort]
    cuts = np.searchsorted(who, np.arange(len(texts) + 1))
    base = np.cumsum(sizes) - sizes
    return [hit[cuts[k] : cuts[k + 1]] - base[k] for k in range(len(texts))]


#: A window holds so many bytes before its anchor or behind it.
_SIDE = (SPAN - GRAM + 1) // 2


def with_partners(segments_of_anchor: dict[tuple[bytes, int], tuple]) -> list[tuple[bytes, int]]:
    """Of one anchor's segments (bytes, place of the anchor) those that agree with another in all of one side of a window; others have no repeated window."""
    left, right = Counter(), Counter()
    for data, at in segments_of_anchor:
        if at >= _SIDE:
            left[data[at - _SIDE : at]] += 1
        if len(data) - at - GRAM >= _SIDE:
            right[data[at + GRAM : at + GRAM + _SIDE]] += 1
    return [(data, at) for data, at in segments_of_anchor if (at >= _SIDE and left[data[at - _SIDE : at]] > 1) or (len(data) - at - GRAM >= _SIDE and right[data[at + GRAM : at + GRAM + _SIDE]] > 1)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "u", "key", "seg", "first", "last", "anchor"]
    for batch in slices(batches):
        docs, keys, segs, firsts, lasts, places, us = [], [], [], [], [], [], []
        for doc, u, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            key, first, last, place = segments(data)
            if not len(key):
                continue
            h = xxhash.xxh3_64_intdigest
            segs.append(np.fromiter((h(data[a : b + SPAN]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(key)))
            keys.append(key)
            firsts.append(first)
            lasts.append(last)
            places.append(place)
            docs.append(np.full(len(key), doc, np.int64))
            us.append(np.full(len(key), u, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(us)), pa.array(_signed(np.concatenate(keys))), pa.array(_signed(np.concatenate(segs))), pa.array(np.concatenate(firsts).astype(np.int32)), pa.array(np.concatenate(lasts).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))], names=names)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, u, text, wanted) to the bytes of the wanted segments."""
    for batch in slices(batches):
        rows = []
        for doc, u, text, wanted in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("doc", "u", "text", "wanted")), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            rows += [(w["key"], doc, u, w["first"], w["anchor"] - w["first"], w["full"], data[w["first"] : w["last"] + SPAN]) for w in wanted]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["key", "doc", "u", "first", "anchor", "full", "bytes"])


def _cut_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, u, text, wanted) to segments of hot anchors cut by the anchor's place in the window, with keys of their own.

    All windows of a part share the bytes from the latest start of one of them
    to the earliest end; equal windows are of one part and share those bytes, so
    the anchor, the part and those bytes make the new key.
    """
    steps = [k * _WINDOW // PARTS for k in range(PARTS + 1)]
    h = xxhash.xxh3_64_intdigest
    for batch in slices(batches):
        out = [[] for _ in range(7)]
        for doc, u, text, wanted in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("doc", "u", "text", "wanted")), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for w in wanted:
                at = w["anchor"]
                for j in range(PARTS):
                    lo, hi = steps[j], steps[j + 1] - 1
                    first, last = max(w["first"], at - hi), min(w["last"], at - lo)
                    if first <= last:
                        key = h(data[at - lo : at - hi + SPAN], seed=j) ^ (w["key"] & (1 << 64) - 1)
                        for to, x in zip(out, (doc, u, _long(key), _long(h(data[first : last + SPAN])), first, last, at), strict=True):
                            to.append(x)
        kinds = (pa.int64(),) * 4 + (pa.int32(),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc", "u", "key", "seg", "first", "last", "anchor"])


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    if not len(places):
        return []
    cut = np.nonzero(np.diff(places) > 1)[0]
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.concatenate([cut, [len(places) - 1]])].tolist(), strict=True))


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of their anchors to the repeated runs of those that aren't repeated whole."""
    block: list[tuple[bytes, tuple]] = []
    own: dict[tuple[bytes, int], tuple] = {}
    size, last = 0, None

    def close() -> None:
        nonlocal size
        for k in with_partners(own):
            block.append((k[0], own[k]))
            size += len(k[0])
        own.clear()

    def done() -> pa.RecordBatch:
        found = repeated_windows([b for b, _ in block])
        rows = [(doc, u, first + a, first + b + SPAN) for (_, (doc, u, first, full)), places in zip(block, found, strict=True) if not full for a, b in _runs(places)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "u", "from", "to"])

    for batch in batches:
        for key, doc, u, first, anchor, full, data in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("key", "doc", "u", "first", "anchor", "full", "bytes")), strict=True):
            if key != last:
                close()
                if size >= SORTED:
                    yield done()
                    block, size = [], 0
                last = key
            own.setdefault((data, anchor), (doc, u, first, full))
    close()
    if block:
        yield done()


def remove_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    out, at, removed, runs, end = [], 0, 0, 0, -1
    for a, b in sorted(spans):
        if a > end:
            runs += 1
            out.append(data[at:a])
            removed += b - a
            at = end = b
        elif b > end:
            removed += b - end
            at = end = b
    out.append(data[at:])
    return b"".join(out), removed, runs


def _cut(texts: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text, spans in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("doc_id", "text", "spans")), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                left, removed, runs = remove_spans(data, [(s["from"], s["to"]) for s in spans or []])
                rows.append((doc, len(data), removed, runs, hashlib.sha256(left).hexdigest(), left if texts else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            k = 6 if texts else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], kinds[:k], strict=True)], names=names[:k])

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row; kept: the remaining bytes."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = named.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("u"), "text")
    anchors = named.select("doc", "u", "text").mapInArrow(_anchors, "doc long, u long, key long, seg long, first int, last int, anchor int")
    here = lambda side: named.join(side, (F.col("doc") == F.col("_doc")) & (F.col("u") == F.col("_u")), "left")

    def repeats(segs: DataFrame) -> DataFrame:
        """segs (doc, u, key, seg, first, last, anchor) that aren't alone with their key, with full, whether the same segment is there again, and kinds, how many different ones the key has."""
        counts = materialize(segs.groupBy("key", "seg").agg(F.count("*").alias("n")))
        keys = counts.groupBy(F.col("key").alias("_key")).agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where("all > 1")
        state = counts.join(keys, F.col("key") == F.col("_key")).select(F.col("key").alias("_key"), F.col("seg").alias("_seg"), (F.col("n") > 1).alias("full"), "kinds")
        return materialize(segs.join(state, (F.col("key") == F.col("_key")) & (F.col("seg") == F.col("_seg"))).select("doc", "u", "key", "seg", "first", "last", "anchor", "full", "kinds"))

    def of_documents(found: DataFrame) -> DataFrame:
        """One copy of each different segment, collected by document, with the text."""
        pick = F.xxhash64("doc", "u", "first")
        one = found.groupBy(F.col("key").alias("_key"), F.col("seg").alias("_seg")).agg(F.min(pick).alias("_pick"))
        wanted = found.join(one, (F.col("key") == F.col("_key")) & (F.col("seg") == F.col("_seg")) & (pick == F.col("_pick")))
        wanted = wanted.groupBy(F.col("doc").alias("_doc"), F.col("u").alias("_u")).agg(F.collect_list(F.struct("key", "first", "last", "anchor", "full")).alias("wanted"))
        return here(wanted).where("wanted IS NOT NULL").select("doc", "u", "text", "wanted")

    def partly(found: DataFrame) -> DataFrame:
        sliced = of_documents(found).mapInArrow(_slices, "key long, doc long, u long, first int, anchor int, full boolean, bytes binary")
        return sliced.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_blocks, "doc long, u long, from long, to long")

    def wholly(found: DataFrame) -> DataFrame:
        return found.where("full").select("doc", "u", F.col("first").cast("long").alias("from"), (F.col("last") + SPAN).cast("long").alias("to"))

    found = repeats(anchors)
    spans = wholly(found).unionByName(partly(found.where(F.col("kinds").between(2, hot))))
    crowded = found.where(F.col("kinds") > hot)
    if not crowded.isEmpty():
        cut = repeats(of_documents(crowded).mapInArrow(_cut_parts, "doc long, u long, key long, seg long, first int, last int, anchor int"))
        spans = spans.unionByName(wholly(cut)).unionByName(partly(cut.where("kinds > 1")))
    spans = materialize(spans).groupBy(F.col("doc").alias("_doc"), F.col("u").alias("_u")).agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return here(spans).select("doc_id", "text", "spans").mapInArrow(_cut(texts), schema + (", kept binary" if texts else ""))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), texts=False)


#: Every string of SPAN bytes by its digest; bytes are written as two digits each.
ORACLE = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, c, substr(h, 1000 * c + 1, {1000 + 2 * SPAN - 2}) AS part, least(500, n - {SPAN - 1} - 500 * c) AS size FROM (SELECT *, unnest(range(0, (n - {SPAN - 1} + 499) // 500)) AS c FROM d WHERE n >= {SPAN})),
w AS (SELECT doc_id, 500 * c + j AS i, md5(substr(part, 2 * j + 1, {2 * SPAN})) AS k FROM (SELECT *, unnest(range(0, size)) AS j FROM c)),
m AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {SPAN} THEN 0 ELSE 1 END AS new FROM m)),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + {SPAN} AS b FROM g GROUP BY ALL),
e AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM s),
k AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS runs, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
