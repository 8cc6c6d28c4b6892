"""Best-fit packing of token pieces, improved by swap-based local search.

Documents become token pieces of at most 2,048. All that packing depends on is
how many pieces there are of each length, a table of 2,048 counts however large
the corpus. Best fit is run on these counts: a pattern is a multiset of lengths
with the number of sequences filled that way. The local search then works on
pairs of underfull patterns: it moves a piece, exchanges one piece for one, or
two for one, where that increases the sum of squared fills, the emptiest
sequences first, until no exchange helps. Every step acts on all sequences of
both patterns at once. The table of patterns is sent to the workers; it has at
most one row for each step of best fit and search, however many documents
there are.

Pieces then find their place by their rank among the pieces of their length;
ranks are counted in small salted groups, so a length that many pieces share
doesn't meet in one task.

Cases: null or empty text is the one id 0; very long texts are encoded whole and
cut into full pieces, the last one shorter; the string of an added token such
as <|endoftext|> in a text becomes that token's id, as the tokenizer's default
is; repeated rows are packed one by one; pieces of equal length take their
places in order of doc_id, piece and checksum within their salted group; an
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import documents, materialize, slices

LENGTH = 2048
TOKENIZER = "word_bpe_49k.json"
#: Id appended to each document.
END = 0
#: Words kept with their ids in each Python worker.
CACHED_WORDS = 150_000
#: Pieces ranked together.
RANKED = 50_000

_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|\d|[²³¹¼½¾]|(?:[^\w\s²³¹¼½¾]|_)+")
#: Text in which lower(), white space and letters mean to Python what they mean to the tokenizer.
_RARE = "[\x1c-\x1fİɐ-\U0010ffff]"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Texts to little-endian 32-bit ids, equal to the tokenizer's own.

    Merges never cross white space, so the ids of each word are kept and looked
    up again. Texts with rarer characters, or with the string of one of the
    tokenizer's added tokens, go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Text that the tokenizer must see whole.
        self.whole = re.compile("|".join([_RARE, *added]))
        self.model, self.letters, self.words, self.parts = self.tokenizer.model, _byte_letters(), {}, {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            text = part.encode().decode("latin-1").translate(self.letters)
            found = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
            if len(self.parts) < CACHED_WORDS:
                self.parts[part] = found
        return found

    def _word(self, word: str) -> bytes:
        found = b"".join(map(self._part, _PRE.findall(word)))
        if len(self.words) < CACHED_WORDS:
            self.words[word] = found
        return found

    def __call__(self, text: str) -> bytes:
        if self.whole.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, get, out = text.lower().split(), self.words.get, []
        for w in words:
            out.append(get(w) or self._word(w))
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, id_type: pa.DataType):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), END.to_bytes(4, "little")
        for batch in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                for k in range(0, len(ids), 4 * LENGTH):
                    part = ids[k : k + 4 * LENGTH]
                    row.append(i)
                    piece.append(k // (4 * LENGTH))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_pieces(tokenizer_path or public_tokenizers.path(TOKENIZER), pa.int64()), "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], capacity: int = LENGTH) -> Counter[Pattern]:
    """Best fit, longest first, on counts: each step fills all sequences of one pattern alike."""
    room: dict[int, Counter[Pattern]] = defaultdict(Counter)  # open patterns by what is free
    done: Counter[Pattern] = Counter()
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            free = min((r for r in room if r >= size), default=None)
            if free is None:
                per = min(capacity // size, left)
                bins = left // per
                new, free_after = (size,) * per, capacity - size * per
                n, left = bins, left - bins * per
            else:
                pattern, bins = next(iter(room[free].items()))
                n = min(bins, left)
                room[free][pattern] -= n
                if not room[free][pattern]:
                    del room[free][pattern]
                if not room[free]:
                    del room[free]
                new, free_after, left = (*pattern, size), free - size, left - n
            if free_after:
                room[free_after][new] += n
            else:
                done[new] += n
    for patterns in room.values():
        done.update(patterns)
    return done


class _Shape:
    """A pattern's fill and distinct lengths, with bitsets of what it can give: bit x for a piece of x, or for two of x together."""

    def __init__(self, pattern: Pattern) -> None:
        self.fill = sum(pattern)
        self.sizes = sorted(set(pattern))
        self.one = sum(1 << x for x in self.sizes)
        twice = {x for x, n in Counter(pattern).items() if n > 1}
        self.two = 0
        for x in self.sizes:
            others = self.one if x in twice else self.one & ~(1 << x)
            self.two |= others << x

    def parts(self, total: int) -> tuple[int, int]:
        """Two pieces that are `total` together."""
        own = set(self.sizes)
        return next((x, total - x) for x in self.sizes if total - x in own and (self.two >> total) & 1 and x <= total - x)


def _exchange(a: _Shape, b: _Shape, capacity: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What a, the fuller one, gives and gets so that the sum of squared fills grows most; None if nothing helps.

    A move gives nothing for one piece, an exchange one for one or one for two.
    With a the fuller, each gain of a raises the sum.
    """
    free = capacity - a.fill
    room = (1 << free + 1) - 2  # gains from 1 to what is free
    best, gain = None, 0
    for y in (0, *a.sizes):
        for bits in (b.one, b.two) if y else (b.one,):
            found = ((bits >> y) & room).bit_length() - 1
            if found > gain:
                best, gain = (y, found + y, bits is b.two), found
        if gain == free:
            break
    if best is None:
        return None
    y, total, two = best
    return (y,) if y else (), b.parts(total) if two else (total,)


def local_search(patterns: Counter[Pattern], capacity: int = LENGTH) -> Counter[Pattern]:
    """Exchanges between underfull sequences until none is left that raises the sum of squared fills.

    Ends by itself: the sum is a whole number, grows with every exchange and is
    bounded by capacity times the pieces' total. Each two patterns are looked
    at once, as they never change; an exchange acts on as many of their
    sequences as both have and gives other patterns.
    """
    now = Counter({tuple(sorted(p, reverse=True)): n for p, n in patterns.items() if n})
    shapes: dict[Pattern, _Shape] = {}
    vain: set[tuple[Pattern, Pattern]] = set()
    changed = True
    while changed:
        changed = False
        for p in now:
            if p not in shapes:
                shapes[p] = _Shape(p)
        open_ = sorted((p for p in now if shapes[p].fill < capacity), key=lambda p: (shapes[p].fill, p))
        for b in open_:  # the emptiest first
            for a in reversed(open_):
                if not now[b] or shapes[a].fill < shapes[b].fill:
                    break
                n = min(now[a], now[b]) if a != b else now[a] // 2
                if not n or (a, b) in vain:
                    continue
                swap = _exchange(shapes[a], shapes[b], capacity)
                if swap is None:
                    vain.add((a, b))
                    continue
                changed = True
                given, got = map(Counter, swap)
                now[a] -= n
                now[b] -= n
                for p in (Counter(a) - given + got, Counter(b) - got + given):
                    if p:
                        now[tuple(sorted(p.elements(), reverse=True))] += n
        now = Counter({p: n for p, n in now.items() if n})
    return now


def slots(patterns: Counter[Pattern]) -> dict[str, np.ndarray]:
    """For each length and pattern the ranks that go there: first rank, pieces a sequence, first sequence, first offset."""
    rows, base, used = [], 0, Counter()
    for pattern, n in sorted(patterns.items()):
        offset = 0
        for size, each in sorted(Counter(pattern).items(), reverse=True):
            rows.append((size, used[size], each, base, offset))
            used[size] += each * n
            offset += each * size
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "rank", "each", "base", "offset"))}


def _placed(shared):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        key = t["length"] << 48 | t["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(key, length << 48 | rank, side="right") - 1
            over = rank - t["rank"][at]
            sequence, offset = t["base"][at] + over // t["each"][at], t["offset"][at] + over % t["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return placed


def pack(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of docs."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer_path))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # LENGTH rows at most
    salts = max(1, sum(counts.values()) // RANKED)
    shared = spark.sparkContext.broadcast(slots(local_search(best_fit(counts))))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    per = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    first = per.select(F.col("length").alias("_l"), F.col("salt").alias("_s"), before.alias("first"))
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(first, (F.col("length") == F.col("_l")) & (F.col("salt") == F.col("_s")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("own")).cast("long").alias("rank"))
    return ranked.mapInArrow(_placed(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


__all__ = ["best_fit", "encoder", "local_search", "op7_best_fit_packing", "pack", "slots", "token_pieces"]
