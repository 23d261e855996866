"""Removal of repeated passages by overlapping windows of three lines.

Every run of `lines` consecutive non-empty lines is hashed. Windows that occur more than once anywhere in the table stay
in their first place (smallest doc_id, then place) and go everywhere else; a line goes if any such later window covers
it. Only hashes and places are shuffled to find them, with a minimum by hash combined before the shuffle; then the
covered places of each document meet its text in one join by id.

Null texts stay null. Documents of fewer than `lines` non-empty lines are left as they are. Empty lines count neither as
lines nor as breaks, and stay. A line repeated in a row keeps its first. Rows that repeat id and text count as one
occurrence. Null ids come first.

`without_passages` also finds runs of `words` words wherever they begin and end, whatever the white space between them. The
least hash of the shorter runs inside such a run is its anchor; runs in a row of one anchor make a segment, about one for 18
words. Equal runs have equal anchors, so a run is repeated only in equal segments, or where one anchor has different segments
(or occurs twice in one). Segments are compared first, by one hash each; single runs are compared only within the first
occurrences of the segments whose anchors have several. Nothing is left out by that: a run's first place lies in its segment's
first place. Three bitmaps of fixed size without false negatives say in the second pass which segments these are; where they
fill up, more rows are compared, at most one for each run of words, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .bytewords import NEWLINE, SPACE, Pieces, chunks, mix
from .shared import bitmap, forget, has, stored

_RATE = 0x9E3779B97F4A7C15
_BACK = pow(_RATE, -1, 2**64)
#: What a null id counts as, since null ids come first.
_FIRST = -(2**63)


def _windows(lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, texts in chunks(batch.column(2)):
                p = Pieces(texts, NEWLINE, None)
                h, doc, at = p.windows(lines, short=False)
                breaks = np.cumsum(NEWLINE[p.raw])
                line = breaks[p.start] - breaks[np.maximum(p.doc_start[p.doc] - 1, 0)] * (p.doc_start[p.doc] > 0)
                places = np.stack([line[at + j] for j in range(lines)], 1) if len(at) else np.zeros((0, lines), np.int64)
                rows = pa.array(doc + base)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * lines, pa.int32()), pa.array(places.ravel().astype(np.int32)))],
                    ["id", "key", "hash", "places"],
                )

    return run


def without_repeats(documents: DataFrame, lines: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `documents`, `text_col` without later occurrences, and `n_lines` and `n_removed` (longs; they replace columns of these names)."""
    key = F.xxhash64(F.col(text_col))
    docs = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(text_col).cast("string").alias("text"))
    windows = docs.mapInArrow(_windows(lines), "id long, key long, hash long, places array<int>")
    place = F.struct("id", "key", F.element_at("places", 1).alias("at"))
    first = windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    later = windows.join(first, "hash").where(place > F.col("first"))
    covered = later.select("id", "key", F.explode("places").alias("place")).groupBy("id", "key").agg(F.collect_set("place").alias("gone"))
    # input columns travel in one struct, so no name of theirs can clash
    rows = documents.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.col(text_col)).alias("own_key"), F.split(F.col(text_col).cast("string"), "\n").alias("parts"))
    joined = rows.join(covered, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))  # by hashing: linear in the lines
    kept = F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n")
    own = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    value = lambda c: F.col("row").getField(c)
    return joined.select(
        *(F.when(F.col("gone").isNull(), value(c)).otherwise(kept).alias(c) if c == text_col else value(c).alias(c) for c in own),
        F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k pieces, as differences of one polynomial's prefix sums modulo 2**64."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = (np.cumprod(np.full(n, x, np.uint64)) for x in (_RATE, _BACK))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def _sliding(pick, x: np.ndarray, width: int) -> np.ndarray:
    """`pick` (np.minimum or np.maximum) of every `width` values in a row."""
    out, size = x, 1
    while 2 * size <= width:
        out, size = pick(out[:-size], out[size:]), 2 * size
    return pick(out[: len(x) - width + 1], out[width - size :])


class _Segments:
    """The runs of `words` words in some texts, by segments: of each, its first run (`at`) and last, its hash, and its anchor's."""

    def __init__(self, p: Pieces, words: int):
        short = max(1, words // 3)
        width, n = words - short + 1, max(0, len(p.hash) - words + 1)
        own = np.flatnonzero(p.doc[:n] == p.doc[len(p.doc) - n :])
        if not len(own):
            self.at = self.last = np.zeros(0, np.int64)
            self.hash = self.anchor = np.zeros(0, np.uint64)
            return
        grams = _runs(p.hash, short)
        inside = np.zeros(n, bool)
        inside[own] = True
        least = _sliding(np.minimum, grams, width)
        new = np.append(True, (np.diff(own) > 1) | (least[own[1:]] != least[own[:-1]]) | (p.doc[own[1:]] != p.doc[own[:-1]]))
        begin = np.flatnonzero(new)
        self.at, self.last = own[begin], own[np.append(begin[1:], len(own)) - 1]
        self.anchor = least[self.at]
        up, down = (np.cumprod(np.full(len(p.hash), x, np.uint64)) for x in (_RATE, _BACK))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(p.hash * up)])
        end = self.last + words
        self.hash = mix(mix((total[end] - total[self.at]) * down[self.at]) + (end - self.at).astype(np.uint64))
        self.parts = grams, least, inside, width

    def twice(self) -> np.ndarray:
        """Whether the anchor occurs more than once in each segment."""
        if not len(self.at):
            return np.zeros(0, bool)
        grams, least, inside, width = self.parts
        none = np.zeros(width - 1, np.uint64)
        place = np.flatnonzero(grams == _sliding(np.maximum, np.concatenate([none, np.where(inside, least, np.uint64(0)), none]), width))
        low, high = np.searchsorted(place, self.at), np.searchsorted(place, self.last + width)
        size = high - low
        i = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        same = grams[place[i]] == np.repeat(self.anchor, size)
        return np.bincount(np.repeat(np.arange(len(size)), size), same, len(size)) > 1


def _line_ranges(w: Pieces, run: list[bytes], lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and number of words of every run of lines that has words."""
    p = Pieces(run, NEWLINE, None)
    h, _, first = p.windows(lines, short=False)
    begin = np.searchsorted(w.start, p.start[first])
    size = np.searchsorted(w.start, p.end[first + lines - 1]) - begin
    full = size > 0
    return mix(h[full] + np.uint64(_RATE)), begin[full], size[full]


def _outlines(words: int, lines: int):
    """A row for each segment and, without an anchor, for each run of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, texts in chunks(batch.column(1)):
                w = Pieces(texts, SPACE, None)
                s = _Segments(w, words)
                h, at, _ = _line_ranges(w, texts, lines)
                ids = batch.column(0).take(pa.array(np.concatenate([w.doc[s.at], w.doc[at]]) + base))
                anchors = pa.array(np.concatenate([s.anchor, np.zeros(len(h), np.uint64)]).astype(np.int64), mask=np.arange(len(s.at) + len(h)) >= len(s.at))
                twice = np.concatenate([s.twice(), np.zeros(len(h), bool)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([s.hash, h]).astype(np.int64)), anchors, pa.array(twice)], ["id", "hash", "anchor", "twice"])

    return run


def _places(words: int, lines: int, repeated, shared, first):
    """Word ranges (`span`: first word times 2^32, plus size) of repeated segments and runs of lines, and of single runs in the first of segments that share an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, anchors, firsts = repeated.value, shared.value, first.value
        found = lambda bits, h: has(bits, (h & np.uint64(8 * len(bits) - 1)).astype(np.int64))
        for batch in batches:
            for base, texts in chunks(batch.column(2)):
                w = Pieces(texts, SPACE, None)
                s = _Segments(w, words)
                ids = batch.column(0).slice(base, len(texts)).fill_null(_FIRST).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                opened = np.flatnonzero(found(anchors, s.anchor) & found(firsts, s.hash ^ ids[w.doc[s.at]]))
                n = s.last[opened] - s.at[opened] + 1
                runs = np.repeat(s.at[opened] - np.cumsum(n) + n, n) + np.arange(n.sum())
                run_hash = mix(_runs(w.hash, words)[runs] + np.uint64(_BACK)) if len(runs) else np.zeros(0, np.uint64)
                whole = np.flatnonzero(found(again, s.hash))
                h, at, size = _line_ranges(w, texts, lines)
                full = found(again, h)
                begin = np.concatenate([s.at[whole], runs, at[full]])
                size = np.concatenate([s.last[whole] - s.at[whole] + words, np.full(len(runs), words), size[full]])
                rows = pa.array(w.doc[begin] + base)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate([s.hash[whole], run_hash, h[full]]).astype(np.int64)), pa.array((begin - w.first[w.doc[begin]]) * 2**32 + size)],
                    ["id", "key", "hash", "span"],
                )

    return run


def _cut(raw: bytes, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without some words; where words go, the white space with more line ends on either side of them stays."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]])))
    if not len(edge):
        return b""
    out, before = [], -1
    for first, last in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()):
        left = raw[end[before] if before >= 0 else 0 : start[before + 1]]
        right = raw[end[first - 1] : start[first]] if first else left
        out += [right if before >= 0 and right.count(b"\n") > left.count(b"\n") else left, raw[start[first] : end[last]]]
        before = last
    return b"".join([*out, raw[end[-1] :]])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, removed = [], [], []
        for base, run in chunks(batch.column(1)):
            raw = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
            inside = ~SPACE[raw]
            before = np.append(False, inside[:-1])
            starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
            size = np.array([len(b) + 1 for b in run])
            doc_start = np.cumsum(size) - size
            edge = np.searchsorted(starts, np.append(doc_start, len(raw)))
            spans = batch.column(2).slice(base, len(run))
            gone, bound = spans.flatten().to_numpy(), np.append(0, np.cumsum(spans.value_lengths().fill_null(0).to_numpy()))
            for j, value in enumerate(batch.column(1).slice(base, len(run)).to_pylist()):
                n, hidden = int(edge[j + 1] - edge[j]), 0
                if bound[j] < bound[j + 1]:
                    at, width = np.divmod(gone[bound[j] : bound[j + 1]], 2**32)
                    covered = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + width, minlength=n + 1))[:n] > 0
                    own = slice(edge[j], edge[j + 1])
                    value = _cut(run[j], starts[own] - doc_start[j], ends[own] - doc_start[j], covered).decode("utf-8", "surrogatepass")
                    hidden = int(covered.sum())
                texts.append(value), counts.append(n), removed.append(hidden)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], ["row", "text", "n_words", "n_removed"])


def without_passages(documents: DataFrame, words: int = 50, lines: int = 3, bits: int = 1 << 26, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `documents`, `text_col` without later occurrences of runs of lines or words, and `n_words` and `n_removed` (words; they replace columns of these names)."""
    docs = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    outlines = docs.select("id", "text").mapInArrow(_outlines(words, lines), "id long, hash long, anchor long, twice int")
    seen = stored(outlines.groupBy("hash", "anchor").agg(F.count("*").alias("n"), F.min(F.coalesce("id", F.lit(_FIRST))).alias("id"), F.max("twice").alias("twice")), "segments")
    several = seen.where("anchor is not null").groupBy("anchor").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice > 0")
    flags = [bitmap(seen.where("n > 1"), "hash", bits, hashed=True), bitmap(several, "anchor", bits, hashed=True), bitmap(seen.where("anchor is not null").selectExpr("hash ^ id as place"), "place", bits, hashed=True)]
    forget(seen)
    shared = [documents.sparkSession.sparkContext.broadcast(f) for f in flags]
    places = stored(docs.mapInArrow(_places(words, lines, *shared), "id long, key long, hash long, span long"), "places")
    for b in shared:
        b.unpersist()
    place = F.struct("id", "key", "span")
    # stored, so that both sides of the join come straight from a shuffle and Spark can split a hash that very many documents hold
    first = stored(places.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    later = places.join(first, "hash").where(place > F.col("first"))
    covered = later.groupBy("id", "key").agg(F.collect_set("span").alias("gone"))
    # input columns travel in one struct, so no name of theirs can clash
    own = [c for c in documents.columns if c not in ("n_words", "n_removed")]
    rows = documents.select(F.struct(*(c for c in own if c != text_col)).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.col(text_col)).alias("own_key"), F.col(text_col).cast("string").alias("own_text"))
    joined = rows.join(covered, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left").select("row", "own_text", "gone")
    out = joined.mapInArrow(_without, StructType([joined.schema["row"], StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())]))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in own), "n_words", "n_removed")
