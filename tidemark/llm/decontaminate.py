"""Benchmark decontamination by template windows.

Texts become templates: words are runs of letters and digits; a word that begins with a digit or spells a number is a
number (numbers in a row are one), a fixed unit name after a number is a unit, a capitalised word (of any script whose
capitals UTF-8 writes in at most two bytes) is a name, unless its second letter is a capital of A-Z too. Numbers, units and names are typed placeholders (slots), all other
words count in lower case. Windows of `words` template words, at least half of them plain, are hashed in benchmark and
documents, and joined on the hash. A capitalised word that begins a sentence may be a name or not: a window with such words
is hashed with them as plain words, and with them as names, and found by either; the windows
of each kind have to be consistent by themselves, so an opening word that is no name takes nothing from the others.

Benchmark hashes make a bitmap of fixed size; documents send only windows that pass it to the join, so texts are never
shuffled and the benchmark may be of any size. Joined windows are gathered by (document, item, shift between their
positions). Slots must be consistent: within a match, equal item values stand for equal document values. A match is made
of all shifts whose slots are consistent in themselves and with each other, so inserted and dropped words do not end it.
Its coverage is the share of the item's words, among those in any of its windows, that the found windows cover. A match
of at least `coverage` is a leak; `changed` counts distinct slot values that differ, so 0 is a verbatim copy and more a
re-parameterised question. Items that differ in their slots only are matched once, not each by itself.

An item without a window that is half plain has windows of its words as they are, and is found as a copy only. An item of
fewer than `words` words is one window of its own length, by template and by its words as they are, and is found wherever
a document holds it. Null and empty texts match nothing. Rows that repeat a doc_id are one document here; null ids are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, MULTIPLIERS, Pieces, chunks, mix
from .shared import bitmap, has

#: Units that count as slots after a number.
UNITS = "kg g mg lb oz t km m cm mm mi ft in yd l ml gal h hr hrs hour hours min mins minute minutes s sec second seconds day days week weeks month months year years percent dollar dollars euro euros usd eur gbp cent cents mph kmh hz khz mhz ghz kb mb gb tb w kw v a k c f".split()
#: Words that spell numbers. "one" is left out, since it mostly is none.
NUMBERS = "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 59, 63]] = True
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x5EED0001, 0x5EED0002, 0x5EED0003))
_UNIT_HASHES, _NUMBER_HASHES = (np.sort(Pieces([" ".join(x).encode()], _BREAK).hash) for x in (UNITS, NUMBERS))
_CAPITAL = np.array([chr(c).isupper() for c in range(0x800)])
_SLOTS = "array<struct<kind:int,value:long>>"
_WINDOW = f"item long, form long, at long, size int, total long, hash long, open boolean, slots {_SLOTS}"
_ARROW = pa.schema([("item", pa.int64()), ("form", pa.int64()), ("at", pa.int64()), ("size", pa.int32()), ("total", pa.int64()), ("hash", pa.int64()), ("open", pa.bool_()), ("slots", pa.list_(pa.struct([("kind", pa.int32()), ("value", pa.int64())])))])
_LITERAL = np.uint64(0x5EED0004)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class _Templates(Pieces):
    """Words of a run with `kind` (0 plain, 1 number, 2 name, 3 unit), `hash` (of the template word), `value`, and `opening`: plain words that may be names."""

    def __init__(self, run: list[bytes]):
        super().__init__(run, _BREAK, LOWER)
        if not len(self.start):
            self.kind = np.zeros(0, np.int64)
            self.value = np.zeros(0, np.uint64)
            self.opening = np.zeros(0, bool)
            return
        first = self.raw[self.start].astype(np.int64)
        second = self.raw[np.minimum(self.start + 1, len(self.raw) - 1)].astype(np.int64)
        number = (first >= 48) & (first < 58) | _among(self.hash, _NUMBER_HASHES)
        two = (first >= 0xC2) & (first < 0xE0)
        capital = _CAPITAL[np.where(two, (first & 0x1F) << 6 | second & 0x3F, np.where(first < 128, first, 0))]
        capital &= (second < 65) | (second > 90)  # words written in capitals are no names: whole texts may be
        stops = np.cumsum(_STOP[self.raw])
        begins = np.ones(len(self.start), bool)
        begins[1:] = (stops[self.start[1:]] > stops[self.end[:-1] - 1]) | (self.doc[1:] != self.doc[:-1])
        follows = np.zeros(len(self.start), bool)
        follows[1:] = number[:-1] & (self.doc[1:] == self.doc[:-1])
        unit = follows & _among(self.hash, _UNIT_HASHES)
        kind = np.where(number, 1, np.where(unit, 3, np.where(capital & ~begins, 2, 0)))
        keep = np.flatnonzero(~(number & follows))
        self.opening = (capital & begins & (kind == 0))[keep]
        self.start, self.end, self.doc, kind = self.start[keep], self.end[keep], self.doc[keep], kind[keep]
        # the value of numbers in a row ("3.50", "1,000,000") is that of all their pieces in order
        place = np.arange(len(number)) - np.repeat(keep, np.diff(np.append(keep, len(number))))
        self.value = np.add.reduceat(self.hash * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)), keep)
        self.value = np.where(kind == 1, mix(self.value), self.hash[keep])
        self.count = np.bincount(self.doc, minlength=len(run))
        self.first = np.cumsum(self.count) - self.count
        self.kind = kind
        self.hash = np.select([kind == 1, kind == 2, kind == 3], [_NUMBER, _NAME, _UNIT], self.value)


_CLOSED, _OPEN, _WORDS = 0, 1, 2


def _hashed(t: _Templates, size: int, how: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of `size` words: by template if at least half plain, with opening words as names where it has some (_OPEN), or of the words as they are (_WORDS)."""
    own, literal = t.hash, how == _WORDS
    if literal:
        t.hash = t.value
    elif how == _OPEN:
        t.hash = np.where(t.opening, _NAME, own)
    h, _, at = t.windows(size, short=False)
    t.hash = own
    if not literal:
        plain, opening = (np.concatenate([[0], np.cumsum(x)]) for x in (_kinds(t, how) == 0, t.opening))
        ok = 2 * (plain[at + size] - plain[at]) >= size
        if how == _OPEN:
            ok &= opening[at + size] > opening[at]
        h, at = h[ok], at[ok]
    return mix(h + np.uint64(size) * MULTIPLIERS[0] + (_LITERAL if literal else np.uint64(0))), at


def _kinds(t: _Templates, how: int) -> np.ndarray:
    return np.where(t.opening, 2, t.kind) if how == _OPEN else t.kind


def _form(t: _Templates, literal: bool) -> int:
    """Identity of one item's template and of which of its slots are equal; of an item found by its words only, of those."""
    own = t.value if literal else t.hash
    slots = np.flatnonzero(t.kind > 0)
    _, first, again = np.unique(t.value[slots] * np.uint64(4) + t.kind[slots].astype(np.uint64), return_index=True, return_inverse=True)
    pattern = np.zeros(len(own), np.uint64)
    if not literal:
        pattern[slots] = first[again].astype(np.uint64) + np.uint64(1)
    place = np.arange(1, len(own) + 1, dtype=np.uint64)
    return int(mix(mix(own + pattern * MULTIPLIERS[1]) * (np.uint64(2) * place + np.uint64(1))).sum().astype(np.int64))


def _row(t: _Templates, item: int, form: int, a: int, size: int, total: int, h: np.uint64, how: int, kinds: np.ndarray) -> dict:
    slots = [] if how == _WORDS else [{"kind": int(kinds[j]), "value": int(t.value[j].astype(np.int64))} for j in range(a, a + size) if kinds[j]]
    return {"item": item, "form": form, "at": a - int(t.first[t.doc[a]]), "size": size, "total": total, "hash": int(h.astype(np.int64)), "open": how == _OPEN, "slots": slots}


def _item_windows(words: int):
    """Windows of benchmark items; `total` is the number of words in any window of the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = _Templates([text.encode("utf-8", "surrogatepass")] if isinstance(text, str) else [b""])
                n = len(t.kind)
                if not n:
                    continue
                size = min(words, n)
                literal = not len(_hashed(t, size, _CLOSED)[1])
                # short items have too few plain words to spare one
                found = [(how, *_hashed(t, size, how)) for how in ((_CLOSED, _WORDS) if n < words else (_WORDS,) if literal else (_CLOSED, _OPEN))]
                total = len(np.unique(np.concatenate([at for _, _, at in found])[:, None] + np.arange(size)))
                form = _form(t, literal)
                for how, h, at in found:
                    kinds = _kinds(t, how)
                    rows += [_row(t, item, form, a, size, total, h[i], how, kinds) for i, a in enumerate(at.tolist())]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def _windows(sizes: list[int], filled):
    """Windows of (id, text), for each of the items' sizes, that are in the broadcast bitmap `filled`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = filled.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for base, texts in chunks(batch.column(1)):
                t = _Templates(texts)
                rows = []
                for size in sizes:
                    for how in (_CLOSED, _OPEN, _WORDS):
                        h, at = _hashed(t, size, how)
                        kinds = _kinds(t, how)
                        ok = np.flatnonzero(has(wanted, (h & np.uint64(8 * len(wanted) - 1)).astype(np.int64)))
                        rows += [_row(t, ids[base + int(t.doc[a])], 0, a, size, 0, h[i], how, kinds) for i, a in zip(ok.tolist(), at[ok].tolist())]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def _best(units: list[tuple[frozenset, dict]], size: int, total: int) -> tuple[int, int, int, int]:
    """(words, -changed, windows, slots) of the match that covers most: each shift in turn, joined by all that agree with it."""

    def rank(windows, bound):
        words = len({w + j for w in windows for j in range(size)})
        return words, -sum(k[1] != v for k, v in bound.items()), len(windows), len(bound)

    units = sorted(units, key=lambda u: rank(*u), reverse=True)
    best = rank(*units[0])
    for seed in units if best[0] < total else []:
        windows, bound = set(seed[0]), dict(seed[1])
        for more, theirs in units:
            if not more <= windows and all(bound.get(k, v) == v for k, v in theirs.items()):
                windows |= more
                bound |= theirs
        best = max(best, rank(windows, bound))
    return best


def _matches(coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                units = []
                for u in r["units"]:
                    bound = {(b["kind"], b["value"]): b["theirs"] for b in u["bound"]}
                    if len(bound) == len(u["bound"]):
                        units.append((frozenset(u["windows"]), bound))
                if units:
                    words, same, windows, slots = _best(units, r["size"], r["total"])
                    if words >= coverage * r["total"]:
                        rows.append((r["doc_id"], r["item_id"], r["n_items"], windows, words / r["total"], slots, -same))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "n_items", "windows", "coverage", "slots", "changed"])

    return run


def _benchmark_windows(benchmark: DataFrame, words: int, item_col: str, item_text_col: str) -> DataFrame:
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    return items.mapInArrow(_item_windows(words), _WINDOW)


def _forms(windows: DataFrame) -> DataFrame:
    return windows.select("form", "item").distinct()


def item_forms(benchmark: DataFrame, words: int = 8, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(form, item_id): which benchmark items share a form."""
    return _forms(_benchmark_windows(benchmark, words, item_col, item_text_col)).withColumnRenamed("item", "item_id")


def leaks(
    documents: DataFrame, benchmark: DataFrame, words: int = 8, coverage: float = 0.5, bits: int = 1 << 24,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_items, windows, coverage, slots, changed): a row for each document and form of benchmark item that it holds.

    Items with one template and the same slots equal to each other are one form (`item_forms` has its members); `item_id` is
    the smallest of them, and `changed` counts against that one.
    """
    spark = documents.sparkSession
    every = _benchmark_windows(benchmark, words, item_col, item_text_col)
    members = _forms(every).groupBy("form").agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("n_items"))
    # an item's number may be repeated with other texts: a window is its form's and its item's
    items = every.join(members, ["form", "item"]).dropDuplicates(["form", "item", "at", "hash"])
    sizes = sorted(r.size for r in items.select("size").distinct().collect())
    filled = spark.sparkContext.broadcast(bitmap(items.select("hash"), "hash", bits, hashed=True))
    docs = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(_windows(sizes, filled), _WINDOW)
    pairs = docs.select(F.col("item").alias("doc_id"), "at", "hash", F.col("slots").alias("theirs")).join(
        items.select(F.col("item").alias("item_id"), "form", "n_items", F.col("at").alias("item_at"), "size", "total", "hash", "open", "slots"), "hash"
    )
    bound = F.zip_with("slots", "theirs", lambda s, t: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), t["value"].alias("theirs")))
    by_shift = pairs.groupBy("doc_id", "item_id", "form", "n_items", (F.col("at") - F.col("item_at")).alias("shift"), "open").agg(
        F.sort_array(F.collect_set("item_at")).alias("windows"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(bound)))).alias("bound"), F.max("total").alias("total"), F.max("size").alias("size"),
    )
    units = by_shift.groupBy("doc_id", "item_id", "form", "n_items").agg(F.collect_set(F.struct("windows", "bound")).alias("units"), F.max("total").alias("total"), F.max("size").alias("size"))
    return units.select("doc_id", "item_id", "n_items", "units", "total", "size").mapInArrow(_matches(coverage), "doc_id long, item_id long, n_items long, windows long, coverage double, slots long, changed long")


def without_leaks(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of `documents` (all columns) that hold no benchmark item."""
    return documents.join(leaks(documents, benchmark, **options).select("doc_id").distinct(), "doc_id", "left_anti")
