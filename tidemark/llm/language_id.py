"""Language identification by cross-parsing with suffix automata.

For each language, labelled text is made into a suffix automaton, which accepts exactly the text's substrings. A
document is parsed greedily: each phrase is the longest match in the automaton from where the last one ended. The
language that needs the fewest phrases, each language's number divided by what it needs for held-back text of its own
(per character), wins: a language has not only to parse well but to parse well for its standards.

Text is lower case; every run of characters that are neither letters nor marks (Unicode categories L and M) is one space. A
whole document is parsed. For speed it is cut into segments that are parsed in step, for all languages, as array look-ups
in one transition table; a segment's parse begins `WARM` bytes before it. Where its state at the border is not the one that
the segment before ended in, the segment is parsed again from there, so the phrases are those of one greedy parse.

The table is fitted on a bounded sample: for each language, documents in the order of their id's hash until `sample_bytes`
of normalised text in automaton and `own_bytes` held back are reached. A document gives a sixteenth of that at first, and
more only where the first parts of all documents are too few. Copies of a part count once, so held-back text is never in
the automaton; where text is scarce, both get their proportion of it. Where there are so many languages that the table
would be above `table_bytes`, each learns from less text; none is dropped.

Null texts and texts without a letter are `und` with score 0. Ties go to the language first in code point order. Rows
with repeated ids are each predicted. With nothing to learn from, all is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT, WARM = 1024, 128
#: States of all lanes and languages that are parsed in step.
STATES = 1 << 20
_OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def normalised(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "ignore") if _LETTER.search(text) else b""


def automaton(text: bytes, symbols: np.ndarray, size: int) -> np.ndarray:
    """Suffix automaton of `text` as a table [state, symbol] of next states, -1 where there is none; the root is 0."""
    link, length, edges = [-1], [0], [{}]
    last = 0
    for c in symbols[np.frombuffer(text, np.uint8)].tolist():
        cur = len(link)
        link.append(0), length.append(length[last] + 1), edges.append({})
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(link)
                link.append(link[q]), length.append(length[p] + 1), edges.append(dict(edges[q]))
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(link), size), -1, np.int32)
    for s, e in enumerate(edges):
        for c, t in e.items():
            table[s, c] = t
    return table


class Model:
    """languages (in code point order), symbols (byte -> column), one table of all automata, and own phrases per byte."""

    def __init__(self, texts: dict[str, bytes], own: dict[str, bytes]):
        self.languages = sorted(texts)
        used = np.unique(np.frombuffer(b"".join(texts.values()) or b" ", np.uint8))
        self.symbols = np.zeros(256, np.int64)
        self.symbols[used] = np.arange(1, len(used) + 1)
        self.size = len(used) + 1
        tables, self.roots, base = [], [], 0
        for lang in self.languages:
            t = automaton(texts[lang], self.symbols, self.size)
            root = np.where(t[0] < 0, 0, t[0]) + base
            # negative entries begin a new phrase with this symbol: every step from the root, and every missing edge
            t = np.where(t < 0, -(root + 1)[None, :], t + base)
            t[0] = -(root + 1)
            tables.append(t.astype(np.int32))
            self.roots.append(base)
            base += len(t)
        self.table = (np.concatenate(tables) if tables else np.zeros((0, self.size), np.int32)).ravel()
        self.norm = np.ones(len(self.languages))
        for i, lang in enumerate(self.languages):
            held = own.get(lang) or texts[lang]
            self.norm[i] = max(self.phrases([held])[0, i], 1.0) / max(1, len(held))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases of each text (rows) for each language."""
        out = np.zeros((len(texts), len(self.languages)))
        lanes = [(i, a) for i, t in enumerate(texts) for a in range(0, len(t), SEGMENT)]
        if not lanes or not self.languages:
            return out
        lanes.sort(key=lambda x: -min(SEGMENT, len(texts[x[0]]) - x[1]))
        most = max(1, STATES // len(self.languages))
        got = [self._in_step(texts, lanes[k : k + most]) for k in range(0, len(lanes), most)]
        begin, end, count = (np.concatenate(x, 1) for x in zip(*got))
        at = {lane: k for k, lane in enumerate(lanes)}
        for i, a in sorted(lanes):
            k = at[i, a]
            if a:
                before = at[i, a - SEGMENT]
                for j in np.flatnonzero(end[:, before] != begin[:, k]).tolist():
                    end[j, k], count[j, k] = self._walk(texts[i][a : a + SEGMENT], int(end[j, before]))
            out[i] += count[:, k]
        return out

    def _in_step(self, texts: list[bytes], lanes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States (languages, lanes) where each segment begins and ends, and the phrases that begin in it; longest lanes come first."""
        parts = [texts[i][max(0, a - WARM) : a + SEGMENT] for i, a in lanes]
        skip = np.array([WARM if a == 0 else 0 for _, a in lanes])  # the unknown symbol keeps the root
        size = np.array([len(t) for t in parts])
        grid = np.zeros((len(lanes), int((skip + size).max())), np.uint8)
        column = np.arange(grid.shape[1])[None, :]
        grid[(column >= skip[:, None]) & (column < (skip + size)[:, None])] = self.symbols[np.frombuffer(b"".join(parts), np.uint8)]
        grid = np.ascontiguousarray(grid.T)
        n = len(self.languages)
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(lanes), 1)
        count = np.zeros((n, len(lanes)), np.int32)
        alive = np.searchsorted(-(skip + size), -np.arange(1, grid.shape[0] + 1), "right")
        width = np.int32(self.size)
        for step, m in enumerate(alive.tolist()):
            if step == WARM:
                begin = state.copy()
                count[:] = 0
            s = self.table[state[:, :m] * width + grid[step, :m]]
            new = s < 0
            count[:, :m] += new
            state[:, :m] = np.where(new, ~s, s)
        return begin, state, count

    def _walk(self, text: bytes, state: int) -> tuple[int, int]:
        count = 0
        for c in self.symbols[np.frombuffer(text, np.uint8)].tolist():
            s = int(self.table[state * self.size + c])
            count += s < 0
            state = ~s if s < 0 else s
        return state, count

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clean = [normalised(t) if isinstance(t, str) else b"" for t in texts]
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        found = self.phrases(clean) / self.norm
        best = found.argmin(1)
        share = np.exp(-10 * (found / np.maximum(found.min(1, keepdims=True), 1e-9) - 1))
        score = 1 / share.sum(1)
        return [self.languages[b] if c else "und" for b, c in zip(best, clean)], [float(s) if c else 0.0 for s, c in zip(score, clean)]


def fit(labelled: DataFrame, sample_bytes: int = 24_000, own_bytes: int = 8_000, table_bytes: int = 1 << 28, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows with text and language. At most `sample_bytes` + `own_bytes` of text a language, and in all languages `table_bytes` / 8, reach the driver."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    letters = lambda text: F.octet_length(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")))
    text = F.col(text_col).cast("string")
    languages = max(1, rows.select(lang_col).distinct().count())
    total = max(16, min(sample_bytes + own_bytes, table_bytes // (8 * languages)))
    part = max(1, total // 16)
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.sum(letters(F.substring(text, 1, part)).cast("long")).alias("n"))
    # The smallest hashes: a threshold by language that leaves about four times the bytes needed, then a running sum over those.
    rank = F.pmod(F.xxhash64(F.col(id_col), F.lit(9)), F.lit(1 << 30))
    least = counts.select("lang", (F.least(F.lit(1.0), F.lit(4.0 * total) / F.greatest("n", F.lit(1))) * 2**30).alias("least"))
    parts = F.transform(F.sequence(F.lit(0), F.least(F.lit(15), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / part)).cast("int")), lambda i: F.substring(F.col("text"), i * part + 1, F.lit(part)))
    near = rows.select(F.col(lang_col).alias("lang"), rank.alias("rank"), text.alias("text")).join(F.broadcast(least), "lang").where("rank < least")  # a row a language
    sample = near.select("lang", "rank", F.posexplode(parts).alias("part", "text"))
    sample = sample.groupBy("lang", "text").agg(F.min(F.struct("part", "rank")).alias("place")).withColumn("size", letters(F.col("text")).cast("long")).where("size > 0")
    order = Window.partitionBy("lang").orderBy("place", F.xxhash64("text"), "text")
    sample = sample.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).where(F.col("before") < total).select("lang", "before", "text").collect()
    got: dict[str, bytes] = {}
    for r in sorted(sample, key=lambda r: r.before):
        got[r.lang] = got.get(r.lang, b"") + (b" " if r.lang in got else b"") + normalised(r.text)
    # a state for each byte and at most as many clones, four bytes a symbol
    symbols = 1 + len(set(b"".join(got.values())))
    most = min(total, max(16, table_bytes // (8 * symbols * max(1, len(got)))))
    got = {k: v[:most] for k, v in got.items() if v}
    held = {k: min(own_bytes, len(v) * own_bytes // (sample_bytes + own_bytes)) for k, v in got.items()}
    return Model({k: v[held[k] :] for k, v in got.items()}, {k: v[: held[k]] for k, v in got.items()})


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                lang, score = model.value.predict(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_languages(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; only the text decides."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _predict(shared), "doc_id long, held_out boolean, lang_pred string, score double"
    )
