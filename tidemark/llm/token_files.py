"""Token ids in patched frame-of-reference files.

A file holds the ids of consecutive documents (ascending doc_id) as little-endian fields:

    header   magic "PFR1", documents, ids, ids in a block, blocks            4 bytes each
    index    start of each block, counted from the end of the index          8 bytes each, and one for the end
    docs     number of ids of each document                                  4 bytes each
    blocks   minimum (4), width in bits (1), exceptions (2), 1 spare byte, values packed in words of 64, exception places (2 each), their values (4 each)

A block's minimum is subtracted from its ids, which are packed at the width of the `percentile`-th largest; the rest are
exceptions: their low bits are packed as well, and place and whole value stand in the exception list. Any block is
found by the index and decoded by itself.

Files are made where Spark has put the documents in order: documents are range-partitioned by id (one shuffle of
texts), each task encodes its own in order and cuts a file at `file_ids` ids. They are rows (part, file, start in
the part, counts, ids, content) of a Parquet table in a shared folder: any store that Spark writes to will do, a lost task is
simply run again, and nobody opens local files. A file knows its start within its part; those of parts are prefix sums
in one small window (a row for each part), broadcast to the readers.

Null and empty texts give the end id alone. A null id comes first. Rows that repeat an id follow each other, by a hash of the text, then by text.
"""

from __future__ import annotations

import gc
import re
import struct
import zlib
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

MAGIC = b"PFR1"
BLOCK = 1024
FILE_SCHEMA = "part int, file int, part_start long, n_docs long, n_ids long, doc_ids array<long>, content binary"


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of `values` (uint64, a multiple of 64 in each row) at `width` bits, lowest bits first."""
    rows = len(values)
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8).reshape(rows, -1)


def _unpacked(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    """The inverse of `_packed`: rows of n values (a multiple of 64)."""
    rows = len(raw)
    if not width:
        return np.zeros((rows, n), np.uint32)
    words = np.ascontiguousarray(np.ascontiguousarray(raw).view(np.uint64).reshape(-1, width).T)
    lanes = np.empty((64, words.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        x = words[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[word + 1] << np.uint64(64 - shift))
        lanes[i] = (x & mask).astype(np.uint32)
    return np.ascontiguousarray(lanes.T).reshape(rows, n)


def pack_blocks(ids: np.ndarray, percentile: float = 97.0) -> list[bytes]:
    """The blocks of `ids` (unsigned 32-bit); blocks of one width are packed together."""
    count = -(-len(ids) // BLOCK)
    out: list[bytes] = [b""] * count
    full = len(ids) // BLOCK * BLOCK
    tail = ids[full:]
    for first, part in ((0, ids[:full].reshape(-1, BLOCK)), (full // BLOCK, tail.reshape(1, -1))):
        if not part.size:
            continue
        low = part.min(1)
        rest = (part - low[:, None]).astype(np.uint32)
        at = min(part.shape[1] - 1, int(np.ceil(part.shape[1] * percentile / 100)))
        width = np.ceil(np.log2(np.partition(rest, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.int64)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            value = rest[rows].astype(np.uint64)
            over = value >> np.uint64(w) > 0
            kept = value & np.uint64((1 << int(w)) - 1)
            pad = -kept.shape[1] % 64
            packed = _packed(np.pad(kept, ((0, 0), (0, pad))) if pad else kept, int(w))
            for j, r in enumerate(rows.tolist()):
                places = np.flatnonzero(over[j])
                out[first + r] = struct.pack("<IBHx", int(low[r]), int(w), len(places)) + packed[j].tobytes() + places.astype("<u2").tobytes() + part[r][places].astype("<u4").tobytes()
    return out


def unpack_block(blob: memoryview | bytes, n: int) -> np.ndarray:
    """One block of n ids by itself."""
    return unpack_blocks([blob], n)[0]


def unpack_blocks(blobs: list, n: int) -> np.ndarray:
    """Blocks of n ids each, as rows."""
    head = [struct.unpack_from("<IBHx", b) for b in blobs]
    out = np.empty((len(blobs), n), np.uint32)
    width = np.array([h[1] for h in head])
    size = -(-n // 64) * 64
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        raw = np.stack([np.frombuffer(blobs[r], np.uint8, size * w // 8, 8) for r in rows])
        out[rows] = _unpacked(raw, w, size)[:, :n] + np.array([head[r][0] for r in rows], np.uint32)[:, None]
    for r, (_, w, over) in enumerate(head):
        if over:
            end = 8 + size * w // 8
            out[r, np.frombuffer(blobs[r], "<u2", over, end)] = np.frombuffer(blobs[r], "<u4", over, end + 2 * over)
    return out


def write_file(lengths: list[int], ids: np.ndarray) -> bytes:
    blocks = pack_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u8") + 4 * len(lengths)
    return b"".join([struct.pack("<4s4I", MAGIC, len(lengths), len(ids), BLOCK, len(blocks)), starts.tobytes(), np.array(lengths, "<u4").tobytes(), *blocks])


def read_file(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each document, and all ids."""
    magic, n_docs, n_ids, block, n_blocks = struct.unpack_from("<4s4I", blob)
    if magic != MAGIC:
        raise ValueError("not a token file")
    base = 20 + 8 * (n_blocks + 1)
    starts = np.frombuffer(blob, "<u8", n_blocks + 1, 20).astype(np.int64) + base
    lengths = np.frombuffer(blob, "<u4", n_docs, base)
    view = memoryview(blob)
    blobs = [view[starts[i] : starts[i + 1]] for i in range(n_blocks)]
    full = n_ids // block
    parts = [unpack_blocks(blobs[:full], block).ravel()] if full else []
    if n_ids % block:
        parts.append(unpack_block(blobs[full], n_ids % block))
    return lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


_ID = attrgetter("id")


class CachedEncoder:
    """Ids of whole texts by a byte-level BPE tokenizer of the `tokenizers` library, with a bounded memory of pieces.

    The pattern of such tokenizers never joins white space with what stands before it, and looks no further than the
    character after white space. In a text without two white space characters in a row, a space and the run after it
    are therefore encoded alike wherever they stand; each such piece is encoded once, by the library's pre-tokenizer
    and model, and then looked up. Other texts, those with an added token's string, and tokenizers of another kind go
    through the library whole.

    Two generations of at most `size` pieces bound the memory: a full young one replaces the old one.
    """

    #: Unicode's White_Space, as in the tokenizer's pattern (Python's own has four more).
    WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

    #: ASCII punctuation that, after letters, is one pre-token (an apostrophe may begin another).
    TAIL = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"

    def __init__(self, path: str, size: int = 600_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
        self.pre, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.white_pair = re.compile(f"[{self.WHITE}]{{2}}").search
        self.apart = ["  ", "\n\n", " \n", "\n ", *added]
        # other white space, by itself: in a text of ASCII alone, and in any
        self.rare = {True: "\t\x0b\x0c\r", False: "".join(re.findall(f"[{self.WHITE}]", "".join(map(chr, range(0x3001))))).translate({32: None, 10: None})}
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(64)]
        # the library's printable stand-ins of the 256 bytes
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
        hidden = [c for c in range(256) if c not in shown]
        self.stand_in = {c: c for c in shown} | {c: 256 + i for i, c in enumerate(hidden)}

    def whole(self, text: str) -> bool:
        """Whether a text has an added token's string or two white space characters in a row; plain searches, as a pattern looks at each character."""
        for x in self.apart:
            if x in text:
                return True
        for c in self.rare[text.isascii()]:
            if c in text:
                return self.white_pair(text) is not None
        return False

    def _model(self, mapped: str) -> bytes:
        t = self.model.tokenize(mapped)
        pack = self.packs[len(t)] if len(t) < len(self.packs) else struct.Struct(f"<{len(t)}I").pack
        return pack(*map(_ID, t))

    def _word(self, word: str) -> bytes:
        """A pre-token, given as text."""
        if word.isascii() and word[1:].isalpha():
            first = word[0]
            return self._model((first if first.isalpha() else chr(self.stand_in[ord(first)])) + word[1:])
        return self._model(word.encode().decode("latin-1").translate(self.stand_in))

    def _piece(self, piece: str) -> bytes:
        """A piece not in the young generation; " " stands before it unless it begins with a line feed."""
        got = self.old.get(piece)
        if got is None:
            if piece.isalpha():
                got = self._model("\u0120" + piece) if piece.isascii() else self._word(" " + piece)
                return self._keep(piece, got)
            core = piece.rstrip(self.TAIL)
            if core.isalpha():
                got = self.young.get(core)
                if got is None:  # a new or rare word: it is kept by itself, not with each mark that may follow it
                    return self._piece(core) + self._known(piece[len(core) :], " ")
                got += self._known(piece[len(core) :], " ")
            elif core[:1] == "\n" and core[1:].isalpha():
                got = self._word("\n") + self._word(core[1:])
                if len(core) < len(piece):
                    got += self._known(piece[len(core) :], " ")
            else:
                got = b"".join([self._model(m) for m, _ in self.pre.pre_tokenize_str(piece if piece[:1] == "\n" else " " + piece)])
        return self._keep(piece, got)

    def _keep(self, key: str, got: bytes) -> bytes:
        if len(key) <= 64:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = got
        return got

    def _known(self, piece: str, before: str = "") -> bytes:
        """A piece by its own, or, with `before`, a run of punctuation that follows a letter (kept under that name)."""
        got = self.young.get(before + piece)
        if got is None:
            got = self._keep(before + piece, self._word(piece)) if before else self._piece(piece)
        return got

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_piece or self.whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = text.replace("\n", " \n").split(" ")
        if not pieces[0]:  # the text begins with a space or a line feed
            first = b""
        else:
            first = b"".join([self._model(m) for m, _ in self.pre.pre_tokenize_str(pieces[0])])
        if not pieces[-1] and len(pieces) > 1:  # and ends with a space
            pieces[-1] = "\0"
            last = np.array(self.tokenizer.encode(" ", add_special_tokens=False).ids, "<u4").tobytes()
        else:
            last = None
        known = list(map(self.young.get, pieces))
        known[0] = first
        if last is not None:
            known[-1] = last
        if None in known:
            i = known.index(None)
            try:
                while True:
                    known[i] = self._known(pieces[i])
                    i = known.index(None, i + 1)
            except ValueError:
                pass
        return b"".join(known)


_ENCODERS: dict[str, CachedEncoder] = {}


def _encode(path: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, CachedEncoder(path))
        part, file, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        docs: list[int | None] = []
        size = before = 0

        def cut() -> pa.RecordBatch:
            blob = write_file([len(b) // 4 for b in ids], np.frombuffer(b"".join(ids), "<u4"))
            row = {"part": part, "file": file, "part_start": before, "n_docs": len(docs), "n_ids": size, "doc_ids": docs, "content": blob}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("file", pa.int32()), ("part_start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("content", pa.binary())]))

        collecting = gc.isenabled()
        gc.disable()  # pieces and ids hold no cycles; looking for some took a seventh of the encoding
        try:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids.append((encode(t) if (t := text.as_py()) else b"") + end)
                    docs.append(doc)
                    size += len(ids[-1]) // 4
                    if size >= file_ids:
                        yield cut()
                        ids, docs, size, file, before = [], [], 0, file + 1, before + size
            if docs:
                yield cut()
        finally:
            if collecting:
                gc.enable()

    return run


def write_tokens(documents: DataFrame, tokenizer_path: str, end_id: int = 0, file_ids: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends `end_id`, and writes the files; returns them, read from the shared folder (`FILE_SCHEMA`)."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of one null or repeated id are dealt by their texts, so that no id is one task's
    by_text = F.xxhash64("text")
    ordered = docs.repartitionByRange(n, F.col("doc_id"), by_text).sortWithinPartitions(F.col("doc_id"), by_text, F.col("text"))
    return stored(ordered.mapInArrow(_encode(tokenizer_path, end_id, file_ids), FILE_SCHEMA), "tokens", "uncompressed")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            doc_ids, content, start = batch.column(0)[i].values, batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            lengths, ids = read_file(content)
            edge = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(edge[:-1] + start), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = parts.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # one row for each task that wrote: at most spark.sql.shuffle.partitions of them, 12 bytes each
    return files.join(F.broadcast(before), "part").select("doc_ids", "content", (F.col("part_start") + F.col("base")).alias("start")).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
