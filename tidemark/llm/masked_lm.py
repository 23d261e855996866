"""Document scores by masked pseudo-likelihood: a bidirectional window network in NumPy.

Tokens are lower-case words. Every distinct word of the corpus has its own probability, the product of two: that of its
cell in context, by the network, and its share of the cell's occurrences, by the corpus's counts. The `KNOWN` most
frequent words are a cell each (share 1); all others are dealt by hash to the remaining `CELLS` - `KNOWN` cells.

The network predicts each token's cell from `SIDE` tokens to its left and as many to its right: embeddings by position are
summed, through tanh, and a two-level softmax (class, then member) gives the cell's probability. A document's score is
the sum of the log-probabilities of all its tokens, each predicted with itself masked; the mean makes documents of
different lengths comparable.

All that the model has comes from the whole corpus:

* Words are counted over all documents. The most frequent ones, at most `head_bound`, are broadcast with their counts; the
  counts of all others stay a table and are joined to the documents' rare words by word, so that vocabulary and counts
  grow with the corpus and nothing on the driver does.
* Training deals documents by a hash of id and text to shards of about `shard_tokens` tokens. Each shard is learnt once in
  order of that hash, every token a target, from the same initial parameters; parameters are averaged by numbers of
  targets, summed in a tree. How the input is partitioned plays no part. A round more begins with the averages of the last.

Null, empty and blank texts have no tokens: 0 tokens, sum 0 and a null mean. Rows with repeated ids are each scored; rows
that repeat both id and text are learnt in one shard. With no tokens at all the network stays as initialised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Pieces, chunks
from .shared import stored

CLASSES = MEMBERS = 32
CELLS = CLASSES * MEMBERS
HASHED = 128
KNOWN = CELLS - HASHED
SIDE, WIDTH = 2, 24
BATCH = 4096
_SHAPES = {"embed": (2 * SIDE, CELLS + 1, WIDTH), "class_w": (CLASSES, WIDTH), "class_b": (CLASSES,), "member_w": (CLASSES, MEMBERS, WIDTH), "member_b": (CLASSES, MEMBERS)}

Parameters = dict[str, np.ndarray]


def initial(counts: np.ndarray) -> Parameters:
    """Small random embeddings, zero output weights, and biases at the log of the corpus's counts by cell."""
    rng = np.random.Generator(np.random.PCG64(7))
    p = {k: np.zeros(s, np.float32) for k, s in _SHAPES.items()}
    p["embed"] = rng.normal(0, 0.3, _SHAPES["embed"]).astype(np.float32)
    grid = (counts.astype(np.float64) + 1).reshape(CLASSES, MEMBERS)
    p["class_b"] = np.log(grid.sum(1) / grid.sum()).astype(np.float32)
    p["member_b"] = np.log(grid / grid.sum(1, keepdims=True)).astype(np.float32)
    return p


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _SHAPES])


def shaped(v: np.ndarray) -> Parameters:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


class Context:
    """Looks up the cells around places, from far left to far right; CELLS stands beyond a document's ends."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray):
        self.place = np.arange(len(ids)) + SIDE * (doc + 1)
        self.padded = np.full((int(self.place[-1]) if len(ids) else 0) + SIDE + 1, CELLS, np.int64)
        self.padded[self.place] = ids

    def at(self, at: np.ndarray | slice) -> np.ndarray:
        place = self.place[at]
        return np.stack([self.padded[place + step] for step in (*range(-SIDE, 0), *range(1, SIDE + 1))])


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def hidden(p: Parameters, ctx: np.ndarray) -> np.ndarray:
    return np.tanh(sum(p["embed"][j][ctx[j]] for j in range(2 * SIDE)))


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by class, and where each class begins in it."""
    order = np.argsort(cls.astype(np.uint16), kind="stable")  # 16 bits: a radix sort
    return order, np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))])


def log_probabilities(p: Parameters, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    h = hidden(p, ctx)
    cls, mem = target // MEMBERS, target % MEMBERS
    out = _log_softmax(h @ p["class_w"].T + p["class_b"])[np.arange(len(target)), cls]
    order, edge = _by_class(cls)
    for c in range(CLASSES):
        if len(rows := order[edge[c] : edge[c + 1]]):
            out[rows] += _log_softmax(h[rows] @ p["member_w"][c].T + p["member_b"][c])[np.arange(len(rows)), mem[rows]]
    return out


def step(p: Parameters, memory: Parameters, ctx: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One Adagrad step on the mean negative log-probability of a batch, in place."""
    n = len(target)
    h = hidden(p, ctx)
    cls, mem = target // MEMBERS, target % MEMBERS
    g = {}
    d = np.exp(_log_softmax(h @ p["class_w"].T + p["class_b"]))
    d[np.arange(n), cls] -= 1
    g["class_w"], g["class_b"] = d.T @ h / n, d.sum(0) / n
    back = d @ p["class_w"]
    order, edge = _by_class(cls)
    g["member_w"], g["member_b"] = np.zeros_like(p["member_w"]), np.zeros_like(p["member_b"])
    for c in range(CLASSES):
        if len(rows := order[edge[c] : edge[c + 1]]):
            d = np.exp(_log_softmax(h[rows] @ p["member_w"][c].T + p["member_b"][c]))
            d[np.arange(len(rows)), mem[rows]] -= 1
            g["member_w"][c], g["member_b"][c] = d.T @ h[rows] / n, d.sum(0) / n
            back[rows] += d @ p["member_w"][c]
    back *= (1 - h * h) / n
    for k, v in g.items():
        memory[k] += v * v
        p[k] -= rate * v / np.sqrt(memory[k] + 1e-8)
    for j in range(2 * SIDE):
        order = np.argsort(ctx[j].astype(np.uint16), kind="stable")
        ids, first = np.unique(ctx[j][order], return_index=True)
        v = np.add.reduceat(back[order], first)
        memory["embed"][j][ids] += v * v
        p["embed"][j][ids] -= rate * v / np.sqrt(memory["embed"][j][ids] + 1e-8)


def _word_counts(flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for _, run_ in chunks(batch.column(0)):
                held.append(Pieces(run_).hash)
                size += len(held[-1])
                if size >= flush:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return run


class Vocabulary:
    """The frequent words of the corpus with their counts, the most frequent first, and the number of tokens in each hashed cell."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, hashed: np.ndarray):
        order = np.argsort(words, kind="stable")
        self.words = words[order]
        self.cell = np.where(order < KNOWN, order, KNOWN + (self.words % np.uint64(HASHED)).astype(np.int64)).astype(np.int16)
        of_cell = hashed[np.maximum(self.cell.astype(np.int64) - KNOWN, 0)]
        self.share = np.where(order < KNOWN, 0.0, np.log(np.maximum(counts[order], 1) / np.maximum(of_cell, 1))).astype(np.float32)
        self.hashed = np.log(np.maximum(hashed, 1.0))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell and log share of each word hash, and whether it is in the list; of others the share lacks the word's own count."""
        cell = KNOWN + (h % np.uint64(HASHED)).astype(np.int64)
        share = -self.hashed[cell - KNOWN]
        if not len(self.words):
            return cell, share, np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        found = self.words[at] == h
        return np.where(found, self.cell[at], cell), np.where(found, self.share[at], share), found


def _train(shared, rate: float):
    """Texts in order of shard: a row (shard, part, n, values) for each part of a shard's parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, v = shared.value
        learner, shard = None, None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]]) if len(shards) else []
            for a, b in zip(edge[:-1], edge[1:]):
                if shards[a] != shard:
                    if learner is not None:
                        yield learner.result(shard)
                    learner, shard = _Learner(v, rate), int(shards[a])
                for _, texts in chunks(batch.column(1).slice(a, b - a)):
                    w = Pieces(texts)
                    learner.add(vocabulary.look_up(w.hash)[0], w.doc)
        if learner is not None:
            yield learner.result(shard)

    return run


#: Values of the parameters in a row of the averaging.
PART = 4096


class _Learner:
    """One shard's parameters while its tokens pass, in batches of BATCH that do not depend on how the texts arrive."""

    def __init__(self, v: np.ndarray, rate: float):
        self.p, self.rate = shaped(v), rate
        self.memory = {k: np.full(s, 1e-6, np.float32) for k, s in _SHAPES.items()}
        self.ctx, self.target, self.n = np.zeros((2 * SIDE, 0), np.int64), np.zeros(0, np.int64), 0

    def add(self, cells: np.ndarray, doc: np.ndarray) -> None:
        if len(cells):
            self.ctx = np.concatenate([self.ctx, Context(cells, doc).at(slice(None))], 1)
            self.target = np.concatenate([self.target, cells])
            self._learn(len(self.target) // BATCH * BATCH)

    def _learn(self, end: int) -> None:
        for i in range(0, end, BATCH):
            step(self.p, self.memory, self.ctx[:, i : min(end, i + BATCH)], self.target[i : min(end, i + BATCH)], self.rate)
        self.ctx, self.target, self.n = self.ctx[:, end:], self.target[end:], self.n + end

    def result(self, shard: int) -> pa.RecordBatch:
        self._learn(len(self.target))
        v = flat(self.p).astype(np.float64) * self.n
        parts = [v[i : i + PART] for i in range(0, len(v), PART)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(parts), shard, np.int64)), pa.array(np.arange(len(parts), dtype=np.int64)), pa.array(np.full(len(parts), self.n, np.int64)), pa.array(parts, pa.list_(pa.float64()))],
            ["shard", "part", "n", "values"],
        )


def _summed(table: pa.Table) -> pa.Table:
    """Rows of one part to their sum, in order of shard."""
    table = table.sort_by("shard")
    total = sum(np.asarray(x.values) for x in table.column("values"))
    return pa.table({"shard": table.column("shard")[:1], "part": table.column("part")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "values": pa.array([total], pa.list_(pa.float64()))})


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, v = shared.value
        p = shaped(v)
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            sums, sizes, words, times = [], [], [], []
            for _, texts in chunks(batch.column(1), 256 << 10):
                w = Pieces(texts)
                cells, share, found = vocabulary.look_up(w.hash)
                around = Context(cells, w.doc)
                logp = np.concatenate([log_probabilities(p, around.at(slice(i, i + 8192)), cells[i : i + 8192]) for i in range(0, len(cells), 8192)] or [np.zeros(0)])
                sums.append(np.bincount(w.doc, logp + share, len(texts)))
                sizes.append(w.count)
                order = np.lexsort((rare := w.hash[~found], own := w.doc[~found]))
                rare, own = rare[order], own[order]
                fresh = np.flatnonzero(np.concatenate([[True], (np.diff(rare.view(np.int64)) != 0) | (np.diff(own) != 0)]) if len(rare) else np.zeros(0, bool))
                n, edge = np.diff(np.append(fresh, len(rare))), np.searchsorted(own[fresh], np.arange(len(texts) + 1))
                words += [rare[fresh[a:b]].view(np.int64) for a, b in zip(edge[:-1], edge[1:])]
                times += [n[a:b].astype(np.int32) for a, b in zip(edge[:-1], edge[1:])]
            if sums:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first, first + len(batch))), batch.column(0), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(sums).astype(np.float64)), pa.array(words, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                    ["row", "doc_id", "n_tokens", "sum_logp", "words", "times"],
                )
                first += len(batch)

    return run


def word_counts(documents: DataFrame, flush: int = 1 << 20, text_col: str = "text") -> DataFrame:
    """(word, n) of every distinct word's hash, as a stored table."""
    texts = documents.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))
    return stored(texts.mapInArrow(_word_counts(flush), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary_of(counts: DataFrame, head_bound: int = 1 << 18) -> tuple[Vocabulary, np.ndarray]:
    """The frequent words (whole levels of counts, at most `head_bound` words) and the numbers of tokens by cell."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r[0]: r[1] for r in counts.groupBy(level.alias("level")).count().collect()}  # a few hundred rows at most
    least, total = None, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > head_bound:
            break
        least = at
    head = counts.where(level >= least).toPandas() if least is not None else counts.limit(0).toPandas()
    words, n = head["word"].to_numpy(np.int64).astype(np.uint64), head["n"].to_numpy(np.int64)
    order = np.lexsort((words, -n))
    words, n = words[order], n[order]
    hashed = np.zeros(HASHED)
    for r in counts.groupBy(F.pmod("word", F.lit(HASHED)).alias("cell")).agg(F.sum("n").alias("n")).collect():
        hashed[r.cell] = r.n
    np.subtract.at(hashed, (words[:KNOWN] % np.uint64(HASHED)).astype(np.int64), n[:KNOWN])
    by_cell = np.zeros(CELLS)
    by_cell[: len(n[:KNOWN])] = n[:KNOWN]
    by_cell[KNOWN:] = hashed
    return Vocabulary(words, n, hashed), by_cell


def train(documents: DataFrame, counts: DataFrame, rounds: int = 1, rate: float = 0.1, shard_tokens: int = 1 << 20, head_bound: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary and parameters from all texts."""
    context = documents.sparkSession.sparkContext
    vocabulary, by_cell = vocabulary_of(counts, head_bound)
    v = flat(initial(by_cell))
    shards = max(1, int(-(-by_cell.sum() // shard_tokens)))
    # every shard is a partition of its own; the order within it is that of the hash
    order = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    texts = documents.where(F.col(text_col).isNotNull()).select(order.alias("order"), F.col(text_col).cast("string").alias("text"))
    dealt = texts.withColumn("shard", F.pmod("order", F.lit(shards)).cast("int")).repartitionById(shards, "shard").sortWithinPartitions("shard", "order")
    row = "shard long, part long, n long, values array<double>"
    for _ in range(rounds):
        shared = context.broadcast((vocabulary, v))
        learnt = dealt.select(F.col("shard").cast("long"), "text").mapInArrow(_train(shared, rate), row)
        left = shards
        while left > 1:
            left = -(-left // 256)
            learnt = learnt.withColumn("group", F.floor(F.col("shard") / 256)).groupBy("part", "group").applyInArrow(_grouped, row)
        got = learnt.toPandas()
        if len(got) and got["n"].iloc[0]:
            got = got.sort_values("part")
            v = (np.concatenate(got["values"].to_list()) / got["n"].iloc[0]).astype(np.float32)
        shared.destroy()
    return vocabulary, v


def _grouped(table: pa.Table) -> pa.Table:
    """The sum of up to 256 shards' rows of one part, under their group's number."""
    out = _summed(table.drop_columns(["group"]))
    return out.set_column(0, "shard", table.column("group")[:1].cast(pa.int64()))


def scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_tokens, sum_logp, mean_logp) of every row, by a model trained on the same table."""
    counts = word_counts(documents, text_col=text_col)
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, counts, id_col=id_col, text_col=text_col, **options))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = stored(docs.mapInArrow(_score(shared), "row long, doc_id long, n_tokens long, sum_logp double, words array<long>, times array<int>"), "scored")
    shared.destroy()
    # the counts of words outside the broadcast list; a word of the corpus has one
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    own = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("rare_logp"))
    out = scored.select("row", "doc_id", "n_tokens", "sum_logp").join(own, "row", "left").select("doc_id", "n_tokens", (F.col("sum_logp") + F.coalesce("rare_logp", F.lit(0.0))).alias("sum_logp"))
    return out.withColumn("mean_logp", F.when(F.col("n_tokens") > 0, F.col("sum_logp") / F.col("n_tokens")))
