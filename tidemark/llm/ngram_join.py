"""N-gram Jaccard self-join by token-combination prefixes, and the near-duplicate classes it gives.

A document is its set of distinct k-word shingles (`SetSpec.words`); two documents link when
100 * intersection >= `percent` * union. Every link between different sets is found, by prefix filtering in the form
where frequent tokens are indexed by combination (k-wise signatures, Wang et al., SIGMOD 2016):

* All shingles are counted over the whole table (one shuffle of sorted, delta-coded hash blocks). Those seen in at
  most `rare_df` documents are *rare*; the rest, in falling rarity, are *frequent*. The frequent list is a table of at
  most `frequent_bound` entries: where there are more, the dividing count rises. A count only orders tokens, so any
  list gives the same links.
* A set of size n can lack t = n - ceil(percent * n / 100) of its tokens in a partner. Tokens in order (rare ones by
  hash, then frequent ones by count and hash) form a prefix. A rare token is a signature by itself; frequent ones are
  dealt by hash into classes, and each pair of one class is a signature. The prefix is extended until
  rare + sum over classes of (members - 1) >= t + 1: then any partner shares a signature. The number of classes
  depends on the octave of n; a set near an octave's lower end signs for the octave below as well.
* A signature seen once can link nothing. A bitmap of fixed size (`bitmap_bits`) drops most rare tokens that only
  one document has before they are shuffled; its false positives cost rows, never links.
* Signatures with the same member sets are one: what two documents share is compared once, not once for each signature.
* Sets sharing a signature are first compared with the most central set of that signature (a star, not all pairs): the
  one with the largest share of frequent tokens, which in a group of edited copies is the one they derive from. Only in
  signatures that still hold several components, the sets outside the largest one are then compared with all others.
* A parity sketch of one to two bits a token bounds the symmetric difference from below within the join. What remains
  is verified on the exact sets, which are sent once for each `batch` partners of a set, not once for each pair.

Equal sets are one node from the start, so copies never meet each other. No step collects documents, links or
components to the driver.

Null, empty and blank texts have no shingles and link with nothing. Rows that repeat a doc_id are each returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import chunks, mix, shingle_sets
from .shared import bitmap, components, forget, has, stored

#: 64-bit words of the short sketch, and of the longest one
SHORT, LONGEST = 8, 256
_U = np.uint64


@dataclass(frozen=True)
class SetSpec:
    """words: shingle length; percent: Jaccard threshold; the rest are sizes that change cost, never results."""

    words: int = 5
    percent: int = 80
    rare_df: int = 8
    frequent_bound: int = 1 << 19
    bitmap_bits: int = 27
    #: shingles sorted at once in a task
    flush: int = 1 << 20
    #: partners for which a set is sent once
    batch: int = 64


def _count_blocks(spec: SetSpec, bits: int):
    """Each flush: the distinct shingles of a task's documents by leading `bits`, as sorted 32-bit keys (delta-coded, byte planes) and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = (h >> _U(64 - bits)).astype(np.int64)
            key = ((h >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype(np.int64)
            edge = np.searchsorted(bucket, np.arange(2**bits + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edge)):
                k = key[edge[b] : edge[b + 1]]
                delta = np.diff(k, prepend=0).astype("<u4")
                rows.append((int(b), delta.view(np.uint8).reshape(-1, 4).T.tobytes(), n[edge[b] : edge[b + 1]].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["bucket", "keys", "counts"])

        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                for s in shingle_sets(texts, spec.words):
                    held.append(s)
                    size += len(s)
                    if size >= spec.flush:
                        yield flushed()
                        held, size = [], 0
        if size:
            yield flushed()

    return run


def _planes(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _merge_counts(spec: SetSpec, bits: int):
    """One bucket: bitmap slice of the shingles seen in two documents or more, and the frequent ones with their counts."""
    own_bits = spec.bitmap_bits - bits

    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(_planes(b)) for b in table.column("keys").to_pylist()])
        counts = np.concatenate([_planes(b) for b in table.column("counts").to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        edge = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[edge], np.add.reduceat(counts, edge)
        seen = np.zeros(2**own_bits, bool)
        seen[keys[counts > 1] >> (32 - own_bits)] = True
        top = counts > spec.rare_df
        return pa.table({
            "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int64()),
            "seen": pa.array([np.packbits(seen).tobytes()], pa.binary()),
            "keys": pa.array([keys[top].tolist()], pa.list_(pa.int64())),
            "df": pa.array([counts[top].tolist()], pa.list_(pa.int64())),
        })

    return run


def token_counts(docs: DataFrame, spec: SetSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Over all texts: bitmap of repeated shingles, sorted frequent shingles (leading bits) and their counts, number of leading bits of a bucket."""
    spark = docs.sparkSession
    bits = min(20, max(8, int(np.ceil(np.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))))
    blocks = docs.select("text").mapInArrow(_count_blocks(spec, bits), "bucket long, keys binary, counts binary")
    merged = stored(blocks.groupBy("bucket").applyInArrow(_merge_counts(spec, bits), "bucket long, seen binary, keys array<long>, df array<long>"), "counts")
    pairs = merged.select("bucket", F.explode(F.arrays_zip("keys", "df")).alias("x")).select("bucket", "x.keys", "x.df")
    levels = {r[0]: r[1] for r in pairs.groupBy(F.expr("cast(floor(log2(df) * 4) as int)").alias("level")).count().collect()}
    least, total = None, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > spec.frequent_bound:
            break
        least = level
    seen = np.zeros(2**spec.bitmap_bits // 8, np.uint8)
    step = 2 ** (spec.bitmap_bits - bits) // 8
    for r in merged.select("bucket", "seen").toLocalIterator():
        seen[r[0] * step : (r[0] + 1) * step] = np.frombuffer(r[1], np.uint8)
    if least is None:
        frequent = pairs.limit(0).toArrow()
    else:
        frequent = pairs.where(F.expr(f"cast(floor(log2(df) * 4) as int) >= {least}")).toArrow()
    key = (frequent["bucket"].to_numpy().astype(np.uint64) << _U(32)) | frequent["keys"].to_numpy().astype(np.uint64)
    order = np.argsort(key)
    forget(merged)
    return seen, key[order], frequent["df"].to_numpy()[order], bits


def signatures(h: np.ndarray, df: np.ndarray, repeated: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of one sorted set `h`; df: 0 for rare tokens; repeated: False only for tokens of this set alone."""
    n = len(h)
    lacking = n - -(-percent * n // 100)
    out = []
    for octave in {int(np.floor(np.log2(n))), int(np.floor(np.log2(max(1, -(-percent * n // 100)))))}:
        salt = _U(octave * 0x632BE59BD9B4E019 % 2**64)
        classes = 2**octave // 20 if octave >= 5 else 1
        rare = np.flatnonzero(df == 0) if octave >= 4 else np.arange(n)
        if octave < 4:
            rare = rare[np.lexsort((h, df))]
        single = rare[: lacking + 1]
        out.append(mix(h[single[repeated[single]]] ^ salt))
        need = lacking + 1 - len(single)
        if need <= 0:
            continue
        rest = np.flatnonzero(df > 0)
        rest = rest[np.lexsort((h[rest], df[rest]))]
        group = (h[rest] % _U(classes)).astype(np.int64)
        fresh = np.zeros(len(rest), bool)
        fresh[np.unique(group, return_index=True)[1]] = True
        gained = np.cumsum(~fresh)
        size = int(np.searchsorted(gained, need)) + 1
        prefix, group = h[rest[:size]], group[:size]
        order = np.argsort(group, kind="stable")
        prefix, group = prefix[order], group[order]
        for j in range(1, int(np.bincount(group).max())):
            same = group[:-j] == group[j:]
            out.append(mix(prefix[:-j][same] * _U(0xC2B2AE3D27D4EB4F) + mix(prefix[j:][same]) + salt))
    return np.unique(np.concatenate(out))


def _node(s: np.ndarray) -> int:
    """64-bit identity of a set."""
    x = np.array([np.bitwise_xor.reduce(mix(s ^ _U(0x9E37))), np.add.reduce(s), len(s)], np.uint64)
    return int(mix((mix(x) * np.array([1, 3, 5], np.uint64)).sum(keepdims=True))[0].astype(np.int64))


def sketch(s: np.ndarray) -> list[int]:
    """Parity of the number of tokens in each of a power of two of cells: two sets differ in at least as many tokens as cells.

    The short form (SHORT words) comes first; sets above 64 * SHORT tokens have a long form of at least a cell a token after it.
    """
    words = SHORT
    while words * 64 < len(s) and words < LONGEST:
        words *= 2
    odd = np.bincount((s >> _U(7)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    full = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    if words == SHORT:
        return full.tolist()
    return np.concatenate([np.bitwise_xor.reduce(full.reshape(-1, SHORT)), full]).tolist()


def _sign(spec: SetSpec, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, key, count, bits = counts.value
        for batch in batches:
            sizes, nodes, central, sketches, sigs = [], [], [], [], []
            for _, texts in chunks(batch.column(2)):
                for s in shingle_sets(texts, spec.words):
                    sizes.append(len(s))
                    if not len(s):
                        nodes.append(None), central.append(None), sketches.append(None), sigs.append(None)
                        continue
                    lead = s >> _U(32 - bits)
                    df = np.zeros(len(s), np.int64)
                    if len(key):
                        at = np.minimum(np.searchsorted(key, lead), len(key) - 1)
                        df = np.where(key[at] == lead, count[at], 0)
                    bit = (s >> _U(64 - spec.bitmap_bits)).astype(np.int64)
                    repeated = (seen[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0
                    nodes.append(_node(s)), sketches.append(sketch(s))
                    central.append(int(1e6 * (df > 0).mean()))
                    sigs.append(signatures(s, df, repeated, spec.percent).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(central, pa.int32()), pa.array(sketches, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))],
                ["doc_id", "mark", "n", "node", "central", "sketch", "sigs"],
            )

    return run


def _sets_of(spec: SetSpec, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            b = batch.filter(pa.array(has(wanted.value, batch.column(1).to_numpy())))
            for _, texts in chunks(b.column(0)):
                sets = {_node(s): s for s in shingle_sets(texts, spec.words) if len(s)}
                fresh = [x for x in sets if x not in done]
                done.update(fresh)
                yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.int64()), pa.array([sets[x].view(np.int64) for x in fresh], pa.list_(pa.int64()))], ["node", "tokens"])

    return run


def _links(pairs: DataFrame, docs: DataFrame, spec: SetSpec) -> DataFrame:
    """Those of the stored `pairs` (a, b, doc_a, doc_b) whose exact sets link. Reads the texts once, through a bitmap of the ids that occur."""
    bits = 1 << 24
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")), "doc_id", bits))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = docs.where("doc_id is not null").select("text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("cell")).mapInArrow(_sets_of(spec, wanted), "node long, tokens array<long>")
    sets = stored(sets.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")
    wanted.destroy()
    # the partners of a set are dealt to groups of about `batch`, and each group gets the set once
    partners = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    grouped = pairs.select("a", "b").join(partners, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / spec.batch)).alias("g"))
    left = grouped.select("a", "g").distinct().join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    right = grouped.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    links = right.join(left, ["a", "g"]).withColumn("both", both).where(100 * F.col("both") >= spec.percent * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")
    links = stored(links, "verified")
    forget(sets)
    return links


def _close(spec: SetSpec) -> F.Column:
    """False only for pairs that cannot link, by size or by sketch (columns n_a, n_b, sketch_a, sketch_b)."""
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    may = lambda cells: cells * (100 + spec.percent) <= (F.col("n_a") + F.col("n_b")) * (100 - spec.percent)
    short = sum((F.bit_count(F.expr(f"sketch_a[{i}] ^ sketch_b[{i}]")) for i in range(SHORT)), F.lit(0))

    def halved(x: F.Column) -> F.Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    def cells(x: F.Column, y: F.Column) -> F.Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)

    a, b = (F.slice(F.col(f"sketch_{x}"), F.lit(SHORT + 1), F.greatest(F.size(f"sketch_{x}") - SHORT, F.lit(0))) for x in "ab")
    long = F.when(F.size(a) == F.size(b), cells(a, b)).when(F.size(a) > F.size(b), cells(halved(a), b)).otherwise(cells(a, halved(b)))
    has_long = (F.size("sketch_a") > SHORT) & (F.size("sketch_b") > SHORT)
    return F.when((low * 100 < high * spec.percent) | ~may(short), False).when(has_long, may(long)).otherwise(True)


def similarity_classes(documents: DataFrame, spec: SetSpec = SetSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the smallest id reachable by links.

    `id_col` is a long. A null id is a document of its own value; a null component is possible only for null ids.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("mark"), F.col(text_col).cast("string").alias("text"))
    return _classes(docs, spec).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _classes(rows: DataFrame, spec: SetSpec) -> DataFrame:
    """(doc_id, mark, n_shingles, class, component_id) of the rows (doc_id, mark, text); class: a node that stands for the component."""
    docs = rows.select("doc_id", "text")
    counts = docs.sparkSession.sparkContext.broadcast(token_counts(docs, spec))
    signed = stored(rows.mapInArrow(_sign(spec, counts), "doc_id long, mark long, n long, node long, central int, sketch array<long>, sigs array<long>"), "signed")
    counts.destroy()

    first = signed.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    own = signed.join(first, ["node", "doc_id"], "left_semi")
    nodes = stored(own.select("node", F.col("doc_id").alias("doc"), "n", "sketch").dropDuplicates(["node"]), "nodes")
    rows = own.select("node", "central", F.explode("sigs").alias("sig"))
    members = stored(_members(rows), "members")

    of = lambda side: nodes.select(F.col("node").alias(side), F.col("doc").alias(f"doc_{side}"), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    star = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    close = stored(star.join(of("b"), "b").join(of("a"), "a").where(_close(spec)).select("a", "b", "doc_a", "doc_b"), "pairs")
    labels = stored(components(_links(close, docs, spec)), "labels")

    # Signatures that still hold several components: their sets outside the largest one with all others.
    held = members.join(labels, "node", "left").select("sig", "pivot", "node", F.coalesce("label", "node").alias("label"))
    parts = held.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("k"))
    opened = parts.groupBy("sig").agg(F.max_by("label", F.struct("k", "label")).alias("largest"), F.count(F.lit(1)).alias("k")).where("k > 1").select("sig", "largest")
    rest = stored(held.join(opened, "sig").join(nodes, "node").select("sig", "pivot", "node", "doc", "label", "n", "sketch", (F.col("label") == F.col("largest")).alias("inside")).distinct(), "open")
    left, right = (rest.select("sig", *(F.col(c).alias(f"{c}_{x}") for c in ("pivot", "node", "doc", "label", "n", "sketch", "inside"))) for x in "ab")
    once = F.col("inside_b") | (F.col("node_a") < F.col("node_b"))
    untried = (F.col("node_a") != F.col("pivot_a")) & (F.col("node_b") != F.col("pivot_b"))
    across = left.where("not inside_a").join(right, "sig").where((F.col("label_a") != F.col("label_b")) & once & untried & _close(spec))
    more = _links(stored(across.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("doc_a"), F.col("doc_b")).distinct(), "pairs"), docs, spec)
    lifted = more.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    joined = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(lifted.select(F.coalesce("la", "a"), F.coalesce("lb", "b"))))

    classes = nodes.select("node", "doc").join(joined, "node", "left").select("node", "doc", F.coalesce("label", "node").alias("label"))
    least = classes.groupBy("label").agg(F.min("doc").alias("component_id"))
    classes = classes.join(least, "label").select("node", F.col("label").alias("class"), "component_id")
    tagged = signed.select("doc_id", "mark", F.col("n").alias("n_shingles"), "node").join(classes, "node", "left")
    return tagged.select("doc_id", "mark", "n_shingles", F.coalesce("class", "node").alias("class"), "component_id")


def _members(rows: DataFrame) -> DataFrame:
    """(sig, pivot, node) of the signatures (node, central, sig) with several nodes; of signatures with equal members, one."""
    by_sig = rows.groupBy("sig").agg(
        F.max_by("node", F.struct("central", "node")).alias("pivot"), F.count(F.lit(1)).alias("k"), F.min("node").alias("low"), F.max("node").alias("high"),
        F.expr("bit_xor(xxhash64(node))").alias("mark"), F.expr("bit_xor(xxhash64(node, 1))").alias("mark2"),
    )
    several = by_sig.where("low <> high").groupBy("k", "low", "high", "mark", "mark2").agg(F.min(F.struct("sig", "pivot")).alias("x")).select("x.sig", "x.pivot")
    return rows.select("node", "sig").join(several, "sig").select("sig", "pivot", "node")


def one_of_each_class(documents: DataFrame, spec: SetSpec = SetSpec()) -> DataFrame:
    """Rows of `documents` (all columns), one of each class: the one with the smallest doc_id (a null id comes last).

    Of rows that repeat both doc_id and text, one stays. Rows without words are in no class and stay.
    """
    mark = F.xxhash64(F.col("text").cast("string"))
    id_ = F.col("doc_id").cast("long")
    keyed = documents.select(id_.alias("doc_id"), mark.alias("mark"), F.col("text").cast("string").alias("text"))
    rows = stored(_classes(keyed, spec), "classes").where("class is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    winners = rows.groupBy("class").agg(F.min(order).alias("w"))
    keys = rows.join(winners, "class").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("k"), F.min(order == F.col("w")).alias("stays"))
    out_of_place = stored(keys.where("not stays or k > 1"), "dropped")

    own = documents.select(F.struct("*").alias("row"), id_.alias("own_id"), mark.alias("own_mark"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_mark") == F.col("mark"))
    single = own.join(out_of_place, same, "left_anti").select("row")
    hashed = [f"row.`{f.name}`" for f in documents.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    again = own.join(out_of_place.where("stays"), same, "left_semi").groupBy("own_id", "own_mark").agg(F.min_by("row", F.xxhash64(*hashed)).alias("row")).select("row")
    return single.union(again).select("row.*")
