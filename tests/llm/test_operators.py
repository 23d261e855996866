"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import io
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import connect, differences
from tidemark.llm import bytewords, decontaminate, language_id, license_scan, line_dedup, masked_lm, media, mixing, ngram_join, quality, queries, shared, token_files

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def classes(sets, percent):
    own = {i: i for i in sets}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                own[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("spec", [ngram_join.SetSpec(4, 85), ngram_join.SetSpec(5, 80, rare_df=1), ngram_join.SetSpec(3, 60, rare_df=1, frequent_bound=300, bitmap_bits=20, flush=5000)])
def test_join_equals_brute_force(docs, texts, spec):
    sets = {i: shingles(t, spec.words) for i, t in texts.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_classes(docs, spec).collect()}
    want = classes(sets, spec.percent)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_join_of_edited_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 7)):
            w[j] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes({i: shingles(t, 4) for i, t in rows}, 85)
    got = {r.doc_id: r.component_id for r in ngram_join.similarity_classes(df, ngram_join.SetSpec(4, 85, rare_df=4)).collect()}
    assert got == want


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(5)
    for n in (1, 3, 7, 16, 40, 150, 700):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            y = x.copy()
            for _ in range(int(rng.integers(0, max(1, n // 12) + 1))):
                y[rng.integers(0, len(y))] = rng.integers(0, 2**63, dtype=np.uint64)
            y = np.unique(y)
            both = len(np.intersect1d(x, y))
            if 100 * both < 85 * (len(x) + len(y) - both):
                continue
            count = lambda s: np.where(s % np.uint64(5) == 0, 0, (s % np.uint64(97)).astype(np.int64) + 9)
            a, b = (ngram_join.signatures(s, count(s), np.ones(len(s), bool), 85) for s in (x, y))
            assert len(np.intersect1d(a, b))


def test_words_of_a_run():
    p = bytewords.Pieces([b"Ab  c\td", b"", b"\x0bone\x1ctwo three"])
    assert [bytes(p.buf[a:b]) for a, b in zip(p.start, p.end)] == [b"ab", b"c", b"d", b"one\x1ctwo", b"three"] and p.count.tolist() == [3, 0, 2]
    long = [b"x" * 9000, b"x" * 8999 + b"y"]
    h = bytewords.Pieces(long).hash
    assert h[0] != h[1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.label for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 300: 100}


def test_media_round_trip(docs, texts):
    for r in media.described(media.texts_as_images(docs)).collect():
        b = texts[r.doc_id].encode()
        payload = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert np.load(io.BytesIO(r.tile)).shape == (16, 16)


def test_difference_hash_by_hand():
    """Means over the areas behind 8 x 9 samples, one cell at a time."""
    rng = np.random.default_rng(5)
    for shape in ((8, 9), (5, 64), (37, 64), (64, 64)):
        a = rng.integers(0, 256, shape).astype(np.uint8)

        def mean(y0, y1, x0, x1):
            total = 0.0
            for y in range(int(y0), int(np.ceil(y1 - 1e-12))):
                for x in range(int(x0), int(np.ceil(x1 - 1e-12))):
                    total += float(a[y, x]) * (min(y + 1, y1) - max(y, y0)) * (min(x + 1, x1) - max(x, x0))
            return total / ((y1 - y0) * (x1 - x0))

        h, w = shape
        cells = [[mean(r * h / 8, (r + 1) * h / 8, c * w / 9, (c + 1) * w / 9) for c in range(9)] for r in range(8)]
        bits = "".join("1" if round(row[c + 1], 6) > round(row[c], 6) else "0" for row in cells for c in range(8))
        assert media.difference_hash(a) == f"{int(bits, 2):016x}"


def test_media_formats(spark):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    assert (media.decode(media.encode_pgm(a)) == a).all()
    assert (media.decode(b"P2 # note\n4 3\n255\n" + " ".join(map(str, a.ravel())).encode()) == a).all()
    rgb = np.stack([a, a + 1, a + 2], 2)
    assert (media.decode(b"P6 4 3 255\n" + rgb.tobytes()) == rgb).all()
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000])).tolist() == [[0, 255, 0]] and media.decode(b"P1 3 1 1 0 1").tolist() == [[0, 255, 0]]
    rows = b"".join(rgb[i, :, ::-1].tobytes() for i in (2, 1, 0))
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 3, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (media.decode(bmp) == rgb).all()
    x = spark.createDataFrame([(1, bytearray(media.encode_pgm(a))), (2, bytearray(b"nonsense")), (3, None)], "id long, m binary")
    got = {r.id: r for r in media.tiles(x, "id", "m", 2, 2).collect()}
    assert np.load(io.BytesIO(got[1].tile)).tolist() == media.area_resize(a, 2, 2).round().astype(int).tolist() and got[2].error and got[3].error is None


def test_area_means():
    a = np.random.default_rng(1).integers(0, 256, (7, 5)).astype(float)
    fine = np.kron(a, np.ones((3, 4)))
    assert np.allclose(media.area_resize(a, 3, 4), fine.reshape(3, 7, 4, 5).mean((1, 3)))


def test_leaks_are_found_and_nothing_else(spark, docs, texts):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " ".join(t.lower().split())
    want = {(i, b.item_id) for b in items.collect() for i, t in texts.items() if plain(b.text) in plain(t)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == want


def test_reparameterised_questions(spark):
    item = spark.createDataFrame([(1, "Tomorrow the farmer Eve sold 7 apples to her friend Joe for 99 dollars and then Eve went home.")], "item_id long, text string")
    rows = [(1, "Intro. Tomorrow the farmer Anna sold 12 apples to her friend Bob for 30 euros and then Anna went home."), (2, "Tomorrow the farmer Anna sold 12 apples to her friend Bob for 30 euros and then Tom went home."), (3, "Tomorrow the farmer came home.")]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), item).collect()
    assert [(r.doc_id, r.changed > 0) for r in got] == [(1, True)]


def test_leaks_of_edited_short_and_numeric_items(spark):
    base = [f"w{chr(97 + i)}x" for i in range(22)]
    items = [
        (1, " ".join(base)), (2, "Mary paid 3.50 for the bread and then she paid 3.75 for the milk."), (3, "what is the capital of peru"),
        (4, "In Lima 12 Bob 13 Eve 14 Tom 15 Ann 16 Joe 17 Sam 18"), (5, " ".join(f"q{chr(97 + i)}z" for i in range(26)) + " rr ss tt uu vv"),
    ]
    long = items[4][1].split()
    rows = [
        (1, " ".join([*base[:11], "other", *base[12:]])), (2, "Mary paid 4.50 for the bread and then she paid 5.25 for the milk."), (3, "Once someone asked what is the capital of peru and left."),
        (4, "Seen: In Lima 12 Bob 13 Eve 14 Tom 15 Ann 16 Joe 17 Sam 18 today."), (5, " ".join([*long[:15], "inserted", *long[15:]])), (6, "In Lima 22 Bob 23 Eve 24 Tom 25 Ann 26 Joe 27 Sam 28"), (7, "what is the capital of chile"),
    ]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.changed) for r in got) == [(1, 1, 0), (2, 2, 2), (3, 3, 0), (4, 4, 0), (5, 5, 0)]


def test_inconsistent_slots_across_an_insertion(spark):
    item = spark.createDataFrame([(1, "Today the old farmer Eve went out to sell some apples on the market and then the tired Eve came back home.")], "item_id long, text string")
    text = "Today the old farmer {} went out to sell some apples really on the market and then the tired {} came back home."
    rows = [(1, text.format("Anna", "Anna")), (2, text.format("Anna", "Tom"))]
    got = {r.doc_id: (r.windows, r.changed) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), item).collect()}
    assert got[1][0] > max(got.get(2, (0,))[0], 0) and got[1][1] == 1


def test_tokens_equal_the_library(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    start = 0
    for r in token_files.read_tokens(token_files.write_tokens(docs, queries.tokenizer_path(), file_ids=5000)).orderBy("doc_id").collect():
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pieces_are_encoded_as_in_their_text():
    e = token_files.CachedEncoder(queries.tokenizer_path(), size=50)
    rng = np.random.default_rng(2)
    parts = ["a", "B", "'s", " a", " ", "\n", "\nx", "é", "1", " !", ".", "***", "\t", "\x1c", "\x85", "　", "<|endoftext|>", "漢", "'ll"]
    for _ in range(3000):
        t = "".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 9)))
        assert np.frombuffer(e(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 50257, 2**32])
def test_blocks_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype("<u4")
    lengths, got = token_files.read_file(token_files.write_file([n], ids))
    assert lengths.tolist() == [n] and (got == ids).all()


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF2}/documents.parquet"), spark.read.parquet(f"{SF2}/labels.parquet")
    scored = quality.with_scores(docs, quality.fit(docs, labels.where("doc_id % 3 <> 0"))).join(labels.where("doc_id % 3 = 0"), "doc_id")
    r = scored.agg(F.avg(((F.col("quality_score") >= 0.5) == (F.col("quality") == 1)).cast("int")).alias("all"), F.avg(F.when(F.col("quality") == 1, (F.col("quality_score") >= 0.5).cast("int"))).alias("good")).first()
    assert r.all > 0.95 and r.good > 0.97


def test_mixing_and_line_dedup_match_sql(spark):
    con = connect(SF2)
    for name, sql in queries.oracle_sql().items():
        assert differences(queries.queries()[name](spark, SF2).toPandas(), con.sql(sql).df()) == "", name


def test_mixing_comes_near_its_targets(spark):
    x = mixing.mix(spark.read.parquet(f"{SF2}/documents.parquet"))
    for r in x.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("m"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert abs(r.t - r.n) <= r.m and r.over <= 0


def test_mixing_of_repeated_ids_comes_near_its_targets(spark):
    same = [(i % 2, "one two three", "s") for i in range(600)] + [(7, f"w{i} x y", "t") for i in range(300)] + [(None, "a b c", "s")] * 100
    d = spark.createDataFrame(same, "doc_id long, text string, source string").repartition(5)
    for r in mixing.mix(d).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect():
        assert abs(r.t - r.n) <= 3
    rows = mixing.mixture(d)
    assert rows.columns == d.columns and abs(3 * rows.count() - 1.5 * 3000) <= 6
    assert mixing.mixture(d.where("source = 't'").withColumn("text", F.lit(""))).count() == 0


def test_exchanged_rows_are_the_least_of_all(spark):
    """Pseudo-labels against a plain selection over all documents, in several ranges of keys."""
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    known = docs.where("doc_id % 5 = 0").select("doc_id")
    every = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text", "source", "lang")
    rng = np.random.default_rng(1)
    weights = [rng.normal(0, 3, quality.DIMENSIONS + 1), rng.normal(0, 1, quality.META + 1)]
    weights[0][-1] -= 2
    wanted = np.array([6, 9])
    got = quality._exchanged(spark, every, known, weights, 0.9, wanted, 40 * every.count())
    out = {(g, label): {} for g in (0, 1) for label in (0, 1)}
    for r in every.join(known, "doc_id", "left_anti").collect():
        x = quality._views([(r.text or "").encode()], [r.source], [r.lang])[0]
        wide = x.astype(np.float32)
        for g, v in enumerate((wide[: quality.DIMENSIONS], wide[quality.DIMENSIONS :])):
            p = float(quality._sigmoid(quality.logit(weights[g], v[None, :]))[0])
            for label, sure in ((0, 1 - p), (1, p)):
                if sure >= 0.9:
                    out[g, label][r.key] = x.tobytes()
    assert any(out.values())
    for k, rows in out.items():
        assert got[k] == [rows[i] for i in sorted(rows)[: wanted[k[1]]]], k


def test_lm_gradient_and_learning(spark, docs):
    rng = np.random.default_rng(4)
    p = masked_lm.initial(np.ones(masked_lm.CELLS))
    p = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float32) for k, v in p.items()}
    ctx, target = rng.integers(0, 50, (4, 3000)), rng.integers(0, 30, 3000)
    ctx[0] = target  # the answer can be read off one side
    memory = {k: np.full(v.shape, 1e-6, np.float32) for k, v in p.items()}
    before = masked_lm.log_probabilities(p, ctx, target).mean()
    for _ in range(60):
        masked_lm.step(p, memory, ctx, target, 0.1)
    assert masked_lm.log_probabilities(p, ctx, target).mean() > before + 2
    all_ids = np.arange(masked_lm.CELLS)
    assert np.exp(masked_lm.log_probabilities(p, np.repeat(ctx[:, :1], len(all_ids), 1), all_ids)).sum() == pytest.approx(1, abs=1e-3)
    r = masked_lm.scores(docs).agg(F.sum("sum_logp").alias("s"), F.sum("n_tokens").alias("n")).first()
    unigram = masked_lm.word_counts(docs).agg(F.sum(F.col("n") * F.log(F.col("n") / r.n))).first()[0]
    assert r.s > unigram + 0.02 * r.n


def test_lm_trains_on_every_token(spark):
    d = spark.createDataFrame([(i, "one two three four " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    vocabulary, v = masked_lm.train(d, masked_lm.word_counts(d))
    cells, share, found = vocabulary.look_up(bytewords.Pieces([b"one two three four"]).hash)
    untrained = masked_lm.initial(np.ones(masked_lm.CELLS))["member_w"]
    moved = np.abs(masked_lm.shaped(v)["member_w"] - untrained).reshape(masked_lm.CELLS, -1).max(1)
    assert moved[cells].min() > 0 and not share.any() and found.all()


def test_lm_equals_brute_force(spark):
    """Every token's probability by hand, with a broadcast list that lacks most words."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 200) % 5000) for _ in range(60)] + ["a", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = masked_lm.word_counts(d)
    vocabulary, v = masked_lm.train(d, counts, head_bound=1000)
    p = masked_lm.shaped(v)
    n = {}
    for t in texts:
        for x in (t or "").split():
            n[x] = n.get(x, 0) + 1
    h = dict(zip(n, bytewords.Pieces([" ".join(n).encode()]).hash.tolist()))
    assert {r.word & (2**64 - 1): r.n for r in counts.collect()} == {h[x]: k for x, k in n.items()}
    known = sorted(n, key=lambda x: (-n[x], h[x]))[: masked_lm.KNOWN]
    assert len(vocabulary.words) < len(n)
    listed = set(vocabulary.words.tolist())
    cell = {x: masked_lm.KNOWN + h[x] % masked_lm.HASHED for x in n} | {x: i for i, x in enumerate(known) if h[x] in listed}
    size = {}
    for x, k in n.items():
        size[cell[x]] = size.get(cell[x], 0) + k
    got = {r.doc_id: r for r in masked_lm.scores(d, head_bound=1000).collect()}
    for i in (0, 17, 60):
        words, total = texts[i].split(), 0.0
        for j, x in enumerate(words):
            around = [words[j + k] if 0 <= j + k < len(words) else None for k in (-2, -1, 1, 2)]
            ids = np.array([[masked_lm.CELLS if y is None else cell[y]] for y in around])
            every = masked_lm.log_probabilities(p, np.repeat(ids, masked_lm.CELLS, 1), np.arange(masked_lm.CELLS))
            assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
            total += float(every[cell[x]]) + np.log(n[x] / size[cell[x]])
        assert (got[i].n_tokens, got[i].sum_logp) == (len(words), pytest.approx(total, rel=1e-5))
    assert (got[61].sum_logp, got[62].mean_logp) == (0.0, None)


def test_lm_does_not_depend_on_partitions(docs):
    few, many = ({r.doc_id: r.mean_logp for r in masked_lm.scores(docs.repartition(k), shard_tokens=20000, head_bound=2000).collect()} for k in (2, 8))
    assert few.keys() == many.keys() and max(abs(few[i] - many[i]) for i in few if few[i] is not None) < 1e-6


def test_phrases_equal_greedy_parsing():
    model = language_id.Model({"a": b"the cat sat on the mat", "b": b"der hund lag im haus"}, {})

    def greedy(text, known):
        n, i = 0, 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i : j + 1] in known:
                j += 1
            n, i = n + 1, j
        return n

    for t in (b"the hat", b"cat cat", b"haus der", b"zzz the", b"q"):
        assert model.phrases([t])[0].tolist() == [greedy(t, b"the cat sat on the mat"), greedy(t, b"der hund lag im haus")]


def test_phrases_of_long_texts_are_one_greedy_parse():
    known = {"a": b"the cat sat on the mat and ran", "b": b"der hund lag im haus und lief"}
    model = language_id.Model(known, {})
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice(np.frombuffer(b"thecat sonmdrugl", np.uint8), n)) for n in (0, 1, 127, 1023, 1024, 1025, 1152, 3000, 9000)] + [b"the cat sat on the mat and ran " * 120, b"a" * 3000]

    def greedy(text, own):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i : j + 1] in own:
                j += 1
            n, i = n + 1, j
        return n

    assert model.phrases(texts).tolist() == [[greedy(t, known["a"]), greedy(t, known["b"])] for t in texts]


def test_language_needs_letters_and_takes_many_languages(spark):
    rng = np.random.default_rng(6)
    stems = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(12)] for k in range(100)}
    rows = [(i, " ".join(rng.choice(w, 60)), lang) for i, (lang, w) in enumerate(list(stems.items()) * 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(d.where("doc_id < 200"), table_bytes=1 << 25)
    got = language_id.predict_languages(d.where("doc_id >= 200"), model).join(d.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 95
    odd = spark.createDataFrame([(1, "\u00bd \u00b2 \u2167 12"), (2, "\u0301\u0301"), (3, "")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in language_id.predict_languages(odd, model).collect()} == {("und", 0.0)}


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    got = language_id.predict_languages(docs, language_id.fit(docs.where(~language_id.held_out()))).join(docs, "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("acc"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.acc > 0.98 and 0 <= r.lo and r.hi <= 1


def test_language_with_little_text(spark):
    d = spark.read.parquet(f"{SF2}/documents.parquet").where("text is not null and lang is not null")
    train, test = d.where(~language_id.held_out()), d.where(language_id.held_out())
    few = train.where("lang = 'en'").orderBy("doc_id").limit(20).withColumn("text", F.substring("text", 1, 100))
    model = language_id.fit(train.where("lang <> 'en'").unionByName(few))
    rows = language_id.predict_languages(test, model).join(test.select("doc_id", "lang"), "doc_id").select("lang", "lang_pred").collect()
    for lang in ("en", "de", "fr", "es"):
        own = [r.lang_pred == lang for r in rows if r.lang == lang]
        assert own and sum(own) >= 0.9 * len(own), lang


def test_licenses(spark, docs, texts):
    got = {(r.doc_id, r.license) for r in license_scan.license_blocks(docs).collect()}
    names = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0-line", "Released under the MIT License.": "MIT-line", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-line", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    assert got == {(i, n) for i, t in texts.items() for s, n in names.items() if s in t}
    rows = [(1, "Licensed under the Apache License, Version 1.1."), (2, "Released under the MIT licence of our firm"), (3, license_scan.TEMPLATES["MIT"][0].replace("sublicense", "sublicense, rent").replace(". ", ".\n")), (4, "He lost his driving license in the public domain."), (5, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.")]
    found = {r.doc_id: r for r in license_scan.license_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.license for i, r in found.items() if i != 2} == {3: "MIT", 5: "GPL-2.0"} and "rent" in found[3].differences


def test_wrapped_and_several_licenses(spark):
    import textwrap

    wrapped = lambda name: "\n".join(textwrap.wrap(license_scan.TEMPLATES[name][0], 75))
    full = ("GPL-3.0", "MIT", "BSD-3-Clause", "Apache-2.0", "ISC", "Unlicense", "MPL-2.0")
    rows = [(i, "Some prose of the author before.\n\n" + wrapped(n) + "\n\nAnd more prose after it.") for i, n in enumerate(full)]
    rows += [(20, "Released under CC BY-SA 4.0."), (21, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."), (22, wrapped("MIT") + "\n\n" + wrapped("GPL-2.0") + "\n\n" + wrapped("GPL-3.0") + "\n" + wrapped("MIT"))]
    got = {}
    for r in license_scan.license_blocks(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "block_start").collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert got == {i: [n] for i, n in enumerate(full)} | {20: ["CC-BY-SA-4.0"], 21: ["MIT-line", "Apache-2.0-line"], 22: ["MIT", "GPL-2.0", "GPL-3.0", "MIT"]}


def test_line_dedup_equals_brute_force(docs, texts):
    seen, want = set(), {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        full = [k for k, x in enumerate(lines) if x]
        gone = set()
        for a in range(len(full) - 2):
            w = tuple(lines[k] for k in full[a : a + 3])
            gone |= set(full[a : a + 3]) if w in seen else set()
            seen.add(w)
        want[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()} == want


def test_passages_equal_brute_force(docs, texts):
    seen, want = set(), {}
    for i in sorted(texts):
        found = [(m.start(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[i] or "")]
        starts, w, gone = [a for a, _ in found], [b for _, b in found], set()
        for a in range(len(w) - 49):
            gone |= set(range(a, a + 50)) if tuple(w[a : a + 50]) in seen else set()
            seen.add(tuple(w[a : a + 50]))
        at, full = 0, []
        for line in (texts[i] or "").split("\n"):
            full += [(line, {k for k, s in enumerate(starts) if at <= s < at + len(line)})] if line else []
            at += len(line) + 1
        for a in range(len(full) - 2):
            key = ("lines", *(x for x, _ in full[a : a + 3]))
            gone |= set.union(*(x for _, x in full[a : a + 3])) if key in seen else set()
            seen.add(key)
        want[i] = (len(w), len(gone), [x for k, x in enumerate(w) if k not in gone])
    got = {r.doc_id: (r.n_words, r.n_removed, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in line_dedup.without_passages(docs).collect()}
    assert got == want


def test_passages_in_few_lines_and_inside_lines(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"Start {passage} end"), (2, passage), (3, f"one\ntwo {passage}\nthree"), (4, f"a b\n{passage}\nc d"), (5, " ".join(passage.split()[:49])), (6, None)]
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, rows[0][1]), 2: (50, ""), 3: (50, "one\ntwo\nthree"), 4: (50, "a b\nc d"), 5: (0, rows[4][1]), 6: (0, None)}


def test_pipeline_equals_its_stages(spark, docs, texts):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = shared.stored(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
        now = {r.doc_id for r in kept.select("doc_id").collect()}
        assert now <= before
        if name == "near_duplicates":
            own = classes({i: shingles(texts[i], 5) for i in before}, 80)
            assert now == {i for i in before if own[i] == i}
    mixed = corpus_pipeline.mix_sources(spark, kept, SF)
    assert mixed.columns == docs.columns
    rows = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert len(rows) == mixed.count() and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_items_of_one_template_are_one_form(spark):
    """Rows grow with the documents, not with documents times items, and the forms' members are known."""
    text = "A train with {} wagons leaves the station at noon and carries {} sacks of grain to the harbour every day"
    items = spark.createDataFrame([(i, text.format(3 + i, 500 + i)) for i in range(60)] + [(100, text.format(7, 7)), (101, text.format(9, 9))], "item_id long, text string")
    docs = spark.createDataFrame([(i, "Intro words here. " + text.format(1000 + i, 2 + i) + " and more after that.") for i in range(40)] + [(99, text.format(4, 4))], "doc_id long, text string")
    rows = decontaminate.leaks(docs, items).collect()
    assert {r.doc_id for r in rows} == {*range(40), 99} and len(rows) <= 2 * 41
    assert {(r.item_id, r.n_items) for r in rows} == {(0, 60), (100, 2)}
    assert {r.doc_id for r in rows if r.item_id == 100} == {99}
    assert decontaminate.item_forms(items).groupBy("form").count().orderBy("count").select("count").collect() == [(2,), (60,)]


def test_passages_that_overlap_repeat_themselves_and_share_anchors(spark):
    """Edited copies, periods within a text, ranges that begin and end anywhere: equal to brute force, also with bitmaps that are full."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(900)]
    texts = {0: "tick tock " * 90, 1: " ".join(base), 2: "tock tick " * 40 + " ".join(base[100:260])}
    for i in range(3, 40):
        a = rng.randrange(700)
        part = base[a : a + rng.randrange(40, 200)]
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = f"edit{i}"
        texts[i] = " ".join([f"own{i}"] * rng.randrange(3) + part + part[: rng.randrange(120)] + base[5:70] * rng.randrange(2))
    seen, want = set(), {}
    for i in sorted(texts):
        w, gone = texts[i].split(), set()
        for a in range(len(w) - 49):
            gone |= set(range(a, a + 50)) if tuple(w[a : a + 50]) in seen else set()
            seen.add(tuple(w[a : a + 50]))
        want[i] = (len(gone), [x for k, x in enumerate(w) if k not in gone])
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(5)
    for bits in (1 << 20, 64):
        got = {r.doc_id: (r.n_removed, r.text.split()) for r in line_dedup.without_passages(df, bits=bits).collect()}
        assert got == want


def _other_values(text, rng):
    """The text with its numbers, names and units changed, each value to one other; words that begin sentences are changed where they are names elsewhere."""
    value = {}

    def other(m):
        w = m.group()
        if w[0].isdigit():
            return value.setdefault(w, str(rng.randrange(10 ** len(w), 10 ** (len(w) + 1))))
        if w in decontaminate.NUMBERS:
            return value.setdefault(w, rng.choice([x for x in decontaminate.NUMBERS if x != w]))
        if w[0].isupper():
            return value.setdefault(w, "N" + "".join(rng.choice("aeiou") + rng.choice("lmnr") for _ in range(4)))
        return w

    return re.sub(r"\w+", other, text)


def test_all_items_with_other_values_are_found(spark, docs, texts):
    """Every capitalised word, number and number word of every item is another one, sentence openings included; clean documents stay clean."""
    rng = random.Random(3)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = items.collect()
    made = [(100_000 + r.item_id, f"Some words come first. {_other_values(r.text, rng)} And some come last.") for r in rows]
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(made, "doc_id long, text string"), items).collect()}
    assert len({(100_000 + r.item_id, r.item_id) for r in rows} & found) >= 0.9 * len(rows)
    assert all(d - 100_000 == i for d, i in found)


def test_names_that_open_sentences_number_words_and_other_scripts(spark):
    items = [
        (1, "Tom has 3 apples. Tom buys 4 more at the market. How many apples does Tom have now?"),
        (2, "Bob runs 5 km every day before he goes to work."),
        (3, "A farmer named Ольга keeps twenty cows and sells three of them each year."),
        (4, "The total is 7. The rest of it is kept by the old miller."),
    ]
    rows = [
        (1, "Ann has 12 apples. Ann buys 40 more at the market. How many apples does Ann have now?"),
        (2, "Jim runs 7 km every day before he goes to work."),
        (3, "A farmer named Борис keeps twelve cows and sells seven of them each year."),
        (4, "The total is 9. A rest of it is kept by the old miller."),
        (5, "Ann has 12 apples. Joe buys 40 more at the market, and that was all for one day in town."),
        (6, "Some day before he goes to work he runs."),
    ]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4)}
    assert {r.doc_id: r.coverage for r in got}[1] == 1.0
    assert {r.doc_id: r.changed > 0 for r in got} == {1: True, 2: True, 3: True, 4: False}  # of 4, the part after "rest" is as it was


def test_encoder_looks_at_each_character_only_where_rare_white_space_is():
    """Texts are searched for plain strings; the pattern runs only where white space other than space and line feed stands."""
    import re

    import numpy as np

    e = token_files.CachedEncoder(queries.tokenizer_path())
    tried = []
    pair, e.white_pair = e.white_pair, lambda text: tried.append(text) or pair(text)
    apart = ["a  b", "a\n\nb", "a \nb", "a\n b", "a<|endoftext|>b", "a\t b", "a\u3000\u2009b", "é\xa0\n"]
    for text in [*apart, "plain words, and\nlines", "a\tb", "é\xa0b", "日\u3000b", "", " ", "\n", "a\x1c b"]:
        assert e.whole(text) == (text in apart), text
        assert e(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert set(tried) == {"a\t b", "a\u3000\u2009b", "é\xa0\n", "a\tb", "é\xa0b", "日\u3000b"}
    long = re.sub("x", "\u0251\u0252", "x" * 200)  # more ids than there are ready-made packers
    assert e(long) == np.array(e.tokenizer.encode(long, add_special_tokens=False).ids, "<u4").tobytes()


def test_new_words_are_kept_without_the_marks_that_follow_them():
    e = token_files.CachedEncoder(queries.tokenizer_path())
    for text, kept in (("see ntherings, now", {"ntherings"}), ("see ntherings, now", {"ntherings", "ntherings,"}), ("x éàthrow. y", {"éàthrow"}), ("a\nThering, b", {"\nThering,"})):
        assert e(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
        assert kept <= set(e.young) and (len(kept) > 1 or not {k + c for k in kept for c in ",."} & set(e.young)), text


def test_quality_views_are_fitted_in_tasks(spark, monkeypatch):
    """The driver fits nothing; weights and scales are those of a plain fit of all labelled rows."""
    docs, labels = (spark.read.parquet(f"{SF2}/{t}.parquet") for t in ("documents", "labels"))
    plain, here = quality.logistic, []
    monkeypatch.setattr(quality, "logistic", lambda *a: here.append(1) or plain(*a))  # tasks have a list of their own
    model = quality.fit(docs, labels, rounds=0)
    assert not here
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y")).where("doc_id is not null")
    rows = docs.join(known, "doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("long"), F.lit(5)), "doc_id").collect()
    x = np.concatenate([quality._views([(r.text or "").encode()], [r.source], [r.lang]) for r in rows]).astype(np.float32)
    y, held = np.array([float(r.y) for r in rows]), np.arange(len(rows)) % 5 == 4
    for got, scale, v in zip((model.content, model.metadata), model.scales, (x[:, : quality.DIMENSIONS], x[:, quality.DIMENSIONS :])):
        w = plain(v, y, ~held)
        assert np.abs(got - w).max() < 1e-4 and np.abs(np.array(scale) - quality.platt(quality.logit(w, v[held]), y[held])).max() < 1e-3
