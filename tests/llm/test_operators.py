"""Each operator against brute force, and on nulls, repeats, empty tables and clashing columns."""

import hashlib
import random
import sys
import zlib
from datetime import UTC, datetime

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framecloud.llm import (
    arrow_ids,
    bpe,
    chat,
    decontaminate,
    order_minhash,
    rp_forest,
    shard_tree,
    token_rollup,
    toxicity,
    warc,
)
from framecloud.llm.components import components
from framecloud.llm.queries import QUERIES, SQL
from framecloud.llm.storage import new_folder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = "a very long word " * 400 + "x" * 5000
TEXTS = [None, "", "  ", "plain words here", "plain words here", "don't  stop\n\n <|endoftext|> é日本\x1c", LONG]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeats, a long text and a column that clashes with results."""
    rows = [(i, t, "s", "en", "kept") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, "kept"), (3, TEXTS[3], "s", "en", "kept")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, ids string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def folder(spark):
    return lambda: new_folder(spark, "test")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tiny, name):
    assert compare(QUERIES[name](spark, tiny), connect(tiny), SQL[name]) is None


def test_shards_grow_only_into_the_new_one(odd, none):
    tree = shard_tree.even_tree(16)
    rows = shard_tree.assign(odd, tree, tree.grown(16)).collect()
    assert len(rows) == odd.count() and shard_tree.assign(none, tree).count() == 0
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_weight_moves_rows_only_of_its_subtree(spark):
    light = shard_tree.Tree({"a": {"r": {0: 1, 1: 1}}, "b": {"r": {2: 1, 3: 1}}})
    heavy = shard_tree.Tree({"a": {"r": {0: 1, 1: 1}}, "b": {"r": {2: 1, 3: 3}}})
    key = F.col("id").cast("string")
    rows = spark.range(4000).select(shard_tree.shard_of(key, light).alias("x"), shard_tree.shard_of(key, heavy).alias("y")).collect()
    assert all(r.x == r.y for r in rows if r.y in (0, 1))
    assert 0.55 < sum(r.y > 1 for r in rows) / 4000 < 0.78


def test_warc_round_trip_over_small_ranges(spark, folder):
    inner = warc.member(warc.record(9, None, b"z" * 200, "0", "response", None, "2000-01-01T00:00:00Z")).decode("latin-1")
    pages = [(1, "http://a", "p" * 150), (2, None, "p" * 150), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", inner), (None, "u", "p" * 150), (1, "http://a", "p" * 150)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, payload string")
    manifest = warc.write_archives(warc.with_record_types(df), folder(), datetime(2020, 1, 1, tzinfo=UTC))
    rows = warc.read_archives(warc.splits(manifest, 97), payload=True).collect()
    assert len(rows) == len(pages)
    html = {p[0]: (p[2] or "").encode() for p in pages}
    for r in rows:
        assert r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest() and r.payload_bytes == len(html[r.page_id])
        assert r.record_type == ("revisit" if r.page_id in (2, None) else "response")
        assert r.refers_to == (1 if r.page_id in (2, None) else None)
        assert r.record_type == "revisit" or bytes(r.payload) == html[r.page_id]
    empty = warc.write_archives(warc.with_record_types(df.where("false")), folder())
    assert warc.read_archives(warc.splits(empty)).count() == 0


def test_encoders_equal_the_library():
    random.seed(1)
    letters = " \n\t'’.,s tredvmlé\xa0 01abcABC<|endoftext|>日\x1c_-Σİ̱"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += [t or "" for t in TEXTS]
    for encode, path in ((bpe.load(BYTE).encode, BYTE), (arrow_ids.word_encoder(WORD), WORD)):
        library = Tokenizer.from_file(path)
        assert [i.tolist() for i in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    small = arrow_ids.FragmentEncoder(bpe.ForcedBoundaries(bpe.token_bytes(Tokenizer.from_file(BYTE))).split, lambda w: [[len(x)] for x in w], bpe.segments, 3, 50)
    assert [sum(i) for i in small(texts)] == [len(t.encode()) for t in texts]


def test_words_are_encoded_together():
    texts = [f"Word{i:x}é.{i}" for i in range(20_000)] + ["日本 <|ENDOFTEXT|> x<|endoftext|>y", "É\xa0x\x85'S\x0b½"]
    encoder, calls = arrow_ids.word_encoder(WORD), []
    encoder([""])
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        ids = list(encoder([" ".join(texts)]))
    finally:
        sys.setprofile(None)
    assert ids[0].tolist() == Tokenizer.from_file(WORD).encode(" ".join(texts), add_special_tokens=False).ids
    assert len(calls) < len(texts) / 10


def test_words_in_any_chunks_equal_the_library():
    texts = [f"a{chr(c)}B' {chr(c)}'S.{chr(c)}1" for c in range(256)] + [TEXTS[5], "word. " * 100, LONG, "", " "]
    want = [t.ids for t in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    for chunk in (1, 50, 10_000_000):
        assert [i.tolist() for i in arrow_ids.WordEncoder(WORD, chunk)(texts)] == want


def test_bpe_columns(odd, none):
    rows = bpe.decode(bpe.encode(odd, BYTE, intact="ok"), BYTE).collect()
    assert all(r.ok and r.decoded == (r.text or "") for r in rows) and len(rows) == odd.count()
    assert bpe.encode(none, BYTE).count() == 0


def test_arrow_ids_read_back(odd, none, folder):
    manifest = arrow_ids.write_sequences(odd, folder(), WORD, 2, length=16, batch=4, partitions=3)
    got = sorted(arrow_ids.read_documents(manifest).collect(), key=lambda r: r.start)
    library, start = Tokenizer.from_file(WORD), 0
    want = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    for row, r in zip(want, got, strict=True):
        ids = library.encode(row.text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)
    file = arrow_ids.SequenceFile(manifest.first().ids_path)
    ids, mask = file.sequence(0)
    assert len(ids) == len(mask) == 16
    assert arrow_ids.read_documents(arrow_ids.write_sequences(none, folder(), WORD, 2)).count() == 0


def test_each_file_of_ids_is_read_in_a_task_of_its_own(spark, folder):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    manifest = arrow_ids.write_sequences(docs, folder(), WORD, 2, partitions=3)
    tasks = arrow_ids.read_documents(manifest).groupBy(F.spark_partition_id()).count()
    assert manifest.count() == tasks.count() == 3


@pytest.mark.parametrize("kind, values", [("float", 2_000_000), ("double", 40)])
def test_nearest_finds_all_of_few(spark, folder, monkeypatch, kind, values):
    monkeypatch.setattr(rp_forest, "GROUP_VALUES", values)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(2).tolist(), "x") for i in range(60)]
    rows += [(100, None, "x"), (101, [0.0] * 4, "x"), (102, [float("nan")] * 4, "x"), (103, [None, 1.0, 1.0, 1.0], "x"), (150, rows[7][1], "x"), (150, rows[7][1], "x")]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, score string")
    got = rp_forest.nearest(df, F.col("vec_id") % 50 == 0, folder(), search=1000).collect()
    stored = np.float32 if kind == "float" else np.float64
    vectors = {r[0]: stored(r[1]).astype(float) for r in rows if r[0] not in (100, 101, 102, 103)}
    cos = lambda a, b: a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)
    for q in (0, 50, 150):
        best = sorted((-round(cos(vectors[q], v), 12), i) for i, v in vectors.items() if i != q)[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == [i for _, i in best]
        assert np.allclose([r.score for r in mine], [-s for s, _ in best])
    assert rp_forest.nearest(df.where("false"), F.lit(True), folder()).count() == 0


def test_only_repeated_vectors_are_ranked_by_id(spark, folder, monkeypatch):
    ranked, first_k = [], rp_forest.first_k

    def counted(df, *args, **named):
        ranked.append(df.count())
        return first_k(df, *args, **named)

    monkeypatch.setattr(rp_forest, "first_k", counted)
    rows = [(k, [1.0, float(k)]) for k in range(40)] + [(100 + k, [1.0, 3.0]) for k in range(5)] + [(8, [1.0, 8.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = rp_forest.nearest(df, F.col("vec_id").isin(3, 8, 104), folder(), search=1000).collect()
    assert ranked == [7]  # 3, 100 to 104 and 8, which stands twice but is one
    ids = lambda q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
    assert ids(3) == [100, 101, 102, 103, 104] and ids(104) == [3, 100, 101, 102, 103]
    assert ids(8) == [9, 7, 10, 11, 6]


@pytest.mark.parametrize("values", [1, 40, 2_000_000])
def test_leaves_compared_at_once_equal_brute_force(monkeypatch, values):
    monkeypatch.setattr(rp_forest, "GROUP_VALUES", values)
    rng = np.random.default_rng(5)
    stored, asking = rng.normal(size=(90, 4)), rng.normal(size=(25, 4))
    leaf = np.sort(rng.integers(10, 30, 90))
    visits = [sorted(rng.choice(np.arange(8, 32), n, replace=False).tolist()) for n in rng.integers(1, 15, 25)]
    scores, places = rp_forest.nearest_rows(asking, pa.array(visits, pa.list_(pa.int64())), stored, leaf, 6)
    for q, leaves in enumerate(visits):
        near = np.where(np.isin(leaf, leaves), stored @ asking[q], -np.inf)
        want = [i for i in np.argsort(-near)[:6] if np.isfinite(near[i])]
        found = places[q] >= 0
        assert set(places[q][found]) == set(want)
        assert np.allclose(scores[q][found], near[places[q][found]])


def test_forest_recall(spark, tiny, folder):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in QUERIES["op5_rp_forest"](spark, tiny).collect()}
    rows = df.collect()
    x = np.array([r.embedding for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        near = x @ x[q]
        near[q] = -9
        want |= {(ids[q], i) for i in ids[np.argsort(-near)[:5]]}
    assert len(got & want) / len(want) >= 0.9


def test_rollup_batches_count_once(spark, odd, folder):
    counted = token_rollup.count_tokens(odd, BYTE)
    side = token_rollup.side(F.col("source"), F.col("lang"), F.lit("v1"), F.col("tokens"))
    insert = counted.select(token_rollup.nothing().alias("before"), side.alias("after"))
    rollup = token_rollup.Rollup(spark, folder())
    assert rollup.totals().count() == 0
    assert [rollup.commit(1, insert), rollup.commit(1, insert)] == [True, False]
    total = sum(len(Tokenizer.from_file(BYTE).encode(r.text or "").ids) for r in odd.collect())
    assert sum(r.tokens for r in rollup.totals().collect()) == total
    rollup.commit(2, insert.select(F.col("after").alias("before"), F.col("before").alias("after")))
    assert rollup.totals().count() == 0 and rollup.committed() == [1, 2]


def test_chats_keep_only_maximal_ones(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "a"), (4, 1, None, None), (None, 0, "user", "q <|im_end|>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(got) == {2, 4, None} and got[2].copies == 2
    assert got[4].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n"
    parts = sorted(chat.format_chats(df, 1).where("conv_id = 2").collect(), key=lambda r: r.part)
    assert "".join(p.rendered for p in parts) == got[2].rendered
    assert chat.format_chats(df.where("false")).count() == 0


def test_toxicity_learns_stems_and_keeps_rows(spark, odd, none):
    random.seed(2)
    clean = [" ".join(random.choice("the of sun tree river walks slowly under".split()) for _ in range(30)) for _ in range(120)]
    toxic = [t + " " + random.choice(["idiot", "idiots", "idiotic"]) + " tree" for t in clean[:40]]
    model = toxicity.train(clean + toxic, [0] * 120 + [1] * 40)
    score = toxicity.Scorer(*model)
    assert score("you idiotical tree") > 0.7 > score("the tree of the river")
    assert 0 <= score(None) == score("") <= 1
    rows = toxicity.score(odd, model, name="ids").collect()
    assert len(rows) == odd.count() and all(0 <= r.ids <= 1 for r in rows)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train([], [])[1] == 0.0
    labels = spark.createDataFrame([(3, 1), (None, 0)], "doc_id bigint, toxic int")
    assert toxicity.training_rows(odd, labels, F.lit(True)).count() == 1


def test_training_rows_survive_long_texts_and_clashing_labels(spark):
    rows = [(k, f"text {k}") for k in range(12)] + [(20, "x" * 20_000), (21, "word " * 5_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = [(k, k % 2) for k in range(12)] + [(20, 1), (21, 0), (5, 0), (6, 0)]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.training_rows(docs, labels, F.lit(True)).collect()}
    assert got == {k: k % 2 for k in range(12) if k != 5}
    with pytest.raises(ValueError, match="are labelled 1"):
        toxicity.fit(docs, labels.where("toxic = 1"), F.lit(True))
    assert toxicity.fit(docs, labels.where("false"), F.lit(True))[1] == 0.0


def test_leaks_verbatim_and_edited(spark, folder):
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(30)]
    noise = lambda n: " ".join(word() for _ in range(n))
    edited = [w if k % 6 else word() for k, w in enumerate(item)]
    docs = [(1, f"{noise(50)} {' '.join(item)} {noise(20)}"), (2, f"{noise(20)} {', '.join(edited).upper()}!"), (3, noise(100)), (4, None), (5, ""), (1, " ".join(item))]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, leaks string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None)], "item_id bigint, text string")
    got = sorted(decontaminate.leaks(df, items, folder()).collect())
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7), (1, 7), (2, 7)]
    assert {(r.first_word, r.last_word) for r in got[:2]} == {(50, 79), (0, 29)} and got[2].score < 1
    assert decontaminate.with_leaks(df, items, folder()).where("size(leaks) = 0").count() == 3
    assert decontaminate.leaks(df, items.where("false"), folder()).count() == 0


@pytest.mark.parametrize(("step", "copies"), [(4, 1), (5, 1), (4, 1000), (5, 1000)])
def test_leaks_of_one_edited_copy_alone(spark, folder, step, copies):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(40)]
    edited = " ".join(w if (k + 1) % step else word() for k, w in enumerate(item))
    kept = sum((k + 1) % step > 0 for k in range(40))
    first = min(k for k in range(40) if (k + 1) % step)
    df = spark.createDataFrame([(k, f"before {edited} after") for k in range(copies)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    got = decontaminate.leaks(df, items, folder()).collect()
    assert sorted(r.doc_id for r in got) == list(range(copies))
    # The last word is an edited one, so the alignment ends before it.
    score = (2 * kept - (40 - kept - 1)) / 80
    assert {(round(r.score, 9), r.first_word) for r in got} == {(score, 1 + first)}
    assert decontaminate.with_leaks(df, items, folder()).where("size(leaks) = 1").count() == copies


def test_leaks_of_several_items(spark, folder):
    texts = {k: " ".join(f"w{k}x{j}" for j in range(8)) for k in range(6)}
    items = spark.createDataFrame(list(texts.items()), "item_id bigint, text string")
    df = spark.createDataFrame([(0, " and ".join(texts.values())), (1, texts[3]), (2, "none of them")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(df, items, folder()).collect())
    assert got == [(0, k) for k in range(6)] + [(1, 3)]
    rows = decontaminate.with_leaks(df, items, folder()).collect()
    assert {r.doc_id: sorted(x.item_id for x in r.leaks) for r in rows} == {0: list(range(6)), 1: [3], 2: []}


def test_alignment_equals_full_table():
    random.seed(5)
    for _ in range(150):
        a, b = ([random.randint(0, 6) for _ in range(random.randint(1, 25))] for _ in range(2))
        band = random.randint(0, 12)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                both = table[i, j] + 1 if x == y and abs(i - j) <= band else 0
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], both)
        assert order_minhash.aligned(a, b, band) == table[-1, -1]


@pytest.mark.parametrize("block", [1_000_000, 400])
def test_near_duplicates_equal_brute_force(spark, folder, monkeypatch, block):
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    random.seed(6)
    words = [f"w{k}" for k in range(3000)]
    base = [[random.choice(words) for _ in range(120)] for _ in range(4)]
    texts = [None, "", " ", "one two", "one two"]
    for b in base:
        for _ in range(14):
            t = list(b)
            for _ in range(random.randint(0, 9)):
                t[random.randrange(len(t))] = random.choice(words)
            texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(df, folder()).collect()}
    shingles = [order_minhash.shingles_of(t) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if order_minhash.similarity(shingles[i], shingles[j]) >= 0.8 and want[i] != want[j]:
                lo, hi = sorted((want[i], want[j]))
                want = [lo if w == hi else w for w in want]
    assert got == dict(enumerate(want))
    assert order_minhash.first_of_each_class(df, folder()).count() == len(set(want))
    assert order_minhash.near_duplicates(df.where("false"), folder()).count() == 0


def test_cells_hold_every_pair_of_labels_once_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 500)
    # One pick: 300 texts of a component, 40 texts on their own.
    placed = [(1, k, 10, 0 if k < 300 else k) for k in range(340)]
    rows = order_minhash.cells(spark.createDataFrame(placed, "key bigint, node bigint, n bigint, label bigint")).collect()
    met = {}
    for r in rows:
        met.setdefault((r.low, r.high), {}).setdefault(r.own, []).append((r.node, r.label))
    pairs = []
    for (low, high), sides in met.items():
        assert set(sides) <= {low, high}
        for a, x in sides.get(low, []):
            pairs += [tuple(sorted((a, b))) for b, y in sides.get(high, []) if x != y and (low != high or a < b)]
    want = {(a, b) for a in range(340) for b in range(max(a + 1, 300), 340)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert len(rows) <= 40 * 7 + 300  # and not 40 * 300


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 9), (5, 5), (None, 1)] + [(k, k + 1) for k in range(20, 40)], "a bigint, b bigint")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | dict.fromkeys(range(20, 41), 20)


def test_pipeline_keeps_clean_documents(spark, tiny):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, tiny).collect()
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert 0 < len(rows) < docs.count() and all(r.decodes for r in rows)
    kept = {r.doc_id for r in rows}
    leaked = {r.doc_id for r in QUERIES["op1_decontaminate"](spark, tiny).collect()}
    assert not kept & leaked


def test_one_of_each_class_with_null_and_repeated_ids(spark, folder):
    random.seed(9)
    fresh = lambda: [f"w{random.randrange(10**6)}" for _ in range(60)]
    near = lambda t: [*t[:-1], f"w{random.randrange(10**6)}"]
    nulls, shared, led, copied = ([fresh() for _ in range(n)] for n in (5, 4, 2, 1))
    rows = [(None, t) for t in nulls] + [(7, t) for t in shared]
    # Two classes led by one id, each with a near copy under another; one class of null and known ids.
    rows += [(3, led[0]), (3, led[1]), (20, near(led[0])), (21, near(led[1]))]
    rows += [(None, copied[0]), (30, near(copied[0])), (None, nulls[0]), (7, shared[0])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.text) for r in order_minhash.first_of_each_class(df, folder()).collect())
    want = [(None, t) for t in nulls] + [(7, t) for t in shared] + [(3, t) for t in led] + [rows[14]]
    assert got == sorted((str(i), " ".join(t)) for i, t in want)


def test_nearest_keeps_ids_beside_a_repeated_one(spark, folder):
    same, far = [1.0, 2.0, 3.0], [[3.0, -1.0, float(k)] for k in range(8)]
    rows = [(1, same)] * 50 + [(i, same) for i in range(2, 8)] + [(20 + k, v) for k, v in enumerate(far)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = rp_forest.nearest(df, F.col("vec_id").isin(1, 7), folder(), search=1000).collect()
    for q, want in ((1, [2, 3, 4, 5, 6]), (7, [1, 2, 3, 4, 5])):
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def insults():
    """A model of clean texts and of texts with one insult each, and a filler of letters."""
    random.seed(2)
    clean = [" ".join(random.choice("the of sun tree river walks slowly under".split()) for _ in range(30)) for _ in range(120)]
    toxic = [t + " " + random.choice(["idiot", "idiots", "idiotic"]) + " tree" for t in clean[:40]]
    return toxicity.Scorer(*toxicity.train(clean + toxic, [0] * 120 + [1] * 40))


def test_toxicity_reads_the_middle_of_long_words():
    score = insults()
    filler = "thesuntreeriverwalksslowlyunder" * 4
    for start in range(90, 98):
        run = filler[:start] + "idiot" + filler[: 195 - start]
        assert len(run) == 200 and score(run) > 0.7 > score(filler + filler[:76])
    for mark in "_/,":
        words = ["the", "sun", "tree", "river"] * 12
        assert score(mark.join([*words, "idiot", *words])) > 0.7 > score(mark.join(words + words))
    long = "x" * 300_000 + "y" * 10
    grams = {f"<{long}>"[k : k + 5] for k in range(len(long) - 2)}
    held = [toxicity.framed(t) for t in toxicity.tokens_of(long)]
    assert all(any(g in p for p in set(held)) for g in grams)


def test_toxicity_does_not_depend_on_where_words_stand():
    score = insults()
    for n in range(8):
        text = " ".join(["the"] * n + ["tree", "sun", "idiots", "river"] + ["of"] * 9)
        clean = text.replace("idiots", "under")
        assert score(text) > 0.7 > score(clean) and score(f"walks {text}") > 0.7 > score(f"walks {clean}")
    model = np.zeros(toxicity.BUCKETS)
    for word, value in (("mean", 1.5), ("sly", 1.5), ("calm", -1.0)):
        model[toxicity.buckets([f"<{word}>"])[1]] = value
    pair = toxicity.Scorer(model, -3.5)
    assert len({round(pair(" ".join(["calm"] * n + ["mean", "sly"] + ["calm"] * (10 - n))), 9) for n in range(9)}) == 1


def test_toxicity_adds_up_mild_words():
    mild = ["dull", "slow", "weak", "odd", "lame"]
    model = np.zeros(toxicity.BUCKETS)
    for word in mild:
        model[toxicity.buckets([f"<{word}>"])[1]] = 1.2
    score = toxicity.Scorer(model, -3.5)
    assert score(" ".join(f"{w} of the" for w in mild)) > 0.7 > score("dull of the " + "of the river " * 4)
