"""Piece encoding, periodic runs and whitening against their libraries and brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from framecloud.llm import periodic_runs, piece_bpe, whitening
from framecloud.llm.queries import QUERIES
from framecloud.llm.storage import new_folder

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
LONG = "a very long word " * 400 + "x" * 5000 + "日本語" * 3000
TEXTS = [None, "", "  ", " lead", "two  blanks ", "▁mark", "<s>a</s><0x0A>\n", "é日本\x1c🎉", "a b a b", LONG, "plain", "plain"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeats, long texts and columns that clash with results."""
    rows = [(k, t, "kept", "kept", "kept") for k, t in enumerate(TEXTS)] + [(None, "no id", *["kept"] * 3)] * 2
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, runs string, `odd name` string")


def random_texts(seed: int, count: int) -> list[str]:
    rnd = random.Random(seed)
    pieces = [LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    letters = "abehinst  ▁\n\t\x00éß日本語кир🎉́aaaa<s></s>"
    out = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(count)]
    return out + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25))) for _ in range(count)]


def test_backtracking_equals_the_library():
    texts = [t or "" for t in TEXTS] + random_texts(1, 1500)
    encoder = piece_bpe.load(MODEL)
    found = list(encoder.encode(texts))
    assert [f.tolist() for f in found] == LIBRARY.encode(texts)
    assert encoder.decode(found) == LIBRARY.decode(LIBRARY.encode(texts))


def test_backtracking_equals_merging_on_small_vocabularies():
    """Dense vocabularies take back more often than real ones; equal scores go to the left."""
    rnd = random.Random(2)
    for _ in range(150):
        pieces = {"a", "b", "c"}
        for _ in range(rnd.randint(1, 25)):
            pieces.add(rnd.choice(sorted(pieces)) + rnd.choice(sorted(pieces)))
        names = sorted(pieces)
        scores = {p: float(rnd.randint(-12, 0)) for p in names}
        table = piece_bpe.Backtracking(scores, {p: k for k, p in enumerate(names)})
        for _ in range(40):
            text = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40)))
            assert [names[k] for k in table.encode(text)] == table.merged(text)


def test_forgotten_verdicts_and_cut_texts_change_nothing(monkeypatch):
    monkeypatch.setattr(piece_bpe, "REMEMBERED_PAIRS", 3)
    monkeypatch.setattr(piece_bpe, "LONG", 8)
    encoder = piece_bpe.PieceBpe(MODEL)
    encoder._encoder._chunk = 50
    texts = random_texts(3, 100) + [LONG]
    assert [f.tolist() for f in encoder.encode(texts)] == LIBRARY.encode(texts)


def test_unsupported_vocabularies_are_refused():
    with pytest.raises(ValueError, match="no pieces themselves"):
        piece_bpe.Backtracking({"a": 0.0, "ab": 1.0}, {"a": 0, "ab": 1})


def test_piece_round_trip(odd):
    want = LIBRARY.encode([t or "" for t in TEXTS], add_bos=True, add_eos=True)
    rows = {r.doc_id: r for r in piece_bpe.round_trip(odd, MODEL).collect()}
    for k, ids in enumerate(want):
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    encoded = piece_bpe.encode(odd.drop("odd name"), MODEL)
    back = piece_bpe.decode(encoded, MODEL, text="runs").orderBy("doc_id").collect()
    assert len(back) == len(TEXTS) + 2
    assert [r.ids for r in back[2:]] == want
    assert [r.runs for r in back[2:]] == LIBRARY.decode(want)
    assert piece_bpe.round_trip(odd.where("false"), MODEL).count() == 0


def loops(words: list) -> list[tuple]:
    """Every run by trying each period at each place."""
    best = {}
    for q in range(1, len(words) // 4 + 1):
        s = 0
        while s + q < len(words):
            e = s
            while e + q < len(words) and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(6, 4 * q):
                best.setdefault((s, e + q - s), q)
            s = max(e, s + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def random_words(seed: int, count: int) -> list[list[str]]:
    rnd = random.Random(seed)
    docs = [[], ["a"] * 5, ["a"] * 6, ["a"] * 300]
    for _ in range(count):
        k, n = rnd.choice([1, 2, 2, 3, 5, 50]), rnd.randint(0, rnd.choice([12, 40, 200]))
        doc = [str(rnd.randrange(k)) for _ in range(n)]
        if rnd.random() < 0.7 and n > 4:
            a = rnd.randrange(n)
            p = 1 + (n - a) // rnd.randint(3, 10)
            doc = [doc[i] if i < a else doc[a + (i - a) % p] for i in range(n)]
        docs.append(docs[-1] + doc if rnd.random() < 0.2 else doc)
    return docs


def test_words_shared_with_the_next_document_are_no_run():
    """A document's last words stand again in the next one, a period of the grid on."""
    for q in range(4, 11):
        for i in range(q * (-(-(41 - q) // q)), 37, q):
            first, second = list(range(40)), list(range(40, 80))
            second[i + q - 41 : i + q - 37] = first[i : i + 4]
            assert [r.tolist() for r in periodic_runs.runs_of([first, second])] == [[], []]


@pytest.mark.parametrize("together", [50, 300_000])
def test_runs_equal_loops(monkeypatch, together):
    monkeypatch.setattr(periodic_runs, "TOGETHER", together)
    monkeypatch.setattr(periodic_runs, "PAIRS", 64)
    docs = random_words(together, 700)
    for doc, found in zip(docs, periodic_runs.runs_of(docs), strict=True):
        assert [tuple(r) for r in found.tolist()] == loops(doc)


def test_extensions_equal_loops():
    rnd = random.Random(5)
    words = np.array([rnd.randrange(2) for _ in range(40)] * 6 + [-1] + [0] * 50 + [-2], np.int64)
    pairs = [(a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if rnd.random() < 0.2]
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    want = [next((k for k in range(len(words)) if j + k >= len(words) or words[i + k] != words[j + k])) for i, j in pairs]
    assert periodic_runs.CoverExtensions(words)(a, b).tolist() == want


def test_find_runs_on_odd_rows(odd):
    rows = {r.doc_id: r for r in periodic_runs.find_runs(odd).collect()}
    assert rows[0].runs == rows[1].runs == rows[2].runs == [] and rows[0].collapsed == ""
    assert [tuple(r) for r in rows[9].runs] == [(0, 1600, 4)]
    assert rows[9].collapsed == "a very long word " + "x" * 5000 + "日本語" * 3000
    assert rows[4].collapsed == "two blanks" and rows[4]["odd name"] == "kept"
    assert periodic_runs.find_runs(odd).count() == len(TEXTS) + 2
    assert periodic_runs.find_runs(odd.where("false")).count() == 0


def test_periodic_query_repeats_tails(spark, tiny):
    """The query's own tails, digests and densest run against plain Python."""
    import zlib
    from fractions import Fraction

    found = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, tiny).collect()}
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        words = (d.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue  # the loops take minutes there
        runs = loops(words)
        row = found[d.doc_id]
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (row.start, row.length, row.period, row.exponent_milli) == want


def whitened_by_numpy(vectors: list[list[float]], components: int):
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], np.int64)
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    c = (n * distinct - sums) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    moved = n * x - sums
    return n, (moved**2).sum(1), moved / n @ axes / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(7)
    vectors = (rng.normal(size=(150, 6)) @ rng.normal(size=(6, 6))).tolist()
    vectors += [vectors[0]] * 80 + [vectors[1]]  # one hot vector
    bad = [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    rows = [(k, v, "clash", 1) for k, v in enumerate(vectors)] + [(None, vectors[2], "clash", 1)] + [(k, v, "bad", 1) for k, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n string, _at int").repartition(5)
    found = whitening.whiten(df, new_folder(spark, "white"), components=4).collect()
    assert len(found) == len(vectors) + 1 and {r['_at'] for r in found} == {1}
    n, deviation, white, explained = whitened_by_numpy(vectors, 4)
    by_id = {r.vec_id: r for r in found}
    got = np.array([by_id[k].whitened for k in range(len(vectors))])
    got *= np.sign((got * white).sum(0))
    assert np.abs(got - white).max() < 1e-9
    assert [by_id[k].deviation for k in range(len(vectors))] == deviation.tolist()
    assert by_id[None].deviation == deviation[2] and {r.n for r in found} == {n}
    assert np.allclose(by_id[0].explained, explained, rtol=1e-9)
    assert by_id[0].identity_error < 1e-9


def test_blocks_of_rows_are_moved_as_rows(spark, monkeypatch):
    """One shuffle of rows, no object for each entry; gaps give zeros, the last blocks are smaller."""
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 4)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 3)
    want = np.zeros((14, 7))
    want[[0, 1, 5, 12, 13]] = np.random.default_rng(3).normal(size=(5, 7))
    rows = spark.createDataFrame([(int(k), want[k].tolist()) for k in (13, 0, 12, 5, 1)], "_at bigint, v array<double>")
    matrix = whitening.block_matrix(rows.repartition(3), F.col("v"), 14, 7)
    assert np.array_equal(matrix.toLocalMatrix().toArray(), want)
    lineage = matrix._java_matrix_wrapper.call("blocks").toDebugString().decode()
    assert "ShuffledRDD" not in lineage and "ShuffledRowRDD" in lineage
    product = whitening.projected(spark, matrix, np.arange(14.0).reshape(7, 2))
    assert np.allclose(product.toLocalMatrix().toArray(), want @ np.arange(14.0).reshape(7, 2))


def test_whitening_of_flat_short_and_missing_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    white = lambda rows: whitening.whiten(make(rows), new_folder(spark, "white")).orderBy("vec_id").collect()
    assert white([]) == [] and white([(1, None), (2, [float("nan")])]) == []
    assert [(r.n, r.deviation, r.whitened) for r in white([(1, [])] * 2)] == [(1, 0, [])] * 2
    one = white([(1, [0.5, 1.0])] * 3)
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 0, [None, None], None)] * 3
    short = white([(1, [1.0, 0.0]), (2, [1.0]), (3, [3.0, 0.0])])
    assert short[0].whitened == short[1].whitened and short[0].n == 2
    assert short[0].whitened[1] is None and abs(abs(short[2].whitened[0]) - 1) < 1e-12


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(k, [1e12 if k == 0 else -1e12 * k, 0.0]) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(df, new_folder(spark, "white")).collect()} == {None}


def test_queries_cover_whole_tables(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert QUERIES["op11_piece_round_trip"](spark, tiny).count() == docs.count()
    white = QUERIES["op13_whitening"](spark, tiny)
    vectors = spark.read.parquet(f"{tiny}/embeddings.parquet").where(whitening.usable("embedding")).count()
    per_row = white.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.n for r in per_row} == {vectors} and len(per_row) == 16
