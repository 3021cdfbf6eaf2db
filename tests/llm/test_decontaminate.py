"""Decontamination against full Smith-Waterman of every item with every text."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framecloud.llm import decontaminate as dc
from framecloud.llm.storage import new_folder


def full_score(a, b):
    """Best local alignment score, cell by cell."""
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            step = dc.MATCH if x == y else dc.MISMATCH
            row.append(max(0, above[j] + step, above[j + 1] - dc.GAP, row[j] - dc.GAP))
        best, above = max(best, *row), row
    return best


def edited(rng, words, rate, vocabulary):
    out = []
    for w in words:
        kind = rng.random()
        if kind < rate / 3:
            continue
        out.append(rng.choice(vocabulary) if kind < 2 * rate / 3 else w)
        if kind > 1 - rate / 3:
            out.append(rng.choice(vocabulary))
    return out


def corpus(rng, items, vocabulary, count):
    texts = []
    for k in range(count):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        for item in rng.sample(items, 2):
            at = rng.randrange(len(text) + 1)
            text[at:at] = edited(rng, item, rng.choice([0, 0.2, 0.5, 0.8, 1.0]), vocabulary)
        texts.append(text)
    return texts


@pytest.mark.parametrize("size", [3, 12, 60, 2000])
def test_findings_equal_full_alignment(size):
    """No leak is lost by seeds, places or passages, and the score is the best one."""
    rng = random.Random(size)
    vocabulary = [f"w{k}" for k in range(size)]
    lengths = [0, 1, 2, 2, 3, 4, 5, 8, 15, 16, 30, 45]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in lengths]
    seen = 0
    for text in corpus(rng, items, vocabulary, 25):
        h = dc.hasher(" ".join(text))
        own = dc.seeds(h)
        for item in items:
            score = full_score(item, text)
            words = dc.hasher(" ".join(item))
            best = dc.align(h, own, words)
            if score < dc.needed(len(item)):
                assert best is None
                continue
            seen += 1
            assert best[0] == score / (dc.MATCH * len(item))
            # Any choice of places finds it: as many are hit as an alignment must hold.
            held = np.isin(dc.seeds(words)[0], own[0])
            hit = len(np.unique(dc.seeds(words)[1][held]))
            wanted, found = dc.places(len(item))
            assert hit >= dc.least(len(item)) and wanted - (len(item) - 1 - hit) >= found
    assert seen >= 10


def test_long_items_need_no_more_than_fifty_words():
    rng = random.Random(1)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    item = fresh(400)
    for kept, leak in ((199, True), (50, True), (49, False)):
        h = dc.hasher(" ".join(fresh(500) + item[100 : 100 + kept] + fresh(300)))
        best = dc.align(h, dc.seeds(h), dc.hasher(" ".join(item)))
        assert (best is not None) == leak
        assert best is None or best[1:] == (500, 499 + kept)


def test_corpus_equals_full_alignment(spark):
    """The job as a whole, with a phrase that every text and every item holds."""
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    common = ["once", "upon", "a", "time"]
    lengths = [2, 5, 9, 20, 40]
    items = [common[: n // 2] + [rng.choice(vocabulary) for _ in range(n - n // 2)] for n in lengths]
    texts = [common + t for t in corpus(rng, items, vocabulary, 60)]
    ids = [*range(len(texts)), None, 3]
    docs = spark.createDataFrame(
        list(zip(ids, [" ".join(t) for t in [*texts, texts[0], texts[3]]])), "doc_id bigint, text string"
    )
    table = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id int, text string")
    want = []
    for doc, text in zip(ids, [*texts, texts[0], texts[3]]):
        for k, item in enumerate(items):
            score = full_score(item, text)
            if score >= dc.needed(len(item)):
                want.append((doc, k, score / (2 * len(item))))
    order = lambda r: (r[0] is None, r)
    got = dc.leaks(docs, table, new_folder(spark, "leaks")).collect()
    assert sorted([(r.doc_id, r.item_id, r.score) for r in got], key=order) == sorted(want, key=order)
    assert len(want) >= 20


def test_odd_columns_items_and_texts(spark):
    docs = spark.createDataFrame(
        [(1, "x alpha beta y", "f", 2, (5,)), (2, None, "f", 2, (5,)), (3, "", None, None, None), (1, "x alpha beta y", "f", 2, (5,))],
        "doc_id bigint, text string, _found string, digest int, `o d` struct<`a b`:int>",
    )
    rows = [("i", "Alpha, beta"), ("i", "alpha beta"), ("j", "alpha beta gamma delta"), (None, "alpha beta"), ("k", None), ("l", "alpha")]
    items = spark.createDataFrame(rows, "item_id string, text string")
    out = dc.with_leaks(docs, items, new_folder(spark, "odd"), name="_leaks")
    assert out.columns == [*docs.columns, "_leaks"]
    found = {(r.doc_id, r.text): [x.item_id for x in r["_leaks"]] for r in out.collect()}
    assert found == {(1, "x alpha beta y"): [None, "i", "i", "j"], (2, None): [], (3, ""): []}
    assert out.drop("_leaks").exceptAll(docs).count() == 0 == docs.exceptAll(out.drop("_leaks")).count()
    for none in (items.where("false"), items.where("item_id = 'l'")):
        assert dc.with_leaks(docs, none, new_folder(spark, "odd")).where(F.size("leaks") > 0).count() == 0
    assert dc.leaks(docs.where("false"), items, new_folder(spark, "odd")).count() == 0


def test_very_long_text(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(50)]
    item = [f"v{k}" for k in range(30)]
    text = [rng.choice(vocabulary) for _ in range(200_000)]
    text[150_000:150_000] = item
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(vocabulary))], "item_id bigint, text string")
    row = dc.leaks(docs, items.where("item_id = 1"), new_folder(spark, "long")).collect()
    assert [(r.item_id, r.score, r.first_word, r.last_word) for r in row] == [(1, 1.0, 150_000, 150_029)]


def test_only_texts_asked_for_are_moved(spark):
    """The filter keeps every text asked for and nearly no other."""
    texts = spark.range(20000).selectExpr("md5(cast(id as string)) as digest", "cast(id as string) as text")
    asked = texts.where("cast(text as int) % 100 = 0").selectExpr("digest", "'item' as item")
    kept = {int(r.text) for r in dc.maybe_in(texts, asked).select("text").collect()}
    assert set(range(0, 20000, 100)) <= kept and len(kept) < 220
    assert dc.maybe_in(texts, asked).columns == texts.columns
    assert dc.maybe_in(texts, asked.where("false")).count() == 0


def test_texts_are_filtered_before_they_are_dealt(spark, tmp_path, monkeypatch):
    """In the plan that fetches the texts nothing joins them before the filter does."""
    plans = []

    def written(df, folder):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        df.write.parquet(folder)
        return spark.read.parquet(folder)

    monkeypatch.setattr(dc, "written", written)
    docs = spark.createDataFrame([(1, "one two three four"), (2, None)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    items = spark.createDataFrame([(7, "one two three four")], "item_id bigint, text string")
    found = dc.findings(spark.read.parquet(str(tmp_path / "docs")), items, str(tmp_path / "run"))
    assert found.count() == 1
    below = plans[-1][plans[-1].index("_bits#") :].splitlines()[1:]
    scan = next(k for k, line in enumerate(below) if "Relation" in line)
    assert "text#" in below[scan] and not any("Join" in line for line in below[:scan])
    assert not any("LeftSemi" in line for line in plans[-1].splitlines())
