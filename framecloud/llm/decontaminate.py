"""Benchmark decontamination: rare seeds join passages to items, Smith-Waterman decides.

A seed is a pair of words with at most one word between them, in an item and in a text.
An alignment that scores enough holds many such pairs at different places of its item
(``least`` proves how many), so an item's rarest places are enough to find it by: seeds
are counted over the corpus, the most frequent places of each item are left out of the
join, and no alignment is lost. What the join finds is aligned exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framecloud.llm.storage import written
from framecloud.llm.words import LETTERS, mix, word_hashes

MATCH, MISMATCH, GAP = 2, -1, 1
#: Share of an item's best possible score from which a passage is a leak.
THRESHOLD = 0.5
#: A score that is a leak of an item of any length: fifty words kept as they are.
ENOUGH = 100
#: Bits of the filter that seeds pass in the scans; its size does not grow.
FILTER_BITS = 1 << 22

_PAIR = np.uint64(0x9E3779B97F4A7C15)


def hasher(text: str | None) -> np.ndarray:
    return word_hashes(text, LETTERS)


def needed(n: int) -> int:
    """Score from which a passage is a leak of an item of ``n`` words.

    Two words must be there as they are. One word is no evidence: such an item, like an
    empty one, needs more than it can reach.
    """
    if n < 2:
        return MATCH * n + 1
    return MATCH * n if n == 2 else min(int(np.ceil(THRESHOLD * MATCH * n)), ENOUGH)


def least(n: int) -> int:
    """Places of an item of ``n`` words that start a seed in every alignment that counts.

    Of m matched words, neighbours that are no seed have two edits or more between them.
    A score of 2 m - edits >= s leaves at most m - s / 2 of these, so s / 2 - 1 or more
    of the m - 1 neighbours are seeds.
    """
    return max(1, -(-(needed(n) - 2) // 2))


def places(n: int) -> tuple[int, int]:
    """How many of an item's places are looked up, and how many of them are always found.

    Half of what any alignment must hold is asked for, which spares the most frequent
    places the join: each place left out lowers the number found by one at most.
    """
    found = (least(n) + 1) // 2
    return n - 1 - least(n) + found, found


def seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a word list's seeds and the place where each starts."""
    pairs = [mix(h[:-d] * _PAIR + h[d:]) for d in (1, 2) if len(h) > d]
    at = [np.arange(len(p)) for p in pairs]
    return np.concatenate([*pairs, np.empty(0, np.uint64)]), np.concatenate([*at, np.empty(0, np.int64)]).astype(np.int64)


def local_score(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences and the place in ``b`` where it ends.

    Rows run over ``a``; a run of gaps along a row is a running maximum.
    """
    place = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    best, end = 0, 0
    for word in a:
        step = np.where(b == word, MATCH, MISMATCH)
        new = np.maximum(row - GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + step)
        row = np.maximum.accumulate(new + GAP * place) - GAP * place
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def passages(h: np.ndarray, text_seeds: tuple, words: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of a text, as first and last place, that hold every alignment that counts.

    The seeds of one alignment lie on diagonals that differ by no more than its edits.
    """
    n = len(words)
    drift = MATCH * n - needed(n)
    own, own_at = seeds(words)
    order = np.argsort(own, kind="stable")
    own, own_at = own[order], own_at[order]
    hashes, at = text_seeds
    low, high = np.searchsorted(own, hashes), np.searchsorted(own, hashes, "right")
    many = high - low
    total = int(many.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
    place = own_at[np.repeat(low, many) + inside]
    hits = np.unique(np.stack([np.repeat(at, many) - place, place], 1), axis=0)
    diagonal = hits[:, 0]
    upto = np.searchsorted(diagonal, diagonal + drift, "right")
    dense = np.flatnonzero(upto - np.arange(len(diagonal)) >= least(n))
    marks = np.zeros(len(diagonal) + 1, np.int64)
    np.add.at(marks, dense, 1)
    np.add.at(marks, upto[dense], -1)
    diagonal = diagonal[np.cumsum(marks[:-1]) > 0]
    if len(diagonal):
        cuts = np.flatnonzero(np.diff(diagonal) > drift) + 1
        for part in np.split(diagonal, cuts):
            yield max(int(part[0]) - drift, 0), min(int(part[-1]) + drift + n, len(h))


def align(h: np.ndarray, text_seeds: tuple, words: np.ndarray) -> tuple[float, int, int] | None:
    """Share of the item's best score, first and last word of its best passage, if a leak."""
    need, best = needed(len(words)), None
    for first, last in passages(h, text_seeds, words):
        window = h[first:last]
        # Each match uses up a word of the item, so this bounds the score.
        if MATCH * int(np.isin(words, window).sum()) < need:
            continue
        score, end = local_score(words, window)
        if score >= need and (best is None or score > best[0]):
            _, length = local_score(words[::-1], window[:end][::-1])
            best = (score, first + end - length, first + end - 1)
    return best and (best[0] / (MATCH * len(words)), best[1], best[2])


def item_words(items: DataFrame, text: str = "text") -> DataFrame:
    """(item, words): each different text of the items once, by its digest."""
    out = pa.schema([("item", pa.string()), ("words", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            words = [hasher(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, out.field(1).type)], schema=out)

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return items.select(F.md5(whole).alias("item"), whole.alias("text")).distinct().mapInArrow(
        run, "item string, words array<bigint>"
    )


def item_seeds(words: DataFrame) -> DataFrame:
    """(item, place, seed, wanted, found): the seeds of each item with its ``places``."""
    out = pa.schema(
        [("item", pa.string()), ("place", pa.int64()), ("seed", pa.int64()), ("wanted", pa.int32()), ("found", pa.int32())]
    )

    def run(batches):
        for batch in batches:
            for item, listed in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if len(listed) < 2:
                    continue
                s, at = seeds(np.array(listed, np.int64).view(np.uint64))
                wanted, found = places(len(listed))
                cells = [pa.array([item.as_py()] * len(s), pa.string()), at, s.view(np.int64)]
                limits = [np.full(len(s), v, np.int32) for v in (wanted, found)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cells), *map(pa.array, limits)], schema=out)

    return words.mapInArrow(run, "item string, place bigint, seed bigint, wanted int, found int")


def seed_filter(owned: DataFrame) -> np.ndarray:
    """Which low bits a seed of ``owned`` may have; the driver sees ``FILTER_BITS`` bits."""
    bit = F.col("seed").bitwiseAND(FILTER_BITS - 1)
    rows = (
        owned.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(seed & {63} as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .collect()
    )
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[[r.w for r in rows]] = [r.b for r in rows]
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def seed_scan(texts: DataFrame, maybe: np.ndarray, with_text: bool) -> DataFrame:
    """Seeds of the texts that pass a filter, each once a text.

    ``texts`` holds digest and text. Gives (digest, seed), or without ``with_text``
    (seed, n): how many texts of a batch hold it.
    """
    shared = texts.sparkSession.sparkContext.broadcast(maybe)

    def run(batches):
        for batch in batches:
            held = []
            for text in batch.column(1).to_pylist():
                s, _ = seeds(hasher(text))
                held.append(np.unique(s[shared.value[s & np.uint64(FILTER_BITS - 1)]]).view(np.int64))
            flat = np.concatenate([*held, np.empty(0, np.int64)])
            if with_text:
                rows = np.repeat(np.arange(len(held)), [len(s) for s in held])
                digest = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([digest, pa.array(flat)], ["digest", "seed"])
            else:
                seed, n = np.unique(flat, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(n.astype(np.int64))], ["seed", "n"])

    return texts.mapInArrow(run, "digest string, seed bigint" if with_text else "seed bigint, n bigint")


def rare_seeds(owned: DataFrame, texts: DataFrame) -> DataFrame:
    """(seed, item, place, found) of the rarest ``wanted`` places of each item.

    A place is as frequent as its two seeds together; ties go by the place.
    """
    counts = seed_scan(texts, seed_filter(owned), False).groupBy("seed").agg(F.sum("n").alias("n"))
    counted = owned.join(counts, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    both = W.partitionBy("item", "place")
    rarest = W.partitionBy("item").orderBy("_often", "place")
    ranked = counted.withColumn("_often", F.sum("n").over(both)).withColumn("_rank", F.dense_rank().over(rarest))
    return ranked.where(F.col("_rank") <= F.col("wanted")).select("seed", "item", "place", "found")


def candidates(texts: DataFrame, rare: DataFrame) -> DataFrame:
    """(digest, item) of texts that hold as many rare places of an item as a leak must."""
    hits = seed_scan(texts, seed_filter(rare), True)
    return (
        hits.join(rare, "seed")
        .groupBy("digest", "item", "found")
        .agg(F.collect_set("place").alias("_places"))  # no more than the item has words
        .where(F.size("_places") >= F.col("found"))
        .select("digest", "item")
    )


def maybe_in(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Texts whose digest may be in ``pairs``: all that are, and few others.

    Digests set bits of a filter of ``FILTER_BITS`` whose size does not grow; it goes to
    every task, so that the join with the digests moves only the texts it asks for.
    """
    bit = F.xxhash64("digest").bitwiseAND(FILTER_BITS - 1)
    word, mask = F.shiftright(bit, 6).alias("_word"), F.expr("shiftleft(1L, cast(xxhash64(digest) & 63 as int))")
    bits = pairs.groupBy(word).agg(F.bit_or(mask).alias("_bits"))
    set_ = F.col("_bits").bitwiseAND(mask) != 0
    marked = texts.withColumn("_word", F.shiftright(bit, 6)).join(F.broadcast(bits), "_word")
    return marked.where(set_).select(*texts.columns)


_FOUND = "digest string, item string, score double, first_word int, last_word int"


def findings(docs: DataFrame, items: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """(digest, item, score, first_word, last_word): each leak of each different text.

    The corpus is read three times whatever the number of items: seeds are counted, rare
    ones are joined, and the texts that were found are fetched. ``folder`` keeps the
    seeds, the candidates and the findings.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.md5(whole).alias("digest"), whole.alias("text"))
    words = written(item_words(items), f"{folder}/items")
    rare = written(rare_seeds(item_seeds(words), texts), f"{folder}/seeds")
    pairs = written(candidates(texts, rare), f"{folder}/candidates")
    asked = pairs.join(words, "item").groupBy("digest").agg(F.collect_list(F.struct("item", "words")).alias("items"))
    # Not a semi-join: the optimizer would move it, and its exchange, below the filter.
    held = maybe_in(texts, pairs).join(pairs.select("digest").distinct(), "digest")
    once = held.groupBy("digest").agg(F.first("text").alias("text"))
    out = pa.schema(
        [("digest", pa.string()), ("item", pa.string()), ("score", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())]
    )

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one text's items at a time
                row = batch.slice(k, 1).to_pylist()[0]
                h = hasher(row["text"])
                own = seeds(h)
                found = []
                for item in row["items"]:
                    best = align(h, own, np.array(item["words"], np.int64).view(np.uint64))
                    if best:
                        found.append((row["digest"], item["item"], *best))
                if found:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*found), out, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)

    return written(once.join(asked, "digest").mapInArrow(run, _FOUND), f"{folder}/found")


def named(found: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Findings with the id of each item of that text, repeated ids and all."""
    kind = items.schema[key].dataType.simpleString()
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("item")
    ids = items.select(digest, F.col(key).cast("bigint" if whole else "string").alias("item_id"))
    return found.join(ids, "item").select("digest", "item_id", "score", "first_word", "last_word")


def with_leaks(
    docs: DataFrame,
    items: DataFrame,
    folder: str,
    text: str = "text",
    key: str = "item_id",
    name: str = "leaks",
) -> DataFrame:
    """Add the test items that occur in each text as an array named ``name``.

    Each element has item_id, score (share of the item's best score), first_word and
    last_word of the passage (from 0, words are runs of letters and digits). A passage is
    a leak from a score of 0.5, or ``ENOUGH`` whatever the item's length; an item of two
    words must be there whole, and one of fewer is never found. Item ids are whole
    numbers or text. Null and empty texts hold nothing; repeated rows and repeated items
    are found each for itself; all other columns stay, whatever their names, and only a
    column called ``name`` is replaced.
    """
    found = named(findings(docs, items, folder, text), items, key)
    leak = F.struct("item_id", "score", "first_word", "last_word")
    by_text = found.groupBy("digest").agg(F.array_sort(F.collect_list(leak)).alias("found"))
    kept = [f"`{c.replace('`', '``')}`" for c in docs.columns if c != name]
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(F.struct(*kept).alias("row"), digest.alias("digest"))
    none = F.array().cast(by_text.schema["found"].dataType)
    joined = rows.join(by_text, "digest", "left")
    return joined.select("row.*", F.coalesce("found", none).alias(name))


def leaks(docs: DataFrame, items: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, score, first_word, last_word) of every leak of every row."""
    found = named(findings(docs, items, folder, text), items, "item_id")
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(F.col(key), digest.alias("digest"))
    return rows.join(found, "digest").select(key, "item_id", "score", "first_word", "last_word")
