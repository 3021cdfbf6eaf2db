"""Near-duplicate texts by Order MinHash and banded alignment.

The k-mers of a text are its shingles of five words, labelled with their number of
occurrence. Each of ``SKETCHES`` hash functions picks the ``SAMPLED`` smallest
labelled shingles and keeps them in text order, so equal picks speak for equal
order and not only for equal content. Texts that agree in one pick are compared by
aligning their shingle sequences inside the band that a similarity of 0.8 allows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framecloud.llm.components import components
from framecloud.llm.storage import bounded_batches, written
from framecloud.llm.words import NOT_SPACE, mix, windows, word_hashes

WORDS = 5
SIMILARITY = 0.8
#: A pair at 0.8 agrees in one pick with 0.8 cubed or so, and is missed by all once in a million.
SKETCHES, SAMPLED = 20, 3
#: Shingles of one block of texts that are compared in one task.
BLOCK = 1_000_000
#: Shingles hashed by all functions at a time.
WIDE = 50_000

_K1 = np.uint64(0x9E3779B97F4A7C15)
SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _K1)


def shingles_of(text: str | None) -> np.ndarray:
    """One hash per run of five words in lower case; a shorter text is one shingle."""
    h = word_hashes(text, NOT_SPACE)
    if len(h) == 0:
        return h
    return windows(h, min(WORDS, len(h)))


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, occurrences before it)."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    if new.all():
        return shingles
    at = np.arange(len(ranked))
    nth = np.empty(len(ranked), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(nth > 0, mix(shingles + nth * _K1), shingles)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per hash function; texts without words share a single one."""
    if len(shingles) == 0:
        return SEEDS[:1].view(np.int64)
    keys = labelled(shingles)
    take = min(SAMPLED, len(keys))
    if len(keys) <= WIDE:
        drawn = mix(keys[None, :] ^ SEEDS[:, None])
        least = np.argpartition(drawn, take - 1, axis=1)[:, :take]
    else:
        least = np.stack([np.argpartition(mix(keys ^ s), take - 1)[:take] for s in SEEDS])
    picked = keys[np.sort(least, axis=1)]  # back in text order
    out = SEEDS.copy()
    for k in range(take):
        out = mix(out * _K1 + picked[:, k])
    return out.view(np.int64)


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Most matches of an order-keeping alignment whose pairs differ in place by at most ``band``.

    One row of the alignment table is the bits of an integer: bit d of row j stands
    for place j - band + d of ``b`` and is 0 where the number of matches rises. Only
    the band is held; a bit that leaves it is final and counted.
    """
    places: dict[int, list[int]] = {}
    for at, s in enumerate(b):
        places.setdefault(s, []).append(at)
    frequent = {s: sum(1 << p for p in ps) for s, ps in places.items() if len(ps) > 64}
    width = 2 * band + 1
    full = (1 << width) - 1
    row, matches = full, 0
    for j, s in enumerate(a):
        low = j - band
        if s in frequent:
            mask = (frequent[s] >> low if low >= 0 else frequent[s] << -low) & full
        else:
            ps = places.get(s, ())
            mask = 0
            for p in ps[bisect_left(ps, low) : bisect_right(ps, j + band)]:
                mask |= 1 << (p - low)
        if mask:
            up = row & mask
            row = ((row + up) | (row - up)) & full
        matches += not row & 1
        row = (row >> 1) | (1 << (width - 1))
    return matches + width - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Aligned shingles over all shingles of both; exact from 0.8 up, no more than the truth below.

    Two texts without words are alike. What both begin and end with is aligned as
    it is; an alignment of 0.8 or more leaves at most a ninth of all shingles
    unpaired, which bounds the band.
    """
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    short = min(len(a), len(b))
    if short < SIMILARITY * max(len(a), len(b)):
        return 0.0
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(differ[0]) if len(differ) else short - head
    band = (len(a) + len(b)) // 9 + 1
    middle = [x[head : len(x) - tail].tolist() for x in (a, b)]
    matched = head + tail + (aligned(*middle, band) if all(middle) else 0)
    return matched / (len(a) + len(b) - matched)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_id, digest of the text, n (shingles) and keys of every row."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("bigint").alias("_id"), F.md5(content).alias("digest"), content.alias("_text"))

    def run(batches):
        for batch in batches:
            found = [shingles_of(t) for t in batch.column(2).to_pylist()]
            keys = pa.array([sketch(s) for s in found], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, keys], ["_id", "digest", "n", "keys"])

    return rows.mapInArrow(run, "_id bigint, digest string, n bigint, keys array<bigint>")


def alike_in_size(n: str, other: str):
    return F.least(n, other) >= SIMILARITY * F.greatest(n, other)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose texts are at least 0.8 similar. ``texts``: node, text."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")

    def run(batches):
        held: dict = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            links = []
            for k in range(len(a)):
                pair = []
                for node, column in ((a[k], 2), (b[k], 3)):
                    if node not in held:
                        if len(held) > 64:
                            held.clear()
                        held[node] = shingles_of(batch.column(column)[k].as_py())
                    pair.append(held[node])
                if similarity(*pair) >= SIMILARITY:
                    links.append(k)
            yield batch.select(["a", "b"]).take(pa.array(links, pa.int64()))

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, class_id, is_first) for every row: the smallest key of its class, see ``labelled_rows``."""
    return labelled_rows(docs, folder, key, text).drop("label")


def labelled_rows(docs: DataFrame, folder: str, key: str, text: str) -> DataFrame:
    """(key, digest, label, class_id, is_first) for every row.

    ``label`` is the class itself; ``class_id`` is its smallest key, which other
    classes may have too where keys are null or repeated.

    A class is a connected component of equal texts and of pairs with a similarity
    of 0.8 or more. Null, empty and blank texts are equal to each other; texts below
    five words are one shingle. A class whose keys are all null has a null id; rows
    that repeat a key are classed by their own text, whose md5 is the digest. Other columns are ignored and
    an empty table gives no rows. ``folder`` receives the intermediate tables.

    Within a group of agreeing texts each is first compared with one centre, so a
    large group of copies costs one comparison per text. Texts that agree in a pick
    but lie in different components then meet in blocks, see ``cells`` and
    ``compared``, which leave out no link between components and emit no pairs but links.
    """
    bounded_batches(docs.sparkSession)
    rows = written(sketches(docs, key, text), f"{folder}/rows")
    texts = rows.groupBy("digest").agg(
        F.min("_id").alias("first"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys")
    )
    texts = written(texts.withColumn("node", F.monotonically_increasing_id()), f"{folder}/texts")
    keyed = texts.select("node", "n", F.explode("keys").alias("key"))

    stars = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("_b")).where("a <> _b")
    around = keyed.join(stars.select("key", "a").hint("rebalance"), "key").where(F.col("node") != F.col("a"))
    around = around.select("a", F.col("node").alias("b"), "n").distinct()
    around = around.join(texts.select(F.col("node").alias("a"), F.col("n").alias("m")), "a")
    around = written(around.where(alike_in_size("n", "m")).select("a", "b"), f"{folder}/around")
    links = written(verified(around, content_of(around, docs, texts, text)), f"{folder}/links")
    first = written(components(links), f"{folder}/components")

    placed = keyed.join(first, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    listed = written(cells(placed), f"{folder}/cells")
    held = written(shingles_in(listed, docs, texts, text), f"{folder}/shingles")
    rows_of = listed.join(held, "node")
    more = rows_of.groupBy("key", "low", "high").applyInArrow(compared, "a bigint, b bigint")
    more = written(more, f"{folder}/more")
    stars = first.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    final = components(stars.union(more)) if more.take(1) else first

    labels = texts.select("digest", "first", "node").join(final, "node", "left")
    labels = labels.withColumn("label", F.coalesce("label", "node"))
    least = labels.groupBy("label").agg(F.min("first").alias("class_id"))
    classes = labels.join(least.hint("rebalance"), "label").select("digest", "label", "class_id")
    classes = written(classes, f"{folder}/classes")
    return rows.select("_id", "digest").join(classes, "digest").select(
        F.col("_id").alias(key), "digest", "label", "class_id", F.col("_id").eqNullSafe(F.col("class_id")).alias("is_first")
    )


def cells(placed: DataFrame) -> DataFrame:
    """(key, low, high, own, node, label, top) of every text in every comparison of blocks it takes part in.

    ``placed``: key, node, n, label. Under a pick that several labels share, the label
    with most shingles is ``top``. Its texts and all others are dealt into blocks of
    about ``BLOCK`` shingles. Blocks of others meet each other, themselves and the
    blocks of ``top``, so rows grow with the texts outside ``top`` times blocks, and
    no two texts of ``top`` meet. ``low`` and ``high`` number the two blocks that meet and
    ``own`` is the block of the row.
    """
    size = F.greatest("n", F.lit(1))
    shares = placed.groupBy("key", "label").agg(F.sum(size).alias("_w"))
    mixed = shares.groupBy("key").agg(
        F.max(F.struct("_w", "label")).alias("_top"), F.sum("_w").alias("_all"), F.count(F.lit(1)).alias("_labels")
    )
    mixed = mixed.where("_labels > 1").select(
        "key",
        F.col("_top.label").alias("top"),
        F.ceil(F.col("_top._w") / BLOCK).alias("_tops"),
        F.ceil((F.col("_all") - F.col("_top._w")) / BLOCK).alias("_others"),
    )
    rows = placed.join(mixed.hint("rebalance"), "key").withColumn("_h", F.xxhash64("node"))
    other = F.col("label") != F.col("top")
    own = F.when(other, F.expr("pmod(_h, _others)")).otherwise(F.expr("_others + pmod(_h, _tops)"))
    met = F.when(other, F.expr("sequence(0L, _others + _tops - 1)")).otherwise(F.expr("sequence(0L, _others - 1)"))
    rows = rows.withColumn("own", own).select("key", "node", "label", "top", "own", F.explode(met).alias("_met"))
    return rows.select("key", F.least("own", "_met").alias("low"), F.greatest("own", "_met").alias("high"), "own", "node", "label", "top")


def shingles_in(listed: DataFrame, docs: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(node, shingles, keys) of the texts in ``listed``, one row each."""
    wanted = texts.join(listed.select("node").distinct(), "node", "left_semi").select("node", "digest", "keys")
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.md5(content).alias("digest"), content.alias("text")).join(wanted, "digest")

    def run(batches):
        for batch in batches:
            found = [shingles_of(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64())), batch.column(2)], ["node", "shingles", "keys"]
            )

    found = rows.select("node", "text", "keys").mapInArrow(run, "node bigint, shingles array<bigint>, keys array<bigint>")
    return found.dropDuplicates(["node"])


def compared(cell: pa.Table) -> pa.Table:
    """Links (a, b) between texts of two blocks that lie under different labels.

    An inverted list of labelled shingles counts what two texts share whatever its
    order, and only pairs that share enough for 0.8 are aligned, most shared first.
    Labels already joined by a link found here are not compared again, so a cell
    yields fewer links than it has labels. Texts that agree in an earlier pick meet
    there.
    """
    own, label, node = (cell.column(c).to_numpy() for c in ("own", "label", "node"))
    key, low, high, top = (cell.column(c)[0].as_py() for c in ("key", "low", "high", "top"))
    column = cell.column("shingles").combine_chunks()
    found = [np.asarray(column[k].values, np.int64).view(np.uint64) for k in range(len(node))]
    keys = [np.asarray(v, np.int64) for v in cell.column("keys").to_pylist()]
    picks = np.stack([np.resize(k, SKETCHES) for k in keys])
    at = int(np.flatnonzero(picks[0] == key)[0])
    left = np.flatnonzero((own == low) & (label != top))
    right = np.flatnonzero(own == high)
    sets = {int(k): labelled(found[k]) for k in {*left.tolist(), *right.tolist()}}
    sizes = np.array([len(sets[int(k)]) for k in right])
    flat = np.concatenate([sets[int(k)] for k in right] or [np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            if root[x] in root:
                root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in left.tolist():
        mine = sets[i]
        start = np.searchsorted(flat, mine, "left")
        count = np.searchsorted(flat, mine, "right") - start
        hits = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        shared = np.bincount(owner[hits], minlength=len(right))
        # Aligned over all shingles is 0.8 or more only where shared ones are 4/9 of both.
        enough = shared * (1 + SIMILARITY) >= SIMILARITY * (len(mine) + sizes) - 1e-9
        enough &= (label[right] != label[i]) & ~(picks[right, :at] == picks[i, :at]).any(1)
        if low == high:
            enough &= node[right] > node[i]
        likely = np.flatnonzero(enough)
        for j in right[likely[np.argsort(-shared[likely], kind="stable")]].tolist():
            a, b = find(int(label[i])), find(int(label[j]))
            if a != b and similarity(found[i], found[j]) >= SIMILARITY:
                root[max(a, b)] = min(a, b)
                links.append((int(node[i]), int(node[j])))
    return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def first_of_each_class(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that come first in their class, one per class.

    First is the smallest key, null only where a class has no other. The text
    decides between rows that repeat a key, and of rows that repeat both one stays.
    All columns stay.
    """
    classes = labelled_rows(docs, folder, key, text)
    # The first row of a class has the class's smallest key, so its text is unique to it.
    firsts = classes.where("is_first").groupBy("label").agg(F.min("digest").alias("_digest"), F.first("class_id").alias("_first"))
    rows = docs.withColumn("_digest", F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    same = F.col(key).cast("bigint").eqNullSafe(firsts["_first"]) & (rows["_digest"] == firsts["_digest"])
    kept = rows.join(firsts, same, "left_semi")
    return kept.dropDuplicates([key, "_digest"]).drop("_digest")


def content_of(pairs: DataFrame, docs: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(node, text) of the texts that occur in pairs, one row each."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = texts.select("node", "digest").join(nodes, "node")
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.md5(content).alias("digest"), content.alias("text"))
    return rows.join(wanted, "digest").groupBy("node").agg(F.any_value("text").alias("text"))
