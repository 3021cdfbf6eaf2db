"""Toxicity scores from subword bags.

A word is the mean of the vectors of its character n-grams and of the word itself,
hashed to buckets. Windows of ``WIDTHS`` words start at every word; a text
is the sum of its most toxic window plus ``MEAN`` times the average of all words, followed
by a linear softmax. Vectors and softmax are trained together, so a misspelling is
scored by the n-grams it shares.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framecloud.llm.schemas import fields_of
from framecloud.llm.storage import bounded_batches

BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4, 5)
#: Windows of so many words start at every word; at the end of a text of as many as are left.
WIDTHS = (1, 4, 16)
#: Weight of the average of the whole text beside its most toxic window.
MEAN = 2.0
#: A longer word is cut at marks, and what is still longer into pieces of ``PIECE``
#: characters that overlap by one less than the longest n-gram, so none is lost.
LONG_WORD, PIECE = 24, 8
THRESHOLD = 0.7
#: Bounds of the training sample: rows of either label, and bytes of each text.
TOXIC_ROWS, CLEAN_ROWS, TEXT_BYTES = 1_000, 2_000, 10_000
STEPS = 100
RATE = 0.02
DECAY = 1e-4
SHARPEST = 6.0
#: Words whose score a worker remembers.
REMEMBERED = 120_000
NO_WORD = float("nan")
#: New words hashed at a time.
LEARNT = 50_000
MARKS = ".,;:!?\"'()[]{}*#$%&|-_~`<>/\\"


_INNER = re.compile(f"[{re.escape(MARKS)}]+")


def tokens_of(text: str | None) -> list[str]:
    """What stands between white space, lower-cased. A piece of a long word begins with a space."""
    tokens = (text or "").lower().split()
    if max(map(len, tokens), default=0) <= LONG_WORD:
        return tokens
    out = []
    for token in tokens:
        if len(token) <= LONG_WORD:
            out.append(token)
            continue
        for part in _INNER.split(token):
            if len(part) <= LONG_WORD:
                out.append(part)
            else:
                whole, step = f"<{part}>", PIECE - GRAMS[-1] + 1
                out += [f" {whole[k : k + PIECE]}" for k in range(0, len(whole) - GRAMS[-1] + 1, step)]
    return out


def framed(token: str) -> str:
    """A token with both ends of its word marked, edge marks removed; empty without a word."""
    if token[:1] == " ":
        return token[1:]
    word = token.strip(MARKS)
    return f"<{word}>" if word else ""


def buckets(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row of each n-gram's word in ``found`` and its bucket, for all framed words at once.

    The word itself is one more n-gram.
    """
    codes = np.frombuffer("".join(found).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    row = np.repeat(np.arange(len(found)), sizes)
    start = np.cumsum(sizes) - sizes
    factor = np.uint64(0x100000001B3)
    rows, hashes = [], []
    for n in GRAMS:
        last = max(len(codes) - n + 1, 0)
        h = np.full(last, n, np.uint64)
        for k in range(n):
            h = h * factor + codes[k : k + last]
        whole = row[:last] == row[n - 1 : n - 1 + last]
        rows.append(row[:last][whole])
        hashes.append(h[whole])
    if len(found):
        powers = np.cumprod(np.full(sizes.max(), factor, np.uint64))
        rows.append(np.arange(len(found)))
        hashes.append(np.add.reduceat(codes * powers[np.arange(len(codes)) - start[row]], start))
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate(rows), (h >> np.uint64(40)).astype(np.int64) % BUCKETS


def widest(upon: np.ndarray, ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The largest sum of the windows that start at each word, and where that window ends.

    ``upon`` holds the running sum before each word and after the last.
    """
    best, reach = upon[ends[0]] - upon[:-1], ends[0].copy()
    for other in ends[1:]:
        more = upon[other] - upon[:-1]
        np.copyto(reach, other, where=more > best)
        np.maximum(best, more, out=best)
    return best, reach


def train(texts: list[str | None], labels: Iterable[int], steps: int = STEPS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit vectors and softmax; returns each bucket's margin and the bias.

    Full-batch Adam, classes weighted alike. Attention over the windows of a text starts
    even and ends on the most toxic one, which is what scores it later.
    With one class only, or no text, every score is 0.5 by a zero model.
    """
    y = np.array([int(v) for v in labels], np.float64)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(BUCKETS), 0.0
    index: dict[str, int] = {}
    found = []
    for text in texts:
        ids = [index.setdefault(w, len(index)) for w in map(framed, tokens_of(text)) if w]
        found.append(np.array(ids or [-1], np.int32))
    length = np.array([len(f) for f in found])
    flat = np.concatenate(found)
    del found
    end = np.cumsum(length)
    first = end - length
    owner = np.repeat(np.arange(len(y), dtype=np.int32), length)
    place = np.arange(len(flat), dtype=np.int32)
    ends = [np.minimum(place + w, end[owner]).astype(np.int32) for w in WIDTHS]
    del place
    row, grams = buckets(list(index))
    del index
    order = np.argsort(row, kind="stable")
    # One more word without a weight stands for the gaps.
    size = np.append(np.bincount(row), 1)
    grams = np.append(grams[order], 0).astype(np.int32)
    del row, order
    gram_at = np.cumsum(size) - size
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    softmax = rng.normal(0, 0.3, (DIMENSIONS, 2))
    bias = np.zeros(2)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())
    values = (vectors, softmax, bias)
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for step in range(1, steps + 1):
        # Two classes differ by one direction, so words and n-grams pass on one number each.
        direction = softmax[:, 1] - softmax[:, 0]
        margin = vectors @ direction
        of_word = np.append(np.add.reduceat(margin[grams], gram_at)[:-1] / size[:-1], 0.0)
        margins = of_word[flat]
        upon = np.append(0.0, np.cumsum(margins))
        of_window, reach = widest(upon, ends)
        mean = np.add.reduceat(margins, first) / length
        # Attention goes from all windows alike to the most toxic one.
        sharp = SHARPEST * step / steps
        share = of_window - np.maximum.reduceat(of_window, first)[owner]
        share *= sharp
        np.exp(share, out=share)
        share /= np.add.reduceat(share, first)[owner]
        logit = np.add.reduceat(share * of_window, first) + MEAN * mean + bias[1] - bias[0]
        error = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y) * weight
        share *= error[owner]
        # A word is pulled by every window that holds it: from its start on, until its end.
        pull = np.cumsum(share - np.bincount(reach, share, len(upon))[:-1])
        pull += (MEAN * error / length)[owner]
        on_word = np.bincount(flat + 1, pull, len(size) + 1)[1:] / size
        on_word[-1] = 0.0
        on_bucket = np.bincount(grams, np.repeat(on_word, size), BUCKETS)
        on_direction = vectors.T @ on_bucket
        grads = (
            np.outer(on_bucket, direction) + DECAY * vectors,
            np.stack([-on_direction, on_direction], 1) + DECAY * softmax,
            np.array([-error.sum(), error.sum()]),
        )
        for value, grad, (m, v) in zip(values, grads, state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return vectors @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0])


class Scorer:
    """Scores texts with a trained model; remembers the margins of recent words."""

    def __init__(self, margin: np.ndarray, bias: float) -> None:
        self._margin, self._bias = margin, bias
        self._seen: dict[str, float] = {}
        self._older: dict[str, float] = {}

    def _learn(self, tokens: list[str]) -> None:
        """Remember the margins of tokens; not a number for one without a word."""
        if len(self._seen) + len(tokens) > REMEMBERED:
            self._older, self._seen = self._seen, {}
        again = {t: self._older[t] for t in tokens if t in self._older}
        self._seen.update(again)
        new = [t for t in tokens if t not in again]
        for k in range(0, len(new), LEARNT):
            part = new[k : k + LEARNT]
            found = [framed(t) or "<>" for t in part]
            row, at = buckets(found)
            means = np.bincount(row, self._margin[at], len(part)) / np.bincount(row, minlength=len(part))
            self._seen.update((t, m if f != "<>" else NO_WORD) for t, f, m in zip(part, found, means.tolist(), strict=True))

    def _values(self, tokens: list[str]) -> np.ndarray:
        found = list(map(self._seen.get, tokens))
        if None in found:
            new = list(dict.fromkeys(t for t, v in zip(tokens, found, strict=True) if v is None))
            before = self._seen
            self._learn(new)
            if self._seen is before:
                found = list(map(before.get, tokens))
            else:  # the memory was renewed: what was known still counts
                found = [self._seen[t] if v is None else v for t, v in zip(tokens, found, strict=True)]
        return np.array(found, np.float64)

    def __call__(self, text: str | None) -> float:
        """Probability of the toxic class; no words give the bias alone."""
        values = self._values(tokens_of(text))
        values = values[~np.isnan(values)]
        logit = self._bias
        if len(values):
            upon = np.append(0.0, np.cumsum(values))
            at = np.arange(len(values))
            ends = [np.minimum(at + w, len(values)) for w in WIDTHS]
            logit += widest(upon, ends)[0].max() + MEAN * values.mean()
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """text and toxic of a bounded sample: the first labelled rows in hash order.

    ``usable`` says which rows of both tables may be learnt from. At most
    ``TOXIC_ROWS`` and ``CLEAN_ROWS`` rows of either label are taken, of texts up to
    ``TEXT_BYTES`` bytes; one that is longer gives way to the next and displaces no
    other. Rows with a null id, label or text take no part, nor do ids labelled both
    ways. Only ids and sizes are shuffled; the scan that fetches the texts knows the
    chosen ids, whose number is bounded.
    """
    sized = docs.select("doc_id", "text").where(usable & F.col("text").isNotNull())
    sized = sized.where(F.octet_length("text") <= TEXT_BYTES).select("doc_id")
    marked = labels.where(usable).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where("toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
    marked = marked.where("toxic = _most").select("doc_id", "toxic")
    both = sized.dropDuplicates(["doc_id"]).join(marked, "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = both.where("toxic = 1").orderBy(*order).limit(TOXIC_ROWS)
    clean = both.where("toxic = 0").orderBy(*order).limit(CLEAN_ROWS)
    ids = F.broadcast(toxic.union(clean))  # at most TOXIC_ROWS + CLEAN_ROWS rows
    texts = docs.where(usable).select("doc_id", "text").where(F.octet_length("text") <= TEXT_BYTES).join(ids, "doc_id")
    # Rows that repeat an id give the training one text, the first in order.
    return texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[np.ndarray, float]:
    """Train on the bounded sample; the model is one number per bucket and a bias.

    A sample of one label alone is an error, as its model would reject nothing; no
    sample at all gives every text 0.5.
    """
    rows = sorted(training_rows(docs, labels, usable).collect(), key=lambda r: r["doc_id"])
    if len({r["toxic"] for r in rows}) == 1:
        raise ValueError(f"all {len(rows)} labelled texts of up to {TEXT_BYTES} bytes are labelled {rows[0]['toxic']}")
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(
    df: DataFrame,
    model: tuple[np.ndarray, float],
    text: str = "text",
    name: str = "score",
) -> DataFrame:
    """Add the toxicity of every whole text, 0 to 1, as ``name``.

    Null, empty and wordless texts get the model's bias. All columns and rows stay;
    an existing column ``name`` is replaced. The model is of fixed size.
    """
    margin, bias = model
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c != name]
    rows = df.select(*[F.col(f"`{c}`") for c in kept])
    shared = df.sparkSession.sparkContext.broadcast(margin)
    at = kept.index(text)

    def run(batches):
        scorer = Scorer(shared.value, bias)
        for batch in batches:
            scores = [scorer(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*kept, name])

    return rows.mapInArrow(run, f"{fields_of(rows)}, `{name}` double")


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
