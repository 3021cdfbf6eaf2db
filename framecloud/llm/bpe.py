"""Byte-level BPE by forced boundaries.

A pair of adjacent bytes that occurs inside no vocabulary token can lie inside no
encoded token, so a cut between them is certain. Where the pre-tokenizer is known
to cut as well, the fragments on both sides are encoded independently of each
other and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from framecloud.llm.fragments import FragmentEncoder, Ragged
from framecloud.llm.schemas import fields_of

#: White space outside ASCII: a space after one of these may belong to its run.
WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
#: Fixed value: the pattern of this family that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this both libraries class every character alike; other fragments go to the slower one.
BEYOND_LATIN = "\u0250"
#: A cut that holds for any vocabulary of this family, for texts longer than a chunk.
PLAIN_SPACE = re.compile(r"(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves; the other bytes, in order,
    take the code points from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def token_bytes(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each token id; added tokens are plain text."""
    alphabet = byte_alphabet()
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    size = max(tokenizer.get_vocab().values()) + 1
    names = (tokenizer.id_to_token(i) for i in range(size))
    return [added[i] if i in added else bytes(alphabet[c] for c in n or "") for i, n in enumerate(names)]


def unseen_pairs(tokens: list[bytes]) -> np.ndarray:
    """256 x 256 flags: the pair occurs inside no token."""
    unseen = np.ones((256, 256), bool)
    for token in tokens:
        raw = np.frombuffer(token, np.uint8)
        unseen[raw[:-1], raw[1:]] = False
    return unseen


def neutral_pairs() -> np.ndarray:
    """Pairs of ASCII bytes between which the pre-tokenizer always cuts, whatever surrounds them.

    A run of letters, digits or marks ends where another kind begins; white space
    never continues them. An apostrophe may take letters along and a space takes
    the next run along, so no cut is certain after either.
    """
    kind = np.zeros(256, np.int8)
    for b in range(0x21, 0x7F):
        kind[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3
    for b in b" \t\n\r":
        kind[b] = 4
    left, right = kind[:, None], kind[None, :]
    neutral = (left > 0) & (left < 4) & (right > 0) & (left != right)
    neutral[ord("'")] = False
    neutral[ord("'"), list(b" \t\n\r")] = True
    return neutral


class ForcedBoundaries:
    """Splits texts at certain cuts of one vocabulary."""

    def __init__(self, tokens: list[bytes]) -> None:
        unseen = unseen_pairs(tokens)
        self.cut = (unseen & neutral_pairs()).ravel()
        # The last byte of a wider character, then a space: certain unless that is white space.
        wide = np.zeros((256, 256), bool)
        wide[0x80:0xC0, list(b" \n")] = True
        self.cut_wide = self.cut | (unseen & wide).ravel()

    def split(self, text: str) -> list[bytes]:
        raw = text.encode()
        if not raw:
            return []
        codes = np.frombuffer(raw, np.uint8)
        table = self.cut if WIDE_SPACE.search(text) else self.cut_wide
        pairs = (codes[:-1].astype(np.uint16) << 8) | codes[1:]
        cuts = (np.flatnonzero(table[pairs]) + 1).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]


def segments(text: str, size: int) -> Iterator[str]:
    """Cut a long text near every ``size`` characters, only where a cut is certain."""
    start = 0
    while len(text) - start > size:
        found = PLAIN_SPACE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class ByteBpe:
    """Encoder and decoder of one tokenizer file, kept by each worker process."""

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokens = token_bytes(tokenizer)

        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        ranks = {t: i for i, t in enumerate(tokens) if t and t.decode("latin-1") not in special}
        merges = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(fragments: list[bytes]) -> list[list[int]]:
            texts = [f.decode() for f in fragments]
            plain = [max(t) < BEYOND_LATIN and not any(x in t for x in special) for t in texts]
            others = [t for t, p in zip(texts, plain, strict=True) if not p]
            rest = iter(tokenizer.encode_batch_fast(others, add_special_tokens=False))
            return [merges.encode_ordinary(t) if p else next(rest).ids for t, p in zip(texts, plain, strict=True)]

        self.encode = FragmentEncoder(ForcedBoundaries(tokens).split, encode, segments)
        self._bytes = Ragged(np.uint8)
        self._bytes.extend(tokens)
        self._decimal = Ragged(np.uint8)
        self._decimal.extend([b"%d," % i for i in range(len(tokens))])

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that form no character become U+FFFD."""
        return self._bytes.take(ids).tobytes().decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self._decimal.take(ids).tobytes()[:-1]


@lru_cache(2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", intact: str | None = None) -> DataFrame:
    """Add the token ids of ``text`` as an array column named ``ids``.

    Null and empty texts have an empty array. Rows, repeated ones too, and other
    columns stay as they are; existing columns of the added names are replaced. With
    ``intact`` a column of that name says whether the ids decode to the text again.
    """
    added = [ids] if intact is None else [ids, intact]
    df = df.drop(*[c for c in added if c != text])
    names = df.columns

    def run(batches):
        bpe = load(path)
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            rows = list(bpe.encode(texts))
            columns = [*batch.columns, as_lists(rows)]
            if intact is not None:
                same = [bpe.decode(r) == (t or "") for r, t in zip(rows, texts, strict=True)]
                columns.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    schema = f"{fields_of(df)}, `{ids}` array<int>" + (f", `{intact}` boolean" if intact else "")
    return df.mapInArrow(run, schema)


def as_lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int64)
    flat = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of an id array as ``text``, special tokens included.

    Null and empty arrays give an empty text; an id outside the vocabulary raises.
    Other columns stay; an existing column named ``text`` is replaced.
    """
    df = df.drop(text) if text != ids else df
    names = df.columns

    def run(batches):
        bpe = load(path)
        for batch in batches:
            lists = batch.column(names.index(ids))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum([n or 0 for n in pc.list_value_length(lists).to_pylist()], dtype=np.int64)
            texts = [bpe.decode(r) for r in np.split(flat, ends[:-1])] if len(lists) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, text])

    return df.mapInArrow(run, f"{fields_of(df)}, `{text}` string")


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode the ids again and return digests of both per row.

    Columns: ``key``, n_tokens, ids_sha256 (of decimal ids joined by commas) and
    decoded_sha256 (of the decoded text in UTF-8). A null text counts as empty. The
    ids stay inside the task, so no array crosses to the JVM.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for ids in bpe.encode(batch.column(1).to_pylist()):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(bpe.decimal(ids)).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return df.select(key, text).mapInArrow(run, schema)
