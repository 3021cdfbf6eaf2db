"""Merge-type piece encoding by backtracking instead of by merging.

A row of pieces is what the merges give exactly if each piece is what merging its own
text gives and merging the text of any two neighbours gives these two again. So a text
is read from the left: the longest piece first, shorter ones when it does not agree with
the piece before. Where no piece agrees, the place is no boundary of the result; it is
marked in a bitfield, never tried again, and the piece before is taken back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_format

from framecloud.llm.bpe import as_lists
from framecloud.llm.fragments import FragmentEncoder
from framecloud.llm.schemas import fields_of

#: Fixed value: the character that stands for a space in pieces.
SPACE = "▁"
#: Verdicts on neighbours a worker remembers; they are found again when forgotten.
REMEMBERED_PAIRS = 500_000
#: Characters from which on a compact array holds the longest pieces.
LONG = 10_000

_CUT = re.compile(f"(?<=[^{SPACE}]){SPACE}")


class Backtracking:
    """Encoder of texts over one vocabulary: ``scores`` by piece, higher merges first."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int]) -> None:
        self._scores = scores
        self.alphabet = {c for piece in scores for c in piece}
        lone = self.alphabet - scores.keys()
        if lone:
            raise ValueError(f"{len(lone)} characters of the vocabulary are no pieces themselves")
        # A piece that merging does not give from its own text never stands in a result.
        self._pieces = [p for p in scores if self.merged(p) == [p]]
        self._ids = [ids[p] for p in self._pieces]
        self._size = [len(p) for p in self._pieces]
        self._automaton = ahocorasick.Automaton()
        for number, piece in enumerate(self._pieces):
            self._automaton.add_word(piece, (len(piece), number))
        self._automaton.make_automaton()
        number_of = {p: k for k, p in enumerate(self._pieces)}
        self._shorter = [
            next((number_of[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in number_of), -1)
            for p in self._pieces
        ]
        self._agree: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: highest score first, leftmost among equals."""
        parts = list(text)
        nothing = float("-inf")
        while len(parts) > 1:
            scores = [self._scores.get(a + b, nothing) for a, b in pairwise(parts)]
            best = max(scores)
            if best == nothing:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def agree(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when their joint text is merged anew."""
        if len(self._agree) >= REMEMBERED_PAIRS:
            self._agree.clear()
        pair = [self._pieces[left], self._pieces[right]]
        known = self._agree[left << 32 | right] = self.merged("".join(pair)) == pair
        return known

    def encode(self, text: str) -> list[int]:
        """Ids of a text whose characters all belong to the vocabulary."""
        n = len(text)
        longest = [0] * n if n < LONG else np.zeros(n, np.int32)
        for end, (size, number) in self._automaton.iter(text):
            longest[end - size + 1] = number  # later ends are longer pieces
        size, shorter, known = self._size, self._shorter, self._agree
        failed = bytearray((n >> 3) + 1)
        chosen: list[int] = []
        at = before = 0
        while at < n:
            piece = int(longest[at])
            while True:
                end = at + size[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if not at:
                        break
                    fits = known.get(before << 32 | piece)
                    if self.agree(before, piece) if fits is None else fits:
                        break
                piece = shorter[piece]
                while piece < 0:  # no boundary here: take back, and try what is shorter there
                    failed[at >> 3] |= 1 << (at & 7)
                    taken = chosen.pop()
                    at -= size[taken]
                    piece = shorter[taken]
                    before = chosen[-1] if chosen else 0
            chosen.append(piece)
            before, at = piece, end
        return [self._ids[k] for k in chosen]


class PieceBpe:
    """Encoder and decoder of one model file, kept by each worker process.

    Takes merge-type models with byte pieces for unknown characters and without a
    normalization table, user-defined or unused pieces; others raise an error.
    """

    def __init__(self, path: str) -> None:
        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = model_format.ModelProto()
        model.ParseFromString(self._library.serialized_model_proto())
        kind = model_format.ModelProto.SentencePiece
        rules = model.normalizer_spec
        plain = rules.add_dummy_prefix and rules.escape_whitespaces
        if model.trainer_spec.model_type != model_format.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte pieces can be read")
        if not plain or rules.remove_extra_whitespaces or rules.precompiled_charsmap:
            raise ValueError("models that normalize texts are not supported")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        if any(_CUT.search(p) for p in normal):
            raise ValueError("a piece holds a space after another character")
        byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self._byte = [byte[f"<0x{b:02X}>"] for b in range(256)]
        self._table = Backtracking({p: model.pieces[i].score for p, i in normal.items()}, normal)
        self.begin, self.end = self._library.bos_id(), self._library.eos_id()
        # A fragment is spaces with what follows them; unknown characters, across which
        # nothing merges, are fragments of their own.
        other = "".join(map(re.escape, self._table.alphabet - {SPACE}))
        split = re.compile(f"{SPACE}+[{other}]*|[{other}]+|[^{other}{SPACE}]+").findall
        self._encoder = FragmentEncoder(split, self._fragments, _segments)

    def _fragments(self, fragments: list[str]) -> list[list[int]]:
        known, byte = self._table.alphabet, self._byte
        return [self._table.encode(f) if f[0] in known else [byte[b] for b in f.encode()] for f in fragments]

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text without begin and end; null and empty texts have none."""
        return self._encoder([SPACE + t.replace(" ", SPACE) if t else "" for t in texts])

    def decode(self, rows: Sequence[np.ndarray]) -> list[str]:
        return [self._library.decode(r.tolist()) for r in rows]


def _segments(text: str, size: int) -> Iterator[str]:
    """Cut a long text near every ``size`` characters, where a fragment begins."""
    start = 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


@lru_cache(2)
def load(path: str) -> PieceBpe:
    return PieceBpe(path)


def _framed(pieces: PieceBpe, texts: Sequence[str | None], ends: bool) -> Iterator[np.ndarray]:
    for ids in pieces.encode(texts):
        yield np.concatenate([[pieces.begin], ids, [pieces.end]]).astype(np.int32) if ends else ids


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", ends: bool = True) -> DataFrame:
    """Add the ids of ``text`` as an array column, with begin and end ids if ``ends``.

    Null and empty texts have those two only. Rows, repeated ones too, and other columns
    stay as they are; an existing column named ``ids`` is replaced.
    """
    df = df.drop(ids) if ids != text else df
    names = df.columns

    def run(batches):
        pieces = load(path)
        for batch in batches:
            rows = list(_framed(pieces, batch.column(names.index(text)).to_pylist(), ends))
            yield pa.RecordBatch.from_arrays([*batch.columns, as_lists(rows)], [*names, ids])

    return df.mapInArrow(run, f"{fields_of(df)}, `{ids}` array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of an id array; null and empty arrays give an empty text.

    An id outside the vocabulary raises. Other columns stay; an existing column named
    ``text`` is replaced.
    """
    df = df.drop(text) if text != ids else df
    names = df.columns

    def run(batches):
        pieces = load(path)
        for batch in batches:
            rows = [np.array(r or [], np.int64) for r in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces.decode(rows), pa.string())], [*names, text])

    return df.mapInArrow(run, f"{fields_of(df)}, `{text}` string")


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text with begin and end ids, decode, and return digests of both.

    Columns: ``key``, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 (of the decoded text in UTF-8). A null text counts as
    empty; null and repeated keys stay rows of their own. The ids stay inside the task.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        pieces = load(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for ids in _framed(pieces, batch.column(1).to_pylist(), True):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(pieces.decode([ids])[0].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return df.select(key, text).mapInArrow(run, schema)
