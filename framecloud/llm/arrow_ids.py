"""Token ids in Arrow files of equal-length sequences.

Documents in ascending key order form one stream of ids. Each task cuts its range
of the stream into sequences of ``length`` ids and writes them as record batches
with two fixed-size-list columns, ``input_ids`` and ``mask`` (false for padding in
a file's last sequence), in the Arrow file format: a stream with a footer, so a
reader maps the file and reaches any sequence without decoding or copying. A
second file beside it holds where each document lies.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from framecloud.llm.bpe import byte_alphabet, segments
from framecloud.llm.fragments import FragmentEncoder, gather
from framecloud.llm.storage import attempt_name, filesystem, open_input, open_output, written

SEQUENCE = 2048
BATCH_SEQUENCES = 512
#: Characters of whole texts whose different words are found and encoded together.
CHUNK_CHARS = 8_000_000
#: No piece holds white space, so a space can stand for the end of one.
PIECE_END = b" "
#: After the pieces of every word.
WORD_END = "\n "
#: Fixed value: the white space of Latin-1 that can stand inside a word.
INNER_SPACE = r"[\t\x0b\x0c\r\x{85}\x{a0}]"
#: Fixed value: the pattern of this tokenizer that splits a word before the merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+"
MANIFEST = "part int, ids_path string, docs_path string, n_docs bigint, n_tokens bigint"


def word_merges(tokenizer: Tokenizer) -> tiktoken.Encoding:
    """The tokenizer's merges as byte ranks, for pieces that each end in a space.

    Ids are the order of the merges, and a byte with the end of its piece comes before
    all of them, so the lowest rank first gives the same ids. The end of a word is an id
    of its own, above all others.
    """
    alphabet, added, vocab = byte_alphabet(), tokenizer.get_added_tokens_decoder(), tokenizer.get_vocab()
    ranks = {}
    for name, i in vocab.items():
        if i not in added:
            stem = name.removesuffix("</w>") if len(name) > 4 else name
            ranks[bytes(alphabet[c] for c in stem) + (PIECE_END if stem != name else b"")] = i
    ranks[WORD_END.encode()] = max(vocab.values()) + 1
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})


class WordEncoder(FragmentEncoder):
    """Encoder of a tokenizer that drops white space, by the different words of a chunk.

    Arrow splits the texts, finds their different words and cuts those into pieces; one
    call of the merge table takes them all. No word is kept beyond its chunk.
    """

    def __init__(self, path: str, chunk: int = CHUNK_CHARS) -> None:
        super().__init__(self._words, self._word_ids, segments, chunk=chunk)
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._merges = word_merges(self._tokenizer)
        self._word_end = self._merges.max_token_value
        special = "|".join(re.escape(t.content) for t in self._tokenizer.get_added_tokens_decoder().values())
        #: Not for the merge table: wider characters, and special tokens in any case.
        self._odd = r"[^\x{00}-\x{ff}]" + (f"|(?i:{special})" if special else "")

    def _words(self, texts: list[str]) -> pa.ListArray:
        """Words between spaces and line ends, ASCII letters lowered where that changes nothing.

        The tokenizer lowers case itself, but composes combining marks and recognises
        its special tokens first, so texts with either stay as they are.
        """
        lines = pc.replace_substring(pa.array(texts, pa.string()), "\n", " ")
        odd = pc.match_substring_regex(lines, self._odd)
        return pc.split_pattern(pc.if_else(odd, lines, pc.ascii_lower(lines)), " ")

    def _word_ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in one array, and where in it those of each word start and how many they are."""
        odd = pc.match_substring_regex(words, self._odd)
        plain = pc.replace_substring_regex(pc.utf8_lower(words.filter(pc.invert(odd))), INNER_SPACE, " ")
        pieces = pc.replace_substring_regex(plain, PIECES, r"\0 ")
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), WORD_END)[0].as_py()
        ids = self._merges.encode_to_numpy(joined + WORD_END if len(pieces) else "", disallowed_special=())
        ends = np.flatnonzero(ids == self._word_end)
        sizes = np.diff(ends, prepend=-1) - 1
        others = [e.ids for e in self._tokenizer.encode_batch_fast(words.filter(odd).to_pylist(), add_special_tokens=False)]
        other_sizes = np.fromiter(map(len, others), np.int64, len(others))
        other_ids = np.fromiter(chain.from_iterable(others), np.int32, int(other_sizes.sum()))
        start, length = np.empty((2, len(words)), np.int64)
        is_odd = odd.to_numpy(zero_copy_only=False)
        start[~is_odd], length[~is_odd] = ends - sizes, sizes
        start[is_odd], length[is_odd] = len(ids) + np.cumsum(other_sizes) - other_sizes, other_sizes
        return np.concatenate([ids.astype(np.int32), other_ids]), start, length

    def _together(self, texts: list[str]) -> Iterator[np.ndarray]:
        words = self._split(texts)
        different = words.flatten().dictionary_encode()
        flat, start, length = self._encode(different.dictionary)
        at = different.indices.to_numpy()
        ids = gather(flat, start[at], length[at])
        upto = np.concatenate([[0], np.cumsum(length[at])])[words.offsets.to_numpy()]
        for first, end in zip(upto[:-1], upto[1:], strict=True):
            yield ids[first:end]


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of one tokenizer file, kept by each worker process."""
    return WordEncoder(path)


def id_type(path: str) -> np.dtype:
    """The narrowest unsigned type that holds every id of the tokenizer."""
    top = max(Tokenizer.from_file(path).get_vocab().values())
    return np.dtype(np.uint16 if top < 1 << 16 else np.uint32)


class SequenceWriter:
    """Appends ids to a file of fixed-size sequences; holds one batch at most."""

    def __init__(self, uri: str, dtype: np.dtype, length: int, batch: int) -> None:
        self.length, self.step, self.dtype = length, length * batch, dtype
        values = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema({"input_ids": pa.list_(values, length), "mask": pa.list_(pa.bool_(), length)})
        self._sink = open_output(uri)
        self._file = pa.ipc.new_file(self._sink, self.schema)
        self._held: list[np.ndarray] = []
        self._size = 0

    def append(self, ids: np.ndarray) -> None:
        self._held.append(ids.astype(self.dtype))
        self._size += len(ids)
        if self._size >= self.step:
            flat = np.concatenate(self._held)
            for at in range(0, len(flat) - self.step + 1, self.step):
                self._write(flat[at : at + self.step], self.step)
            rest = flat[len(flat) // self.step * self.step :]
            self._held, self._size = [rest], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = (pa.array(ids), pa.array(mask))
        lists = [pa.FixedSizeListArray.from_arrays(c, self.length) for c in columns]
        self._file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self._size:
            flat = np.concatenate(self._held)
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self._file.close()
        self._sink.close()


class SequenceFile:
    """Random access to a written file; ids come as views of the mapped file."""

    def __init__(self, uri: str) -> None:
        store, path = filesystem(uri)
        local = store.type_name == "local"
        self._file = pa.ipc.open_file(pa.memory_map(path) if local else open_input(uri))
        field = self._file.schema.field("input_ids").type
        self.length = field.list_size
        first = self._file.get_batch(0).num_rows if self._file.num_record_batches else 0
        self.step = max(1, first * self.length)
        self._batch: tuple[int, np.ndarray] = (-1, np.empty(0))

    def _values(self, batch: int) -> np.ndarray:
        if self._batch[0] != batch:
            column = self._file.get_batch(batch).column("input_ids")
            self._batch = (batch, column.flatten().to_numpy(zero_copy_only=True))
        return self._batch[1]

    def spans(self, start: int, count: int) -> Iterator[np.ndarray]:
        """Ids ``start`` to ``start + count`` of the file, one view per batch."""
        while count > 0:
            batch, at = divmod(start, self.step)
            view = self._values(batch)[at : at + count]
            yield view
            start, count = start + len(view), count - len(view)

    def sequence(self, row: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of one sequence."""
        batch, at = divmod(row * self.length, self.step)
        mask = self._file.get_batch(batch).column("mask")
        return self._values(batch)[at : at + self.length], mask[at // self.length].values


def write_sequences(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    length: int = SEQUENCE,
    batch: int = BATCH_SEQUENCES,
    partitions: int | None = None,
) -> DataFrame:
    """Write all documents and return the manifest, one row per file.

    A null text counts as empty and still gets its end id. Null keys come first;
    rows that share a key follow each other in order of their text. An empty table
    gives an empty manifest. Other columns are not written. The work runs once,
    here; a repeated task writes files of its own and only those it returns count.
    """
    dtype = id_type(path)
    columns = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    by_key = ([partitions] if partitions else []) + [order[0]]
    ranges = columns.repartitionByRange(*by_key).sortWithinPartitions(*order)

    def run(batches):
        encoder = word_encoder(path)
        part = TaskContext.get().partitionId()
        writer = docs_sink = None
        n_docs = n_tokens = 0
        schema = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()})
        for rows in batches:
            if rows.num_rows == 0:
                continue
            if writer is None:
                names = [attempt_name(folder, part, s) for s in (".ids.arrow", ".docs.arrow")]
                writer = SequenceWriter(names[0], dtype, length, batch)
                docs_sink = open_output(names[1])
                docs_file = pa.ipc.new_file(docs_sink, schema)
            sizes = []
            for ids in encoder(rows.column(1).to_pylist()):
                writer.append(np.append(ids, end_id))
                sizes.append(len(ids) + 1)
            sizes = np.array(sizes, np.int64)
            starts = n_tokens + np.cumsum(sizes) - sizes
            docs_file.write_batch(pa.record_batch([rows.column(0), pa.array(starts), pa.array(sizes)], schema=schema))
            n_docs += len(sizes)
            n_tokens += int(sizes.sum())
        if writer is not None:
            writer.close()
            docs_file.close()
            docs_sink.close()
            values = ([part], [names[0]], [names[1]], [n_docs], [n_tokens])
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch(
                [pa.array(v, k) for v, k in zip(values, kinds, strict=True)],
                names=["part", "ids_path", "docs_path", "n_docs", "n_tokens"],
            )

    return written(ranges.mapInArrow(run, MANIFEST), f"{folder}/manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files.

    ``start`` counts the ids of all documents before, over all files; the checksum
    is of the ids as little-endian unsigned 32-bit integers. Each task maps the
    files of one manifest row. The window runs over one row per file.
    """
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = based.select("ids_path", "docs_path", "base").repartition(max(1, manifest.count()))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = SequenceFile(row["ids_path"])
                with pa.ipc.open_file(open_input(row["docs_path"])) as docs:
                    for k in range(docs.num_record_batches):
                        rows = docs.get_batch(k)
                        starts, sizes = rows.column(1).to_pylist(), rows.column(2).to_pylist()
                        sums = []
                        for start, size in zip(starts, sizes, strict=True):
                            crc = 0
                            for view in ids.spans(start, size):
                                crc = zlib.crc32(view.astype("<u4"), crc)
                            sums.append(crc)
                        yield pa.record_batch(
                            [rows.column(0), pa.array([s + row["base"] for s in starts], pa.int64()), rows.column(2), pa.array(sums, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
