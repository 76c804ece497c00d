"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the model has a white-space marker after another character, so no merge can cross from one marked
word (a run of markers and the characters up to the next marker) into the next one: the words can be segmented alone.

1. Each block of about eight thousand documents gives its distinct marked words, in packets by a hash of the word: sorted and compressed, a word takes some three bytes.
2. An exchange by that hash brings all places of a word together: there it is segmented, once in the whole job, and its ids go back to each
   block that has it. This is the table of distinct words, dealt by hash; a task holds its share of it.
3. An exchange by block brings a block's entries and its documents (compressed) together. A document's ids are the entries of its words, joined by their positions, with begin
   and end; the ids are decoded by the library.

A task holds one block's entries and one slice of documents, whatever the corpus. Blocks are numbered by the rows' places in their partitions. Should a
plan that isn't deterministic deal other rows to a block when it is read again, a word without an entry is segmented on the spot: ids never depend on blocks.

Defined results: a null text counts as empty; an empty text gets the begin and end ids alone; repeated rows are encoded
each; very long texts and texts without white space are encoded like others, whole (a text without a space is one word, which is segmented
in one piece); an empty table gives an empty one; other columns of the input are kept, and `ids`, `n_tokens` and `decoded` replace
columns of these names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bound_batches, free_name, squeezed, tasks_for, unsqueezed, worker_cached

MARK = "▁"
_MARKED = re.compile(" ( *[^ ]+| *)")
#: Rows of a block, as a power of two.
BLOCK_BITS = 13


def crossing_pieces(processor) -> list[str]:
    """Pieces that have a marker after another character; the table is exact only if there are none."""
    return [p for p in map(processor.id_to_piece, range(processor.get_piece_size())) if re.search(f"[^{MARK}]{MARK}", p)]


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker, which the library adds."""
    if MARK in text:
        text = text.replace(MARK, " ")
    # Between single spaces a cut at each space is enough.
    return text.split(" ") if "  " not in text and text[:1] != " " and text[-1:] != " " else _MARKED.findall(" " + text)


class WordTable(dict):
    """Marked word, without its first marker -> its ids as little-endian 32-bit integers."""

    def __init__(self, model: str, table_words: int = 0):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        if crossing_pieces(self.processor):
            raise ValueError("the model has pieces that cross white-space markers: its texts can't be cut into words")
        self.limit = table_words
        self.begin = self.processor.bos_id().to_bytes(4, "little")
        self.end = self.processor.eos_id().to_bytes(4, "little")
        self.lone_mark = self.processor.piece_to_id(MARK)

    def segment(self, word: str) -> bytes:
        ids = self.processor.encode(word) if word else [self.lone_mark]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.limit:
            self.clear()
        entry = self[word] = self.segment(word)
        return entry

    def ids(self, text: str) -> bytes:
        return b"".join([self.begin, *map(self.__getitem__, marked_words(text)), self.end]) if text else self.begin + self.end

    def decoded(self, ids: list[bytes]) -> list[str]:
        return self.processor.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1) if ids else []

    def encode(self, text: str) -> tuple[bytes, str]:
        ids = self.ids(text)
        return ids, self.decoded([ids])[0]


def word_table(model: str) -> WordTable:
    """One processor for each worker process."""
    return worker_cached(("words", model), lambda: WordTable(model))


def pack_words(words: list[str]) -> bytes:
    """Sorted words as compressed bytes: each with its length before it."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    return _squeeze(np.array([len(r) for r in raw], "<u4").tobytes() + b"".join(raw))


def unpack_words(data: bytes, n: int) -> list[str]:
    raw = _open(data)
    ends = (4 * n + np.cumsum(np.frombuffer(raw, "<u4", n))).tolist()
    return [raw[low:high].decode("utf-8", "surrogatepass") for low, high in zip([4 * n, *ends], ends)]  # noqa: B905


def pack_entries(entries: list[bytes]) -> bytes:
    return _squeeze(np.array([len(e) // 4 for e in entries], "<u4").tobytes() + b"".join(entries))


def unpack_entries(data: bytes, n: int) -> list[bytes]:
    raw = _open(data)
    ends = (4 * n + 4 * np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64))).tolist()
    return [raw[low:high] for low, high in zip([4 * n, *ends], ends)]  # noqa: B905


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3, write_content_size=True).compress(data)


def _open(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


_PACKET = "block long, packet int, n int, words binary"


def block_words(docs: DataFrame, block: str, text: str, packets: int) -> DataFrame:
    """(block, packet, n, words): the distinct marked words of each block, dealt to packets by a hash of the word. Blocks come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words = None, set()
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                for b, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if b != at:
                        yield from emit(at, words)
                        at, words = b, set()
                    if t:
                        words.update(marked_words(t))
        yield from emit(at, words)

    def emit(at: int | None, words: set[str]) -> Iterator[pa.RecordBatch]:
        dealt: dict[int, list[str]] = {}
        for w in sorted(words):
            dealt.setdefault(zlib.crc32(w.encode("utf-8", "surrogatepass")) % packets, []).append(w)
        if dealt:
            yield pa.RecordBatch.from_arrays([pa.array([at] * len(dealt), pa.int64()), pa.array(list(dealt), pa.int32()), pa.array([len(x) for x in dealt.values()], pa.int32()), pa.array([pack_words(x) for x in dealt.values()], pa.binary())], names=["block", "packet", "n", "words"])

    return docs.select(F.col(block).alias("block"), F.col(text).alias("text")).mapInArrow(run, _PACKET)


def entries(words: DataFrame, model: str, tasks: int) -> DataFrame:
    """words (block, packet, n, words) with entries, the ids of each; a distinct word is segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = word_table(model), None
        for batch in batches:
            out = []
            for packet, n, data in zip(*(batch.column(c).to_pylist() for c in ("packet", "n", "words")), strict=True):
                if packet != at:  # the words of another packet are others
                    table.clear()
                    table.limit, at = 0, packet
                table.limit += n
                out.append(pack_entries([table[w] for w in unpack_words(data, n)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "entries"])
        table.clear()

    return words.repartition(tasks, "packet").sortWithinPartitions("packet").mapInArrow(run, f"{_PACKET}, entries binary")


def encode_decode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Adds ids (binary, little-endian unsigned 32-bit, with begin and end), n_tokens and decoded, the text that the ids decode to."""
    new = {"ids": T.BinaryType(), "n_tokens": T.LongType(), "decoded": T.StringType()}
    kept = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in new.items())])
    names = [f.name for f in kept]
    block, size, words, found, squeezed_text = (free_name(docs, n) for n in ("block", "size", "words", "entries", "squeezed"))
    bound_batches(docs.sparkSession)
    numbered = docs.select(*[F.col(f"`{n}`") for n in names if n != text], F.col(f"`{text}`").alias(squeezed_text)).withColumn(block, F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    tasks = tasks_for(docs)
    table_rows = entries(block_words(numbered, block, squeezed_text, tasks), model, tasks).select(F.col("block").alias(block), F.col("n").alias(size), F.col("words").alias(words), F.col("entries").alias(found))
    both = table_rows.unionByName(squeezed(numbered, squeezed_text), allowMissingColumns=True)
    # A block's entries stand before its documents.
    dealt = both.repartition(tasks, block).sortWithinPartitions(block, F.col(size).isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = word_table(model), None
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                rows, ids, texts = [], [], []
                for k, (b, n, w, e, t) in enumerate(zip(*(column(c).to_pylist() for c in (block, size, words, found, squeezed_text)), strict=True)):
                    if b != at:
                        table.clear()
                        table.limit, at = 1_000, b
                    if n is not None:
                        table.limit += n
                        table.update(zip(unpack_words(w, n), unpack_entries(e, n), strict=True))
                    else:
                        rows.append(k)
                        texts += unsqueezed([t])
                        ids.append(table.ids(texts[-1] or ""))
                if rows:
                    own = part.take(pa.array(rows, pa.int64()))
                    told = pa.array(texts, pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [*(told if c == text else own.column(own.schema.get_field_index(c)) for c in names), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(table.decoded(ids), pa.string())],
                        names=[*names, *new],
                    )
        table.clear()

    return dealt.mapInArrow(run, schema)
