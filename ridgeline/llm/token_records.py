"""Token-ID output: framed binary records with masked checksums and an offset index.

File format, for each document in ascending ``doc_id`` order::

    uint64  length of the data, little endian
    uint32  masked CRC-32C of those eight bytes
    bytes   the ids, little endian, two bytes each (four for vocabularies over 65,536)
    uint32  masked CRC-32C of the data

which is the record framing of TFRecord files.  The index, a Parquet table beside the files,
has a row per record: ``doc_id, part, file, offset, n_bytes, n_tokens, first`` where ``first``
counts the ids before the record in its file.  Any order of reads is served by the index.

Defined results: null text is an empty document (its end id only); a null ``doc_id`` sorts
first; rows that share a ``doc_id`` keep one record each, in the order of a hash of their texts; a very
long text is one record, which its task holds whole; an empty table gives an empty index; other
columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm import files
from ridgeline.llm.crc32c import crc32c, masked
from ridgeline.llm.tasks import kept, slim
from ridgeline.session import materialize, run_path

END_ID = 1
HEADER = 12
READ_AHEAD = 4 << 20
PIECE_BYTES = 8 << 20  # of a file, read by one task
INDEX_SCHEMA = "doc_id long, part int, file string, offset long, n_bytes long, n_tokens long, first long"
_INDEX_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("file", pa.string()), *((n, pa.int64()) for n in ("offset", "n_bytes", "n_tokens", "first"))])

#: The splits that word tokenizers' files name in their "pre_tokenizer", and all else there that matters.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_SPLITS = [
    {"type": "Split", "pattern": {"Regex": PIECES.pattern}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


class Encoder:
    """Encodes texts with a tokenizer file, remembering the ids of words.

    White space always ends a token of a word tokenizer, so a text's ids are those of its
    words, one after another, and each word goes through the library once while it is
    remembered.  Memory is bounded: of the words, the last one or two ``limit`` are kept.  Texts
    of any other tokenizer go through the library whole.
    """

    def __init__(self, path: str, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4"
        self.limit = limit
        self.words, self.older_words = {}, {}
        self.pieces, self.older_pieces = {}, {}
        specials = (t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.special = regex.compile("|".join(map(regex.escape, specials)) or "(?!)")
        self.by_word = self._splits_at_blanks()
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.packers = [struct.Struct(f"<{n}{'H' if self.width == '<u2' else 'I'}").pack for n in range(17)]

    def _splits_at_blanks(self) -> bool:
        """Whether the tokenizer is of the kind whose words, and pieces of words, stand alone."""
        state = json.loads(self.tokenizer.to_str())
        normalizer, splits, model = state["normalizer"] or {}, state["pre_tokenizer"] or {}, state["model"]
        plain = not any(state[k] for k in ("truncation", "padding", "post_processor")) and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in state["added_tokens"])
        return plain and normalizer.get("normalizers") == _WORD_NORMALIZER and splits.get("pretokenizers") == _WORD_SPLITS and model["type"] == "BPE" and not model["dropout"] and not model["byte_fallback"]

    def _ids(self, ids: list[int]) -> bytes:
        return self.packers[len(ids)](*ids) if len(ids) < len(self.packers) else np.array(ids, self.width).tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece) or self.older_pieces.get(piece)
        if got is None:
            mapped = piece if piece.isascii() and piece.isprintable() else "".join(map(self.byte_chars.__getitem__, piece.encode()))
            got = self._ids([t.id for t in self.tokenizer.model.tokenize(mapped)])
        self.pieces[piece] = got
        return got

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        # Up to U+00FF lower-casing is plain and no characters combine; all else is left to the library.
        if (word.isascii() or max(text) <= "ÿ") and not self.special.search(text):
            # ASCII letters alone are one piece.
            return self._piece(text.lower()) if word.isalpha() else b"".join([self._piece(p) for p in PIECES.findall(text.lower())])
        return self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        """The ids of a text, as little-endian bytes of ``width``."""
        if not self.by_word:
            return self._ids(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        words = text.split()
        if len(self.words) > self.limit:
            self.words, self.older_words = {}, self.words
        if len(self.pieces) > self.limit:
            self.pieces, self.older_pieces = {}, self.pieces
        known = self.words
        for word in set(words).difference(known):
            known[word] = self.older_words.get(word) or self._word(word)
        return b"".join([known[w] for w in words])


def encoder(path: str) -> Encoder:
    """One for each Python worker, which Spark uses again for later tasks; tasks that encode nothing let go of it."""
    return kept("encoder", path, lambda: Encoder(path))


def _frames(payloads: list[bytes]) -> list[bytes]:
    sizes = [struct.pack("<Q", len(p)) for p in payloads]
    size_crc, data_crc = masked(crc32c(sizes)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [s + a.tobytes() + p + b.tobytes() for s, a, p, b in zip(sizes, size_crc, payloads, data_crc)]


def write_records(docs: DataFrame, tokenizer_path: str, target: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every document and write record files to ``target``; returns the committed index.

    One shuffle by ranges of ``doc_id`` moves the texts; each task then streams its sorted
    rows into one file, holding one batch of rows in memory.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        end = np.array([end_id], words.width).tobytes()
        part, out, at, first = TaskContext.get().partitionId(), None, 0, 0
        name = files.attempt_name(part, ".tfrecord")
        try:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
                for lo in range(0, len(batch), 1024):
                    payloads = [words.encode(t.as_py() or b"") + end for t in texts[lo : lo + 1024]]
                    if out is None:
                        store, folder = files.open_store(target)
                        store.create_dir(folder, recursive=True)
                        out = store.open_output_stream(f"{folder}/{name}")
                    out.write(b"".join(_frames(payloads)))
                    size = np.array([len(p) for p in payloads], np.int64)
                    counts, framed = size // np.dtype(words.width).itemsize, size + HEADER + 4
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids[lo : lo + 1024],
                            pa.array(np.full(len(size), part, np.int32)),
                            pa.array([name] * len(size)),
                            *map(pa.array, (at + np.cumsum(framed) - framed, size, counts, first + np.cumsum(counts) - counts)),
                        ],
                        schema=_INDEX_ARROW,
                    )
                    at, first = at + int(framed.sum()), first + int(counts.sum())
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialize(ordered.mapInArrow(slim(write, "encoder"), INDEX_SCHEMA), "token-index")


def read_records(index: DataFrame, target: str, width: str = "<u2") -> DataFrame:
    """Read the records that ``index`` names, in any split or order, checking both checksums.

    Returns the index columns and ``ids``, the data of the record (``width`` ids, little endian).
    """
    schema = pa.schema([*_INDEX_ARROW, ("ids", pa.large_binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = files.open_store(target)
        for batch in batches:
            names, offsets, sizes = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            lo = 0
            while lo < len(names):
                hi, end = lo, offsets[lo]
                while hi < len(names) and names[hi] == names[lo] and offsets[hi] == end and (hi == lo or end - offsets[lo] < READ_AHEAD):
                    end, hi = end + sizes[hi] + HEADER + 4, hi + 1
                with store.open_input_file(f"{folder}/{names[lo]}") as source:
                    block = source.read_at(end - offsets[lo], offsets[lo])
                data, heads, tails, lengths = [], [], [], []
                for k in range(lo, hi):
                    at = offsets[k] - offsets[lo]
                    lengths.append(block[at : at + 8])
                    data.append(block[at + HEADER : at + HEADER + sizes[k]])
                    heads.append(block[at + 8 : at + HEADER])
                    tails.append(block[at + HEADER + sizes[k] : at + HEADER + sizes[k] + 4])
                sound = lengths == [struct.pack("<Q", n) for n in sizes[lo:hi]] and b"".join(heads) == masked(crc32c(lengths)).astype("<u4").tobytes() and b"".join(tails) == masked(crc32c(data)).astype("<u4").tobytes()
                if not sound:
                    raise ValueError(f"damaged record in {names[lo]} between bytes {offsets[lo]} and {end}")
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(data, pa.large_binary())], schema=schema)
                lo = hi

    # A stated number of partitions: left to itself, Spark would size them by the few bytes of the index.
    total = index.agg(F.sum("n_bytes")).first()[0] or 0
    pieces = max(1, -(-total // PIECE_BYTES))
    placed = index.repartition(pieces, "file", F.floor(F.col("offset") / PIECE_BYTES)).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(slim(read), f"{INDEX_SCHEMA}, ids binary")


def record_digests(index: DataFrame, target: str, width: str = "<u2") -> DataFrame:
    """Per record, from the files: ``doc_id, part, n_tokens, first`` and the CRC-32 of its ids as uint32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(x.as_py(), width) for x in batch.column(3)]
            crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in data]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in data], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "first", "n_tokens", "ids_crc32"])

    kept = read_records(index, target, width).select("doc_id", "part", "first", "ids")
    return kept.mapInArrow(digest, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")


def token_ids(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents as records, read the files back: ``doc_id, start, n_tokens, ids_crc32``."""
    target = run_path(spark, "token-records")
    index = write_records(docs, tokenizer_path, target)
    width = encoder(tokenizer_path).width
    # One row for each file, so the running total over files is small whatever the input.
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    read = record_digests(index, target, width)
    return read.join(before, "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
