"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, each holding the ids of a few documents (4-byte little-endian,
every document ended by the end id), then a skippable frame with the documents' ids and lengths,
then the seek table of zstandard's seekable format: for every frame its compressed and plain size
and the low 32 bits of the xxh64 checksum of its plain bytes. A reader gets a document by the seek
table's sums: it reads, decompresses and checks that frame alone. Plain zstandard tools can
decompress the whole file too.

Documents are dealt to files by ranges of (doc_id, hash), so that the files, in order, hold them in
ascending order; a task writes one file as a stream, under a name of its own, and hands on one row.
A task that is run again writes a new file; only files named in the manifest count.
"""

from __future__ import annotations

import functools
import gc
import os
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from plumbtrace.sources.scratch import fresh_path, materialise

END_ID = 0
FRAME_BYTES = 1 << 18
#: Input bytes that one file holds about.
FILE_BYTES = 64 << 20
#: Distinct pieces of text whose ids a worker keeps, half of them from before the last turn.
CACHE_PIECES = 800_000

#: Fixed values of the public seekable format.
SKIPPABLE, SEEK_MAGIC, INDEX_MAGIC, HAS_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50, 0x80


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    """Loaded once for each worker; a worker has one task at a time, so threads would only add memory."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    made = PieceEncoder(path)
    # the known pieces hold no cycles; otherwise the collector walks all of them again and again
    gc.freeze()
    return made


def _byte_letters() -> dict[int, str]:
    """The letter that stands for a byte in byte-level vocabularies: itself if it is printable, else the next free one."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class _Pieces(dict):
    """Piece -> ids as bytes; a piece that isn't known yet is encoded by the library and kept."""

    _LETTERS = _byte_letters()
    #: A line end beside white space or an end of the piece: the cut there isn't safe.
    _ODD_LINE = re.compile(r"(?:^|\s)\n|\n(?:\s|\Z)")

    def __init__(self, tokenizer, lead: str, first: _Pieces | None = None):
        super().__init__()
        #: Where pieces without a lead are known, and the letters that stand for this lead.
        self.first, self.mark = self if first is None else first, "".join(map(self._LETTERS.__getitem__, lead.encode("utf-8")))
        #: What was known before the last turn; pieces that come again move over.
        self.older: dict[str, bytes] = {}
        self.tokenizer, self.model, self.lead = tokenizer, tokenizer.model, lead
        self.line_end = np.array(tokenizer.encode("\n", add_special_tokens=False).ids, "<u4").tobytes()

    def turn(self) -> None:
        """Forget what hasn't come since the last turn."""
        self.older = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None)
        if ids is None:
            if "\n" in piece and not self._ODD_LINE.search(piece):
                # lines are known by their own; two words that a line end joins seldom come again, so they aren't kept
                head, *lines = piece.split("\n")
                return self.line_end.join([self[head], *map(self.first.__getitem__, lines)])
            word = piece if piece.isalpha() else piece.rstrip(string.punctuation)
            if not word.isalpha():
                found = self.tokenizer.encode(self.lead + piece, add_special_tokens=False).ids
                ids = struct.pack(f"<{len(found)}I", *found)
            elif len(word) < len(piece):
                ids = self[word] + self.first[piece[len(word):]]
            else:
                # letters alone are one word of the pattern, so the vocabulary's merges can be asked directly
                letters = piece if piece.isascii() else "".join(map(self._LETTERS.__getitem__, piece.encode("utf-8")))
                found = self.model.tokenize(self.mark + letters)
                ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        self[piece] = ids
        return ids


class PieceEncoder:
    """Encodes whole texts with a byte-level BPE file, piece by piece.

    The vocabulary's word pattern never joins a blank with what stands before it, so a text may be cut
    before each space that follows a character other than white space. Marks after a letter, up to the end of a piece,
    are a word of their own too, and so is a line end between two characters other than white space. Pieces repeat,
    so the library encodes each of them once for as long as it is kept.
    """

    #: White space before a space: the cut there isn't safe.
    _ODD = [c + " " for c in map(chr, range(0x3001)) if c.isspace()]

    def __init__(self, path: str, cache: int = CACHE_PIECES):
        self.tokenizer, self.cache = _tokenizer(path), cache
        #: Pieces as they stand, and pieces after a space.
        self.first = _Pieces(self.tokenizer, "")
        self.later = _Pieces(self.tokenizer, " ", self.first)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for known in (self.first, self.later):
            if len(known) > self.cache // 2:
                known.turn()
        out = []
        get = self.later.__getitem__
        for text in texts:
            if any(map(text.__contains__, self._ODD)):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                head, *rest = text.split(" ")
                out.append(b"".join([self.first[head] if head else b"", *map(get, rest)]))
        return out


class FrameWriter:
    """Writes one file; `write` only needs a binary stream."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.press = zstandard.ZstdCompressor(level=3)
        self.buffer, self.held, self.table = [], 0, []
        self.ids, self.null, self.lengths = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.buffer.append(ids)
        self.held += len(ids)
        self.ids.append(0 if doc_id is None else doc_id)
        self.null.append(doc_id is None)
        self.lengths.append(len(ids) // 4)
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            plain = b"".join(self.buffer)
            self._frame(self.press.compress(plain), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF)
            self.buffer, self.held = [], 0

    def _frame(self, data: bytes, plain: int, check: int) -> None:
        self.out.write(data)
        self.table.append((len(data), plain, check))

    def close(self) -> int:
        """Ends the file; returns the number of ids in it."""
        self.flush()
        index = self.press.compress(
            struct.pack("<I", len(self.ids)) + np.asarray(self.ids, "<i8").tobytes() + np.asarray(self.lengths, "<i8").tobytes()
            + np.asarray(self.null, "u1").tobytes()
        )
        self._frame(struct.pack("<II", INDEX_MAGIC, len(index)) + index, 0, 0)
        body = b"".join(struct.pack("<III", *row) for row in self.table)
        body += struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        return sum(self.lengths)


class FrameReader:
    """Random access to one file; `file` needs read, seek and tell."""

    def __init__(self, file):
        self.file = file
        self.file.seek(-9, 2)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        self.file.seek(-9 - 12 * n, 2)
        table = np.frombuffer(self.file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.plain, self.check = table.T
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        self.plain_at = np.concatenate([[0], np.cumsum(self.plain)])
        self.file.seek(int(self.at[n - 1]) + 8)
        index = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.packed[n - 1]) - 8))
        m = struct.unpack("<I", index[:4])[0]
        self.doc_ids = np.frombuffer(index, "<i8", m, 4)
        self.lengths = np.frombuffer(index, "<i8", m, 4 + 8 * m)
        self.null = np.frombuffer(index, "u1", m, 4 + 16 * m).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._frame = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._frame[0] != k:
            self.file.seek(int(self.at[k]))
            plain = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.packed[k])), max_output_size=int(self.plain[k]))
            if len(plain) != self.plain[k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.check[k]:
                raise ValueError(f"frame {k} is damaged")
            self._frame = (k, plain)
        return self._frame[1]

    def document(self, place: int) -> bytes:
        """Ids of the document at a place of the file; only its frame is decompressed."""
        first = 4 * int(self.starts[place])
        k = int(np.searchsorted(self.plain_at, first, "right")) - 1
        offset = first - int(self.plain_at[k])
        return self.frame(k)[offset:offset + 4 * int(self.lengths[place])]

    def places(self, doc_id: int) -> list[int]:
        return np.flatnonzero((self.doc_ids == doc_id) & ~self.null).tolist()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all `docs` (doc_id, text) below `folder`; returns the manifest (shard, path, n_docs, n_tokens), stored.

    Documents stand in ascending order of doc_id (null first, equal ids by a hash of their text); a
    null or empty text is the end id alone; repeated rows are written as often as they come.
    `folder` must be one that all executors reach (a path or URI that pyarrow's file systems open).
    No rows: no files, and an empty manifest.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // file_bytes))
    ranged = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    ranged = ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, encode, writer, out, path, shard, n = struct.pack("<I", END_ID), None, None, None, "", -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encode, shard = _encoder(tokenizer), batch.column("shard")[0].as_py()
                path = f"{folder}/tokens-{shard:06d}-{uuid.uuid4().hex}.zst"
                files_of, inner = _filesystem(path)
                files_of.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                out = files_of.open_output_stream(inner, compression=None)
                writer = FrameWriter(out)
            for k in range(0, batch.num_rows, 256):
                # of a batch's texts, few at a time are Python's
                part = batch.slice(k, 256)
                for doc_id, coded in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                    writer.add(doc_id, coded + end)
                    n += 1
        if writer is not None:
            tokens = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [n], "n_tokens": [tokens]})

    return materialise(ranged.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "token_manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, shard, place.

    `start` counts the ids of all documents before it. One task per file; every frame is checked.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    parts = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = parts.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "shard")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, path, first in zip(batch["shard"], batch["path"], batch["first"]):
                files_of, inner = _filesystem(path)
                with files_of.open_input_file(inner) as file:
                    r = FrameReader(file)
                    crc = [zlib.crc32(r.document(k)) for k in range(len(r.lengths))]
                    yield pd.DataFrame({
                        "doc_id": pd.Series(r.doc_ids).astype("Int64").mask(r.null), "start": first + r.starts[:-1], "n_tokens": r.lengths,
                        "ids_crc32": np.asarray(crc, np.int64), "shard": np.full(len(crc), shard, np.int32), "place": np.arange(len(crc), dtype=np.int64),
                    })

    return parts.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, place long")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write `docs` to the shared folder and read the files back: doc_id, start, n_tokens, ids_crc32."""
    manifest = write_tokens(docs, tokenizer, fresh_path(docs.sparkSession, "tokens"))
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
