"""Token-ID files: independent zstandard frames, a trailing seek table, a checksum for each frame.

File layout (one file for each task, documents ascending by id over all files): frames; then one skippable zstandard
frame holding the seek table, an entry of (compressed size, raw size, low 32 bits of the raw bytes' xxh64) for each
frame and a footer of (number of frames, descriptor, magic), all little-endian. A raw frame is: number of documents,
their id offsets, then all ids, as 32-bit unsigned integers. Readers find a frame by the table and decompress nothing else.

Null or empty texts are documents of the end id alone. Equal ids are ordered by their texts' hashes; null ids come first.
Files are written under a temporary name and moved, so a task that runs again replaces its own file by equal bytes.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidalgrid.llm.common import scratch, small_batches

#: Fixed values of the public seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, HAS_CHECKSUM = 0x184D2A5E, 0x8F92EAB1, 0x80
END_ID = 2
#: A frame is closed when it holds so many ids.
FRAME_IDS = 1 << 18
#: Words a worker remembers.
MEMO = 500_000
_ODD_SPACES = "\x1c\x1d\x1e\x1f"
_ODD = "\u03a3\u0130"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_alphabet() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(128)]
#: Letters outside ASCII and the lower-case letters of Latin-1, which are their own normal forms.
_NOT_LATIN = re.compile("[^a-z\u00df-\u00f6\u00f8-\u00ff]").search


def _pack(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < 128 else struct.pack(f"<{len(ids)}I", *ids)


#: The steps before the merge model for which words can be encoded one by one.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class WordEncoder:
    """Ids of words by the tokenizers library, remembered as packed 32-bit integers.

    A tokenizer with the steps ``BY_WORDS`` drops white space and never joins what it parts, so words are encoded once each.
    Words of Latin letters go straight to the library's merge model, in its byte alphabet; all others pass its whole
    pipeline, and so do all texts with another tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok, self.memo = Tokenizer.from_file(path), {}
        steps = json.loads(self.tok.to_str())
        self.by_words = all(steps.get(k) == v for k, v in BY_WORDS.items()) and steps["model"]["type"] == "BPE" and not steps["model"].get("dropout")
        self.letters = _byte_alphabet()
        if not self.by_words:
            return
        self.stop = {c: self.whole([c])[0] for c in ".,"}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [_pack(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        memo, other, tokenize, stop = self.memo, [], self.tok.model.tokenize, self.stop
        for w in words:
            if w[-1] in stop and w[:-1].isalnum():
                stem, tail = w[:-1], stop[w[-1]]
                if (got := memo.get(stem)) is not None:
                    memo[w] = got + tail
                    continue
            else:
                stem, tail = w, b""
            if not stem.isalpha():
                other.append(w)
            elif stem.isascii():
                memo[w] = _pack([t.id for t in tokenize(stem)]) + tail
            elif not _NOT_LATIN(stem):
                memo[w] = _pack([t.id for t in tokenize("".join([self.letters[b] for b in stem.encode()]))]) + tail
            else:
                other.append(w)
        for at in range(0, len(other), 5_000):
            part = other[at : at + 5_000]
            memo.update(zip(part, self.whole(part), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return self.whole([t or "" for t in texts])
        if len(self.memo) > MEMO:
            self.memo.clear()
        # separators that Python takes for white space, and letters whose lower case depends on their place, go another way
        odd = [t is not None and not t.isascii() and any(c in t for c in _ODD) or t is not None and any(c in t for c in _ODD_SPACES) for t in texts]
        words = [[] if t is None or o else t.lower().split() for t, o in zip(texts, odd, strict=True)]
        new: set[str] = set()
        new.update(*words)
        self.learn(new.difference(self.memo))
        get = self.memo.__getitem__
        return [self.whole([t])[0] if o else b"".join(map(get, w)) for t, w, o in zip(texts, words, odd, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_ids(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of each text."""
    return [np.frombuffer(x, "<u4") for x in encoder(path).encode(texts)]


class FrameWriter:
    """Writes frames to an open file and the seek table at its end."""

    def __init__(self, sink, level: int = 3):
        import zstandard

        self.sink, self.table, self.at = sink, [], 0
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def write(self, docs: list[np.ndarray]) -> None:
        import xxhash

        ends = np.cumsum([len(d) for d in docs], dtype=np.uint32)
        raw = np.concatenate([np.array([len(docs)], np.uint32), ends, *docs]).astype("<u4").tobytes()
        packed = self.zip.compress(raw)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.sink.write(packed)

    def close(self) -> None:
        body = b"".join(struct.pack("<III", *e) for e in self.table) + struct.pack("<IBI", len(self.table), HAS_CHECKSUM, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class FrameReader:
    """Random access to the frames of one file."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUM:
            raise ValueError("no seek table")
        source.seek(size - 9 - 12 * n)
        body = source.read(12 * n)
        self.table = [struct.unpack_from("<III", body, 12 * i) for i in range(n)]
        self.starts = [0, *itertools.accumulate(e[0] for e in self.table)]

    def documents(self, frame: int) -> list[np.ndarray]:
        import xxhash

        packed, size, check = self.table[frame]
        self.source.seek(self.starts[frame])
        raw = self.unzip.decompress(self.source.read(packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {frame} is damaged")
        values = np.frombuffer(raw, "<u4")
        n = int(values[0])
        return np.split(values[1 + n :], values[1 : n].astype(np.int64)) if n else []


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` (``doc_id``, ``text``) to files in ``folder``; returns the manifest, a row for each document:
    ``doc_id, part, file, frame, slot, n_tokens, start_in_part``."""
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = tokenizer or default_tokenizer()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(folder)
        filesystem.create_dir(base)
        part = TaskContext.get().partitionId()
        name = f"{base}/part-{part:08d}.tok"
        temporary = f"{base}/.{uuid.uuid4().hex}.tmp"
        rows: list[tuple] = []
        start = frame = held = 0
        kept: list[np.ndarray] = []
        ids_type = None
        with filesystem.open_output_stream(temporary) as sink:
            writer = FrameWriter(sink)
            for batch in batches:
                ids_type = batch.schema.field(0).type
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode_ids(batch.column(1).to_pylist(), tokenizer), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    rows.append((doc_id, frame, len(kept), len(ids), start))
                    start += len(ids)
                    held += len(ids)
                    kept.append(ids)
                    if held >= FRAME_IDS:
                        writer.write(kept)
                        kept, held, frame = [], 0, frame + 1
                if rows:
                    yield manifest(rows, part, name, ids_type)
                    rows = []
            if kept:
                writer.write(kept)
            writer.close()
        if ids_type is None:
            filesystem.delete_file(temporary)
        else:
            filesystem.move(temporary, name)

    def manifest(rows: list[tuple], part: int, name: str, ids_type) -> pa.RecordBatch:
        doc, frame, slot, size, at = zip(*rows, strict=True)
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, ids_type), pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array(frame, pa.int32()), pa.array(slot, pa.int32()), pa.array(size, pa.int64()), pa.array(at, pa.int64())],
            names=["doc_id", "part", "file", "frame", "slot", "n_tokens", "start_in_part"],
        )

    found = ordered.mapInArrow(run, f"doc_id {id_type}, part int, file string, frame int, slot int, n_tokens long, start_in_part long")
    found.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """The documents that ``manifest`` names, with their ``ids`` read from the files; only their frames are decompressed."""
    fields = ["doc_id", "start", "slot", "file", "frame"]
    spark = manifest.sparkSession
    id_type = manifest.schema["doc_id"].dataType.simpleString()
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = manifest.select(*fields).repartition(n, "file", "frame").sortWithinPartitions("file", "frame", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _filesystem(folder)
        at, reader, source, docs = None, None, None, []
        for batch in batches:
            rows, ids = batch.to_pylist(), []
            for r in rows:
                if at is None or r["file"] != at[0]:
                    if source:
                        source.close()
                    source = filesystem.open_input_file(r["file"])
                    reader, at = FrameReader(source, source.size()), (r["file"], -1)
                if r["frame"] != at[1]:
                    docs, at = reader.documents(r["frame"]), (r["file"], r["frame"])
                ids.append(docs[r["slot"]])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))], names=["doc_id", "start", "ids"])
        if source:
            source.close()

    return ordered.mapInArrow(run, f"doc_id {id_type}, start long, ids array<int>")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before; the window runs over one row for each file."""
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("b"))
    return manifest.join(before, "part").withColumn("start", F.coalesce("b", F.lit(0)) + F.col("start_in_part")).drop("b")


def digest(tokens: DataFrame) -> DataFrame:
    id_type = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            values, offsets = np.asarray(ids.values).astype("<u4"), np.asarray(ids.offsets)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = scratch(spark, "tokens")
    manifest = write_token_files(docs, folder)
    return digest(read_token_files(with_starts(manifest), folder))
