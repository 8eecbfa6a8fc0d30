"""Token-ID output: bit-plane shuffled blocks of ids, each plane compressed with zstandard.

File format. A table of frames in Parquet, ordered by document id. A frame holds whole
documents and at least ``FRAME_IDS`` ids (the last of a part may hold fewer). Its ids are
cut into blocks of ``BLOCK_IDS``; a block's 32-bit little-endian ids are transposed into
planes (32 bit planes or 4 byte planes), and every plane is one zstandard frame, except
that an all-zero plane takes no bytes. Columns:

- ``part``, ``frame``: place in the order of all frames;
- ``part_start``: ids of the part before this frame;
- ``n_ids``, ``doc_ids``, ``doc_tokens``: what the frame holds;
- ``index``: stored bytes of every plane, block after block (the chunk index);
- ``payload``: the planes, one after another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelf.llm.common import Workspace, bounded, texts_of

BLOCK_IDS = 65_536
FRAME_IDS = 131_072
END_ID = 1
#: Words in each of the two generations that a worker remembers.
CACHE_WORDS = 250_000
LEVEL = 1

FRAMES = (
    "part int, frame int, part_start long, n_ids long, doc_ids array<long>, doc_tokens array<long>, "
    "index array<int>, payload binary"
)


class WordEncoder:
    """Ids of whole texts by way of a bounded memory of words.

    The tokenizer's splitting never joins characters across white space, so the ids of a
    text are the ids of its words in order. A word of letters alone is one piece for the
    splitting, so it goes to the tokenizer's model directly; other words take the whole
    tokenizer, and a text that holds the mark of a special token does so unsplit.
    """

    _held: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = (chr(c) for c in range(0x80, 0x250) if chr(c).isalpha() and chr(c) == chr(c).lower())
        #: Letters that lower-casing and composition leave alone, and how the model spells them.
        self.letters = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in letters}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _spelled(self, word: bytes) -> str | None:
        """How the model spells a word that is one run of plain letters; None for others."""
        if word.isalpha():
            return word.decode()
        text = word.decode().lower()
        if text.isalpha() and all(c < "\x80" or ord(c) in self.letters for c in text):
            return text.translate(self.letters)
        return None

    def _learn(self, fresh: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words; final full stops and commas are encoded apart."""
        found, rest, ended = {}, [], {}
        for w in fresh:
            stem = w.rstrip(b".,")
            if stem != w and stem and (stem[-1] >= 128 or stem[-1:].isalnum()) and (spelled := self._spelled(stem)):
                ended[w] = (stem, w[len(stem) :])
            else:
                stem, spelled = w, self._spelled(w)
            if spelled is None:
                rest.append(w)
            elif stem not in found:
                found[stem] = np.array([x.id for x in self.model.tokenize(spelled)], "<u4").tobytes()
        marks = list({end for _, end in ended.values()})
        found.update(zip(rest + marks, self._whole(rest + marks), strict=True))
        for w, (stem, end) in ended.items():
            found[w] = found[stem] + found[end]
        return found

    def batch(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; null and empty texts have none."""
        split = [() if not t or b"<|" in t else t.lower().split() for t in texts]
        here: dict[bytes, bytes] = {}
        fresh = []
        for w in set().union(*split):
            ids = self.young.get(w)
            if ids is None:
                ids = self.old.get(w)
                if ids is None:
                    fresh.append(w)
                    continue
                self.young[w] = ids
            here[w] = ids
        learned = self._learn(fresh)
        here.update(learned)
        if len(self.young) + len(learned) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young.update(learned)
        get = here.__getitem__
        out = [b"".join(map(get, ws)) for ws in split]
        for i, t in enumerate(texts):
            if t and b"<|" in t:
                out[i] = self._whole([t])[0]
        return out


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = LEVEL) -> tuple[bytes, list[int]]:
    """Payload and chunk index of an array of unsigned 32-bit ids."""
    press = zstandard.ZstdCompressor(level=level)
    parts, index = [], []
    for at in range(0, len(ids), BLOCK_IDS):
        raw = np.ascontiguousarray(ids[at : at + BLOCK_IDS], "<u4").view(np.uint8).reshape(-1, 4)
        used = np.bitwise_or.reduce(raw, axis=0)
        for byte in range(4):
            column = np.ascontiguousarray(raw[:, byte])
            if kind == "byte":
                planes = [(column.tobytes(), bool(used[byte]))]
            elif used[byte]:
                bits = np.packbits(np.unpackbits(column[:, None], axis=1, bitorder="little").T, axis=1)
                planes = [(bits[k].tobytes(), bool(used[byte] >> k & 1)) for k in range(8)]
            else:
                planes = [(b"", False)] * 8
            for plane, some in planes:
                stored = press.compress(plane) if some else b""
                parts.append(stored)
                index.append(len(stored))
    return b"".join(parts), index


def from_planes(payload: bytes, index: list[int], n_ids: int, kind: str = "byte") -> np.ndarray:
    """Invert ``to_planes``; raises ValueError where the index and the payload disagree."""
    per = 32 if kind == "bit" else 4
    if sum(index) != len(payload) or len(index) != per * -(-n_ids // BLOCK_IDS):
        raise ValueError("chunk index does not fit the payload")
    open_ = zstandard.ZstdDecompressor()
    out, at = np.zeros((n_ids, 4), np.uint8), 0
    for b, start in enumerate(range(0, n_ids, BLOCK_IDS)):
        rows = min(BLOCK_IDS, n_ids - start)
        size = rows if kind == "byte" else -(-rows // 8)
        for p in range(per):
            length = index[b * per + p]
            if not length:
                continue
            plane = np.frombuffer(open_.decompress(payload[at : at + length], max_output_size=size), np.uint8)
            at += length
            if kind == "byte":
                out[start : start + rows, p] = plane
            else:
                out[start : start + rows, p // 8] |= np.unpackbits(plane, count=rows) << (p % 8)
    return out.view("<u4").ravel()


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID, kind: str = "byte", parts: int | None = None) -> DataFrame:
    """Frames of all documents in ascending ``doc_id`` order, nulls first.

    One range exchange orders the rows; each part is encoded as a stream. Null texts are
    encoded as empty ones: they hold the end id alone. Rows that repeat an id stay apart,
    ordered by text. Other columns of ``docs`` are not read. An empty table has no frames.
    """
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = WordEncoder.of(tokenizer), TaskContext.get().partitionId()
        ids, counts, held, size, start, frame = [], [], [], 0, 0, 0
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(held), "<u4")
            payload, index = to_planes(flat, kind)
            row = [part, frame, start, len(flat), ids, counts, index, payload]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, types, strict=True)],
                names=["part", "frame", "part_start", "n_ids", "doc_ids", "doc_tokens", "index", "payload"],
            )

        for batch in bounded(batches):
            for doc_id, coded in zip(batch.column(0).to_pylist(), coder.batch(texts_of(batch.column(1))), strict=True):
                held.append(coded + tail)
                ids.append(doc_id)
                counts.append(len(coded) // 4 + 1)
                size += counts[-1]
                if size >= FRAME_IDS:
                    yield flush()
                    ids, counts, held, start, frame, size = [], [], [], start + size, frame + 1, 0
        if ids:
            yield flush()

    return ordered.mapInArrow(run, FRAMES)


def decode(frames: DataFrame, kind: str = "byte") -> DataFrame:
    """Documents of a table of frames: ``doc_id, start, n_tokens, ids_crc32``.

    Frames decode apart from each other. ``start`` adds the ids of earlier parts, of earlier
    frames of the part, and of earlier documents of the frame; only one total for each part
    passes through a window.
    """
    totals = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select(
        "part",
        (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            for r in batch.to_pylist():
                ids = from_planes(r["payload"], r["index"], r["n_ids"], kind)
                ends = np.cumsum(r["doc_tokens"])
                starts = ends - np.array(r["doc_tokens"])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(crc), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["part_start"], pa.int64()), pa.array(r["doc_tokens"], pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = frames.mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(before, "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, kind: str = "byte") -> DataFrame:
    """Write the frames below the shared folder, then return what reading them gives."""
    ws = Workspace(docs.sparkSession, "planes")
    # planes are compressed already
    return decode(ws.save(encode(docs, tokenizer, kind=kind), "frames", compression="none"), kind)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write the files, and read every document back from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return write_and_read(docs, tokenizer_path())
