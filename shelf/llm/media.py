"""Media columns: interleaved document sequences with payloads resolved by digest.

HTML is parsed into an ordered array of text and media-reference structs. A reference is
known by a digest: the SHA-256 that its address names (``media:sha256/<hex>``), or that of
the address itself. A media store maps digests to stored bytes; a join on the digest
resolves every reference, and positions and captions stay with their reference.

Payloads are kept as 8-bit mono PCM in RIFF/WAVE, one sample for each byte, with the
unpadded length in a chunk of its own.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelf.llm.common import Workspace, bounded, texts_of

BLOCK = 64
SAMPLE_RATE = 8000
ITEM = "struct<pos:int,kind:string,text:string,ref:string,digest:string,caption:string>"
_ITEM = pa.list_(pa.struct([("pos", pa.int32()), *[(n, pa.string()) for n in ("kind", "text", "ref", "digest", "caption")]]))
_NAMED = re.compile(r"sha256[:/=-]([0-9a-f]{64})(?![0-9a-f])")
#: Elements whose address is a media reference, and those that end a run of text.
MEDIA = frozenset("img video audio embed".split())
INLINE = frozenset("a abbr b cite code em i mark q s small span strong sub sup time u".split())
SILENT = frozenset("script style template noscript".split())


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.caption: list[str] | None = None
        self.figures: list[tuple[int, list[str]]] = []
        self.captioned: set[int] = set()

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.add(kind="text", text=text)

    def add(self, **item: str | None) -> None:
        self.items.append({"pos": len(self.items), "kind": None, "text": None, "ref": None, "digest": None, "caption": None} | item)

    def end_caption(self) -> None:
        """Give an open caption to its figure; one outside a figure is a run of text."""
        if self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            if text and self.figures:
                self.figures[-1][1].append(text)
            elif text:
                self.add(kind="text", text=text)

    def end_figure(self) -> None:
        """Caption the media of the innermost figure that have none; captions without media are text."""
        self.end_caption()
        self.flush()
        start, captions = self.figures.pop()
        media = [item for item in self.items[start:] if item["kind"] == "media" and item["pos"] not in self.captioned]
        for item in media if captions else ():
            item["caption"] = " ".join(captions)
            self.captioned.add(item["pos"])
        for text in () if media else captions:
            self.add(kind="text", text=text)

    def end_page(self) -> None:
        while self.figures:
            self.end_figure()
        self.end_caption()
        self.flush()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        elif not self.silent and tag not in INLINE:
            self.flush()
            if tag == "figure":
                self.end_caption()
                self.figures.append((len(self.items), []))
            elif tag == "figcaption":
                self.end_caption()
                self.caption = []
            elif tag in MEDIA or tag == "source":
                found = dict(attrs)
                if ref := found.get("src"):
                    self.add(kind="media", ref=ref, digest=reference_digest(ref), caption=found.get("alt") or found.get("title") or None)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif not self.silent and tag not in INLINE:
            self.flush()
            if tag == "figcaption":
                self.end_caption()
            elif tag == "figure" and self.figures:
                self.end_figure()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def reference_digest(ref: str) -> str:
    named = _NAMED.search(ref)
    return named[1] if named else hashlib.sha256(ref.encode("utf-8", "surrogatepass")).hexdigest()


def parse_html(html: str | None) -> list[dict]:
    """Ordered items of a page; null and empty pages have none."""
    page = _Sequence()
    page.feed(html or "")
    page.close()
    page.end_page()
    return page.items


def sequences(pages: DataFrame, html: str = "html", into: str = "items") -> DataFrame:
    """Append the array of items to every row of ``pages``; a column of that name is replaced.

    Null and empty pages have an empty array. Captions come from ``figcaption`` for every
    medium of its figure, before or after it, otherwise from ``alt`` or ``title``; media of
    a nested figure with a caption keep that one. Several captions of a figure are
    joined. A caption without a medium is a text item; one that is not closed ends with its
    figure or the page.
    """
    kept = pages.drop(into)
    where = kept.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            items = pa.array([parse_html(h) for h in batch.column(where).to_pylist()], _ITEM)
            yield pa.RecordBatch.from_arrays([*batch.columns, items], names=[*batch.schema.names, into])

    item = T.StructType.fromDDL(f"{into} array<{ITEM}>")[into].dataType
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(into, item)]))


def resolve(rows: DataFrame, store: DataFrame, items: str = "items") -> DataFrame:
    """One row for each media reference, with what ``store`` (keyed by ``digest``) has of it.

    The columns of ``rows`` but the items come first, then ``pos, ref, digest, caption``
    (which replace columns of those names), then the other columns of ``store``; these are
    null where the store lacks the digest. A digest stored more than once resolves to one
    of its entries, which are equal in content. Every reference stays one row.
    """
    own = [c for c in rows.columns if c not in (items, "pos", "ref", "digest", "caption") and c not in store.columns]
    media = rows.select(*own, F.explode(items).alias("_item")).where(F.col("_item.kind") == "media")
    refs = media.select(*own, "_item.pos", "_item.ref", "_item.digest", "_item.caption")
    return refs.join(store.dropDuplicates(["digest"]), "digest", "left")


def to_wave(text: bytes) -> tuple[bytes, bytes]:
    """Padded payload of a text, and its stored form."""
    payload = text + bytes(-len(text) % BLOCK if text else BLOCK)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    body = b"WAVE" + form + struct.pack("<4sIQ", b"size", 8, len(text)) + struct.pack("<4sI", b"data", len(payload)) + payload
    return payload, struct.pack("<4sI", b"RIFF", len(body)) + body


def from_wave(stored: bytes) -> tuple[bytes, int]:
    """Samples and unpadded length read from a stored form."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, found = 12, {}
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        found[name] = stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return found[b"data"], struct.unpack("<Q", found[b"size"])[0]


def feature(samples: bytes) -> str:
    """Mean, deviation, crossings of the middle, and the share of each eighth of the range."""
    x = np.frombuffer(samples, np.uint8)
    shares = np.bincount(x >> 5, minlength=8) / len(x)
    crossings = int(np.count_nonzero(np.diff(x >= 96)))
    return f"mean={x.mean():.4f};dev={x.std():.4f};cross={crossings};hist=" + ",".join(f"{s:.4f}" for s in shares)


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, html, digest, media``: a page that refers to each text's payload, and its stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            pages, digests, media = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                _, stored = to_wave(text or b"")
                digests.append(hashlib.sha256(stored).hexdigest())
                media.append(stored)
                pages.append(f'<article><p>Document {doc}</p><figure><audio src="media:sha256/{digests[-1]}"></audio><figcaption>Text of document {doc}</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages), pa.array(digests), pa.array(media, pa.binary())], names=["doc_id", "html", "digest", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, html string, digest string, media binary")


def read_store(store: DataFrame) -> DataFrame:
    """Read stored media back: sizes, digests, checksum and feature, keyed by ``digest``."""
    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            rows = []
            for stored in batch.column(1).to_pylist():
                samples, n = from_wave(stored)
                rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.select("digest", "media").mapInArrow(run, schema)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text, refer to it from a page, parse the pages, and resolve by digest.

    Payloads are written once and never shuffled: what the join moves are the digests and
    figures of the stored bytes. Null texts are stored as empty ones, with one block.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = Workspace(spark, "media").save(store_texts(docs), "store", compression="zstd")
    found = resolve(sequences(stored.select("doc_id", "html")).drop("html"), read_store(stored))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
