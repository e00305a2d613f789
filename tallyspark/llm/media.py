"""Media columns: interleaved sequences of text and media references, with payloads resolved by digest.

HTML is parsed into an ordered array of structs (position, kind text or media, text, digest, caption): runs of
text between references are text elements, an ``img``, ``audio``, ``video`` or ``source`` element is a media
element whose ``src`` names a digest (``sha256:...``); its caption is the ``figcaption`` of its figure, else its
``alt`` or ``title``. Payloads are stored losslessly as 8-bit greyscale images (PGM) of 576 columns in a written table,
keyed by the payload's digest, which is checked when they are read; what is computed of them is read back from there and
joined by digest, so that positions and captions stay aligned with it. The catalog holds a digest once however many
documents refer to it.

Null HTML gives an empty sequence, a null text an empty payload. A reference without a stored payload keeps its
place with null features. Repeated rows are kept each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, materialize, slices, text_or_empty
from tallyspark.llm.html_extract import INLINE, RAW, tokens

#: Samples in a row, and so the unit to which payloads are filled up with bytes 255.
UNIT = 576
_HEADER = re.compile(rb"P5\n([0-9]+) ([0-9]+)\n255\n")
ELEMENT = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
MEDIA_TAGS = frozenset({"img", "audio", "video", "source"})
SILENT_TAGS = frozenset({"noscript", "template"})
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def encode_image(payload: bytes) -> bytes:
    """A greyscale image whose samples are the payload (a positive multiple of UNIT bytes)."""
    return b"P5\n%d %d\n255\n" % (UNIT, len(payload) // UNIT) + payload


def decode_image(data: bytes) -> bytes:
    """The samples of an image that encode_image() wrote; anything else raises ValueError."""
    head = _HEADER.match(data)
    if not head or int(head[1]) != UNIT or len(data) - head.end() != UNIT * int(head[2]):
        raise ValueError("not a greyscale image of this width")
    return data[head.end() :]


def interleave(html: str | None) -> list[dict]:
    """The sequence of one page, in time proportional to its length."""
    items: list[dict] = []
    words: list[str] = []
    figures: list[list] = []  # media and caption of the open figures
    caption: list[str] | None = None
    silent = 0

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def settle() -> None:
        members, told = figures.pop()
        for i in members:
            items[i]["caption"] = told or items[i]["caption"]

    for text, closes, tag, attrs in tokens(html or ""):
        if text and not silent:
            (words if caption is None else caption).append(entities.unescape(text))
        if tag in SILENT_TAGS:
            silent = max(0, silent - 1) if closes else silent + 1
        elif tag in MEDIA_TAGS:
            at = {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attrs)}
            if not closes and not silent and at.get("src"):
                flush()
                items.append({"kind": "media", "text": None, "digest": at["src"].removeprefix("sha256:"), "caption": at.get("alt") or at.get("title")})
                if figures:
                    figures[-1][0].append(len(items) - 1)
        elif tag == "figure":
            flush()
            if not closes:
                figures.append([[], ""])
            elif figures:
                settle()
        elif tag == "figcaption":
            if closes and caption is not None:
                told = " ".join("".join(caption).split())
                if figures:
                    figures[-1][1] = told
            caption = None if closes else []
        elif tag and tag not in INLINE and tag not in RAW:
            words.append(" ")
    if caption:
        words += caption
    flush()
    while figures:
        settle()
    return [{"position": i} | item for i, item in enumerate(items)]


def _sequences(batches):
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([interleave(h) for h in batch.column(1).to_pylist()], kind)], names=["doc_id", "elements"])


def sequences(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """doc_id, elements: the interleaved sequence of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_sequences, f"doc_id long, elements array<{ELEMENT}>")


def _store(batches):
    for batch in slices(batches):
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([encode_image(pad(t)) for t in texts], pa.binary()),
            ],
            names=["digest", "n_bytes", "media"],
        )


def store_texts(docs: DataFrame) -> DataFrame:
    """digest (of the unpadded bytes), n_bytes and media (the stored form) of every row's text."""
    return docs.select(text_or_empty().alias("text")).mapInArrow(_store, "digest string, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: bytes, n_bytes: int, digest: str) -> tuple:
    """What is read back from a stored form; feature: size in samples, their sum, and how many values occur. Bytes of another digest raise ValueError."""
    payload = decode_image(media)
    if hashlib.sha256(payload[:n_bytes]).hexdigest() != digest:
        raise ValueError("damaged payload")
    samples = np.frombuffer(payload, np.uint8)
    told = f"{UNIT}x{len(payload) // UNIT};sum={int(samples.sum(dtype=np.int64))};values={int((np.bincount(samples, minlength=256) > 0).sum())}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), told


def _read(batches):
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in slices(batches):
        rows = [features(m, n, d) for d, n, m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols, kinds)], names=["digest", "n_bytes", *names])


def read_media(stored: DataFrame) -> DataFrame:
    """Features of the stored forms, read back from their bytes."""
    return stored.select("digest", "n_bytes", "media").mapInArrow(_read, "digest string, n_bytes long, " + FEATURES)


def catalog(read: DataFrame) -> DataFrame:
    """A row for each digest."""
    cols = [c for c in read.columns if c != "digest"]
    return read.groupBy("digest").agg(F.max(F.struct(*cols)).alias("m")).select("digest", "m.*")


def resolve(seqs: DataFrame, media: DataFrame) -> DataFrame:
    """A row for each media element, in place: doc_id, position, caption, digest and the catalog's columns."""
    refs = seqs.select("doc_id", F.inline("elements")).where("kind = 'media'").select("doc_id", "position", "caption", "digest")
    return refs.join(media, "digest", "left")


def text_media(docs: DataFrame) -> DataFrame:
    """Every document's text as the one payload of a page that refers to it, resolved by digest."""
    stored = materialize(store_texts(docs), "media")
    media = materialize(catalog(read_media(stored)), "media-catalog")
    discard(stored)
    size = F.octet_length(text_or_empty()).cast("string")
    html = F.concat(F.lit('<figure><img src="sha256:'), F.sha2(text_or_empty(), 256), F.lit('" alt=""><figcaption>text of '), size, F.lit(" bytes</figcaption></figure>"))
    pages = docs.select(F.col("doc_id").cast("long").alias("doc_id"), html.alias("html"))
    found = resolve(sequences(pages), media)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def oracle_sql() -> str:
    """The rows of text_media() over documents in DuckDB's dialect. Bytes are written in hexadecimal."""
    size = f"greatest({UNIT}, ceil(n / {UNIT}.0)::bigint * {UNIT})"
    crc = "list_reduce(list_prepend(4294967295::bigint, {b}), lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
    numbers = "list_transform(regexp_extract_all({h}, '..'), lambda x: ('0x' || x)::bigint)"
    return (
        "with d as (select doc_id, encode(coalesce(text, '')) as t from documents), h as (select doc_id, hex(t) as h, octet_length(t) as n from d), "
        f"p as (select doc_id, n, h || repeat('FF', ({size} - n)::int) as h, {size} as m from h), "
        f"i as (select *, hex(encode('P5' || chr(10) || '{UNIT} ' || m // {UNIT} || chr(10) || '255' || chr(10))) || h as image, {numbers.format(h='h')} as v, {numbers.format(h='right(h, 64)')} as tail from p) "
        "select doc_id, n as n_bytes, m as payload_bytes, sha256(unhex(h)) as payload_sha256, xor("
        + crc.format(b="tail")
        + f", 4294967295::bigint) as tail_crc32, length(image) // 2 as media_bytes, sha256(unhex(image)) as media_sha256, '{UNIT}x' || m // {UNIT} || ';sum=' || list_sum(v)::bigint || ';values=' || list_unique(v) as feature, "
        "0 as position, 'text of ' || n || ' bytes' as caption from i"
    )
