"""Media columns stored as content-defined chunks.

A text's payload (UTF-8, padded with spaces to a positive multiple of 192 bytes)
becomes a WAV file of 8-bit mono samples. A gear hash rolls over the last 32
samples; where its low bits are zero a chunk ends, within the least and largest
chunk size, so equal stretches give equal chunks wherever they stand. Two tables:

* manifest, in the shared folder: one row a document: sha256 of the whole file,
  chunk digests in order;
* store, a managed table: every distinct chunk once, by a 128-bit digest,
  compressed; bucketed by digest, so that reading doesn't shuffle it.

A chunk belongs to the file with the smallest key (64 bits of its sha256) among
all that hold it: digests of all manifests are grouped, and each written chunk is
joined with its owner, so that only that file's copy stays. Chunks are small (LEAST bytes up), so
they are compressed with a zstd dictionary of DICTIONARY bytes, trained on the
SAMPLE texts of the smallest hash of up to MOST characters (that sample is
bounded, chunking and storing are not); it is a table beside the store.

Reading joins each distinct file's chunk list with the store, puts chunks back in
order, checks each chunk's digest and the whole file's, and computes features
from the samples. Copies share a manifest entry, so a file of many copies is
rebuilt once; its features are joined back to all of them. Chunks that more than
`hot` files refer to are joined apart, by a shuffle that AQE can split. Only files
of several chunks are shuffled to be put together.

A file is one value when it is rebuilt, so a text must fit into memory several
times over; Python takes texts in groups of GROUP bytes, whatever their number.

Defined cases: null text counts as empty and gives one block of spaces; null
doc_ids and repeated rows keep their rows; an empty table gives no rows; extra
columns are ignored. A chunk or file that doesn't match its digest fails the
read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WRITING, materialize, settings, table

BLOCK, RATE = 192, 16_000
REACH, LEAST, MOST = 32, 512, 16_384
MASK = np.uint32((1 << 11) - 1)
SAMPLE, DICTIONARY = 1500, 112 << 10
HOT = 10_000
SEGMENT, GROUP = 1 << 20, 1 << 22
GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), np.uint32)


def payload(text: str | None) -> bytes:
    raw = text.encode() if isinstance(text, str) else b""
    return raw + b" " * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0)


def wav_header(n: int) -> bytes:
    """Head of a WAV file of n samples: PCM, mono, 8 bits."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def samples_of(media: bytes) -> bytes:
    head = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if head[0] != b"RIFF" or head[2] != b"WAVE" or head[12] != len(media) - 44:
        raise ValueError("not a WAV file of this module's form")
    return media[44:]


def _marks(stream: bytes, pad: np.ndarray) -> np.ndarray:
    """Places where the gear hash of the last REACH bytes ends a chunk; pad: bytes that count as nothing."""
    raw, found = np.frombuffer(stream, np.uint8), []
    for at in range(0, len(raw), SEGMENT):
        first = max(0, at - REACH + 1)
        h = GEAR[raw[first : at + SEGMENT]]
        h[pad[first : at + SEGMENT]] = 0
        span = 1
        while span < REACH:  # hash of 2 * span bytes from two of span
            h[span:] += h[:-span] << np.uint32(span)
            span *= 2
        found.append(np.flatnonzero((h[at - first :] & MASK) == 0) + at)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunks(files: list[bytes]) -> Iterator[list[bytes]]:
    """Chunks of each file, in order."""
    group: list[bytes] = []
    size = 0
    for k, f in enumerate(files):
        group.append(f)
        size += len(f)
        if size < GROUP and k + 1 < len(files):
            continue
        gap = bytes(REACH)
        stream = gap.join(group)
        pad = np.zeros(len(stream), bool)
        begin = 0
        for g in group:
            pad[begin + len(g) : begin + len(g) + REACH] = True
            begin += len(g) + REACH
        marks = _marks(stream, pad)
        begin = 0
        for g in group:
            own = (marks[np.searchsorted(marks, begin) : np.searchsorted(marks, begin + len(g))] - begin + 1).tolist()
            out, start, j = [], 0, 0
            while start < len(g):
                while j < len(own) and own[j] < start + LEAST:
                    j += 1
                end = min(own[j] if j < len(own) else len(g), start + MOST, len(g))
                out.append(g[start:end])
                start = end
            yield out
            begin += len(g) + REACH
        group, size = [], 0


def chunk_digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _groups(texts: pd.Series) -> Iterator[tuple[slice, list[bytes]]]:
    """Payloads of GROUP bytes or one text at a time, with their places."""
    files: list[bytes] = []
    start = size = 0
    for k, t in enumerate(texts):
        files.append(payload(t))
        size += len(files[-1])
        if size >= GROUP:
            yield slice(start, k + 1), files
            files, start, size = [], k + 1, 0
    if files:
        yield slice(start, len(texts)), files


def _media(f: bytes) -> bytes:
    return hashlib.sha256(wav_header(len(f)) + f).digest()


def _key(media: bytes) -> int:
    return int.from_bytes(media[:8], "big", signed=True)


def _manifest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at, files in _groups(pdf["text"]):
            part, media = pdf.iloc[at], [_media(f) for f in files]
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"],
                    "n_bytes": [len(t.encode()) if isinstance(t, str) else 0 for t in part["text"]],
                    "media": media,
                    "key": [_key(m) for m in media],
                    "digests": [[chunk_digest(c) for c in cs] for cs in chunks(files)],
                }
            )


def _store(dictionary: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=16, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=16)
        least: dict[bytes, int] = {}  # of this task's chunks; a file with a larger key can't own them
        for pdf in batches:
            for _, files in _groups(pdf["text"].drop_duplicates()):
                found: dict[bytes, bytes] = {}
                for f, cs in zip(files, chunks(files), strict=True):
                    key = _key(_media(f))
                    for c in cs:
                        d = chunk_digest(c)
                        if d not in least or key < least[d]:
                            least[d], found[d] = key, c
                if found:
                    yield pd.DataFrame({"digest": list(found), "key": [least[d] for d in found], "packed": [pack.compress(c) for c in found.values()]})

    return run


def train_dictionary(documents: DataFrame) -> bytes:
    """A zstd dictionary from SAMPLE texts of at most MOST characters; empty if they are too few for one."""
    able = documents.where(F.length("text") <= MOST).select("text", F.xxhash64("text").alias("h"))
    first = [r["h"] for r in able.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
    texts = sorted(r["text"] for r in able.where(F.col("h") <= max(first)).groupBy("h").agg(F.min("text").alias("text")).collect()) if first else []
    parts = [c for cs in chunks([payload(t) for t in texts]) for c in cs]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def feature(samples: bytes) -> str:
    """Range, mean, deviation and zero crossings of the samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    mean = x.mean()
    return f"{x.min()}..{x.max()} mean {mean:.4f} dev {np.sqrt(((x - mean) ** 2).mean()):.4f} zc {crossings}"


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_chunks long, feature string"


def read_media(media: pd.Series, parts: pd.Series, dictionary: bytes = b"") -> pd.DataFrame:
    """Rebuild files from (seq, digest, packed) parts in order, verify and measure them."""
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    rows = []
    for want, own in zip(media, parts, strict=True):
        pieces = []
        for k, p in enumerate(own):
            c = unpack.decompress(p["packed"])
            if p["seq"] != k or chunk_digest(c) != bytes(p["digest"]):
                raise ValueError(f"chunk {k} of {bytes(want).hex()} is not what was stored")
            pieces.append(c)
        whole = wav_header(sum(map(len, pieces))) + b"".join(pieces)
        if hashlib.sha256(whole).digest() != bytes(want):
            raise ValueError(f"{bytes(want).hex()} is not what was stored")
        s = samples_of(whole)
        rows.append((len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-16:]), len(whole), bytes(want).hex(), len(own), feature(s)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")])


def store_media(documents: DataFrame) -> tuple[DataFrame, str]:
    """Writes doc_id and text of documents; returns the manifest and the chunk store's table name."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    manifest = materialize(rows.mapInPandas(_manifest, "doc_id long, n_bytes long, media binary, key long, digests array<binary>"), "media-manifest")
    owners = manifest.select("key", F.explode("digests").alias("digest")).groupBy("digest").agg(F.min("key").alias("key"))
    dictionary = train_dictionary(rows)
    held = rows.select("text").mapInPandas(_store(dictionary), "digest binary, key long, packed binary")
    # dealt by digest alone, as the buckets are, so that each bucket is one file; copies of the owner's file are left, which are equal
    owned = held.join(owners.withColumnRenamed("key", "owner"), "digest").where("key >= owner AND key <= owner")
    store = owned.dropDuplicates(["digest"]).select("digest", "packed")
    name = f"media_store_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with settings(spark, WRITING):
        store.write.bucketBy(buckets, "digest").sortBy("digest").option("compression", "none").saveAsTable(name)
    spark.createDataFrame([(dictionary,)], "dictionary binary").coalesce(1).write.saveAsTable(f"{name}_dictionary")
    return manifest, name


def load_media(manifest: DataFrame, store_name: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes and what read_media finds in each document's file."""
    store = manifest.sparkSession.table(store_name)
    dictionary = bytes(manifest.sparkSession.table(f"{store_name}_dictionary").first()["dictionary"])
    files = materialize(manifest.groupBy("media").agg(F.first("digests").alias("digests")), "media-files")
    parts = files.select("media", F.size("digests").alias("n"), F.posexplode("digests").alias("seq", "digest"))
    often = materialize(parts.groupBy("digest").count().where(F.col("count") > hot).select("digest"), "media-hot")
    usual = parts.join(often, "digest", "left_anti").join(store.hint("merge"), "digest", "left")
    shared = parts.join(often, "digest", "left_semi").join(store.join(often, "digest", "left_semi").hint("merge"), "digest", "left")
    part = F.struct("seq", "digest", "packed")
    usual, shared = (x.select("media", "n", part.alias("part")) for x in (usual, shared))
    single = usual.where("n = 1").select("media", F.array("part").alias("parts"))
    several = usual.where("n > 1").unionByName(shared)
    several = several.groupBy("media").agg(F.sort_array(F.collect_list("part")).alias("parts"))

    @F.pandas_udf(READ)
    def measure(media: pd.Series, parts: pd.Series) -> pd.DataFrame:
        return read_media(media, parts, dictionary)

    measured = materialize(single.unionByName(several).select("media", measure("media", "parts").alias("m")).select("media", "m.*"), "media-read")
    return manifest.select("doc_id", "n_bytes", "media").join(measured.hint("merge"), "media").drop("media")


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, store = store_media(table(spark, sf_dir, "documents"))
    out = load_media(manifest, store)
    for name in (store, f"{store}_dictionary"):  # every stored byte has been read back by now
        spark.sql(f"DROP TABLE {name}")
    return out
