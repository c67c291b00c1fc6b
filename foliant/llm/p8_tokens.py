"""Problem 8: the whole corpus encoded with a public tokenizer.

Method: overlapping chunk encoding. A text is cut into chunks that overlap,
every chunk is pre-tokenised by itself, neighbours are stitched at the first
pre-token boundary of the overlap on which both agree (from there on they agree
throughout), and the pieces are encoded. Texts of one chunk need no stitching.
Pieces are encoded through a bounded memo, as words repeat. Decoding
concatenates the raw bytes of the ids.

Defined results: null and empty texts have an empty list of ids. Texts of any
length are encoded whole; a pre-token longer than an overlap, on which no
boundary agrees, makes the text be joined again and pre-tokenised in one task.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.runtime import read_table

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK = 8192
OVERLAP = 512
MEMO = 200_000  # pieces a worker remembers; results do not depend on it
OUT_BYTES = 16 << 20  # ids in one Arrow batch handed back

# The pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOOSE = re.compile(r"\s | \s|^ | $")  # blanks at which a plain split would not be a boundary
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts as little-endian int32 bytes."""

    def __init__(self, path: str):
        self.encode = encoding(path).encode_ordinary
        self.memo: dict[str, bytes] = {}

    def piece(self, unit: str) -> bytes:
        got = np.array(self.encode(unit), dtype=np.int32).tobytes()
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(unit) <= 64:
            self.memo[unit] = got
        return got

    def text(self, text: str) -> bytes:
        """A blank between two visible characters always starts a pre-token, so the words are encoded by themselves."""
        if _LOOSE.search(text):
            units = _SAFE.split(text)
        else:
            first, *rest = text.split(" ")
            units = [first, *[" " + r for r in rest]] if rest else [first]
        memo = self.memo
        return b"".join([memo.get(u) or self.piece(u) for u in units])


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))


def _encode_batches(path: str, key: str, field: pa.Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for b in batches:
            keys, parts, size, begun = b.column(0), [], 0, 0
            for i, text in enumerate(b.column(1)):
                got = enc.text(text.as_py()) if text.is_valid and len(text.as_py()) else b""
                parts.append(got)
                size += len(got)
                if size >= OUT_BYTES or i + 1 == len(b):
                    yield pa.RecordBatch.from_arrays([keys.slice(begun, i + 1 - begun), _lists(parts)], names=[key, "ids"])
                    parts, size, begun = [], 0, i + 1

    return run


def _chunk_batches(path: str):
    """(key, chunk, first, text with overlaps) -> pre-token starts, ids per pre-token and ids of the chunk."""

    def run(batches):
        import regex

        enc, pattern = encoding(path), regex.compile(PATTERN)
        for b in batches:
            rows = []
            for key, chunk, first, text, core in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                spans = [m.start() for m in pattern.finditer(text)]
                pieces = [enc._encode_single_piece(text[s:e].encode()) for s, e in zip(spans, spans[1:] + [len(text)], strict=True)]
                rows.append((key, chunk, core, [first + s for s in spans], [len(p) for p in pieces], [i for p in pieces for i in p]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.int32())), pa.array(cols[5], pa.list_(pa.int32()))],
                names=["key", "chunk", "core", "starts", "counts", "ids"])

    return run


def stitch(chunks: list[tuple[list[int], list[int], list[int]]]) -> list[int] | None:
    """Ids of a text from its chunks' (starts, counts, ids), or None where two neighbours share no boundary."""
    out: list[int] = []
    begin = 0
    for n, (starts, counts, ids) in enumerate(chunks):
        if n + 1 < len(chunks):
            here = set(starts[:-1])  # the last pre-token of a chunk may be cut
            end = next((s for s in chunks[n + 1][0][1:] if s in here and s >= begin), None)
            if end is None:
                return None
        else:
            end = float("inf")
        at = 0
        for s, c in zip(starts, counts, strict=True):
            if begin <= s < end:
                out.extend(ids[at : at + c])
            at += c
        begin = end
    return out


def _stitcher(path: str):
    @F.udf(T.ArrayType(T.IntegerType()))  # one call a long text, not a row of the hot path
    def run(parts):
        parts = sorted(parts, key=lambda p: p["chunk"])
        got = stitch([(p["starts"], p["counts"], p["ids"]) for p in parts])
        return encoding(path).encode_ordinary("".join(p["core"] for p in parts)) if got is None else got

    return run


def encode(df: DataFrame, key: str, text: str, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids): the ids of each text, without special tokens. Other columns are dropped."""
    path = path or tokenizer_path()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType
    out = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    long = F.length("text") > chunk
    short = rows.where(F.coalesce(~long, F.lit(True))).mapInArrow(_encode_batches(path, "key", None), out)
    first = F.greatest(F.lit(0), F.col("chunk") * chunk - overlap)
    pieces = (
        rows.where(long).withColumn("at", F.monotonically_increasing_id())
        .select("key", "text", "at", F.explode(F.sequence(F.lit(0), F.expr(f"int((length(text) - 1) div {chunk})"))).alias("chunk"))
        .select(
            F.struct("key", "at").alias("key"), "chunk", first.cast("long").alias("first"),
            F.col("text").substr(first + 1, (F.col("chunk") + 1) * chunk + overlap - first).alias("text"),
            F.col("text").substr(F.col("chunk") * chunk + 1, F.lit(chunk)).alias("core"))
        .repartition("key", "chunk")  # the chunks of one long text go to many tasks
    )
    made = T.StructType([
        T.StructField("key", pieces.schema["key"].dataType), T.StructField("chunk", T.IntegerType()), T.StructField("core", T.StringType()),
        T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    joined = (
        pieces.mapInArrow(_chunk_batches(path), made)
        .groupBy("key").agg(F.collect_list(F.struct("chunk", "core", "starts", "counts", "ids")).alias("parts"))
        .select("key.key", _stitcher(path)("parts").alias("ids"))
    )
    return short.unionByName(joined).withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text): the texts of lists of ids, their raw bytes concatenated before UTF-8 is read."""
    path = path or tokenizer_path()

    def run(batches):
        back = encoding(path)
        for b in batches:
            texts = [back.decode_bytes(i.as_py() or []).decode("utf-8", "replace") for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])
    return df.select(key, F.col(ids)).mapInArrow(run, out)


def count_tokens(df: DataFrame, text: str, out: str = "n_tok", path: str | None = None) -> DataFrame:
    """``df`` without ``text``, with the number of its tokens (0 for null and empty texts)."""
    path = path or tokenizer_path()
    kept = [c for c in df.columns if c != text]

    def run(batches):
        enc = Encoder(path)
        for b in batches:
            counts = [len(enc.text(t.as_py())) // 4 if t.is_valid and t.as_py() else 0 for t in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(kept))], pa.array(counts, pa.int64())], names=[*kept, out])

    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.LongType())])
    return df.select(*kept, text).mapInArrow(run, schema)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents decoded from their ids: the text itself, '' for null."""
    return decode(p8_ids(spark, sf_dir), "doc_id", "ids")
