"""Problem 8: encoding of whole texts with a public tokenizer, by overlapping chunks.

Texts are pre-tokenised in chunks; chunks of one text are stitched where their pre-token boundaries resynchronise, and
the pieces between the seams are encoded, pre-token by pre-token.
"""

from __future__ import annotations

import base64
import functools
import os
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread, written

#: Folder of the public vocabulary files, and the vocabulary of the production query.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Length of a chunk, and how far it reaches into the next (code points).
CHUNK, OVERLAP = 8_192, 512
#: Chunks of long texts that one task takes.
TASK_CHUNKS = 512
#: Pre-tokens whose ids a worker keeps, and the longest that is kept; beyond, they are encoded again.
KEPT, KEPT_LENGTH = 500_000, 64

# fixed value: the public pre-token pattern of the byte-level vocabularies
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once in each worker."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: The pre-tokens of a text scanned from its first character; they cover all of it, and the scan never looks back.
pretokens = regex.compile(PATTERN).findall


class _Ids(dict):
    """pre-token -> ids; words that come again are encoded once, up to a bounded number of them."""

    def __init__(self, folder: str, vocabulary: str):
        super().__init__()
        self.one = encoder(folder, vocabulary).encode_ordinary

    def __missing__(self, token: str) -> list[int]:
        ids = self.one(token)
        if len(token) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[token] = ids
        return ids


@functools.lru_cache(maxsize=4)
def _ids(folder: str, vocabulary: str) -> _Ids:
    return _Ids(folder, vocabulary)


def seams(part: str, at: int, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Pre-token starts of a chunk in its first `overlap` characters, and in what reaches into the next chunk.

    The end of a chunk may cut its last pre-token, but not move that one's start.
    """
    starts = [0, *accumulate(map(len, pretokens(part)))][:-1]
    return [at + s for s in starts if s < overlap], [at + s for s in starts if s >= chunk]


def _lists(values: array, ends: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(np.frombuffer(values, np.int32) if values else [], pa.int32()))


def _coded(texts: list[str | None], ids: _Ids) -> pa.Array:
    """The ids of each text (none for a null one)."""
    out, ends = array("i"), []
    for text in texts:
        if text:
            out.extend(chain.from_iterable(map(ids.__getitem__, pretokens(text))))
        ends.append(len(out))
    return _lists(out, ends)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, count: bool = False) -> DataFrame:
    """(key, ids): the ids of each text without special tokens; an empty list for an empty or null text.

    One pass over the table cuts every text into overlapping chunks. A text of one chunk is pre-tokenised and encoded
    there. The chunks of a longer one are spread over the tasks and pre-tokenised, each from its own first character;
    two neighbours are stitched at the first boundary that both scans have where they overlap, for from a shared
    boundary on they agree. The piece of a chunk, from its first seam to the next, is then encoded. A text with two
    chunks that never agree (a run of letters longer than the overlap) is encoded in one piece. Special strings in a
    text are ordinary text. Rows are kept apart whatever their keys, so a key may come twice or be null; other
    columns are not touched; an empty table gives no rows. With `count` the column is n, the number of ids.
    """
    if overlap >= chunk:
        raise ValueError("chunks may only reach into the next one")
    value, kind = ("n", "int") if count else ("ids", "array<int>")
    rows = spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))).withColumn("_row", F.monotonically_increasing_id())
    key_kind = rows.schema["_key"].dataType.simpleString()

    def result(lists: pa.Array) -> pa.Array:
        return lists.value_lengths().cast(pa.int32()) if count else lists

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(folder, vocabulary)
        for batch in batches:
            index, at, parts, whole = [], [], [], []
            for i, x in enumerate(batch.column("_text").to_pylist()):
                if x is None or len(x) <= chunk:
                    index.append(i), at.append(0), parts.append(None), whole.append(x)
                else:
                    for a in range(0, len(x), chunk):
                        index.append(i), at.append(a), parts.append(x[a : a + chunk + overlap]), whole.append(None)
            of = pa.array(index, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(of), batch.column("_key").take(of), pa.array(at, pa.int32()), pa.array(parts, pa.string()), result(_coded(whole, ids))], ["_row", "_key", "at", "part", value])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [seams(x, a, chunk, overlap) for x, a in zip(batch.column("part").to_pylist(), batch.column("at").to_pylist(), strict=True)]
            sides = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("at"), *sides], ["_row", "at", "starts", "reach"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(folder, vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_key"), batch.column("at"), result(_coded(batch.column("piece").to_pylist(), ids))], ["_row", "_key", "at", value])

    schema = f"_row long, _key {key_kind}, at int"
    cuts, seen = written(rows.mapInArrow(cut, f"{schema}, part string, {value} {kind}"), {"chunks": F.count("part")})
    short = cuts.filter("part is null").select(F.col("_key").alias(key), value)
    chunks = cuts.filter("part is not null").select("_row", "_key", "at", "part")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-seen["chunks"] // TASK_CHUNKS))
    apart = lambda c: c.repartition(tasks, "_row", "at")
    marks = apart(chunks.select("_row", "at", "part")).mapInArrow(marked, "_row long, at int, starts array<int>, reach array<int>")
    order = Window.partitionBy("_row").orderBy("at")
    ends = marks.select("_row", "at", F.array_min(F.array_intersect("reach", F.lead("starts").over(order))).alias("end"), F.lead("at").over(order).alias("next"))
    broken = F.max((F.col("end").isNull() & F.col("next").isNotNull()).cast("int")).over(Window.partitionBy("_row")) == 1
    ends = ends.select("_row", "at", F.coalesce(F.lag("end").over(order), F.lit(0)).alias("begin"), "end", broken.alias("broken"))
    pieces = chunks.join(ends, ["_row", "at"])
    inner = F.substring("part", F.col("begin") - F.col("at") + 1, F.coalesce("end", F.lit(2**30)) - F.col("begin"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.substring("part", 1, chunk).alias("text")))), lambda c: c["text"]), "")
    once = pieces.filter("broken").groupBy("_row", "_key").agg(F.lit(0).alias("at"), whole.alias("piece"))
    each = apart(pieces.filter("not broken").select("_row", "_key", "at", inner.alias("piece")).unionByName(once)).mapInArrow(coded, f"{schema}, {value} {kind}")
    joined = F.sum("n").cast("int") if count else F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda c: c["ids"]))
    long = each.groupBy("_row", "_key").agg(joined.alias(value)).select(F.col("_key").alias(key), value)
    return short.unionByName(long)


def decode(ids: list[int], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> str:
    """The text of ids: the raw bytes of the tokens joined, then read as UTF-8."""
    enc = encoder(folder, vocabulary)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8", errors="replace")
