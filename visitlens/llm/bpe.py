"""Byte-level BPE over whole corpora: every distinct word of the corpus is encoded once.

Documents are dealt to blocks of bounded bytes. A block gives its distinct pre-tokens, dealt
by a hash of the word, so that all blocks' copies of a word meet in one task; there the word
is encoded once and its ids go back to every block that asked. The block then reads its
documents again and puts ids in the place of words, position by position. Words travel as
one compressed list for each block and word part, not as one row each: a frequent word costs
one entry a block, however often it occurs. Decoding joins the token-byte table, which the
vocabulary bounds, to the ids on the map side.

Defined cases: a null text is empty; an empty text has no ids and decodes to no bytes. Rows
that repeat an id or a text are rows of their own; a null id is kept. A document longer than
a block is a block alone. An empty table gives an empty result. Other columns are not looked
at.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import shuffle_parts, whole_text
from visitlens.llm.pretokens import splitter

BLOCK_BYTES = 12 << 20
CACHED_WORDS = 120_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def pack_words(words: list[str]) -> bytes:
    """Words as one compressed cell: their lengths, then their bytes."""
    data = [w.encode() for w in words]
    sizes = np.fromiter(map(len, data), "<u4", len(data))
    return zlib.compress(len(data).to_bytes(8, "little") + sizes.tobytes() + b"".join(data), 6)


def unpack_cells(cell: bytes, unit: int = 1) -> list[bytes]:
    """The byte strings of a packed cell; ``unit`` is the number of bytes a length counts."""
    raw = zlib.decompress(cell)
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 8).astype(np.int64)) * unit + 8 + 4 * n
    starts = np.concatenate([[8 + 4 * n], ends[:-1]]) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def pack_ids(ids: list[list[int]]) -> bytes:
    sizes = np.fromiter(map(len, ids), "<u4", len(ids))
    flat = np.fromiter((i for one in ids for i in one), "<u4", int(sizes.sum()))
    return zlib.compress(len(ids).to_bytes(8, "little") + sizes.tobytes() + flat.tobytes(), 6)


def by_part(words: set[str], parts: int) -> dict[int, list[str]]:
    """Words dealt by their hash and sorted, the same in every task."""
    dealt: dict[int, list[str]] = {}
    for word in words:
        dealt.setdefault(zlib.crc32(word.encode()) % parts, []).append(word)
    return {part: sorted(found) for part, found in dealt.items()}


def token_bytes(ranks: dict[bytes, int]) -> list[bytes | None]:
    """The token-byte table: place i holds the bytes of token i."""
    table = {i: data for data, i in ranks.items()}
    return [table.get(i) for i in range(max(table) + 1)]


def joined_bytes(ids: bytes, table: list[bytes | None]) -> bytes:
    """Every id of a document joined to its bytes, in order."""
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, ranks_path: str, pattern: str, with_decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids``: ids as little-endian unsigned 32-bit integers.

    ``with_decoded`` adds what ``decoded`` would, in the same task: ids of a whole corpus
    are larger than its text, and so do not go to a second Python process.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    text = whole_text()
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(parts, -(-total // BLOCK_BYTES))
    dealt = docs.select(
        "doc_id", text.alias("text"), F.pmod(F.xxhash64("doc_id", F.xxhash64(text)), F.lit(blocks)).alias("block")
    )

    def distinct_words(rows: pd.DataFrame) -> pd.DataFrame:
        split, words = splitter(pattern), set()
        for one in rows["text"]:
            words.update(split(one))
        dealt = by_part(words, parts)
        return pd.DataFrame(
            {
                "block": [rows["block"].iloc[0]] * len(dealt),
                "part": list(dealt),
                "words": [pack_words(found) for found in dealt.values()],
            }
        )

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            cells = []
            for cell in batch.column("words"):
                ids = []
                for word in unpack_cells(cell.as_py()):
                    found = known.get(word)
                    if found is None:
                        if len(known) >= CACHED_WORDS:
                            known.clear()
                        found = known[word] = merges.encode_ordinary(word.decode())
                    ids.append(found)
                cells.append(pack_ids(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("part"), pa.array(cells, pa.binary())],
                names=["block", "part", "ids"],
            )

    def put_together(rows: pd.DataFrame, coded: pd.DataFrame) -> pd.DataFrame:
        # Texts are split twice, since the words of a whole block would not fit beside it.
        split, words = splitter(pattern), set()
        for one in rows["text"]:
            words.update(split(one))
        ids_of: dict[str, bytes] = {}
        dealt = by_part(words, parts)
        for part, cell in zip(coded["part"], coded["ids"], strict=True):
            ids_of.update(zip(dealt[part], unpack_cells(cell, 4), strict=True))
        ids = [b"".join(map(ids_of.__getitem__, split(one))) for one in rows["text"]]
        out = {"doc_id": rows["doc_id"].array, "n_tokens": [len(x) // 4 for x in ids], "ids": ids}
        if with_decoded:
            table = token_bytes(ranks.value)
            out["decoded"] = [joined_bytes(x, table) for x in ids]
        return pd.DataFrame(out)

    words = dealt.groupBy("block").applyInPandas(distinct_words, "block long, part int, words binary")
    coded = words.repartition(parts, "part").mapInArrow(encode_words, "block long, part int, ids binary")
    both = dealt.groupBy("block").cogroup(coded.groupBy("block"))
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * with_decoded
    return both.applyInPandas(put_together, schema)


def decoded(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """The rows with ``decoded``: the bytes of every token of ``ids``, looked up by its id.

    A hash join by hand, one probe a token: the table of the vocabulary's tokens goes to
    every task once.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(token_bytes(read_ranks(ranks_path)))
    schema = f"{', '.join(f'{n} {t}' for n, t in tokens.dtypes)}, decoded binary"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = shared.value
        for batch in batches:
            cells = [joined_bytes(ids.as_buffer(), bytes_of) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.binary())], names=[*batch.schema.names, "decoded"]
            )

    return tokens.mapInArrow(look_up, schema)
