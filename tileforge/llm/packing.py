"""Packing token pieces into windows by minimum bin slack.

A document's full windows are sequences of their own; what is left of it, shorter than a window, is packed. Lengths below
the window form a histogram of at most ``window`` cells, however large the corpus is. The plan is made from that histogram
alone: a window takes the longest length left, and a subset-sum program over bitsets finds the multiset of other lengths
that fills it closest to capacity; backtracking gives its counts, and the pattern is repeated as often as the counts allow.
Spark then deals the pieces to the plan: the piece of rank r among those of its length has its place in closed form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, durable, running_sum, table, unit_hash

WINDOW = 2048
END = 1
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
#: Texts of these characters only are cut into words alike by both tokenizer libraries; others go to the slower one.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-ɏ]*")

_encoders: dict[str, object] = {}


def encode(text: str) -> list[int]:
    """The ids of a text by the vocabulary in TOKENIZER, without special tokens added.

    tiktoken has the same vocabulary and merges and is four times as fast; texts outside PLAIN, or with the special
    token's string, are left to tokenizers itself.
    """
    import public_tokenizers

    if PLAIN.fullmatch(text) and SPECIAL not in text:
        if "fast" not in _encoders:
            import base64

            import tiktoken

            with open(public_tokenizers.path(RANKS), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _encoders["fast"] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return _encoders["fast"].encode_ordinary(text)
    if "full" not in _encoders:
        from tokenizers import Tokenizer

        _encoders["full"] = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    return _encoders["full"].encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, tie): full windows and the rest of every document; the end id is its last.

    Null texts are empty: such a document is its end id alone. ``tie`` is a hash of the text and tells repeated keys apart.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            owner: list[int] = []
            for at, t in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(t or ""), END], "<u4")
                tie = int(np.uint64(xxhash.xxh3_64_intdigest(ids.tobytes())).astype(np.int64))
                for start in range(0, len(ids), window):
                    own = ids[start : start + window]
                    owner.append(at)
                    rows.append((start, len(own), zlib.crc32(own.tobytes()), len(ids), tie))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], [key, "start", "length", "ids_crc32", "doc_tokens", "tie"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(cut, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, tie long")


def best_fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is largest but at most ``capacity``: {length: count}.

    Bit s of ``reach`` tells that sum s can be made. Long lengths come in first; of each the counts are split into powers of
    two, one shift of the bitset each. Going back over the steps gives the counts.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in np.nonzero(counts[: capacity + 1])[0][::-1].tolist():
        left = min(int(counts[length]), capacity // length)
        part = 1
        while left > 0:
            part = min(part, left)
            wider = reach | (reach << (part * length)) & mask
            if wider != reach:
                steps.append((length, part, reach))
                reach = wider
            left -= part
            part *= 2
        if reach >> capacity & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + part
            total -= length * part
    return out


def plan(histogram: dict[int, int], window: int = WINDOW) -> pd.DataFrame:
    """Rows (length, rank, per, sequence, offset): from ``rank`` on, ``per`` pieces of the length go to each sequence in turn."""
    counts = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used = np.zeros(window + 1, np.int64)
    rows, sequence = [], 0
    while counts.any():
        seed = int(np.nonzero(counts)[0][-1])
        counts[seed] -= 1
        pattern = best_fill(counts, window - seed)
        counts[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(int(counts[x]) // n for x, n in pattern.items())
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rows.append((length, int(used[length]), n, sequence, offset))
            used[length] += n * times
            counts[length] -= n * times
            offset += n * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "per", "sequence", "offset"], dtype="int64")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    Pieces of one length are ranked by a hash of key, start and text, then by these themselves; pieces alike in all of these are
    alike in the result. An empty table has no pieces.
    """
    cut = durable(pieces(docs, key, text, window))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    total = sum(histogram.values())
    shared = docs.sparkSession.sparkContext.broadcast(plan(histogram, window).sort_values(["length", "rank"]).reset_index(drop=True))

    placed = cut.withColumn("_place", unit_hash(F.lit("pack"), key, "start", "tie"))
    ranked = running_sum(placed, "length", "_place", [key, "start", "tie"], F.lit(1), buckets_for(total), "_rank").drop("_place", "tie")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        lengths, ranks = p["length"].to_numpy(), p["rank"].to_numpy()
        code = lengths * (1 << 40) + ranks
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(code, length * (1 << 40) + rank, side="right") - 1
            nth, per = rank - ranks[at], p["per"].to_numpy()[at]
            names = [n for n in b.schema.names if n != "_rank"]
            columns = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p["sequence"].to_numpy()[at] + nth // per), pa.array(p["offset"].to_numpy()[at] + nth % per * length)], [*names, "sequence_id", "offset"])

    fields = [f for f in ranked.schema if f.name != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    out = ranked.mapInArrow(deal, schema)
    return out.select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
