"""Best-fit packing: minimum bin slack over the histogram of lengths.

Tokenising is one Arrow pass.  How pieces share sequences depends on their
lengths alone, so the plan is made from the histogram of lengths, which has at
most `capacity` rows however many documents there are.  Each plan step seeds a
bin with the longest length left, finds by a bitset subset-sum programme the
fullest combination of available lengths that fits beside it, and takes that
combination as often as the counts allow.  The steps become rank intervals per
length; pieces get their rank within their length by salted windows, so a
length that a third of all pieces share is ranked by many tasks.

Defined cases: null text is empty and packs as the end token alone; equal rows
(same id and text) are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftgraph.llm.shared import cut, lean, only

SALTS = 128


def _encoder(ranks_path: str, pattern: str):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("weftgraph", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenize_pieces(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its token ids and end_id.  One of more than `capacity` ids is
    cut into pieces of exactly that many; the remainder is its first piece.
    ranks_path is a byte-level BPE vocabulary as ranks, which executors read
    (ship it with the job, as with any model file).
    """
    rows = only(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id").withColumnRenamed(text_col, "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks_path, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            src, piece, start, length, crc, kept = [], [], [], [], [], []

            def flush():
                cols = [ids.take(pa.array(src, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                return pa.RecordBatch.from_arrays(cols, names=names)

            for k in range(len(texts)):
                got = enc.encode_ordinary(texts[k].as_py() or "")
                got.append(end_id)
                arr = np.array(got, np.dtype("<u4"))
                n, at, p = len(arr), 0, 0
                step = n % capacity or capacity
                while at < n:
                    part = arr[at : at + step]
                    src.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
                    at, p, step = at + step, p + 1, capacity
                if len(src) >= 4000:
                    yield flush()
                    src, piece, start, length, crc, kept = [], [], [], [], [], []
            if src:
                yield flush()

    return rows.mapInArrow(lean(run), fields)


def slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Plan steps ([(length, times in a bin)], bins) that use up counts.

    Per step: the longest length left seeds the bin; `reach` is a bitset whose
    bit s says that available lengths sum to s; its highest bit within the room
    is the least slack.  The step repeats while all its lengths last.
    """
    left = {l: c for l, c in counts.items() if c > 0}
    if any(not 0 < l <= capacity for l in left):
        raise ValueError("lengths must be from 1 to capacity")
    steps = []
    while left:
        seed = max(left)
        room = capacity - seed
        left[seed] -= 1
        full, reach, trail = (1 << (room + 1)) - 1, 1, []
        for l in sorted((x for x in left if x <= room and left[x]), reverse=True):
            most, take = min(left[l], room // l), 1
            while most > 0 and not reach >> room & 1:
                take = min(take, most)
                trail.append((l, take, reach))
                reach = (reach | reach << (l * take)) & full
                most, take = most - take, take * 2
            if reach >> room & 1:
                break
        left[seed] += 1
        bin_, target = {seed: 1}, reach.bit_length() - 1
        for l, take, before in reversed(trail):
            if not before >> target & 1:
                bin_[l] = bin_.get(l, 0) + take
                target -= l * take
        times = min(left[l] // m for l, m in bin_.items())
        for l, m in bin_.items():
            left[l] -= times * m
            if not left[l]:
                del left[l]
        steps.append((sorted(bin_.items(), reverse=True), times))
    return steps


def _intervals(steps: list, first: int = 0) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank past the last, first sequence, times in a bin, place of the first)."""
    out, used, seq = [], {}, first
    for bin_, times in steps:
        at = 0
        for l, m in bin_:
            r = used.get(l, 0)
            out.append((l, r, r + times * m, seq, m, at))
            used[l] = r + times * m
            at += l * m
        seq += times
    return out


def pack(pieces: DataFrame, *, capacity: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset; its column length says what is packed.

    Shuffles only the pieces' rows, by (length, salt).  What reaches the driver
    is the histogram (at most `capacity` rows); what is broadcast is the plan,
    whose bins hold at most capacity tokens: under 45 lengths a step.
    """
    spark = pieces.sparkSession
    own = [c for c in pieces.columns]
    pieces = cut(pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")), "pieces")
    per_salt = pieces.groupBy(F.col("length").alias("_l"), F.col("_salt").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    before = cut(per_salt.select("_l", "_s", "_n", (F.sum("_n").over(Window.partitionBy("_l").orderBy("_s")) - F.col("_n")).alias("_before")), "piece-counts")
    counts = {r[0]: r[1] for r in before.groupBy("_l").agg(F.sum("_n")).collect()}
    plan = spark.createDataFrame(_intervals(slack_plan(counts, capacity)), "_len long, _from long, _to long, _seq long, _times long, _place long")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("_k", rank.cast("long"))
    # both small sides are bounded: capacity * SALTS rows, and the plan
    ranked = ranked.join(F.broadcast(before.drop("_n")), (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s")))
    ranked = ranked.withColumn("_rank", F.col("_k") + F.col("_before"))
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    within = F.col("_rank") - F.col("_from")
    return placed.select(
        *own,
        (F.col("_seq") + F.floor(within / F.col("_times"))).cast("long").alias("sequence_id"),
        (F.col("_place") + (within % F.col("_times")) * F.col("length")).cast("long").alias("offset"),
    )
