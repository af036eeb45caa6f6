"""Packing of tokenised documents into fixed-length sequences.

The lengths of all pieces form a histogram of at most ``capacity`` entries.  On it
a configuration linear program (each configuration: lengths that fit in one
sequence together) is solved by multiplicative weights; a knapsack dynamic program
prices the best configuration for every length at once.  The fractional solution is
rounded down, what is left goes through the program again and at last through a
decreasing fit, all on counts by length.  Every vector of weights also bounds the number
of sequences from below (no sequence is worth more than the best filling); while the plan
is farther than GAP from the best bound, the weights are multiplied on and the plan is
rounded anew from their averages.  The pieces themselves stay distributed: each learns its
place from its rank among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm.arrays import small_batches
from corpuslens.llm.store import settle, table
from corpuslens.llm.tokens import encoder

CAPACITY = 2048
#: Rounds of the linear program, weight updates in each, and the learning rate.
ROUNDS, STEPS, ETA = 6, 12, 0.35
#: Share of sequences above the bound at which the plan is good enough; most and fewest further updates, first
#: rate, and the part of the gap that two roundings must close for the updates to go on.
GAP, UPDATES, LEAST_UPDATES, RATE, STALL = 5e-4, 256, 32, 0.5, 0.02
#: Share above the bound from which the other way to break ties is tried as well.
FAR = 3e-3

#: Bound on the broadcast table of places.
MAX_BYTES = 64 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, piece number, start and length of the pieces of documents of ``n`` ids each.

    A document is cut only if longer than ``capacity``; its first piece takes the remainder."""
    parts = -(-n // capacity)
    row = np.repeat(np.arange(len(n)), parts)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = n - (parts - 1) * capacity
    start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
    return row, piece, start, np.where(piece == 0, first[row], capacity)


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of every document; with ``with_ids`` also the ids themselves."""

    def cut(batches):
        enc = encoder(tokenizer)
        for batch in small_batches(batches):
            ids, counts = enc.encode(batch.column(1))
            ends = np.cumsum(counts + 1)
            flat = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint32)
            keep = np.ones(len(flat), bool)
            keep[ends - 1] = False
            flat[keep] = ids
            row, piece, start, length = pieces_of(counts + 1, capacity)
            at = (ends - counts - 1)[row] + start
            view = memoryview(flat.view(np.uint8))
            spans = [view[4 * a : 4 * (a + k)] for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            out = [
                batch.column(0).take(pa.array(row)),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array([zlib.crc32(s) for s in spans], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array([np.frombuffer(s, np.uint32).astype(np.int32) for s in spans], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, PIECES + (", ids array<int>" if with_ids else "")
    )


def best_fillings(weights: np.ndarray, capacity: int, longest: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the greatest value of each room 0..capacity, and the length taken first (0: none).

    ``weights[l]`` is the value of one piece of length l, not above 0 where there is none.  Of equal values
    the longest piece is taken, which leaves short ones to fill gaps, or else the shortest."""
    best = np.zeros(capacity + 1)
    first = np.zeros(capacity + 1, np.int64)
    present = np.flatnonzero(weights > 0)
    value = weights[present]
    if (capacity // present).sum() < capacity:  # few lengths: one after the other, in runs as long as the length
        for x in present.tolist():
            for at in range(x, capacity + 1, x):
                run = slice(at, min(at + x, capacity + 1))
                gain = weights[x] + best[at - x : run.stop - x]
                more = gain > best[run]
                best[run], first[run] = np.where(more, gain, best[run]), np.where(more, x, first[run])
        return best, first
    for room in range(1, capacity + 1):
        k = np.searchsorted(present, room, "right")
        best[room] = best[room - 1]
        first[room] = -1
        if k:
            gain = value[:k] + best[room - present[:k]]
            j = k - 1 - int((gain[::-1] >= gain.max() * (1 - 1e-12)).argmax()) if longest else int(gain.argmax())
            if gain[j] > best[room]:
                best[room], first[room] = gain[j], present[j]
    # a room that is best left partly empty fills as the next smaller room
    for room in range(1, capacity + 1):
        if first[room] < 0:
            first[room] = first[room - 1]
    return best, first


def filling(first: np.ndarray, room: int) -> list[int]:
    """The lengths of the best filling of a room."""
    out = []
    while room and first[room] > 0:
        out.append(int(first[room]))
        room -= out[-1]
    return out


def configurations(need: np.ndarray, capacity: int, longest: bool, steps: int = STEPS, eta: float = ETA) -> Counter:
    """Fractional solution of the configuration program: {configuration: amount}.

    Each step prices, for every length still in need, the most valuable sequence
    that holds it, and lowers the weights of lengths that are covered early."""
    lengths = np.flatnonzero(need)
    covered = np.zeros(capacity + 1)
    amount: Counter = Counter()
    for step in range(steps):
        target = need * ((step + 1) / steps)
        weights = np.zeros(capacity + 1)
        lag = np.clip((target - covered)[lengths] / need[lengths] * steps, -8, 8)
        weights[lengths] = lengths * np.exp(eta * lag)
        _, first = best_fillings(weights, capacity, longest)
        for length in lengths[::-1]:
            short = target[length] - covered[length]
            if short <= 0:
                continue
            config = [int(length), *filling(first, capacity - int(length))]
            uses = Counter(config)
            share = short / uses[int(length)]
            amount[tuple(sorted(config, reverse=True))] += share
            for k, c in uses.items():
                covered[k] += share * c
    return amount


class Left:
    """Pieces by length that have no place yet, and the sequences taken so far."""

    def __init__(self, need: np.ndarray, longest: bool):
        self.left, self.taken, self.longest = need.copy(), [], longest

    def take(self, config: tuple[int, ...], most: int) -> int:
        uses = Counter(config)
        k = min(most, *(int(self.left[x]) // c for x, c in uses.items()))
        if k > 0:
            for x, c in uses.items():
                self.left[x] -= k * c
            self.taken.append((config, k))
        return k

    def finish(self, capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
        """Place all that is left: by the program, rounded down, and at last by a decreasing fit."""
        left = self.left
        if left[capacity]:
            self.take((capacity,), int(left[capacity]))
        for _ in range(rounds):
            if not left.any():
                break
            found = configurations(left.astype(float), capacity, self.longest)
            # the fullest first, so that rounding gives up the worst
            order = sorted(found.items(), key=lambda x: (capacity - sum(x[0]), -x[1], x[0]))
            if not sum(self.take(c, int(x)) for c, x in order if x >= 1):
                for c, _ in order:
                    if sum(c) == capacity:
                        self.take(c, 1)
                break
        while left.any():
            room, config, used = capacity, [], Counter()
            while room:
                fits = np.flatnonzero(left[: room + 1])
                while len(fits) and left[fits[-1]] <= used[int(fits[-1])]:
                    fits = fits[:-1]
                if not len(fits):
                    break
                x = int(fits[-1])
                config.append(x)
                used[x] += 1
                room -= x
            self.take(tuple(config), int(left.max()))
        return self.taken


def sequences_of(taken: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(k for _, k in taken)


def simple_bound(need: np.ndarray, capacity: int) -> int:
    """Sequences needed at least: pieces of more than half a sequence stand apart, and those with
    no room for a length of ``k`` are of no use to pieces of ``k`` and more."""
    size = np.arange(capacity + 1)
    room, count = np.cumsum(need * size), np.cumsum(need)
    half = capacity // 2
    k = np.arange(half + 1)
    apart = count[-1] - count[half]
    small = room[half] - np.where(k > 0, room[np.maximum(k - 1, 0)], 0)  # lengths k .. half
    wide = room[capacity - k] - room[half]  # lengths over half, with room for k
    spare = (count[capacity - k] - count[half]) * capacity - wide
    return int((apart + np.maximum(0, -(-(small - spare) // capacity))).max())


def refined(need: np.ndarray, capacity: int, taken: list, bound: float, longest: bool):
    """Better plans by multiplicative weights: the best plan and bound found.

    A length's weight is multiplied by how much it was short in the last step's
    configurations, those within a thousandth of the best.  After 1, 2, 4, ... updates the plan is
    rounded from the averages so far: by the amounts, and by the weights' order; updates
    end when the gap is closed or two roundings in a row have hardly narrowed it."""
    lengths = np.flatnonzero(need)
    weights, sums, covered = np.zeros(capacity + 1), np.zeros(capacity + 1), np.zeros(capacity + 1)
    weights[lengths] = lengths / capacity
    amount: Counter = Counter()
    gaps = [sequences_of(taken) - bound]
    for step in range(1, UPDATES + 1):
        best, first = best_fillings(weights, capacity, longest)
        bound = max(bound, float(need @ weights) / best[capacity])
        sums += weights / best[capacity]
        near = [x for x in lengths.tolist() if weights[x] + best[capacity - x] >= 0.999 * best[capacity]]
        configs = {tuple(sorted([x, *filling(first, capacity - x)], reverse=True)) for x in near}
        uses = {c: Counter(c) for c in configs}
        most = {c: min(need[x] / k for x, k in uses[c].items()) for c in configs}
        scale = bound / sum(most.values())
        now = np.zeros(capacity + 1)
        for c in configs:
            amount[c] += most[c] * scale
            for x, k in uses[c].items():
                now[x] += most[c] * scale * k
        covered += now
        weights[lengths] *= np.exp(np.clip(RATE / np.sqrt(step) * (1 - now[lengths] / need[lengths]), -1, 1))
        if step & (step - 1):
            continue
        value, _ = best_fillings(sums, capacity)
        bound = max(bound, float(need @ sums) / value[capacity])
        worth = {c: sum(sums[x] for x in c) for c in amount}
        by_worth = sorted(amount, key=lambda c: (-worth[c], c))
        for share in (1 / step, None):
            plan_ = Left(need, longest)
            for c in by_worth:
                plan_.take(c, int(amount[c] * share) if share else int(need.max()))
            new = plan_.finish(capacity, 2)
            taken = min(taken, new, key=sequences_of)
        gaps.append(sequences_of(taken) - bound)
        if sequences_of(taken) <= max(np.ceil(bound - 1e-6), bound * (1 + GAP)) or step >= LEAST_UPDATES and gaps[-1] > (1 - STALL) * gaps[-3]:
            break
    return taken, bound


def bounded_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Whole numbers of sequences by configuration that hold exactly the given pieces, and a lower bound on any plan's sequences."""
    need = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        need[length] += count
    bound = float(simple_bound(need, capacity))
    enough = lambda gap: max(np.ceil(bound - 1e-6), bound * (1 + gap))
    taken: list = []
    for longest in (True, False):
        if longest or sequences_of(taken) > enough(FAR):
            own = Left(need, longest).finish(capacity)
            taken = own if longest else min(taken, own, key=sequences_of)
            if sequences_of(taken) > enough(GAP):
                taken, bound = refined(need, capacity, taken, bound, longest)
    return taken, int(np.ceil(bound - 1e-6))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """The plan of :func:`bounded_plan`."""
    return bounded_plan(histogram, capacity)[0]


def slots(packed: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places by length: sorted keys (length, first rank), first sequence and offset of each run."""
    runs, at, seen = [], 0, Counter()
    for config, count in packed:
        offset = 0
        for length in config:
            runs.append((length, seen[length], at, offset))
            seen[length] += count
            offset += length
        at += count
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to settled pieces (doc_id, piece, length, ...), n_sequences and least_sequences (the bound).

    Ranks are counted within (length, bucket), so a length that a third of all
    pieces share is spread over all buckets."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    packed, least = bounded_plan(histogram, capacity)
    total = sequences_of(packed)
    # bounded by rounds * steps * capacity configurations, whatever the number of documents
    table_ = slots(packed)
    if sum(x.nbytes for x in table_) > MAX_BYTES:
        raise ValueError("more configurations than the program can have")
    places = spark.sparkContext.broadcast(table_)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    offsets = (
        dealt.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
        .drop("n")
    )
    ranked = (
        dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")))
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("rank") - 1 + F.col("before"))
        .select(*pieces.columns, "rank")
    )

    def place(batches):
        length, first, sequence, offset = places.value
        for batch in batches:
            own = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("rank"))
            # runs are sorted by (length, first): find the last run not after the rank
            low = np.searchsorted(length, own, "left")
            high = np.searchsorted(length, own, "right")
            while np.any(high - low > 1):
                mid = (low + high) // 2
                up = first[np.minimum(mid, len(first) - 1)] <= rank
                go = high - low > 1
                low, high = np.where(go & up, mid, low), np.where(go & ~up, mid, high)
            out = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            out += [pa.array(sequence[low] + rank - first[low]), pa.array(offset[low]), *(pa.array(np.full(batch.num_rows, x)) for x in (total, least))]
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset", "n_sequences", "least_sequences"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long, n_sequences long, least_sequences long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack whole documents: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset, n_sequences, least_sequences.

    The last two are the number of sequences in all, and a lower bound on it that the
    weights of the program prove.  A null text counts as empty and packs as its end id
    alone.  Repeated rows are packed once each, a null doc_id is a key like others; an
    empty table gives no rows.  Other columns, whatever their names, are ignored.
    """
    return pack(settle(tokenised_pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
