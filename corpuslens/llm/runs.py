"""Runs of repeated words: stretches that repeat with a period at least four times over.

Equality of words is exact (numbers from a dictionary).  Two ways find the stretches that
equal themselves moved by a lag:

* Lags up to SHORT are compared directly, each over all words at once.
* Longer ones at scales P = SHORT, 2 SHORT, 4 SHORT, ... for periods above P, up to 2 P.
  The context of a place is the 2 P words from there, named by a hash made by doubling.  In
  each window of P places the place whose context has the least hash is chosen.  A run of
  period q is at least 4 q long, so its first window, and that window moved by q, lie with
  all contexts inside it: both choose, q apart.  Two equal contexts less than q apart
  inside the run would give it a smaller period.  So neighbouring chosen places of equal
  hash are q apart, and such pairs are the seeds.  Seeds of one lag whose contexts touch
  are one stretch; its ends are extended word by word.

The seeds are compared exactly, so a hash met twice (64 bits) can only hide a run, with a
probability of some 1e-8 in a text of a million words.  A stretch whose period is a
multiple of a smaller one is left out.  Everything happens where a text is read; nothing
is shuffled.  A text is held whole by one task, with some 100 bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.arrays import offsets
from corpuslens.llm.store import table

SHORT, TIMES, LEAST = 16, 4, 6
#: Bytes of text searched at once (one longer text is searched alone).
CHUNK_BYTES = 4 << 20
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of x[i], ..., x[i + w - 1] for every i (fewer at the end), by doubling."""
    out, have = x.copy(), 1
    while have < w:
        step = min(have, w - have)
        np.minimum(out[:-step], out[step:], out=out[:-step])
        have += step
    return out


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of at least ``least`` true values begin and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    begin, end = edges[::2], edges[1::2]
    keep = end - begin >= least
    return begin[keep], end[keep]


def _extended(ids: np.ndarray, at: np.ndarray, lag: np.ndarray, end: np.ndarray, step: int) -> np.ndarray:
    """Words from ``at`` on (step 1) or before it (step -1) that equal the words ``lag`` behind them, up to ``end``.

    All places are compared at once, a block of words at a time; those that go on stay."""
    out = np.zeros(len(at), np.int64)
    open_ = np.flatnonzero((end - at) * step > 0)
    block = 16
    while len(open_):
        k = np.arange(block)
        room = (end[open_] - at[open_]) * step - out[open_]
        first = at[open_] + step * out[open_] - (step < 0)
        place = first[:, None] + step * np.minimum(k, room[:, None] - 1)
        same = (ids[place] == ids[place + lag[open_, None]]) & (k < room[:, None])
        got = np.where(same.all(1), block, same.argmin(1))
        out[open_] += got
        open_ = open_[got == block]
        block = min(2 * block, max(16, (1 << 18) // max(1, len(open_))))
    return out


def _primes_of(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def find_runs(ids: np.ndarray, counts: np.ndarray, short: int = SHORT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of texts laid end to end: (start, length, period), by start, then period.

    ``ids`` are numbers of words, ``counts`` the words of each text.  A run has its smallest
    period q, at least max(LEAST, TIMES q) words, and cannot be extended."""
    n = len(ids)
    text_end = np.repeat(np.cumsum(counts), counts)
    ids = ids.astype(np.int64, copy=False)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # where equal stretches begin and end, and their lag
    longest = int(counts.max(initial=0)) // TIMES
    for q in range(1, min(short, longest) + 1):
        same = (ids[:-q] == ids[q:]) & (text_end[:-q] == text_end[q:])
        begin, end = _stretches(same, max(LEAST, TIMES * q) - q)
        found.append((begin, end, np.full(len(begin), q)))
    name, size, scale = _mixed(ids.astype(np.uint64) * MIX[0] + MIX[0]), 1, short
    own = np.arange(n)
    while scale < longest:
        # only texts that can hold a run of this scale stay
        if (fit := counts > TIMES * scale).sum() < len(counts):
            keep = np.repeat(fit, counts)
            counts, name, own = counts[fit], name[keep], own[keep]
        while size < 2 * scale:
            moved = name[size:] * MIX[2]
            name[: len(moved)] = _mixed(name[: len(moved)] * MIX[0] + (moved ^ (moved >> np.uint64(29))))
            size *= 2
        last = np.repeat(np.cumsum(counts), counts)
        inside = np.arange(len(own)) + 2 * scale <= last  # places with a whole context
        low = _window_least(np.where(inside, name, np.uint64(2**64 - 1)), scale)
        # a place is chosen if its hash is the least of a window that holds it
        best = low.copy()
        have = 1
        while have < scale:
            step = min(have, scale - have)
            np.maximum(best[step:], best[:-step].copy(), out=best[step:])
            have += step
        chosen = np.flatnonzero(inside & (name == best))
        seq = np.lexsort((chosen, name[chosen], last[chosen]))
        p = chosen[seq]
        gap = np.diff(p)
        pair = np.flatnonzero((name[p[1:]] == name[p[:-1]]) & (last[p[1:]] == last[p[:-1]]) & (gap > scale) & (gap <= 2 * scale))
        if len(pair):
            found.append(_grown(ids, own[p[pair]], gap[pair], 2 * scale, text_end))
        scale *= 2
    return _runs(ids, found)


def _grown(ids: np.ndarray, at: np.ndarray, lag: np.ndarray, context: int, text_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches around seeds, extended both ways; seeds of a lag whose contexts touch are one."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    first = np.append(True, (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + context))
    last = np.append(first[1:], True)
    left, right, lag = at[first], at[last], lag[first]
    end = text_end[left] - lag
    begin_of = np.append(0, np.unique(text_end))
    begin = begin_of[np.searchsorted(begin_of, left, "right") - 1]
    whole = left + _extended(ids, left, lag, np.minimum(right + context, end), 1) >= np.minimum(right + context, end)
    left, right, lag, end, begin = left[whole], right[whole], lag[whole], end[whole], begin[whole]
    right = np.minimum(right + context, end)
    right += _extended(ids, right, lag, end, 1)
    left -= _extended(ids, left, lag, begin, -1)
    keep = right - left >= (TIMES - 1) * lag
    return left[keep], right[keep], lag[keep]


def _runs(ids: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches as runs, each once, without those of a smaller period."""
    begin, end, lag = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    order = np.lexsort((lag, begin))
    begin, end, lag = begin[order], end[order], lag[order]
    keep = np.append(True, (begin[1:] != begin[:-1]) | (lag[1:] != lag[:-1]))[: len(begin)]
    for i in np.flatnonzero(keep & (lag > 1)).tolist():
        a, q = begin[i], int(lag[i])
        keep[i] = not any(np.array_equal(ids[a : a + q], ids[a + q // r : a + q // r + q]) for r in _primes_of(q))
    begin, end, lag = begin[keep], end[keep], lag[keep]
    return begin, end - begin + lag, lag


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between white space of each text, laid end to end, and how many each has; null counts as empty."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    at = split.offsets.to_numpy() - split.offsets[0].as_py()
    words = split.flatten()
    filled = pc.not_equal(words, "")
    return words.filter(filled), np.diff(np.append(0, np.cumsum(filled.to_numpy(zero_copy_only=False)))[at])


def _digest(rows: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256("".join([f"{s},{n},{q}\n" for s, n, q in rows]).encode()).hexdigest()


def _strongest(rows: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period; of equal ones the first, then of the smallest period."""
    best = rows[0]
    for r in rows[1:]:  # they come by start, then period
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _searched(texts: pa.Array, source: Callable[[np.ndarray], np.ndarray] | None) -> list[list]:
    """Columns of results for texts searched at once."""
    words, counts = words_of(texts)
    at = offsets(counts)
    coded = words.dictionary_encode()
    ids, names = coded.indices.to_numpy(), coded.dictionary
    if source is not None:
        ids = ids[source(counts)]
    start, length, period = find_runs(ids, counts)
    of = np.searchsorted(at, start, "right") - 1
    start = start - at[of]
    # words of a run after its first period are dropped
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, at[of] + start + period, 1)
    np.add.at(change, at[of] + start + length, -1)
    stays = np.cumsum(change)[:-1] == 0
    kept = offsets(np.append(0, np.cumsum(stays))[at[1:]] - np.append(0, np.cumsum(stays))[at[:-1]])
    lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), names.take(pa.array(ids[stays])))
    collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
    runs: list[list] = [[] for _ in range(len(counts))]
    for i, row in zip(of.tolist(), zip(start.tolist(), length.tolist(), period.tolist(), strict=True), strict=True):
        runs[i].append(row)
    best = [_strongest(r) if r else (None, None, None) for r in runs]
    return [
        [len(r) for r in runs], [b[0] for b in best], [b[1] for b in best], [b[2] for b in best], [None if b[0] is None else 1000 * b[1] // b[2] for b in best],
        [_digest(r) for r in runs], [hashlib.sha256(c.as_buffer()).hexdigest() for c in collapsed], collapsed, runs,
    ]


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, with_texts: bool = False, source: Callable | None = None) -> DataFrame:
    """Runs of every row of (doc_id, text): their number, the strongest, and digests of all runs and of the collapsed text.

    The collapsed text keeps of each run the first period's words, joined by one blank.
    ``with_texts`` adds it as ``collapsed``, and ``runs``, an array of (start, length, period).  ``source``
    (doc_ids, counts of words) may give for each word of a batch the place of the word that stands for it.

    Null and empty texts have no words and no runs; null and repeated doc_ids and repeated
    rows are rows like others; other columns are ignored; an empty table gives no rows."""
    schema = DIGESTS + (", collapsed string, runs array<struct<start: long, length: long, period: long>>" if with_texts else "")
    names = [c.split(" ")[0] for c in DIGESTS.split(", ")] + (["collapsed", "runs"] if with_texts else [])
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches):
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cut = np.unique(np.searchsorted(size, np.arange(0, int(size[-1]) + CHUNK_BYTES, CHUNK_BYTES))) if len(size) else []
            for a, z in zip([0, *cut], [*cut, len(texts)], strict=True):
                if a == z:
                    continue
                own = keys.slice(a, z - a)
                found = _searched(texts.slice(a, z - a), None if source is None else lambda counts, own=own: source(own.to_pylist(), counts))
                columns = [own, *[pa.array(c, t) for c, t in zip(found, kinds, strict=False)]]
                if with_texts:
                    runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rows] for rows in found[8]]
                    columns += [pa.array(found[7].to_pylist(), pa.string()), pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _planted(keys: list, counts: np.ndarray) -> np.ndarray:
    """The query's rule: of a tenth of the documents, words from a place on repeat the words there (a null id has no number, so none)."""
    at = offsets(counts)
    out = np.arange(int(at[-1]))
    for i, key in enumerate(keys):
        n = int(counts[i])
        h = None if key is None else zlib.crc32(str(key).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[at[i] + a : at[i + 1]] = at[i] + a + np.arange(n - a) % p
    return out


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every row of ``documents``, with the repeats that the query's rule puts into a tenth of them."""
    return periodic_runs(table(spark, sf_dir, "documents"), source=_planted)
