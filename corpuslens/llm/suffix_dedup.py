"""Removal of repeated passages by a sparse, distributed suffix array.

A byte is removed if some string of ``length`` bytes that covers it also starts in a
document with a smaller doc_id.  Not every suffix has to be sorted for that:

1. Anchors.  Each window of ``length`` bytes is represented by the gram in it with the
   smallest hash, a choice that depends on the window's bytes alone, so equal windows
   have equal anchors at equal offsets.  Some six in a hundred positions are anchors.
2. Grams that occur in one document only are set aside; only hashes travel for that.
   Of a gram that a task meets in several documents only two are sent to the others; the
   rest are known to be shared, so a gram that every document holds is no hot key.
3. The suffixes at the other anchors (the bytes a window can reach from its anchor, to
   the right and then to the left) are sorted within a bucket of documents, front-coded
   as runs, and exchanged by gram.
4. Each receiver merges its runs with a loser tree.  Every contender carries the length
   of the prefix it is known to share with the last winner, so bytes known to be equal
   are never compared again.  Equal neighbours settle whole anchors; where suffixes
   differ only beyond a window, the windows themselves are compared.
5. The findings go back to the buckets, where spans are joined and cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.store import release, settle, table

LENGTH, GRAM = 50, 16
#: Bytes of text whose anchors are found at once, and anchors held before they are sent.
CHUNK_BYTES, HELD_ANCHORS = 1 << 20, 2_000_000
#: Bytes of text for each bucket of documents, for each of the first receivers of suffixes
#: (a bucket sends a row to each receiver, so there are not too many), and for further ones.
BUCKET_BYTES, RECEIVER_BYTES, RECEIVERS, FURTHER_BYTES = 24 << 20, 4 << 20, 4096, 64 << 20

#: Odd multipliers of the mixing function.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def squeeze(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(bytes(x) if isinstance(x, (bytes, memoryview)) else np.ascontiguousarray(x).tobytes())


def expand(x: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return raw if kind is None else np.frombuffer(raw, kind)


def delta(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=x.dtype.type(0)))


def undelta(x: bytes, kind) -> np.ndarray:
    return np.cumsum(expand(x, kind), dtype=kind)


def six(x: np.ndarray) -> bytes:
    """The low 48 bits of each value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def bucket_of(doc_ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((doc_ids.view(np.uint64) * MIX[0]) >> np.uint64(33)).astype(np.int64) % buckets


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors and 48-bit hashes of their grams, over texts laid end to end."""
    n, span = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = np.ndarray((n - 7,), "<u8", buffer=data, strides=(1,))
    m = n - gram + 1
    mixed = words[:m] * MIX[0]
    mixed ^= mixed >> np.uint64(29)
    mixed += words[gram - 8 : gram - 8 + m] * MIX[1]
    mixed ^= mixed >> np.uint64(32)
    mixed *= MIX[2]
    order = np.maximum((mixed >> np.uint64(32)).astype(np.uint32), 1)
    least = sliding(order, span, np.minimum)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        least[max(a, b - length + 1) : b] = 0  # windows that would leave their text
    reach = sliding(np.pad(least, span - 1), span, np.maximum)
    at = np.flatnonzero(reach == order)
    return at, ((mixed[at] ^ (mixed[at] >> np.uint64(31))) * MIX[3]) >> np.uint64(16)


def text_chunks(sizes: np.ndarray):
    """Ranges of rows of about CHUNK_BYTES."""
    i = 0
    ends = np.cumsum(sizes)
    while i < len(sizes):
        before = ends[i] - sizes[i]
        j = max(i + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
        yield i, j
        i = j


def gram_rows(ranges: int, buckets: int):
    """Anchors of texts as rows (r, docs, sizes, grams), each with its runs of documents.

    r is a range of the hash; or, for grams known to be shared, ranges + a bucket of documents."""

    def send(docs, grams):
        doc, h = np.concatenate(docs), np.concatenate(grams)
        r = (((h >> np.uint64(16)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(h)
        new = np.flatnonzero(np.append(True, np.diff(h[order]) != 0))
        times = np.diff(np.append(new, len(h)))
        low, high = (np.repeat(pick.reduceat(doc[order], new), times) for pick in (np.minimum, np.maximum))
        settled = order[(low < doc[order]) & (doc[order] < high)]
        r[settled] = ranges + bucket_of(doc[settled], buckets)
        order = np.argsort(r, kind="stable")
        doc, h, r = doc[order], h[order], r[order]
        cuts = np.append(np.flatnonzero(np.diff(r, prepend=-1)), len(r))
        out = [[], [], [], []]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            new = np.flatnonzero(np.diff(doc[a:b], prepend=~doc[a]))
            for column, x in zip(out, (int(r[a]), delta(doc[a:b][new]), squeeze(np.diff(np.append(new, b - a)).astype(np.uint32)), six(h[a:b])), strict=True):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["r", "docs", "sizes", "grams"])

    def run(batches):
        docs, grams, held = [], [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0))
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            for i, j in text_chunks(sizes):
                data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
                offsets = np.append(0, np.cumsum(sizes[i:j]))
                at, h = anchors(data, offsets)
                docs.append(ids[i:j][np.searchsorted(offsets, at, "right") - 1])
                grams.append(h)
                held += len(at)
                if held >= HELD_ANCHORS:
                    yield send(docs, grams)
                    docs, grams, held = [], [], 0
        if held:
            yield send(docs, grams)

    return run


def shared_grams(ranges: int, buckets: int):
    """Of one range of hashes: (document, gram) pairs whose gram is in several documents, by bucket.

    Pairs known to be so pass through."""

    def run(rows: pa.Table) -> pa.Table:
        docs, grams = [], []
        for d, s, g in zip(rows["docs"], rows["sizes"], rows["grams"], strict=True):
            docs.append(np.repeat(undelta(d.as_py(), np.int64), expand(s.as_py(), np.uint32)))
            grams.append(unsix(g.as_py()))
        doc, h = np.concatenate(docs), np.concatenate(grams)
        if rows["r"][0].as_py() < ranges:
            order = np.argsort(h)
            doc, h = doc[order], h[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            several = np.minimum.reduceat(doc, new) < np.maximum.reduceat(doc, new)
            keep = np.repeat(several, np.diff(np.append(new, len(h))))
            doc, h = doc[keep], h[keep]
        b = bucket_of(doc, buckets)
        order = np.lexsort((h, doc, b))
        doc, h, b = doc[order], h[order], b[order]
        cuts = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b))
        pairs = list(zip(cuts[:-1], cuts[1:], strict=True)) if len(b) else []
        return pa.table(
            {
                "bucket": pa.array([int(b[i]) for i, _ in pairs], pa.int32()),
                "docs": pa.array([delta(doc[i:j]) for i, j in pairs], pa.binary()),
                "grams": pa.array([six(h[i:j]) for i, j in pairs], pa.binary()),
            }
        )

    return run


def packed_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts as they travel: bucket, doc_id, mark (a hash of the text), body (compressed)."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            body = [squeeze((t or "").encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket_of(ids, buckets), pa.int32()), batch.column(0), batch.column(1), pa.array(body, pa.binary())], ["bucket", "doc_id", "mark", "body"]
            )

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "bucket int, doc_id long, mark long, body binary")


def front_coded(strings: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Sorted byte strings (rows): what each shares with the one before, and the rest of all."""
    width = strings.shape[1]
    differ = np.ones((len(strings), width), bool)
    differ[1:] = strings[1:] != strings[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), width)
    shared[0] = 0
    rest = strings[np.arange(width) >= shared[:, None]]
    return shared.astype(np.uint8), rest.tobytes()


def decode_run(shared: np.ndarray, rest: bytes, width: int) -> list[bytes]:
    out, at, last = [], 0, b""
    for s in shared.tolist():
        last = last[:s] + rest[at : at + width - s]
        at += width - s
        out.append(last)
    return out


def loser_merge(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs: the run each output comes from, and the prefix it shares with the output before.

    ``shared[r][i]`` is what string i of run r shares with string i-1."""
    k = len(runs)
    if k == 1:
        return [0] * len(runs[0]), shared[0]
    current = [r[0] for r in runs]
    at = [0] * k
    size = [len(r) for r in runs]
    tree, known = [0] * k, [0] * k

    def lower(a: int, b: int, same: int) -> tuple[bool, int]:
        """Whether a goes before b, which share ``same`` bytes at least, and what they share."""
        x, y = current[a][same:], current[b][same:]
        if x == y:
            return a < b, same + len(x)
        if x[0] != y[0]:
            return x < y, same
        differ = int.from_bytes(x) ^ int.from_bytes(y)
        return x < y, same + len(x) - 1 - (differ.bit_length() - 1) // 8

    winners = [0] * (2 * k)
    for i in range(k):
        winners[k + i] = i
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        first, same = lower(a, b, 0)
        winners[node], tree[node], known[node] = (a, b, same) if first else (b, a, same)
    win, same = winners[1], 0
    out, common = [], []
    # an exhausted run shares -1 bytes, so that any other goes before it
    for _ in range(sum(size)):
        out.append(win)
        common.append(same)
        at[win] += 1
        if at[win] < size[win]:
            current[win] = runs[win][at[win]]
            same = shared[win][at[win]]
        else:
            same = -1
        node = (k + win) >> 1
        while node:
            other = known[node]
            if other > same:
                tree[node], win = win, tree[node]
                known[node], same = same, other
            elif other == same and same >= 0:
                rival = tree[node]
                first, both = lower(win, rival, same)
                known[node] = both
                if not first:
                    tree[node], win = win, rival
            node >>= 1
    return out, common


def own_anchors(docs: pa.Table, wanted: pa.Table, length: int, gram: int):
    """Anchors of a bucket's documents whose grams are wanted, chunk by chunk.

    Yields the suffix strings (right part, left part backwards, both padded, then their
    sizes), and row, position and gram of each."""
    rows = sorted(range(docs.num_rows), key=lambda i: docs["doc_id"][i].as_py())
    ids = np.asarray(docs["doc_id"])[rows]
    if wanted.num_rows:
        want_doc = np.concatenate([undelta(x.as_py(), np.int64) for x in wanted["docs"]])
        want_gram = np.concatenate([unsix(x.as_py()) for x in wanted["grams"]])
    else:
        want_doc, want_gram = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    order = np.lexsort((want_gram, want_doc))
    want_doc, want_gram = want_doc[order], want_gram[order]
    begin, end = np.searchsorted(want_doc, ids, "left"), np.searchsorted(want_doc, ids, "right")
    texts, held = [], []

    def cut():
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.append(0, np.cumsum([len(t) for t in texts]))
        at, h = anchors(data, offsets, length, gram)
        local = np.searchsorted(offsets, at, "right") - 1
        keep = np.zeros(len(at), bool)
        for k, i in enumerate(held):
            a, b = np.searchsorted(local, (k, k + 1))
            keep[a:b] = np.isin(h[a:b], want_gram[begin[i] : end[i]])
        at, h, local = at[keep], h[keep], local[keep]
        left, right = length - gram, length
        n_left = np.minimum(at - offsets[local], left)
        n_right = np.minimum(offsets[local + 1] - at, right)
        padded = np.pad(data, (left, right))
        strings = np.zeros((len(at), left + right + 2), np.uint8)
        strings[:, :right] = padded[at[:, None] + left + np.arange(right)]
        strings[:, right : right + left] = padded[at[:, None] + left - 1 - np.arange(left)]
        strings[:, :right][np.arange(right) >= n_right[:, None]] = 0
        strings[:, right : right + left][np.arange(left) >= n_left[:, None]] = 0
        strings[:, -2], strings[:, -1] = n_left, n_right
        return strings, np.array(rows)[np.array(held)[local]], at - offsets[local], h

    size = 0
    for i, row in enumerate(rows):
        if begin[i] == end[i]:
            continue
        texts.append(expand(docs["body"][row].as_py()))
        held.append(i)
        size += len(texts[-1])
        if size >= CHUNK_BYTES:
            yield cut()
            texts, held, size = [], [], 0
    if texts:
        yield cut()


def suffix_runs(receivers: int, length: int, gram: int):
    """A bucket's sorted runs by receiver, and one row (behind) that says who stands behind each string.

    Of equal strings in the bucket only the smallest document's is sent; the others are
    settled (string number -1)."""

    def run(key, docs: pa.Table, wanted: pa.Table) -> pa.Table:
        parts = list(own_anchors(docs, wanted, length, gram))
        schema = pa.schema([("receiver", pa.int32()), ("behind", pa.bool_()), ("bucket", pa.int32()), ("first", pa.int64()), ("shared", pa.binary()), ("rest", pa.binary()), ("docs", pa.binary())])
        if not parts or not sum(len(p[0]) for p in parts):
            return pa.Table.from_pylist([], schema)
        strings, row, pos, h = (np.concatenate([p[i] for p in parts]) for i in range(4))
        width = strings.shape[1]
        to = (((h >> np.uint64(8)) * MIX[1]) >> np.uint64(33)).astype(np.int64) % receivers
        ids, marks = np.asarray(docs["doc_id"]), np.asarray(docs["mark"])
        doc = ids[row]
        flat = np.ascontiguousarray(strings).view(f"S{width}").ravel()
        order = np.lexsort((doc, flat, to))
        strings, row, pos, to, doc = strings[order], row[order], pos[order], to[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (strings[1:] != strings[:-1]).any(1) | (to[1:] != to[:-1])
        number = np.cumsum(new) - 1
        leader = doc[new]
        settled = doc > leader[number]
        out = [
            {
                "receiver": key[0].as_py() % receivers, "behind": True, "bucket": key[0].as_py(), "first": 0,
                "shared": squeeze(np.where(settled, -1, number).astype(np.int32)),
                "rest": squeeze(pos.astype(np.uint32)),
                "docs": squeeze(np.stack([doc, marks[row]])),
            }
        ]
        strings, to = strings[new], to[new]
        cuts = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            shared, rest = front_coded(strings[a:b])
            out.append({"receiver": int(to[a]), "behind": False, "bucket": key[0].as_py(), "first": a, "shared": squeeze(shared), "rest": squeeze(rest), "docs": squeeze(leader[a:b])})
        return pa.Table.from_pylist(out, schema)

    return run


def window_hashes(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row of bytes."""
    n = windows.shape[1]
    loads = [np.ascontiguousarray(windows[:, min(i, n - 8) : min(i, n - 8) + 8]).view("<u8").ravel() for i in range(0, n, 8)]
    out = []
    for one, two in ((MIX[0], MIX[1]), (MIX[3], MIX[2])):
        h = np.full(len(windows), one)
        for x in loads:
            h = (h ^ x) * two
            h ^= h >> np.uint64(29)
            h = h * one
            h ^= h >> np.uint64(32)
        out.append(h)
    return out[0], out[1]


def merge_runs(length: int, gram: int):
    """Merge a receiver's runs: per bucket, strings found in a smaller document, and single windows that are.

    Rows that say who stands behind the strings pass through."""
    left, right = length - gram, length
    width = left + right + 2
    schema = pa.schema([("bucket", pa.int32()), ("behind", pa.bool_()), ("number", pa.binary()), ("back", pa.binary()), ("docs", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        through = rows.filter(rows["behind"])
        passed = pa.table([through["bucket"], through["behind"], through["shared"], through["rest"], through["docs"]], schema=schema)
        rows = rows.filter(pc.invert(rows["behind"]))
        if not rows.num_rows:
            return passed
        shared = [expand(x.as_py(), np.uint8) for x in rows["shared"]]
        runs = [decode_run(s, expand(x.as_py()), width) for s, x in zip(shared, rows["rest"], strict=True)]
        merged, common = loser_merge(runs, [s.tolist() for s in shared])
        source = np.array(merged)
        # the i-th output of a run is its i-th string
        order = np.argsort(np.argsort(source, kind="stable"), kind="stable")
        size = np.array([len(r) for r in runs])
        flat = lambda parts: np.concatenate(parts)[order]
        strings = np.frombuffer(b"".join(b"".join(r) for r in runs), np.uint8).reshape(-1, width)[order]
        doc = flat([expand(x.as_py(), np.int64) for x in rows["docs"]])
        number = flat([np.arange(n) + f.as_py() for n, f in zip(size, rows["first"], strict=True)])
        bucket = np.asarray(rows["bucket"])[source]
        common = np.array(common)
        new = np.flatnonzero(common < width)
        least = np.minimum.reduceat(doc, new)
        group = np.cumsum(common < width) - 1
        whole = doc > least[group]
        # strings that stay: windows they may share with their neighbours in order
        near = np.append(common[new], 0)
        near = np.minimum(np.maximum(near[:-1], near[1:]), right)[group]
        n_left, n_right = strings[:, -2].astype(int), strings[:, -1].astype(int)
        low, high = np.maximum(right - near, right - n_right), np.minimum(left, n_left)
        stay = np.flatnonzero(~whole & (low <= high))
        natural = np.concatenate([strings[stay][:, right : right + left][:, ::-1], strings[stay][:, :right]], axis=1)
        found = [(bucket[whole], number[whole], np.full(int(whole.sum()), -1))]
        for back in range(left + 1):
            own = (low[stay] <= back) & (back <= high[stay])
            if not own.any():
                continue
            one, two = window_hashes(natural[own][:, left - back : left - back + length])
            who = stay[own]
            order = np.lexsort((two, one))
            first = np.flatnonzero(np.append(True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)))
            smallest = np.repeat(np.minimum.reduceat(doc[who][order], first), np.diff(np.append(first, len(order))))
            hit = who[order][doc[who][order] > smallest]
            found.append((bucket[hit], number[hit], np.full(len(hit), back)))
        b, e, a = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.argsort(b, kind="stable")
        b, e, a = b[order], e[order], a[order]
        cuts = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b))
        pairs = list(zip(cuts[:-1], cuts[1:], strict=True)) if len(b) else []
        columns = [
            pa.array([int(b[i]) for i, _ in pairs], pa.int32()),
            pa.array([False] * len(pairs), pa.bool_()),
            pa.array([squeeze(e[i:j].astype(np.int32)) for i, j in pairs], pa.binary()),
            pa.array([squeeze(a[i:j].astype(np.int8)) for i, j in pairs], pa.binary()),
            pa.array([b""] * len(pairs), pa.binary()),
        ]
        return pa.concat_tables([passed, pa.table(columns, schema=schema)])

    return run


def cut_out(length: int, gram: int, with_text: bool):
    """Join a bucket's findings to its documents and remove what they cover."""
    left, right = length - gram, length

    def run(key, docs: pa.Table, found: pa.Table) -> pa.Table:
        spans: dict[tuple[int, int], list] = {}
        behind = [i for i in range(found.num_rows) if found["behind"][i].as_py()]
        if behind:
            i = behind[0]
            number = expand(found["number"][i].as_py(), np.int32)
            pos = expand(found["back"][i].as_py(), np.uint32).astype(np.int64)
            doc, mark = expand(found["docs"][i].as_py(), np.int64).reshape(2, -1)
            others = [j for j in range(found.num_rows) if not found["behind"][j].as_py()]
            e = np.concatenate([np.zeros(0, np.int32), *(expand(found["number"][j].as_py(), np.int32) for j in others)])
            a = np.concatenate([np.zeros(0, np.int8), *(expand(found["back"][j].as_py(), np.int8) for j in others)]).astype(np.int64)
            whole = (number < 0) | np.isin(number, e[a < 0])
            start, stop = [pos[whole] - left], [pos[whole] + right]
            who = [np.flatnonzero(whole)]
            # anchors behind a string, then each single window of it
            order = np.argsort(number, kind="stable")
            e, a = e[a >= 0], a[a >= 0]
            low, high = np.searchsorted(number[order], e, "left"), np.searchsorted(number[order], e, "right")
            times = high - low
            member = order[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())] if len(e) else np.zeros(0, np.int64)
            begin = pos[member] - np.repeat(a, times)
            who, start, stop = np.concatenate([*who, member]), np.concatenate([*start, begin]), np.concatenate([*stop, begin + length])
            order = np.lexsort((start, mark[who], doc[who]))
            who, start, stop = who[order], start[order], stop[order]
            change = np.flatnonzero(np.append(True, (np.diff(doc[who]) != 0) | (np.diff(mark[who]) != 0))) if len(who) else np.zeros(0, np.int64)
            for x, y in zip(change, np.append(change[1:], len(who))[: len(change)], strict=True):
                spans[int(doc[who[x]]), int(mark[who[x]])] = [start[x:y], stop[x:y]]
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for i in range(docs.num_rows):
            body = expand(docs["body"][i].as_py())
            ident, mark_ = docs["doc_id"][i].as_py(), docs["mark"][i].as_py()
            n, removed, runs = len(body), 0, 0
            if (ident, mark_) in spans:
                start, stop = spans[ident, mark_]
                start, stop = np.maximum(start, 0), np.minimum(stop, n)
                end = np.maximum.accumulate(stop)
                head = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
                a, b = start[head].tolist(), end[np.append(head[1:] - 1, len(end) - 1)].tolist()
                removed, runs = sum(b) - sum(a), len(a)
                body = b"".join(body[x:y] for x, y in zip([0, *b], [*a, n], strict=True))
            for k, v in zip(out, (ident, n, removed, runs, hashlib.sha256(body).hexdigest(), body if with_text else None), strict=True):
                out[k].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) of every row.

    Strings are judged on the input; matches never cross documents.  A null text counts
    as empty; texts shorter than ``length`` bytes lose nothing.  Rows that repeat a
    doc_id are judged one by one, and neither is smaller than the other; rows with a
    null doc_id lose nothing and take nothing from others.  Other columns, whatever their
    names, are ignored; an empty table gives no rows.

    Buckets of documents and receivers of suffixes are as many as the measured bytes of
    text ask for, so what a task holds at once does not grow with the table.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.filter(F.col("doc_id").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * parts, size // BUCKET_BYTES)
    receivers = max(parts, min(size // RECEIVER_BYTES, RECEIVERS), size // FURTHER_BYTES)
    grams = known.mapInArrow(gram_rows(receivers, buckets), "r int, docs binary, sizes binary, grams binary")
    wanted = grams.groupBy("r").applyInArrow(shared_grams(receivers, buckets), "bucket int, docs binary, grams binary")
    packed = packed_texts(known, buckets)
    runs = packed.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(
        suffix_runs(receivers, length, gram), "receiver int, behind boolean, bucket int, first long, shared binary, rest binary, docs binary"
    )
    found = settle(
        runs.groupBy("receiver").applyInArrow(merge_runs(length, gram), "bucket int, behind boolean, number binary, back binary, docs binary"), "suffix-hits"
    )
    release(spark)  # what was exchanged so far is of no further use
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = packed.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(cut_out(length, gram, with_text), schema)
    body = F.encode("text", "UTF-8")
    loose = rows.filter(F.col("doc_id").isNull()).select(
        "doc_id", F.length(body).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(body, 256).alias("kept_sha256"), body.alias("kept"),
    )
    out = out.unionByName(loose)
    return out if with_text else out.drop("kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings cut out of every row of ``documents``."""
    return remove_repeats(table(spark, sf_dir, "documents"))
