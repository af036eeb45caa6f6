"""SentencePiece encoding and decoding with sampled segmentations.

The lattice of a text has the places between its characters as nodes and every piece of the
vocabulary that spells the characters between two nodes as an edge.  Characters without a
piece are spelt by their byte pieces.  A place that no piece reaches over is on every path,
so the lattice is a chain of segments between such places; every blank begins a new word,
and the lattices of words met before are kept.  Each path decodes to the same text.  A
path's weight is the product over its pieces of split * exp(alpha * score / vocabulary
size); backward sums of the weights give the probability of each edge at its node.

Segmentations are drawn without replacement by the Gumbel top-k trick.  Every path has its
log-probability plus a Gumbel number; a perturbed A* search finds the k largest without
listing paths: the search tree's node is a prefix, the largest number below a node is a
Gumbel number at the node's log-mass, and siblings of the best path are drawn truncated at
their parent's number.  The siblings of one step stay one frontier entry until it is the
best.  A sample's inclusion score is the probability that its number exceeds that of the
first path left out.

The search runs on many texts at once in arrays; random numbers are hashes of the row's key
and a counter, and sums are taken in whole numbers, so a row's samples do not depend on the
rows beside it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.arrays import offsets, spread
from corpuslens.llm.store import table

SAMPLES, SPLIT, ALPHA, SEED = 3, 0.1, 4.0, 20
#: Edges of word lattices kept by a worker; when more, the cache starts anew.
CACHE_EDGES = 6_000_000
#: Characters of text searched at once (one longer text is searched alone).
CHUNK_CHARS = 400_000
BLANK, ALONE = "▁", 0xF0000
#: Log-probabilities are whole multiples of UNIT, choices among edges of 2**-SHARE.
UNIT, SHARE = 2.0**-32, 40
SCHEMA = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, decoded_crc32 long"
#: Odd multipliers of the counter-based random numbers.
STEP, ONE, TWO = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 random-looking bits of each counter."""
    x = x ^ (x >> np.uint64(30))
    x *= ONE
    x ^= x >> np.uint64(27)
    x *= TWO
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each counter."""
    return ((mixed(x) >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52


def gumbel(x: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(uniform(x)))


def truncated(loc: np.ndarray, top: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Gumbel numbers at ``loc``, given that they are below ``top``."""
    return -np.logaddexp(-top, -(loc + gumbel(counter)))


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind, room: int = 1024):
        self.held, self.size = np.zeros(room, kind), 0  # pages never written take no memory

    def append(self, x: np.ndarray) -> None:
        need = self.size + len(x)
        if need > len(self.held):
            self.held = np.append(self.held[: self.size], np.zeros(max(need, 2 * self.size) - self.size, self.held.dtype))
        self.held[self.size : need] = x
        self.size = need


class Path:
    """One path of each text: steps of all texts one after another, ``at`` says where a text's begin.

    ``before`` is the sum of log-probabilities (in units) before a step, ``number`` the
    largest number among the paths that leave this one at the step."""

    def __init__(self, has, node, edge, slot, at):
        self.has, self.node, self.edge, self.slot, self.at = has, node, edge, slot, at
        self.before = self.number = self.total = self.top = None


class WordLattice:
    """Lattices of all words met so far, laid out for array look-ups; bounded in size.

    Nodes are the places of all words.  ``start[v]`` to ``start[v + 1]`` are the edges out
    of node v; ``piece``, ``to`` (-1: the segment's end), ``logq`` and ``cum`` are an edge's
    piece, next node, log-probability in units, and cumulative probability at its node."""

    def __init__(self, path: str, split: float = SPLIT, alpha: float = ALPHA, cache_edges: int = CACHE_EDGES):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        plain = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(n)]
        self.ids = {name: i for i, name in enumerate(names) if plain[i]}
        if any(BLANK in name.lstrip(BLANK) for name in self.ids):
            raise ValueError("pieces reach over words")
        if missing := {c for name in self.ids for c in name} - set(self.ids):
            raise ValueError(f"characters of longer pieces have none of their own: {sorted(missing)[:9]}")
        # scores of pieces for blanks alone may be far below the others
        self.weight = np.array([float(np.log(split) + alpha * max(m.get_score(i) / n, -1.0)) for i in range(n)])
        byte = {int(names[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        #: What each piece decodes to.
        self.surface = [name.replace(BLANK, " ").encode() if plain[i] else b"" for i, name in enumerate(names)]
        for b, i in byte.items():
            self.surface[i] = bytes([b])
        self.bytes_of = {b: chr(ALONE + byte.get(b, m.unk_id())) for b in range(256)}
        # pieces that stand alone are single characters of a private plane
        self._trie(self.ids | {chr(ALONE + i): i for i in [*byte.values(), m.unk_id()]})
        self.surface_size = np.fromiter(map(len, self.surface), np.int64, n)
        self.surface_at, self.surface_all = np.cumsum(self.surface_size) - self.surface_size, np.frombuffer(b"".join(self.surface), np.uint8)
        self.cache_edges = cache_edges
        self.clear()

    def _trie(self, spelt: dict[str, int]) -> None:
        """All prefixes of pieces as numbered nodes with a sorted table of (node, character) steps."""
        chars = {c: i for i, c in enumerate(sorted({c for s in spelt for c in s}), 1)}
        self.chars = len(chars) + 1
        self.char = np.zeros(0x110000, np.int64)
        for c, i in chars.items():
            self.char[ord(c)] = i
        self.char[ord(" ")] = chars[BLANK]
        nodes = {"": 0}
        for s in sorted(spelt):
            for k in range(1, len(s) + 1):
                nodes.setdefault(s[:k], len(nodes))
        self.spells = np.full(len(nodes), -1, np.int32)
        for s, i in spelt.items():
            self.spells[nodes[s]] = i
        self.root = np.array([nodes.get(c, -1) for c in ("", *chars)])
        steps = sorted((nodes[s[:-1]] * self.chars + chars[s[-1]], v) for s, v in nodes.items() if s)
        self.step_key, self.step_to = np.array([k for k, _ in steps]), np.array([v for _, v in steps])

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.nodes = 0
        self.start, self.piece, self.to, self.logq, self.cum = (Grown(t, 5 * self.cache_edges // 4) for t in (np.int64, np.int32, np.int32, np.int64, np.float32))
        self.segment, self.first = Grown(np.int64), Grown(np.int64)  # nodes where segments begin; first segment of each word

    def _trace(self, cps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, piece, length) of every piece found in words laid end to end, by place, longest first."""
        own = self.char[cps]
        at, state, size = np.arange(len(cps)), self.root[own], 1
        found = []
        while len(at):
            piece = self.spells[state]
            whole = piece >= 0
            found.append((at[whole], piece[whole], size))
            more = np.flatnonzero(at + size < ends[at])
            at = at[more]
            key = state[more] * self.chars + own[at + size]
            step = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
            hit = np.flatnonzero(self.step_key[step] == key)
            at, state, size = at[hit], self.step_to[step[hit]], size + 1
        counts = np.zeros(len(cps), np.int64)
        for at, _, _ in found:
            counts[at] += 1
        after = np.cumsum(counts)  # filled from behind, as shorter pieces were found first
        piece, length = np.zeros(after[-1], np.int32), np.zeros(after[-1], np.int64)
        for at, own, size in found:
            after[at] -= 1
            piece[after[at]], length[after[at]] = own, size
        return np.repeat(np.arange(len(cps)), counts), piece, length

    @staticmethod
    def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))

    def spelt(self, text: str) -> str:
        """The text with bytes, as characters that stand alone, for characters without a piece."""
        return "".join([c if c in self.ids or c == " " else "".join([self.bytes_of[b] for b in c.encode()]) for c in text])

    def _add(self, words: list[bytes]) -> None:
        """File the lattices of new words."""
        texts = list(map(bytes.decode, words))
        cps, sizes = self._laid_out(texts)
        odd = np.flatnonzero(self.char[cps] == 0)
        if len(odd):
            for i in np.unique(np.searchsorted(np.cumsum(sizes), odd, "right")).tolist():
                texts[i] = self.spelt(texts[i])
            cps, sizes = self._laid_out(texts)
        n, word_at = len(cps), np.cumsum(sizes) - sizes
        place, piece, length = self._trace(cps, np.repeat(word_at + sizes, sizes))
        end = place + length
        over = np.cumsum(np.bincount(place + 1, minlength=n + 2) - np.bincount(end, minlength=n + 2))
        cut = over[: n + 1] == 0
        segment = np.flatnonzero(cut[:n])
        until = np.append(segment[1:], n)[np.cumsum(cut[:n]) - 1] - np.arange(n)  # characters to the segment's end
        # backward sums, by falling distance from the segments' ends
        order = np.argsort((until if n >= 1 << 16 and until.max() >= 1 << 16 else until.astype(np.uint16))[place], kind="stable")
        by, tail = place[order], end[order]
        own, ended = self.weight[piece[order]], cut[tail]
        new = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
        level = offsets(np.bincount(until[by[new]])[1:])
        mass, logp = np.zeros(n + 1), np.zeros(len(by))
        new_end = np.append(new[1:], len(by))
        for a, b in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            if a == b:
                continue
            lo, hi = new[a], new_end[b - 1]
            heads = new[a:b] - lo
            w = own[lo:hi] + np.where(ended[lo:hi], 0.0, mass[tail[lo:hi]])
            times = new_end[a:b] - new[a:b]
            high = np.maximum.reduceat(w, heads)
            total = high + np.log(np.add.reduceat(np.exp(w - np.repeat(high, times)), heads))
            mass[by[new[a:b]]] = total
            logp[lo:hi] = w - np.repeat(total, times)
        q = np.zeros(len(place), np.int64)
        q[order] = np.rint(logp / UNIT).astype(np.int64)
        counts = np.bincount(place, minlength=n)
        begin = np.cumsum(counts) - counts
        q[begin[counts == 1]] = 0
        p = np.exp(q * UNIT)
        run = np.cumsum(p)
        cum = run - np.repeat(run[begin] - p[begin], counts)
        cum[begin + counts - 1] = 2.0
        self.words |= zip(words, range(len(self.words), len(self.words) + len(words)))
        self.first.append(np.searchsorted(segment, word_at) + self.segment.size)
        self.segment.append(segment + self.nodes)
        self.start.append(begin + self.piece.size)
        self.to.append(np.where(cut[end], -1, end + self.nodes))
        self.piece.append(piece)
        self.logq.append(q)
        self.cum.append(cum)
        self.nodes += n

    def segments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First nodes of the segments of all texts, and how many each text has."""
        if self.piece.size > self.cache_edges:
            self.clear()
        # blanks are all escaped by the model's normaliser, so the sign can give way to one byte
        plain = [s.replace(BLANK, " ").encode() for s in map(self.model.normalize, texts)]
        size = np.fromiter(map(len, plain), np.int64, len(plain))
        data = np.frombuffer(b"".join(plain), np.uint8)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        blank = data == 0x20
        new = blank.copy()
        new[1:] &= ~blank[:-1]
        at = np.cumsum(size) - size
        new[at[size > 0]] = True
        cuts = np.flatnonzero(new)
        words = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        known = list(map(self.words.get, distinct))
        fresh = [w for w, k in zip(distinct, known, strict=True) if k is None]
        if fresh:
            self._add(fresh)  # they are numbered in this order
            after = iter(range(len(self.words) - len(fresh), len(self.words)))
            known = [next(after) if k is None else k for k in known]
        no = np.array(known, np.int64)[words.indices.to_numpy()]
        first = self.first.held[no]
        times = np.append(self.first.held[: self.first.size], self.segment.size)[no + 1] - first
        word, place = spread(times)
        per_text = np.add.reduceat(np.append(times, 0), np.minimum(np.searchsorted(cuts, at), len(times))) * (size > 0)
        return self.segment.held[first[word] + place], per_text

    def edges_from(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First edge of each node, and the number of its edges."""
        start = self.start.held
        return start[node], np.where(node + 1 < self.nodes, start[np.minimum(node + 1, self.nodes - 1)], self.piece.size) - start[node]

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Random paths from nodes to their segments' ends: (node, edge, place in ``node``) of all steps in order.

        ``key`` seeds the draws of each path."""
        start, cum, to = self.start.held, self.cum.held, self.to.held
        place, steps, taken = np.arange(len(node)), [], np.zeros(len(node), np.int64)
        while len(node):
            edge = start[node]
            u = uniform(key)
            left = np.flatnonzero(u >= cum[edge])
            while len(left):
                edge[left] += 1
                left = left[u[left] >= cum[edge[left]]]
            steps.append((node, edge, place))
            taken[place] += 1
            node = to[edge]
            go = np.flatnonzero(node >= 0)
            node, place, key = node[go].astype(np.int64), place[go], key[go] + STEP
        at = offsets(taken)
        out = [np.zeros(at[-1], np.int64) for _ in range(2)]
        for k, (v, e, i) in enumerate(steps):
            out[0][at[i] + k], out[1][at[i] + k] = v, e
        return out[0], out[1], np.repeat(np.arange(len(taken)), taken)

    def _settle(self, path: Path, fresh: np.ndarray, top: np.ndarray, key: np.ndarray) -> Path:
        """Sums before steps, and numbers of the siblings at a text's steps from ``fresh`` on."""
        counts = np.diff(path.at)
        text, step = spread(counts)
        q = self.logq.held[path.edge]
        run = np.cumsum(q)
        base = np.append(0, run)[path.at[:-1]]
        path.before = run - q - base[text]
        path.total, path.top = np.append(0, run)[path.at[1:]] - base, top
        path.number = np.full(len(q), -np.inf)
        own = np.flatnonzero((q < 0) & (step >= fresh[text]))
        path.number[own] = truncated(path.before[own] * UNIT + np.log(-np.expm1(q[own] * UNIT)), top[text[own]], key[text[own]] + step[own].astype(np.uint64) * STEP)
        return path

    @staticmethod
    def _largest(path: Path) -> tuple[np.ndarray, np.ndarray]:
        """The largest number of each text's path (-inf: none), and its step."""
        n = len(path.has)
        best, where = np.full(n, -np.inf), np.zeros(n, np.int64)
        full = np.flatnonzero(np.diff(path.at))
        if len(full):
            best[full] = np.maximum.reduceat(path.number, path.at[:-1][full])
            text = np.repeat(np.arange(n), np.diff(path.at))
            at = np.flatnonzero(path.number == best[text])
            hit, first = np.unique(text[at], return_index=True)
            where[hit] = at[first]
        return best, where

    def sample(self, root: np.ndarray, per_text: np.ndarray, key: np.ndarray, k: int) -> tuple[list[Path], np.ndarray]:
        """The k largest paths of each text, largest first, and the number of the first path left out (-inf: none)."""
        n = len(per_text)
        last = np.cumsum(per_text)
        text_of = np.repeat(np.arange(n), per_text)
        sub = lambda no: mixed(key + np.uint64(no * int(STEP) % (1 << 64)))  # noqa: E731  an independent key of each text

        def walked(node, slot, draw):
            steps, edge, place = self.walk(node, mixed(draw[text_of[slot]] + slot_no[slot]))
            return steps, edge, slot[place]

        slot_no = (np.arange(len(root)) - np.repeat(last - per_text, per_text)).astype(np.uint64) * TWO
        node, edge, slot = walked(root, np.arange(len(root)), sub(1))
        at = offsets(np.bincount(text_of[slot], minlength=n))
        paths = [self._settle(Path(np.ones(n, bool), node, edge, slot, at), np.zeros(n, np.int64), gumbel(sub(2)), sub(3))]
        parent, branch, chosen = np.full((k, n), -1), np.full((k, n), -1), np.full((k, n), -1)
        for r in range(1, k + 1):
            found = [self._largest(p) for p in paths]
            best = np.stack([f[0] for f in found])
            which = best.argmax(0)
            best = best[which, np.arange(n)]
            if r == k or not (best > -np.inf).any():
                break
            live = np.flatnonzero(best > -np.inf)
            which, top = which[live], best[live]
            where = np.stack([f[1] for f in found])[which, live]
            pick = lambda name: np.choose(which, [getattr(p, name)[np.where(which == f, where, 0)] if len(p.edge) else where * 0 for f, p in enumerate(paths)])  # noqa: B023, E731
            node_b, edge_b, slot_b, before_b = pick("node"), pick("edge"), pick("slot"), pick("before")
            # a sibling of all that was taken at this step, by its share
            low, times = self.edges_from(node_b)
            group, place = spread(times)
            sibling = low[group] + place
            share = np.maximum(np.rint(np.exp(self.logq.held[sibling] * UNIT) * 2.0**SHARE).astype(np.int64), 1)
            share[sibling == edge_b[group]] = 0
            for c in range(1, r):
                same = (parent[c, live] == which) & (branch[c, live] == where)
                share[same[group] & (sibling == chosen[c, live][group])] = 0
            run = np.cumsum(share)
            head = np.cumsum(times) - times
            base = run[head] - share[head]
            total = run[head + times - 1] - base
            draw = np.minimum((uniform(sub(4 * r + 4)[live]) * total).astype(np.int64), total - 1)
            taken = np.searchsorted(run, base + draw, "right")
            edge_c = sibling[taken]
            left = (total - share[taken]) * 2.0**-SHARE
            with np.errstate(divide="ignore"):
                number = truncated(before_b * UNIT + np.log(left), top, sub(4 * r + 5)[live])
            for f, p in enumerate(paths):
                own = which == f
                p.number[where[own]] = np.where(left[own] > 0, number[own], -np.inf)
            parent[r, live], branch[r, live], chosen[r, live] = which, where, edge_c
            # the way to the sibling, and a random way on from there
            inner = self.to.held[edge_c].astype(np.int64)
            inside = inner >= 0
            later = last[live] - slot_b - 1 + inside
            group, place = spread(later)
            ahead = (slot_b + ~inside)[group] + place
            begin = root[ahead]
            first = np.flatnonzero((place == 0) & inside[group])
            begin[first] = inner[group[first]]
            node, edge, slot = walked(begin, ahead, sub(4 * r + 6))
            fresh = np.bincount(text_of[slot], minlength=n)[live]
            start_b = np.stack([p.at[:-1] for p in paths])[which, live]
            ahead_of = where - start_b
            counts = np.zeros(n, np.int64)
            counts[live] = ahead_of + 1 + fresh
            at = offsets(counts)
            new = [np.zeros(at[-1], np.int64) for _ in range(3)]
            for f, p in enumerate(paths):
                own = np.flatnonzero(which == f)
                group, place = spread(ahead_of[own])
                source, target = start_b[own][group] + place, at[live[own]][group] + place
                for out, x in zip(new, (p.node, p.edge, p.slot), strict=True):
                    out[target] = x[source]
            turn = at[live] + ahead_of
            group, place = spread(fresh)
            target = turn[group] + 1 + place
            for out, x, rest in zip(new, (node_b, edge_c, slot_b), (node, edge, slot), strict=True):
                out[turn], out[target] = x, rest
            has, high, after = np.zeros(n, bool), np.full(n, -np.inf), np.zeros(n, np.int64)
            has[live], high[live], after[live] = True, top, ahead_of + 1
            paths.append(self._settle(Path(has, *new, at), after, high, sub(4 * r + 7)))
        return paths, best


_LATTICES: dict = {}


def lattice(path: str) -> WordLattice:
    if path not in _LATTICES:
        _LATTICES[path] = WordLattice(path)
    return _LATTICES[path]


def decode(lat: WordLattice, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The texts that pieces spell, without the blank that the model puts first; ``at``: where texts begin, and the end."""
    size = lat.surface_size[ids]
    ends = offsets(size)
    spelt = lat.surface_all[np.repeat(lat.surface_at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
    cut = ends[at].tolist()
    return [spelt[a:b].removeprefix(b" ") for a, b in zip(cut[:-1], cut[1:], strict=True)]


def row_keys(keys: list, texts: list[str], seed: int) -> np.ndarray:
    """A random-looking number from seed, doc_id and text of each row."""
    return np.array([xxhash.xxh64_intdigest(t.encode(), zlib.crc32(f"{seed}|{d}".encode())) for d, t in zip(keys, texts, strict=True)], np.uint64)


def chunks(texts: list[str]):
    """Ranges of rows of about CHUNK_CHARS."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS or j == len(texts) - 1:
            yield i, j + 1
            i, size = j + 1, 0


def sampled_segmentations(docs: DataFrame, model: str, samples: int = SAMPLES, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """doc_id, sample (from 1), n_pieces, ids_crc32, log_prob, perturbed, inclusion, decoded_crc32[, ids] of every whole text.

    decoded_crc32 is the crc32 of the text (UTF-8) that the sample's pieces decode to.
    Draws depend on seed, doc_id and text only.  A text with fewer paths than ``samples``
    gives them all, with inclusion 1; a null text counts as empty and has the empty path.
    Repeated rows give the same samples again; a null doc_id is a key like others.
    Other columns, whatever their names, are ignored; an empty table gives no rows."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int32())]
    names = ["doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "inclusion", "decoded_crc32", "ids"]
    width = 9 if with_ids else 8

    def run(batches):
        lat = lattice(model)
        for batch in batches:
            all_texts = [t or "" for t in batch.column(1).to_pylist()]
            all_keys = batch.column(0).to_pylist()
            for i, j in chunks(all_texts):
                texts, keys = all_texts[i:j], all_keys[i:j]
                paths, out_of = lat.sample(*lat.segments(texts), row_keys(keys, texts, seed), samples)
                out: list[list] = [[] for _ in range(9)]
                for no, path in enumerate(paths, 1):
                    pieces = lat.piece.held[path.edge]
                    log_prob = path.total * UNIT
                    with np.errstate(over="ignore"):
                        inclusion = np.where(out_of > -np.inf, -np.expm1(-np.exp(np.minimum(log_prob - out_of, 700.0))), 1.0)
                    at, view, texts_ = path.at.tolist(), memoryview(pieces.view(np.uint8)), decode(lat, pieces, path.at)
                    for t in np.flatnonzero(path.has).tolist():
                        a, b = at[t], at[t + 1]
                        row = (keys[t], no, b - a, zlib.crc32(view[4 * a : 4 * b]), log_prob[t], path.top[t], inclusion[t], zlib.crc32(texts_[t]), pieces[a:b] if with_ids else None)
                        for column, v in zip(out, row, strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:width], kinds[:width], strict=True)], names[:width])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def decoded(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """Add the text that each row's ids decode to (null ids: the empty text).

    An empty table gives no rows; other columns, but for one named ``decoded``, pass through."""
    names = rows.columns
    at = names.index(ids)

    def run(batches):
        lat = lattice(model)
        for batch in batches:
            ids = [x or [] for x in batch.column(at).to_pylist()]
            found = decode(lat, np.array([i for x in ids for i in x], np.int64), offsets(np.fromiter(map(len, ids), np.int64, len(ids))))
            texts = [x.decode("utf-8", "replace") for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, decoded string")


def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of every row of ``documents``."""
    import public_tokenizers

    return sampled_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
