"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are made per document; equal ones collapse to one row first, so groups
of copies cost nothing further.  The index is a hierarchy of bit patterns:

* upper nodes: patterns masked to whole blocks of the fingerprint.  Two fingerprints
  within ``distance`` bits agree on at least ``blocks - distance`` of the blocks, so each
  is filed under every choice of that many blocks and every linked pair meets below some
  upper node.  Upper nodes are Spark groups.  A node of very many fingerprints is divided
  in the same way by blocks of its free bits, a smaller one into chunks of bounded size
  whose pairs are task groups, so no node is ever held whole.
* inner nodes: within a chunk, fingerprints in the Gray order of their free bits; every
  FAN neighbours share a masked pattern (the bits on which all of them agree), and every
  FAN nodes share what their patterns have in common, up to one root.

Two trees are compared from the roots down.  A pair of nodes differs at least on the bits
that both patterns fix; a child adds only what its pattern fixes beyond its parent's, and
the pair with all that is below it is dropped once the sum exceeds ``distance``.

Chunks return spanning edges instead of all pairs.  Components come from alternating
large-star and small-star rounds over the edges, as Spark joins.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.arrays import spread
from corpuslens.llm.groups import changes, chunk_pairs, whole_groups
from corpuslens.llm.store import discard, join_hot, settle, settled_path, table

WORDS, DISTANCE, SEED = 4, 4, 42
#: Least number of fingerprint blocks of the upper nodes, and fingerprints that random ones may put below one.
BLOCKS, CROWD = 6, 16
#: Fingerprints in a chunk; chunks of a node, beyond which it is divided by further blocks.
CHUNK, CHUNKS = 1024, 16
#: Children of an inner node, and fingerprints compared at once.
FAN, AT_ONCE = 4, 4096

#: ASCII white space and upper case, as fixed by the contract of the fingerprints.
BLANKS = bytes(range(9, 14)) + b" "
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + BLANKS, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(BLANKS))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 values of a whole text's word shingles, repeats included.

    A text with fewer words is one shingle, one without words has none."""
    parts = (text or "").encode().translate(LOWER).split()
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: n - words + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the values; zero if there are none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of a whole text over its word shingles, repeats included."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and signed 64-bit fingerprint of every document."""

    def make(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def masks(free: int, blocks: int, distance: int) -> list[int]:
    """The bits of every choice of ``blocks - distance`` of the parts into which the free bits are cut."""
    bits = [b for b in range(64) if free >> b & 1]
    edges = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    block = [sum(1 << b for b in bits[a:e]) for a, e in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(block, blocks - distance)]


def blocks_for(n: int, distance: int, least: int) -> int:
    """Blocks of the upper nodes for ``n`` fingerprints: as many as keep random ones apart."""
    blocks = max(least, distance + 1)
    while blocks < 64 and n > CROWD << (64 * (blocks - distance) // blocks):
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class GrayTrees:
    """Inner nodes over codes of several groups laid end to end, each group in Gray order.

    Level 0 is the codes; node v of level k has the children ``begin[k][v]`` to
    ``begin[k][v + 1]`` in level k - 1, which agree on the bits ``shared[k][v]``."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.begin, self.shared, self.pattern = [None], [np.full(len(codes), ~np.uint64(0))], [codes]
        while True:
            nodes = -(-counts // FAN)
            group, place = spread(nodes)
            begin = np.append((np.cumsum(counts) - counts)[group] + FAN * place, counts.sum())
            every = np.bitwise_and.reduceat(self.pattern[-1], begin[:-1])
            some = np.bitwise_or.reduceat(self.pattern[-1], begin[:-1])
            alike = np.bitwise_and.reduceat(self.shared[-1], begin[:-1]) & ~(every ^ some)
            self.begin.append(begin)
            self.shared.append(alike)
            self.pattern.append(every)
            counts = nodes
            if counts.max() <= 1:
                break

    def near(self, left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Pairs of codes below the root pairs (left, right) that differ in at most ``distance`` bits.

        A root paired with itself gives each pair of its codes once.  The third result is
        the number of pairs of codes that were compared."""
        top = len(self.begin) - 1

        def differ(a, b, level_a, level_b, known, apart):
            """Which pairs stay, the bits both patterns fix, and on how many of these they differ."""
            both = self.shared[level_a][a] & self.shared[level_b][b]
            apart = apart + np.bitwise_count((self.pattern[level_a][a] ^ self.pattern[level_b][b]) & both & ~known)
            keep = np.flatnonzero(apart <= distance)
            return keep, both[keep], apart[keep]

        a, b = left, right
        keep, known, apart = differ(a, b, top, top, np.uint64(0), np.zeros(len(a), np.uint8))
        a, b = a[keep], b[keep]
        for level in range(top, 0, -1):
            begin = self.begin[level]
            # first the children of one side, then those of the other
            pair, place = spread(begin[a + 1] - begin[a])
            child = begin[a][pair] + place
            keep, known, apart = differ(child, b[pair], level - 1, level, known[pair], apart[pair])
            same = (a == b)[pair][keep]
            a, b = child[keep], b[pair][keep]
            pair, place = spread(begin[b + 1] - begin[b])
            child = begin[b][pair] + place
            ordered = np.flatnonzero(~same[pair] | ((child > a[pair]) if level == 1 else (child >= a[pair])))
            pair, child = pair[ordered], child[ordered]
            compared = len(pair)
            keep, known, apart = differ(a[pair], child, level - 1, level - 1, known[pair], apart[pair])
            a, b = a[pair][keep], child[keep]
        return a, b, compared


def _spanning(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Smallest position reachable from each of ``size`` positions along the given pairs."""
    root = np.arange(size)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    return root


def links(codes: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """Edges (a, b), a < b, between distinct fingerprints (column fp) that keep their components.

    Exact: fingerprints joined by a chain of links of at most ``distance`` bits are
    joined by a chain of edges, and no others.  ``blocks`` follows the number of
    fingerprints unless given."""
    blocks = blocks or blocks_for(codes.count(), distance, BLOCKS)
    times = len(masks((1 << 64) - 1, blocks, distance))

    def mask_of(no: int, depth: int, known: dict) -> int:
        """Bits fixed by node number ``no``: the choices of all levels above it."""
        if depth == 0:
            return 0
        if no not in known:
            above = mask_of(no // times, depth - 1, {})
            known[no] = above | masks(((1 << 64) - 1) & ~above, blocks, distance)[no % times]
        return known[no]

    def file_under(rows: DataFrame, depth: int) -> DataFrame:
        """Each fingerprint of a node (number ``no``) below all that its free bits choose."""

        def run(batches):
            known: dict = {}
            for batch in batches:
                fp, above = np.asarray(batch.column("fp")), np.asarray(batch.column("no"))
                for no in np.unique(above).tolist():
                    own = fp[above == no]
                    for child in range(no * times, (no + 1) * times):
                        mask = np.int64(_signed(mask_of(child, depth, known)))
                        gray = gray_rank((own & ~mask).view(np.uint64)) ^ np.uint64(1 << 63)
                        columns = [pa.array(np.full(len(own), child)), pa.array(own & mask), pa.array(own), pa.array(gray.view(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, ["no", "pattern", "fp", "gray"])

        return rows.select("no", "fp").mapInArrow(run, "no long, pattern long, fp long, gray long")

    keys = ["no", "pattern", "i", "j"]

    def edges_of(batches):
        """Groups arrive whole and in Gray order."""
        for t in whole_groups(batches, keys, AT_ONCE):
            fp, side = np.asarray(t.column("fp")), np.asarray(t.column("side"))
            tree_at = np.append(0, np.flatnonzero(changes(t, [*keys, "side"])) + 1)
            trees = GrayTrees(fp.view(np.uint64), np.diff(np.append(tree_at, len(fp))))
            tree = np.arange(len(tree_at))
            second = side[tree_at] == 1
            paired = np.append(second[1:], False)  # a chunk and the one it is compared with
            left = tree[~second]
            x, y, _ = trees.near(left, left + paired[left], distance)
            root = _spanning(x, y, len(fp))
            at = np.flatnonzero(root != np.arange(len(fp)))
            pair = np.unique(np.sort(np.stack([fp[root[at]], fp[at]], 1), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    found, depth = [], 1
    filed = file_under(codes.select(F.lit(0).cast("long").alias("no"), "fp"), depth)
    while True:
        size = settle(filed.groupBy("no", "pattern").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "index-nodes")
        nodes = filed.join(size, ["no", "pattern"])
        near = nodes.filter(F.col("members") <= CHUNK * CHUNKS)
        grouped = chunk_pairs(near, ["no", "pattern"], "members", F.col("fp"), CHUNK, ["gray"])
        found.append(grouped.mapInArrow(edges_of, "a long, b long").filter("a != b"))
        if size.filter(F.col("members") > CHUNK * CHUNKS).isEmpty():
            break
        depth += 1
        filed = file_under(nodes.filter(F.col("members") > CHUNK * CHUNKS), depth)
    return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of the edges (a, b): node, root.

    Large-star and small-star rounds until nothing changes; each round joins and
    aggregates, and is written to the shared folder."""
    spark = edges.sparkSession

    def star(both: DataFrame, larger: bool, rows: int) -> DataFrame:
        """Tie neighbours of u to its smallest neighbour (or u itself)."""
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        tied = join_hot(both, low, "u", "n", rows)
        if larger:
            tied = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return tied.filter("u != v").distinct()

    now = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    mark, rows = None, now.count()
    while True:
        wide = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(wide, True, 2 * rows)
        new = settle(star(large, False, rows), "edges")  # all edges of `large` point down already
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, settled_path(now))
        now = new
        if state == mark:
            break
        mark, rows = state, state[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def named_classes(nodes: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """``node``, n and component_id (smallest doc_id reachable) of nodes (``node``, first, n: rows and least doc_id of a node)."""
    rooted = nodes.join(found.withColumnRenamed("node", node), node, "left").select(node, "first", "n", F.coalesce("root", node).alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    return join_hot(rooted, named, "root", "nodes", nodes.count()).select(node, "n", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    A null or empty text, or one without words, has fingerprint zero and is linked
    as any other.  Repeated rows give one output row each; a null doc_id never names
    a component unless no other member has an id.  Other columns, whatever their names,
    are ignored; an empty table gives no rows.
    """
    prints = settle(fingerprints(docs, words), "fingerprints")
    codes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "codes")
    classes = settle(named_classes(codes, components(links(codes, distance, blocks)), "fp"), "classes")
    return join_hot(prints, classes, "fp", "n", prints.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
