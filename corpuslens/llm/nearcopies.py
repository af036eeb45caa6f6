"""Near copies: SimHash links and MinHash bands, verified by Jaccard similarity.

Two documents are linked if the sets of their word shingles have a Jaccard similarity of
at least ``similarity``.  Candidates come from three sources, one after the other:

1. Links of the SimHash index (fingerprints of the same shingles within a few bits).
   They join nearly equal documents, and with them large groups, at one pair a document.
   They do not suffice: at similarity 0.8 some ten of 64 bits differ, and blocks that any
   two such fingerprints share are too short for an index.
2. Pairs that agree on all minima of some band of a MinHash sketch; with 40 bands of 6
   minima a pair at similarity 0.8 is missed with probability (1 - 0.8**6)**40 < 6e-6.
   Members of a band value are first compared with one leader.
3. Pairs of a band value that are still in different components, compared within tasks
   by their whole sketches; a pair goes on if at least LEAST_AGREE of the 240 minima agree
   (a pair at similarity 0.8 fails that with probability below 1e-7).  Sets of at most
   CARRIED shingles travel with their sketches: such pairs are verified on the spot, and
   those in components that a task has already found to be one are passed over.
   So no link is left out, and pairs that are not alike are not written out.

Every candidate is verified on the whole sets before components are formed.  Documents
with equal sets are one node, named by a digest of 128 bits.  Sets are made again only of the documents that stand for nodes
in candidates, picked by a Bloom filter of bounded size where the texts are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.arrays import small_batches
from corpuslens.llm.groups import changes, chunk_pairs, whole_groups
from corpuslens.llm.simhash import DISTANCE, SEED, components, links, majority, named_classes, shingle_hashes
from corpuslens.llm.store import join_hot, settle

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
#: Least share of equal minima (last bytes of them) for a pair to be verified.
LEAST_AGREE = 0.66
#: Bits of the Bloom filter (at most), bits a document, and bits of a piece of it.
BLOOM_BITS, BLOOM_LOAD, BLOOM_PIECE = 1 << 26, 16, 1 << 18
#: Shingles of a set that travels with its sketch (at most).
CARRIED = 256
#: Sketches in a chunk, and compared at once.
CHUNK, AT_ONCE = 512, 2048

_RNG = np.random.Generator(np.random.Philox(SEED))
FLIPS = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
FACTORS = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 values of a whole text's word shingles."""
    return np.unique(shingle_hashes(text, words))


def minima(found: np.ndarray) -> np.ndarray:
    """The sketch of a set of shingles that is not empty."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    own = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(own), 256):
        np.minimum(low, ((own[at : at + 256, None] ^ FLIPS) * FACTORS).min(0), out=low)
    return low


def bands(sketch: np.ndarray) -> np.ndarray:
    """One number for each band of a sketch."""
    raw = sketch.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(raw)], np.uint64).view(np.int64)


def _node(found: np.ndarray) -> bytes:
    return hashlib.md5(found.tobytes(), usedforsecurity=False).digest()


def _packed(found: np.ndarray) -> bytes:
    """A set's shingles as 48 bits each."""
    return np.unique(found >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _set(shingles: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(shingles.as_buffer(), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (0, 2))).view("<u8").ravel()


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= similarity * (len(x) + len(y) - shared) - 1e-9


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, node (digest of the set of shingles), SimHash fingerprint, bands, sketch and number of shingles of every document."""

    def make(batches):
        for batch in small_batches(batches):
            all_ = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            prints = np.fromiter((majority(h) for h in all_), np.uint64, len(all_))
            sets = [np.unique(h) for h in all_]
            low = [minima(s) if len(s) else None for s in sets]
            rows = [bands(m) if m is not None else [] for m in low]
            brief = [(m & np.uint32(255)).astype(np.uint8).tobytes() if m is not None else b"" for m in low]
            columns = [
                batch.column(0), pa.array([_node(s) for s in sets], pa.binary()), pa.array(prints.view(np.int64)),
                pa.array(rows, pa.list_(pa.int64())), pa.array(brief, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "fp", "bands", "sketch", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, node binary, fp long, bands array<long>, sketch binary, size long")


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Three places of the Bloom filter for each id."""
    x = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return np.stack([(x >> np.uint64(k)) & np.uint64(bits - 1) for k in (4, 20, 36)]).astype(np.int64)


def bloom(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of a column of longs: tasks set bits, pieces of equal place are united, ``bits`` bits reach the driver."""

    def part(batches):
        held = np.zeros(bits, bool)
        for batch in batches:
            held[_places(np.asarray(batch.column(0)), bits).ravel()] = True
        packed = np.packbits(held).reshape(-1, min(BLOOM_PIECE, bits) // 8)
        own = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([packed[i].tobytes() for i in own], pa.binary())], ["piece", "bits"])

    def unite(t: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in t["bits"]])
        return pa.table({"piece": t["piece"].slice(0, 1), "bits": pa.array([both.tobytes()], pa.binary())})

    out = np.zeros((-(-bits // BLOOM_PIECE), min(BLOOM_PIECE, bits) // 8), np.uint8)
    for r in ids.mapInArrow(part, "piece int, bits binary").groupBy("piece").applyInArrow(unite, "piece int, bits binary").collect():  # bounded by `bits`
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def shingle_sets(docs: DataFrame, words: int, wanted: np.ndarray) -> DataFrame:
    """node and its sorted shingles (48 bits each) of documents whose id is in the Bloom filter, or null."""
    filter_ = docs.sparkSession.sparkContext.broadcast(wanted)  # at most BLOOM_BITS bits

    def make(batches):
        for batch in small_batches(batches):
            ids = pc.fill_null(batch.column(0), 0).to_numpy()
            at = _places(ids, 8 * len(filter_.value))
            near = (filter_.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(0) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
            sets = [shingles(t, words) for t in batch.column(1).filter(pa.array(near)).to_pylist()]
            brief = [_packed(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.binary()), pa.array(brief, pa.binary())], ["node", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "node binary, shingles binary")



def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    both = pairs
    for side in ("a", "b"):
        own = sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}"))
        both = both.join(own.hint("merge"), side)

    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                keep[i] = _alike(_set(x), _set(y), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a binary, b binary")


def _pairs(left: str, right: str):
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def open_bands(held: DataFrame, found: DataFrame) -> DataFrame:
    """band, node, root, members (nodes of the band value) of band values whose nodes are in different components, settled."""
    rooted = held.join(found.hint("merge"), "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members")).filter("low != high")
    mixed = settle(mixed.select("band", "members"), "mixed-bands")
    return settle(join_hot(rooted, mixed, "band", "members", mixed.agg(F.sum("members")).first()[0] or 0), "open-bands")


def across(open_: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, sure) of nodes of a band value that are in different components and similar enough, or, if not sure, may be.

    Sure pairs of a task are as many as join what they join."""
    short = F.when(F.length("shingles") <= 6 * CARRIED, F.col("shingles"))
    brief = nodes.select("node", "sketch", "size").join(sets.select("node", short.alias("carried")).hint("merge"), "node", "left")
    rows = open_.join(brief.hint("merge"), "node").withColumn("root", F.xxhash64("root"))
    keys = ["band", "i", "j"]

    def compare(batches):
        for t in whole_groups(batches, keys, AT_ONCE):
            begin = np.append(np.append(0, np.flatnonzero(changes(t, keys)) + 1), t.num_rows)
            side, size, root = np.asarray(t.column("side")), np.asarray(t.column("size")), np.asarray(t.column("root")).copy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            carried = [_set(v) if v.is_valid else () for v in t.column("carried")]
            left, right, sure = [], [], []
            for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                second = lo + int(np.searchsorted(side[lo:hi], 1))
                for x in range(lo, second):
                    y = np.arange(second if second < hi else x + 1, hi)
                    small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                    y = y[(root[y] != root[x]) & (small >= similarity * large - 1e-9)]
                    if not len(y):
                        continue
                    for j in y[(sketch[y] == sketch[x]).sum(1) >= least].tolist():
                        if root[j] == root[x]:
                            continue
                        both = len(carried[x]) > 0 and len(carried[j]) > 0
                        if both and not _alike(carried[x], carried[j], similarity):
                            continue
                        left.append(x)
                        right.append(j)
                        sure.append(both)
                        if both:
                            root[root == root[j]] = root[x]
            if left:
                node = t.column("node")
                pairs = [node.take(pa.array(k, pa.int64())).combine_chunks() for k in (left, right)]
                yield pa.RecordBatch.from_arrays([*pairs, pa.array(sure, pa.bool_())], ["a", "b", "sure"])

    least = LEAST_AGREE / SIMILARITY * similarity * BANDS * ROWS
    near = chunk_pairs(rows, ["band"], "members", F.col("node"), CHUNK, ["node"]).mapInArrow(compare, "a binary, b binary, sure boolean")
    return near.select(*_pairs("a", "b"), "sure").distinct()


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, distance: int = DISTANCE) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable) of every document.

    Null, empty and blank texts have no shingles and count as copies of each other.
    Repeated rows give one output row each; a null doc_id never names a component
    unless no other member has an id.  Other columns, whatever their names, are
    ignored; an empty table gives no rows."""
    sketched = settle(sketches(docs, words), "sketches")
    of_node = [F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")]
    nodes = settle(sketched.groupBy("node").agg(*of_node, *[F.any_value(c).alias(c) for c in ("bands", "sketch", "size")]), "nodes")
    filed = nodes.select(F.explode("bands").alias("band"), "node")
    shared = filed.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("band")
    held = settle(filed.join(shared.hint("merge"), "band"), "bands")

    # nodes of one fingerprint with the first of them, and the first nodes of linked fingerprints
    prints = settle(sketched.select("fp", "node").distinct(), "prints")
    codes = settle(prints.groupBy("fp").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")), "codes")
    equal = join_hot(prints, codes, "fp", "n", prints.count()).filter("node != lead").select(*_pairs("node", "lead"))
    ends = links(codes, distance)
    for side in ("a", "b"):
        ends = ends.join(codes.select(F.col("fp").alias(side), F.col("lead").alias(f"lead_{side}")).hint("merge"), side)
    first = settle(equal.unionByName(ends.select(*_pairs("lead_a", "lead_b"))).filter("a != b").distinct(), "pairs")

    wanted = held.select("node").unionByName(first.select(F.col("a").alias("node"))).unionByName(first.select(F.col("b").alias("node"))).distinct()
    wanted = settle(nodes.select("node", "first").join(wanted.hint("merge"), "node"), "wanted")
    n = max(1, wanted.count())
    picked = bloom(wanted.select(F.coalesce("first", F.lit(0))), min(BLOOM_BITS, 1 << (BLOOM_LOAD * n - 1).bit_length()))
    sets = settle(shingle_sets(docs, words, picked).join(wanted.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "shingle-sets")
    as_edges = lambda df: df.select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = components(verified(first, sets, similarity))

    now = open_bands(held, found)
    draw = F.min(F.struct(F.xxhash64("band", "node").alias("draw"), "node", "root")).alias("lead")
    leaders = now.groupBy("band").agg(draw, F.count(F.lit(1)).alias("n_led")).select("band", "n_led", F.col("lead.node").alias("lead"), F.col("lead.root").alias("lead_root"))
    led = join_hot(now, settle(leaders, "leaders"), "band", "n_led", now.count()).filter("root != lead_root").select(*_pairs("node", "lead")).distinct()
    second = settle(led.join(first.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    found = components(as_edges(found).unionByName(verified(second, sets, similarity)))

    now = open_bands(held, found)
    third = settle(across(now, nodes, sets, similarity), "pairs")
    open_ = third.filter("NOT sure").select("a", "b").join(second.unionByName(first).hint("merge"), ["a", "b"], "left_anti")
    found = components(as_edges(found).unionByName(third.filter("sure").select("a", "b")).unionByName(verified(open_, sets, similarity)))

    classes = settle(named_classes(nodes.select("node", "first", "n"), found, "node"), "classes")
    return join_hot(sketched.select("doc_id", "node"), classes, "node", "n", sketched.count()).select("doc_id", "component_id")
