"""Token counts of whole texts, also of texts too long for one task's patience.

Texts up to CORE characters are counted where they are read.  No piece of the vocabulary has
a blank behind another character, so no merge reaches over the place before a blank that
follows another character: the words between such places are counted alone, and the counts
of words met before are kept.

Longer texts are cut into cores of CORE characters.  Each is encoded with OVERLAP characters
of its neighbours at either end, in tasks of their own, and its tokens near both ends are
handed on with their offsets.  The encodings of two neighbours are spliced at a place that

* is a boundary in both, and
* is stable: the token that ends there in the left encoding and the token that begins there
  in the right one, put together, are encoded as these two tokens.

Byte-pair merging is a sequence of best merges, ties from the left.  Were the spliced
sequence not the text's encoding, look at the first merge that crosses one of its
boundaries.  Until then all merges near it were the same as in the two tokens put together,
so these would merge across their boundary as well.  Inside an encoding all neighbours are
stable, and at the splice they were tested.  So the sequence is the text's encoding.

A text with a seam where no such place is found is encoded again with cores and overlaps
WIDER times as long, in the last resort as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.store import join_hot, settle, table

CORE, OVERLAP, WIDER = 1 << 14, 256, 4
MODEL_LIMIT = 4096
BLANK = "▁"
#: Words and pairs kept by a worker; when more, the cache starts anew.
CACHE = 400_000
#: Bytes of text counted at once.
CHUNK_BYTES = 4 << 20
#: So many texts that must be encoded again are sent to all tasks (16 bytes each); more are joined.
BROADCAST_KEYS = 1 << 16


class Pieces:
    """A sentencepiece model of merges, without the blank it puts before a text."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models of merges that leave characters as they are can be spliced")
        kinds = np.array([p.type for p in proto.pieces])
        if np.isin(kinds, (4, 5)).any():
            raise ValueError("user-defined and unused pieces are not merged by rank")
        if any(BLANK in p.piece.lstrip(BLANK) for p in proto.pieces):
            raise ValueError("pieces reach over words")
        self.prefix = " " if rules.add_dummy_prefix else ""
        rules.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.plain = kinds == 1
        self.surface = [p.piece for p in proto.pieces]
        #: Characters that a token stands for; of a character spelt by bytes, its first byte.
        self.chars = np.array([len(p.piece) if k == 1 else int(k != 6 or not 0x80 <= int(p.piece[3:5], 16) < 0xC0) for p, k in zip(proto.pieces, kinds, strict=True)])
        self.words: dict[bytes, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int64)

    def stable(self, left: int, right: int) -> bool:
        """Whether a boundary between these two tokens stands."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            found = self.pairs[left, right] = self.model.encode(self.surface[left] + self.surface[right], num_threads=1) == [left, right]
        return found

    def _counts_of(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > CACHE:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        for w, ids in zip(new, self.model.encode([w.decode() for w in new], num_threads=1), strict=True):
            self.words[w] = len(ids)
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out = np.zeros(len(texts), np.int64)
        marked = pc.match_substring(texts, BLANK).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(marked).tolist():  # there a blank may follow a blank unseen
            out[i] = len(self.model.encode(self.prefix + texts[i].as_py(), num_threads=1))
        size = pc.binary_length(texts).to_numpy()
        rows = np.flatnonzero((size > 0) & ~marked)
        if not len(rows):
            return out
        after = np.cumsum(size[rows])
        for part in np.split(rows, np.searchsorted(after, np.arange(CHUNK_BYTES, int(after[-1]), CHUNK_BYTES))):
            if len(part):
                out[part] = self._chunk(pc.binary_join_element_wise(pa.scalar(self.prefix, pa.large_string()), texts.take(pa.array(part)), pa.scalar("", pa.large_string())))
        return out

    def _chunk(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
        starts = at[:-1] - at[0]
        blank = data == 0x20
        new = np.empty(len(data), bool)
        new[0] = True
        np.logical_and(blank[1:], ~blank[:-1], out=new[1:])
        new[starts] = True
        cuts = np.flatnonzero(new)
        words = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data))), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        counts = self._counts_of(words.dictionary.to_pylist())[words.indices.to_numpy()]
        return np.add.reduceat(counts, np.searchsorted(cuts, starts))


_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One model a worker and file."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def _plainly(texts: DataFrame, model: str) -> DataFrame:
    def run(batches):
        m = pieces(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m.count(b.column(2)))], ["doc_id", "n_bytes", "n_tokens"])

    return texts.select("doc_id", "n_bytes", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def _cores(texts: DataFrame, core: int, overlap: int) -> DataFrame:
    """(key, part, parts, lo, text): every core of every text with its overlaps, dealt evenly over the tasks."""

    def run(batches):
        names = ["key", "part", "parts", "lo", "text"]
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                parts = max(1, -(-len(text) // core))
                for i in range(parts):
                    lo = max(0, i * core - overlap)
                    row = [[key], [i], [parts], [lo], [text[lo : (i + 1) * core + overlap if i + 1 < parts else len(text)]]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)

    return texts.select("key", "text").mapInArrow(run, "key binary, part long, parts long, lo long, text string").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


SEAM = "key binary, seam long, right boolean, first array<long>, place array<long>, token array<int>"


def _seams(cores: DataFrame, model: str, core: int, overlap: int) -> DataFrame:
    """Two rows a core, one for the seam at either end.

    ``place``: boundaries near the seam, beside a plain token that begins (right side) or ends
    there (left side); ``first``: tokens before each.  Behind the last core there is no
    seam: its row has the number of all its tokens."""

    def run(batches):
        m = pieces(model)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for key, part, parts, lo, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                ids = m.ids((m.prefix if part == 0 else "") + text)
                ends = np.append(0, np.cumsum(m.chars[ids])) + lo - (len(m.prefix) if part == 0 else 0)
                plain = m.plain[ids]
                for seam, right in ((part, True), (part + 1, False)):
                    if seam == 0:
                        continue
                    if seam == parts:
                        row = (key, seam, right, [len(ids)], [], [])
                    else:
                        # boundary k stands before token k and behind token k - 1
                        k = np.arange(*np.searchsorted(ends[:-1] if right else ends[1:], [seam * core - overlap, seam * core + overlap + 1]))
                        k = k[plain[k]]
                        row = (key, seam, right, k if right else k + 1, ends[k if right else k + 1], ids[k])
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
            kinds = [pa.binary(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["key", "seam", "right", "first", "place", "token"])

    return cores.mapInArrow(run, SEAM)


def _spliced(seams: DataFrame, model: str) -> DataFrame:
    """(key, n, failed): of each seam, the tokens of the left encoding before the splice less those of the right one."""
    side = F.struct("first", "place", "token")
    both = seams.groupBy("key", "seam").agg(F.any_value(F.when(~F.col("right"), side), True).alias("l"), F.any_value(F.when(F.col("right"), side), True).alias("r"))
    flat = both.select("key", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in ("first", "place", "token")])

    def run(batches):
        m = pieces(model)
        for b in batches:
            keys, n, failed = b.column(0), [], []
            for lf, lp, lt, rf, rp, rt in zip(*(b.column(i).to_pylist() for i in range(1, 7)), strict=True):
                if rf is None:  # behind the last core
                    n.append(lf[0])
                    failed.append(False)
                    continue
                _, at_l, at_r = np.intersect1d(np.array(lp, np.int64), np.array(rp, np.int64), return_indices=True)
                found = next(((i, j) for i, j in zip(at_l.tolist(), at_r.tolist(), strict=True) if m.stable(lt[i], rt[j])), None)
                n.append(0 if found is None else lf[found[0]] - rf[found[1]])
                failed.append(found is None)
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(failed, pa.bool_())], ["key", "n", "failed"])

    return flat.mapInArrow(run, "key binary, n long, failed boolean")


def _long_counts(texts: DataFrame, model: str, core: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of each distinct text; keys are digests."""
    spark, done, todo = texts.sparkSession, None, texts
    while True:
        rows = _spliced(_seams(_cores(todo, core, overlap), model, core, overlap), model)
        found = settle(rows.groupBy("key").agg(F.sum("n").alias("n_tokens"), F.max("failed").alias("failed")), "token-counts")
        good = found.filter(~F.col("failed")).select("key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        again = found.filter("failed").select("key")
        left = again.count()
        if not left:
            return done
        core, overlap = core * WIDER, overlap * WIDER
        todo = texts.join(F.broadcast(again) if left <= BROADCAST_KEYS else again.hint("merge"), "key", "left_semi")


def token_counts(docs: DataFrame, model: str, limit: int = MODEL_LIMIT, core: int = CORE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of (doc_id, text).

    Tokens are those of the sentencepiece model without begin and end; strings that look like
    special tokens are text.  Null and empty texts have no bytes and no tokens; null and
    repeated doc_ids and repeated rows are rows like others; other columns are ignored; an
    empty table gives no rows.  ``overlap`` must be less than half of ``core``."""
    if not 0 < 2 * overlap < core:
        raise ValueError("overlap must be less than half of core")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > core
    far = texts.filter(is_long).withColumn("key", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    counts = _long_counts(far.select("key", "text"), model, core, overlap)
    rows = settle(far.select("doc_id", "n_bytes", "key"), "long-texts")
    groups = counts.join(rows.groupBy("key").agg(F.count("*").alias("group_rows")).hint("merge"), "key")
    joined = join_hot(rows, groups, "key", "group_rows", rows.count())
    both = _plainly(texts.filter(~is_long), model).unionByName(joined.select("doc_id", "n_bytes", "n_tokens"))
    return both.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every row of ``documents``."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
