"""Best-fit packing of tokenized documents into sequences, in bulk-synchronous rounds.

Documents are cut into pieces of at most `limit` tokens. Pieces over half of it open a sequence each; the others go by
classes of size, the larger first. In a round the class's unplaced pieces and all gaps (the room left in a sequence) are
sorted by range, largest first, gaps before pieces of their size. Each range is swept by itself, in one task: from the largest
down a piece takes its successor, the smallest gap that holds it. Gaps that a range leaves are a stack for the ranges after
it, the smallest on top, whose pieces use it up from the top; the stacks are put together from one row for each range, so
where a piece looks is a running sum, and it is joined with the gap that lies there. Pieces of higher rank (larger, then by
hash) come first; one that finds only the rest of a gap and the beginning of another has lost its place and tries again in the
next round, with the gaps as they are then and before the next class. Where tokens are more than the room that is left, or
hardly a piece finds a gap, there are new sequences, as many as the tokens need. Rounds end when all pieces are placed.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.scratch import materialize

#: Pieces and gaps of a range; tokens of a range's stack in which pieces of later ranges find their gaps together.
RANGE_ROWS, BUCKET_TOKENS = 100_000, 1 << 16
#: Each class of sizes reaches down to this share of its largest.
CLASS_RATIO = 4
#: Words whose ids a worker remembers, and bytes of text tokenized at once.
CACHE_WORDS, SLICE_BYTES = 150_000, 4 << 20

_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: How byte-level vocabularies name bytes: printable ones by themselves, the others from 256 on.
BYTE_NAMES = {b: chr(b if b in _PLAIN else 256 + sum(x not in _PLAIN for x in range(b))) for b in range(256)}


# Kinds of rows that a swept range gives: a gap as it was, a placed piece, one that looks for a gap of an earlier range, a gap
# that is left for later ranges, and the range's sums.
GAP, PLACED, LOOKS, LEFT, SUMS = range(5)
_SWEPT = "part int, kind int, id long, size long, seq long, low long, high long"


def _sweep_range(part: int, rows: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """A range's rows (whether a piece, id, size), sorted, to rows of _SWEPT.

    A piece that looks for an earlier gap wants the tokens low to high from the top of the stack that is before the range; gaps that
    are left are the tokens low to high of what the range puts on it.
    """
    rooms: list[int] = []  # that there are, ascending
    gaps: dict[int, list[int]] = {}
    digs = many = tokens = 0

    def put(room: int, seq: int) -> None:
        if room not in gaps:
            gaps[room] = []
            bisect.insort(rooms, room)
        gaps[room].append(seq)

    for piece, i, size in rows:
        at = bisect.bisect_left(rooms, size)
        if not piece:
            yield part, GAP, i, size, i, 0, 0
            put(size, i)
        elif at == len(rooms):
            yield part, LOOKS, i, size, -1, digs, digs + size
            digs += size
        else:
            room = rooms[at]
            seq = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], rooms[at]
            yield part, PLACED, i, size, seq, 0, 0
            many, tokens = many + 1, tokens + size
            if room > size:
                put(room - size, seq)
    left = 0
    for room in reversed(rooms):
        for seq in gaps[room]:
            yield part, LEFT, seq, room, seq, left, left + room
            left += room
    yield part, SUMS, many, tokens, -1, digs, left


def stack_of_ranges(sums: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """sums: (range, tokens it digs into the stack, tokens it leaves on it) in order. (range, low, high, source, top): what the range
    wants from low to high are the source range's left tokens from `top` downwards."""
    stack: list[list[int]] = []
    out = []
    for part, digs, leaves in sums:
        at = 0
        while at < digs and stack:
            source, low, high = stack[-1]
            take = min(digs - at, high - low)
            out.append((part, at, at + take, source, high))
            at += take
            stack[-1][2] -= take
            if stack[-1][2] == low:
                stack.pop()
        if leaves:
            stack.append([part, 0, leaves])
    return out


def sweep(items: DataFrame, rows: int) -> tuple[DataFrame, DataFrame | None, int, int]:
    """items: piece (boolean), id, size. Rows of _SWEPT; of those that look in earlier ranges id, size, seq if they are held; how many pieces are placed, and their tokens."""
    order = [F.desc("size"), "piece", F.xxhash64("id"), "id"]
    parts = -(-rows // RANGE_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def each() -> Iterator[tuple[int, int, int]]:
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)

        block: list[tuple] = []
        for row in _sweep_range(TaskContext.get().partitionId(), each()):
            block.append(row)
            if len(block) == 65_536:
                yield as_batch(block)
                block = []
        yield as_batch(block)

    names = [x.split()[0] for x in _SWEPT.split(", ")]

    def as_batch(block: list[tuple]) -> pa.RecordBatch:
        cols = np.array(block, np.int64).reshape(-1, len(names)).T
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.int64()) for k, c in enumerate(cols)], names=names)

    dealt = items.select("piece", "id", "size")
    dealt = (dealt.repartitionByRange(parts, *order) if parts > 1 else dealt.coalesce(1)).sortWithinPartitions(*order)
    swept = materialize(dealt.mapInArrow(run, _SWEPT), "swept")
    sums = sorted(swept.where(F.col("kind") == SUMS).collect())  # a row for each range
    many, tokens = sum(r.id for r in sums), sum(r.size for r in sums)
    segments = stack_of_ranges([(r.part, r.low, r.high) for r in sums])
    if not segments:
        return swept, None, many, tokens
    spark = items.sparkSession
    kinds = {"part": pa.int32(), "first": pa.int64(), "last": pa.int64(), "source": pa.int32(), "top": pa.int64()}
    # As an Arrow table: rows of a list would be read by Python workers of their own, which stay in memory.
    table = F.broadcast(spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*segments, strict=True), kinds.values(), strict=True)], names=list(kinds))))
    looks = swept.where(F.col("kind") == LOOKS).select("part", "id", "size", "low", "high").join(table, "part").where("low >= first AND high <= last")
    looks = looks.select("id", "size", "source", (F.col("top") - F.col("high") + F.col("first")).alias("low"), (F.col("top") - F.col("low") + F.col("first")).alias("high"), F.lit(None).cast("long").alias("gap"))
    left = swept.where(F.col("kind") == LEFT).select(F.lit(None).cast("long").alias("id"), "size", F.col("part").alias("source"), "low", "high", F.col("seq").alias("gap"))
    buckets = F.explode(F.sequence(F.floor(F.col("low") / BUCKET_TOKENS), F.floor((F.col("high") - 1) / BUCKET_TOKENS)))
    both = left.withColumn("bucket", buckets).unionByName(looks.withColumn("bucket", F.floor(F.col("low") / BUCKET_TOKENS)))
    line = Window.partitionBy("source", "bucket").orderBy("low", F.col("gap").isNull(), "id").rowsBetween(Window.unboundedPreceding, 0)
    holds = F.last(F.when(F.col("gap").isNotNull(), F.struct("gap", "high")), True).over(line)
    held = materialize(both.withColumn("holds", holds).where("gap IS NULL AND high <= holds.high").select("id", "size", F.col("holds.gap").alias("seq")), "held")
    n, t = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return swept, held, many + n, tokens + t


class WordTokenizer:
    """Ids of whole texts by a tokenizer that splits at blanks and between letters and marks, and folds case.

    So words are cut out first, A-Z in lower case, and each is tokenized once and remembered. Texts that may hold a special token
    ("<|") are only cut at blanks. U+0130 folds to a letter and a mark, which belongs to marks that follow: there is no cut after it.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.merges = self.inner.model
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, words: list[str]) -> list[bytes]:
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        fresh = []
        for w in words:
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    fresh.append(w)
        slow = []
        for w in fresh:
            if w.isalpha() and (w.isascii() or max(w) < "\u0180" and is_normalized("NFC", w)) and w == w.lower():
                # One word for the tokenizer's splitting and nothing to fold: straight to its merges, on the names of its bytes.
                new[w] = array("I", [t.id for t in self.merges.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_NAMES))]).tobytes()
            else:
                slow.append(w)
        for k in range(0, len(slow), 5_000):
            part = slow[k : k + 5_000]
            for w, e in zip(part, self.inner.encode_batch_fast(part, add_special_tokens=False), strict=True):
                new[w] = array("I", e.ids).tobytes()
        return [new[w] for w in words]

    def texts(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by `end`, and where each text's ids begin (and the last end)."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"([^\PL\x{130}])([!-&(-/:-@\[-`{-~])", r"\1 \2")
        parts = pc.split_pattern(texts, " ")
        code = pc.dictionary_encode(parts.flatten())
        each = self.words(code.dictionary.to_pylist())
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        words = code.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(size[words])])
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        bounds = upto[offsets] + np.arange(len(offsets))  # an id more for each text before
        table = np.frombuffer(b"".join(each), "=u4")
        ids = np.full(bounds[-1], end, "<u4")
        at = np.ones(len(ids), bool)
        at[bounds[1:] - 1] = False
        lens = size[words]
        ids[at] = table[np.repeat(begin[words] - upto[:-1], lens) + np.arange(upto[-1])]
        return ids, bounds


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenize_pieces(
    docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text",
    payload: tuple[str, str, Callable[[np.ndarray], object]] = ("ids", "array<int>", lambda ids: ids.astype(np.int32)),
) -> DataFrame:
    """doc, piece, start, length and a column made of each piece's ids (by default the ids). tokenizer_path: on every executor.

    Null and empty texts are the id `end` alone; texts of any length are cut into pieces; repeated rows and null ids each have
    their pieces; an empty table gives an empty one; other columns are not read.
    """
    name, kind, make = payload
    arrow = {"array<int>": pa.list_(pa.int32()), "long": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            cuts = np.unique(np.searchsorted(size, np.arange(0, (size[-1] if len(size) else 0) + SLICE_BYTES, SLICE_BYTES), "right").clip(0, len(size)))
            for a, b in zip([0, *cuts], [*cuts, len(size)], strict=True):
                if a < b:
                    yield pieces(tokenizer, batch.slice(a, b - a))

    def pieces(tokenizer: WordTokenizer, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = tokenizer.texts(batch.column(1), end)
        total = np.diff(bounds)
        many = -(-total // limit)
        row = np.repeat(np.arange(len(total)), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = piece * limit
        length = np.minimum(limit, total[row] - start)
        made = [make(ids[bounds[r] + s : bounds[r] + s + n]) for r, s, n in zip(row, start, length, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (piece, start, length)), pa.array(made, arrow)], names=["doc", "piece", "start", "length", name])

    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc long, piece long, start long, length long, {name} {kind}")


def pack(pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """pieces (with a length from 1 to limit) with sequence_id (any numbers) and offset; sequences are gapless from 0 and hold at most limit.

    Null ids and repeated rows are packed as any other; an empty table gives an empty one; other columns stay (a column `_piece`
    or of the result's names is replaced). The driver gets how many pieces of each length there are (at most limit rows), and a
    row for each range of a round.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces.drop("_piece", "sequence_id", "offset").withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    assert all(1 <= x <= limit for x in counts)
    slim = pieces.select(F.col("_piece").alias("id"), F.col("length").alias("size"))
    # Pieces that no other of their kind can share a sequence with open one, which has their number.
    placed = [slim.where(F.col("size") > limit // 2).select("id", F.col("id").alias("seq"))]
    gaps = slim.where((F.col("size") > limit // 2) & (F.col("size") < limit)).select(F.col("id").alias("seq"), (limit - F.col("size")).alias("size"))
    rooms = sum((limit - x) * n for x, n in counts.items() if x > limit // 2)
    n_gaps = sum(n for x, n in counts.items() if limit // 2 < x < limit)
    opened, top, left, many, tokens, stalled = 0, limit // 2, None, 0, 0, False
    while top or many:
        low = top // CLASS_RATIO if top > 8 * CLASS_RATIO else 0
        own = {x: n for x, n in counts.items() if low < x <= top}
        if own:
            now = slim.where((F.col("size") > low) & (F.col("size") <= top))
            left = now if left is None else left.unionByName(now)
        many, tokens, top = many + sum(own.values()), tokens + sum(x * n for x, n in own.items()), low
        if not many:
            continue
        fresh = max(-(-(tokens - rooms) // limit), -(-tokens // limit) if stalled else 0, 0)
        new = spark.range(opened, opened + fresh).select((-F.col("id") - 1).alias("seq"), F.lit(limit).cast("long").alias("size"))
        opened, rooms, n_gaps = opened + fresh, rooms + fresh * limit, n_gaps + fresh
        wide = (gaps.unionByName(new) if fresh else gaps).select(F.lit(False).alias("piece"), F.col("seq").alias("id"), "size")
        swept, held, n, t = sweep(left.select(F.lit(True).alias("piece"), "id", "size").unionByName(wide), many + n_gaps)
        put = swept.where(F.col("kind") == PLACED).select("id", "size", "seq")
        left = swept.where(F.col("kind") == LOOKS).select("id", "size")
        if held is not None:
            put, left = put.unionByName(held), left.join(held.select("id"), "id", "left_anti")
        placed.append(put.select("id", "seq"))
        before = swept.where(F.col("kind") == GAP).select("seq", "size")
        gaps = before.unionByName(put.select("seq", (-F.col("size")).alias("size"))).groupBy("seq").agg(F.sum("size").alias("size")).where("size > 0")
        stalled, many, tokens, rooms = not top and (held is None or n < 0.5 * many), many - n, tokens - t, rooms - t
    where = placed[0]
    for more in placed[1:]:
        where = where.unionByName(more)
    line = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_piece").rowsBetween(Window.unboundedPreceding, -1)
    found = pieces.join(where.select(F.col("id").alias("_piece"), F.col("seq").alias("sequence_id")), "_piece")
    return found.withColumn("offset", F.coalesce(F.sum("length").over(line), F.lit(0)).cast("long")).drop("_piece")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, input_ids, document_starts: the packed sequences themselves, from pieces with ids."""
    each = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc", "ids"))).alias("p"))
    return each.select("sequence_id", F.flatten("p.ids").alias("input_ids"), F.col("p.offset").alias("document_starts"))
