"""SentencePiece encoding and decoding over a relational lattice.

Words are exploded into substrings no longer than the longest piece and joined to the piece table,
which every task has. The edges of a word stay together and in the order of their places; a task folds
those of many words at once by Viterbi, place by place, keeping the best way to every place, and walks
them back. A word of any length is one lattice: it is exploded from windows that overlap by the longest
piece. A task sends each word through its lattice once, for as long as it remembers it, then the texts
as numbers of these words, so nothing is exchanged or written in between.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from determina.llm.blocks import _told_apart
from determina.llm.shared import Hasher, chunks, text_arrays

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Places of a word exploded from one window.
WINDOW = 256
#: First characters of a piece that tell how long it may be.
HEAD = 4
#: An edge as a number: mark of the empty character, bits of size and of the beginning of a word.
EMPTY, SIZE, BEGIN = 7, 36, 62
#: Edges folded at a time, about; all of a word are.
EDGES = 1 << 18
#: Words that a task remembers, in slices, and their bytes; then it begins anew.
WORDS_IN_SLICE, SLICES_IN_TASK = 65_536, 8
REMEMBERED = 32 << 20
#: Cost of a byte of a character that no piece has.
UNKNOWN = 20.0


@dataclass
class Pieces:
    """``text`` of every id, its ``score`` (null: not used in the lattice), and the id of byte 0."""

    text: list[str]
    score: list[float | None]
    first_byte: int

    @property
    def longest(self) -> int:
        return max((len(t) for t, s in zip(self.text, self.score, strict=True) if s is not None), default=1)


def load_pieces(path: str | None = None) -> Pieces:
    """The piece table of a model file, read by the driver.

    The model ranks its pieces by order of merging; the score of rank r is -log(r + 2), the cost of
    a word of that rank where frequency falls with the rank.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    text, score, first = [], [], -1
    for k in range(model.get_piece_size()):
        plain = not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))
        text.append(model.id_to_piece(k))
        score.append(-float(np.log(k + 2)) if plain else None)
        if model.is_byte(k) and first < 0:
            first = k
    if first < 0 or any(text[first + b] != f"<0x{b:02X}>" for b in range(256)):
        raise ValueError("the model needs byte pieces in order")
    if any("\n" in t or SPACE in t.lstrip(SPACE) for t, s in zip(text, score, strict=True) if s is not None):
        raise ValueError("pieces must not cross words")
    return Pieces(text, score, first)


def split_pieces(raw: np.ndarray, offsets: np.ndarray):
    """Words with their leading spaces, newlines apart; every non-empty text gets a space in front."""
    filled = np.diff(offsets) > 0
    data = np.insert(raw, offsets[:-1][filled], 32)
    edges = offsets + np.concatenate([[0], np.cumsum(filled)])
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(offsets), np.int64)
    space, line = data == 32, data == 10
    start = np.zeros(len(data) + 1, bool)
    start[:-1] = space | line
    start[1:-1] &= ~(space[1:] & space[:-1])
    start[1:] |= line
    start[edges[:-1][filled]] = True
    start[-1] = True
    cut = np.flatnonzero(start)
    return data, cut[:-1], cut[1:], np.searchsorted(cut[:-1], edges)


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, id, score) of the pieces a lattice may use; its size is that of the vocabulary."""
    rows = [(t, k, s) for k, (t, s) in enumerate(zip(pieces.text, pieces.score, strict=True)) if s is not None]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def head_sizes(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(head, sizes) of the first ``HEAD`` characters of pieces: how long a piece that begins so may be,
    ascending, all shorter sizes among them; no larger than the vocabulary."""
    sizes: dict[str, set[int]] = {}
    for t, s in zip(pieces.text, pieces.score, strict=True):
        if s is not None and len(t) >= HEAD:
            sizes.setdefault(t[:HEAD], set(range(1, HEAD))).add(len(t))
    return spark.createDataFrame([(head, sorted(own)) for head, own in sizes.items()], "head string, sizes array<int>")


def edges_of(words: DataFrame, table: DataFrame, pieces: Pieces) -> DataFrame:
    """(tag, edge) of (tag, spelled) rows: the edges of each word, in the order of the rows and, within a
    word, of place and size. The first edge of a word has its tag; the empty word has one empty edge.
    All of it is narrow.

    ``edge`` is one number: from bit 0 the id, or the bytes of a character without a piece; from bit 32
    how many these are (0: a piece, ``EMPTY``: none); from ``SIZE`` the size, at ``BEGIN`` whether a word
    begins. The first edge of every place has size 1, so the edges tell their places.
    """
    text = words.select("tag", F.replace(F.col("spelled").cast("string"), F.lit(" "), F.lit(SPACE)).alias("w"))
    far = F.expr(f"transform(sequence(0, (char_length(w) - 1) div {WINDOW}), k -> substring(w, k * {WINDOW} + 1, {WINDOW + pieces.longest - 1}))")
    windows = text.select("tag", F.posexplode(far).alias("k", "w"))
    last = F.greatest(F.lit(1), F.least(F.lit(WINDOW), F.char_length("w")))
    starts = windows.select("tag", "k", "w", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    at = F.col("k") * WINDOW + F.col("at")
    starts = starts.select(F.when(at == 1, F.col("tag")).alias("tag"), at.alias("at"), F.col("w").substr(F.col("at"), F.lit(pieces.longest)).alias("rest"))
    headed = starts.withColumn("head", F.substring("rest", 1, HEAD)).join(F.broadcast(head_sizes(words.sparkSession, pieces)), "head", "left")
    sizes = F.coalesce("sizes", F.array(*map(F.lit, range(1, HEAD))))
    sized = headed.select("tag", "at", "rest", F.char_length("rest").alias("left"), F.explode(sizes).alias("size")).where("size <= greatest(left, 1)")
    parts = sized.select(F.when(F.col("size") == 1, F.col("tag")).alias("tag"), "at", "size", F.col("rest").substr(F.lit(1), F.col("size")).alias("part"))
    # Pieces are found by a number and compared by their text.
    named = table.select(F.xxhash64("piece").alias("name"), "piece", "id")
    edges = parts.withColumn("name", F.xxhash64("part")).join(F.broadcast(named), "name", "left")
    edges = edges.select("tag", "at", "size", F.when(F.col("piece") == F.col("part"), F.col("id")).alias("id"), "part").where("id is not null or size = 1")
    spelled = f"if(part = '', {EMPTY}L, cast(octet_length(part) as long)) * {1 << 32}L + if(part = '', 0L, cast(conv(hex(part), 16, 10) as long))"
    begins = f"if(at = 1 and size = 1, {1 << BEGIN}L, 0L)"
    return edges.select("tag", F.expr(f"size * {1 << SIZE}L + {begins} + coalesce(cast(id as long), {spelled})").alias("edge"))


def _fold(edges: np.ndarray, costs: np.ndarray, first_byte: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of whole words to the first edge of each word, how many ids it has, and the ids of all words."""
    size = (edges & ((1 << BEGIN) - 1)) >> SIZE
    begin, long, ids = edges >> BEGIN != 0, (edges >> 32) & 15, edges & ((1 << 32) - 1)
    known = long == 0
    long[long == EMPTY] = 0
    first, word = np.flatnonzero(begin), np.cumsum(begin) - 1
    score = np.where(known, costs[np.where(known, ids, 0)], -UNKNOWN * long)
    # Places of all words are numbered one after the other; a word has one more, its end.
    source = np.cumsum(size == 1) - 1 + word
    base = source[first]
    length = source[np.append(first[1:], len(edges)) - 1] + 1 - base
    # Short numbers are sorted much faster.
    level = (source + size - base[word]).astype(np.int16 if length.max() < 1 << 14 else np.int64)
    order = np.argsort(level, kind="stable")
    target, level = (source + size)[order], level[order]
    groups = np.flatnonzero(np.diff(target, prepend=-1))
    best, back = np.zeros(base[-1] + length[-1] + 1), np.zeros(base[-1] + length[-1] + 1, np.int64)
    cuts = np.append(np.flatnonzero(np.diff(level, prepend=-1)), len(level))
    ends = np.searchsorted(groups, cuts)
    for lo, hi, a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own, starts = order[lo:hi], groups[a:b] - lo
        ways = best[source[own]] + score[own]
        top = np.maximum.reduceat(ways, starts)
        # Of equal ways the longest last piece comes first.
        many = np.diff(np.append(starts, hi - lo))
        hits = np.flatnonzero(ways == np.repeat(top, many))
        hits = hits[np.searchsorted(hits, starts)]
        best[target[groups[a:b]]], back[target[groups[a:b]]] = top, own[hits]
    taken = np.zeros(len(edges), bool)
    place, floor = base + length, base
    while len(place):
        edge = back[place]
        taken[edge] = True
        place = source[edge]
        left = place > floor
        place, floor = place[left], floor[left]
    path = np.flatnonzero(taken)
    wide = np.where(known[path], 1, long[path])
    out = np.repeat(ids[path], wide)
    unknown = np.flatnonzero(np.repeat(~known[path], wide))
    if len(unknown):
        later = (np.repeat(np.cumsum(wide), wide) - 1 - np.arange(len(out)))[unknown]
        out[unknown] = first_byte + ((out[unknown] >> (8 * later)) & 255)
    return first, np.bincount(word[path], wide, len(first)).astype(np.int64), out


def _folded(costs: np.ndarray, first_byte: int):
    """Task code: edges to (tags, how many ids, ids) of some words after the other, tags as Arrow."""

    def run(batches):
        held, rows, later = [], 0, False
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                starts = batch.column("edge").to_numpy() >> BEGIN != 0
                later = later or bool(starts[0 if held else 1 :].any())
                held.append(batch)
                rows += len(starts)
            if not rows or batch is not None and (rows < EDGES or not later):
                continue
            table = pa.Table.from_batches(held)
            edges, end = table.column("edge").to_numpy(), rows
            if batch is not None:
                end = int(np.flatnonzero(edges >> BEGIN)[-1])
            first, many, ids = _fold(edges[:end], costs, first_byte)
            yield table.column("tag").take(pa.array(first)).combine_chunks(), many, ids
            held, rows, later = table.slice(end).to_batches(), rows - end, False

    return run


def _costs(pieces: Pieces) -> np.ndarray:
    """The score of every id."""
    return np.array([0.0 if s is None else s for s in pieces.score])


def encode_words(words: DataFrame, pieces: Pieces, table: DataFrame | None = None) -> DataFrame:
    """(word, ids) of distinct (word, spelled) rows; ``spelled`` are the bytes of the word.

    The path has the largest sum of scores; of equal ones the longer last piece wins. A character
    without a piece is written as its bytes. ``word`` names the word;
    an empty word has no ids.
    """
    table = piece_table(words.sparkSession, pieces) if table is None else table
    folded = _folded(_costs(pieces), pieces.first_byte)

    def run(batches):
        for tags, many, ids in folded(batches):
            ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([tags, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], ["word", "ids"])

    edges = edges_of(words.where("spelled != X''").select(F.col("word").alias("tag"), "spelled"), table, pieces)
    return edges.mapInArrow(run, StructType([StructField("word", words.schema["word"].dataType), *StructType.fromDDL("ids array<int>").fields]))


def piece_bytes(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces, and their ends with a leading 0."""
    raw = [bytes([k - pieces.first_byte]) if 0 <= k - pieces.first_byte < 256 else t.replace(SPACE, " ").encode() if s is not None else b"" for k, (t, s) in enumerate(zip(pieces.text, pieces.score, strict=True))]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def gather(values: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges ``at`` of ``values`` one after the other, and their ends with a leading 0."""
    size = (ends[1:] - ends[:-1])[at]
    out = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(ends[at] - out[:-1], size) + np.arange(out[-1])], out


def _words_and_texts(most: int):
    """Task code: (id, text) to (spelled, tag): the new words of some texts, then the texts as the tag of an
    empty word: their ids, the numbers of their words and whether all words are forgotten then."""

    def run(batches):
        hasher, words, size = Hasher(), {}, 0
        keys, numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column("text")):
                data, starts, ends, first = split_pieces(raw, offsets)
                before = len(words)
                own = _told_apart(hasher.load(data).spans(starts, ends), data, starts, ends, words)
                added = np.array(list(itertools.islice(words, before, None)), np.uint64)
                new = list(itertools.islice(words.values(), before, None))
                size += sum(map(len, new))
                order = np.argsort(added)
                spot = np.searchsorted(keys, added[order])
                keys, numbers = np.insert(keys, spot, added[order]), np.insert(numbers, spot, before + order)
                distinct, codes = np.unique(own, return_inverse=True)
                codes = numbers[np.searchsorted(keys, distinct)][codes].astype(np.int32)
                full = len(words) >= most or size >= REMEMBERED
                texts = pa.table({"id": batch.column("id").slice(lo, hi - lo)})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, texts.schema) as out:
                    out.write_table(texts)
                head = np.array([len(words), full, len(first), len(codes)], np.int64)
                tag = b"".join([head.tobytes(), first.astype(np.int64).tobytes(), codes.tobytes(), sink.getvalue().to_pybytes()])
                yield pa.RecordBatch.from_arrays([pa.array([*new, b""], pa.binary()), pa.array([None] * len(new) + [tag], pa.binary())], ["spelled", "tag"])
                if full:
                    words, size, keys, numbers = {}, 0, keys[:0], numbers[:0]

    return run


def _coded(pieces: Pieces):
    """Task code: edges of words and texts to (id, ids, decoded) of the texts."""
    folded, (body, ends) = _folded(_costs(pieces), pieces.first_byte), piece_bytes(pieces)

    def texts(tag: pa.Scalar, many: np.ndarray, flat: np.ndarray) -> tuple[bool, pa.RecordBatch]:
        told = memoryview(tag.as_buffer())
        words, full, rows, codes = np.frombuffer(told, np.int64, 4).tolist()
        if words != len(many):
            raise ValueError(f"{words} words were sent, {len(many)} came")
        first = np.frombuffer(told, np.int64, rows, 32)
        at = 32 + 8 * rows
        ids, last = gather(flat, np.concatenate([[0], np.cumsum(many)]), np.frombuffer(told, np.int32, codes, at))
        where = last[first]
        raw, byte_at = gather(body, ends, ids)
        edge = byte_at[where]
        # The space in front of every text goes.
        decoded = [raw[a + 1 : b].tobytes().decode("utf-8", "replace") for a, b in itertools.pairwise(edge.tolist())]
        table = pa.ipc.open_stream(tag.as_buffer().slice(at + 4 * codes)).read_all()
        lists = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return bool(full), pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), lists, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    def run(batches):
        many, flat = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for tags, sizes, ids in folded(batches):
            done, ends_at = 0, np.concatenate([[0], np.cumsum(sizes)])
            for at in [*np.flatnonzero(tags.is_valid().to_numpy(zero_copy_only=False)).tolist(), len(sizes)]:
                many = np.concatenate([many, sizes[done:at]])
                flat = np.concatenate([flat, ids[ends_at[done] : ends_at[at]].astype(np.int32)])
                done = at + 1
                if at < len(sizes):
                    full, batch = texts(tags[at], many, flat)
                    yield batch
                    if full:
                        many, flat = many[:0], flat[:0]

    return run


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, decoded) of every row: piece ids, and the text decoded from the ids alone.

    A null or empty text has no ids and decodes to the empty text. Every other text is what comes
    back. Rows that share an id, or have none, are encoded each; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    words = rows.mapInArrow(_words_and_texts(WORDS_IN_SLICE * SLICES_IN_TASK), "spelled binary, tag binary")
    edges = edges_of(words, piece_table(docs.sparkSession, pieces), pieces)
    coded = StructType([StructField("id", rows.schema["id"].dataType), *StructType.fromDDL("ids array<int>, decoded string").fields])
    return edges.mapInArrow(_coded(pieces), coded).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, pieces: Pieces, ids: str = "ids") -> DataFrame:
    """(row, decoded) of rows that hold piece ids; null ids decode to null, an id out of range to nothing."""
    body, ends = piece_bytes(pieces)

    def run(batches):
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            texts = []
            for x in lists:
                if x is None:
                    texts.append(None)
                    continue
                at = np.array([k for k in x if k is not None and 0 <= k < len(ends) - 1], np.int64)
                texts.append(gather(body, ends, at)[0].tobytes()[1:].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "decoded"])

    given = rows.select(F.struct("*").alias("row"), F.col(ids).cast("array<int>").alias("ids"))
    return given.mapInArrow(run, StructType(given.schema.fields[:1] + StructType.fromDDL("decoded string").fields))
