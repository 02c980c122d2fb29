"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search looks for the segmentation into pieces with the highest sum of scores, the model's vocabulary being the
lattice. It goes through the text once, in a window that the longest piece bounds the overlap of: after each window the
paths to all positions that further pieces can begin at are followed back, and ids are committed up to the boundary
that all of them run through: what lies before is settled, whatever follows. The next window begins there; a window in
which paths nowhere meet is widened. Where no piece covers a character, its UTF-8 bytes' pieces do, if the model has
them, and else its unknown piece.

All texts of a block lie one after another. Within a window all pieces are found at once by walking a trie held in flat
arrays, and the stretches between places that no piece spans, where all paths meet whatever their scores, are searched
side by side, position by position.

The vocabulary file is read by Spark (its path is a parameter), and only as fixed values: pieces, scores and kinds.
Ties go to the longer last piece. Texts are not normalised: the model's own rule is identity with a leading mark.

Defined cases: a null text has null ids; an empty one none; decoding gives the text back exactly if every character
has a piece or byte pieces; the mark itself in a text decodes to a space, as in the model's own library; ids outside
the vocabulary decode to nothing; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Text bytes that are encoded at once, and cells (characters by piece lengths) of a window.
BLOCK, WINDOW_CELLS = 1 << 20, 1 << 21
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Vocabulary:
    """Pieces of a model: text to (id, score), byte values to ids, what each id decodes to, and the trie of the pieces."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=data)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: list[int] = [-1] * 256
        self.unknown = model.unk_id()
        self.decoded: list[bytes] = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.decoded.append(bytes([value]))
            elif model.is_control(i) or model.is_unused(i):
                self.decoded.append(b"")
            elif model.is_unknown(i):
                self.decoded.append(" ⁇ ".encode())
            else:
                self.pieces[piece] = (i, model.get_score(i))
                self.decoded.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.pieces), default=1)
        #: Below every piece, so that bytes stand only where no piece does.
        self.floor = min((s for _, s in self.pieces.values()), default=0.0) - 10.0
        #: Beside the ids: a character that no piece covers, and nothing.
        self.fall, self.none = len(self.decoded), len(self.decoded) + 1
        self.scores = np.full(len(self.decoded) + 2, -np.inf)
        self.scores[self.fall] = self.floor
        for i, s in self.pieces.values():
            self.scores[i] = s
        self._trie()

    def _trie(self) -> None:
        """Flat arrays: the child of a node by a character c is node[base + c], if that one's parent is the node."""
        self.letters = np.array(sorted({ord(x) for p in self.pieces for x in p}), np.int64)
        number = {chr(x): i + 1 for i, x in enumerate(self.letters.tolist())}
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        for p, (i, _) in self.pieces.items():
            at = 0
            for x in p:
                c = number[x]
                to = children[at].get(c)
                if to is None:
                    to = children[at][c] = len(children)
                    children.append({})
                    ids.append(-1)
                at = to
            ids[at] = i
        wide = len(number) + 1
        size = wide
        while size < 4 * len(children):
            size *= 2
        rng = np.random.default_rng(5)
        used = np.zeros(size + wide, bool)
        slot, base_of = np.zeros(len(children), np.int64), np.zeros(len(children), np.int64)
        several = sorted((k for k, x in enumerate(children) if len(x) > 1), key=lambda k: -len(children[k]))
        for k in several:
            cs = np.fromiter(children[k], np.int64)
            while True:
                at = rng.integers(0, size, 32)
                free = np.flatnonzero(~used[at[:, None] + cs].any(1))
                if len(free):
                    break
            base_of[k] = at[free[0]]
            used[base_of[k] + cs] = True
            slot[list(children[k].values())] = base_of[k] + cs
        single = [k for k, x in enumerate(children) if len(x) == 1]
        free = np.flatnonzero(~used[wide:])[: len(single)] + wide
        for k, s in zip(single, free.tolist()):
            (c, to), = children[k].items()
            base_of[k], slot[to] = s - c, s
        self.root = size + wide
        slot[0] = self.root
        self.base, self.parent, self.id_at = np.zeros(self.root + 1, np.int32), np.full(self.root + 1, -1, np.int32), np.full(self.root + 1, -1, np.int32)
        self.base[slot] = base_of
        self.id_at[slot] = ids
        for k, x in enumerate(children):
            if x:
                self.parent[slot[list(x.values())]] = slot[k]

    def numbers(self, points: np.ndarray) -> np.ndarray:
        """The trie's number of each code point; 0 where no piece has it."""
        if not hasattr(self, "_table"):
            self._table = np.zeros(0x110001, np.int32)
            self._table[self.letters] = np.arange(1, len(self.letters) + 1)
        return self._table[points]

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if k != "_table"}  # a task makes its own


def _fallback(v: Vocabulary, char: str) -> tuple[int, ...]:
    ids = tuple(v.bytes[b] for b in char.encode())
    return (v.unknown,) if -1 in ids else ids


class Window:
    """The best paths to all positions of a stretch of character numbers."""

    def __init__(self, v: Vocabulary, c: np.ndarray):
        n, longest = len(c), v.longest
        found, far, covered = _pieces(v, c)
        ends = np.maximum.accumulate(np.arange(n) + far)
        cut = np.flatnonzero(ends == np.arange(1, n + 1)) + 1  # no piece spans these
        self.begin = np.r_[0, cut[:-1]].astype(np.int64)
        size = cut - self.begin
        # lanes in order of length, cells in order of the position in their lane: those of one position lie together
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lanes = np.cumsum(np.bincount(size)[::-1])[::-1]  # of so many positions or more
        self.base = np.r_[0, 0, np.cumsum(lanes[1:])].astype(np.int64)
        self.at = self.base[np.arange(n) - np.repeat(self.begin, size) + 1] + np.repeat(rank, size)
        self.order, self.size = order, size
        self.pieces = np.full((longest, n), v.none, np.int32)
        for k, (start, ids) in enumerate(found):
            self.pieces[k, self.at[start + k]] = ids
        self.pieces[0, self.at[~covered]] = v.fall
        # before a lane's first position the sum is 0; those cells come last
        self.base[0] = n
        best, self.length = np.zeros(n + len(order)), np.ones(n, np.int16 if longest < 1 << 15 else np.int32)
        for place in range(1, len(lanes)):
            lo, k = self.base[place], lanes[place]
            last = np.arange(min(place, longest), 0, -1)  # the longest last piece comes first and keeps ties
            before = self.base[place - last]
            if k < 32:
                worth = v.scores[self.pieces[last - 1, lo : lo + k]] + best[before[:, None] + np.arange(k)]
                by = np.argmax(worth, 0)
                best[lo : lo + k], self.length[lo : lo + k] = worth[by, np.arange(k)], last[by]
                continue
            top, by = best[lo : lo + k], self.length[lo : lo + k]
            top[:] = -np.inf
            for size_, b in zip(last.tolist(), before.tolist()):
                worth = v.scores[self.pieces[size_ - 1, lo : lo + k]]
                worth += best[b : b + k]
                better = worth > top
                np.copyto(top, worth, where=better)
                by[better] = size_

    def back(self, position: int) -> int:
        return position - int(self.length[self.at[position - 1]])

    def meeting(self, longest: int) -> int:
        """The boundary that the paths to all positions at which further pieces can begin have in common."""
        n = len(self.at)
        open_ = set(range(max(1, n - longest + 1), n + 1))
        while len(open_) > 1:
            last = max(open_)
            open_.discard(last)
            open_.add(self.back(last))
        return open_.pop()

    def path(self, to: int) -> tuple[np.ndarray, np.ndarray]:
        """Ends and ids of the pieces on the best path to a boundary that paths meet at."""
        out = np.full(to, -1, np.int64)
        own = np.flatnonzero(self.begin[self.order] < to)
        begin = self.begin[self.order][own]
        left = np.minimum(self.size[self.order][own], to - begin)
        while len(own):
            cell = self.base[left] + own
            length = self.length[cell]
            out[begin + left - 1] = self.pieces[length - 1, cell]
            left = left - length
            live = left > 0
            own, begin, left = own[live], begin[live], left[live]
        end = np.flatnonzero(out >= 0)
        return end + 1, out[end]


def _pieces(v: Vocabulary, c: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Starts and ids of all pieces, by length; the longest at each position (1 without any); which have one of length 1."""
    n = len(c)
    padded = np.r_[c, np.zeros(v.longest, c.dtype)]
    far, covered, found = np.ones(n, np.int64), np.zeros(n, bool), []
    node = v.base[v.root] + c
    at = np.flatnonzero(v.parent[node] == v.root)
    node = node[at]
    for k in range(v.longest):
        ids = v.id_at[node]
        hit = ids >= 0
        start = at[hit]
        found.append((start, ids[hit]))
        if k == 0:
            covered[start] = True
        far[start] = k + 1
        to = v.base[node] + padded[at + (k + 1)]
        live = v.parent[to] == node
        at, node = at[live], to[live]
        if not len(at):
            break
    return found, far, covered


def viterbi(v: Vocabulary, c: np.ndarray, window: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ends and ids of the pieces of the best segmentation of character numbers, given out as they are settled."""
    window = window or max(4 * v.longest, WINDOW_CELLS // v.longest)
    done, n, wide = 0, len(c), window
    while done < n:
        to = min(n, done + wide)
        part = Window(v, c[done:to])
        settled = to - done if to == n else part.meeting(v.longest)
        if not settled:
            wide *= 2
            continue
        end, ids = part.path(settled)
        yield done + end, ids
        done, wide = done + settled, window


def encode_texts(v: Vocabulary, texts: list[str | None], window: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after another, and where each text's begin."""
    size = np.array([len(x) + 1 if x else 0 for x in texts], np.int64)
    points = np.frombuffer("".join(MARK + x for x in texts if x).encode("utf-32-le"), np.uint32)
    points = np.where(points == 32, np.uint32(ord(MARK)), points)
    # a gap after each text, which no piece spans
    edge = np.cumsum(size + 1)
    gap = np.zeros(int(edge[-1]) if len(edge) else 0, bool)
    gap[edge - 1] = True
    every = np.full(len(gap), 0x110000, np.int64)
    every[~gap] = points
    out = [x for x in viterbi(v, v.numbers(every), window)]
    end, ids = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in out)]) for i in (0, 1))
    own = ~gap[end - 1]
    end, ids = end[own] - 1, ids[own]
    many = np.ones(len(ids), np.int64)
    bare = np.flatnonzero(ids == v.fall)
    if len(bare):  # characters without a piece
        chars, of = np.unique(every[end[bare]], return_inverse=True)
        spelt = [_fallback(v, chr(x)) for x in chars.tolist()]
        many[bare] = np.array([len(x) for x in spelt])[of]
        first = np.cumsum(many) - many
        flat = np.repeat(ids, many)
        for k, x in enumerate(spelt):
            at = first[bare[of == k]]
            for j, i in enumerate(x):
                flat[at + j] = i
        ids = flat
    count = np.bincount(np.searchsorted(edge, end, side="right"), many, minlength=len(texts)).astype(np.int64)
    return ids.astype(np.int32), np.r_[0, np.cumsum(count)].astype(np.int64)


def encode_text(v: Vocabulary, text: str, window: int | None = None) -> list[int]:
    """Ids of a whole text."""
    return encode_texts(v, [text], window)[0].tolist()


def decode_ids(v: Vocabulary, ids) -> str:
    """The text of ids; the leading space of the first piece is the one that encoding put there."""
    n = len(v.decoded)
    if len(ids) and not (0 <= min(ids) and max(ids) < n):
        ids = [i for i in ids if 0 <= i < n]
    out = b"".join(map(v.decoded.__getitem__, ids))
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def read_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model file's bytes: its size is that of a vocabulary, whatever the data."""
    if "://" not in path:
        path = "file://" + path
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode(df: DataFrame, text: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """Adds the ids as array<int>."""
    v = Vocabulary(read_model(df.sparkSession, model))
    rest = [c for c in df.columns if c != out]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, text, BLOCK):  # ids are many: a few texts at a time
            texts = table.column(text).to_pylist()
            ids, at = encode_texts(v, texts)
            null = [x is None for x in texts]
            column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pa.array(null) if any(null) else None)
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in rest), column], [*rest, out])

    return df.mapInArrow(run, df.select(rest).schema.add(out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """Adds the text of a column of ids."""
    v = Vocabulary(read_model(df.sparkSession, model))
    rest = [c for c in df.columns if c != out]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [None if x is None else decode_ids(v, [i for i in x if i is not None]) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(back, pa.string())], [*rest, out])

    return df.mapInArrow(run, df.select(rest).schema.add(out, "string"))


def piece_digest(docs: DataFrame, id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_chars, n_ids, ids_sha256 of the ids as 32-bit little-endian numbers, round_trip)."""
    v = Vocabulary(read_model(docs.sparkSession, model))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "text", BLOCK):
            texts = [x or "" for x in table.column("text").to_pylist()]
            ids, at = encode_texts(v, texts)
            parts = [ids[i:j] for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), pa.array([len(x) for x in texts], pa.int64()), pa.array(np.diff(at)), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in parts], pa.string()), pa.array([decode_ids(v, x.tolist()) == y for x, y in zip(parts, texts)], pa.bool_())],
                ["doc_id", "n_chars", "n_ids", "ids_sha256", "round_trip"],
            )

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_chars long, n_ids long, ids_sha256 string, round_trip boolean")
