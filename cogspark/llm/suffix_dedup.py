"""Removal of long repeated strings by a sparse suffix array that Spark partitions by range.

Suffixes begin at anchors: of the GRAM-byte strings that begin in a window, the one with the least hash. A window of
`length` bytes holds its anchor whole and the choice depends on nothing else, so equal windows have equal anchors at
the same place in them; all windows of a text fall into runs that share an anchor, about one in 60 bytes.

Round 1 sorts the anchored suffixes. Splitters sampled from the leading tokens (8 bytes) cut their order into
ranges; a range sorts its suffixes by multikey quicksort, leading token first, then a fingerprint of the next GRAM
bytes, and compares neighbours. Suffixes that compare equal lie in one range: a splitter is a token, and a token so
frequent that several splitters equal it is dealt over their ranges by fingerprint, so no comparison has to look
over a range's edge. An anchor that stands alone settles its windows (none repeats); one whose every occurrence has
the same surroundings, up to the ends of its outermost windows, settles them too (all repeat). Round 2 sorts the
windows of the other anchors in the same way, by leading token and a fingerprint of all `length` bytes.

Texts are packed into blocks once, in a bucketed table of the shared folder; only fingerprints are shuffled. A block
sends one record for each different suffix, however often it holds it, so frequent lines and groups of copies cost a
record a block. Equal 8 leading bytes and equal 64-bit fingerprints count as equal strings.

Defined cases: null texts are empty; texts shorter than `length` bytes are kept whole; a text that repeats as a
whole, or a row that does, is removed in all its copies; an empty table gives an empty result; a text longer than a
segment is worked on segment by segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, blocks, bucketed, parts_for, release, text_bytes, tidy, written

LENGTH, GRAM = 200, 64
#: Text bytes in a block and in a segment of it, and text bytes whose suffixes share a
#: range (more as the whole grows, so that a block's part of a range does not get tiny); segments fit a core's cache.
BLOCK, SEGMENT, RANGE, RANGE_MOST = 2 << 20, (1 << 18) - 4096, 16 << 20, 128 << 20
#: Quantiles of the leading tokens that the splitters come from, and tokens sampled from each block.
QUANTILES, SAMPLED = 4096, 512
UNIQUE, SAME, MIXED = 0, 1, 2


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Order by the words, first word first: each further word sorts only what is still tied."""
    order = np.argsort(words[0], kind="quicksort")
    sorted_ = words[0][order]
    group = np.zeros(len(order), np.int64)
    np.cumsum(sorted_[1:] != sorted_[:-1], out=group[1:])
    for w in words[1:]:
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        part = order[at]
        again = np.lexsort((w[part], group[at]))
        order[at] = part[again]
        x = w[order]
        new = np.zeros(len(order), np.int64)
        new[1:] = (group[1:] != group[:-1]) | (x[1:] != x[:-1])
        group = np.cumsum(new)
    return order


def _groups(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by both, where each group of equals begins in it, and the group of each element."""
    order = multikey_order([first, second])
    f, s = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


def _leading(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number that sorts as they do."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | body[at + i].astype(np.uint64)
    return out


def _segments(n: int, length: int) -> Iterator[tuple[int, int]]:
    for lo in range(0, max(0, n - length + 1), SEGMENT):
        yield lo, min(n, lo + SEGMENT + length - 1)


def _whole_windows(offsets: np.ndarray, n: int, length: int) -> np.ndarray:
    """Where a window begins that lies in one text."""
    edge = np.zeros(n + 1, np.int32)
    ends, begins = offsets[1:], offsets[:-1]
    np.add.at(edge, np.maximum(begins, ends - length + 1), 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge, dtype=np.int32)[:n] == 0


class Runs:
    """The runs of windows of a block that share an anchor: first and last window, leading token, fingerprints."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, length: int):
        self.body, self.length = body, length
        found = []
        n, wide = len(body), length - GRAM + 1
        ok = _whole_windows(offsets, n, length)
        for lo, hi in _segments(n, length):
            part = body[lo:hi]
            spans = SpanHash(part)
            at = np.arange(len(part) - GRAM + 1)
            gram = spans.of(at, at + GRAM)
            x, size = (gram & np.uint64(0xFFFFFFFFFF800000)) | at.astype(np.uint64), 1
            while size * 2 <= wide:
                x, size = np.minimum(x[:-size], x[size:]), size * 2
            if wide > size:
                x = np.minimum(x[: len(x) - (wide - size)], x[wide - size :])
            anchor = (x & np.uint64(0x7FFFFF)).astype(np.int64)
            start = np.flatnonzero(ok[lo : lo + len(anchor)])
            if not len(start):
                continue
            anchor = anchor[start]
            cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)) + 1
            first, last, a = start[np.r_[0, cut]], start[np.r_[cut - 1, len(start) - 1]], anchor[np.r_[0, cut]]
            around = spans.of(first, last + length) ^ ((a - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((last - first).astype(np.uint64) << np.uint64(40))
            found.append((first + lo, last + lo, _leading(part, a), gram[a], around))
        join = lambda i, kind: np.concatenate([x[i] for x in found]) if found else np.zeros(0, kind)
        self.first, self.last = join(0, np.int64), join(1, np.int64)
        self.token, self.gram, self.around = join(2, np.uint64), join(3, np.uint64), join(4, np.uint64)
        order, starts, self.group = _groups(self.token, self.gram)
        self.tokens, self.grams = self.token[order][starts], self.gram[order][starts]
        if len(starts):
            count = np.diff(np.r_[starts, len(order)])
            around = self.around[order]
            self.surround = around[starts]
            differ = np.minimum.reduceat(around, starts) != np.maximum.reduceat(around, starts)
            self.state = np.where(differ, 3, np.where(count > 1, 2, 1)).astype(np.uint8)
        else:
            self.surround, self.state = np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def windows(self, verdict: np.ndarray) -> None:
        """The windows that round 2 has to settle: one run for each different surrounding of a mixed anchor."""
        mixed = np.flatnonzero(verdict[self.group] == MIXED) if len(self.group) else np.zeros(0, np.int64)
        _, one, self.same, count = np.unique(self.around[mixed], return_index=True, return_inverse=True, return_counts=True)
        self.mixed, keep = mixed, mixed[one]
        by = np.argsort(keep)
        keep, many = keep[by], (count > 1)[by]
        self.place = np.empty(len(by), np.int64)  # of a surrounding among the kept runs
        self.place[by] = np.arange(len(by))
        size = self.last[keep] - self.first[keep] + 1
        self.begin = np.r_[0, np.cumsum(size)].astype(np.int64)
        at = np.repeat(self.first[keep] - self.begin[:-1], size) + np.arange(self.begin[-1])
        print_ = np.zeros(len(at), np.uint64)
        for lo, hi in _segments(len(self.body), self.length):
            i, j = np.searchsorted(at, (lo, min(lo + SEGMENT, hi)))
            if j > i:
                print_[i:j] = SpanHash(self.body[lo:hi]).of(at[i:j] - lo, at[i:j] - lo + self.length)
        token = _leading(self.body, at)
        order, starts, self.window = _groups(token, print_)
        twice = np.repeat(many, size)[order]
        self.w_tokens, self.w_prints = token[order][starts], print_[order][starts]
        if len(starts):
            self.w_state = np.where((np.diff(np.r_[starts, len(order)]) > 1) | np.maximum.reduceat(twice, starts), 2, 1).astype(np.uint8)
        else:
            self.w_state = np.zeros(0, np.uint8)

    def covered(self, verdict: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Which bytes repeated windows cover. repeats: of the windows' groups."""
        n = len(self.body)
        hit = np.zeros(n + 1, np.int32)
        whole = np.flatnonzero(verdict[self.group] == SAME) if len(self.group) else np.zeros(0, np.int64)
        hit[self.first[whole]] += 1  # no two runs have the same first window
        hit[self.last[whole] + self.length] -= 1
        if len(self.mixed):
            size = self.last[self.mixed] - self.first[self.mixed] + 1
            begin = np.r_[0, np.cumsum(size)].astype(np.int64)
            step = np.arange(begin[-1])
            at = np.repeat(self.first[self.mixed] - begin[:-1], size) + step
            of = np.repeat(self.begin[self.place[self.same]] - begin[:-1], size) + step
            at = at[repeats[self.window[of]]]
            hit[at] += 1
            hit[at + self.length] -= 1
        return np.cumsum(hit, dtype=np.int32)[:n] > 0


def _range_of(token: np.ndarray, print_: np.ndarray, splitters: np.ndarray, deal: int) -> np.ndarray:
    lo, hi = np.searchsorted(splitters, token, "left"), np.searchsorted(splitters, token, "right")
    mixed = print_ ^ (print_ >> np.uint64(29))
    return (lo + (mixed % (hi - lo + 1).astype(np.uint64)).astype(np.int64)) * deal + ((mixed >> np.uint64(20)) % np.uint64(deal)).astype(np.int64)


def _pack(token: np.ndarray, *rest: np.ndarray) -> bytes:
    step = pa.compress(np.diff(token, prepend=np.uint64(0)).astype(np.uint64).tobytes(), codec="zstd", asbytes=True)
    return len(token).to_bytes(8, "little") + len(step).to_bytes(8, "little") + step + b"".join(x.tobytes() for x in rest)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    n, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    out = [np.cumsum(np.frombuffer(pa.decompress(data[16 : 16 + size], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint64), dtype=np.uint64)]
    at = 16 + size
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _chunks(block: int, where: np.ndarray, token: np.ndarray, *rest: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(where, kind="stable")
    found, begin = np.unique(where[order], return_index=True)
    for r, lo, hi in zip(found, begin, [*begin[1:], len(order)]):
        at = order[lo:hi]
        yield block, int(r), _pack(token[at], *(x[at] for x in rest))


def _spread(where: np.ndarray, answers: list) -> np.ndarray:
    """What the ranges answered, in the order of the elements that asked."""
    out = np.zeros(len(where), np.uint8)
    order = np.argsort(where, kind="stable")
    found, begin = np.unique(where[order], return_index=True)
    got = {a["range"]: a["answer"] for a in answers or ()}
    for r, lo, hi in zip(found, begin, [*begin[1:], len(order)]):
        out[order[lo:hi]] = np.frombuffer(got[int(r)], np.uint8)
    return out


def _settle(kinds, judge):
    """A range: sorts what the blocks sent, compares neighbours, and answers each block."""

    def run(pdf):
        import pandas as pd

        chunks = [_unpack(x, *kinds) for x in pdf["payload"]]
        size = [len(c[0]) for c in chunks]
        every = [np.concatenate([c[i] for c in chunks]) for i in range(len(kinds) + 1)]
        order, starts, group = _groups(every[0], every[1])
        answer = judge(starts, np.diff(np.r_[starts, len(order)]), *(x[order] for x in every[2:]))[group].astype(np.uint8)
        del every, order, group
        release()
        return pd.DataFrame({"block": pdf["block"], "range": pdf["range"], "answer": [x.tobytes() for x in np.split(answer, np.cumsum(size)[:-1])]})

    return run


def _judge_anchor(starts, count, state, around):
    lone = (count == 1) & (state[starts] == 1)
    mixed = (np.maximum.reduceat(state, starts) == 3) | (np.minimum.reduceat(around, starts) != np.maximum.reduceat(around, starts))
    return np.where(lone, UNIQUE, np.where(mixed, MIXED, SAME))


def _judge_window(starts, count, state):
    return (count > 1) | (np.maximum.reduceat(state, starts) == 2)


def _sample(length: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = text_bytes(batch.column(0))
            at = np.arange(0, max(0, len(body) - length), max(1, len(body) // SAMPLED))
            token = (_leading(body, at) ^ np.uint64(1 << 63)).view(np.int64)
            size = np.zeros(len(token) + 1, np.int64)
            size[-1] = len(body)
            yield pa.RecordBatch.from_arrays([pa.array([*token.tolist(), None], pa.int64()), pa.array(size)], ["token", "size"])

    return run


def _pack_blocks(text: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, options = TaskContext.get().partitionId(), pa.ipc.IpcWriteOptions(compression="zstd")
        for i, table in enumerate(blocks(batches, text, BLOCK)):
            to = pa.BufferOutputStream()
            with pa.ipc.new_stream(to, table.schema, options=options) as w:
                w.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([part << 31 | i], pa.int64()), pa.array([to.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    return run


def _rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def keep_unique(docs: DataFrame, emit, schema, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Runs both rounds; emit(table, body, offsets, covered) makes the rows of a block, of the given schema."""
    spark = docs.sparkSession
    quantiles = ",".join(f"{i / QUANTILES:.8g}d" for i in range(1, QUANTILES))
    seen = docs.select(text).mapInArrow(_sample(length), "token long, size long").agg(F.sum("size").alias("size"), F.expr(f"percentile_approx(token, array({quantiles}), 50000)").alias("tokens")).first()
    n = parts_for(spark, seen["size"] or 0, min(RANGE_MOST, max(RANGE, 128 * (seen["size"] or 0) ** 0.5)))
    deal = -(-n // QUANTILES)
    tokens = (np.array(seen["tokens"] or [], np.int64).view(np.uint64)) ^ np.uint64(1 << 63)
    splitters = tokens[np.linspace(0, len(tokens) - 1, min(n, QUANTILES) - 1).astype(int)] if len(tokens) else tokens
    n_files = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = bucketed(docs.mapInArrow(_pack_blocks(text), "block long, rows binary"), "suffix_blocks", "block", n_files)
    part = lambda df, kinds, judge: written(df.groupBy("range").applyInPandas(_settle(kinds, judge), "block long, range long, answer binary"), "suffix_answers")

    def runs(data: bytes):
        table = _rows(data)
        body, offsets = text_bytes(table.column(text))
        return table, body, offsets, Runs(body, offsets, length)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["block", "range", "payload"])

    @tidy
    def anchors(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = runs(data)[3]
                if rows := list(_chunks(block, _range_of(r.tokens, r.grams, splitters, deal), r.tokens, r.grams, r.state, r.surround)):
                    yield batch_of(rows)

    asked = "block long, range long, payload binary"
    first = part(packed.mapInArrow(anchors, asked), (np.uint64, np.uint8, np.uint64), _judge_anchor)
    # dealt as the bucketed table is, so that grouping and joining share one shuffle
    by_block = lambda df, name: df.repartition(n_files, "block").groupBy("block").agg(F.collect_list(F.struct("range", "answer")).alias(name))
    with_first = packed.join(by_block(first, "first").hint("shuffle_hash"), "block", "left")

    @tidy
    def windows(batches):
        for batch in batches:
            for block, data, answers in zip(*(batch.column(i).to_pylist() for i in range(3))):
                r = runs(data)[3]
                r.windows(_spread(_range_of(r.tokens, r.grams, splitters, deal), answers))
                if rows := list(_chunks(block, _range_of(r.w_tokens, r.w_prints, splitters, deal), r.w_tokens, r.w_prints, r.w_state)):
                    yield batch_of(rows)

    second = part(with_first.mapInArrow(windows, asked), (np.uint64, np.uint8), _judge_window)
    both = with_first.join(by_block(second, "second").hint("shuffle_hash"), "block", "left")

    @tidy
    def last(batches):
        for batch in batches:
            for data, one, two in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                table, body, offsets, r = runs(data)
                verdict = _spread(_range_of(r.tokens, r.grams, splitters, deal), one)
                r.windows(verdict)
                repeats = _spread(_range_of(r.w_tokens, r.w_prints, splitters, deal), two) > 0
                yield from emit(table, body, offsets, r.covered(verdict, repeats))

    return both.mapInArrow(last, schema)


def _kept(body: np.ndarray, offsets: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that stay and the offset of each text in them."""
    stay = np.r_[0, np.cumsum(~covered)].astype(np.int64)
    return body[~covered], stay[offsets]


def repeat_digest(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""

    def emit(table, body, offsets, covered):
        start = covered.copy()
        inner = np.ones(len(covered), bool)
        inner[offsets[:-1][offsets[:-1] < len(covered)]] = False
        start[1:] &= ~(covered[:-1] & inner[1:])
        spans = np.r_[0, np.cumsum(start)].astype(np.int64)
        left, at = _kept(body, offsets, covered)
        left = left.tobytes()
        size, kept = np.diff(offsets), np.diff(at)
        yield pa.RecordBatch.from_arrays(
            [table.column(0).combine_chunks().cast(pa.int64()), pa.array(size), pa.array(size - kept), pa.array(np.diff(spans[offsets])), pa.array([hashlib.sha256(left[i:j]).hexdigest() for i, j in zip(at[:-1], at[1:])])],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    narrow = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return keep_unique(narrow, emit, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", "text", length)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, n_chars: str | None = "n_chars") -> DataFrame:
    """The rows with what stays of each text; characters that lose some of their bytes go whole. n_chars is counted anew."""
    names, schema = docs.columns, docs.schema

    def emit(table, body, offsets, covered):
        left, at = _kept(body, offsets, covered)
        left = left.tobytes()
        new = [left[i:j].decode("utf-8", "ignore") for i, j in zip(at[:-1], at[1:])]
        null = table.column(text).is_null().to_pylist()
        columns = []
        for c in names:
            old = table.column(c).combine_chunks()
            if c == text:
                old = pa.array([None if x else y for x, y in zip(null, new)], old.type)
            elif c == n_chars:
                old = pa.array([None if x else len(y) for x, y in zip(null, new)], old.type)
            columns.append(old)
        yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=2000)

    return keep_unique(docs, emit, schema, text, length)
