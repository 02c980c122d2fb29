"""Language model scoring by a hierarchical Pitman-Yor process over words.

The model has three levels of Chinese restaurants. A leaf restaurant is a context, the two words before; its parent is
the word before, which all contexts that end in it share; all parents share the root, whose base is uniform over the
vocabulary and one slot for unknown words. A word's customers sit at a leaf's tables; each table is a customer of the
parent, each of the parent's tables one of the root. Discounts come from the numbers of words seen once and twice on
each level. There are as many restaurants as the corpus has contexts.

What is counted grows with the corpus and is never cut. Texts are read once, into blocks that hold their tokens as
numbers of the block's own words. Each block sends its words with their counts to slices by hash; a slice numbers its
words by falling count and answers with the numbers, so that what is sent from then on are small numbers in rising
order, not hashes. Blocks send, for each range of words before, their (context, word) cells with counts. A range merges
these and holds all restaurants of its words before, leaves and parents, with all their customers; the root lies in the
slices. A Gibbs sweep seats the customers of a
range anew given the root's counts of its words, one after another (those beyond the 64th of a cell in steps of at most
an eighth of the seated) and each cell given the other cells' tables of the pass before; it sends the parents' tables by
word to the root's slices, which merge and seat them and answer each range. Tables are kept from sweep to sweep. The
first seating is the least one; the sweeps after the first are kept, and each one's predictive probabilities, which use
that sweep's own tables and totals on every level, are averaged. Draws are seeded by the sweep and the range, and ranges
follow from the corpus alone, so reruns agree on any cluster.

A range answers each block with log probabilities of its own cells; only packed cells are shuffled. A document is scored
from its block's stored tokens, the base from its words' counts. Words with the same 64-bit hash count as one.

Defined cases: a null or empty text has one token, its end; without training documents all probabilities are the
base's; repeated rows are scored alike and count as often as they are there; a null id is trained on; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, blocks, bucketed, fold, mix, release, text_bytes, tidy, words, written

#: Leaves for each parent, and parents, where a caller of sample_words names no parents.
PARENTS, LEAVES = 16, 16
SWEEPS, STRENGTH, ONE_BY_ONE = 3, (1.0, 1.0, 1.0), 64
#: Text bytes of a block and of what is tokenised at once; text bytes whose cells share a range of words before.
BLOCK, PIECE, RANGE = 6 << 20, 1 << 20, 12 << 20
END = np.uint64(0x656E64)
#: Stands for what is before a text; no word and no end has this hash.
START = np.uint64(0)
#: Cells whose probabilities are computed at once.
CELLS = 1 << 18


def tokens(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token (the end is the last one of each text), hash of the word before it, tokens of each text."""
    body, offsets = text_bytes(texts)
    n = len(offsets) - 1
    body, start, end, of = words(body, offsets)
    spans = SpanHash(body)
    count = np.bincount(of, minlength=n) + 1
    at = np.arange(len(start)) + of  # an end after each text before
    word = np.full(len(start) + n, END, np.uint64)
    word[at] = spans.of(start, end) | np.uint64(1 << 63)  # the end has no such hash
    before = np.zeros(len(word), np.uint64)
    before[1:] = word[:-1]
    first = np.r_[0, np.cumsum(count)[:-1]].astype(np.int64)
    before[first[first < len(word)]] = START
    return word, before, count


def _read_block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block in rising order, the start first; the word's number of each token; tokens of each text."""
    parts = [tokens(t.column("text")) for t in blocks(iter(table.to_batches()), "text", PIECE)]
    word, _, count = (np.concatenate(x) for x in zip(*parts))
    names, of = np.unique(np.r_[START, word], return_inverse=True)
    return names, of[1:].astype(np.uint32), count.astype(np.int64)


def _groups(columns: tuple, sizes: tuple) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, each below its size, and which rows in that order are the first of their kind."""
    bits = [max(1, int(n - 1).bit_length()) for n in sizes]
    if sum(bits) <= 64:
        key = columns[0].astype(np.uint64)
        for c, b in zip(columns[1:], bits[1:]):
            key <<= np.uint64(b)
            key |= c
        order = np.argsort(key)
        columns = (key[order],)
        del key
    else:
        order = np.lexsort(columns[::-1])
        columns = tuple(c[order] for c in columns)
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return order, new


def _cells(of: np.ndarray, count: np.ndarray, start: int, n: int) -> tuple:
    """Word before, word and word before that of each cell of a block, in rising order; the order of the tokens by cells, and where each cell begins in it."""
    first = np.cumsum(count) - count  # no text is without a token
    one = np.r_[np.uint32(start), of[:-1]][: len(of)]
    one[first] = start
    two = np.r_[np.uint32(start), one[:-1]][: len(of)]
    two[first] = start
    order, new = _groups((one, of, two), (n, n, n))
    lead = order[new]
    return one[lead], of[lead], two[lead], order, new


def _size(x) -> int:
    return sum(9 + a.nbytes for a in x)


def _arrays(*x: np.ndarray) -> bytes:
    """Arrays as compressed bytes: each with its length, steps in place of rising numbers, all first bytes first, then the second ones."""
    parts = []
    for a in x:
        rising = a.dtype.kind in "iu" and len(a) > 1 and float((a[1:] >= a[:-1]).mean()) > 0.9
        steps = np.diff(a, prepend=a.dtype.type(0)) if rising else np.ascontiguousarray(a)
        parts.append(len(a).to_bytes(8, "little") + bytes([rising]) + steps.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int, *kinds) -> list[np.ndarray]:
    raw, at, out = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), 0, []
    for kind in kinds:
        n, wide = int.from_bytes(raw[at : at + 8], "little"), np.dtype(kind).itemsize
        a = np.frombuffer(raw, np.uint8, n * wide, at + 9).reshape(wide, n).T.reshape(-1).view(kind)
        out.append(np.cumsum(a, dtype=kind) if raw[at + 8] else a)
        at += 9 + n * wide
    return out


def range_of(ids: np.ndarray, ranges: int) -> np.ndarray:
    """The range that holds the restaurants of each word before."""
    return ((mix(ids) >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)


def slice_of_hash(names: np.ndarray, slices: int) -> np.ndarray:
    """The slice that numbers each word."""
    return ((names >> np.uint64(20)) % np.uint64(slices)).astype(np.int64)


def slice_of(ids: np.ndarray, slices: int) -> np.ndarray:
    """The slice that has numbered each word and holds it as part of the root."""
    return (ids % np.uint64(slices)).astype(np.int64)


_BLOCK = (np.int64, np.uint8, np.uint8, np.int64, np.uint64, np.uint32)


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks: ids and which are null, which are held out, tokens of each text, the block's words, the tokens."""
    part = TaskContext.get().partitionId()
    for k, table in enumerate(blocks(batches, "text", BLOCK)):
        names, of, count = _read_block(table)
        ids = table.column("doc_id").to_pylist()
        held = np.array(table.column("held_out").to_pylist(), np.uint8)
        x = (np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), held, count, names, of)
        yield _rows([(part << 31 | k, -1, _size(x), _arrays(*x))])


def _words(slices: int):
    """A block's words and their training counts, to the slices that number them."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                _, _, held, count, names, of = _unpack(row["payload"], row["size"], *_BLOCK)
                seen = np.bincount(of[~np.repeat(held > 0, count)], minlength=len(names)).astype(np.uint32)
                where = slice_of_hash(names, slices)
                by = np.argsort(where, kind="stable")
                edge, out = np.searchsorted(where[by], np.arange(slices + 1)), []
                for v in np.flatnonzero(edge[1:] > edge[:-1]):
                    x = tuple(a[by[edge[v] : edge[v + 1]]] for a in (names, seen))
                    out.append((row["block"], int(v), _size(x), _arrays(*x)))
                yield _rows(out)

    return run


def _number(slices: int):
    """A slice: the number of each word, by falling count, and its training count, for each block."""

    def run(pdf):
        import pandas as pd

        asked = [_unpack(p, s, np.uint64, np.uint32) for p, s in zip(pdf["payload"], pdf["size"])]
        names, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        total = np.zeros(len(names), np.uint64)
        np.add.at(total, at, np.concatenate([a[1] for a in asked]).astype(np.uint64))
        ids = np.empty(len(names), np.uint64)
        ids[np.argsort(-total.astype(np.int64), kind="stable")] = np.arange(len(names), dtype=np.uint64) * np.uint64(slices) + np.uint64(pdf["range"].iloc[0])
        out, lo = [], 0
        for b, v, a in zip(pdf["block"].tolist(), pdf["range"].tolist(), asked):
            own = at[lo : lo + len(a[0])]
            x = (ids[own], total[own])
            out.append((b, v, _size(x), _arrays(*x)))
            lo += len(own)
        release()
        return pd.DataFrame(out, columns=["block", "range", "size", "payload"])

    return run


def _numbers(names: np.ndarray, of: np.ndarray, answers: list, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The number and the training count of each of a block's words, in the order of the root's slices; the tokens and the start in that order."""
    by = np.argsort(slice_of_hash(names, slices), kind="stable")
    got = [_unpack(a["payload"], a["size"], np.uint64, np.uint64) for a in sorted(answers, key=lambda a: a["range"])]
    ids, total = np.empty(len(names), np.uint64), np.empty(len(names), np.uint64)
    ids[by], total[by] = (np.concatenate([g[i] for g in got]) for i in (0, 1))
    order = _in_slices(ids, slices)
    rank = np.empty(len(names), np.uint32)
    rank[order] = np.arange(len(names), dtype=np.uint32)
    return ids[order], total[order], rank[of], int(rank[0])


def _in_slices(ids: np.ndarray, slices: int) -> np.ndarray:
    """The order of words in which ranges and the root's slices talk of them."""
    return np.lexsort((ids, slice_of(ids, slices)))


def _by_range(ids: np.ndarray, one: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells in the order of the ranges, otherwise as they are, and where each range begins."""
    where = range_of(ids, ranges).astype(np.uint16 if ranges <= 1 << 16 else np.int64)[one]
    by = np.argsort(where, kind="stable")
    return by, np.searchsorted(where[by], np.arange(ranges + 1))


def _send(ranges: int, slices: int):
    """Blocks to the cells of each range, in rising order of word before, word and word before that."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                _, _, held, count, names, of = _unpack(row["payload"], row["size"], *_BLOCK)
                ids, _, of, start = _numbers(names, of, row["numbers"], slices)
                one, word, two, order, new = _cells(of, count, start, len(ids))
                seen = np.add.reduceat(np.repeat(held == 0, count)[order], np.flatnonzero(new), dtype=np.uint32)
                by, edge = _by_range(ids, one, ranges)
                out = []
                for r in np.flatnonzero(edge[1:] > edge[:-1]):
                    own = by[edge[r] : edge[r + 1]]
                    used, at = np.unique(np.r_[one[own], word[own], two[own]], return_inverse=True)
                    x = (ids[used], *at.astype(np.uint32).reshape(3, -1), seen[own])
                    out.append((row["block"], int(r), _size(x), _arrays(*x)))
                    if len(out) == 32:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    return run


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, payloads where they lie: a batch may hold many, and each is large."""
    for i in range(batch.num_rows):
        yield {k: c[i].as_buffer() if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else c[i].as_py() for k, c in zip(batch.schema.names, batch.columns)}


_ASKED = "block long, range long, size long, payload binary"


def _rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["block", "range", "size", "payload"])


def _merge(slices: int):
    """A range: one row with its cells, words in the order of the root's slices, and apart which cells each block asks for.

    Cells lie by parent and word, so that the leaves' cells of a parent's cell follow one another and none is looked up later.
    """

    def run(pdf):
        import pandas as pd

        most = int(pdf["size"].sum()) // 16  # four numbers a cell
        cells, used, sizes, lo, n = [np.empty(most, np.uint32) for _ in range(4)], [], [], 0, 0
        for payload, size in zip(pdf["payload"], pdf["size"]):
            own, *piece, counts = _unpack(payload, size, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32)
            for to, a in zip(cells, (*(a + np.uint32(lo) for a in piece), counts)):
                to[n : n + len(a)] = a
            used.append(own)
            sizes.append(len(counts))
            lo, n = lo + len(own), n + len(counts)
        names, inverse = np.unique(np.concatenate(used), return_inverse=True)
        order = _in_slices(names, slices)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        names, inverse = names[order], rank[inverse]
        one, of, two = (inverse[a[:n]] for a in cells[:3])
        seen, sizes = cells[3][:n], np.array(sizes, np.int64)
        del cells, used, own, piece, counts, to, a, inverse, order
        n = len(names)
        order, new = _groups((one, of, two), (n, n, n))
        lead = order[new]
        seen = np.add.reduceat(seen[order], np.flatnonzero(new), dtype=np.uint32)
        at = np.empty(len(order), np.uint32)
        at[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        one, of, two = one[lead], of[lead], two[lead]
        del order, new, lead
        is_one, held = np.zeros(n, bool), np.zeros(n, bool)
        is_one[one], held[of] = True, True
        one, of = (np.cumsum(x, dtype=np.uint32)[a] - np.uint32(1) for x, a in ((is_one, one), (held, of)))
        up = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (of[1:] != of[:-1])])
        order, new = _groups((one, two), (n, n))
        context = np.empty(len(order), np.uint32)
        context[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        leaves = np.bincount(one[order[new]]).astype(np.uint32)  # contexts of each parent
        context -= (np.cumsum(leaves, dtype=np.uint32) - leaves)[one]
        x = (names[held], of[up], one[up], np.diff(up, append=len(one)).astype(np.uint32), leaves, context, seen)
        y = (pdf["block"].to_numpy(np.int64), sizes, at)
        out = pd.DataFrame({"range": pdf["range"].iloc[:1].to_numpy(), "size": [_size(x)], "payload": [_arrays(*x)], "asked_size": [_size(y)], "asked": [_arrays(*y)]})
        del order, new, one, of, two, up, context, at, x, y
        release()
        return out

    return run


_MERGED, _CELLS = "range long, size long, payload binary, asked_size long, asked binary", (np.uint64, *6 * (np.uint32,))


def _unmerge(row: dict) -> tuple[np.ndarray, tuple, np.ndarray, np.ndarray]:
    """A range's words, the parents' cells (as _levels has them), the context and the training count of each leaf's cell."""
    names, word, parent, per, leaves, context, seen = _unpack(row["payload"], row["size"], *_CELLS)
    up = np.repeat(np.arange(len(word), dtype=np.uint32), per)
    return names, (word, parent, up), context + (np.cumsum(leaves, dtype=np.uint32) - leaves)[parent][up], seen


def seat(rng: np.random.Generator, customers: np.ndarray, share: np.ndarray, tables_else: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Tables of cells after all customers of each have sat down, one after another.

    share: the parent's probability of the word; tables_else: tables of the restaurant that serve other words.
    """
    t = (customers > 0).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    seated = np.ones(len(customers), np.int64)
    while len(live):
        i, have = seated[live], t[live]
        new = (strength + discount * (tables_else[live] + have)) * share[live]
        p = new / (new + np.maximum(i - discount * have, 1e-12))
        step = np.minimum(np.where(i < ONE_BY_ONE, 1, i // 8), customers[live] - i)
        t[live] += np.where(step == 1, rng.random(len(live)) < p, rng.binomial(step, np.clip(p, 0, 1)))
        seated[live] += step
        live = live[seated[live] < customers[live]]
    return t


class Totals:
    """Customers and tables of all restaurants on each level, discounts, and the number of words."""

    def __init__(self, customers, tables, discount, n_words):
        self.customers, self.tables, self.discount, self.n_words = customers, tables, discount, n_words

    def mass(self, level: int) -> np.ndarray:
        """What a restaurant leaves to its parent, of 1."""
        c, t, d, s = self.customers[level], self.tables[level], self.discount[level], STRENGTH[level]
        return np.where(c > 0, (s + d * t) / (s + c), 1.0)

    def own(self, level: int, customers, tables, at) -> np.ndarray:
        c = self.customers[level][at]
        return np.where(customers > 0, np.maximum(customers - self.discount[level] * tables, 0.0) / (STRENGTH[level] + np.maximum(c, 1)), 0.0)


def _levels(of: np.ndarray, context: np.ndarray, above: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parents' cells: word and parent of each, and the parent's cell of each leaf's cell."""
    parent = context // LEAVES if above is None else above[context]
    n = int(parent.max()) + 1 if len(parent) else 1
    key, up = np.unique(of.astype(np.int64) * n + parent, return_inverse=True)
    return key // n, key % n, up


def totals_of(state: tuple, context, root: tuple[int, int], discount, n_words: int) -> Totals:
    """The totals of all restaurants that a state holds whole, with the root's customers and tables."""
    c0, t0, c1, t1, _, _, _, parent, _ = state
    return Totals([_sums(context, c0), _sums(parent, c1), np.array([root[0]])], [_sums(context, t0), _sums(parent, t1), np.array([root[1]])], discount, n_words)


def sample_words(names, of, context, seen, totals: Totals | None, sweep: int, above=None, last: tuple | None = None, levels: tuple | None = None) -> tuple:
    """One sweep over cells: (customers and tables of the leaves' cells, of the parents', of the root, parents' cells).

    above: the parent of each context; last: tables of the leaves' cells and of the parents', and the root's customers
    and tables of each word, as they are. totals: the root's totals, the discounts and the number of words. Sweep 0 is
    the least seating, for which neither is read. The root's tables are not seated here. levels: the parents' cells, where
    they are known from another sweep.
    """
    n = len(names)
    word, parent, up = levels or _levels(of, context, above)
    rng = np.random.default_rng([sweep, int(names[0] & np.uint64(0xFFFFFFFF)) if n else 0, n])
    c0, live = seen, np.flatnonzero(seen > 1)  # the others have a table for each customer
    least = (c0 > 0).astype(np.uint32)
    t0 = least if last is None else last[0]
    # cells with a customer, of each parent's cell and each context: what more tables there are is added for live ones alone
    below = _sums(up, least, len(word))
    c1 = _more(below, up, live, t0)
    t1 = (c1 > 0).astype(np.uint32) if last is None else last[1]
    c2 = _sums(word, t1, n).astype(np.int64) if last is None else last[2].astype(np.int64)
    t2 = (c2 > 0).astype(np.int64) if last is None else last[3].astype(np.int64)
    if sweep == 0:
        return c0, t0, c1, t1, c2, t2, word, parent, up
    root = totals.own(2, c2, t2, np.zeros(n, int)) + totals.mass(2)[0] / (totals.n_words + 1)
    inside = _sums(context, least)
    for _ in range(2):
        now = Totals([None, _sums(parent, c1), None], [_more(inside, context, live, t0), _sums(parent, t1), None], totals.discount, totals.n_words)
        k, x = up[live], context[live]
        mid = now.own(1, c1[k], t1[k], parent[k]) + now.mass(1)[parent[k]] * root[word[k]]
        had, t0 = t0[live].astype(np.int64), least.copy()
        t0[live] = seat(rng, c0[live].astype(np.int64), mid, now.tables[0][x] - had, now.discount[0], STRENGTH[0])
        c1 = _more(below, up, live, t0)
        k = np.flatnonzero(c1 > 1)
        had, t1 = t1[k].astype(np.int64), (c1 > 0).astype(np.uint32)
        t1[k] = seat(rng, c1[k].astype(np.int64), root[word[k]], now.tables[1][parent[k]] - had, now.discount[1], STRENGTH[1])
    return c0, t0, c1, t1, c2, t2, word, parent, up


def _sums(of: np.ndarray, what: np.ndarray, n: int | None = None) -> np.ndarray:
    """Sums of what by of, a part of the rows at a time: np.bincount makes 16 bytes of each row."""
    n = (int(of.max()) + 1 if len(of) else 0) if n is None else n
    out, step = np.zeros(n, np.uint32), max(CELLS, n // 4)
    for i in range(0, len(of), step):
        k = slice(i, i + step)
        lo = int(of[k].min())
        some = np.bincount(of[k] - of.dtype.type(lo), what[k])
        out[lo : lo + len(some)] += some.astype(np.uint32)
    return out


def _more(least: np.ndarray, of: np.ndarray, live: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Sums of the cells' tables, given the sums where each cell with customers has one."""
    out = least.copy()
    np.add.at(out, of[live], tables[live].astype(np.uint32) - np.uint32(1))
    return out


def predictive(state: tuple, context, totals: Totals) -> np.ndarray:
    """Probability of each leaf's cell's word in its context."""
    c0, t0, c1, t1, c2, t2, word, parent, up = state
    root = totals.own(2, c2, t2, np.zeros(len(c2), int)) + totals.mass(2)[0] / (totals.n_words + 1)
    mass, mid, p = (totals.mass(0), totals.mass(1)), np.empty(len(c1)), np.empty(len(c0))
    for k in (slice(i, i + CELLS) for i in range(0, len(c1), CELLS)):
        mid[k] = totals.own(1, c1[k], t1[k], parent[k]) + mass[1][parent[k]] * root[word[k]]
    for k in (slice(i, i + CELLS) for i in range(0, len(c0), CELLS)):
        p[k] = totals.own(0, c0[k], t0[k], context[k]) + mass[0][context[k]] * mid[up[k]]
    return p


_SENT = "sweep long, range long, slice long, size long, payload binary"
_STATE, _STATS = -1, -2


def _sent(sweep: int, rows: list) -> list:
    """(range, slice, arrays) as rows of _SENT."""
    return [(sweep, r, v, _size(x), _arrays(*x)) for r, v, x in rows]


def _last(got: list, sweep: int, cells: tuple) -> tuple:
    """What a sweep left for a range: tables of the leaves' cells and of the parents'; the root's customers and tables of each word."""
    (_, (word, _, up), _, seen), got = cells, [g for g in got if g["sweep"] == sweep]
    more0, more1 = next(_unpack(g["payload"], g["size"], np.uint32, np.uint32) for g in got if g["slice"] == _STATE)
    t0 = (seen > 0).astype(np.uint32)
    t0[seen > 1] = more0
    c1 = _sums(up, t0, len(word))
    t1 = (c1 > 0).astype(np.uint32)
    t1[c1 > 1] = more1
    root = [_unpack(g["payload"], g["size"], np.uint32, np.uint32) for g in sorted(got, key=lambda g: g["slice"]) if g["slice"] >= 0]
    return (t0, t1, *(np.concatenate([x[i] for x in root]) for i in (0, 1)))


def _sweep(slices: int, sweep: int, totals: Totals | None):
    """Seats a range's customers: its state, what it asks of each slice of the root, cells with one and two customers and all customers."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                cells = names, levels, context, seen = _unmerge(row)
                last = _last(row["got"], sweep - 1, cells) if sweep else None
                c0, t0, c1, t1, _, _, word, _, _ = sample_words(names, None, context, seen, totals, sweep, None, last, levels)
                up = _sums(word, t1, len(names))
                stats = np.array([(c0 == 1).sum(), (c0 == 2).sum(), (c1 == 1).sum(), (c1 == 2).sum(), c0.sum(dtype=np.int64)], np.int64)
                out = [(row["range"], _STATE, (t0[c0 > 1].astype(np.uint32), t1[c1 > 1].astype(np.uint32))), (row["range"], _STATS, (stats,))]
                edge = np.searchsorted(slice_of(names, slices), np.arange(slices + 1))
                out += [(row["range"], int(v), (names[a:b], up[a:b])) for v, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
                yield from _packed(_sent(sweep, out))

    return run


def _packed(rows: list) -> Iterator[pa.RecordBatch]:
    kinds = [(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in _SENT.split(", ")]
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows[i : i + 64]), kinds)], [c for c, _ in kinds])


def _root(sweep: int, totals: Totals | None):
    """A slice of the root: seats what the ranges send, answers each range, and sums customers and tables."""

    def run(pdf):
        import pandas as pd

        asked = [_unpack(p, s, np.uint64, np.uint32) for p, s in zip(pdf["payload"], pdf["size"])]
        names, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        c = np.bincount(at, np.concatenate([a[1] for a in asked]).astype(float), minlength=len(names)).astype(np.int64)
        t = (c > 0).astype(np.int64)
        if sweep:
            rng = np.random.default_rng([sweep, int(names[0] & np.uint64(0xFFFFFFFF)), len(names)])
            t = seat(rng, c, np.full(len(c), 1 / (totals.n_words + 1)), np.maximum(totals.tables[2][0] - t, 0), totals.discount[2], STRENGTH[2])
        v, out, lo = int(pdf["slice"].iloc[0]), [], 0
        for r, a in zip(pdf["range"].tolist(), asked):
            own = at[lo : lo + len(a[0])]
            out.append((r, v, tuple(x[own].astype(np.uint32) for x in (c, t))))
            lo += len(own)
        out.append((-1, _STATS, (np.array([(c == 1).sum(), (c == 2).sum(), c.sum(), t.sum(), (c > 0).sum()], np.int64),)))
        release()
        return pd.DataFrame(_sent(sweep, out), columns=[c.split()[0] for c in _SENT.split(", ")])

    return run


def _stats(sent: DataFrame) -> np.ndarray:
    """A handful of numbers of each range or slice, summed."""
    return sum((_unpack(r["payload"], r["size"], np.int64)[0] for r in sent.filter(F.col("slice") == _STATS).toLocalIterator()), np.zeros(5, np.int64))


def _with(merged: DataFrame, sent: list[DataFrame], files: int) -> DataFrame:
    """The ranges, each with what sweeps left for it."""
    rows = sent[0]
    for s in sent[1:]:
        rows = rows.unionByName(s)
    # dealt as the bucketed table is, so that grouping and joining share one shuffle
    got = rows.repartition(files, "range").groupBy("range").agg(F.collect_list(F.struct("sweep", "slice", "size", "payload")).alias("got"))
    return merged.join(got.hint("shuffle_hash"), "range", "left")


def _answer(kept: list[tuple[int, Totals]]):
    """A range: log10 probabilities of the cells each block asked for."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                cells = names, levels, context, seen = _unmerge(row)
                p = np.zeros(len(seen))
                for sweep, totals in kept:
                    last = _last(row["got"], sweep, cells)
                    state = sample_words(names, None, context, seen, None, 0, None, last, levels)
                    own = totals_of(state, context, (totals.customers[2][0], totals.tables[2][0]), totals.discount, totals.n_words)
                    p += predictive(state, context, own)
                log = np.log10(p / len(kept)).astype(np.float32)
                del cells, levels, context, seen, last, state, own, p
                block, sizes, at = _unpack(row["asked"], row["asked_size"], np.int64, np.int64, np.uint32)
                rows, lo = [], 0
                for b, n in zip(block.tolist(), sizes.tolist()):
                    x = (log[at[lo : lo + n]],)
                    rows.append((b, row["range"], _size(x), _arrays(*x)))
                    lo += n
                for i in range(0, len(rows), 64):
                    yield _rows(rows[i : i + 64])

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(ranges: int, slices: int, n_tokens: int, n_words: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                ids, null, held, count, names, of = _unpack(row["payload"], row["size"], *_BLOCK)
                number, total, of, start = _numbers(names, of, row["numbers"], slices)
                seen = total[of]
                base = np.log10((total.astype(float) + 0.5) / (n_tokens + 0.5 * (n_words + 1)))[of]
                one, _, _, order, new = _cells(of, count, start, len(number))
                log = np.empty(len(one), np.float32)  # ranges answer in their order, as they were asked
                log[_by_range(number, one, ranges)[0]] = np.concatenate([_unpack(a["payload"], a["size"], np.float32)[0] for a in sorted(row["answers"], key=lambda a: a["range"])])
                scores = np.empty(len(of))
                scores[order] = log[np.cumsum(new) - 1]
                of_text = np.repeat(np.arange(len(ids)), count)
                sum_ = lambda x: np.bincount(of_text, x, minlength=len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=null > 0), pa.array(held > 0), pa.array(count), pa.array(sum_((seen > 0).astype(float)).astype(np.int64)), pa.array(np.full(len(ids), n_tokens)), pa.array(sum_(base)), pa.array(sum_(scores))],
                    [x.split()[0] for x in _SCORED.split(", ")],
                )

    return run


def _by_block(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("block").agg(F.collect_list(F.struct("range", "size", "payload")).alias(name)).hint("shuffle_hash")


def score_corpus(docs: DataFrame, is_held: Column, id: str = "doc_id", text: str = "text", sweeps: int = SWEEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document; learns from the others than is_held (of doc_id) marks."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).select("doc_id", F.coalesce(is_held, F.lit(False)).alias("held_out"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(max(1, np.ceil(size / RANGE)))  # by the data alone, so that draws do not depend on the cluster
    files = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slices = max(1, ranges // 4)
    counted = bucketed(rows.mapInArrow(_read, _ASKED), "tokens", "block", files)
    numbers = bucketed(counted.mapInArrow(_words(slices), _ASKED).groupBy("range").applyInPandas(_number(slices), _ASKED), "numbers", "block", files)
    own = counted.select("block", "size", "payload").join(_by_block(numbers, "numbers"), "block")
    merged = bucketed(own.mapInArrow(_send(ranges, slices), _ASKED).groupBy("range").applyInPandas(_merge(slices), _MERGED), "ranges", "range", files)
    cells = merged.select("range", "size", "payload")
    totals, kept, sent, discount = None, [], [], (0.5, 0.5, 0.5)
    n_tokens = n_words = 0
    for sweep in range(sweeps + 1):
        state = written((_with(cells, sent, files) if sweep else cells).mapInArrow(_sweep(slices, sweep, totals), _SENT), "state")
        root = written(state.filter("slice >= 0").groupBy("slice").applyInPandas(_root(sweep, totals), _SENT), "root")
        below, top = _stats(state), _stats(root)
        if not sweep:
            n_tokens, n_words = int(below[4]), int(top[4])
            discount = tuple(min(0.95, max(0.05, float(a) / max(1.0, float(a + 2 * b)))) for a, b in (below[:2], below[2:4], top[:2]))
        totals = Totals([None, None, np.array([top[2]])], [None, None, np.array([top[3]])], discount, n_words)
        sent = [state.filter(F.col("slice") == _STATE), root.filter("range >= 0")]
        kept.append((sweep, totals, sent))
        if not n_tokens:
            break
    kept = kept[2:] or kept[-1:]
    answers = _with(merged, [x for k in kept for x in k[2]], files).mapInArrow(_answer([k[:2] for k in kept]), _ASKED).repartition(files, "block")
    return own.join(_by_block(answers, "answers"), "block").mapInArrow(_score(ranges, slices, n_tokens, n_words), _SCORED)


def language_model(docs: DataFrame, mod: int = 5, held: int = 1) -> DataFrame:
    return score_corpus(docs, fold("doc_id", mod) == held)
