"""Product quantisation by Lloyd's rounds with the filtering algorithm.

Vectors become whole numbers and are cut into parts; each part position has a
codebook.  Every partition of the vectors builds a kd-tree over its parts, whose
nodes hold the bounding box, the sum and the count of what lies below them.
Entries go down the tree: at a node, the entry nearest to the box's middle beats
each entry that is farther from it over all the box, and where one entry is left
the whole subtree is its own at once.  What reaches a leaf is compared with the
entries that are left there.  Spark adds up sums and counts by part and entry;
the codebooks, of a fixed size, are all that comes to the driver.

Trees go down a level at a time in arrays, all nodes of the level together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsight.llm.common import checkpoint, record_of

#: Components are held within this, so that squared distances fit 64 bits; it is a million in the input.
MOST = 1 << 28
LEAF = 16
#: Vectors of a tree at most; a partition of more builds several.
TREE_ROWS = 65_536
#: Narrow tables are broadcast up to so many rows, which are counted first.
BROADCAST_ROWS = 200_000


@dataclass
class Tree:
    """Points in tree order with their first rows; for each level, the nodes' starts, ends, boxes and sums."""

    order: np.ndarray
    points: np.ndarray
    starts: list[np.ndarray]
    ends: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]


def build(points: np.ndarray) -> Tree:
    """A kd-tree that halves its nodes at the median of their widest side, down to LEAF points."""
    n = len(points)
    order = np.arange(n)
    starts, ends = np.zeros(1, np.int64), np.full(1, n, np.int64)
    tree = Tree(order, points, [], [], [], [], [])
    while True:
        own = points[order]
        low, high = np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)
        tree.starts.append(starts)
        tree.ends.append(ends)
        tree.low.append(low)
        tree.high.append(high)
        tree.sums.append(np.add.reduceat(own, starts))
        if (ends - starts).max() <= LEAF:
            break
        # within each node, points in the order of its widest side; halves of it are the next level's nodes
        node = np.repeat(np.arange(len(starts)), ends - starts)
        side = np.argmax(high - low, axis=1)[node]
        order = order[np.lexsort((own[np.arange(n), side], node))]
        middle = (starts + ends + 1) // 2
        starts = np.stack([starts, middle], axis=1).ravel()
        ends = np.stack([middle, ends], axis=1).ravel()
        keep = ends > starts
        starts, ends = starts[keep], ends[keep]
    # a child's place is known by its points, so levels need no links; leaves are the last level
    tree.order, tree.points = order, points[order]
    return tree


def _nearest(middle2: np.ndarray, entries: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of the entries left at each node, the one nearest to the box's middle (given twice as large), the lower of equals."""
    far = ((2 * entries[None] - middle2[:, None]) ** 2).sum(axis=2)
    return np.argmin(np.where(left, far, np.iinfo(np.int64).max), axis=1)


def _filter(low: np.ndarray, high: np.ndarray, entries: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which entries stay: those nearer than the best one to some place of the box, or as near and of a lower index."""
    best = _nearest(low + high, entries, left)
    z, best_z = entries[None], entries[best][:, None]
    corner = np.where(z > best_z, high[:, None], low[:, None])
    margin = ((z - corner) ** 2).sum(axis=2) - ((best_z - corner) ** 2).sum(axis=2)
    index = np.arange(len(entries))[None]
    stays = (margin < 0) | ((margin == 0) & (index < best[:, None])) | (index == best[:, None])
    return left & stays


def assign(tree: Tree, entries: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the tree's points (in tree order), and sums and counts by entry."""
    n, k = len(tree.points), len(entries)
    code = np.zeros(n, np.int64)
    sums, counts = np.zeros_like(entries), np.zeros(k, np.int64)
    open_starts, left = tree.starts[0], np.ones((1, k), bool)
    for level, (starts, ends) in enumerate(zip(tree.starts, tree.ends, strict=True)):
        at = np.searchsorted(starts, open_starts)
        kept = np.concatenate([_filter(tree.low[level][at[i : i + block]], tree.high[level][at[i : i + block]], entries, left[i : i + block]) for i in range(0, len(at), block)])
        alone = kept.sum(axis=1) == 1
        if alone.any():
            # whole subtrees, by their cached sums and counts
            won, nodes = np.argmax(kept[alone], axis=1), at[alone]
            sizes = ends[nodes] - starts[nodes]
            np.add.at(sums, won, tree.sums[level][nodes])
            np.add.at(counts, won, sizes)
            code[_ranges(starts[nodes], sizes)] = np.repeat(won, sizes)
        nodes, kept = at[~alone], kept[~alone]
        if not len(nodes):
            return code, sums, counts
        if level + 1 == len(tree.starts):
            break
        below = tree.starts[level + 1]
        first, last = np.searchsorted(below, starts[nodes]), np.searchsorted(below, ends[nodes])
        open_starts, left = below[_ranges(first, last - first)], np.repeat(kept, last - first, axis=0)
    starts, ends = tree.starts[-1][nodes], tree.ends[-1][nodes]
    for i in range(0, len(nodes), block):
        sizes = ends[i : i + block] - starts[i : i + block]
        points = _ranges(starts[i : i + block], sizes)
        row, entry = np.nonzero(np.repeat(kept[i : i + block], sizes, axis=0))
        far = ((tree.points[points[row]] - entries[entry]) ** 2).sum(axis=1)
        # the nearest of each point's entries, the lower of equals
        order = np.lexsort((entry, far, row))
        first = order[np.unique(row[order], return_index=True)[1]]
        code[points] = entry[first]
        np.add.at(sums, entry[first], tree.points[points])
        np.add.at(counts, entry[first], 1)
    return code, sums, counts


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(vectors * scale), -MOST, MOST).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A partition's rows, up to TREE_ROWS together, and their whole numbers."""
    held: list[pa.RecordBatch] = []

    def take() -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        vectors = rows.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return rows, whole_numbers(vectors.reshape(rows.num_rows, -1), scale)

    for batch in batches:
        for i in range(0, batch.num_rows, TREE_ROWS):
            held.append(batch.slice(i, TREE_ROWS))
            if sum(x.num_rows for x in held) >= TREE_ROWS:
                yield take()
                held.clear()
    if held:
        yield take()


def _cuts(width: int, parts: int) -> list[slice]:
    """Equal consecutive parts; where width can't be divided, the first ones are one longer."""
    at = [len(x) for x in np.array_split(np.arange(width), parts)]
    ends = np.cumsum(at).tolist()
    return [slice(e - n, e) for e, n in zip(ends, at, strict=True)]


def _round(books: list[np.ndarray], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [(np.zeros_like(b), np.zeros(len(b), np.int64)) for b in books]
        for _, x in _chunks(batches, scale):
            for cut, book, (sums, counts) in zip(_cuts(x.shape[1], len(books)), books, totals, strict=True):
                _, s, c = assign(build(x[:, cut]), book)
                sums += s
                counts += c
        rows = [(p, e, int(c), s[e].tolist()) for p, (s, counts) in enumerate(totals) for e, c in enumerate(counts) if c]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "entry", "n", "sums"])

    return run


def _codes(books: list[np.ndarray], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _chunks(batches, scale):
            codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, (cut, book) in enumerate(zip(_cuts(x.shape[1], len(books)), books, strict=True)):
                tree = build(x[:, cut])
                code, _, _ = assign(tree, book)
                codes[tree.order, p] = code
                error[tree.order] += ((tree.points - book[code]) ** 2).sum(axis=1)
            hexed = codes.tobytes().hex()
            width = 2 * len(books)
            text = pa.array([hexed[i : i + width] for i in range(0, len(hexed), width)], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(1), text, pa.array(error)], ["record", "code", "error"])

    return run


@dataclass
class Quantiser:
    books: list[np.ndarray]
    scale: int

    def codebook_text(self) -> str:
        """All entries' numbers by part, entry and place, joined by commas."""
        return ",".join(str(v) for book in self.books for v in book.ravel().tolist())


def usable(df: DataFrame, vector: str) -> DataFrame:
    """vector and record of the rows whose vector is given and holds finite numbers alone."""
    v = df[f"`{vector}`"]
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(fine & (F.size(v) > 0)).select(v.alias("vector"), record_of(df).alias("record"))


def fit(rows: DataFrame, key: str, parts: int, entries: int, rounds: int, scale: int) -> tuple[Quantiser | None, int]:
    """Codebooks that begin with the rows of the smallest keys, and the vectors' width.

    rows are those of `usable`.  The width is that of the smallest key's vector.
    """
    first = rows.orderBy(F.col(f"record.`{key}`").asc_nulls_last(), "vector").select("vector").limit(1).first()
    if first is None:
        return None, 0
    width = len(first.vector)
    rows = rows.where(F.size("vector") == width)
    start = rows.orderBy(F.col(f"record.`{key}`").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    x = whole_numbers(np.array([r.vector for r in start], np.float64), scale)
    books = [x[:, cut] for cut in _cuts(width, parts)]
    vectors = rows.select("vector")
    for _ in range(rounds):
        found = vectors.mapInArrow(_round(books, scale), "part int, entry int, n long, sums array<long>")
        # a row a part, entry and place of the part: a table of the codebooks' size
        found = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "s")).groupBy("part", "entry", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in found.collect():
            books[r.part][r.entry, r.place] = r.s // r.n
    return Quantiser(books, scale), width


def quantise(df: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str | None = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Quantiser | None]:
    """A row per usable row of df: record, code, error, group_error; and the fitted quantiser.

    Rows are dropped whose vector is null or empty, holds a null or a number
    that isn't finite, or has another width than the smallest key's.  Components
    become floor(scale * x), held within 2**28.  A code has two hex digits a part.
    group_error sums errors over equal values of the group column, nulls
    together.  Fewer rows than entries make fewer entries.  Null keys come last,
    equal keys in the order of their vectors.  A table without usable rows gives
    an empty result and no quantiser.
    """
    rows = usable(df, vector)
    model, width = fit(rows, key, parts, entries, rounds, scale)
    kind = rows.select("record").schema["record"].dataType.simpleString()
    books = model.books if model else [np.zeros((1, 1), np.int64)] * parts
    coded = rows.where(F.size("vector") == width).mapInArrow(_codes(books, scale), f"record {kind}, code string, error long")
    if group is None:
        return coded, model
    coded = checkpoint(coded)
    by = F.col(f"record.`{group}`")
    total = checkpoint(coded.groupBy(by.alias("of")).agg(F.sum("error").alias("group_error")))
    total = F.broadcast(total) if total.count() <= BROADCAST_ROWS else total
    return coded.join(total, by.eqNullSafe(F.col("of"))).drop("of"), model
