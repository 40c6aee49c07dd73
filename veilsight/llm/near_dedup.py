"""Near duplicates by a chosen-path set similarity join.

Documents become sets of word shingles, sketches of minwise tokens, and a bit
a coordinate of a longer sketch.  In each of several independent trees a node
picks one or two sketch coordinates by its path, and its documents go on to the
children their tokens name: 1.25 children each, so that a pair at the threshold
meets in one child of a node, and less alike ones in ever fewer.

A node that is small enough is compared exhaustively, by bits.  In a large node
all documents are compared with one of them, the pivot: those about it become
its candidates, those close to it go no deeper, as whatever links to them is a
candidate of the pivot too.  A node whose documents all became candidates of one
pivot before has nothing left to find.  Each node stops by itself; whatever a
hot group looks like, a document costs a comparison for each node it is in.

Candidates' components are then linked exactly, on full sets.  Exact copies fall
together before all that, and nothing is ever paired within a group of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilsight.llm.common import Scratch, checkpoint, returning

MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Coordinates of the bits, of which the first are the tokens that trees branch by.
BITS, COORDINATES = 512, 64
_GEN = np.random.Generator(np.random.PCG64(11))
SCALES = _GEN.integers(0, 1 << 31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _GEN.integers(0, 1 << 32, BITS, dtype=np.uint32)
#: Sets are sketched so many tokens at a time.
CHUNK = 512
#: Tables of narrow rows are broadcast up to so many rows, which are counted first.
BROADCAST_ROWS = 200_000
#: Links, two numbers each, that one task joins up at most.
LOCAL_LINKS = 200_000


@dataclass(frozen=True)
class Plan:
    """How the join searches; similarity is share / 100."""

    share: int = 80
    words: int = 5
    trees: int = 10
    levels: int = 40
    #: A document's node has 1 + second children on average; 1.25 is one over the similarity.
    second: float = 0.25
    #: Nodes of so many documents at most are compared exhaustively, which costs less than another level.
    node: int = 256
    #: Bits that agree, of 512, where similarity s leaves (1 + s) / 2 of them: a candidate pair in a small node (0.695,
    #: four standard deviations under the threshold), a pivot's candidate (0.56), and one that goes no deeper (0.77).
    agree: int = 434
    about: int = 400
    close: int = 453
    #: Components of so many documents or tokens at most are linked in one task.
    local_docs: int = 4000
    local_tokens: int = 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX2
    return x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the text, A-Z lower-cased.

    Fewer words than a shingle's make one of all of them; no words make none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, and only the ASCII blanks
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)  # so that a short text's shingle is no full one's
    for i in range(k):
        h = mix(h * MIX1 + w[i : i + n])
    return np.unique(h)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The least of each coordinate's 32-bit hashes of the tokens."""
    least, t = np.full(BITS, 0xFFFFFFFF, np.uint32), (tokens >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(t), CHUNK):
        np.minimum(least, (t[i : i + CHUNK, None] * SCALES + SHIFTS).min(axis=0), out=least)
    return least


def bits_of(least: np.ndarray) -> bytes:
    """A bit a coordinate."""
    return np.packbits((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).tobytes()


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows of words agree."""
    return BITS - np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _signatures(words: int):
    @returning()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, first, second, drawn, bits = [], [], [], [], []
            for t in batch.column(2):
                tokens = shingles(t.as_py(), words)
                size.append(len(tokens))
                if len(tokens):
                    digest, least = xxhash.xxh3_128_digest(tokens.tobytes()), sketch(tokens)
                    first.append(int.from_bytes(digest[:8], "little", signed=True))
                    second.append(int.from_bytes(digest[8:], "little", signed=True))
                    drawn.append(least[:COORDINATES].tobytes())
                    bits.append(bits_of(least))
                else:
                    for column in (first, second, drawn, bits):
                        column.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(drawn, pa.binary()), pa.array(bits, pa.binary())],
                ["key", "text_hash", "n", "h1", "h2", "sketch", "bits"],
            )

    return run


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Binaries of one length as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _grow(path: np.ndarray, tokens: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """Children's paths and the rows that go there: one coordinate for every node, a second for some."""
    rows, out, at = np.arange(len(path)), [], []
    for turn in (1, 2):
        drawn = mix(path + np.uint64(turn * int(MIX1) % (1 << 64)))
        coordinate = (drawn % np.uint64(COORDINATES)).astype(np.int64)
        child = mix(mix(path + drawn) + tokens[rows, coordinate].astype(np.uint64) * MIX1)
        goes = np.ones(len(path), bool) if turn == 1 else (drawn >> np.uint64(40)) < np.uint64(second * (1 << 24))
        out.append(child[goes])
        at.append(rows[goes])
    return np.concatenate(out), np.concatenate(at)


def _roots(trees: int, second: float):
    @returning(first=False)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, cid = _matrix(batch.column(1), np.uint32), batch.column(0)
            for tree in range(trees):
                path, at = _grow(np.full(len(tokens), mix(np.array([tree + 1], np.uint64) * MIX1)[0], np.uint64), tokens, second)
                here = cid.take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), here, here], ["path", "cid", "held"])

    return run


def _descend(plan: Plan):
    """Rows of large nodes against their pivots: candidates (path null) with the pivot as held, and children."""

    @returning(first=False)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path, cid, held, pivot = (batch.column(c).to_numpy() for c in ("path", "cid", "held", "pivot"))
            same = agreement(_matrix(batch.column("bits"), np.uint64), _matrix(batch.column("pivot_bits"), np.uint64))
            about = same >= plan.about
            held = np.where(about, pivot, held)
            deeper = np.flatnonzero(same < plan.close)
            child, at = _grow(path[deeper].view(np.uint64), _matrix(batch.column("sketch"), np.uint32)[deeper], plan.second)
            at, star = deeper[at], np.flatnonzero(about & (cid != pivot))
            paths = pa.concat_arrays([pa.nulls(len(star), pa.int64()), pa.array(child.view(np.int64))])
            yield pa.RecordBatch.from_arrays([paths, pa.array(np.concatenate([cid[star], cid[at]])), pa.array(np.concatenate([pivot[star], held[at]]))], ["path", "cid", "held"])

    return run


class Union:
    def __init__(self, n: int):
        self.of = list(range(n))

    def find(self, x: int) -> int:
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.of[max(x, y)] = min(x, y)
        return True


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _compare_nodes(agree: int, pairs: int = 1 << 18):
    """Candidate links inside each small node, as few as join up what no pivot holds together.

    Nodes are taken together up to about so many pairs.
    """
    corner: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def compare(ids: np.ndarray, bits: np.ndarray, held: np.ndarray, ends: list[int]) -> list[tuple[int, int]]:
        left, right = [], []
        for start, end in zip(ends, ends[1:], strict=False):
            if end - start not in corner:
                corner[end - start] = np.triu_indices(end - start, 1)
            a, b = corner[end - start]
            left.append(a + start)
            right.append(b + start)
        left, right = np.concatenate(left), np.concatenate(right)
        hit = (held[left] != held[right]) & (agreement(bits[left], bits[right]) >= agree)
        left, right = left[hit].tolist(), right[hit].tolist()
        # rows of different nodes are different, so one forest serves them all
        joined = Union(ends[-1])
        for a, b in zip(left, right, strict=True):
            joined.join(a, b)
        # stars about the least cid, so that nodes of like members emit like links
        star, least = {i: joined.find(i) for i in {*left, *right}}, {}
        for i, r in star.items():
            least[r] = min(least.get(r, int(ids[i])), int(ids[i]))
        return [(least[r], int(ids[i])) for i, r in star.items() if least[r] != ids[i]]

    @returning(first=False)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            flat, offsets = members.flatten(), members.offsets.to_numpy()
            sizes = np.diff(offsets).astype(np.int64)
            load = np.cumsum(sizes * (sizes - 1) // 2) // pairs
            cuts = np.flatnonzero(np.diff(load, prepend=-1)).tolist() + [len(sizes)]
            for first, after in zip(cuts, cuts[1:], strict=False):
                here = flat.slice(int(offsets[first] - offsets[0]), int(offsets[after] - offsets[first]))
                bits = _matrix(here.field(1), np.uint64)
                yield _edges(compare(here.field(0).to_numpy(), bits, here.field(2).to_numpy(), (offsets[first : after + 1] - offsets[first]).tolist()))

    return run


def _with(rows: DataFrame, facts: DataFrame, on: str, n_facts: int) -> DataFrame:
    """rows joined to facts, which are broadcast if their counted number is within the bound."""
    return rows.join(F.broadcast(facts) if n_facts <= BROADCAST_ROWS else facts, on)


def candidate_links(reps: DataFrame, plan: Plan) -> DataFrame:
    """Links a, b between cids whose bits agree; reps has cid, sketch and bits."""

    scratch = Scratch(reps.sparkSession)
    keep = scratch.keep

    def sketched(rows: DataFrame, n_rows: int, *columns: str) -> DataFrame:
        own = reps.select("cid", *columns)
        return own.join(F.broadcast(rows) if n_rows <= BROADCAST_ROWS else rows, "cid")

    nodes = keep(reps.select("cid", "sketch").mapInArrow(_roots(plan.trees, plan.second), "path long, cid long, held long"))
    links, place = None, F.xxhash64("cid", "path")
    for level in range(1, plan.levels + 1):
        n_nodes = nodes.count()
        counts = nodes.groupBy("path").agg(F.count("*").alias("n"), F.min(place).alias("least"), (F.min("held") != F.max("held")).alias("apart"))
        counts = keep(counts.where("n > 1 AND apart").drop("apart"), n_nodes)
        n_small, n_large = counts.agg(F.count_if(F.col("n") <= plan.node), F.count_if(F.col("n") > plan.node)).first()
        small = keep(_with(nodes, counts.where(F.col("n") <= plan.node).select("path"), "path", n_small), n_nodes)
        members = sketched(small, small.count(), "bits").groupBy("path").agg(F.collect_list(F.struct("cid", "bits", "held")).alias("members")).select("members")
        found = members.mapInArrow(_compare_nodes(plan.agree), "a long, b long")
        if n_large:
            large = keep(_with(nodes, counts.where(F.col("n") > plan.node).select("path", "least"), "path", n_large), n_nodes)
            # the row with the least hash is the pivot
            pivots = sketched(large.where(place == F.col("least")).select("path", "cid"), n_large, "bits")
            pivots = keep(pivots.select("path", F.col("cid").alias("pivot"), F.col("bits").alias("pivot_bits")), n_large)
            judged = _with(sketched(large, large.count(), "sketch", "bits"), pivots, "path", n_large)
            nodes = keep(judged.select("path", "cid", "held", "pivot", "sketch", "bits", "pivot_bits").mapInArrow(_descend(plan), "path long, cid long, held long"), 2 * n_nodes)
            found = found.unionByName(nodes.where("path IS NULL").select(F.col("held").alias("a"), F.col("cid").alias("b")))
            nodes = nodes.where("path IS NOT NULL")
            if level == plan.levels:  # what is still large is not lost: all of a node become its pivot's candidates
                found = found.unionByName(judged.where("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")))
        found = keep(found.distinct(), n_nodes)
        links = found if links is None else links.unionByName(found)
        if not n_large:
            break
    links = checkpoint(links.distinct())
    scratch.clear()
    return links


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [np.stack([batch.column(i).to_numpy() for i in range(2)]) for batch in batches if batch.num_rows]
    if ends:
        names, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
        left, right = at.reshape(2, -1).tolist()
        joined = Union(len(names))
        for a, b in zip(left, right, strict=True):
            joined.join(a, b)
        # names are sorted, so the least place is the least name
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[[joined.find(i) for i in range(len(names))]])], ["cid", "comp"])


def components(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """cid and comp, the least cid that links a, b reach; a row for each cid with a link.

    Links are counted; up to local_links narrow ones are joined up in one task.
    Beyond, labels fall to the least of the neighbours' and then to their
    label's own label, so that long chains take few rounds.
    """
    scratch = Scratch(links.sparkSession)
    keep = scratch.keep
    links = keep(links.select("a", "b"))
    if links.count() <= local_links:
        found = checkpoint(links.repartition(1).mapInArrow(_join_up, "cid long, comp long"))
        scratch.clear()
        return found
    both = keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("a"), F.min("b")).alias("comp")))
    while True:
        heard = both.join(labels.select(F.col("cid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("comp").alias("near"))
        lower = labels.join(heard, "cid").select("cid", "comp", F.least("comp", "near").alias("low"))
        # each label also hears of what its own node and the members it stands for have found
        told = lower.groupBy(F.col("comp").alias("of")).agg(F.min("low").alias("told"))
        step = keep(lower.join(told, F.col("comp") == F.col("of")).select("cid", F.col("comp").alias("was"), F.least("low", "told").alias("comp")))
        jump = step.select(F.col("cid").alias("to"), F.col("comp").alias("next"))
        after = keep(step.join(jump, F.col("comp") == F.col("to")).select("cid", "was", F.least("comp", "next").alias("comp")))
        labels = after.select("cid", "comp")
        if after.where("comp < was").isEmpty():
            labels = checkpoint(labels)
            scratch.clear()
            return labels


def _sets(words: int):
    """Sets of the candidates; copies of one that meet in a task give one row."""

    @returning(first=False)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            rows, at = [], []
            for i, (cid, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                if cid in done:
                    continue
                raw = shingles(t.as_py(), words).tobytes()
                # another row may have the key and the text's hash, but not the set
                if int.from_bytes(xxhash.xxh3_128_digest(raw)[:8], "little", signed=True) == cid:
                    done.add(cid)
                    rows.append(raw)
                    at.append(i)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(rows, pa.binary())], ["comp", "cid", "tokens"])

    return run


def link_sets(sets: list[np.ndarray], share: int) -> Union:
    """Joins the sets whose intersection is at least share/100 of their union, exactly.

    A set is compared with all; those it links to need no comparison of their
    own, as by the triangle inequality only sets in the grey zone about it can
    link to them, and these are compared with all.
    """
    n = len(sets)
    joined, settled = Union(n), [False] * n
    sizes = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1])])
    mark = np.zeros(len(names), np.int64)
    grey = 2 * share - 100

    def compare(i: int) -> tuple[np.ndarray, np.ndarray]:
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        inter = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        union = sizes + sizes[i] - inter
        return np.flatnonzero(100 * inter >= share * union), np.flatnonzero((100 * inter < share * union) & (100 * inter >= grey * union))

    def settle(i: int) -> tuple[np.ndarray, np.ndarray]:
        linked, near = compare(i)
        settled[i] = True
        for j in linked.tolist():
            joined.join(i, j)
        return linked, near

    for i in range(n):
        if settled[i]:
            continue
        linked, near = settle(i)
        for j in near.tolist():
            if not settled[j] and joined.find(i) != joined.find(j):
                settle(j)
        for j in linked.tolist():
            settled[j] = True
    return joined


def _link_components(share: int):
    """Exact links of whole components, which come one after another."""

    def solve(rows: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        sets = {c: np.frombuffer(t, np.uint64) for c, t in rows}
        cids = list(sets)
        joined = link_sets(list(sets.values()), share)
        return [(cids[joined.find(i)], c) for i, c in enumerate(cids) if joined.find(i) != i]

    @returning(first=False)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        comp = None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for c, cid, tokens in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != comp and held:
                    out += solve(held)
                    held = []
                comp = c
                held.append((cid, tokens))
            yield _edges(out)
        yield _edges(solve(held) if held else [])

    return run


def link_whole(rows: DataFrame, share: int) -> DataFrame:
    """Links a, b of components that one task can hold; rows has comp, cid and tokens.

    A component's rows have to come one after another in one task.  After a join by comp,
    repartition("comp") and its sort are dropped as done already, and then the join may be run
    as a broadcast, which keeps neither; so rows go by a hash of comp, which no join has dealt by.
    """
    dealt = rows.select("comp", "cid", "tokens").repartition(F.xxhash64("comp")).sortWithinPartitions("comp")
    return dealt.mapInArrow(_link_components(share), "a long, b long")


def _stack(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets end to end, their starts and sizes."""
    sizes = np.array([len(r) // 8 for r in rows])
    return np.frombuffer(b"".join(rows), np.uint64), np.concatenate([[0], np.cumsum(sizes[:-1])]), sizes


def _compare_blocks(share: int):
    """Links of each set of one block with one set of the other, as the sets of that block are linked already."""

    @returning(first=False)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, grey in zip(batch.column(0), batch.column(1), strict=True):
                rows = rows.as_py()
                flat, starts, sizes = _stack([r["tokens"] for r in rows])
                names, flat = np.unique(flat, return_inverse=True)
                for y in grey.as_py():
                    own = np.frombuffer(y["tokens"], np.uint64)
                    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                    mark = np.zeros(len(names), np.int64)
                    mark[at[names[at] == own]] = 1
                    inter = np.add.reduceat(mark[flat], starts)
                    hit = np.flatnonzero(100 * inter >= share * (sizes + len(own) - inter))
                    if len(hit):
                        out.append((rows[hit[0]]["cid"], y["cid"]))
            yield _edges(out)

    return run


def _judge(share: int, grey: int):
    @returning(first=False)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zone, to = [], []
            for tokens, p in zip(batch.column("tokens").to_pylist(), batch.column("p").to_pylist(), strict=True):
                own, other = np.frombuffer(tokens, np.uint64), np.frombuffer(p["tokens"], np.uint64)
                inter = len(np.intersect1d(own, other, assume_unique=True))
                union = len(own) + len(other) - inter
                zone.append("linked" if 100 * inter >= share * union else "grey" if 100 * inter >= grey * union else "far")
                to.append(p["cid"])
            kept = [batch.column(c) for c in ("comp", "cid", "tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(to, pa.int64()), pa.array(zone, pa.string())], ["comp", "cid", "tokens", "to", "zone"])

    return run


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            flat, _, sizes = _stack(part.column("tokens").to_pylist())
            at = pa.array(np.repeat(np.arange(part.num_rows), sizes), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("comp").take(at), part.column("cid").take(at), pa.array(sizes).take(at), pa.array(flat.view(np.int64))], ["comp", "cid", "n", "token"])


def _verify(share: int):
    @returning(first=False)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * inter >= share * (len(x) + len(y) - inter):
                    out.append((a, b))
            yield _edges(out)

    return run


def _link_sparse(sets: DataFrame, plan: Plan) -> DataFrame:
    """Exact links of components where few sets are alike: two linked sets share a token among the rarest of each.

    Rarity counts inside the component; a token that one set alone holds meets nothing.
    """
    tokens = checkpoint(sets.select("comp", "cid", "tokens").mapInArrow(_token_rows, "comp long, cid long, n long, token long"))
    df = tokens.groupBy("comp", "token").agg(F.count("*").alias("df"))
    rare = F.row_number().over(Window.partitionBy("cid").orderBy("df", "token"))
    keep = F.col("n") - F.ceil(F.col("n") * plan.share / 100) + 1
    first = checkpoint(tokens.join(df, ["comp", "token"]).withColumn("nth", rare).where((F.col("nth") <= keep) & (F.col("df") > 1)).select("comp", "token", "cid", "n"))
    other = first.select("comp", "token", F.col("cid").alias("b"), F.col("n").alias("nb"))
    met = first.withColumnRenamed("cid", "a").join(other, ["comp", "token"]).where((F.col("a") < F.col("b")) & (100 * F.least("n", "nb") >= plan.share * F.greatest("n", "nb")))
    pairs = met.select("a", "b").distinct()
    left, right = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_verify(plan.share), "a long, b long")


def _link_giants(sets: DataFrame, plan: Plan, block: int = 512) -> DataFrame:
    """Exact links of components too large for one task, by rounds of pivots.

    What links to a component's pivot is done, once the grey zone about the
    pivot has been compared with it in blocks; the rest goes on.  A component
    of which a pivot takes less than an eighth has its links looked up by rare
    tokens instead, so rounds are some log8/7 of the component's documents.
    """
    grey = 2 * plan.share - 100
    links = None
    rest = sets
    while True:
        rest = checkpoint(rest)
        held = rest.groupBy("comp").agg(F.count("*").alias("docs"), F.sum(F.octet_length("tokens") / 8).alias("n"))
        is_small = (F.col("docs") <= plan.local_docs) & (F.col("n") <= plan.local_tokens)
        small = rest.join(held.where(is_small), "comp").select("comp", "cid", "tokens")
        found = link_whole(small, plan.share)
        links = checkpoint(found if links is None else links.unionByName(found))
        large = held.where(~is_small).select("comp", F.col("docs").alias("comp_docs"))
        if large.isEmpty():
            return links
        rows = rest.join(large, "comp")
        # a sum by key, of a row a component
        least = rows.groupBy("comp").agg(F.min(F.xxhash64("cid")).alias("least"))
        pivot = rows.join(least, "comp").where(F.xxhash64("cid") == F.col("least")).dropDuplicates(["comp"]).select("comp", F.struct("cid", "tokens").alias("p"))
        judged = checkpoint(rows.join(pivot, "comp").mapInArrow(_judge(plan.share, grey), "comp long, cid long, tokens binary, to long, zone string"))
        taken = judged.groupBy("comp").agg(F.count_if(F.col("zone") == "linked").alias("linked"), F.count_if(F.col("zone") == "grey").alias("grey"), F.count("*").alias("all"))
        taken = checkpoint(taken.withColumn("dense", F.col("linked") * 8 >= F.col("all")))
        sparse = judged.join(taken.where("NOT dense").select("comp"), "comp")
        if not taken.where("NOT dense").isEmpty():
            links = checkpoint(links.unionByName(_link_sparse(sparse, plan)))
        sizes = taken.where("dense").select("comp", F.ceil(F.col("linked") / block).alias("blocks"), F.ceil(F.col("grey") / block).alias("grey_blocks"))
        judged = judged.join(sizes, "comp")
        star = judged.where("zone = 'linked' AND cid <> to").select(F.col("to").alias("a"), F.col("cid").alias("b"))
        one = F.struct("cid", "tokens").alias("one")
        number = lambda of: F.pmod(F.xxhash64("cid", F.lit(5)), F.col(of)).alias("i" if of == "blocks" else "j")
        every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1)).alias("i" if of == "blocks" else "j")
        left = judged.where("zone = 'linked' AND grey_blocks > 0").select("comp", number("blocks"), every("grey_blocks"), one)
        right = judged.where("zone = 'grey'").select("comp", every("blocks"), number("grey_blocks"), one)
        left = left.groupBy("comp", "i", "j").agg(F.collect_list("one").alias("rows"))
        right = right.groupBy("comp", "i", "j").agg(F.collect_list("one").alias("grey"))
        across = left.join(right, ["comp", "i", "j"]).select("rows", "grey").mapInArrow(_compare_blocks(plan.share), "a long, b long")
        links = checkpoint(links.unionByName(star).unionByName(across))
        rest = judged.where("zone <> 'linked'").select("comp", "cid", "tokens")


def near_components(df: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan | None = None) -> DataFrame:
    """A row per row of df: key, n_shingles, component_id, kept, text_hash.

    Rows link if their sets of distinct word shingles overlap by plan.share /
    100 or more; component_id is the smallest key that links reach, kept
    whether it is the row's own.  Rows without words (null, empty or blank
    texts) link to nothing.  Rows with a null key count as documents with the
    largest key.  Rows with equal keys and sets are one document.  An empty
    table gives an empty result.  Candidate links are found with a chance of
    about 0.999 at the threshold, more above it and in small nodes; what is
    found is exact.
    """
    plan = plan or Plan()
    texts = df.select(df[key].alias("key"), F.xxhash64(df[text]).alias("text_hash"), df[text].alias("text"))
    kind = dict(texts.dtypes)["key"]
    seen = checkpoint(texts.mapInArrow(_signatures(plan.words), f"key {kind}, text_hash long, n long, h1 long, h2 long, sketch binary, bits binary"))
    classes = seen.where("n > 0").groupBy("h1", "h2").agg(F.min("key").alias("first"), F.max("n").alias("n"))
    reps = seen.where("n > 0").join(classes.select("h1", "h2", "first"), ["h1", "h2"]).where(F.col("key").eqNullSafe(F.col("first")))
    reps = checkpoint(reps.dropDuplicates(["h1", "h2"]).select(F.col("h1").alias("cid"), "first", F.col("text_hash").alias("first_hash"), "n", "sketch", "bits"))
    comps = components(candidate_links(reps, plan))
    wanted = checkpoint(reps.select("cid", "first", "first_hash", "n").join(comps, "cid"))
    held = wanted.groupBy("comp").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    is_small = (F.col("docs") <= plan.local_docs) & (F.col("tokens") <= plan.local_tokens)

    def sets(of: DataFrame) -> DataFrame:
        of = of.select("comp", "cid", "first", "first_hash")
        of = F.broadcast(of) if wanted.count() <= BROADCAST_ROWS else of
        # a key may stand in many rows (null, or repeated), a key and a text's hash in copies only
        same = texts["key"].eqNullSafe(of["first"]) & (texts["text_hash"] == of["first_hash"])
        return texts.join(of, same).select("comp", "cid", "text").mapInArrow(_sets(plan.words), "comp long, cid long, tokens binary")

    small = sets(wanted.join(held.where(is_small).select("comp"), "comp"))
    links = checkpoint(link_whole(small, plan.share))
    large = wanted.join(held.where(~is_small).select("comp"), "comp")
    if not large.isEmpty():
        links = components(links.unionByName(_link_giants(sets(large).dropDuplicates(["cid"]), plan))).select(F.col("comp").alias("a"), F.col("cid").alias("b"))
    # links are stars now: a names the component, b a member
    linked = links.where("a <> b").select(F.col("b").alias("cid"), F.col("a").alias("root"))
    rooted = reps.select("cid", "first").join(linked, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("cid").alias("h1"), "component_id")
    out = seen.select("key", "text_hash", "n", "h1").join(named, "h1", "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"), "text_hash")
