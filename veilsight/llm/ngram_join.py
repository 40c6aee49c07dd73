"""Jaccard join of word n-grams with several global orders.

Under a global order of all tokens, two sets that are alike enough share so many
tokens among the first of each (their prefixes) that what is left beyond the
prefixes can make up the rest.  This holds under every order, so a candidate has
to pass it under all of several orders before it is verified.  Each order puts
common tokens last and goes by a hash of its own among the others.

First comes what one document can tell by itself: of a set that links to
any other, a known number of tokens of a longer prefix, and then 85 (share)
per cent of all, stand in other documents too.  Few documents of a corpus have
that, and only their whole sets are made, ordered and compared.

A token that stands in the prefixes of many documents is a hub.  No pairs are
made of its documents: those that hubs join under an order share a label, and
that counts as passing the order.  Documents with equal labels under all orders
are candidates as one group.

Candidates' components are then linked exactly, on whole sets.  Exact copies
fall together before all that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsight.llm.common import Scratch, checkpoint
from veilsight.llm.near_dedup import Plan, _link_giants, components, link_whole, mix, shingles

#: Narrow tables are broadcast up to so many rows, which are counted first.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Orders:
    """share / 100 is the least similarity; orders, how many; a token in the prefixes of more than hub documents is a hub."""

    share: int = 80
    words: int = 5
    orders: int = 3
    hub: int = 64
    #: Components of so many documents or tokens at most are linked in one task.
    local_docs: int = 4000
    local_tokens: int = 4_000_000


def prefix_size(n: np.ndarray, share: int) -> np.ndarray:
    """Tokens of a prefix: two sets with none of them in common can't reach share."""
    return n - -(-n * share // 100) + 1


def surplus(n: np.ndarray, share: int) -> np.ndarray:
    """Tokens by which a set's longer prefix is longer than one without any in common with the other's may be.

    Two sets that reach share have as many in common in their longer
    prefixes as the smaller surplus: of the set whose prefix ends first, what
    lies beyond is so much short of share.
    """
    return np.maximum(1, n * (100 - share) // 100)


@dataclass(frozen=True)
class Common:
    """The most common tokens, sorted, and their classes from 1: one more for each doubling of their documents."""

    tokens: np.ndarray
    classes: np.ndarray

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.uint64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.classes[at], np.uint64(0))


def ranks(tokens: np.ndarray, turn: int, common: Common | None = None) -> np.ndarray:
    """Places of tokens in an order: their class, then a hash that each turn draws anew; they name the tokens too."""
    drawn = mix(tokens + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(6)
    return drawn if common is None else drawn | (common.of(tokens) << np.uint64(58))


def first(placed: np.ndarray, size: int) -> np.ndarray:
    """The first so many of a set's places, in order."""
    size = min(size, len(placed))
    return np.sort(np.partition(placed, size - 1)[:size])


def _identities(plan: Orders):
    """Rows' sizes and identities, and the longer prefixes under the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, prefix = [], [], [], []
            for t in batch.column(2):
                tokens = shingles(t.as_py(), plan.words)
                n = len(tokens)
                size.append(n)
                if n:
                    digest = xxhash.xxh3_128_digest(tokens.tobytes())
                    one.append(int.from_bytes(digest[:8], "little", signed=True))
                    two.append(int.from_bytes(digest[8:], "little", signed=True))
                    prefix.append(first(ranks(tokens, 1), int(prefix_size(n, plan.share) - 1 + surplus(n, plan.share))).tobytes())
                else:
                    for column in (one, two, prefix):
                        column.append(None)
            columns = [pa.array(c, pa.int64()) for c in (size, one, two)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(prefix, pa.binary())], ["key", "text_hash", "n", "h1", "h2", "prefix"])

    return run


SENT = "token long, cid long, n long"


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens on their way to where all documents' tokens meet.

    A token that several documents of a batch have goes once, with their
    number and no document; each document's number of such tokens goes along under
    the document's name.
    """
    for batch in batches:
        kept = batch.filter(batch.column(0).is_valid())
        if not kept.num_rows:
            continue
        cid = kept.column(0).to_numpy()
        sets = [np.frombuffer(t, np.uint64) for t in kept.column(1).to_pylist()]
        of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        tokens, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        alone = n[at] == 1
        here = np.bincount(of[~alone], minlength=len(sets))
        single, known, told = tokens[at[alone]].view(np.int64), tokens[n > 1].view(np.int64), np.flatnonzero(here)
        token = pa.array(np.concatenate([single, known, cid[told]]))
        document = pa.concat_arrays([pa.array(cid[of[alone]]), pa.nulls(len(known), pa.int64()), pa.array(cid[told])])
        number = pa.concat_arrays([pa.nulls(len(single), pa.int64()), pa.array(n[n > 1].astype(np.int64)), pa.array(here[told].astype(np.int64))])
        yield pa.RecordBatch.from_arrays([token, document, number], ["token", "cid", "n"])


def _meet(many: int):
    """Documents with how many of their tokens others have, and tokens of more than many documents, from tokens in their order.

    A token has a row a batch of its sender's at most, so what is kept of one from batch
    to batch is a few numbers: its documents so far, and the one document if there is no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, so_far, lone = None, 0, None

        def rows(cid: np.ndarray, n: np.ndarray, token: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
            documents, common = [pa.array(x.astype(np.int64)) for x in (cid, n)], [pa.array(x.astype(np.int64)) for x in (token, df)]
            columns = [pa.concat_arrays([x, pa.nulls(len(token), pa.int64())]) for x in documents] + [pa.concat_arrays([pa.nulls(len(cid), pa.int64()), x]) for x in common]
            return pa.RecordBatch.from_arrays(columns, ["cid", "n", "token", "df"])

        none = np.zeros(0, np.int64)
        for batch in batches:
            told = pc.and_(batch.column(1).is_valid(), batch.column(2).is_valid())
            own = batch.filter(told)
            yield rows(own.column(1).to_numpy(), own.column(2).to_numpy(), none, none)
            own = batch.filter(pc.invert(told))
            if not own.num_rows:
                continue
            token, named = own.column(0).to_numpy(), own.column(1).is_valid().to_numpy(zero_copy_only=False)
            cid, n = own.column(1).fill_null(0).to_numpy(), own.column(2).fill_null(1).to_numpy()
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            df = np.add.reduceat(n, starts)
            goes_on = last == token[0]
            ended = (none, none) if goes_on or so_far <= many else (np.array([last]), np.array([so_far]))
            if goes_on:
                df[0] += so_far
            met = np.repeat(df, np.diff(np.append(starts, len(token)))) > 1
            found = cid[met & named]
            if goes_on and lone is not None:
                found = np.append(found, lone)
            found, times = np.unique(found, return_counts=True)
            # the last token may go on in the next batch
            last, so_far = int(token[-1]), int(df[-1])
            lone = int(cid[-1]) if so_far == 1 and named[-1] else None
            over = np.flatnonzero(df[:-1] > many)
            yield rows(found, times, np.append(token[starts[over]], ended[0]), np.append(df[over], ended[1]))
        if so_far > many:
            yield rows(none, none, np.array([last]), np.array([so_far]))

    return run


def shared_tokens(sets: DataFrame, many: int) -> DataFrame:
    """Rows cid, n: of a document, so many tokens of its set that others have too (to be added up); and token, df: tokens that more than many documents have.

    What a task knows of already isn't sent again for each document, so a
    token of a third of all documents goes once a batch.
    """
    sent = sets.select("cid", "tokens").mapInArrow(_send, SENT).repartition("token").sortWithinPartitions("token")
    return sent.mapInArrow(_meet(many), "cid long, n long, token long, df long")


def _shared(met: DataFrame) -> DataFrame:
    return met.where("cid IS NOT NULL").groupBy("cid").agg(F.sum("n").alias("shared"))


def common_tokens(met: DataFrame, many: int, most: int = BROADCAST_ROWS) -> Common:
    """The most common of the tokens that more than many documents have, so many at most."""
    top = met.where("token IS NOT NULL").select("token", "df").orderBy(F.desc("df"), "token").limit(most).toPandas()
    order = np.argsort(top["token"].to_numpy(np.int64).view(np.uint64))
    df = top["df"].to_numpy(np.int64)[order]
    classes = np.minimum(np.floor(np.log2(np.maximum(df / many, 1))) + 1, 30).astype(np.uint64)
    return Common(top["token"].to_numpy(np.int64).view(np.uint64)[order], classes)


POSTING = "turn int, rank long, cid long"


def _prefixes(plan: Orders, common: Broadcast):
    """A set's size, prefix and the rank that ends it, under each order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for cid, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.frombuffer(raw, np.uint64)
                for turn in range(1, plan.orders + 1):
                    own = first(ranks(tokens, turn, common.value), int(prefix_size(len(tokens), plan.share)))
                    for column, v in zip(rows, (turn, cid, len(tokens), int(own[-1]), own.tobytes()), strict=True):
                        column.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["turn", "cid", "n", "last", "prefix"])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            turn, cid, prefix = batch.slice(i, 512).columns
            sets = [np.frombuffer(p, np.uint64) for p in prefix.to_pylist()]
            at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            columns = [turn.to_numpy()[at], np.concatenate(sets).view(np.int64), cid.to_numpy()[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["turn", "rank", "cid"])


def _pairs(share: int, most: int = 1 << 18):
    """Pairs in each list, and how many tokens of their prefixes they have to share."""
    corner: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def made(turn: np.ndarray, cid: np.ndarray, n: np.ndarray, last: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        for start, end in zip(ends.tolist(), ends.tolist()[1:], strict=False):
            if end - start not in corner:
                corner[end - start] = np.triu_indices(end - start, 1)
            a, b = corner[end - start]
            left.append(a + start)
            right.append(b + start)
        left, right = np.concatenate(left), np.concatenate(right)
        near = 100 * np.minimum(n[left], n[right]) >= share * np.maximum(n[left], n[right])
        left, right = left[near], right[near]
        rest = n - prefix_size(n, share)
        # what both may share beyond the prefix that ends first
        beyond = np.where(last[left] < last[right], rest[left], np.where(last[left] > last[right], rest[right], np.minimum(rest[left], rest[right])))
        least = -(-share * (n[left] + n[right]) // (100 + share))
        need = np.maximum(least - beyond, 1)
        which = np.repeat(turn, np.diff(ends))[left]
        a, b = np.minimum(cid[left], cid[right]), np.maximum(cid[left], cid[right])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (which, a, b, need)], ["turn", "a", "b", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn, members = batch.column(0).to_numpy(), batch.column(1)
            flat, offsets = members.flatten(), members.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(offsets)
            load = np.cumsum(sizes * (sizes - 1) // 2) // most
            cuts = np.flatnonzero(np.diff(load, prepend=-1)).tolist() + [len(sizes)]
            for first, after in zip(cuts, cuts[1:], strict=False):
                here = flat.slice(int(offsets[first] - offsets[0]), int(offsets[after] - offsets[first]))
                columns = [here.field(i).to_numpy() for i in range(3)]
                yield made(turn[first:after], *columns, offsets[first : after + 1] - offsets[first])

    return run


def _filter(postings: DataFrame, facts: DataFrame, plan: Orders) -> tuple[DataFrame, DataFrame]:
    """Pairs turn, a, b that pass an order by short lists, and turn, cid, label of documents that hubs join.

    facts has turn, cid, n and last, the rank that ends the prefix.
    """
    held = checkpoint(postings.groupBy("rank").agg(F.count("*").alias("df")).where("df > 1"))
    matched = checkpoint(postings.join(F.broadcast(held) if held.count() <= BROADCAST_ROWS else held, "rank"))
    listed = matched.where(F.col("df") <= plan.hub).select("turn", "rank", "cid").join(facts, ["turn", "cid"])
    # a list has plan.hub members at most
    lists = listed.groupBy("rank").agg(F.first("turn").alias("turn"), F.collect_list(F.struct("cid", "n", "last")).alias("members"))
    pairs = lists.select("turn", "members").mapInArrow(_pairs(plan.share), "turn int, a long, b long, need long")
    pairs = checkpoint(pairs.groupBy("turn", "a", "b").agg(F.count("*").alias("m"), F.max("need").alias("need")).where("m >= need").select("turn", "a", "b"))
    # documents with the same hubs are one node, so that a large group moves as few
    own = matched.where(F.col("df") > plan.hub).groupBy("turn", "cid").agg(F.array_sort(F.collect_list("rank")).alias("hubs"))
    own = checkpoint(own.select("turn", "cid", "hubs", F.xxhash64("turn", "hubs").alias("node")))
    if own.isEmpty():
        return pairs, own.select("turn", "cid", F.col("node").alias("label"))
    edges = own.select("turn", "node", "hubs").dropDuplicates(["node"]).select(F.col("node").alias("a"), "turn", F.explode("hubs").alias("hub"))
    joined = components(edges.select("a", F.xxhash64("turn", "hub", F.lit(7)).alias("b")))
    labels = own.select("turn", "cid", "node").join(joined.withColumnRenamed("cid", "node"), "node").select("turn", "cid", F.col("comp").alias("label"))
    return pairs, checkpoint(labels)


def _sets(words: int):
    """Sets of the survivors; copies of one that meet in a task give one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            cids, rows = [], []
            for cid, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if cid not in done:
                    raw = shingles(t.as_py(), words).tobytes()
                    if int.from_bytes(xxhash.xxh3_128_digest(raw)[:8], "little", signed=True) == cid:
                        done.add(cid)
                        cids.append(cid)
                        rows.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(rows, pa.binary())], ["cid", "tokens"])

    return run


def _intersect(pairs: DataFrame, labels: DataFrame, orders: int) -> DataFrame:
    """Candidates a, b: pairs that pass every order, by its lists or its hubs, and stars of documents that hubs join in all."""
    turns = range(1, orders + 1)
    wide = checkpoint(labels.groupBy("cid").agg(*[F.max(F.when(F.col("turn") == k, F.col("label"))).alias(f"l{k}") for k in turns]))
    seen = pairs.groupBy("a", "b").agg(*[F.max(F.col("turn") == k).alias(f"t{k}") for k in turns])
    whole = reduce(lambda x, y: x & y, [F.col(f"t{k}") for k in turns])
    part = checkpoint(seen)
    ends = lambda name: wide.select(F.col("cid").alias(name), *[F.col(f"l{k}").alias(f"{name}{k}") for k in turns])
    some = part.where(~whole).join(ends("a"), "a").join(ends("b"), "b")
    some = some.where(reduce(lambda x, y: x & y, [F.coalesce(F.col(f"t{k}") | (F.col(f"a{k}") == F.col(f"b{k}")), F.lit(False)) for k in turns]))
    together = wide.dropna().groupBy(*[f"l{k}" for k in turns]).agg(F.min("cid").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = wide.join(together, [f"l{k}" for k in turns]).where("cid <> a").select("a", F.col("cid").alias("b"))
    return part.where(whole).select("a", "b").unionByName(some.select("a", "b")).unionByName(stars)


def ngram_components(df: DataFrame, key: str = "doc_id", text: str = "text", plan: Orders | None = None) -> DataFrame:
    """A row per row of df: key, n_shingles, component_id.

    Rows link if their sets of distinct word n-grams overlap by plan.share / 100
    or more, all such links count, and component_id is the smallest key they
    reach.  Rows without words (null, empty or blank texts) link to nothing.
    Rows with a null key count as documents with the largest key; rows with
    equal sets are one document.  An empty table gives an empty result.
    """
    plan = plan or Orders()
    texts = df.select(df[f"`{key}`"].alias("key"), F.xxhash64(df[f"`{text}`"]).alias("text_hash"), df[f"`{text}`"].alias("text"))
    kind = dict(texts.dtypes)["key"]
    scratch = Scratch(df.sparkSession)
    wide = scratch.keep(texts.mapInArrow(_identities(plan), f"key {kind}, text_hash long, n long, h1 long, h2 long, prefix binary"))
    seen = checkpoint(wide.drop("prefix"))
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_hash")).alias("least")
    reps = seen.where("n > 0").groupBy("h1", "h2").agg(least, F.first("n").alias("n"))
    reps = checkpoint(reps.select(F.col("h1").alias("cid"), F.col("least.key").alias("first"), F.col("least.text_hash").alias("first_hash"), "n"))

    # the smallest set that a set may link to has the smaller surplus
    other = F.ceil(F.col("n") * plan.share / 100)
    enough = F.greatest(F.lit(1), F.floor(other * (100 - plan.share) / 100))
    hopeful = _shared(shared_tokens(wide.select(F.col("h1").alias("cid"), F.col("prefix").alias("tokens")), plan.hub))
    wanted = checkpoint(reps.join(hopeful, "cid").where(F.col("shared") >= enough).select("cid", "first", "first_hash"))
    scratch.clear()
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    same = texts["key"].eqNullSafe(near["first"]) & (texts["text_hash"] == near["first_hash"])
    sets = texts.join(near, same).select("cid", "text").mapInArrow(_sets(plan.words), "cid long, tokens binary")
    # rows that are alike in key and text give their set more than once
    twice = not seen.where("n > 0").groupBy("key", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()
    sets = scratch.keep(sets.dropDuplicates(["cid"]) if twice else sets)
    met = scratch.keep(shared_tokens(sets, plan.hub))
    common = df.sparkSession.sparkContext.broadcast(common_tokens(met, plan.hub))
    covered = checkpoint(_shared(met).join(reps.select("cid", "n"), "cid").where(100 * F.col("shared") >= plan.share * F.col("n")).select("cid"))
    sets = checkpoint(sets.join(F.broadcast(covered) if covered.count() <= BROADCAST_ROWS else covered, "cid").select("cid", "tokens"))
    scratch.clear()

    prefixes = scratch.keep(sets.mapInArrow(_prefixes(plan, common), "turn int, cid long, n long, last long, prefix binary"))
    facts = checkpoint(prefixes.drop("prefix"))
    pairs, labels = _filter(prefixes.select("turn", "cid", "prefix").mapInArrow(_postings, POSTING), facts, plan)
    scratch.clear()
    comps = components(_intersect(pairs, labels, plan.orders))
    rows = checkpoint(sets.join(comps, "cid").select("comp", "cid", "tokens"))
    held = checkpoint(rows.groupBy("comp").agg(F.count("*").alias("docs"), F.sum(F.octet_length("tokens") / 8).alias("tokens")))
    is_small = (F.col("docs") <= plan.local_docs) & (F.col("tokens") <= plan.local_tokens)
    small = rows.join(held.where(is_small).select("comp"), "comp")
    links = link_whole(small, plan.share)
    if not held.where(~is_small).isEmpty():
        exact = Plan(share=plan.share, words=plan.words, local_docs=plan.local_docs, local_tokens=plan.local_tokens)
        giants = _link_giants(rows.join(held.where(~is_small).select("comp"), "comp"), exact)
        links = components(links.unionByName(giants)).select(F.col("comp").alias("a"), F.col("cid").alias("b"))
    # links are stars now: a names the component, b a member
    linked = checkpoint(links.where("a <> b").select(F.col("b").alias("cid"), F.col("a").alias("root")))
    rooted = reps.select("cid", "first").join(linked, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(F.col("cid").alias("h1"), "component_id")
    out = seen.select("key", "n", "h1").join(named, "h1", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))
