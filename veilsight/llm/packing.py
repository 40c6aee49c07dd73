"""Best-fit packing of token sequences by a linear grouping scheme.

Lengths are whole numbers up to the capacity, so a histogram of at most
capacity counts says all that packing needs to know.  The driver solves it:

1. large lengths, in falling order, are cut into groups of equal cardinality
   and rounded up to the largest of their group;
2. configurations of these few sizes are chosen, each around the largest size
   left and filled as well as the counts allow, and used as often as they last;
3. actual lengths take the places of the rounded ones;
4. small lengths, in falling order, go to the fullest sequence they fit.

The result is a table of rank ranges by length.  Executors rank the pieces of
each length and look their places up.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilsight.llm.common import FORGET, checkpoint, returning

#: Chunks and words whose ids a worker remembers, about.
REMEMBERED = 200_000
#: Rows that are ranked together, about.
RANKED_ROWS = 8192


@dataclass(frozen=True)
class Place:
    """Pieces of a length with ranks lo to hi - 1: per_bin to a sequence, from sequence bin on, at offset on."""

    length: int
    lo: int
    hi: int
    bin: int
    per_bin: int
    offset: int


def _fill(sizes: list[int], left: list[int], room: int) -> list[tuple[int, int]]:
    """(group, times) whose sizes add up to as much of room as the counts allow."""
    # reached[s]: the group used last to reach s, and how often; sums are reached by few groups first
    reached: dict[int, tuple[int, int, int]] = {0: (-1, 0, 0)}
    for g, size in enumerate(sizes):
        if not left[g] or size > room:
            continue
        for s in list(reached):
            for times in range(1, min(left[g], (room - s) // size) + 1):
                if s + times * size in reached:
                    continue
                reached[s + times * size] = (g, times, s)
        if room in reached:
            break
    s, chosen = max(reached), []
    while s:
        g, times, s = reached[s]
        chosen.append((g, times))
    return chosen


def solve(counts: dict[int, int], capacity: int, groups: int = 256, small: int | None = None) -> tuple[list[Place], int]:
    """Places for counts[length] pieces of each length, and the number of sequences."""
    small = capacity // 4 if small is None else small
    large = [(n, counts[n]) for n in sorted(counts, reverse=True) if n > small and counts[n]]
    total = sum(c for _, c in large)
    places: list[Place] = []
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, number)
    n_bins = 0

    # 1. groups of equal cardinality: for each its segments (length, first rank in that length, count)
    each = max(1, -(-total // groups))
    grouped: list[list[list[int]]] = []
    free = 0
    for n, c in large:
        rank = 0
        while c:
            if not free:
                grouped.append([])
                free = each
            take = min(c, free)
            grouped[-1].append([n, rank, take])
            rank, c, free = rank + take, c - take, free - take
    sizes, left = [g[0][0] for g in grouped], [sum(x[2] for x in g) for g in grouped]

    def take(g: int, k: int) -> list[tuple[int, int, int]]:
        """The next k pieces of a group as segments."""
        out = []
        while k:
            n, rank, c = grouped[g][0]
            t = min(c, k)
            out.append((n, rank, t))
            k -= t
            if t == c:
                grouped[g].pop(0)
            else:
                grouped[g][0] = [n, rank + t, c - t]
        return out

    # 2. and 3.
    for g in range(len(sizes)):
        while left[g]:
            left[g] -= 1
            config = [(g, 1), *_fill(sizes, left, capacity - sizes[g])]
            left[g] += 1
            need: dict[int, int] = defaultdict(int)
            for h, times in config:
                need[h] += times
            uses = min(left[h] // times for h, times in need.items())
            slots = []
            for h, times in sorted(need.items()):
                left[h] -= times * uses
                slots += [take(h, uses) for _ in range(times)]
            done = 0
            while done < uses:  # runs of sequences in which every slot keeps its length
                run = min(s[0][2] for s in slots)
                offset = 0
                for i, s in enumerate(slots):
                    n, rank, c = s[0]
                    places.append(Place(n, rank, rank + run, n_bins + done, 1, offset))
                    offset += n
                    slots[i] = s[1:] if c == run else [(n, rank + run, c - run), *s[1:]]
                open_runs[capacity - offset].append((n_bins + done, run))
                done += run
            n_bins += uses

    # 4.
    for n in sorted((n for n in counts if 0 < n <= small and counts[n]), reverse=True):
        rank, c = 0, counts[n]
        for room in range(n, capacity + 1):
            while c and open_runs.get(room):
                first, bins = open_runs[room].pop()
                fit = room // n
                full = min(bins, c // fit)
                if full:
                    places.append(Place(n, rank, rank + full * fit, first, fit, capacity - room))
                    open_runs[room - fit * n].append((first, full))
                    rank, c = rank + full * fit, c - full * fit
                if c and full < bins:  # fewer than fit are left
                    places.append(Place(n, rank, rank + c, first + full, c, capacity - room))
                    open_runs[room - c * n].append((first + full, 1))
                    rank, c, full = rank + c, 0, full + 1
                if full < bins:
                    open_runs[room].append((first + full, bins - full))
            if not c:
                break
        if c:
            fit = capacity // n
            bins = -(-c // fit)
            places.append(Place(n, rank, rank + c, n_bins, fit, 0))
            whole = c // fit
            if whole:
                open_runs[capacity - fit * n].append((n_bins, whole))
            if c % fit:
                open_runs[capacity - c % fit * n].append((n_bins + whole, 1))
            n_bins += bins
    return places, n_bins


class Ids:
    """Ids of texts as bytes, remembering each word's.

    Encoding a gibberish corpus word by word is several times faster than text
    by text, as each distinct word is merged once, and each distinct chunk
    between spaces cut into words once.  The short cut takes texts of
    characters that lower-casing and NFC treat one by one; others are encoded
    whole.
    """

    LETTERS, DIGITS = "a-zªµºß-öø-ÿĀ-įĲ-ſ", "0-9²³¹¼-¾"
    PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-įĲ-ſ]*")
    WORD = re.compile(rf"[{LETTERS}]+")
    #: The tokenizer's own pattern, with its classes as they are among the plain characters.
    PARTS = re.compile(rf"[{LETTERS}]+|[{DIGITS}]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{LETTERS}{DIGITS}]+")
    BLOCK = 1 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        #: Its merges, for a word that is lower-cased already, in the characters that stand for bytes there, and ids as bytes.
        self.merge = self.model.model.tokenize
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x180)) if self.WORD.fullmatch(c)}
        last = max(self.model.get_vocab().values(), default=0)
        self.packed = [i.to_bytes(4, "little") for i in range(last + 1)]
        #: Chunks and words met since the last turn, and those of the turn before, of which the ones still in use come over.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        if text.isascii():
            word = text.isalpha() and text.islower()
        elif word := self.WORD.fullmatch(text):
            text = text.translate(self.written)
        packed = self.packed
        if word:
            return b"".join([packed[t.id] for t in self.merge(text)])
        return b"".join([packed[i] for i in self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids])

    def learn(self, chunk: str) -> bytes:
        """Ids of a chunk that is not a word, those of its parts together."""
        parts = (chunk[:-1], chunk[-1]) if chunk[:-1].isalpha() else self.PARTS.findall(chunk)
        if len(parts) == 1:
            return self.whole(chunk)
        known = self.known
        for w in parts:
            if w not in known:
                known[w] = self.older[w] if w in self.older else self.whole(w)
        return b"".join([known[w] for w in parts])

    def block(self, text: str) -> bytes:
        if not self.PLAIN.fullmatch(text):
            return self.whole(text)
        chunks = text.lower().split()
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older, whole = self.known, self.older, self.whole
        for c in set(chunks).difference(known):
            known[c] = older[c] if c in older else whole(c) if c.isalpha() else self.learn(c)
        return b"".join(map(known.__getitem__, chunks))

    def of(self, text: str) -> bytes:
        """In blocks that end at a space, as tokens don't span one; texts with an added token's own string are encoded whole."""
        if any(a in text for a in self.added):
            return self.whole(text)
        out, start = [], 0
        while start < len(text):
            end = text.find(" ", start + self.BLOCK) if len(text) - start > self.BLOCK else -1
            end = len(text) if end < 0 else end
            out.append(self.block(text[start:end]))
            start = end
        return b"".join(out)


_IDS: dict[str, Ids] = {}
FORGET["packing"] = _IDS.clear


def tokenize(df: DataFrame, tokenizer: str, text: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Columns of df other than the text, and a row a piece: piece, start, length, ids_crc32 and, with_ids, ids.

    A document is its ids (a null text has none) and end_id, cut into pieces
    of capacity.  ids are little-endian unsigned 32-bit numbers.  tokenizer is
    the path of a word_bpe file on every executor.
    """
    made = [("piece", T.IntegerType(), pa.int32()), ("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64())]
    made += [("ids", T.BinaryType(), pa.binary())] if with_ids else []
    names = [n for n, _, _ in made]
    others = [c for c in df.columns if c != text and c not in names]
    schema = T.StructType([*[df.schema[c] for c in others], *[T.StructField(n, t) for n, t, _ in made]])
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    @returning("packing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _IDS:  # a worker's words serve its later tasks too
            _IDS[tokenizer] = Ids(tokenizer)
        ids_of = _IDS[tokenizer].of
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(text)):
                ids = ids_of(t.as_py() or "") + end
                for piece, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    at.append(i)
                    rows.append((piece, a // 4, len(part) // 4, zlib.crc32(part), part)[: len(made)])
            kept = [batch.column(c).take(pa.array(at, pa.int32())) for c in others]
            columns = [pa.array(x, k) for x, (_, _, k) in zip(zip(*rows, strict=True), made, strict=True)] if rows else [pa.array([], k) for _, _, k in made]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*others, *names])

    return df.select(*[F.col(f"`{c}`") for c in [*others, text]]).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = 2048, groups: int = 256) -> DataFrame:
    """The pieces with sequence_id and offset.

    pieces has column length (1 to capacity; other lengths are an error).
    Sequences hold at most capacity tokens, and their pieces lie end to end
    from offset 0.  Pieces alike in all columns are packed one by one.  No
    pieces give an empty result.
    """
    pieces = checkpoint(pieces)  # ranks and places must see the same rows
    seen = {int(n): c for n, c in pieces.groupBy("length").count().collect()}  # a row a length
    if any(not 1 <= n <= capacity for n in seen):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    places, _ = solve(seen, capacity, groups)
    # each length is ranked in so many parts that none is large
    parts = 1 + max(seen.values(), default=0) // RANKED_ROWS
    cut = pieces.withColumn("_h", F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns], F.monotonically_increasing_id()))
    cut = checkpoint(cut.withColumn("_part", F.pmod("_h", F.lit(parts))))
    by_part = Window.partitionBy("_n").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(F.col("length").alias("_n"), F.col("_part").alias("_p")).count()
    starts = starts.select("_n", "_p", F.coalesce(F.sum("count").over(by_part), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_h")) - 1  # a rerun ranks alike
    ranked = cut.withColumn("_within", within).join(starts, (F.col("length") == F.col("_n")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_within"))
    spark = pieces.sparkSession
    table = spark.createDataFrame([(p.length, p.lo, p.hi, p.bin, p.per_bin, p.offset) for p in places], "_l long, _lo long, _hi long, _bin long, _per long, _off long")
    # the table grows with the capacity and the number of groups, not with the pieces
    found = ranked.join(F.broadcast(table), (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    nth = F.col("_rank") - F.col("_lo")
    return found.select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        (F.col("_bin") + F.floor(nth / F.col("_per"))).alias("sequence_id"),
        (F.col("_off") + F.pmod(nth, F.col("_per")) * F.col("length")).alias("offset"),
    )
