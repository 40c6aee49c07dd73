"""Fill-in-middle transformation with an index of distinct texts.

Identical texts are found by their content: the SHA-256 and the length of their
bytes.  Each distinct text goes to one place once, and its documents' keys come
to it; there its token boundaries are put into an Elias-Fano list once, and every
document selects its two seeded cuts from the list.  Only keys are joined, so a
text moves once however many documents hold it.

An Elias-Fano list of n boundaries up to u takes about n * (2 + log2(u / n)) bits:
the low bits of each side by side, and a bitmap in which the high bits are
written in unary.  A cut is one select in the bitmap.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from veilsight.llm.common import checkpoint

#: The contract's marks and the shares, in per cent, of texts that are cut and of cut texts with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20
#: A text of more copies than this is sent to several tasks, so many copies to each.
COPIES = 1000
#: Narrow tables are broadcast up to so many rows, which are counted first.
BROADCAST_ROWS = 200_000
HEAD = struct.Struct("<IB")


def boundaries(text: str) -> np.ndarray:
    """Where the tokens `[A-Za-z]+|[^A-Za-z]` of a text end, in code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lower = c | np.uint32(32)
    letter = (lower >= 97) & (lower <= 122)
    inside = letter[1:] & letter[:-1]
    return np.flatnonzero(np.append(~inside, True)[: len(c)]) + 1


def encode(ends: np.ndarray) -> bytes:
    """Elias-Fano list of increasing positive numbers."""
    n = len(ends)
    if not n:
        return HEAD.pack(0, 0)
    low_bits = max(0, (int(ends[-1]) // n).bit_length() - 1)
    low = (ends[:, None] >> np.arange(low_bits)) & 1
    high = np.zeros((int(ends[-1]) >> low_bits) + n, np.uint8)
    high[(ends >> low_bits) + np.arange(n)] = 1
    return HEAD.pack(n, low_bits) + np.packbits(low.astype(np.uint8).ravel()).tobytes() + np.packbits(high).tobytes()


def select(listed: bytes, i: int) -> int:
    """The i-th number of a list, from 1; 0 for the 0th."""
    if not i:
        return 0
    n, low_bits = HEAD.unpack_from(listed)
    width = (n * low_bits + 7) // 8
    high = np.frombuffer(listed, np.uint8, offset=HEAD.size + width)
    ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
    byte = int(np.searchsorted(ones, i))
    before = int(ones[byte - 1]) if byte else 0
    at = byte * 8 + int(np.flatnonzero(np.unpackbits(high[byte : byte + 1]))[i - before - 1])
    first, last = (i - 1) * low_bits, i * low_bits
    own = np.frombuffer(listed, np.uint8, count=(last + 7) // 8 - first // 8, offset=HEAD.size + first // 8)
    low = np.unpackbits(own)[first % 8 : first % 8 + low_bits]
    return ((at - (i - 1)) << low_bits) | int((low.astype(np.int64) << np.arange(low_bits)).sum())


@F.pandas_udf(StructType().add("n", LongType()).add("first", IntegerType()).add("second", IntegerType()))
def cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Tokens of a text, and where its document's two seeded cuts are.

    Documents of one text come one after another, and the text's list is made
    for the first of them.
    """
    held, listed, n = None, b"", 0
    for digest, text, h1, h2 in batches:
        rows = []
        for own, t, a, b in zip(digest, text, h1, h2, strict=True):
            if own != held:
                ends = boundaries(t)
                held, listed, n = own, encode(ends), len(ends)
            a, b = sorted((a % (n + 1), b % (n + 1)))
            rows.append((n, select(listed, a), select(listed, b)))
        yield pd.DataFrame(rows, columns=["n", "first", "second"])


def seeds(key: Column, seed: int) -> list[Column]:
    """The first four 32-bit numbers of the SHA-256 of `seed:key`; a null key is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    A mark can't arise where two parts meet, as it begins with its only `<` and
    ends with its only `>`; so the first mark of a kind is the one put there.
    """

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.char_length(a) + len(second) + 1)
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substr(rest, F.char_length(b) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    late, early, last = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, last, late)).otherwise(output)


def _meet(keys: DataFrame, texts: DataFrame, copies: int) -> DataFrame:
    """Each row of keys with its text, those of one text one after another; texts of many copies are sent to several tasks.

    Distinct texts are made before they move, and keys come to where they are.
    """
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))
    hot = checkpoint(keys.groupBy("digest").agg(F.count("*").alias("rows")).where(F.col("rows") > copies).select("digest", F.ceil(F.col("rows") / copies).alias("parts")))
    n_hot = hot.count()
    if not n_hot:
        return keys.join(distinct, "digest")
    hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    rare = keys.join(hot, "digest", "left_anti").join(distinct, "digest")
    # keys are read from written files, where a row's number doesn't change
    some = keys.withColumn("row", F.monotonically_increasing_id()).join(hot, "digest").withColumn("part", F.pmod("row", "parts")).drop("row", "parts")
    each = distinct.join(hot, "digest").select("digest", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return rare.unionByName(some.join(each, ["digest", "part"]).drop("part"))


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, copies: int = COPIES) -> DataFrame:
    """A row per row of df: record (its columns but the text), n, form, prefix_chars, middle_chars, output, restored.

    n counts the tokens; form is plain, psm or spm; restored is the text as
    rebuilt from output and form.  Texts that are null count as empty; empty
    ones, and those that hold a mark, stay plain with null prefix_chars and
    middle_chars.  A null key draws as an empty one.  Repeated rows give repeated
    rows.  Cuts depend on seed, key and text alone.
    """
    whole = F.coalesce(df[f"`{text}`"], F.lit(""))
    # SHA-256 and length verify that contents are the same
    digest = F.concat(F.unhex(F.sha2(whole, 256)), F.octet_length(whole).cast("string").cast("binary")).alias("digest")
    others = [df[f"`{c}`"] for c in df.columns if c != text]
    record = F.struct(*others) if others else F.struct(F.lit(None).alias("none"))
    keys = checkpoint(df.select(record.alias("record"), digest))
    rows = _meet(keys, df.select(digest, whole.alias("text")), copies)
    rows = rows.select("*", *seeds(F.col(f"record.`{key}`"), seed))
    rows = rows.withColumn("cut", cuts("digest", "text", "h1", "h2"))
    n = F.col("cut.n")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (n == 0) | marked | (F.col("h3") % 100 >= CUT_SHARE)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST_SHARE, "spm").otherwise("psm")
    rows = rows.select("record", "text", n.alias("n"), form.alias("form"), "cut")
    first, second = F.col("cut.first"), F.col("cut.second")
    prefix, middle = F.substr("text", F.lit(1), first), F.substr("text", first + 1, second - first)
    suffix = F.substr("text", second + 1)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    rows = rows.select("record", "n", "form", cut(first).alias("prefix_chars"), cut(second - first).alias("middle_chars"), output.alias("output"))
    return rows.withColumn("restored", restore(F.col("output"), F.col("form")))
