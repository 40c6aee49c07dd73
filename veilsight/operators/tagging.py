"""A hidden Markov tagger with emissions of words and of their endings, fitted on tagged rows.

Counts are made by Spark; what is sent out is a table of bounded size: the most
frequent words and endings, and tags by tags.  Texts are decoded by Viterbi, all of
a batch that have one length together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from veilsight.functions.text import words
from veilsight.session import checkpoint

#: What an unseen pair counts.
UNSEEN = 0.05


@dataclass(frozen=True)
class Model:
    """Log chances: of a first tag, of a tag after a tag, and of a word or an ending under each tag."""

    tags: tuple[str, ...]
    first: np.ndarray
    after: np.ndarray
    words: dict[str, np.ndarray]
    endings: dict[str, np.ndarray]
    longest: int

    def emission(self, word: str) -> np.ndarray:
        """A known word's own chances, else those of its longest known ending."""
        own = self.words.get(word)
        if own is not None:
            return own
        for n in range(min(self.longest, len(word)), -1, -1):
            own = self.endings.get(word[len(word) - n :])
            if own is not None:
                return own
        return np.zeros(len(self.tags))

    def decode(self, texts: list[list[str]]) -> list[list[str]]:
        """The likeliest tags of each text's words."""
        known = {w: self.emission(w) for t in texts for w in t}
        by_length, out = defaultdict(list), [[] for _ in texts]
        for i, t in enumerate(texts):
            by_length[len(t)].append(i)
        for n, rows in by_length.items():
            if not n:
                continue
            seen = np.array([[known[w] for w in texts[i]] for i in rows])
            score, back = self.first + seen[:, 0], []
            for k in range(1, n):
                step = score[:, :, None] + self.after[None]
                back.append(step.argmax(axis=1))
                score = step.max(axis=1) + seen[:, k]
            at = score.argmax(axis=1)
            path = [at]
            for b in reversed(back):
                at = b[np.arange(len(rows)), at]
                path.append(at)
            for i, own in zip(rows, np.stack(path[::-1], axis=1), strict=True):
                out[i] = [self.tags[t] for t in own]
        return out


def fit(rows: DataFrame, sentence: str = "sentence", place: str = "place", ending: int = 3, max_words: int = 50_000, rare: int = 10) -> Model:
    """The model of rows sentence, place, token and pos.

    Words beyond the max_words most frequent, like words never seen, go by their
    endings, which words of up to rare occurrences tell.
    """
    rows = checkpoint(rows.select(F.col(sentence).alias("s"), F.col(place).alias("i"), F.lower("token").alias("token"), "pos"))
    before = F.lag("pos").over(Window.partitionBy("s").orderBy("i"))
    steps = rows.withColumn("before", before).groupBy("before", "pos").agg(F.count("*").alias("n")).collect()  # tags by tags
    tags = tuple(sorted({r.pos for r in steps}))
    at = {t: i for i, t in enumerate(tags)}
    first, after = np.full(len(tags), UNSEEN), np.full((len(tags), len(tags)), UNSEEN)
    for r in steps:
        if r.before is None:
            first[at[r.pos]] += r.n
        else:
            after[at[r.before], at[r.pos]] += r.n
    every = first + after.sum(axis=0)

    def table(found: DataFrame) -> dict[str, np.ndarray]:
        made: dict[str, np.ndarray] = defaultdict(lambda: np.full(len(tags), UNSEEN))
        for r in found.collect():
            for x in r.by:
                made[r.key][at[x.pos]] += x.n
        return {k: np.log(v / every) for k, v in made.items()}

    counts = checkpoint(rows.groupBy("token", "pos").agg(F.count("*").alias("n")))
    listed = lambda key: [F.sum("n").alias("n"), F.collect_list(F.struct("pos", "n")).alias("by")]  # noqa: E731  a row a tag
    per_word = counts.groupBy(F.col("token").alias("key")).agg(*listed("token"))
    seldom = counts.join(per_word.where(F.col("n") <= rare).select(F.col("key").alias("token")), "token", "left_semi")
    ends = F.transform(F.sequence(F.lit(0), F.least(F.lit(ending), F.length("token"))), lambda k: F.substring("token", F.length("token") - k + 1, k))
    ends = seldom.select(F.explode(ends).alias("key"), "pos", "n").groupBy("key", "pos").agg(F.sum("n").alias("n")).groupBy("key").agg(*listed("key"))
    top = lambda found: found.orderBy(F.desc("n"), "key").limit(max_words)
    return Model(tags, np.log(first / first.sum()), np.log(after / after.sum(axis=1, keepdims=True)), table(top(per_word)), table(top(ends)), ending)


class MarkovTagger:
    """A tagger for clause_tokens, dictionary and noun phrases: from a text column to structs of token and pos."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, c: Column) -> Column:
        model = self.model
        pair = pa.struct([("token", pa.string()), ("pos", pa.string())])

        @arrow_udf("array<struct<token:string,pos:string>>")
        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                texts = [t or [] for t in column.to_pylist()]
                yield pa.array([[{"token": w, "pos": p} for w, p in zip(t, tags, strict=True)] for t, tags in zip(texts, model.decode(texts), strict=True)], pa.list_(pair))

        return run(words(c))


def agreement(rows: DataFrame, model: Model, sentence: str = "sentence", place: str = "place") -> DataFrame:
    """pos, n, right and share: tagged rows, and those whose tag the model gives; by the rows' tag."""
    texts = rows.groupBy(sentence).agg(F.array_sort(F.collect_list(F.struct(place, F.lower("token").alias("token"), "pos"))).alias("w"))

    @arrow_udf("array<string>")
    def decoded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(model.decode([t or [] for t in column.to_pylist()]), pa.list_(pa.string()))

    tagged = texts.withColumn("p", decoded(F.transform("w", lambda x: x["token"])))
    both = tagged.select(F.explode(F.arrays_zip(F.transform("w", lambda x: x["pos"]).alias("pos"), F.col("p").alias("p"))).alias("x"))
    out = both.groupBy(F.col("x.pos").alias("pos")).agg(F.count("*").alias("n"), F.count_if(F.col("x.pos") == F.col("x.p")).alias("right"))
    return out.withColumn("share", F.col("right") / F.col("n"))
