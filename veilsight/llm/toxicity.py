"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus.  What looks
obfuscated in a text (digits and signs among letters, repeated or spaced-out
letters) becomes a lattice of readings, which Viterbi decodes under that model.
A logistic model over words and their beginnings, learned from labelled rows,
then scores the words of the text together with the restored ones.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from veilsight.llm.common import FORGET, returning

#: Symbols of the character model: a boundary, a to z, the letters ß to ÿ, and one for all other letters.
BOUNDARY, OTHER, SYMBOLS = 0, 60, 61
_CODES = np.zeros(0x180, np.int64)
for _c in range(0x180):
    if chr(_c).isalpha():
        _low = ord(chr(_c).lower()) if len(chr(_c).lower()) == 1 else _c
        _CODES[_c] = _low - 96 if 97 <= _low <= 122 else _low - 0xDF + 27 if 0xDF <= _low <= 0xFF else OTHER

#: Fixed readings of signs that stand for letters.
READINGS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "2": "z",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "*": "aeiou", "#": "h",
    "а": "a", "е": "e", "о": "o", "і": "i", "с": "c", "р": "p", "х": "x", "у": "y", "к": "k", "м": "m", "т": "t",
}
SEPARATORS = frozenset(" ._-*~/\\'’`​‌‍﻿­")
#: Log costs of the channel: a sign for a letter, a repeated letter, a separator put in or taken out, an accent.
SIGN, REPEAT, DELETED, KEPT, ACCENT = -0.7, -1.0, -0.3, -2.3, -3.0

OUTER = ".,;:!?\"'()[]{}<>«»“”„‘’…–—-_/\\|`~=+*&%#^"
SPACED = re.compile(r"(?<!\S)[^\s\w]?(?:[^\W_]|[@$!|+])(?:[ ._\-*~/]{1,2}(?:[^\W_]|[@$!|+])){2,}(?![^\W_])")
INVISIBLE = "​‌‍⁠﻿­"
#: Characters below 0x180 that are letters or digits, and those that SPACED takes for a letter.
_ALNUM = np.array([bool(re.match(r"[^\W_]", chr(c))) for c in range(0x180)])
_UNIT = _ALNUM | np.isin(np.arange(0x180), [ord(c) for c in "@$!|+"])
#: Of each byte of Latin-1: 3 for a letter or digit, 2 for another character that SPACED takes for a letter, else 0.
_KINDS = bytes((3 if _ALNUM[c] else 2 if _UNIT[c] else 0) for c in range(0x100))
#: Of each byte of Latin-1, its symbol.
_SYMBOLS = bytes(_CODES[:0x100].tolist())
PIECES = re.compile(r"[^\W\d_]+")
DOUBLED = re.compile(r"(.)\1")


class CharModel:
    """Log probabilities of a symbol after two, from trigram counts."""

    def __init__(self, counts: np.ndarray):
        three = counts.astype(np.float64).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SYMBOLS)
        p2 = (two + 8 * p1) / (two.sum(axis=1, keepdims=True) + 8)
        p3 = (three + 8 * p2[None]) / (three.sum(axis=2, keepdims=True) + 8)
        self.log = np.log(p3).astype(np.float32)
        self.rows, self.after = None, []

    def __getstate__(self):
        return self.log

    def __setstate__(self, log):
        self.log, self.rows, self.after = log, None, []

    def following(self) -> list[list[float]]:
        """At a * SYMBOLS + b, the log probabilities of all symbols after a and b."""
        if not self.after:
            self(BOUNDARY, BOUNDARY, BOUNDARY)
            self.after = [self.rows[BOUNDARY][BOUNDARY] if b == BOUNDARY else self.rows[a][b] for a in range(SYMBOLS) for b in range(SYMBOLS)]
        return self.after

    def __call__(self, a: int, b: int, c: int) -> float:
        if self.rows is None:
            self.rows = self.log.tolist()
        return self.rows[BOUNDARY if b == BOUNDARY else a][b][c]


def symbol(c: str) -> int:
    o = ord(c)
    return int(_CODES[o]) if o < 0x180 else OTHER if c.isalpha() else BOUNDARY


def count_trigrams(text: str) -> np.ndarray:
    """Codes of the symbol trigrams of a text, whose boundaries count once."""
    points = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    s = _CODES[np.minimum(points, 0x17F)]
    far = points >= 0x180
    if far.any():
        s[far] = [OTHER if chr(c).isalpha() else BOUNDARY for c in points[far].tolist()]
    s = s[np.concatenate([[True], (s[1:] != BOUNDARY) | (s[:-1] != BOUNDARY)])]
    before = np.concatenate([[BOUNDARY], s[:-2]])
    before[s[:-1] == BOUNDARY] = BOUNDARY
    return (before * SYMBOLS + s[:-1]) * SYMBOLS + s[1:]


def character_model(df: DataFrame, text: str = "text") -> CharModel:
    """Model from every text of df.  The driver gathers a count a trigram of the symbols, 61 to the third at most."""

    @returning("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(SYMBOLS**3, np.int64), [], 0
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    held.append(t.as_py())
                    size += len(held[-1])
                if size > 1_000_000:
                    total += np.bincount(count_trigrams(" ".join(held)), minlength=SYMBOLS**3)
                    held, size = [], 0
        total += np.bincount(count_trigrams(" ".join(held)), minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    rows = df.select(F.col(f"`{text}`")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3, np.int64)
    for code, n in rows:
        counts[code] = n
    return CharModel(counts)


def lattice(seen: str) -> list[list[tuple[str, float]]]:
    """Readings of each character with their log costs; '' leaves it out, ' ' is a boundary."""
    out: list[list[tuple[str, float]]] = []
    last = ""
    for c in seen.lower():
        if c in SEPARATORS and c != "*":
            # two in a row part words
            out.append([("", DELETED), (" ", KEPT if last else -0.2)])
            last = ""
            continue
        choices = []
        if c in READINGS:
            if c.isalpha():
                choices.append((c, 0.0))
            choices += [(x, SIGN - math.log(len(READINGS[c]))) for x in READINGS[c]]
        elif c.isalpha():
            choices.append((c, 0.0))
            base = unicodedata.normalize("NFKD", c)[0]
            if base != c and "a" <= base <= "z":
                choices.append((base, ACCENT))
        else:
            choices.append((" ", KEPT))
        if c == last:
            choices.append(("", REPEAT))
        if c in "*!|(+#":
            choices.append(("", SIGN))
        last = c
        out.append(choices)
    return out


class _Choices(dict):
    """Of a character and what stands before it (nothing or a separator, the same, another): its readings with costs and symbols."""

    def __missing__(self, at: tuple[str, str]) -> tuple[tuple[str, float, int], ...]:
        c, before = at
        seen = {"": "", "same": c, "other": "a"}[before] + c
        self[at] = out = tuple((text, cost, BOUNDARY if text in ("", " ") else symbol(text)) for text, cost in lattice(seen)[-1])
        return out


CHOICES = _Choices()


@lru_cache(maxsize=1 << 12)
def disguised(word: str) -> bool:
    """Whether a word of letters has other readings: a letter twice in a row, or one that stands for another."""
    return bool(DOUBLED.search(word)) or not word.isascii() and any(LETTERS[c][1] for c in word)


FORGET["toxicity"] = disguised.cache_clear


class _Letters(dict):
    """Of each letter seen: its symbol, and what else it may stand for, with symbols and costs."""

    def __missing__(self, c: str) -> tuple[int, tuple[tuple[str, int, float], ...]]:
        (choices,) = lattice(c)
        self[c] = out = symbol(c), tuple((x, symbol(x), cost) for x, cost in choices if x != c)
        return out


LETTERS = _Letters()


def restore_apart(word: str, model: CharModel) -> str | None:
    """What restore gives for a lower-case word of letters, where those with other readings are three places apart or more; None for other words.

    A choice changes the probabilities of its own symbol and the next two, so
    choices so far apart are the likeliest each by itself.
    """
    found, last, place = [], "", -3
    if word.isascii():  # only letters twice in a row
        s = b"".join([b"\0\0", word.encode().translate(_SYMBOLS), b"\0"])
        for m in DOUBLED.finditer(word):
            i = m.end() - 1
            if i - place < 3 or word[i + 1 : i + 2] == word[i]:
                return None
            found.append((i, ()))
            place = i
    else:
        s = [BOUNDARY, BOUNDARY]
        for i, c in enumerate(word):
            code, others = LETTERS[c]
            s.append(code)
            if others or c == last:
                if i - place < 3:
                    return None
                found.append((i, others))
                place = i
            last = c
        s.append(BOUNDARY)
    out, following = list(word), model.following()
    for i, others in found:
        a, b, after = s[i], s[i + 1], s[i + 3]
        second = s[i + 4] if i + 4 < len(s) else None

        before, link = following[a * SYMBOLS + b], b * SYMBOLS

        d = s[i + 2]
        best, pick = before[d] + following[link + d][after] + (0.0 if second is None else following[d * SYMBOLS + after][second]), word[i]
        for x, d, cost in others:
            if (p := cost + (before[d] + following[link + d][after] + (0.0 if second is None else following[d * SYMBOLS + after][second]))) > best:
                best, pick = p, x
        if i and word[i] == word[i - 1]:
            without = REPEAT + before[after] + (0.0 if second is None else following[link + after][second])
            if without > best:
                pick = ""
        out[i] = pick
    return "".join(out)


def restore(seen: str, model: CharModel) -> str:
    """The likeliest reading, by Viterbi over the last two symbols, with words parted by spaces."""
    following = model.following()
    # last two symbols, a * SYMBOLS + b -> (score, link), a link being (text, link before)
    states: dict[int, tuple[float, tuple | None]] = {BOUNDARY: (0.0, None)}
    last = ""
    for c in seen.lower():
        if c in SEPARATORS and c != "*":
            choices, last = CHOICES[c, "other" if last else ""], ""
        else:
            choices, last = CHOICES[c, "same" if c == last else ""], c
        reached: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, link) in states.items():
            row, b = following[state], state % SYMBOLS
            for text, cost, d in choices:
                if not text or (d == BOUNDARY and b == BOUNDARY):
                    s = score + cost
                    if (old := reached.get(state)) is None or s > old[0]:
                        reached[state] = (s, link)
                else:
                    key, s = b * SYMBOLS + d, score + cost + row[d]
                    if (old := reached.get(key)) is None or s > old[0]:
                        reached[key] = (s, (text, link))
        states = reached
    (_, link) = max(((score + (following[state][BOUNDARY] if state % SYMBOLS else 0.0), link) for state, (score, link) in states.items()), key=lambda x: x[0])
    out = []
    while link:
        out.append(link[0])
        link = link[1]
    return "".join(reversed(out)).strip()


class Restorer:
    """Words of texts: those that stand there, and those restored."""

    #: Words of texts, and of those other than words, that are remembered, about.
    REMEMBERED = 200_000
    REMEMBERED_MIXED = 50_000

    def __init__(self, model: CharModel):
        self.model, self.known = model, {}
        #: Words met since the last turn, and what those are restored to that are restored to others; and the same of the turn before,
        #: of which the ones still in use come over.
        self.met: set[str] = set()
        self.changed: dict[str, list[str]] = {}
        self.older: set[str] = set()
        self.older_changed: dict[str, list[str]] = {}

    def restored(self, seen: str) -> str:
        found = restore_apart(seen, self.model) if seen.isalpha() else None
        return restore(seen, self.model) if found is None else found

    def read(self, seen: str) -> str:
        if seen not in self.known:
            if len(self.known) >= self.REMEMBERED_MIXED:
                self.known.clear()
            self.known[seen] = self.restored(seen)
        return self.known[seen]

    def learn(self, words: set[str]) -> None:
        self.met |= words
        again = words & self.older
        for w in again & self.older_changed.keys():
            self.changed[w] = self.older_changed[w]
        for w in words - again:
            if disguised(w) and (found := self.restored(w)) != w:
                self.changed[w] = found.split()

    def spaced(self, text: str) -> set[str]:
        """Spaced-out words."""
        if len(text) < 5:
            return set()
        # three in a row that stand alone, two or three places apart; other characters than the table's may be anything
        try:
            kinds = np.frombuffer(b" ".join([b"", text.encode("latin-1"), b""]).translate(_KINDS), np.uint8)
            alone = np.flatnonzero((kinds[1:-1] != 0) & ((kinds[:-2] | kinds[2:]) & 1 == 0))
        except UnicodeEncodeError:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            near, at = points < 0x180, np.minimum(points, 0x17F)
            alnum = np.zeros(len(points) + 2, bool)
            alnum[1:-1] = _ALNUM[at] & near
            alone = np.flatnonzero((_UNIT[at] | ~near) & ~alnum[:-2] & ~alnum[2:])
        if len(alone) < 3:
            return set()
        marks = np.zeros(len(text) + 6, bool)
        marks[alone + 3] = True
        if not ((marks[alone] | marks[alone + 1]) & (marks[alone + 5] | marks[alone + 6])).any():
            return set()
        return {m.group(0) for m in SPACED.finditer(text)}

    def words(self, text: str | None) -> tuple[set[str], set[str]]:
        if not text:
            return set(), set()
        if not text.isascii() and any(c in text for c in INVISIBLE):
            text = "".join(c for c in text if c not in INVISIBLE)
        tokens = set(text.split())
        cores = {t.strip(OUTER) for t in tokens}
        alphabetic = [c for c in cores if c.isalpha()]
        plain = set(" ".join(alphabetic).lower().split())
        if new := plain.difference(self.met):
            if len(self.met) > self.REMEMBERED // 2:
                self.older, self.older_changed, self.met, self.changed = self.met, self.changed, set(), {}
                new = plain
            self.learn(new)
        restored: set[str] = set()
        for w in plain & self.changed.keys():
            restored.update(self.changed[w])
        suspects = self.spaced(text)
        if len(alphabetic) < len(cores):
            for core in cores.difference(alphabetic):
                plain.update(PIECES.findall(core.lower()))
                if len(core) > 2 and any(c.isalpha() for c in core):
                    suspects.add(core)
            # signs at the ends may be letters too
            suspects.update(t for t in tokens if t[0] in "$@|(!<+*#" and len(t) > 2)
            suspects.update(t for t in tokens if t[-1] in "$@|+*#" and len(t) > 2)
        for s in suspects:
            restored.update(self.read(s).split())
        return plain, restored - plain


MIN_STEM, MAX_STEM = 3, 7


def traits(words: set[str]) -> set[str]:
    """The stems of 3 to 7 letters that words begin with, and each whole word, marked $."""
    out = {w + "$" for w in words}
    for k in range(MIN_STEM, MAX_STEM + 1):
        out.update([w[:k] for w in words if len(w) >= k])
    return out


@dataclass
class ToxicModel:
    chars: CharModel
    stems: dict[str, int]
    weights: list[float]
    bias: float
    heads: set[str] = field(default_factory=set)
    wholes: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.heads = {s[:MIN_STEM] for s in self.stems}
        self.wholes = {s[:-1] for s in self.stems if s.endswith("$")}

    def counts(self, words: set[str]) -> dict[int, int]:
        n: dict[int, int] = defaultdict(int)
        heads, wholes, stems = self.heads, self.wholes, self.stems
        for w in [w for w in words if w[:MIN_STEM] in heads or w in wholes]:
            for k in range(MIN_STEM, min(MAX_STEM, len(w)) + 1):
                if (i := stems.get(w[:k])) is not None:
                    n[i] += 1
            if (i := stems.get(w + "$")) is not None:
                n[i] += 1
        return n

    def score(self, words: set[str]) -> float:
        x = self.bias + math.fsum(self.weights[i] * math.log1p(c) for i, c in self.counts(words).items())
        return 1.0 / (1.0 + math.exp(-x)) if x > -30 else 0.0


def _choose(rows: list[tuple[str, int, int]], toxic: int, clean: int, most: int) -> list[str]:
    """Stems that tell toxic from clean texts, none that a shorter or a longer one makes redundant."""

    def gain(a: int, b: int) -> float:
        p, s = (a + b) / (toxic + clean), 0.0
        for k, n in ((a, toxic), (b, clean)):
            for x, e in ((k, n * p), (n - k, n * (1 - p))):
                if x > 0:
                    s += x * math.log(x / e)
        return s

    told = [(gain(a, b), f, a, b) for f, a, b in rows if a * (clean + 1) > 2 * (b + 0.5) * toxic]
    told = sorted((x for x in told if x[0] >= 8), key=lambda x: (-round(x[0], 6), -len(x[1]), x[1]))
    chosen: dict[str, tuple[int, int]] = {}
    for _, f, a, b in told:
        core = f.rstrip("$")
        shorter = [chosen[core[:k]] for k in range(MIN_STEM, len(core) + (f != core)) if core[:k] in chosen]
        # a shorter stem that is as sure says it all; a shorter one than a chosen one must see more
        if any((b + 0.5) * (x + 1) >= (y + 0.5) * (a + 1) for x, y in shorter) or any(g.startswith(core) and (a, b) == n for g, n in chosen.items()):
            continue
        chosen[f] = (a, b)
        if len(chosen) == most:
            break
    return list(chosen)


def _fit(x: np.ndarray, y: np.ndarray, decay: float = 3e-6, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; the bias does not decay."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 1.0 / (0.25 * 1.05 * float(np.linalg.norm(x.T @ (x @ v))) / len(y) + decay)
    shrink = np.full(x.shape[1], decay, x.dtype)
    shrink[-1] = 0
    w, z, t = np.zeros(x.shape[1], x.dtype), np.zeros(x.shape[1], x.dtype), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        new = z - step * (x.T @ (p - y) / len(y) + shrink * z)
        grown = (1 + math.sqrt(1 + 4 * t * t)) / 2
        w, z, t = new, new + (t - 1) / grown * (new - w), grown
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labelled: DataFrame, text: str = "text", max_rows: int = 20_000, max_stems: int = 400) -> ToxicModel:
    """Model from all texts of docs (characters) and the labelled ones (words).

    labelled has columns text and toxic (0 or 1; null rows don't count).  Of
    more than max_rows of its rows, about so many are taken, by a hash of the
    text.  The driver gathers counts of stems that occur in at least four
    toxic texts, and the chosen stems' counts in those rows.  Without rows of
    both kinds every score is 0.
    """
    chars = character_model(docs, text)
    labelled = labelled.select(F.col(f"`{text}`").alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    by_kind = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    n = sum(by_kind.values())
    if len(by_kind) < 2:
        return ToxicModel(chars, {}, [], -math.inf)
    if n > max_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))

    @returning("toxicity")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, seen = Restorer(chars), {0: Counter(), 1: Counter()}
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                plain, restored = read.words(t.as_py())
                seen[y].update(traits(plain | restored))
                seen[y][""] += 1
        names = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(names), 100_000):
            part = names[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[1][f] for f in part], pa.int64()), pa.array([seen[0][f] for f in part], pa.int64())], ["stem", "toxic", "clean"])

    found = labelled.mapInArrow(count, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 4 OR stem = ''")
    rows = [tuple(r) for r in found.collect()]
    toxic, clean = next(((a, b) for f, a, b in rows if f == ""), (0, 0))
    if not toxic or not clean:
        return ToxicModel(chars, {}, [], -math.inf)
    stems = {f: i for i, f in enumerate(_choose([r for r in rows if r[0]], toxic, clean, max_stems))}
    blank = ToxicModel(chars, stems, [], 0.0)

    @returning("toxicity")
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Restorer(chars)
        for batch in batches:
            found = [blank.counts(set().union(*read.words(t.as_py()))) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], ["toxic", "stem", "n"]
            )

    rows = labelled.mapInArrow(vectors, "toxic int, stem array<int>, n array<int>").collect()
    x, y = np.zeros((len(rows), len(stems)), np.float32), np.array([r[0] for r in rows], np.float32)
    for i, (_, at, n) in enumerate(rows):
        x[i, at] = np.log1p(n)
    weights, bias = _fit(x, y)
    return ToxicModel(chars, stems, [float(w) for w in weights], bias)


def score_texts(df: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """Rows of df as column record (struct of all columns) with score, restored and n_restored.

    score is from 0 to 1, higher for likelier toxic, and a function of the
    text alone; null and empty texts have the score of no words.  restored
    joins the words that only deobfuscation found.
    """

    @returning("toxicity")
    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = Restorer(model.chars)
        for column in columns:
            out = []
            for t in column:
                plain, restored = read.words(t.as_py())
                out.append({"score": model.score(plain | restored), "restored": " ".join(sorted(restored)), "n_restored": len(restored)})
            yield pa.array(out, pa.struct([("score", pa.float64()), ("restored", pa.string()), ("n_restored", pa.int32())]))

    @arrow_udf("struct<score:double,restored:string,n_restored:int>")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from scores(columns)

    scored = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("record"), score(df[text]).alias("s"))
    return scored.select("record", "s.score", "s.restored", "s.n_restored")


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = 20_000) -> DataFrame:
    """text and toxic of the labelled rows of docs, about max_rows of them at most, chosen by a hash of the key.

    The chosen labels are few enough to broadcast.
    """
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    labels = labels.select(F.col(key).alias("_key"), "toxic").where("toxic IN (0, 1)").dropDuplicates(["_key"])
    n = labels.count()
    if n > max_rows:
        labels = labels.where(F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    return docs.join(F.broadcast(labels), F.col("key") == F.col("_key")).select("text", "toxic")
