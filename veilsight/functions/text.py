"""Text columns: normalising, clause splitting, words, phrases."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from veilsight.config import LONG_SENTENCE_WORDS, MIN_CLAUSE_WORDS, NOT_TEXT

#: Fixed patterns of the clause rules: what ends a sentence, what is no part of a clause's ends, words that begin another clause.
SENTENCE_ENDS = "\n.!?;"
EDGES = " \t\n\x0b\f\r,;:.-"
#: By their first letters, so that a place is tried once.
CONJUNCTIONS = "a(?:nd|lthough|fter)|b(?:ut|ecause|efore)|wh(?:ile|ereas|en)|though|however|since"
#: Characters that no text has, between parts and for a letter set aside.
MARK, ASIDE = "\ufdd0", "\ufdd1"
#: Fixed: signs that are upper case already, and the letters that they fold to.
SIGNS, LETTERS = "\u03f4\u1e9e\u2126\u212a\u212b", "\u03b8\u00df\u03c9\u006b\u00e5"
CLAUSE_MARKS_JA = "[。、]+"
#: The same for one text in Python: blanks and case are those of ASCII, as in Spark's patterns.
_BLANKS = re.compile(r"[\t\n\x0B\f\r]\s*|\s{2,}", re.A)
#: Both for texts in lower case, where no sign that becomes a letter of a conjunction keeps its length.
_CONJUNCTION = [re.compile(rf"{apart}(?:{CONJUNCTIONS})\s+", re.A) for apart in ("", r"(?:(?<=\s)|(?<=\s,))")]
_APART, _RARE = str.maketrans(SIGNS + "ı", LETTERS + ASIDE), re.compile(f"[{SIGNS}\u0130ı]")

#: Fixed word lists of the default tagger.
DETERMINERS = ("a", "an", "the")
STOPWORDS = (
    "i", "me", "my", "we", "our", "ours", "you", "your", "he", "him", "his", "she", "her", "hers", "it", "its", "they", "them", "their",
    "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "can", "will", "just", "should", "now",
)
PREPOSITION_TAGS = ("of", "at", "in", "from", "for", "with", "on", "by", "as", "into", "over", "under", "about", "between", "through", "during", "against", "after", "before")
ADJECTIVE_ENDS = ("able", "ible", "al", "ful", "ic", "ive", "less", "ous", "ish")


def normalize_clause(c: Column) -> Column:
    """Without blanks and marks at the ends, and with single spaces."""
    return single_spaced(F.btrim(c, F.lit(EDGES)))


def single_spaced(c: Column) -> Column:
    # single spaces stay as they are, so nothing is put in for them
    return F.regexp_replace(c, r"[\t\n\x0B\f\r]\s*|\s{2,}", " ")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(c: Column) -> Column:
    """Case folded away, as equal texts but for case have it: upper case, which spells ligatures, ß and final sigmas out.

    Upper case leaves some signs apart from the letters they stand for, and
    takes the dotless i for an i; these are told apart before.
    """
    named = F.translate(F.replace(c, F.lit("\u0130"), F.lit("i\u0307")), SIGNS + "ı", LETTERS + ASIDE)
    return F.when(F.octet_length(c) == F.char_length(c), F.upper(c)).otherwise(F.upper(named))


def dedupe(array: Column) -> Column:
    """The first of the strings that are equal but for case, in their order; nulls left out.

    Where all differ, as most often, they are compared by one list of their
    folded forms; else sorting brings equal ones together, so that long arrays
    take little more than their length.
    """

    def firsts_of(given: Column) -> Column:
        named = F.transform(given, lambda x, i: F.struct(fold(x).alias("low"), i.alias("i"), x.alias("x")))
        firsts = let(F.array_sort(named), lambda a: F.filter(a, lambda s, i: (i == 0) | (s["low"] != F.get(a, i - 1)["low"])))
        return F.transform(F.array_sort(F.transform(firsts, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])

    def whole(given: Column) -> Column:
        low = F.split(fold(F.array_join(given, MARK)), MARK)
        return F.when((F.size(low) == F.size(given)) & (F.size(F.array_distinct(low)) == F.size(low)), given).otherwise(firsts_of(given))

    return let(F.array_compact(array), whole)


def _folded(t: str) -> str:
    """`fold` of one text."""
    return t.upper() if t.isascii() or not _RARE.search(t) else t.replace("\u0130", "i\u0307").translate(_APART).upper()


def _sentences(t: str) -> list[str]:
    """Parts between the ends of sentences, with single spaces."""
    for end in SENTENCE_ENDS:
        t = t.replace(end, ".")
    if "  " in t or any(blank in t for blank in "\t\x0b\f\r"):
        t = _BLANKS.sub(" ", t)
    return t.split(".")


def _at_conjunctions(s: str, word_boundary: bool) -> list[str]:
    """Parts of a sentence before, between and after conjunctions in any case."""
    low = s.lower()
    if len(low) != len(s):  # one sign is longer in lower case; it is no letter of a conjunction
        low = s.replace("\u0130", "\u0131").lower()
    parts, at = [], 0
    for m in _CONJUNCTION[word_boundary].finditer(low):
        parts.append(s[at : m.start()])
        at = m.end()
    return [*parts, s[at:]]


def _tidy(parts: list[str]) -> list[str]:
    return [x for p in parts if (x := p.strip(EDGES))]


def clauses_of(t: str | None, word_boundary: bool = False, words: int = 0) -> list[str] | None:
    """Clauses of one text: sentences, the long ones split at conjunctions; the first of those that are equal but for case.

    Without word_boundary a conjunction may also end a longer word, as in
    b/and played.  Clauses of fewer words than given are left out, unless all are.
    """
    if t is None:
        return None
    found: dict[str, str] = {}
    for s in _tidy(_sentences(t)):
        parts = _tidy(_at_conjunctions(s, word_boundary)) if s.count(" ") >= LONG_SENTENCE_WORDS else []
        for x in parts if len(parts) > 1 else [s]:
            found.setdefault(_folded(x), x)
    out = list(found.values())
    return [x for x in out if x.count(" ") + 1 >= words] or out


def _clauses(c: Column, word_boundary: bool, words: int) -> Column:
    @arrow_udf("array<string>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([clauses_of(t, word_boundary, words) for t in column.to_pylist()], pa.list_(pa.string()))

    return run(c)


def rule_clauses(text: Column, word_boundary: bool = False) -> Column:
    """Sentences, the long ones split at conjunctions; repeats left out."""
    return _clauses(text, word_boundary, 0)


class ClauseSplitter(Protocol):
    """What splits a text column into an array of clauses."""

    def split(self, text: Column) -> Column: ...


class RuleSplitter:
    def __init__(self, word_boundary: bool = False):
        self.word_boundary = word_boundary

    def split(self, text: Column) -> Column:
        return _clauses(text, self.word_boundary, MIN_CLAUSE_WORDS)


class MarkSplitter:
    """Parts between full stops and commas of Japanese text."""

    def split(self, text: Column) -> Column:
        return F.filter(F.transform(F.split(text, CLAUSE_MARKS_JA, -1), F.trim), lambda x: x != "")


class PartnerSplitter:
    """A splitter of another library: a function from text to clauses, run over Arrow batches."""

    def __init__(self, function):
        self.function = function

    def split(self, text: Column) -> Column:
        function = self.function

        @arrow_udf("array<string>")
        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                yield pa.array([list(function(t)) if t is not None else [] for t in column.to_pylist()], pa.list_(pa.string()))

        return run(text)


class PartnerMorphemes:
    """Tokens of another library's tagger: a function from text to (token, part of speech) pairs, run over Arrow batches."""

    def __init__(self, function):
        self.function = function

    def __call__(self, c: Column) -> Column:
        function = self.function
        pair = pa.struct([("token", pa.string()), ("pos", pa.string())])

        @arrow_udf("array<struct<token:string,pos:string>>")
        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                found = [[{"token": w, "pos": p} for w, p in function(t)] if t is not None else [] for t in column.to_pylist()]
                yield pa.array(found, pa.list_(pair))

        return run(c)


def normalize_field(df: DataFrame, name: str) -> Column:
    """A text or list-of-text column as an array of its trimmed, non-empty texts; null is empty."""
    c = df[name]
    kind = dict(df.dtypes)[name]
    array = F.coalesce(c, F.array().cast(kind)) if kind.startswith("array") else F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c.cast("string")))
    array = F.transform(array, lambda x: F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"^\s+|\s+$", ""))
    return F.filter(array, lambda x: x != "")


def aliases(field: str) -> list[str]:
    return [field, field[: -len("_list")]] if field.endswith("_list") else [field, f"{field}_list"]


def resolve_field(df: DataFrame, field: str) -> Column:
    """The first alias of a field that is there and not empty in the row."""
    present = [normalize_field(df, a) for a in aliases(field) if a in df.columns]
    if not present:
        raise ValueError(f"no column {field} or alias of it")
    out = present[-1]
    for c in reversed(present[:-1]):
        out = F.when(F.size(c) > 0, c).otherwise(out)
    return out


def text_fields(df: DataFrame) -> list[str]:
    """String and list-of-string columns whose first row holds at least 16 characters and two words."""
    names = [c for c, kind in df.dtypes if kind in ("string", "array<string>") and c not in NOT_TEXT]
    if not names:
        return []
    long = lambda x: (F.length(x) >= 16) & (word_count(x) >= 2)
    first = df.limit(1).select(*[F.exists(normalize_field(df, c), long).alias(c) for c in names]).first()
    return [c for c in names if first is not None and first[c]]


def words(c: Column) -> Column:
    """Runs of a to z in the lower-cased text, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


#: All bytes but those of a to z as blanks.
_NO_LETTERS = bytes(b if 97 <= b <= 122 else 32 for b in range(256))


def words_of(t: str) -> list[str]:
    """`words` of one text that is in lower case."""
    return t.encode().translate(_NO_LETTERS).decode("ascii").split()


def tag(word: Column) -> Column:
    """D, I, J, N or O: determiner, preposition, adjective, noun, other; by word lists and endings."""
    ends = F.lit(False)
    for e in ADJECTIVE_ENDS:
        ends = ends | F.endswith(word, F.lit(e))
    return (
        F.when(word.isin(*DETERMINERS), "D")
        .when(word.isin(*PREPOSITION_TAGS), "I")
        .when(word.isin(*STOPWORDS), "O")
        .when(ends & (F.length(word) > 4), "J")
        .otherwise("N")
    )


def tag_of(word: str) -> str:
    """`tag` of one word."""
    if word in DETERMINERS:
        return "D"
    if word in PREPOSITION_TAGS:
        return "I"
    if word in STOPWORDS:
        return "O"
    return "J" if len(word) > 4 and word.endswith(ADJECTIVE_ENDS) else "N"


def part_of_speech(word: Column) -> Column:
    t = tag(word)
    return F.when(t == "N", "NN").when(t == "J", "JJ").when(t == "D", "DT").when(t == "I", "IN").otherwise("XX")


def content_word(word: Column, pos: Column, min_chars: int = 3, prefix: str = "NN") -> Column:
    """Alphabetic, long enough, of the wanted part of speech, and no stopword."""
    return F.rlike(word, F.lit("^[A-Za-z]+$")) & (F.length(word) >= min_chars) & F.startswith(pos, F.lit(prefix)) & ~word.isin(*STOPWORDS)


def morphemes(c: Column) -> Column:
    """The words of a text as structs of token and pos, by the default tags."""
    return F.transform(words(c), lambda w: F.struct(w.alias("token"), part_of_speech(w).alias("pos")))


_BASE = r"(?:D:\S+ )?(?:J:\S+ )*(?:N:\S+ )+"
GRAMMARS = {"base": _BASE, "pp1": f"{_BASE}(?:I:\\S+ {_BASE})?", "chain": f"{_BASE}(?:I:\\S+ {_BASE})*"}


def _letter(pos: Column) -> Column:
    return F.when(F.startswith(pos, F.lit("NN")), "N").when(F.startswith(pos, F.lit("JJ")), "J").when(pos == "DT", "D").when(pos == "IN", "I").otherwise("O")


def tagged(c: Column, tagger=None) -> Column:
    """The words of a text as `tag:word `, one after another, by the default tags or by those that tagger gives.

    The default tags are put in by a pattern a tag over the whole text, in
    the order in which `tag` tries them; a word that has one is met by no later
    pattern.
    """
    if tagger is not None:
        letters = F.transform(tagger(c), lambda m: F.concat(_letter(m["pos"]), F.lit(":"), F.lower(m["token"])))
        return F.concat(F.array_join(letters, " "), F.lit(" "))
    out = F.concat(F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " ")), F.lit(" "))
    for mark, listed in (("D", DETERMINERS), ("I", PREPOSITION_TAGS), ("O", STOPWORDS)):
        out = F.regexp_replace(out, rf"(?<!\S)({'|'.join(listed)}) ", f"{mark}:$1 ")
    # longer than four letters
    out = F.regexp_replace(out, rf"(?<!\S)((?=[a-z]{{5}})[a-z]*(?:{'|'.join(ADJECTIVE_ENDS)})) ", "J:$1 ")
    return F.regexp_replace(out, r"(?<!\S)([a-z]+) ", "N:$1 ")


def segments(c: Column, grammar: str = "base", tagger=None) -> Column:
    """A text's noun phrases and the words between them, in their order, each as words with spaces."""
    cut = F.regexp_replace(tagged(c, tagger), rf"({GRAMMARS[grammar]}|\S+ )", "$1\x1f")
    words_alone = F.regexp_replace(cut, "(?<![^ \x1f])[DIJNO]:", "")
    return F.split(F.regexp_replace(words_alone, " ?\x1f?$", ""), " \x1f")


def noun_phrases(c: Column, grammar: str = "base", tagger=None) -> Column:
    """Noun phrases of a text, by a chunk grammar over the default tags, or those that tagger gives: a function from the text column to structs of token and pos."""
    found = F.regexp_extract_all(tagged(c, tagger), F.lit(GRAMMARS[grammar]), F.lit(0))
    return F.transform(found, lambda p: F.trim(F.regexp_replace(p, r"(?<!\S)[DIJN]:", "")))


def lemma(word: Column) -> Column:
    """Singular of a noun by its ending."""
    return (
        F.when(F.rlike(word, F.lit("[^aeiou]ies$")) & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
        .when(F.rlike(word, F.lit("(ss|x|z|ch|sh)es$")), F.regexp_replace(word, "es$", ""))
        .when(F.rlike(word, F.lit("[^su]s$")) & (F.length(word) > 3), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def lemma_of(word: str) -> str:
    """`lemma` of one word."""
    if word.endswith("ies") and len(word) > 4 and word[-4] not in "aeiou":
        return word[:-3] + "y"
    if word.endswith(("sses", "xes", "zes", "ches", "shes")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and len(word) > 3 and word[-2] not in "su" else word


def normalize_phrase(c: Column, lemmatize: bool = True) -> Column:
    """Lower case, without articles, each word its lemma."""
    kept = F.regexp_replace(F.lower(c), rf"(?<!\S)(?:{'|'.join(DETERMINERS)})(?!\S)", " ")
    kept = F.trim(F.regexp_replace(kept, r"\s+", " "))
    return lemmas(kept) if lemmatize else kept


def lemmas(c: Column) -> Column:
    """Words with single spaces, each its lemma: the rules of `lemma` as patterns over the whole."""
    c = F.regexp_replace(c, r"(?<=\S[^aeiou\s])ies(?=\s|$)", "y")
    c = F.regexp_replace(c, r"(?<=ss|x|z|ch|sh)es(?=\s|$)", "")
    return F.regexp_replace(c, r"(?<=\S\S[^su\s])s(?=\s|$)", "")


def longest_phrase(phrases: Column, word: Column) -> Column:
    """The longest phrase that has the word, the first of equals; the word itself if none has."""
    has = F.filter(phrases, lambda p: F.array_contains(F.split(F.lower(p), " "), word))
    best = F.array_max(F.transform(has, lambda p, i: F.named_struct(F.lit("n"), F.length(p), F.lit("i"), -i, F.lit("p"), p)))
    return F.coalesce(best["p"], word)


def canonical(array: Column) -> Column:
    """Sorted and without repeats or nulls: the form of every attribute set."""
    return F.array_sort(F.array_distinct(F.array_compact(array)))


def json_key(array: Column) -> Column:
    """The set as JSON text with a space after each comma."""
    quoted = F.transform(array, lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


@arrow_udf(T.StringType())
def nfkc(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """NFKC form, trimmed, lower-cased; Spark has no such function."""
    for column in columns:
        yield pa.array([None if t is None else unicodedata.normalize("NFKC", t).strip().lower() for t in column.to_pylist()], pa.string())
