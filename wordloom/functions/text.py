"""Column -> Column text functions. Everything here stays in the JVM."""

from collections.abc import Collection

from pyspark.sql import Column, functions as F

from wordloom.constants import STOPWORDS

# Java's \s and \w are ASCII only, so Unicode spaces and word characters are spelled out.
SPACE = r"[\s\x0B\p{Z}]"
NON_WORD = r"[^\p{L}\p{N}_]+"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def keep_words(words: Column, stopwords: Collection[str] | None) -> Column:
    """Drop stopwords from an array of words; `None` keeps all."""
    if not stopwords:
        return words
    return F.filter(words, lambda w: ~w.isin(sorted(stopwords)))


def tokenize(text: Column, include_stopwords: bool = False, max_tokens: int | None = None) -> Column:
    """ASCII alphanumeric runs of three or more characters, lower-cased.

    A greedy run of three or more is the whole run, so short runs fall out in the same match.
    """
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]{3,}"), F.lit(0))
    words = F.transform(runs, F.lower)
    words = keep_words(words, None if include_stopwords else STOPWORDS)
    return words if max_tokens is None else F.slice(words, 1, max_tokens)


def tokenize_lowered(text: Column, include_stopwords: bool = False) -> Column:
    """Word-cloud variant: lower-case first, then take the runs."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return keep_words(runs, None if include_stopwords else STOPWORDS)


def tokenize_vocab(text: Column, pattern: str = "^[a-z0-9]{3,}$") -> Column:
    """Whole words that are ASCII alphanumeric: `foo_bar` and `cafés` give nothing."""
    return F.filter(F.split(F.lower(text), NON_WORD), lambda w: w.rlike(pattern))


def word_terms(text: Column) -> Column:
    """Unicode words of two or more characters, the vectorizers' unit."""
    return F.filter(F.split(F.lower(text), NON_WORD), lambda w: F.length(w) >= 2)


def space_tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def basic_clean(text: Column) -> Column:
    """Lower-case, punctuation to spaces, runs of spaces to one."""
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")
    return F.trim(spaced)


def remove_stopwords(text: Column, stopwords: Collection[str] = STOPWORDS) -> Column:
    return F.array_join(keep_words(space_tokens(text), stopwords), " ")


def sentences(text: Column) -> Column:
    """Trimmed sentences; a terminator followed by space ends one and is consumed."""
    pieces = F.transform(F.split(text, rf"[.?!]{SPACE}+"), strip)
    return F.filter(pieces, lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Rows of an unlabeled blob: blank lines or sentence ends separate them."""
    pieces = F.transform(F.split(text, rf"\n{{2,}}|[.!?]{SPACE}+"), strip)
    return F.filter(pieces, lambda s: s != "")


def chunks(text: Column, size: int) -> Column:
    """Consecutive windows of `size` characters as (start, chunk) structs, start from 0."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size)))
    return F.transform(starts, lambda s: F.struct(
        s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("chunk")))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of an array; shorter arrays give none."""
    if n == 1:
        return tokens
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)),
                        lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def truncate(text: Column, max_chars: int) -> Column:
    return F.substring(text, 1, max_chars)


def snippet(text: Column) -> Column:
    """The first 160 characters and an ellipsis when the text exceeds 180."""
    return F.when(F.length(text) > 180, F.concat(F.substring(text, 1, 160), F.lit("..."))).otherwise(text)


def unquote(text: Column) -> Column:
    """Drop one quote mark at each end."""
    return F.regexp_replace(text, "^[\"']|[\"']$", "")
