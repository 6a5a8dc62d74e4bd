"""Line-first cleaning: rules judge each line, failing lines go, and a text that loses too much is rejected.

Columns only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import unused

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: A line passes the punctuation rule if it ends like a sentence ...
SENTENCE_END = r"[.!?\x{2026}][\"'\x{201D}\x{2019}\x{00BB})\]]*[\x20\x09-\x0D]*$"
#: ... or is at least this long; runs of exclamation or question marks and other symbols must be rarer than one in so many words.
LONG_LINE_WORDS = 10
WORDS_PER_SHOUT = 4
WORDS_PER_SYMBOL = 4
#: Separators of menus and breadcrumbs.
SEPARATOR = r"[|\x{00BB}\x{203A}\x{2022}\x{00B7}]"
WORDS_PER_SEPARATOR = 4
BOILERPLATE = r"(?i)(all rights reserved|licensed under|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies|enable javascript|lorem ipsum|sign up for our newsletter|share on (facebook|twitter)|powered by|copyright (\(c\)|\x{00A9}|[0-9]{4}))"
#: Words that must stay, of a hundred.
KEPT_PERCENT = 70
LEAST_WORDS = 50


def line_passes(line: Column) -> Column:
    """Whether a line passes the punctuation, navigation and boilerplate rules. A line without words fails none."""
    words = F.regexp_count(line, F.lit(WORD))
    ends = line.rlike(SENTENCE_END) | (words >= LONG_LINE_WORDS)
    calm = F.regexp_count(line, F.lit(r"[!?]{2,}")) * WORDS_PER_SHOUT <= words
    plain = F.regexp_count(line, F.lit(SYMBOL)) * WORDS_PER_SYMBOL <= words
    no_menu = F.regexp_count(line, F.lit(SEPARATOR)) * WORDS_PER_SEPARATOR <= words
    return (words == 0) | (ends & calm & plain & no_menu & ~line.rlike(BOILERPLATE))


def with_repeated_words(docs: DataFrame, words: str, into: str) -> DataFrame:
    """Adds how many of the words stand in a three-word window that the list holds at least twice.

    Windows are compared by 64-bit hash. Sorting tells whether any repeats; only then do their places matter.
    Each array is a column of its own, so that no lambda makes it again for every element.
    """
    held, at = unused("windows", docs.columns), unused("places", docs.columns)
    last = F.size(words) - 3
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    docs = docs.withColumn(held, F.when(last >= 0, windows))
    distinct = F.size(F.array_distinct(held))
    places = F.sort_array(F.transform(held, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn(at, F.when(distinct < F.size(held), places))
    before, after = F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1)
    pairs = F.filter(F.zip_with(before, after, lambda a, b: F.struct(a["h"].alias("h"), b["h"].alias("g"), a["i"].alias("i"), b["i"].alias("j"))), lambda x: x["h"] == x["g"])
    covered = F.flatten(F.transform(pairs, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2, x["j"], x["j"] + 1, x["j"] + 2)))
    return docs.withColumn(into, F.coalesce(F.when(F.col(at).isNotNull(), F.size(F.array_distinct(covered))), F.lit(0)).cast("long"))


def clean_lines(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``n_failed_lines``, ``clean_text``, ``kept``.

    ``clean_text`` has the lines that pass, in order. A text is kept if the base counts are right (at least 50
    words, at most half of them in repeated windows) and its passing lines hold at least 70 of a hundred words.

    A null or empty text has no words, so it fails. Lines end at ``\\n``; repeated rows are judged alike; an empty table
    gives an empty result. Columns of ``docs`` that have the names of the new ones are replaced.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_failed_lines", "clean_text", "kept"]
    own = [c for c in docs.columns if c not in new]
    whole, words, lines, full, passing = (unused(c, docs.columns) for c in ("whole_text", "word_list", "line_list", "full_lines", "passing_lines"))
    base = docs.select(*own, F.coalesce(F.col(text_col), F.lit("")).alias(whole))
    split = base.withColumns({words: F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), lines: F.split(whole, "\n", -1)})
    counted = split.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(whole, F.lit(SYMBOL)).cast("long"),
            full: F.filter(lines, lambda x: x.rlike(WORD)),
            passing: F.filter(lines, line_passes),
        }
    )
    cleaned = with_repeated_words(counted, words, "n_repeat_words").withColumns(
        {
            "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
            "n_failed_lines": (F.size(lines) - F.size(passing)).cast("long"),
            "clean_text": F.array_join(passing, "\n"),
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
        }
    )
    stay = F.regexp_count("clean_text", F.lit(WORD)) * 100 >= F.col("n_words") * KEPT_PERCENT
    return cleaned.withColumn("kept", ~F.col("base_failed") & stay).select(*own, *new)
