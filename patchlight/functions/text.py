"""Predicates on text and paths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as v
from .guards import folded, may_hold


def rx(text: Column, pattern: str) -> Column:
    """Whether a pattern is found, without regard to case; only ``\\n`` ends a line, and classes are Unicode's."""
    return text.rlike(f"(?idU){pattern}")


def rx_guarded(text: Column, low: Column | str, pattern: str) -> Column:
    """As ``rx``, for a long text with its ``folded`` copy: the pattern runs only where the text holds a word that it needs."""
    return may_hold(low, pattern) & rx(text, pattern)


def rx_case(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?dU){pattern}")


def n_found(text: Column, pattern: str, *, case: bool = False) -> Column:
    return F.regexp_count(text, F.lit(f"{'(?dU)' if case else '(?idU)'}{pattern}"))


def increased(after: Column, before: Column, pattern: str, *, case: bool = False) -> Column:
    """Whether a pattern occurs more often in one text than in another. Where it isn't in the first, the second isn't read."""
    return (rx_case if case else rx)(after, pattern) & (n_found(after, pattern, case=case) > n_found(before, pattern, case=case))


def stripped(text: Column) -> Column:
    """Without white space at both ends; Spark's trim takes only spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def extension(path: Column) -> Column:
    """From the last dot on, lower-cased; empty without a dot."""
    return F.when(path.contains("."), F.concat(F.lit("."), F.lower(F.substring_index(path, ".", -1)))).otherwise("")


def is_document(path: Column) -> Column:
    """The narrow test: by extension, name, or the docs folder."""
    return extension(path).isin(v.DOC_EXTENSIONS) | rx(path, v.DOC_NAME) | F.lower(path).startswith("docs/")


def is_doc_path(path: Column) -> Column:
    """The wide test: also changelogs and changesets."""
    return is_document(path) | F.lower(path).contains("/changelog") | F.lower(path).contains(".changeset/")


def has_extension(files: Column, extensions: list[str]) -> Column:
    ends = "|".join(e.lstrip(".") for e in extensions)
    return F.exists(files, lambda f: F.lower(f).rlike(rf"\.({ends})$"))


def is_release_subject(subject: Column) -> Column:
    s = stripped(F.coalesce(subject, F.lit("")))
    return rx(s, v.RELEASE_SUBJECT) | rx(s, v.VERSION_BUMP)


def is_code_path(path: Column) -> Column:
    """A source file that isn't one of those a release touches."""
    return rx_case(path, v.CODE_EXTENSION) & ~rx(path, v.RELEASE_FILE)


def is_security_flavoured(message: Column) -> Column:
    low, out = folded(message), F.lit(False)
    for pattern in (v.CVE, v.GHSA, v.CWE, v.VULN_CLASS, v.SECURITY_NOUN, v.ADVISORY):
        out = out | rx_guarded(message, low, pattern)
    return out


def advisory_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?idU){v.ADVISORY_ID}"), F.lit(0))


def sha_references(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?dU){v.SHA_REFERENCE}"), F.lit(1))
