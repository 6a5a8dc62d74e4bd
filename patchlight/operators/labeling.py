"""Labeling functions: each is a column that votes +1 (security), 0 (not security) or -1 (abstains)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.guards import folded
from ..functions.text import has_extension, increased, is_doc_path, is_document, rx, rx_case, rx_guarded, stripped

SECURITY, NOT_SECURITY, ABSTAIN = 1, 0, -1


@dataclass(frozen=True)
class LabelingFunction:
    """A vote: its name, the side it takes when it fires, its role, and its condition over a commit's columns and shared facts."""

    name: str
    polarity: int
    role: str
    fires: Callable[[], Column]

    def vote(self) -> Column:
        return F.when(F.coalesce(self.fires(), F.lit(False)), self.polarity).otherwise(ABSTAIN).cast("tinyint").alias(self.name)


@dataclass(frozen=True)
class BatchFunction:
    """A labeling function in Python, for what columns can't say: ``vote`` gets a frame of the named ``columns`` of a batch of commits, and
    gives a vote for each row. Null is an abstention; anything but 1, 0 and -1, or another number of votes, fails.
    """

    name: str
    polarity: int
    columns: tuple[str, ...]
    vote: Callable[[pd.DataFrame], Sequence]
    role: str = "python"

    def cast(self, frame: pd.DataFrame) -> pd.Series:
        """Votes as integers. An exception says which function it came from."""
        try:
            votes = pd.Series(list(self.vote(frame[list(self.columns)])), dtype="object")
            if len(votes) != len(frame):
                raise ValueError(f"{len(votes)} votes on {len(frame)} commits")
            votes = votes.where(votes.notna(), ABSTAIN)
            if not votes.isin((SECURITY, NOT_SECURITY, ABSTAIN)).all():
                raise ValueError(f"votes other than 1, 0 and -1: {sorted(set(map(str, votes)))[:5]}")
            return votes.astype("int8")
        except Exception as e:
            raise RuntimeError(f"labeling function {self.name}: {e}") from e


def row_function(name: str, polarity: int, columns: Sequence[str], vote: Callable[..., int | None]) -> BatchFunction:
    """A function of one commit's values, called for each row of a batch."""
    return BatchFunction(name, polarity, tuple(columns), lambda frame: [vote(*row) for row in frame.itertuples(index=False, name=None)])


def _python_votes(functions: Sequence[BatchFunction]) -> Column:
    """All Python functions' votes as one struct: their columns reach Python once, in Arrow batches."""
    columns = list(dict.fromkeys(c for f in functions for c in f.columns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({f.name: f.cast(frame).to_numpy() for f in functions})

    voted = F.pandas_udf(run, ", ".join(f"`{f.name}` tinyint" for f in functions))
    return voted(F.struct(*[F.col(c) for c in columns]))


def _flag(name: str) -> Column:
    return F.col(f"fact_{name}")


def message_facts(commits: DataFrame) -> DataFrame:
    """Adds what several labeling functions ask of message, subject and files, each worked out once.

    A message's patterns run only where its lower-cased copy holds one of the words that they need.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    files = F.coalesce(F.col("files"), F.array().cast("array<string>"))
    base = commits.withColumns({"fact_m": text("message"), "fact_low": folded(text("message")), "fact_s": text("subject"), "fact_f": files})
    m, s, f = F.col("fact_m"), F.col("fact_s"), F.col("fact_f")
    found = lambda pattern: rx_guarded(m, "fact_low", pattern)
    every = lambda test: (F.size(f) > 0) & F.forall(f, test)
    return base.withColumns(
        {
            "fact_cve": found(v.CVE),
            "fact_ghsa": found(v.GHSA),
            "fact_cwe": found(v.CWE),
            "fact_class": found(v.VULN_CLASS),
            "fact_noun": found(v.SECURITY_NOUN),
            "fact_fix": found(v.FIX_VERB),
            "fact_advisory": found(v.ADVISORY),
            "fact_security_paths": F.size(F.filter(f, lambda x: rx(x, v.SECURITY_PATH))),
            "fact_note_dir": F.exists(f, lambda x: rx(x, v.SECURITY_NOTE_DIR)) & F.exists(f, lambda x: ~is_doc_path(x)),
            "fact_docs": every(is_document),
            "fact_tests": every(lambda x: rx(x, v.TEST_PATH)),
            "fact_ci": every(lambda x: rx(x, v.CI_PATH)),
            "fact_bot": rx(text("author_email"), v.BOT) | rx(text("author_name"), v.BOT),
            "fact_merge": F.coalesce(F.col("is_merge"), F.lit(False)),
            "fact_backport": F.col("fact_low").contains("security") & F.lower(m).contains("security") & F.lower(m).rlike(f"(?dU){v.BACKPORT}"),
            "fact_bounds": F.size(f).between(1, 4) & F.exists(f, lambda x: rx(x, v.PARSER_PATH)) & found(v.BOUNDS_CHECK),
            "fact_crash": found(v.UNTRUSTED) & rx(m, v.CRASH),
            "fact_bump": rx(s, v.VERSION_BUMP),
            "fact_style": rx(s, v.STYLE),
            "fact_short": F.length(stripped(m)) < 8,
            "fact_feature": rx(stripped(s), v.CONVENTIONAL_PREFIX),
        }
    )


def _huge() -> Column:
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return ((n("n_files") > 50) | (n("insertions") + n("deletions") > 5000)) & ~_flag("cve")


def _positive(name: str, fires: Callable[[], Column]) -> LabelingFunction:
    return LabelingFunction(name, SECURITY, "message", fires)


def _negative(name: str, fires: Callable[[], Column]) -> LabelingFunction:
    return LabelingFunction(name, NOT_SECURITY, "message", fires)


POSITIVE = [
    _positive("lf_cve_id", lambda: _flag("cve")),
    _positive("lf_ghsa_id", lambda: _flag("ghsa")),
    _positive("lf_cwe_id", lambda: _flag("cwe")),
    _positive("lf_vuln_class", lambda: _flag("class")),
    _positive("lf_fix_plus_security_noun", lambda: _flag("fix") & _flag("noun")),
    _positive("lf_advisory_language", lambda: _flag("advisory")),
    _positive("lf_security_backport", lambda: _flag("backport")),
    _positive("lf_security_paths_and_fix", lambda: _flag("fix") & (_flag("security_paths") >= F.greatest(F.lit(1), F.floor(F.size(_flag("f")) / 2)))),
    _positive("lf_security_note_path", lambda: _flag("note_dir")),
    _positive("lf_bounds_check_in_parser", lambda: _flag("bounds")),
    _positive("lf_crash_on_untrusted_input", lambda: _flag("crash")),
]
NEGATIVE = [
    _negative("lf_docs_only", lambda: _flag("docs")),
    _negative("lf_tests_only", lambda: _flag("tests")),
    _negative("lf_ci_only", lambda: _flag("ci")),
    _negative("lf_merge_commit", lambda: _flag("merge") & ~_flag("cve")),
    _negative("lf_bot_author", lambda: _flag("bot") & ~_flag("cve")),
    _negative("lf_version_bump", lambda: _flag("bump") & ~_flag("cve")),
    _negative("lf_typo_or_style", lambda: _flag("style") & ~_flag("noun")),
    _negative("lf_feature_commit", lambda: _flag("feature") & ~_flag("noun") & ~_flag("class")),
    _negative("lf_huge_diff", _huge),
    _negative("lf_empty_message", lambda: (F.size(_flag("f")) == 0) & _flag("short")),
]
DERIVED = [
    LabelingFunction("lf_release_of_security_fix", SECURITY, "derived", lambda: F.col("release_window_positive")),
    LabelingFunction("lf_patch_cites_fix_commit", SECURITY, "derived", lambda: ~_flag("merge") & F.col("patch_cites_fix_commit")),
]
MESSAGE = POSITIVE + NEGATIVE

#: (family, vote on the surface alone, vote on the mitigation, vote on both)
FAMILIES = [
    ("sql", "lf_diff_sql_query_touched", "lf_diff_sql_parameterized", "lf_diff_sqli_fix"),
    ("xss", "lf_diff_dom_sink_touched", "lf_diff_output_escaping_added", "lf_diff_xss_fix"),
    ("path", "lf_diff_path_op_touched", "lf_diff_path_normalization_added", "lf_diff_path_traversal_fix"),
    ("authz", "lf_diff_resource_lookup_touched", "lf_diff_authz_check_added", "lf_diff_authz_fix"),
    ("memory", "lf_diff_memory_api_touched", "lf_diff_bounds_guard_added", "lf_diff_memory_safety_fix"),
    ("dos", "lf_diff_unbounded_work_touched", "lf_diff_resource_limit_added", "lf_diff_dos_hardening_fix"),
]


def diff_facts(commits: DataFrame) -> DataFrame:
    """Adds surface and mitigation of each family, from ``diff_added`` and ``diff_removed``, after ``message_facts``."""
    a, r = F.coalesce(F.col("diff_added"), F.lit("")), F.coalesce(F.col("diff_removed"), F.lit(""))
    either = lambda p: rx(a, p) | rx(r, p)
    system = has_extension(_flag("f"), v.SYSTEM_EXTENSIONS)
    guarded = rx_case(a, v.MEM_GUARD) & (increased(a, r, v.MEM_GUARD, case=True) | increased(a, r, v.MEM_REJECT, case=True))
    comments = F.array_join(F.filter(F.split(a, "\n", -1), lambda x: rx_case(x, v.COMMENT_LINE)), "\n")
    facts = commits.withColumns(
        {
            "fact_sql": either(v.SQL_SURFACE),
            "fact_sql_better": increased(a, r, v.SQL_PARAM) | increased(r, a, v.SQL_RAW_INTERP),
            "fact_xss": either(v.XSS_SINK),
            "fact_xss_better": increased(a, r, v.XSS_ESCAPE) | increased(r, a, v.XSS_HTML_CONCAT, case=True) | increased(r, a, v.XSS_SINK),
            "fact_path": either(v.PATH_SURFACE),
            "fact_path_better": increased(a, r, v.PATH_MITIG),
            "fact_authz": either(v.AUTHZ_SURFACE),
            "fact_authz_better": increased(a, r, v.AUTHZ_MITIG),
            "fact_memory": system & either(v.MEM_SURFACE),
            "fact_memory_better": system & (increased(a, r, v.MEM_MITIG, case=True) | guarded),
            "fact_dos": either(v.DOS_SURFACE),
            "fact_dos_better": increased(a, r, v.DOS_MITIG),
            "fact_concurrency": rx(comments, v.CONCURRENCY_COMMENT),
        }
    )
    excused = _flag("security_paths") > 0
    for known in ("cve", "ghsa", "cwe", "class", "noun", "advisory", *[f"{family}_better" for family, *_ in FAMILIES]):
        excused = excused | _flag(known)
    # Only a touched surface asks for an excuse, so other commits' messages aren't searched for one.
    touched = reduce(or_, [_flag(family) for family, *_ in FAMILIES])
    return facts.withColumn("fact_excused", touched & excused)


def _family(family: str, surface: str, mitigation: str, both: str) -> list[LabelingFunction]:
    touched, better = (lambda: _flag(family)), (lambda: _flag(f"{family}_better"))
    return [
        LabelingFunction(surface, NOT_SECURITY, "surface", lambda: touched() & ~_flag("excused")),
        LabelingFunction(mitigation, SECURITY, "mitigation", better),
        LabelingFunction(both, SECURITY, "conjunction", lambda: touched() & better()),
    ]


DIFF = [lf for family in FAMILIES for lf in _family(*family)] + [LabelingFunction("lf_diff_comment_names_concurrency_bug", SECURITY, "standalone", lambda: _flag("concurrency"))]
ALL = MESSAGE + DERIVED
ALL_WITH_DIFF = ALL + DIFF


def apply_lfs(commits: DataFrame, lfs: Sequence[LabelingFunction | BatchFunction]) -> DataFrame:
    """``commits`` with one vote column per labeling function, in the order given.

    Facts come in one projection and votes in the next, so no pattern runs twice; Python functions share one pass over Arrow batches of the
    columns that they name. Diff functions need ``diff_added`` and ``diff_removed``; the derived ones abstain where their column is
    absent, as do user-made ones that return null. Commits that have ``message_facts`` already are taken with them.
    """
    in_python = [lf for lf in lfs if isinstance(lf, BatchFunction)]
    ready = commits.withColumn("__python", _python_votes(in_python)) if in_python else commits
    if len(in_python) < len(lfs) and "fact_cve" not in commits.columns:
        ready = message_facts(ready)
    if any(lf.role in ("surface", "mitigation", "conjunction", "standalone") for lf in lfs):
        ready = diff_facts(ready)
    for column in ("release_window_positive", "patch_cites_fix_commit"):
        if column not in ready.columns:
            ready = ready.withColumn(column, F.lit(False))
    return ready.select(*commits.columns, *[F.col("__python")[lf.name].alias(lf.name) if isinstance(lf, BatchFunction) else lf.vote() for lf in lfs])


def long_votes(votes: DataFrame, names: Sequence[str], *ids: str) -> DataFrame:
    """Vote columns as rows: the ids, ``lf`` and ``vote``."""
    return votes.unpivot([*ids], [*names], "lf", "vote")


def wide_votes(votes: DataFrame, names: Sequence[str], *ids: str) -> DataFrame:
    """Rows as vote columns again; of several votes of one function on one id the largest counts.

    One aggregation with an entry for each id: a pivot would first keep one for each id and function.
    """
    return votes.groupBy(*ids).agg(*[F.max(F.when(F.col("lf") == name, F.col("vote"))).alias(name) for name in names])
