"""Measures of labeling functions and labels, as small tables. Gold is positive-unlabeled, so no precision is given."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .combine import n_votes


def lf_table(votes: DataFrame, polarity: Mapping[str, int], gold: str | None = None, code: str | None = None) -> DataFrame:
    """Per function ``lf``, ``polarity``, ``observed`` (the votes that it cast, joined by commas), ``fired``, ``coverage``, ``overlaps``, ``conflicts`` and, with gold, ``gold_hits``, ``correct``, ``incorrect``, ``accuracy``.

    Counts of both votes per row say what overlaps and conflicts, so it is one pass with one row out. ``correct`` counts cast votes
    that equal gold (null is false). ``code`` flags rows that change code; with it ``code_gold_hits`` counts those of the hits.
    """
    names = list(polarity)
    rows = votes.withColumns({"__yes": n_votes(names, 1), "__no": n_votes(names, 0)})
    is_gold = F.coalesce(F.col(gold), F.lit(False)) if gold else F.lit(False)
    is_code = F.coalesce(F.col(code), F.lit(False)) if code else F.lit(False)
    sums = [F.count(F.lit(1)).alias("rows")]
    for c in names:
        cast = F.col(c) != -1
        sums += [
            F.count_if(cast).alias(f"{c}|fired"),
            F.count_if(F.col(c) == 0).alias(f"{c}|no"),
            F.count_if(F.col(c) == 1).alias(f"{c}|yes"),
            F.count_if(cast & (F.col("__yes") + F.col("__no") > 1)).alias(f"{c}|overlaps"),
            F.count_if(((F.col(c) == 1) & (F.col("__no") > 0)) | ((F.col(c) == 0) & (F.col("__yes") > 0))).alias(f"{c}|conflicts"),
            F.count_if((F.col(c) == polarity[c]) & is_gold).alias(f"{c}|gold"),
            F.count_if((F.col(c) == polarity[c]) & is_gold & is_code).alias(f"{c}|code"),
            F.count_if(cast & (F.col(c) == is_gold.cast("int"))).alias(f"{c}|correct"),
        ]
    one = rows.agg(*sums)
    each = F.explode(
        F.array(*[F.struct(F.lit(c).alias("lf"), F.lit(polarity[c]).alias("polarity"), *[F.col(f"`{c}|{k}`").alias(k) for k in ("fired", "no", "yes", "overlaps", "conflicts", "gold", "code", "correct")]) for c in names])
    )
    flat = one.select("rows", each.alias("x")).select("rows", "x.*")
    share = lambda c: F.when(F.col("rows") > 0, F.col(c) / F.col("rows")).otherwise(0.0)
    observed = F.concat_ws(",", F.when(F.col("no") > 0, "0"), F.when(F.col("yes") > 0, "1")).alias("observed")
    out = flat.select("lf", "polarity", observed, "fired", share("fired").alias("coverage"), share("overlaps").alias("overlaps"), share("conflicts").alias("conflicts"), "gold", F.col("code").alias("code_gold_hits"), "correct")
    if not code:
        out = out.drop("code_gold_hits")
    if not gold:
        return out.drop("gold", "correct")
    return out.withColumnRenamed("gold", "gold_hits").withColumns({"incorrect": F.col("fired") - F.col("correct"), "accuracy": F.when(F.col("fired") > 0, F.col("correct") / F.col("fired"))})


def headline(votes: DataFrame, polarity: Mapping[str, int], *, label: str = "label", mv: str = "mv_label", gold: str = "is_gold") -> DataFrame:
    """One row: rows, those with and without votes, those flagged, and how gold fares by model, majority, any vote and veto; unions of coverage by side."""
    names = list(polarity)
    yes, no, g = n_votes(names, 1), n_votes(names, 0), F.coalesce(F.col(gold), F.lit(False))
    rows = votes.select(yes.alias("y"), no.alias("n"), g.alias("g"), F.col(label).alias("l"), F.col(mv).alias("m"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.expr("y + n > 0")).alias("any_vote"),
        F.count_if(F.expr("y + n = 0")).alias("no_vote"),
        F.count_if(F.expr("l = 1")).alias("flagged"),
        F.count_if("g").alias("gold"),
        F.count_if(F.expr("g and l = 1")).alias("gold_by_model"),
        F.count_if(F.expr("g and m = 1")).alias("gold_by_majority"),
        F.count_if(F.expr("g and y > 0")).alias("gold_with_positive"),
        F.count_if(F.expr("g and n > 0")).alias("gold_vetoed"),
        F.count_if(F.expr("y > 0")).alias("any_positive"),
        F.count_if(F.expr("n > 0")).alias("any_negative"),
        F.count_if(F.expr("y > 0 and n > 0")).alias("both_sides"),
    )


def threshold_sweep(scored: DataFrame, cuts: Sequence[float], *, prob: str = "prob_security", gold: str = "is_gold", voted: Column | None = None) -> DataFrame:
    """Per cut-off ``threshold``: rows ``flagged``, their ``share`` of all, and ``gold_recovered``, in one pass. ``voted`` says which rows may be flagged."""
    counts = voted if voted is not None else F.lit(True)
    flagged = {k: counts & (F.col(prob) >= c) for k, c in enumerate(cuts)}
    one = scored.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(x).alias(f"f{k}") for k, x in flagged.items()], *[F.count_if(x & F.coalesce(F.col(gold), F.lit(False))).alias(f"g{k}") for k, x in flagged.items()])
    rows = F.array(*[F.struct(F.lit(float(c)).alias("threshold"), F.col(f"f{k}").alias("flagged"), F.col(f"g{k}").alias("gold_recovered")) for k, c in enumerate(cuts)])
    share = F.when(F.col("rows") > 0, F.col("x.flagged") / F.col("rows")).otherwise(0.0)
    return one.select("rows", F.explode(rows).alias("x")).select("x.threshold", "x.flagged", share.alias("share"), "x.gold_recovered")


def label_distribution(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Per label ``n`` and its ``share``."""
    counts = labelled.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("share"))


def gold_recall(labelled: DataFrame, label: str = "label", gold: str = "is_gold") -> DataFrame:
    """Over rows with a label: ``gold``, ``recovered``, ``recall``, and ``extra`` flagged rows that aren't gold."""
    g = F.coalesce(F.col(gold), F.lit(False))
    out = labelled.filter(F.col(label) != -1).agg(F.count_if(g).alias("gold"), F.count_if(g & (F.col(label) == 1)).alias("recovered"), F.count_if(~g & (F.col(label) == 1)).alias("extra"))
    return out.select("gold", "recovered", F.when(F.col("gold") > 0, F.col("recovered") / F.col("gold")).alias("recall"), "extra")


def cofire(patterns: DataFrame, positive: Sequence[str]) -> DataFrame:
    """Rows on which two positive functions both fire, ``a`` before ``b`` or the same, ``n``; from patterns, so commits aren't read again."""
    fired = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in positive]))
    held = patterns.select(fired.alias("fired"), "n")
    pairs = held.select(F.explode("fired").alias("a"), "fired", "n").select("a", F.explode("fired").alias("b"), "n").filter("a <= b")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def vetoes(votes: DataFrame, negative: Sequence[str], gold: str = "is_gold", code: str | None = None, label: str | None = None) -> DataFrame:
    """Per negative function ``lf`` the gold rows it votes against, ``n``, and those of them that no function supports, ``lone``.

    With ``code`` also those that change code, ``on_code``; with ``label`` those that aren't labeled security, ``on_missed``.
    """
    rows = votes.filter(F.coalesce(F.col(gold), F.lit(False)))
    flags = {"lone": F.col("n_positive") == 0}
    if code:
        flags["on_code"] = F.coalesce(F.col(code), F.lit(False))
    if label:
        flags["on_missed"] = F.col(label) != 1
    long = rows.select(F.explode(F.array_compact(F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in negative]))).alias("lf"), *[x.alias(k) for k, x in flags.items()])
    return long.groupBy("lf").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(k).alias(k) for k in flags])


def unions(votes: DataFrame, polarity: Mapping[str, int]) -> DataFrame:
    """Per side (``polarity``) its functions, ``lfs``, the share of rows that any of them votes on, ``covered``, the sum of their single shares, ``summed``, and the share with votes of both sides, ``both``."""
    sides = {p: [c for c, q in polarity.items() if q == p] for p in (1, 0)}
    counts = votes.select(*[n_votes(sides[p], p).alias(f"n{p}") for p in sides])
    one = counts.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.expr("n1 > 0 AND n0 > 0")).alias("both"), *[x for p in sides for x in (F.count_if(F.col(f"n{p}") > 0).alias(f"any{p}"), F.sum(f"n{p}").alias(f"sum{p}"))])
    rows = F.array(*[F.struct(F.lit(p).alias("polarity"), F.lit(len(own)).alias("lfs"), *[(F.col(x) / F.col("rows")).alias(k) for x, k in ((f"any{p}", "covered"), (f"sum{p}", "summed"), ("both", "both"))]) for p, own in sides.items()])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def fired_on(votes: DataFrame, lf: str, repo: str | None = None) -> DataFrame:
    """One row: on how many commits, of one repository or all, a function votes, ``n``, and what ``share`` of them that is."""
    rows = votes if repo is None else votes.filter(F.col("repo") == repo)
    out = rows.agg(F.count_if(F.col(lf) != -1).alias("n"), F.count(F.lit(1)).alias("rows"))
    return out.select("n", F.coalesce(F.col("n") / F.when(F.col("rows") > 0, F.col("rows")), F.lit(0.0)).alias("share"))


def missed_gold(votes: DataFrame, negative: Sequence[str], label: str = "label", gold: str = "is_gold") -> DataFrame:
    """Per repository the gold rows that aren't labeled security, ``n``, those without a label, ``abstained``, and those that a function votes against, ``vetoed``."""
    missed = votes.filter(F.coalesce(F.col(gold), F.lit(False)) & (F.col(label) != 1)).select("repo", F.col(label).alias("l"), n_votes(negative, 0).alias("against"))
    return missed.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("l = -1")).alias("abstained"), F.count_if(F.expr("against > 0")).alias("vetoed"))


def ranked_conjunctions(sample: DataFrame, conjunctions: Sequence[str], corpus_rows: Column, stratum: str = "stratum") -> DataFrame:
    """Conjunctions by their rate on the control stratum, the rarest first: ``rank``, ``lf``, ``gold_hits``, ``fired``, ``rate``, ``expected`` (firings in so many rows) and a verdict."""
    control, gold = F.col(stratum) == "control", F.col(stratum) == "gold"
    one = sample.agg(F.count_if(control).alias("n"), *[x for c in conjunctions for x in (F.count_if(control & (F.col(c) == 1)).alias(f"{c}|c"), F.count_if(gold & (F.col(c) == 1)).alias(f"{c}|g"))])
    rows = F.array(*[F.struct(F.lit(c).alias("lf"), F.col(f"`{c}|g`").alias("gold_hits"), F.col(f"`{c}|c`").alias("fired")) for c in conjunctions])
    rate = F.coalesce(F.col("fired") / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0))
    flat = one.select("n", F.explode(rows).alias("x")).select("x.*", "n").withColumn("rate", rate)
    verdict = F.when(F.col("gold_hits") == 0, "no gold evidence").when(F.col("rate") <= 0.001, "high precision").when(F.col("rate") <= 0.005, "usable").when(F.col("rate") <= 0.015, "loose").otherwise("too loose")
    # One row per function, so one task may rank them.
    rank = F.row_number().over(Window.orderBy("rate", "gold_hits", "lf"))
    return flat.select(rank.alias("rank"), "lf", "gold_hits", "fired", "rate", F.floor(F.col("rate") * corpus_rows).cast("long").alias("expected"), verdict.alias("verdict"))


def by_repo(votes: DataFrame, names: Sequence[str], gold: str = "is_gold", mv: str = "mv_label") -> DataFrame:
    """Per repository: commits, any vote, any positive, gold, flagged and its percentage to two places."""
    yes, no = n_votes(names, 1), n_votes(names, 0)
    rows = votes.select("repo", yes.alias("y"), no.alias("n"), F.coalesce(F.col(gold), F.lit(False)).alias("g"), F.col(mv).alias("m"))
    out = rows.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.count_if(F.expr("y + n > 0")).alias("any_vote"), F.count_if(F.expr("y > 0")).alias("any_positive"), F.count_if("g").alias("gold"), F.count_if(F.expr("m = 1")).alias("flagged"))
    return out.withColumn("flagged_percent", F.round(F.col("flagged") * 100 / F.col("commits"), 2))


def gold_detail(votes: DataFrame, polarity: Mapping[str, int], *ids: str, gold: str = "is_gold", mv: str = "mv_label", others: Sequence[str] = ()) -> DataFrame:
    """Per gold row the functions for it, ``positives``, and against it, ``vetoes`` (names joined by commas), its majority, and ``others`` (as its probability, label and whether it changes code)."""
    joined = lambda vote: F.array_join(F.array_compact(F.array(*[F.when(F.col(c) == vote, F.lit(c)) for c in polarity])), ",")
    return votes.filter(F.coalesce(F.col(gold), F.lit(False))).select(*ids, joined(1).alias("positives"), joined(0).alias("vetoes"), mv, *others)


def conversion(votes: DataFrame, names: Sequence[str], label: str = "label") -> DataFrame:
    """Rows by number of positive votes (3 stands for more): ``n_positive``, ``n`` and how many are labeled security."""
    rows = votes.select(F.least(n_votes(names, 1), F.lit(3)).alias("n_positive"), F.col(label).alias("l"))
    return rows.groupBy("n_positive").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("l = 1")).alias("labeled"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of a share; (0, 0) of nothing."""
    p = hits / F.when(n > 0, n)
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(0.0))


def control_rates(sample: DataFrame, names: Sequence[str], stratum: str = "stratum") -> DataFrame:
    """Per function its firings on the control stratum, with the interval of its rate and a verdict: precise, usable, loose."""
    control = sample.filter(F.col(stratum) == "control")
    one = control.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c) != -1).alias(c) for c in names])
    rows = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("lf"), F.col(c).alias("fired")) for c in names])).alias("x")).select("x.lf", "x.fired", "n")
    low, high = wilson(F.col("fired"), F.when(F.col("n") > 0, F.col("n")))
    rate = F.coalesce(F.col("fired") / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0))
    verdict = F.when(rate < 0.005, "precise").when(rate < 0.02, "usable").otherwise("loose")
    return rows.select("lf", "fired", "n", rate.alias("rate"), low.alias("low"), high.alias("high"), verdict.alias("verdict"))


def weak_functions(table: DataFrame, thin: float = 0.01) -> DataFrame:
    """Functions of ``lf_table`` that never fire (dead) or on fewer than one row in a hundred (thin)."""
    return table.filter(F.col("coverage") < thin).select("lf", "fired", F.when(F.col("fired") == 0, "dead").otherwise("thin").alias("state"))


def family_table(votes: DataFrame, families: Sequence[tuple[str, str, str, str]], gold: str = "is_gold") -> DataFrame:
    """Per family, on gold rows: those its surface vetoes, its mitigation hits and both together hit."""
    g = F.coalesce(F.col(gold), F.lit(False))
    sums = [x for f, s, m, b in families for x in (F.count_if(g & (F.col(s) == 0)).alias(f"{f}|s"), F.count_if(g & (F.col(m) == 1)).alias(f"{f}|m"), F.count_if(g & (F.col(b) == 1)).alias(f"{f}|b"))]
    rows = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"`{f}|s`").alias("surface_vetoes"), F.col(f"`{f}|m`").alias("mitigation_hits"), F.col(f"`{f}|b`").alias("both_hits")) for f, *_ in families])
    return votes.agg(*sums).select(F.explode(rows).alias("x")).select("x.*")


def control_trips(sample: DataFrame, conjunctions: Sequence[str], corpus_rows: Column, stratum: str = "stratum") -> DataFrame:
    """Control rows on which any conjunction fires, their rate, and what that makes of so many rows."""
    trips = F.greatest(*[F.col(c) for c in conjunctions]) == 1
    one = sample.filter(F.col(stratum) == "control").agg(F.count(F.lit(1)).alias("n"), F.count_if(trips).alias("tripped"))
    rate = F.coalesce(F.col("tripped") / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0))
    return one.select("n", "tripped", rate.alias("rate"), (rate * corpus_rows).alias("expected"))
