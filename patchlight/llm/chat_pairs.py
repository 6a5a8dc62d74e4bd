"""Preference formatting: the longest common turn prefix of chosen and rejected, rendered once, with masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

#: Buckets of conversations with one opening, for about so many conversations in all; and the mean size of a group that lends answers.
OPENING_BUCKETS, CONVERSATIONS = 64, 1 << 20
LENDERS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rendered(turn: Column) -> Column:
    """A turn (``role``, ``text``) as chat markup."""
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE))


def loss_spans(turns: Column) -> Column:
    """Where the assistant's words, with the mark that ends them, stand in the rendering of ``turns``: [begin, end) pairs."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        size = F.length(rendered(turn)).cast("long")
        begin = state["at"] + F.length(turn["role"]) + (len(OPEN) + 1)
        end = state["at"] + size - 1
        spans = F.when(turn["role"] == "assistant", F.concat(state["spans"], F.array(F.array(begin, end)))).otherwise(state["spans"])
        return F.struct((state["at"] + size).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def conversations(turns: DataFrame) -> DataFrame:
    """Each conversation (``conv_id``) with its ``turns`` (``role``, ``text``) in order of turn; ties go by role and text, null is empty text. Null ids are left out."""
    texts = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("given"), "turn", "role", "text")))
    return texts.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def last_answer(turns: Column) -> Column:
    """The place, from 1, of the last turn of the assistant; 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(turns, lambda t, k: F.when(t["role"] == "assistant", k + 1))), F.lit(0))


def n_common(chosen: Column, rejected: Column) -> Column:
    """How many turns two conversations have in common from the start, by role and text."""
    same = F.zip_with(chosen, rejected, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Format each pair of conversations (``chosen_turns`` and ``rejected_turns``, as ``conversations`` makes them; null rejected turns are an unpaired chosen).

    Adds ``n_common`` (turns of the prompt), ``prompt``, ``chosen``, ``rejected`` and the spans that training may
    see, ``chosen_mask`` and ``rejected_mask``, in characters of each completion; the turns go. The prompt is the longest common prefix
    of turns, rendered once. Where one conversation is the other's prefix, the shorter's completion is empty. An unpaired
    conversation's prompt is all before its last assistant turn. Repeated rows are formatted alike; an empty table gives an empty result.
    """
    c, r = F.col("chosen_turns"), F.col("rejected_turns")
    common = F.when(r.isNull(), F.greatest(last_answer(c) - 1, F.lit(0))).otherwise(n_common(c, r))
    cut = pairs.withColumn("n_common", common.cast("int"))
    tail = lambda x: F.slice(x, F.col("n_common") + 1, F.greatest(F.size(x) - F.col("n_common"), F.lit(0)))
    empty = F.array().cast("array<struct<role:string,text:string>>")
    parts = cut.select(*[x for x in cut.columns if x not in ("chosen_turns", "rejected_turns")], F.slice(c, 1, F.col("n_common")).alias("p"), tail(c).alias("c"), F.coalesce(tail(r), empty).alias("r"))
    text = lambda x: F.array_join(F.transform(x, rendered), "")
    kept = [x for x in parts.columns if x not in ("p", "c", "r")]
    return parts.select(*kept, text(F.col("p")).alias("prompt"), text(F.col("c")).alias("chosen"), text(F.col("r")).alias("rejected"), loss_spans(F.col("c")).alias("chosen_mask"), loss_spans(F.col("r")).alias("rejected_mask"))


def _bucket(conv_id: Column, buckets: int) -> Column:
    """A bucket by the hash of an id's text, so that ids may be sparse, or no numbers."""
    return F.conv(F.substring(F.md5(conv_id.cast("string")), 1, 8), 16, 10).cast("long") % buckets


def neighbours(whole: DataFrame) -> DataFrame:
    """Pairs (``chosen_id``, ``rejected_id``) of ``conversations`` that open with the same turn; one that is left over has no rejected_id.

    Those with one opening stand in the order of their ids, dealt out in groups of two: the longer (the lower id if equal)
    is chosen. The order is met within buckets by the id's hash first, and only the odd
    one of each bucket goes on, so a very common opening is not sorted by one task.
    """
    first = F.get("turns", F.lit(0))
    opening = whole.select("conv_id", F.size("turns").alias("n"), F.sha2(F.concat(F.length(first["role"]).cast("string"), F.lit(":"), first["role"], first["text"]), 256).alias("opening"))

    def dealt(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
        by = Window.partitionBy(*keys).orderBy("conv_id")
        group = rows.withColumn("pair", F.floor((F.row_number().over(by) - 1) / 2)).groupBy(*keys, "pair")
        best = F.min(F.struct((-F.col("n")).alias("m"), "conv_id"))
        last = F.max(F.struct((-F.col("n")).alias("m"), "conv_id"))
        made = group.agg(best.alias("a"), last.alias("b"), F.count(F.lit(1)).alias("size"))
        full = made.filter("size = 2").select(F.col("a.conv_id").alias("chosen_id"), F.col("b.conv_id").alias("rejected_id"))
        return full, made.filter("size = 1").select("opening", F.col("a.conv_id").alias("conv_id"), (-F.col("a.m")).alias("n"))

    buckets = OPENING_BUCKETS * -(-max(whole.count(), 1) // CONVERSATIONS)
    near, odd = dealt(opening.withColumn("bucket", _bucket(F.col("conv_id"), buckets)), "opening", "bucket")
    far, left = dealt(odd, "opening")
    return near.unionByName(far).unionByName(left.select(F.col("conv_id").alias("chosen_id"), F.lit(None).cast(whole.schema["conv_id"].dataType).alias("rejected_id")))


def answer_givers(whole: DataFrame) -> DataFrame:
    """For ``conversations`` that have an answer: ``chosen_id`` and ``answer_id``, the next one of its group that has one too, the first after the last.

    Groups are by the id's hash, of LENDERS on average, so only one that is alone in its group, as it is where there is no other, has none.
    """
    answering = saved(whole.filter(last_answer(F.col("turns")) > 0).select("conv_id"), "answering")
    groups = -(-max(answering.count(), 1) // LENDERS)
    by = Window.partitionBy(_bucket(F.col("conv_id"), groups)).orderBy("conv_id")
    next_id = F.coalesce(F.lead("conv_id").over(by), F.first("conv_id").over(by))
    return answering.select(F.col("conv_id").alias("chosen_id"), next_id.alias("answer_id")).filter("answer_id <> chosen_id")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of all conversations of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``), as ``format_pairs`` takes them.

    Conversations with one opening are paired (``rejected_id``). One that has no such partner is rejected with another's answer in place of its own last one
    (``answer_id``), so that what comes before is common; without an answer, or with nobody to give one, it has no partner.
    """
    whole = saved(conversations(turns), "conversations")
    pairs = saved(neighbours(whole), "conversation-pairs")
    chosen = whole.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen_turns"))
    other = lambda c: whole.select(F.col("conv_id").alias(c), F.col("turns").alias("rejected_turns"))
    columns = ["chosen_id", "rejected_id", "answer_id", "chosen_turns", "rejected_turns"]
    null_id = F.lit(None).cast(whole.schema["conv_id"].dataType)
    natural = pairs.filter(F.col("rejected_id").isNotNull()).join(chosen, "chosen_id").join(other("rejected_id"), "rejected_id").withColumn("answer_id", null_id)
    alone = saved(pairs.filter(F.col("rejected_id").isNull()).select("chosen_id").join(chosen, "chosen_id"), "conversations-alone")
    givers = saved(answer_givers(alone.select(F.col("chosen_id").alias("conv_id"), F.col("chosen_turns").alias("turns"))), "answer-givers")
    lent = alone.join(givers, "chosen_id").join(other("answer_id"), "answer_id")
    answer = F.element_at("rejected_turns", last_answer(F.col("rejected_turns")))
    lent = lent.withColumns({"rejected_turns": F.concat(F.slice("chosen_turns", 1, last_answer(F.col("chosen_turns")) - 1), F.array(answer)), "rejected_id": null_id})
    none = alone.join(givers, "chosen_id", "left_anti").withColumns({"rejected_id": null_id, "answer_id": null_id, "rejected_turns": F.lit(None).cast("array<struct<role:string,text:string>>")})
    return natural.select(columns).unionByName(lent.select(columns)).unionByName(none.select(columns))
