"""Similarity join of documents on word n-grams by a prefix tree, and the groups that its links form.

Texts with equal sets form one class. Sets are ordered by an estimate of how many classes hold a shingle (a count sketch of fixed size,
the same for all), ties by hash, and two sets that are similar enough share one of the first few shingles. Which classes
share one is found with a shuffle by shingle; what they share must make up the overlap that their sizes ask for. Classes that
are still connected form a candidate group, and only there do whole sets meet: in blocks of bounded weight, each a prefix tree that
the sets of the block walk. The tree reads the common order from its other end, so that beginnings are shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import vectext as vt
from .bits import build_filter
from .graph import components
from .storage import saved
from .trie import Least, similar_pairs

SKETCH_BITS = 21
_PARTS = 64
#: Tasks' sketches that are summed at once, on average; the sums again, until few are left.
MERGED = 64
#: Weight of one chunk of a group: its shingles and SET_WEIGHT for each set. Two chunks meet in a block; small groups share one.
CHUNK = 1 << 17
SET_WEIGHT = 32
#: Sets of which a task remembers that it has met them; what it forgets and meets again is merged later.
_REMEMBERED = 1 << 17
#: A shingle that starts more classes than this ties them to one of them instead of in pairs.
HOT_CLASSES = 64


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """Of each text with words: its place, its set of shingles by hash, and the hash of the set."""
    h, where = vt.shingles(*vt.words(data, offsets), size)
    for k in np.flatnonzero(np.diff(where)):
        own = np.unique(h[where[k] : where[k + 1]])
        yield int(k), own, int(vt.mix64(vt.mix64(own).sum(keepdims=True) + np.uint64(len(own))).view(np.int64)[0])


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _remember(seen: set[int], digest: int) -> None:
    if len(seen) >= _REMEMBERED:
        seen.clear()
    seen.add(digest)


def describe(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """For each document ``doc_id``, ``n_shingles`` and ``class`` (null for an empty set); and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "class", "part", "counts"]
        sketch, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
        for batch in batches:
            n, classes, known = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            data, offsets = vt.text_bytes(batch.column(1))
            for i, j in vt.slices(offsets):
                for k, own, digest in _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size):
                    n[i + k], classes[i + k], known[i + k] = len(own), digest, True
                    if digest not in seen:
                        _remember(seen, digest)
                        np.add.at(sketch, _slot(own), np.uint32(1))
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(classes, mask=~known), none, pa.nulls(batch.num_rows, pa.binary())], names)
        if seen:
            blobs = [x.tobytes() for x in sketch.reshape(_PARTS, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(_PARTS, kind), pa.nulls(_PARTS, pa.int64()), pa.nulls(_PARTS, pa.int64()), pa.array(np.arange(_PARTS, dtype=np.int32)), pa.array(blobs)], names)

    field = docs.select("doc_id").schema.fields[0]
    kind = to_arrow_type(field.dataType)
    every = saved(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {field.dataType.simpleString()}, n_shingles bigint, class bigint, part int, counts binary"), "sets")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // _PARTS, np.int64)
        for blob in pdf["counts"]:
            total += np.frombuffer(blob, np.uint32)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    parts = every.filter(F.col("part").isNotNull()).select("part", "counts")
    tasks = parts.filter("part = 0").count()
    while tasks > MERGED:  # so that no group grows with the number of tasks
        tasks = -(-tasks // MERGED)
        parts = saved(parts.groupBy("part", F.pmod(F.xxhash64("counts"), F.lit(tasks)).alias("salt")).applyInPandas(add, "part int, counts binary"), "sketches")
        tasks = parts.filter("part = 0").count()
    parts = parts.groupBy("part").applyInPandas(add, "part int, counts binary").toArrow().sort_by("part")
    sketch = np.frombuffer(b"".join(parts["counts"].to_pylist()), np.uint32) if len(parts) else np.zeros(1 << SKETCH_BITS, np.uint32)
    return every.filter(F.col("part").isNull()).select("doc_id", "n_shingles", "class"), sketch


def first_shingles(docs: DataFrame, size: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """The first shingles of each class in the common order: ``token``, ``class``, ``n``. A class may come from several tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = sent.value, set()
        for batch in batches:
            data, offsets = vt.text_bytes(batch.column(0))
            for i, j in vt.slices(offsets):
                tokens, classes, sizes = [np.zeros(0, np.uint64)], [], []
                for _, own, digest in _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size):
                    if digest not in seen:
                        _remember(seen, digest)
                        first = len(own) - -(-percent * len(own) // 100) + 1
                        tokens.append(own[np.argsort(sketch[_slot(own)], kind="stable")[:first]])
                        classes.append(digest)
                        sizes.append(len(own))
                each = [len(t) for t in tokens[1:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(vt.signed(np.concatenate(tokens))), pa.array(np.repeat(np.array(classes, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int64), each))], ["token", "class", "n"]
                )

    return docs.select("text").mapInArrow(run, "token bigint, class bigint, n bigint")


def candidate_edges(firsts: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes (``a``, ``b``) whose components hold every pair that can be similar enough.

    Counts by shingle are summed within tasks first, so a shingle of very many classes is many rows nowhere but in joins, which Spark splits.
    """
    firsts = saved(firsts, "first-shingles")
    several = firsts.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("token")
    met = saved(firsts.join(several, "token", "left_semi").distinct(), "met-firsts")
    held = met.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min("class").alias("least"))
    shared = saved(met.join(held, "token"), "shared-firsts")
    hot = shared.filter(F.col("held") > HOT_CLASSES)
    ties = hot.select(F.col("class").alias("a"), F.col("least").alias("b")).filter("a <> b")
    small = shared.filter(F.col("held") <= HOT_CLASSES).select("token", "class", "n")
    other = small.select("token", F.col("class").alias("b"), F.col("n").alias("n_b"))
    a = small.select("token", F.col("class").alias("a"), F.col("n").alias("n_a"))
    close = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.col("a") < F.col("b"))
    pairs = a.join(other, "token").filter(close).groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("common"))
    # Hot shingles may be common to both as well, but to no more than either has.
    hots = hot.groupBy("class").agg(F.count(F.lit(1)).alias("hot"))
    pairs = pairs.join(hots.select(F.col("class").alias("a"), F.col("hot").alias("hot_a")), "a", "left").join(hots.select(F.col("class").alias("b"), F.col("hot").alias("hot_b")), "b", "left")
    common = F.col("common") + F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0)))
    # Beyond its first shingles a set of n has one less than percent of n.
    rest = F.ceil(F.greatest("n_a", "n_b") * percent / 100) - 1
    strong = (common + rest) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    return saved(pairs.filter(strong).select("a", "b").unionByName(ties).distinct(), "candidate-edges")


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """Which blocks each class (``class``, ``n``, ``copies``, ``root``) goes to: ``block`` and ``side`` (1 for the tree's sets, 2 for those that walk it, 3 for both).

    A group's sets stand by size, those of one size by hash, and are cut into chunks of equal weight. The places follow from counts
    by size, so that no task sorts a group.
    """
    weight = F.col("n") + SET_WEIGHT
    sizes = members.groupBy("root", "n").agg((F.count(F.lit(1)) * weight).alias("held"))
    by = Window.partitionBy("root").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumns({"before": F.coalesce(F.sum("held").over(by), F.lit(0)), "whole": F.sum("held").over(Window.partitionBy("root"))})
    fraction = F.pmod(F.xxhash64("class"), F.lit(1 << 20)) / (1 << 20)
    chunk = F.when(F.col("whole") <= CHUNK, 0).otherwise(F.floor((F.col("before") + fraction * F.col("held")) / CHUNK)).cast("int")
    dealt = saved(members.join(placed, ["root", "n"]).select("class", "n", "copies", "root", "whole", chunk.alias("chunk")), "join-members")
    small, large = dealt.filter(F.col("whole") <= CHUNK), dealt.filter(F.col("whole") > CHUNK)
    bins = 1 + (small.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0] or 0) // CHUNK
    alone = small.select("class", "copies", "root", F.concat(F.lit("bin "), F.pmod(F.xxhash64("root"), F.lit(bins)).cast("string")).alias("block"), F.lit(3).alias("side"))
    chunks = saved(large.groupBy("root", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high")), "join-chunks")
    left = chunks.select("root", F.col("chunk").alias("i"), F.col("high").alias("high_i"))
    right = chunks.select("root", F.col("chunk").alias("j"), F.col("low").alias("low_j"))
    # Chunks ascend by size of set, so two are too far apart if the first's largest is below percent of the second's smallest.
    met = left.join(right, "root").filter((F.col("i") <= F.col("j")) & (F.col("high_i") * 100 >= F.col("low_j") * percent))
    name = F.concat_ws(" ", F.lit("pair"), "root", "i", "j")
    sides = met.select("root", F.col("i").alias("chunk"), name.alias("block"), F.when(F.col("i") == F.col("j"), 3).otherwise(1).alias("side")).unionByName(
        met.filter("i < j").select("root", F.col("j").alias("chunk"), name.alias("block"), F.lit(2).alias("side"))
    )
    return alone.unionByName(large.join(sides, ["root", "chunk"]).select("class", "copies", "root", "block", "side"))


def _whole_sets(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """Sets of the wanted classes: ``class``, ``hashes``."""
    sent = docs.sparkSession.sparkContext.broadcast(build_filter(wanted, "class"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = sent.value, set()
        for batch in batches:
            data, offsets = vt.text_bytes(batch.column(0))
            for i, j in vt.slices(offsets):
                found = [(digest, own) for _, own, digest in _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)]
                keep = known.passes(np.array([d for d, _ in found], np.int64)) if found else []
                rows = [x for x, k in zip(found, keep, strict=True) if k and x[0] not in seen]
                rows = list({d: (d, own) for d, own in rows}.values())
                for d, _ in rows:
                    _remember(seen, d)
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([own.tobytes() for _, own in rows], pa.binary())], ["class", "hashes"])

    return docs.select("text").mapInArrow(run, "class bigint, hashes binary").dropDuplicates(["class"])


def linked_classes(docs: DataFrame, members: DataFrame, size: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """Of each class in a candidate group and each of its blocks: ``class``, ``to`` (the smallest class it reaches there), ``links`` (documents of other classes that it links with there) and ``whole`` (whether its group has but that block)."""
    dealt = _whole_sets(docs, size, members).join(_blocks(members, percent), "class")
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        classes, copies, side, roots = (table[c].to_numpy() for c in ("class", "copies", "side", "root"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["hashes"]]
        whole = (side == 3).all()
        common = lambda tokens: sent.value[_slot(tokens)]
        links, least = np.zeros(len(sets)), Least(len(sets))
        for a, b in similar_pairs(sets, percent, groups=roots, indexed=None if whole else side == 1, asked=None if whole else side == 2, weigh=common):
            links += np.bincount(a, copies[b], len(sets)) + np.bincount(b, copies[a], len(sets))
            least.link(a, b)
        return pa.table({"class": classes, "to": classes[least.of], "links": links.astype(np.int64), "whole": pa.array([table["block"][0].as_py().startswith("bin")] * len(sets))})

    linked = saved(dealt.groupBy("block").applyInArrow(join, "class bigint, to bigint, links bigint, whole boolean"), "linked")
    sent.destroy()
    return linked


def ngram_groups(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of similar documents: ``doc_id``, ``n_shingles``, ``component_id``, ``n_links``, one row for each row of ``docs``.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct word shingles (A-Z lower-cased). A text of
    fewer words than a shingle has its whole sequence as its only one. ``component_id`` is the smallest doc_id
    that links reach, itself included; ``n_links`` counts the documents that one links with.

    A null text, or one without words, has an empty set and links with nothing. Rows that repeat an id are documents of their own; a null
    id has no part in a group's smallest. An empty table gives an empty result; other columns are ignored.
    """
    described, sketch = describe(docs, shingle_words)
    classes = described.filter(F.col("class").isNotNull()).groupBy("class").agg(F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    classes = saved(classes, "classes")
    candidates = components(candidate_edges(first_shingles(docs, shingle_words, percent, sketch), percent))
    members = saved(classes.join(candidates, F.col("class") == F.col("node")).select("class", "n", "copies", "root"), "members")
    linked = linked_classes(docs, members, shingle_words, percent, sketch)
    roots = components(linked.filter("NOT whole").select(F.col("class").alias("a"), F.col("to").alias("b")))
    roots = roots.unionByName(linked.filter("whole").select(F.col("class").alias("node"), F.col("to").alias("root")))
    links = linked.groupBy("class").agg(F.sum("links").alias("links"))
    joined = classes.join(roots, F.col("class") == F.col("node"), "left").withColumn("group", F.coalesce("root", "class")).select("class", "copies", "least", "group")
    smallest = joined.groupBy("group").agg(F.min("least").alias("component_id"))
    known = joined.join(smallest, "group").join(links, "class", "left").select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = described.join(saved(known, "class-groups"), "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
