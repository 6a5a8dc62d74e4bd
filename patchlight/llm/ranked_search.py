"""Ranked search by TPUT (three-phase uniform threshold) over posting lists that are partitioned by term.

The documents' postings are kept for the queries' terms, each list in segments of documents. For every query, the highest entries of its
lists give a lower bound of its k-th best score; its share of that bound is the threshold under which no list needs to be read, as a
document with no entry above it can't reach the bound. What is read bounds every document's score from both sides, and only those that
may still be among the k best are looked up in the rest of their lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import vectext as vt
from .bits import build_filter
from .storage import saved

#: A segment has at most so many documents, and about so many postings (those of one more document at most).
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 13, 1 << 18
#: Queries are answered in rounds whose terms number about so many, as they are broadcast: 24 MB.
ROUND_TERMS = 1 << 20

_SPACE = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _SPACE[_low : _high + 1] = True

_LIST = "term bigint, segment bigint, n bigint, docs binary, tf binary, size binary"


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The distinct terms of each row of ``queries``: ``query`` (a number for the row), its id and ``term``."""
    kind = queries.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, j in vt.slices(vt.text_bytes(batch.column(1))[1]):
                data, at = vt.text_bytes(batch.column(1).slice(i, j - i))
                hashes, of = vt.words(data, at, _SPACE)
                owner = np.repeat(np.arange(j - i), np.diff(of))
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
                own = owner[new]
                yield pa.RecordBatch.from_arrays([pa.array(own + row), batch.column(0).slice(i, j - i).take(pa.array(own)), pa.array(vt.signed(hashes[new]))], ["query", "id", "term"])
                row += j - i

    return queries.select(id_col, text_col).mapInArrow(run, f"query bigint, id {kind}, term bigint")


class _Segment:
    """Documents in a row and their postings so far."""

    def __init__(self, number: int):
        self.number, self.parts, self.docs, self.postings, self.ids, self.held, self.total = number, [], 0, 0, [], 0, 0

    def add(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, sizes: np.ndarray, ids: pa.Array) -> None:
        self.parts.append((term, doc + self.docs, tf, sizes[doc]))
        self.docs, self.postings = self.docs + len(sizes), self.postings + len(term)
        self.ids.append(ids)
        self.held, self.total = self.held + int((sizes > 0).sum()), self.total + int(sizes.sum())

    def lists(self) -> dict[str, pa.Array]:
        term, doc, tf, size = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(term, kind="stable")
        term = term[order]
        at = np.append(np.flatnonzero(np.diff(term, prepend=term[:1] - np.uint64(1))), len(term)) if len(term) else np.zeros(1, np.int64)

        def packed(x: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(x[order].astype(np.int32))])

        return {"term": pa.array(vt.signed(term[at[:-1]])), "segment": pa.array(np.full(len(at) - 1, self.number)), "n": pa.array(np.diff(at)), "docs": packed(doc), "tf": packed(tf), "size": packed(size)}

    def entry(self) -> dict[str, pa.Array]:
        return {"segment": pa.array([self.number]), "n": pa.array([self.held]), "total": pa.array([self.total]), "ids": pa.array([pa.concat_arrays(self.ids)], pa.list_(self.ids[0].type))}


def build_lists(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Posting lists of the ``terms`` over all ``docs``, written by term and segment.

    A row holds one list's entries in one segment: places of documents, occurrences and documents' sizes, as 32-bit integers. Rows
    without a term hold a segment's ids, in ``n`` how many of its documents have a term, and in ``total`` how many they have. Words that
    no query has fall at a filter of fixed size. Lists are dealt out by term and segment, so a frequent term's list is many tasks'.
    """
    passes = docs.sparkSession.sparkContext.broadcast(build_filter(terms, "term"))
    schema = f"{_LIST}, total bigint, ids array<{docs.schema[id_col].dataType.simpleString()}>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def rows(held: dict[str, pa.Array]) -> pa.RecordBatch:
        n = len(next(iter(held.values())))
        return pa.RecordBatch.from_arrays([held[f.name].cast(f.type) if f.name in held else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        segment = _Segment(number)
        for batch in batches:
            data, offsets = vt.text_bytes(batch.column(1))
            for i, j in vt.slices(offsets):
                hashes, of = vt.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _SPACE)
                sizes = np.diff(of)
                kept = passes.value.passes(vt.signed(hashes))
                term, doc = hashes[kept], np.repeat(np.arange(j - i), sizes)[kept]
                order = np.argsort(term, kind="stable")
                term, doc = term[order], doc[order]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                term, doc, tf = term[at], doc[at], np.diff(np.append(at, len(new)))
                for a in range(0, j - i, SEGMENT_DOCS):
                    b = min(a + SEGMENT_DOCS, j - i)
                    if segment.docs and (segment.docs + b - a > SEGMENT_DOCS or segment.postings > SEGMENT_POSTINGS):
                        yield rows(segment.lists())
                        yield rows(segment.entry())
                        number += 1
                        segment = _Segment(number)
                    own = (doc >= a) & (doc < b)
                    segment.add(term[own], doc[own] - a, tf[own], sizes[a:b], batch.column(0).slice(i + a, b - a))
        if segment.docs:
            yield rows(segment.lists())
            yield rows(segment.entry())

    return saved(docs.select(id_col, text_col).mapInArrow(run, schema).repartition("term", "segment"), "search-lists")


def _impacts(tf: bytes, size: bytes, n_docs: int, n_terms: int) -> np.ndarray:
    tf, size = np.frombuffer(tf, np.int32).astype(np.int64), np.frombuffer(size, np.int32).astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * size * n_docs // n_terms))


def list_heads(lists: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The ``k`` highest entries of each list: ``term``, ``segment``, ``doc``, ``impact``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for term, segment, docs, tf, size in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                x = _impacts(tf, size, n_docs, n_terms)
                top = np.argpartition(-x, k)[:k] if len(x) > k else np.arange(len(x))
                found.append((np.full(len(top), term), np.full(len(top), segment), np.frombuffer(docs, np.int32)[top].astype(np.int64), x[top]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["term", "segment", "doc", "impact"])

    heads = lists.select("term", "segment", "docs", "tf", "size").mapInArrow(run, "term bigint, segment bigint, doc bigint, impact bigint")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "segment", "doc"))
    return heads.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def kth_best(scores: DataFrame, k: int) -> DataFrame:
    """For each query that has ``k`` scores, the ``k``-th highest: ``query``, ``bound``."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    best = scores.select("query", "score").withColumn("place", place).filter(F.col("place") <= k)
    return best.groupBy("query").agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n")


class _Round:
    """The queries of one round: for each its terms' numbers and weights, its bound and its threshold."""

    def __init__(self, wanted: pa.Table, bounds: pa.Table):
        query, term, weight = (wanted[c].to_numpy() for c in ("query", "term", "weight"))
        self.terms, number = np.unique(term, return_inverse=True)
        order = np.argsort(query, kind="stable")
        self.queries, at = np.unique(query[order], return_index=True)
        self.at = np.append(at, len(query))
        self.number, self.weight = number[order], weight[order]
        found = dict(zip(bounds["query"].to_pylist(), bounds["bound"].to_pylist(), strict=True))
        self.bound = np.array([found.get(q, 0) for q in self.queries.tolist()], np.int64)
        self.least = np.maximum(1, -(-self.bound // np.diff(self.at)))  # with no bound, whatever adds to a score
        least = np.repeat(self.least, np.diff(self.at))
        # The lowest impact at which some query reads a term's list.
        self.lowest = np.full(len(self.terms), np.iinfo(np.int64).max)
        np.minimum.at(self.lowest, self.number, -(-least // self.weight))

    def place(self, term: int) -> int | None:
        i = int(np.searchsorted(self.terms, term))
        return i if i < len(self.terms) and self.terms[i] == term else None


def read_lists(lists: DataFrame, sent, n_docs: int, n_terms: int) -> DataFrame:
    """The entries that some query of the round reads: by term and segment ``docs`` and ``impacts``, from the highest down.

    ``beyond`` is the highest impact that none reads (0 if there is none), so that a segment knows what it may lack.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in batches:
            out = []
            for term, segment, docs, tf, size in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if (i := asked.place(term)) is None:
                    continue
                x = _impacts(tf, size, n_docs, n_terms)
                top = np.argsort(-x, kind="stable")[: int((x >= asked.lowest[i]).sum())]
                beyond = int(x[x < asked.lowest[i]].max(initial=0))
                out.append((segment, i, np.frombuffer(docs, np.int32)[top].tobytes(), x[top].astype(np.int32).tobytes(), beyond))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["segment", "number", "docs", "impacts", "beyond"])

    return lists.select("term", "segment", "docs", "tf", "size").mapInArrow(run, "segment bigint, number bigint, docs binary, impacts binary, beyond bigint")


def possible(read: DataFrame, sent, k: int) -> DataFrame:
    """From what was read, the documents that may be among a query's best, for each query and segment in one row.

    ``docs``, ``scores`` so far and ``uppers``, the most they can be, are 64-bit integers; ``best`` has the segment's ``k`` highest scores.

    A segment's documents are held against every query of the round. What a document may have beyond its score so far is, for each list in which
    it wasn't met, the segment's highest entry that the query hasn't read. Documents that another ``k`` of the segment surely beat are
    left out, and those that can't reach the query's bound.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        asked, held = sent.value, {}
        for number, docs, impacts, beyond in zip(*(table[c].to_pylist() for c in ("number", "docs", "impacts", "beyond")), strict=True):
            held[number] = np.frombuffer(docs, np.int32), np.frombuffer(impacts, np.int32).astype(np.int64), beyond
        n = 1 + max(int(d.max(initial=0)) for d, _, _ in held.values())
        out = []
        for q, query in enumerate(asked.queries.tolist()):
            score, met_of, lacking = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
            span = slice(asked.at[q], asked.at[q + 1])
            for number, weight in zip(asked.number[span].tolist(), asked.weight[span].tolist(), strict=True):
                if number in held:
                    docs, x, beyond = held[number]
                    upto = int(np.searchsorted(-x, -(-(-int(asked.least[q]) // weight)), "right"))
                    unread = weight * (int(x[upto]) if upto < len(x) else beyond)
                    score[docs[:upto]] += weight * x[:upto]
                    met_of[docs[:upto]] += unread
                    lacking += unread
            met = np.flatnonzero(score)
            if not len(met):
                continue
            score, upper = score[met], score[met] + lacking - met_of[met]
            bound = int(asked.bound[q]) if len(met) < k else max(int(asked.bound[q]), int(np.partition(score, len(met) - k)[len(met) - k]))
            may = upper >= bound
            if may.any():
                best = np.partition(score, len(score) - k)[len(score) - k :] if len(score) > k else score
                out.append((query, key[0].as_py(), met[may].tobytes(), score[may].tobytes(), upper[may].tobytes(), best))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query", "segment", "docs", "scores", "uppers", "best"])

    return read.groupBy("segment").applyInArrow(run, "query bigint, segment bigint, docs binary, scores binary, uppers binary, best array<bigint>")


def candidates_of(some: DataFrame, bounds: DataFrame) -> DataFrame:
    """Of what ``possible`` gives, the documents that reach their query's bound: ``query``, ``segment``, ``doc``, ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for query, segment, docs, scores, uppers, bound in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                may = np.frombuffer(uppers, np.int64) >= (bound or 0)
                found.append((np.full(int(may.sum()), query), np.full(int(may.sum()), segment), np.frombuffer(docs, np.int64)[may], np.frombuffer(scores, np.int64)[may]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query", "segment", "doc", "score"])

    met = some.join(bounds, "query", "left").select("query", "segment", "docs", "scores", "uppers", "bound")
    return met.mapInArrow(run, "query bigint, segment bigint, doc bigint, score bigint")


def looked_up(candidates: DataFrame, wanted: DataFrame, least: DataFrame, lists: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Candidates with exact scores: what lies under the threshold in each of their query's lists is looked up and added."""
    ask = candidates.select("query", "segment", "doc").join(wanted.select("query", "term", "weight"), "query").join(least, "query")
    asks = ask.groupBy("term", "segment").agg(F.collect_list(F.struct("query", "doc", "weight", "least")).alias("asks"))
    met = asks.join(lists.select("term", "segment", "docs", "tf", "size"), ["term", "segment"]).select("segment", "asks", "docs", "tf", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                segment, _, docs, tf, size = (batch.column(c)[r].as_py() if c != 1 else None for c in range(5))
                rows = batch.column(1)[r].values
                query, doc, weight, least = (rows.field(f).to_numpy() for f in ("query", "doc", "weight", "least"))
                docs = np.frombuffer(docs, np.int32)
                at = np.minimum(np.searchsorted(docs, doc), len(docs) - 1)
                part = weight * _impacts(tf, size, n_docs, n_terms)[at]
                under = (docs[at] == doc) & (part < least)
                yield pa.RecordBatch.from_arrays([pa.array(query[under]), pa.array(np.full(int(under.sum()), segment)), pa.array(doc[under]), pa.array(part[under])], ["query", "segment", "doc", "part"])

    rest = met.mapInArrow(run, "query bigint, segment bigint, doc bigint, part bigint").groupBy("query", "segment", "doc").agg(F.sum("part").alias("rest"))
    return candidates.join(rest, ["query", "segment", "doc"], "left").select("query", "segment", "doc", (F.col("score") + F.coalesce("rest", F.lit(0))).alias("score"))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text: str = "text") -> DataFrame:
    """The ``k`` best documents for each row of ``queries``, of those that share a term: the query's id, ``rank``, the document's id, ``score``.

    Terms are compared as 64-bit hashes. Equal scores go by the document's id, null last; rows of one id are documents (queries) of their
    own, in no particular order. A text without terms, null or not, is found by nothing and finds nothing; empty tables give an empty result.
    """
    spark = docs.sparkSession
    asked = saved(query_terms(queries, query_col, query_text), "search-queries")
    lists = build_lists(docs, asked, id_col, text_col)
    entries, postings = lists.filter("term IS NULL"), lists.filter("term IS NOT NULL")
    total = entries.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = int(total["docs"]), max(int(total["terms"]), 1)
    heads = saved(list_heads(postings, n_docs, n_terms, k), "search-heads")
    held = postings.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    wanted = saved(asked.join(held, "term").select("query", "id", "term", weight.alias("weight")).filter("weight > 0"), "search-terms")
    rounds = -(-wanted.count() // ROUND_TERMS)
    found = []
    for number in range(rounds):
        own = wanted.filter(F.pmod(F.xxhash64("query"), F.lit(rounds)) == number)
        firsts = own.join(heads, "term").groupBy("query", "segment", "doc").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
        now = _Round(own.select("query", "term", "weight").toArrow(), kth_best(firsts, k).toArrow())
        sent = spark.sparkContext.broadcast(now)
        some = saved(possible(read_lists(postings, sent, n_docs, n_terms), sent, k), "search-possible")
        some = candidates_of(some, kth_best(some.select("query", F.explode("best").alias("score")), k))
        least = spark.createDataFrame(pa.table({"query": now.queries, "least": now.least}))
        found.append(saved(looked_up(some, own, least, postings, n_docs, n_terms), "search-scores"))
        sent.destroy()
    kind = f"{query_col} {queries.schema[query_col].dataType.simpleString()}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score bigint"
    if not found:
        return spark.createDataFrame([], kind)
    scores = found[0]
    for more in found[1:]:
        scores = scores.unionByName(more)
    # With ties whole, as ids decide them; ids are met by segment.
    near = scores.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("place") <= k)
    by_segment = near.groupBy("segment").agg(F.collect_list(F.struct("query", "doc", "score")).alias("found"))
    named = by_segment.join(entries.select("segment", "ids"), "segment").select("segment", "ids", F.explode("found").alias("f"))
    named = named.select("f.query", "f.score", "segment", "f.doc", F.get("ids", F.col("f.doc").cast("int")).alias("doc_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "segment", "doc")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ids = wanted.select("query", F.col("id").alias(query_col)).dropDuplicates(["query"])
    return ranked.join(ids, "query").select(query_col, "rank", "doc_id", "score")
