"""Scores of documents by a context-tree model of the corpus, with a word-count base beside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import deep_tree as dt
from . import vectext as vt
from .storage import saved

#: Words with at least one in so many of all training tokens are looked up in each task; there can be no more than that, 16 MB.
HEAD_WORDS = 1 << 20
#: Stands for the end of a text among the hashes of words.
END_WORD = np.uint64(0x5EEDE2D0F7E87A11)


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def count_words(docs: DataFrame) -> DataFrame:
    """Counts of the words of all texts: ``key``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(vt.signed(keys)), pa.array(n.astype(np.int64))], ["key", "n"])

        of_words = vt.Tally()
        for batch in batches:
            data, offsets = vt.text_bytes(batch.column(0))
            for i, j in vt.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                for x in of_words.add(np.append(vt.words(part, at)[0], np.repeat(END_WORD, j - i))):
                    yield out(*x)
        for x in of_words.rest():
            yield out(*x)

    partial = docs.select("text").mapInArrow(run, "key bigint, n bigint")
    return partial.groupBy("key").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all texts with what those that are not ``held_out`` teach.

    Gives ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (the context tree's
    log10 probability of the text's bytes and its end) and ``bits_per_byte``.

    Counts of frequent words are looked up in each task; a text's other words go, by hash, to where their counts are, and come
    back as one sum per text. Cells of the tree go and come back by chunks of texts, each distinct one once. A null text is empty: its only token is the end. Repeated rows are scored alike, each teaching once. Without
    training texts each bit has one half; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    words = saved(count_words(rows.filter(~F.col("held_out"))), "lm-words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, base = int(total["n"]), float(np.log10(total["n"] + total["v"] + 1))
    head = words.filter(F.col("n") * HEAD_WORDS >= F.lit(n_all)).select("key", "n").toArrow()
    order = np.argsort(head["key"].to_numpy().view(np.uint64))
    keys, logs = head["key"].to_numpy().view(np.uint64)[order], np.log10(head["n"].to_numpy()[order] + 1.0)
    sent = spark.sparkContext.broadcast((keys, logs))
    kind = rows.schema["doc_id"].dataType.simpleString()
    per_text = f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, logs double, n_bytes bigint, rest array<bigint>"
    schema = f"{per_text}, chunk bigint, sizes binary, text binary, bucket int, n bigint, cells binary, counts binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def wide(held: dict[str, pa.Array]) -> pa.RecordBatch:
        """Columns of one kind of row, with nulls for those of the others."""
        n = len(next(iter(held.values())))
        return pa.RecordBatch.from_arrays([held[f.name].cast(f.type) if f.name in held else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def closed(chunk: dt.Chunk, first: int) -> Iterator[pa.RecordBatch]:
        yield wide({"row": pa.array([first]), "chunk": pa.array([first]), "sizes": pa.array([np.concatenate(chunk.sizes).astype(np.int64).tobytes()]), "text": pa.array([chunk.text()])})
        bucket, n, cells, counts = zip(*dt.blocks(*chunk.cells()), strict=True)
        yield wide({"chunk": pa.array(np.full(len(n), first)), "bucket": pa.array(bucket), "n": pa.array(n), "cells": pa.array(cells), "counts": pa.array(counts)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = sent.value
        at_row = TaskContext.get().partitionId() << 33
        chunk, first = dt.Chunk(), at_row
        for batch in batches:
            data, offsets = vt.text_bytes(batch.column(1))
            for i, j in vt.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                hashes, of = vt.words(part, at)
                # The end of each text stands after its words.
                hashes = np.insert(hashes, of[1:], END_WORD)
                of = of + np.arange(len(of))
                place = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                known = keys[place] == hashes if len(keys) else np.zeros(len(hashes), bool)
                value = np.where(known, logs[place], 0.0) if len(keys) else np.zeros(len(hashes))
                rest = np.concatenate([[0], np.cumsum(~known)])[of].astype(np.int32)
                yield wide(
                    {
                        "row": pa.array(at_row + np.arange(j - i)),
                        "doc_id": batch.column(0).slice(i, j - i),
                        "held_out": batch.column(2).slice(i, j - i),
                        "n_tokens": pa.array(np.diff(of)),
                        "known": pa.array(np.add.reduceat(known.astype(np.int64), of[:-1])),
                        "logs": pa.array(np.add.reduceat(value, of[:-1])),
                        "n_bytes": pa.array(np.diff(at)),
                        "rest": pa.ListArray.from_arrays(pa.array(rest), pa.array(vt.signed(hashes[~known]))),
                    }
                )
                if chunk.bytes and chunk.bytes + len(part) > dt.CHUNK_BYTES:
                    yield from closed(chunk, first)
                    chunk, first = dt.Chunk(), at_row
                chunk.add(part, at, batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False))
                at_row += j - i
        if chunk.sizes:
            yield from closed(chunk, first)

    every = saved(rows.select("doc_id", "text", "held_out").mapInArrow(run, schema), "lm-scored")
    scored = every.filter("chunk IS NULL").select("row", "doc_id", "held_out", "n_tokens", "known", "logs", "n_bytes", "rest")
    chunks = every.filter("sizes IS NOT NULL").count()
    said = dt.answered(every.filter("bucket IS NOT NULL").select("chunk", "bucket", "n", "cells", "counts"), chunks)
    of_tree = dt.scores(every.filter("text IS NOT NULL"), said)
    rare = scored.select("row", F.explode("rest").alias("key")).join(words.select("key", "n"), "key")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"))
    whole = scored.drop("rest").join(rare, "row", "left").join(of_tree, "row", "left")
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * base).alias("base_score"),
        "score",
        (-F.col("score") / float(np.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
