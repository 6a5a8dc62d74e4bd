"""The main text of pages, by wrappers that are induced for each host from all its pages."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import wrappers as wr
from .html_blocks import Page, read_page
from .sample import unused
from .storage import saved
from .url_templates import url_host

#: Trees that one group of a round aligns, on average, and shapes that are held against their host's wrapper together.
TREES, SHAPES = 64, 256
#: A task hands on the trees that it has summed once they are so many.
TASK_SHAPES = 1 << 12
#: What is learned is broadcast if it takes no more than this; more of it meets the pages in a join, each host in SALTS parts.
FEW_BYTES, SALTS = 1 << 24, 32
#: A block of text is template if it is on so many of a host's pages in a hundred, and these are SURE_PAGES or more.
REPEATED_PERCENT = 90


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _skeleton(page: Page) -> str:
    return "\n".join(f"{p}\t{part}\t{label}" for p, part, label in zip(page.parents, page.parts, page.labels, strict=True))


def _tree(skeleton: str) -> tuple[wr.Node, list[wr.Node]]:
    rows = [line.split("\t", 2) for line in skeleton.split("\n")]
    return wr.built([r[2] for r in rows], [r[1] for r in rows], [int(r[0]) for r in rows])


def survey(pages: DataFrame, host: str, html: str) -> DataFrame:
    """What the pages look like, without their texts: two kinds of rows.

    For a host and a shape of tree, the tree with its sums over a task's pages; for a host and a page's content, the hashes of its blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[str, wr.Node, list[wr.Node]]] = {}

        def trees() -> pa.RecordBatch:
            rows = [(h, shape, skeleton, wr.dumped(root)) for (h, shape), (skeleton, root, _) in held.items()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.list_(pa.int64()))], names)

        for batch in batches:
            contents = []
            for h, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = read_page(x.as_py() or "")
                skeleton = _skeleton(page)
                key = h, _hash(skeleton)
                if key not in held:
                    held[key] = (skeleton, *_tree(skeleton))
                nodes = held[key][2]
                own: dict[int, list[int]] = {}
                for node, text, links in page.blocks:
                    own.setdefault(node, []).append(_hash(text))
                    nodes[node].chars += len(text)
                    nodes[node].links += links
                blocks = [b for bs in own.values() for b in bs]
                content = hash(tuple(blocks))
                for node in nodes:
                    node.pages += 1
                for node, hashes in ({0: [content]} | {n: [hash(tuple(bs))] for n, bs in own.items() if n}).items():
                    found = wr.Node("", "", 0, 0, 0, 1, hashes[0], hashes[0])
                    nodes[node].add(found)
                contents.append((h, content, list(dict.fromkeys(blocks))))
                if len(held) >= TASK_SHAPES:
                    yield trees()
                    held.clear()
            if contents:
                hosts, content, blocks = zip(*contents, strict=True)
                n = len(hosts)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(content, pa.int64()), pa.array(blocks, pa.list_(pa.int64()))], names)
        if held:
            yield trees()

    names = ["host", "shape", "skeleton", "tree", "page", "blocks"]
    return pages.select(host, html).mapInArrow(run, "host string, shape bigint, skeleton string, tree string, page bigint, blocks array<bigint>")


def induced(trees: DataFrame) -> DataFrame:
    """One wrapper for each host: ``trees`` (``host``, ``tree``) are aligned some ``TREES`` at a time, round by round."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        roots = sorted(map(wr.loaded, table["tree"].to_pylist()), key=lambda r: (-r.pages, wr.dumped(r)))
        for root in roots[1:]:
            wr.merge(roots[0], root)
        return pa.table({"host": [key[0].as_py()], "tree": [wr.dumped(roots[0])]})

    while True:
        most = trees.groupBy("host").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        if most <= 1:
            return trees
        salt = F.pmod(F.xxhash64("tree"), F.lit(-(-most // TREES)))
        trees = saved(trees.groupBy("host", salt.alias("salt")).applyInArrow(run, "host string, tree string"), "html-wrappers")


def judged(shapes: DataFrame, wrappers: DataFrame) -> DataFrame:
    """For each host and shape which nodes hold content: ``host``, ``shape``, ``keep`` (a byte for each node)."""
    parts = shapes.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / SHAPES).alias("parts"))
    dealt = shapes.join(parts, "host").withColumn("part", F.pmod("shape", "parts"))
    copies = wrappers.join(parts.toDF("of", "copies"), F.col("host") == F.col("of")).select(F.col("host").alias("its_host"), "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("its_part"))

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        for tree in theirs["tree"].to_pylist():
            wrapper = wr.loaded(tree)
            marks = wr.template(wrapper, wrapper.low != wrapper.high)
            for h, shape, skeleton in zip(*(mine[c].to_pylist() for c in ("host", "shape", "skeleton")), strict=True):
                out.append((h, shape, bytes(wr.content(wrapper, marks, *_tree(skeleton)))))
        cols = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["host", "shape", "keep"])

    return dealt.groupBy("host", "part").cogroup(copies.groupBy("its_host", "its_part")).applyInArrow(run, "host string, shape bigint, keep binary")


def repeated(contents: DataFrame) -> DataFrame:
    """Blocks that nearly all pages of a host hold: ``host``, ``block``. Pages of equal content count once."""
    once = contents.groupBy("host", "page").agg(F.first("blocks").alias("blocks"))
    totals = once.groupBy("host").agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= wr.SURE_PAGES)
    counts = once.select("host", F.explode("blocks").alias("block")).groupBy("host", "block").agg(F.count(F.lit(1)).alias("n"))
    often = counts.filter(100 * F.col("n") >= REPEATED_PERCENT * wr.SURE_PAGES)
    return often.join(totals, "host").filter(100 * F.col("n") >= REPEATED_PERCENT * F.col("total")).select("host", "block")


def _extracted(rows: DataFrame, dropped: list[str], rule: Callable[[dict[str, pa.Array], int, int], tuple[bytes, set[int]]], html: str) -> DataFrame:
    """``rows`` without the ``dropped`` columns, with ``text`` and ``n_chars``; ``rule`` gives the nodes and the blocks that decide a row."""
    kept = [c for c in rows.columns if c not in dropped]
    schema = rows.select(*kept, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    arrow, columns = to_arrow_schema(schema), list(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {c: batch.column(i) for i, c in enumerate(columns)}
            texts = []
            for r, x in enumerate(held[html]):
                page = read_page(x.as_py() or "")
                keep, template = rule(held, r, _hash(_skeleton(page)))
                texts.append("\n".join(text for node, text, _ in page.blocks if keep[node] and not (template and _hash(text) in template)))
            cols = [*(held[c] for c in kept), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def main_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of each, in place of the html, and ``n_chars``, the text's code points.

    Blocks are joined by line breaks, their white space is single spaces. Null and empty html have the empty text; pages without a host
    (a null url, or one without ``://``) are taken for one host; repeated rows fare alike; an empty table stays empty. Columns named
    ``text`` or ``n_chars`` are replaced.
    """
    spark = pages.sparkSession
    kept = pages.drop(*[c for c in ("text", "n_chars") if c in pages.columns])
    host, shape, salt = (unused(c, kept.columns) for c in ("host", "shape", "salt"))
    rows = kept.withColumn(host, url_host(F.col(url_col)))
    seen = saved(survey(rows, host, html_col), "html-survey")
    trees = seen.filter("tree IS NOT NULL")
    shapes = trees.groupBy("host", "shape").agg(F.first("skeleton").alias("skeleton"))
    keep = saved(judged(shapes, induced(trees.select("host", "tree"))), "html-content")
    blocks = saved(repeated(seen.filter("page IS NOT NULL")), "html-repeated")
    size = F.coalesce(F.sum(F.octet_length("host") + 64), F.lit(0)).alias("n")
    taken = keep.agg(size + F.coalesce(F.sum(F.octet_length("keep")), F.lit(0))).first()[0] + blocks.agg(size).first()[0]
    if taken <= FEW_BYTES:
        known = {(r["host"], r["shape"]): bytes(r["keep"]) for r in keep.toLocalIterator()}
        template: dict[str, set[int]] = {}
        for r in blocks.toLocalIterator():
            template.setdefault(r["host"], set()).add(r["block"])
        sent = spark.sparkContext.broadcast((known, template))

        def told(held: dict[str, pa.Array], r: int, shape: int) -> tuple[bytes, set[int]]:
            h = held[host][r].as_py()
            return sent.value[0][h, shape], sent.value[1].get(h, set())

        return _extracted(rows, [html_col, host], told, html_col)

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hash(_skeleton(read_page(x.as_py() or ""))) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, shape])

    at = rows.columns.index(html_col)
    whole = rows.mapInArrow(shaped, rows.withColumn(shape, F.lit(0).cast("long")).schema)
    by_host = blocks.groupBy("host").agg(F.collect_list("block").alias("blocks"))
    rules = keep.join(by_host, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rules = rules.select(F.col("host").alias(host), F.col("shape").alias(shape), F.col("salt").alias(salt), F.col("keep").alias(f"{host}_keep"), F.col("blocks").alias(f"{host}_blocks"))
    met = whole.withColumn(salt, F.pmod(F.xxhash64(html_col), F.lit(SALTS)).cast("int")).join(rules, [host, shape, salt])

    def joined(held: dict[str, pa.Array], r: int, _: int) -> tuple[bytes, set[int]]:
        return held[f"{host}_keep"][r].as_py(), set(held[f"{host}_blocks"][r].as_py() or ())

    return _extracted(met, [html_col, host, shape, salt, f"{host}_keep", f"{host}_blocks"], joined, html_col).select(*[c for c in kept.columns if c != html_col], "text", "n_chars")
