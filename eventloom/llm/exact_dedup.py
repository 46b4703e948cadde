"""Exact dedup by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of characters. Distinct blocks are sorted and
numbered; then the names of adjacent blocks are paired, distinct pairs are sorted and
numbered, and so on until every document has one name. Two documents have the same
(number of blocks, name) if and only if their texts are the same: blocks are compared by
content, never by a digest alone.

Block contents are shuffled once, to find the distinct ones. After that a digest and a
length lead to the name; only where different contents share both are contents joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import pin

BLOCK_CHARS = 4096
_ROW = ["doc_id", "text_sha256", "copies", "n_blocks"]


def _numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows in sorted order with an integer ``name``, different for each; pinned."""
    return pin(df.sort(*keys).withColumn("name", F.monotonically_increasing_id()), name)


def block_names(docs: DataFrame, block_chars: int = BLOCK_CHARS, digest: Column | None = None) -> DataFrame:
    """The identity of every text: doc_id, text_sha256, copies, n_blocks, name.

    One row for each distinct (doc_id, text); ``copies`` says how many input rows it stands
    for. (n_blocks, name) is the same for equal texts and no others. A null text counts as
    empty, an empty text is one empty block, null ids are kept, other columns are ignored.
    ``digest`` replaces the digest of ``block``; however weak, the classes stay the same.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    last = F.greatest(F.lit(0), F.floor((F.char_length("text") - 1) / block_chars)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(F.col("text"), i * block_chars + 1, F.lit(block_chars)))
    blocks = (
        text.select("doc_id", F.sha2("text", 256).alias("text_sha256"), (last + 1).alias("n_blocks"), F.posexplode(cut).alias("i", "block"))
        .withColumn("h", F.xxhash64("block") if digest is None else digest)
        .withColumn("len", F.octet_length("block"))
    )
    row = ["doc_id", "text_sha256", "n_blocks", "i", "h", "len"]
    distinct = blocks.select("h", "len", "block").distinct()
    contents = distinct.groupBy("h", "len").agg(F.count("*").alias("contents"))
    keys = _numbered(contents, ["len", "h"], "block-names")
    rows = blocks.groupBy(*row).agg(F.count("*").alias("copies"))
    named = rows.join(keys.filter("contents = 1"), ["h", "len"]).select(*_ROW, "i", "name")
    clash = keys.filter("contents > 1").select("h", "len")
    if not clash.isEmpty():
        full = _numbered(distinct.join(clash, ["h", "len"]), ["len", "h", "block"], "clash-names")
        again = blocks.join(clash, ["h", "len"], "left_semi").groupBy(*row, "block").agg(F.count("*").alias("copies"))
        # below zero, so that they meet no name of the others
        named = named.unionByName(again.join(full, ["h", "len", "block"]).select(*_ROW, "i", (-1 - F.col("name")).alias("name")))
    return _climb(pin(named, "block-level"))


def _climb(level: DataFrame) -> DataFrame:
    """Names adjacent pairs until every document has one name."""
    top = level.agg(F.max("n_blocks")).first()[0] or 1
    done = level.filter("n_blocks = 1").select(*_ROW, "name")
    level, at_once = level.filter("n_blocks > 1"), 1
    while at_once < top:
        at_once *= 2
        half = F.col("i") % 2 == 0
        pairs = pin(level.groupBy(*_ROW, F.shiftright("i", 1).alias("i")).agg(F.max(F.when(half, F.col("name"))).alias("left"), F.max(F.when(~half, F.col("name"))).alias("right")), "block-pairs")
        # a last block without a neighbour: its name alone
        names = _numbered(pairs.select("left", "right").distinct(), ["left", "right"], "pair-names").withColumnsRenamed({"left": "l", "right": "r"})
        named = pairs.join(names, (F.col("left") == F.col("l")) & F.col("right").eqNullSafe(F.col("r"))).select(*_ROW, "i", "name")
        done = done.unionByName(named.filter(F.col("n_blocks") <= at_once).select(*_ROW, "name"))
        level = named.filter(F.col("n_blocks") > at_once)
    return done


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS, digest: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (a null id only if no other is
    there); of repeated rows with that id one is ``kept``. An empty table gives no rows.
    Nulls, empty and long texts: see :func:`block_names`.
    """
    names = pin(block_names(docs, block_chars, digest), "text-names")
    groups = names.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return (
        names.join(groups, ["n_blocks", "name"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Of repeated rows of one id and text the one with the least other columns stays.
    """
    kept = pin(exact_dedup(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha")), "kept-texts")
    return only(docs, kept)


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` named in ``kept(_id, _sha)``, one each; of several the least row, by its JSON if it holds maps."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("_key"))
    found = keyed.join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_sha")), "left_semi")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return found.select("_row.*")
    least = F.min_by("_row", F.to_json("_row")) if "map<" in docs.schema.simpleString() else F.min("_row")
    return found.groupBy("_doc", "_key").agg(least.alias("_row")).select("_row.*")
