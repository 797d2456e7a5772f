"""Line dedup by a log-template tree, in DataFrame functions only.

A fixed-depth tree sorts lines by token count and leading tokens; a leaf is (count, first ``depth`` tokens), where
tokens that hold a digit, an at sign or a URL scheme are variable by kind and count as ``<*>``. A leaf is split by token
agreement: behind the leading tokens a token stays fixed if lines of at least ``min_sources`` different texts have
it there, every other one becomes ``<*>``. Lines that are equal after that share a template, so a leaf holds as many
templates as it needs. A line takes part only if at least ``LIKENESS`` percent of its words behind the leading ones are
fixed (tokens variable by kind aside), and at least half of all its tokens are fixed words: unrelated prose that begins
alike, and rows of numbers, have no template.

A template is boilerplate if at least ``min_sources`` different texts bear it out; all its lines are dropped but for those
of the document with the smallest id. A text bears a template out if it has a body of its own: of the characters
outside the template's lines, at least half lie in lines whose leaf is clearly rarer than the template. What copies
share is equally frequent throughout, so exact and near copies of one text bear nothing out and lose nothing, while a footer
over different texts goes, however long it is and whatever header stands with it. Rarer is by powers of two: the
bit length of the number of texts that reach the leaf is smaller by two at least.

The lines of all documents are reduced to hashes once and stored. Only lines of leaves that enough texts reach are
looked for in the texts; Spark broadcasts these leaves while its own size check allows, beyond that it shuffles.

Null text counts as empty; blank lines stay; long lines and texts are taken whole; repeated rows lose the same lines and
count as one text; equal smallest ids keep their lines together; rows without id never keep one if another has an id;
extra columns stay as they are, but ``n_lines`` and ``n_dropped``, which are the result's; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.functions.skew import let
from docrisk.llm.common import apart, stored, text_key

DEPTH = 3
MIN_SOURCES = 4
LIKENESS = 70
# A whole token; it starts where a token starts and never backtracks, so long tokens cost no more.
VARIABLE = r"(?<![^ ])(?:[^ \d@:]++|:(?!//))*+(?:[\d@]|://)[^ ]*+"


def token_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def leaf(line: Column, depth: int = DEPTH) -> Column:
    return F.xxhash64(token_count(line), F.regexp_replace(F.substring_index(line, " ", depth), VARIABLE, "<*>"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def tree_lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, k1, k2, total, pos, size, line, leaf) of every line: ``size`` of the line's and ``total`` of the text's characters
    without line ends; the leaf of a blank line is null."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    total = F.length(F.replace(whole, F.lit("\n"), F.lit(""))).alias("total")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")), total, lines_of(F.col("text")).alias("lines"))
    rows = base.select("doc_id", "k1", "k2", "total", F.posexplode("lines").alias("pos", "raw"))
    out = let(F.trim("raw"), lambda x: F.struct(x.alias("line"), F.when(x != "", leaf(x, depth)).alias("leaf")))
    rows = rows.select("doc_id", "k1", "k2", "total", "pos", F.length("raw").alias("size"), out.alias("o"))
    return rows.select("doc_id", "k1", "k2", "total", "pos", "size", F.col("o.line").alias("line"), F.col("o.leaf").alias("leaf"))


def templates(lines: DataFrame, depth: int = DEPTH, min_sources: int = MIN_SOURCES, likeness: int = LIKENESS) -> DataFrame:
    """(leaf, lh, template) of the lines (leaf, lh, line, n) that have one; ``n`` texts hold the line.

    Tokens travel as hashes of position and token. A template is the combination of the hashes of its fixed tokens.
    """
    kind = lambda t: t.rlike(r"[\d@]|://")
    tokens = F.split("line", " ")
    lead = F.size(F.filter(F.slice(tokens, 1, depth), lambda t: ~kind(t)))
    hashes = F.transform(tokens, lambda t, i: F.when((i >= depth) & ~kind(t), F.xxhash64(i, t)))
    base = lines.select("leaf", "lh", "n", lead.alias("lead"), F.size(tokens).alias("size"), F.array_compact(hashes).alias("hashes"))
    rows = base.select("leaf", "lh", "n", "lead", "size", F.explode_outer("hashes").alias("token"))
    # A token in too few texts is no token of a template.
    often = rows.where("token is not null").groupBy("leaf", "token").agg(F.sum("n").alias("texts")).where(F.col("texts") >= min_sources)
    marked = rows.join(often, ["leaf", "token"], "left")
    fixed = F.when(F.col("texts").isNotNull(), F.col("token"))
    lined = marked.groupBy("leaf", "lh", "lead", "size").agg(
        F.count("token").alias("words"), F.count(fixed).alias("fixed"), F.coalesce(F.bit_xor(fixed), F.lit(0)).alias("template")
    )
    enough = (F.col("fixed") * 100 >= F.col("words") * likeness) & (2 * (F.col("lead") + F.col("fixed")) >= F.col("size"))
    return lined.where(enough).select("leaf", "lh", "template")


def boilerplate(docs: DataFrame, rows: DataFrame, depth: int = DEPTH, min_sources: int = MIN_SOURCES, likeness: int = LIKENESS) -> DataFrame:
    """(k1, k2, pos, keeper) of the lines of boilerplate templates in every distinct text, with the document that keeps them.

    ``rows`` are the stored line hashes (doc_id, k1, k2, total, pos, size, leaf, lh).
    """
    bits = lambda c: F.length(F.bin(F.col(c)))
    reach = rows.select("leaf", "k1", "k2").distinct().groupBy("leaf").agg(F.count("*").alias("texts"))
    wide = stored(reach.where(F.col("texts") >= min_sources).select("leaf", bits("texts").alias("bits")), "line-leaves")
    # Equal texts are one from here on.
    once = rows.join(wide, "leaf").groupBy("k1", "k2", "pos", "leaf", "lh", "size", "total", "bits").agg(F.min("doc_id").alias("doc_id"))
    seen = stored(once, "line-wide")
    texts = seen.select("leaf", "lh", "k1", "k2").distinct().groupBy("leaf", "lh").agg(F.count("*").alias("n"))
    near = tree_lines(docs, depth).select("leaf", "line").join(wide.select("leaf"), "leaf")
    lines = near.groupBy("leaf", "line").agg(F.lit(1)).select("leaf", F.xxhash64("line").alias("lh"), "line")
    member = stored(templates(lines.join(texts, ["leaf", "lh"]), depth, min_sources, likeness), "line-templates")

    held = seen.join(member, ["leaf", "lh"]).groupBy("leaf", "template", "k1", "k2").agg(F.sum("size").alias("own"), F.min("doc_id").alias("doc_id"))
    held = stored(held, "line-held")
    often = held.groupBy("leaf", "template").agg(F.count("*").alias("texts"), F.min("doc_id").alias("keeper")).where(F.col("texts") >= min_sources)
    # Characters of a text by the frequency of their leaf: one entry per bit length.
    spread = seen.groupBy("k1", "k2", "bits").agg(F.sum("size").alias("chars"), F.max("total").alias("total"))
    spread = spread.groupBy("k1", "k2").agg(F.collect_list(F.struct("bits", "chars")).alias("spread"), F.max("total").alias("total"))
    asked = held.drop("doc_id").join(often.select("leaf", "template", bits("texts").alias("bits")), ["leaf", "template"]).join(spread, ["k1", "k2"])
    common = F.expr("aggregate(spread, 0L, (a, x) -> a + if(x.bits > bits - 2, x.chars, 0L))")
    body = F.col("total") - common
    borne = asked.where((body > 0) & (2 * body >= F.col("total") - F.col("own"))).groupBy("leaf", "template").agg(F.count("*").alias("sources"))
    found = borne.where(F.col("sources") >= min_sources).join(often, ["leaf", "template"]).select("leaf", "template", "keeper")
    bad = member.join(found, ["leaf", "template"]).select("leaf", "lh", "keeper")
    return seen.select("k1", "k2", "pos", "leaf", "lh").join(bad, ["leaf", "lh"]).select("k1", "k2", "pos", "keeper")


def drop_lines(docs: DataFrame, depth: int = DEPTH, min_sources: int = MIN_SOURCES, likeness: int = LIKENESS) -> DataFrame:
    """``docs`` with ``text`` less its boilerplate lines, and ``n_lines`` and ``n_dropped``."""
    hashed = tree_lines(docs, depth).withColumn("lh", F.xxhash64("line")).drop("line")
    rows = stored(hashed.where("leaf is not null"), "line-hashes")
    found = boilerplate(docs, rows, depth, min_sources, likeness)
    d1, d2, h1, h2, bad, gone, text = apart(docs, "d1", "d2", "h1", "h2", "bad", "gone", "kept")
    cut = found.groupBy(F.col("k1").alias(h1), F.col("k2").alias(h2)).agg(F.collect_list(F.struct("pos", "keeper")).alias(bad))  # at most a text's lines
    k1, k2 = text_key(F.col("text"))
    out = docs.withColumns({d1: k1, d2: k2}).join(cut, (F.col(d1) == F.col(h1)) & (F.col(d2) == F.col(h2)), "left")
    mine = F.col("doc_id").cast("long")
    out = out.withColumn(gone, F.transform(F.filter(bad, lambda g: ~mine.eqNullSafe(g["keeper"])), lambda g: g["pos"]))
    lines = lines_of(F.col("text"))
    kept = F.filter(lines, lambda _, i: ~F.array_contains(gone, i))
    left = F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    counts = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    return out.withColumns({**counts, text: left}).withColumn("text", F.col(text)).drop(text, gone, bad, d1, d2, h1, h2)
