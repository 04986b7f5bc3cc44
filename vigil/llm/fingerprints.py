"""Document fingerprints as Merkle trees, in column expressions alone.

Method: a text is cut into sections (at blank lines), paragraphs (at newlines) and blocks of
``LEAF_WORDS`` words. A block's hash is the MD5 of its exact characters, a paragraph's that of
its blocks' hashes, a section's that of its paragraphs', the root the SHA-256 of the sections'.
Equal texts have equal roots; where two roots differ, the branches that differ lead to the
edited paragraph and block. The fingerprint is the tree as a string: root, then sections after
``/``, their paragraphs after ``:`` and ``;``, their blocks after ``=`` and ``,``.

The likeness of two fingerprints is 1 for equal roots, else the share of blocks they have in
common: 2 |A and B| / (|A| + |B|) over distinct blocks, so an edit costs the blocks it touches.

Defined cases: a null text is empty; the empty text has one empty section and no block, and its
likeness to any other text is 0; a null id orders last; rows with one id are ordered by a hash
of their texts, and repeated rows follow each other; a table of one row has itself as next; an
empty table gives an empty result; other columns are ignored. Texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .exchange import partitions

LEAF_WORDS = 4
#: Ids that share a window, and groups of such that do.
NEAR_IDS, NEAR_GROUPS = 256, 4096
_NO_BUCKET = -(1 << 62)


def tree(text: Column) -> Column:
    """Sections as arrays of paragraphs, each an array of block hashes."""
    sections = F.split(text, "\n[ \t\r]*\n", -1)
    return F.transform(sections, lambda s: F.transform(F.split(s, "\n", -1), lambda p: F.transform(blocks(p), F.md5)))


def blocks(paragraph: Column) -> Column:
    """A paragraph's characters in blocks of words."""
    return F.regexp_extract_all(paragraph, F.lit(rf"(?:\s*\S+\s*+){{1,{LEAF_WORDS}}}|\s+"), F.lit(0))


def leaves(of_tree: Column) -> Column:
    """Distinct block hashes as the fingerprint shows them."""
    return F.array_distinct(F.transform(F.flatten(F.flatten(of_tree)), lambda b: F.substring(b, 1, 8)))


def _paragraph_hash(p: Column) -> Column:
    return F.md5(F.array_join(p, ""))


def _section_hash(s: Column) -> Column:
    return F.md5(F.array_join(F.transform(s, _paragraph_hash), ""))


def root(of_tree: Column) -> Column:
    return F.sha2(F.array_join(F.transform(of_tree, _section_hash), ""), 256)


def shown(of_tree: Column) -> Column:
    """The tree as a string."""
    def paragraph(p: Column) -> Column:
        return F.concat(F.substring(_paragraph_hash(p), 1, 16), F.lit("="), F.array_join(F.transform(p, lambda b: F.substring(b, 1, 8)), ","))

    def section(s: Column) -> Column:
        return F.concat(F.substring(_section_hash(s), 1, 16), F.lit(":"), F.array_join(F.transform(s, paragraph), ";"))

    return F.concat(root(of_tree), F.lit("/"), F.array_join(F.transform(of_tree, section), "/"))


def likeness(a: Column, b: Column, leaves_a: Column, leaves_b: Column) -> Column:
    """Of two fingerprints, with their distinct blocks."""
    both = F.size(F.array_intersect(leaves_a, leaves_b))
    size = F.size(leaves_a) + F.size(leaves_b)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(2.0 * both / size)


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Which paragraphs of tree ``a``, numbered through all sections, are not in tree ``b``."""
    hashes = F.transform(F.flatten(a), _paragraph_hash)
    theirs = F.transform(F.flatten(b), _paragraph_hash)
    return F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(theirs, h), F.lit(-1)).otherwise(i)), lambda i: i >= 0)


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``root``, ``fingerprint`` and ``blocks`` of each text."""
    built = docs.select("doc_id", tree(F.coalesce("text", F.lit(""))).alias("tree"))
    return built.select("doc_id", root(F.col("tree")).alias("root"), shown(F.col("tree")).alias("fingerprint"), leaves(F.col("tree")).alias("blocks"))


def _following(buckets: DataFrame) -> DataFrame:
    """Each bucket number and the next lower one; after the lowest, the highest.

    Numbers are windowed in groups of ``NEAR_GROUPS``; only one row for each group, one for
    about a million ids, is ordered as a whole.
    """
    numbers = buckets.select("bucket", F.floor(F.col("bucket") / NEAR_GROUPS).cast("long").alias("g"))
    inside = numbers.withColumn("after", F.lead("bucket").over(Window.partitionBy("g").orderBy(F.desc("bucket"))))
    tops = numbers.groupBy("g").agg(F.max("bucket").alias("top"))
    whole = Window.orderBy(F.desc("g"))
    first = F.max("top").over(Window.orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    groups = tops.select("g", F.coalesce(F.lead("top").over(whole), first).alias("below"))
    return inside.join(groups, "g").select("bucket", F.coalesce("after", "below").alias("after"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, tree`` and ``next_text, next_tree``: those of the document before, by id, or for the smallest those of the largest."""
    parts = partitions(docs.sparkSession)
    bucket = F.coalesce(F.expr(f"floor(doc_id / {NEAR_IDS})").cast("long"), F.lit(_NO_BUCKET))
    dealt = docs.select(bucket.alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(parts, "bucket")
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))
    heads = dealt.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("bucket", "text")
    after = _following(dealt.select("bucket").distinct())
    edges = after.join(heads.withColumnRenamed("bucket", "after"), "after").select(F.col("bucket").alias("_bucket"), F.col("text").alias("edge_text"))
    edges = edges.withColumn("edge_tree", tree(F.col("edge_text")))
    here = dealt.withColumn("tree", tree(F.col("text")))
    here = here.withColumns({"next_text": F.lead("text").over(order), "next_tree": F.lead("tree").over(order)})
    joined = here.join(edges, F.col("bucket") == F.col("_bucket"))
    return joined.select("doc_id", "text", "tree", F.coalesce("next_text", "edge_text").alias("next_text"), F.coalesce("next_tree", "edge_tree").alias("next_tree"))


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of an edited text and of the next document.

    The edited text has its last half, rounded down, replaced by the first as many characters of the next.
    """
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.expr("substring(next_text, 1, length(text) div 2)"))
    rows = with_next(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "tree", "next_tree")
    rows = rows.withColumn("edited_tree", tree(F.col("edited")))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[
        f(F.col(f"{t}tree")).alias(f"{t}{name}") for t in ("", "edited_", "next_") for f, name in ((shown, "fingerprint"), (leaves, "blocks")) if (t, name) != ("next_", "fingerprint")
    ], root(F.col("next_tree")).alias("next_root"), edited_paragraphs(F.col("tree"), F.col("edited_tree")).alias("edited_paragraphs"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("blocks"), F.col("edited_blocks")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_root"), F.col("blocks"), F.col("next_blocks")).alias("near_next"), "edited_paragraphs")
