"""Document fingerprints (operator 6): a Merkle tree over paragraphs and sections, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paymatch.plans.runtime import stage

SECTION = 8  # paragraphs in a section


def _leaf_count(n: Column) -> Column:
    """Leaves of a paragraph with n words: four leaves each of 1, 2 and 4 words, then leaves of 8."""
    up = lambda first, before, size: F.lit(first) + F.ceil((n - before) / size)
    return (F.when(n <= 4, n).when(n <= 12, up(4, 4, 2)).when(n <= 28, up(8, 12, 4)).otherwise(up(12, 28, 8))).cast("int")


def _leaf(words: Column, j: Column) -> Column:
    at = F.when(j < 4, j).when(j < 8, 2 * j - 4).when(j < 12, 4 * j - 20).otherwise(8 * j - 68)
    size = F.when(j < 4, 1).when(j < 8, 2).when(j < 12, 4).otherwise(8)
    return F.hash(F.array_join(F.slice(words, at + 1, size), " "))


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: struct(root, sections array, leaves array of arrays of ints by paragraph) of a text column without nulls.

    Paragraphs are lines; their nodes are SHA-256 of the raw line, a section's node is that of its paragraphs' nodes, the
    root that of the sections'.  Below a paragraph lie leaves, labels of a few words each, by which likeness is measured and
    edits are located.
    """
    nodes, parts, sections = f"_{name}_nodes", f"_{name}_parts", f"_{name}_sections"
    lines = F.split(F.col(text), "\n", -1)
    return (df.withColumns({nodes: F.transform(lines, lambda p: F.sha2(p, 256)), parts: F.transform(lines, lambda p: F.split(p, " ", -1))})
            .withColumn(sections, F.transform(F.sequence(F.lit(0), (F.ceil(F.size(nodes) / SECTION) - 1).cast("int")),
                                              lambda j: F.sha2(F.array_join(F.slice(F.col(nodes), j * SECTION + 1, SECTION), ""), 256)))
            .withColumn(name, F.struct(
                F.sha2(F.array_join(sections, ""), 256).alias("root"), F.col(sections).alias("sections"),
                F.transform(parts, lambda w: F.transform(F.sequence(F.lit(0), _leaf_count(F.size(w)) - 1), lambda j: _leaf(w, j))).alias("leaves")))
            .drop(nodes, parts, sections))


def rendered(tree: str) -> Column:
    """The fingerprint as text: root, the sections' first 16 digits, and the leaves in hexadecimal, line by line."""
    return F.concat_ws("|", F.col(tree)["root"], F.array_join(F.transform(F.col(tree)["sections"], lambda s: F.substring(s, 1, 16)), ","),
                       F.array_join(F.transform(F.col(tree)["leaves"], lambda p: F.array_join(F.transform(p, lambda x: F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), ",")), ";"))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Shared distinct leaves over those of the text with more; 1 for equal roots."""
    return F.when(same, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def changed_sections(a: str, b: str) -> Column:
    """Numbers (from 0) of the sections that differ between two trees, those that only one of them has included."""
    n = F.greatest(F.size(F.col(a)["sections"]), F.size(F.col(b)["sections"]))
    at = lambda t, j: F.get(F.col(t)["sections"], j)
    return F.when(F.col(a)["root"] == F.col(b)["root"], F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(0), n - 1), lambda j: ~at(a, j).eqNullSafe(at(b, j))))


def successors(ids: DataFrame, order: list[str]) -> DataFrame:
    """Each row with a column `next` (struct of the order columns): the following row's, and the first row's after the last.

    Rows are dealt out by ranges; the first row of each range (one row a range) links the ranges.
    """
    key = F.struct(*order)
    dealt = stage(ids.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    led = dealt.withColumn("next", F.lead(key).over(Window.partitionBy("_range").orderBy(*order)))
    firsts = dealt.groupBy("_range").agg(F.min(key).alias("_first"))
    ranges = (firsts.select("_range", F.coalesce(F.lead("_first").over(Window.orderBy("_range")),
                                                 F.first("_first").over(Window.orderBy("_range"))).alias("_following")))
    ends = led.where("next is null").join(ranges, "_range").withColumn("next", F.col("_following")).drop("_following")
    return led.where("next is not null").unionByName(ends).drop("_range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_sections).

    The edited text is the text with its last floor(n_chars / 4) code points replaced by as many (or all) from the start of
    the next document in ascending doc_id; the last one's next is the first.  Null doc_ids come first, documents with one
    doc_id follow the hash of their texts, repeated rows share one result each; a null text is empty; an empty table gives
    no rows; other columns are ignored.  `edited_sections` lists the sections whose nodes differ.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))
    ids = docs.select("doc_id", "th", F.length("text").alias("n")).distinct()
    wanted = stage(successors(ids, ["doc_id", "th"]).select(
        F.col("doc_id").alias("owner"), F.col("th").alias("owner_th"), F.col("next.doc_id").alias("n_id"), F.col("next.th").alias("n_th"),
        F.floor(F.col("n") / 4).cast("int").alias("want")))
    given = with_tree(docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("th") == F.col("n_th"))), "text", "tree")
    given = given.select("owner", "owner_th", "want", F.substring(F.col("text"), F.lit(1), F.col("want")).alias("lent"),
                         F.flatten("tree.leaves").alias("n_leaves"), F.col("tree.root").alias("n_root")).dropDuplicates(["owner", "owner_th"])
    both = docs.join(given, F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("th") == F.col("owner_th")))
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("want")), "lent"))
    both = with_tree(with_tree(both, "text", "own"), "edited", "other")
    own, other = F.flatten("own.leaves"), F.flatten("other.leaves")
    return both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       rendered("own").alias("fingerprint"), rendered("other").alias("edited_fingerprint"),
                       likeness(own, other, F.col("own.root") == F.col("other.root")).alias("near_edited"),
                       likeness(own, F.col("n_leaves"), F.col("own.root") == F.col("n_root")).alias("near_next"),
                       changed_sections("own", "other").alias("edited_sections"))
