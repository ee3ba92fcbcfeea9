"""Merkle fingerprints of documents, in SQL functions only.

Leaves are paragraphs: runs of text up to a line end, longer ones cut after sentences; nothing of a text is left out of its
leaves. A section is a run of leaves up to one whose digest starts with 0 or 1, so a section's edges follow the content and an
edit moves none of the later ones. A section's digest is the SHA-256 of its leaves' digests, the root's that of the sections'.
The fingerprint is the root, then for each section its digest and the digests of its leaves (shortened): equal roots mean
equal texts, differing sections and leaves locate an edit. Likeness is the share of leaf digests that two texts have in
common (Jaccard).

The next document in an order over the whole table comes without one global window: ids are cut into ranges at (at most
``ranges``) approximate quantiles, a range is a window of its own, and the head of the next range joins it as a guest row.
Results: null texts count as empty, and empty texts are equal to each other (likeness 1); null ids come last in the order;
rows that share an id stand next to each other in order of text; a single document is its own next one; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.llm.common import two_columns

LEAF = "(?<=\\n)|(?<=[.!?] )"
LOWEST = -(1 << 63)


def _digest(c: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def leaves(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, LEAF), lambda x: x != ""), lambda x: _digest(x))


def sections(leaf_digests: Column) -> Column:
    """Strings of comma-ended leaf digests, one per section."""
    listed = F.when(F.size(leaf_digests) == 0, F.lit("")).otherwise(F.concat(F.array_join(leaf_digests, ","), F.lit(",")))
    return F.filter(F.split(listed, "(?<=\\b[01][0-9a-f]{15},)"), lambda x: x != "")


def tree(section_strings: Column) -> Column:
    branches = F.transform(section_strings, lambda x: F.concat(_digest(x, 8), F.lit(":"), F.regexp_replace(x, "([0-9a-f]{8})[0-9a-f]{8},", "$1")))
    root = F.sha2(F.array_join(F.transform(section_strings, lambda x: F.sha2(x, 256)), ""), 256)
    return F.concat_ws("/", F.substring(root, 1, 32), F.array_join(branches, "/"))


def likeness(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def fingerprints(docs: DataFrame, text_cols: dict[str, str]) -> DataFrame:
    """Adds, per (text column, name): ``<name>_leaves`` and ``<name>`` (the fingerprint)."""
    docs = docs.withColumns({f"{n}_leaves": leaves(F.col(c)) for c, n in text_cols.items()})
    docs = docs.withColumns({f"{n}_sections": sections(F.col(f"{n}_leaves")) for n in text_cols.values()})
    return docs.withColumns({n: tree(F.col(f"{n}_sections")) for n in text_cols.values()}).drop(*[f"{n}_sections" for n in text_cols.values()])


def with_next(docs: DataFrame, ranges: int = 1000, rows_per_range: int = 500) -> DataFrame:
    """``docs`` (doc_id, text without nulls) with ``next_text``: the next document's by descending id, the last one's the first's."""
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(LOWEST)))
    n = docs.count()
    points = min(ranges, n // rows_per_range)
    cuts = []
    if points > 1:
        at = [i / points for i in range(1, points)]
        cuts = sorted(set(keyed.agg(F.percentile_approx("key", at, 100 * points)).first()[0]))
    # the number of cuts above a key: 0 is the first range in descending order
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("key"))) if cuts else F.lit(0)
    ranged = keyed.withColumn("range", bucket)
    heads = ranged.groupBy("range").agg(F.max("key").alias("key"))  # at most `ranges` rows
    order = Window.orderBy("range")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    previous = F.coalesce(F.lag("range").over(order), F.last("range").over(everything))
    guests = heads.select("key", previous.alias("range"))
    guest_rows = (keyed.join(F.broadcast(guests), "key").groupBy("range", "key").agg(F.min("text").alias("text"))
                  .select(F.col("key").alias("doc_id"), "text", "key", "range", F.lit(True).alias("guest")))
    both = ranged.withColumn("guest", F.lit(False)).unionByName(guest_rows)
    inside = Window.partitionBy("range").orderBy("guest", F.desc("key"), "text")
    return both.withColumn("next_text", F.lead("text").over(inside)).where(~F.col("guest")).select("doc_id", "text", "next_text")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (the last third replaced by the start of the next document's text),
    and their likeness: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    texts = two_columns(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    third = F.expr("cast(floor(n_chars / 3) as int)")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.substring(F.col("next_text"), F.lit(1), third))
    rows = with_next(texts).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
    marked = (fingerprints(rows, {"text": "fingerprint", "edited": "edited_fingerprint"})
              .withColumn("next_leaves", leaves(F.col("next_text"))))
    return marked.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                         likeness(F.col("fingerprint_leaves"), F.col("edited_fingerprint_leaves")).alias("near_edited"),
                         likeness(F.col("fingerprint_leaves"), F.col("next_leaves")).alias("near_next"))
