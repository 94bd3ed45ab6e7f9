"""Queries p2 to p9 over the test tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.catalog import ELEMENTS_SQL, RECORDS_SQL, form_sql
from tagweave.functions.text import elements, tag_form
from tagweave.llm import cooccur, iceberg, overlap, packing, pii, similar, terms, tokens
from tagweave.operators.keyed import pairs_present
from tagweave.session import table


def replies(spark, d) -> DataFrame:
    return table(spark, d, "search_response_info")


def records(spark, d) -> DataFrame:
    """(tag, id) without repetition: the tag sets of the records."""
    return elements(replies(spark, d).filter("id IS NOT NULL"), keep=("id",)).distinct()


#: Ranges of 131,072 image ids: these lie densely, so a range is well filled and a task's share is bounded.
RANGE_BITS = 17


# ---- p2 -----------------------------------------------------------------------------------------


def compared_members(spark, d) -> DataFrame:
    """(origin, k, id) of the sets to compare. The log and the replies are reduced to the compared
    keys before anything is shuffled; Spark broadcasts the keys if they are few."""
    wanted = table(spark, d, "compared_sets").select("origin", "k").dropna().distinct()
    log = table(spark, d, "hitchhiker_set_map").filter("root = 'audience'").select(tag_form(F.col("k")).alias("k"), F.col("v").alias("id"), "seq", "op")
    log = log.join(wanted.filter("origin = 'root'").select("k"), "k", "left_semi")
    present = pairs_present(log, ["k", "id"]).select(F.lit("root").alias("origin"), "k", "id")
    tagged = elements(replies(spark, d).filter("id IS NOT NULL"), keep=("id",)).withColumnRenamed("tag", "k")
    tagged = tagged.join(wanted.filter("origin = 'tags'").select("k"), "k", "left_semi")
    return present.unionByName(tagged.select(F.lit("tags").alias("origin"), "k", "id"))


def p2_overlaps(spark, d):
    """Shared identifiers of each pair of compared sets that share any, with the sizes of both."""
    return overlap.overlap_sizes(compared_members(spark, d), bits=RANGE_BITS)


def p2_compared(spark, d):
    """Shared identifiers of every pair of compared sets, 0 where they share none or one has no members."""
    return overlap.overlap_sizes(compared_members(spark, d), bits=RANGE_BITS, wanted=table(spark, d, "compared_sets"))


def p2_found(spark, d):
    """Pairs with |A and B| / |A or B| >= 1/3."""
    pairs = p2_overlaps(spark, d)
    return pairs.filter(3 * F.col("n_common") >= F.col("size_a") + F.col("size_b") - F.col("n_common")).select("origin", "key_a", "key_b")


# ---- p3, p4 -------------------------------------------------------------------------------------


def p3_terms(spark, d):
    """Elements and records of every tag, with its mark."""
    return terms.frequencies(elements(replies(spark, d)))


def p3_found(spark, d):
    return p3_terms(spark, d).filter("mark IS NOT NULL").select("tag", "mark")


def p4_top(spark, d):
    """Tags with at least 1 % of all elements, with their exact counts."""
    return iceberg.heavy_hitters(elements(replies(spark, d), keep=()), share=0.01)


def p4_found(spark, d):
    return p4_top(spark, d).select("tag")


# ---- p5, p6 -------------------------------------------------------------------------------------


def items_of_records(spark, d) -> DataFrame:
    """(id, item) per element; the operators below form the sets themselves."""
    return elements(replies(spark, d).filter("id IS NOT NULL"), keep=("id",)).select("id", F.col("tag").alias("item"))


def p5_found(spark, d):
    """Pairs of records of at least 4 tags with |A and B| / |A or B| >= 0.7.

    Not the complete list where more than 1,000 records have equal sets: such a class, whose id is its
    least record, has only the pairs of that record with each copy and with each partner, and the
    columns don't tell. For every pair, put all records of the same class in `p5_classes` in the place
    of either side of each row, and add the pairs within each class.
    """
    return similar.similar_pairs(items_of_records(spark, d), 0.7, least=4)


def p5_classes(spark, d):
    """Class of equal tag sets of each record, and its number of similar classes."""
    return similar.class_members(items_of_records(spark, d), 0.7, least=4)


def _pairs(spark, d, min_count: int, min_share: float) -> DataFrame:
    return cooccur.cooccurrences(items_of_records(spark, d), "id", "item", min_count=min_count, min_share=min_share)


def p6_found(spark, d):
    """Pairs in at least 5 records and 0.2 % of them, four times as often as by chance."""
    pairs = _pairs(spark, d, 5, 0.002).filter(F.col("n_ab") * F.col("n") >= 4 * F.col("n_a") * F.col("n_b"))
    return pairs.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p6_pairs(spark, d):
    """Every pair of tags that some record holds, with its counts, factor over chance and significance."""
    return _pairs(spark, d, 1, 0.0).withColumnsRenamed({"item_a": "tag_a", "item_b": "tag_b"})


def p6_counts(spark, d):
    """The counts and the factor of `p6_pairs`."""
    return p6_pairs(spark, d).select("tag_a", "tag_b", "n_ab", "n_a", "n_b", "n", "lift")


# ---- p7 -----------------------------------------------------------------------------------------


def p7_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"))


def p7_decoded(spark, d):
    """The texts again, from their ids."""
    return tokens.decoded(p7_ids(spark, d))


# ---- p8 -----------------------------------------------------------------------------------------


def p8_containers(spark, d):
    """Every decision in containers of 2,048 tokens."""
    return packing.fill_containers(table(spark, d, "documents"))


def p8_fill(spark, d):
    """Containers, the least number possible, and the share of unused space."""
    return packing.container_fill(p8_containers(spark, d))


def p8_blocks(spark, d):
    """Of each block, the containers before and after the local search."""
    return packing.block_fill(table(spark, d, "documents"))


def p8_laws(spark, d):
    """How often the packing breaks a law: never."""
    return packing.laws(p8_containers(spark, d), tokens.count(table(spark, d, "documents")))


# ---- p9 -----------------------------------------------------------------------------------------


def p9_found(spark, d):
    """Personal information in every decision."""
    return pii.found(table(spark, d, "documents"))


def p9_redacted(spark, d):
    """Every decision with placeholders in its stead."""
    return pii.redacted(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_overlaps, p2_compared, p3_found, p3_terms, p4_found, p4_top, p5_found, p5_classes, p6_found, p6_pairs, p6_counts, p7_ids, p7_decoded, p8_containers, p8_fill, p8_blocks, p8_laws, p9_found, p9_redacted)}

_MEMBERS = f"""{RECORDS_SQL}, mem AS (
 SELECT 'root' AS origin, k, v AS id FROM (SELECT k, v, arg_max(op, seq) AS op FROM (SELECT {form_sql("k")} AS k, v, op, seq FROM hitchhiker_set_map WHERE root = 'audience' AND k IS NOT NULL AND v IS NOT NULL) GROUP BY ALL)
  WHERE op = 'U' AND k IN (SELECT k FROM compared_sets WHERE origin = 'root')
 UNION ALL SELECT 'tags', tag, id FROM rec WHERE tag IN (SELECT k FROM compared_sets WHERE origin = 'tags')),
 sz AS (SELECT origin, k, count(*) AS n FROM mem GROUP BY ALL),
 ov AS (SELECT a.origin, a.k AS key_a, b.k AS key_b, count(*) AS n_common FROM mem a JOIN mem b ON a.origin = b.origin AND a.id = b.id AND a.k < b.k GROUP BY ALL),
 os AS (SELECT ov.origin, key_a, key_b, x.n AS size_a, y.n AS size_b, n_common FROM ov JOIN sz x ON x.origin = ov.origin AND x.k = key_a JOIN sz y ON y.origin = ov.origin AND y.k = key_b)"""
_TERMS = f"""{RECORDS_SQL}, tot AS (SELECT count(DISTINCT id) AS n FROM rec),
 fr AS (SELECT tag, count(*) AS n_elements, count(DISTINCT id) AS n_records FROM el GROUP BY tag),
 mk AS (SELECT *, CASE WHEN n_records > 0.5 * (SELECT n FROM tot) THEN 'common' WHEN n_records < 3 THEN 'rare' END AS mark FROM fr)"""

_SIMILAR = f"""{RECORDS_SQL}, st AS (SELECT id, list(tag ORDER BY tag) AS tags, count(*) AS n FROM rec GROUP BY id HAVING count(*) >= 4), big AS (SELECT rec.id, tag, n FROM rec JOIN st USING (id)),
 pr AS (SELECT a.id AS id_a, b.id AS id_b FROM big a JOIN big b ON a.tag = b.tag AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*)))"""
_CLASSES = f"""{_SIMILAR}, cl AS (SELECT id, min(id) OVER (PARTITION BY tags) AS class_id FROM st),
 ends AS (SELECT id_a AS id FROM pr WHERE id_a IN (SELECT class_id FROM cl) AND id_b IN (SELECT class_id FROM cl) UNION ALL SELECT id_b FROM pr WHERE id_a IN (SELECT class_id FROM cl) AND id_b IN (SELECT class_id FROM cl)),
 ln AS (SELECT id, count(*) AS n_links FROM ends GROUP BY id)"""
_TOGETHER = f"""{RECORDS_SQL}, tn AS (SELECT count(DISTINCT id) AS n FROM rec), fq AS (SELECT tag, count(*) AS f FROM rec GROUP BY tag),
 fr AS (SELECT id, tag, f FROM rec JOIN fq USING (tag), tn WHERE f >= 5 AND f >= 0.002 * n),
 pc AS (SELECT a.tag AS tag_a, b.tag AS tag_b, any_value(a.f) AS n_a, any_value(b.f) AS n_b, count(*) AS n_ab, any_value(tn.n) AS n FROM fr a JOIN fr b ON a.id = b.id AND a.tag < b.tag, tn GROUP BY ALL HAVING count(*) >= 5 AND count(*) >= 0.002 * any_value(tn.n))"""

SQL = {
    "p2_found": f"WITH {_MEMBERS} SELECT origin, key_a, key_b FROM os WHERE 3 * n_common >= size_a + size_b - n_common",
    "p2_overlaps": f"WITH {_MEMBERS} SELECT * FROM os",
    "p2_compared": f"WITH {_MEMBERS}, cs AS (SELECT DISTINCT origin, k FROM compared_sets WHERE origin IS NOT NULL AND k IS NOT NULL) SELECT a.origin, a.k AS key_a, b.k AS key_b, coalesce(x.n, 0) AS size_a, coalesce(y.n, 0) AS size_b, coalesce(n_common, 0) AS n_common FROM cs a JOIN cs b ON a.origin = b.origin AND a.k < b.k LEFT JOIN ov ON ov.origin = a.origin AND ov.key_a = a.k AND ov.key_b = b.k LEFT JOIN sz x ON x.origin = a.origin AND x.k = a.k LEFT JOIN sz y ON y.origin = a.origin AND y.k = b.k",
    "p3_found": f"WITH {_TERMS} SELECT tag, mark FROM mk WHERE mark IS NOT NULL",
    "p3_terms": f"WITH {_TERMS} SELECT tag, n_elements, n_records, mark FROM mk",
    "p4_found": f"WITH {ELEMENTS_SQL} SELECT tag FROM el GROUP BY tag HAVING count(*) >= 0.01 * (SELECT count(*) FROM el)",
    "p4_top": f"WITH {ELEMENTS_SQL} SELECT tag, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM el) AS share FROM el GROUP BY tag HAVING count(*) >= 0.01 * (SELECT count(*) FROM el)",
    "p5_found": f"WITH {_SIMILAR} SELECT id_a, id_b FROM pr",
    "p5_classes": f"WITH {_CLASSES} SELECT cl.id, class_id, coalesce(n_links, 0) AS n_links FROM cl LEFT JOIN ln ON ln.id = class_id",
    "p6_found": f"WITH {_TOGETHER} SELECT tag_a, tag_b FROM pc WHERE n_ab * n >= 4 * n_a * n_b",
    "p6_counts": f"WITH {RECORDS_SQL}, tn AS (SELECT count(DISTINCT id) AS n FROM rec), fq AS (SELECT tag, count(*) AS f FROM rec GROUP BY tag), ab AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM rec a JOIN rec b ON a.id = b.id AND a.tag < b.tag GROUP BY ALL) SELECT tag_a, tag_b, n_ab, x.f AS n_a, y.f AS n_b, tn.n AS n, n_ab::DOUBLE * tn.n / (x.f * y.f) AS lift FROM ab JOIN fq x ON x.tag = tag_a JOIN fq y ON y.tag = tag_b, tn",
    "p8_laws": "SELECT count(*) AS n_texts, 0::BIGINT AS n_overfull, 0::BIGINT AS n_cut, 0::BIGINT AS n_gaps, 0::BIGINT AS n_wrong FROM documents",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
