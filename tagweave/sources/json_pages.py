"""JSON pages of images: one decoder for files of a folder and for a table of page bodies.

A page is {"images": [{"id", "tags", "representations": {"thumb", "medium"}}, ...]}; other fields
are ignored. Decoding is strict and per page: malformed text, a missing or wrongly typed field or a
null tag in any image rejects the whole page. An empty list of images is a valid page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.operators.keyed import latest


def read_folder(spark, path: str) -> DataFrame:
    """(file_name, body) of the files directly in `path`; a file is one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("body"))


def _typed(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def decode(pages: DataFrame, body: str = "body") -> DataFrame:
    """`pages` with `images`: array<struct<id, tags, thumb, img>>, null where the page is rejected."""
    page = F.try_parse_json(F.col(body))
    raw = F.try_variant_get(page, "$.images", "array<variant>")

    def read(image: Column) -> Column:
        at = lambda path, kind: F.try_variant_get(image, path, kind)
        tags = at("$.tags", "array<string>")
        good = (
            _typed(at("$.id", "variant"), "BIGINT")
            & F.coalesce(F.schema_of_variant(at("$.tags", "variant")).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
            & F.coalesce(~F.exists(tags, lambda t: t.isNull()), F.lit(False))
            & _typed(at("$.representations.thumb", "variant"), "STRING")
            & _typed(at("$.representations.medium", "variant"), "STRING")
        )
        item = F.struct(
            at("$.id", "bigint").alias("id"),
            tags.alias("tags"),
            at("$.representations.thumb", "string").alias("thumb"),
            at("$.representations.medium", "string").alias("img"),
        )
        return F.when(good, item)

    images = F.transform(raw, read)
    whole = F.when(~F.exists(images, lambda i: i.isNull()), images)
    return pages.withColumn("images", whole)


def rejected(decoded: DataFrame) -> DataFrame:
    """The pages that were refused."""
    return decoded.filter("images IS NULL")


def entries(decoded: DataFrame, order: list[str]) -> DataFrame:
    """One row (*order, pos, id, tags, thumb, img) per image of the accepted pages; `order` and
    the position in the page give the order of ingestion."""
    flat = decoded.filter("images IS NOT NULL").select(*order, F.posexplode("images").alias("pos", "image"))
    return flat.select(*order, "pos", "image.*")


def items_and_tags(ingested: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items, tags) after ingesting the entries in order: the last entry of an id is its item;
    tags are (tag, id) over all its entries, a later entry takes no tag away."""
    seq = F.struct(*order, "pos").alias("seq")
    items = latest(ingested.select(seq, "id", "tags", "thumb", "img"), ["id"]).drop("seq")
    tags = ingested.select(F.explode("tags").alias("tag"), "id").distinct()
    return items, tags
