"""Reference-manager snapshot: attachments and item metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def attachments(items: DataFrame, types: DataFrame, item_attachments: DataFrame, deleted: DataFrame) -> DataFrame:
    """Stored PDF attachments with their parent item, deleted ones left out."""
    stored = item_attachments.filter(F.col("linkMode").isin(0, 1) & (F.col("contentType") == "application/pdf")
                                     & F.startswith("path", F.lit("storage:")))
    child = items.select(F.col("itemID"), F.col("key").alias("attachment_key"))
    parent = items.join(types, "itemTypeID").select(F.col("itemID").alias("parentItemID"), F.col("key").alias("parent_key"), "typeName")
    out = stored.join(child, "itemID").join(parent, "parentItemID")
    gone = deleted.select("itemID").distinct()
    out = out.join(gone, "itemID", "left_anti").join(gone.withColumnRenamed("itemID", "parentItemID"), "parentItemID", "left_anti")
    return out.select("itemID", "parentItemID", "attachment_key", "parent_key", "typeName",
                      F.substring("path", len("storage:") + 1, 2147483647).alias("file_name"))


FIELDS = ["title", "DOI", "date", "abstractNote", "publicationTitle"]


def item_metadata(items: DataFrame, item_data: DataFrame, fields: DataFrame, values: DataFrame, creators: DataFrame,
                  item_creators: DataFrame, wanted: list[str] = FIELDS) -> DataFrame:
    """Attribute rows pivoted to one row per item, with the year of the date and ordered creators."""
    rows = item_data.join(fields, "fieldID").join(values, "valueID").filter(F.col("fieldName").isin(wanted))
    wide = rows.groupBy("itemID").pivot("fieldName", wanted).agg(F.first("value"))
    name = F.trim(F.concat_ws(" ", "firstName", "lastName"))
    people = item_creators.join(creators, "creatorID").groupBy("itemID").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("orderIndex", name.alias("name")))), lambda s: s["name"]).alias("authors"))
    out = items.select("itemID", "key").join(wide, "itemID", "left").join(people, "itemID", "left")
    year = F.nullif(F.regexp_extract(F.coalesce("date", F.lit("")), r"\b(\d{4})\b", 1), F.lit("")).cast("int") if "date" in wanted else F.lit(None).cast("int")
    return out.withColumn("year", year).withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
