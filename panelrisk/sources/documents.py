"""Elements of one large JSON document, read in parallel by a scan of its brackets.

Spark reads a document with ``multiLine`` as one task. Here the text source cuts it at every closing brace, so any number
of tasks read ranges of it, and the depth of each piece follows from running sums: a range doesn't know whether it starts
inside a string, so it counts for both cases, and the totals of the ranges before it tell which one holds.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelrisk.session import cut_lineage

#: The depth at which the elements of an array of the outermost object stand.
ELEMENT_DEPTH = 2


def _depth_change(text: Column, inside: bool) -> Column:
    """Opening less closing brackets of a piece outside strings, if it starts inside a string or not."""
    bare = F.regexp_replace(text, r'^[^"]*("|$)', "") if inside else text
    bare = F.regexp_replace(bare, r'"[^"]*("|$)', "")
    return F.length(F.regexp_replace(bare, r"[^\[{]+", "")) - F.length(F.regexp_replace(bare, r"[^\]}]+", ""))


def array_elements(spark: SparkSession, path: str, array: str = "features") -> DataFrame:
    """(path, number, text) of each element of the array of that name in the outermost object of every document.

    Elements are objects; the numbers order them. A document may hold other members, but no array of that name in them.
    The text of an element is one row; documents are of any size.
    """
    pieces = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value"
    )
    plain = F.regexp_replace("value", r"\\.", "")
    counted = pieces.select("*", F.length(F.regexp_replace(plain, '[^"]+', "")).alias("quotes"), _depth_change(plain, False).alias("outer"), _depth_change(plain, True).alias("inner"))
    order = Window.partitionBy("path", "start").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    running = counted.withColumn("seen", F.sum("quotes").over(order))
    open_at_start = ((F.col("seen") - F.col("quotes")) % 2).cast("boolean")  # if the range itself starts outside

    def change(flipped: bool) -> Column:
        starts, ends = open_at_start != F.lit(flipped), ((F.col("seen") % 2) == 1) != F.lit(flipped)
        # The brace the piece was cut at closes an object unless it stands in a string.
        return F.when(starts, F.col("inner")).otherwise(F.col("outer")) - F.when(ends, 0).otherwise(1)

    steps = running.select("path", "start", "id", "value", "quotes", "seen", change(False).alias("even"), change(True).alias("odd"))
    summed = cut_lineage(steps.withColumns({"even_depth": F.sum("even").over(order), "odd_depth": F.sum("odd").over(order)}))
    ranges = summed.groupBy("path", "start").agg(F.sum("quotes").alias("quotes"), F.sum("even").alias("even"), F.sum("odd").alias("odd"))
    files = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("flipped", F.coalesce(F.sum("quotes").over(files), F.lit(0)) % 2 == 1)
    ranges = ranges.withColumn("depth", F.coalesce(F.sum(F.when(F.col("flipped"), F.col("odd")).otherwise(F.col("even"))).over(files), F.lit(0)))
    placed = summed.join(ranges.select("path", "start", "flipped", "depth"), ["path", "start"])
    after = F.col("depth") + F.when(F.col("flipped"), F.col("odd_depth")).otherwise(F.col("even_depth"))
    before = after - F.when(F.col("flipped"), F.col("odd")).otherwise(F.col("even"))
    closed = ((F.col("seen") % 2) == 1) == F.col("flipped")  # the brace is outside strings
    ends = (closed & (after == ELEMENT_DEPTH)).cast("long")
    marked = placed.select("path", "start", "id", "value", F.least(before, after).alias("low"), ends.alias("ends"))
    # The number of an element: how many end before the piece, in its range and in those before.
    number = F.sum("ends").over(order) - F.col("ends")
    earlier = marked.groupBy("path", "start").agg(F.sum("ends").alias("n"))
    earlier = earlier.select("path", "start", F.coalesce(F.sum("n").over(files), F.lit(0)).alias("earlier"))
    numbered = marked.withColumn("number", number).join(earlier, ["path", "start"]).withColumn("number", F.col("number") + F.col("earlier"))
    whole = numbered.groupBy("path", "number").agg(
        F.array_sort(F.collect_list(F.struct("start", "id", "value"))).alias("pieces"), F.min("low").alias("low"), F.max("ends").alias("complete")
    )
    text = F.concat(F.array_join(F.transform("pieces", lambda p: p["value"]), "}"), F.lit("}"))
    # What stands before the array is no part of its first element; an object of another member is no element.
    head = rf'^[\s\S]*?"{array}"\s*:\s*\['
    outside = F.col("low") < ELEMENT_DEPTH
    text = F.when(outside & text.rlike(head), F.regexp_replace(text, head, "")).when(~outside, text)
    elements = whole.filter("complete = 1").select("path", "number", F.regexp_replace(text, r"^[\s,]+", "").alias("text"))
    return elements.filter(F.startswith("text", F.lit("{")))
