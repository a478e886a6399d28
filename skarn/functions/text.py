"""Text expressions: snippets, formats, headings, lines, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_EXTRACTED = 200


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def snippet(text: Column, size: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(text, "\n", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size - 3), F.lit("..."))).otherwise(flat)


def hit_block(heading: Column, source: Column, url: Column, body: Column) -> Column:
    """One search hit as markdown; only web addresses become links."""
    link = F.when(url.startswith("http://") | url.startswith("https://"), F.concat(F.lit("Source: ["), source, F.lit("]("), url, F.lit(")"))).otherwise(F.concat(F.lit("Source: "), source, F.lit(" ("), url, F.lit(")")))
    return F.concat(F.lit("### "), heading, F.lit("\n"), link, F.lit("\n\n"), body)


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.round(x.cast("double"), 6).cast("decimal(18,6)").cast("string")), ","), F.lit("]"))


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else 0."""
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s+(.*)$", 1))


def heading_title(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, r"^(#{1,6})\s+(.*)$", 2))


def is_fence(line: Column) -> Column:
    return F.ltrim(line).startswith("```")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 0, line, fence, inside): inside is true between fences, on the opening one too."""
    out = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    by = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("fence", is_fence(F.col("line")))
    return out.withColumn("inside", (F.sum(F.col("fence").cast("int")).over(by) % 2) == 1)


def is_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Link lists: three link bullets at least, and half of the content lines."""
    out = lines(docs, id_col, text_col).where(~F.col("fence") & ~F.col("inside"))
    bullet = F.col("line").rlike(r"^\s*[-*+]\s+\[[^\]]+\]\([^)]+\)")
    content = (F.trim("line") != "") & ~F.ltrim("line").startswith("#")
    counted = out.groupBy(id_col).agg(F.count_if(bullet & content).alias("links"), F.count_if(content).alias("lines"))
    return counted.withColumn("is_index", (F.col("links") >= 3) & (F.col("links") * 2 >= F.col("lines")))


def index_links(docs: DataFrame, id_col: str, text_col: str, base_col: str | None = None) -> DataFrame:
    """(id, ord, url): web links of bullets outside fences, the first of each url; others are resolved where a base is given."""
    out = lines(docs, id_col, text_col).where(~F.col("fence") & ~F.col("inside"))
    out = out.select(id_col, F.col("line_no").alias("ord"), F.regexp_extract("line", r"^\s*[-*+]\s+\[[^\]]+\]\(([^)\s]+)\)", 1).alias("url")).where("url <> ''")
    if base_col is not None:
        from .urls import joined

        out = out.where("not url like '#%'").join(docs.select(id_col, base_col), id_col).withColumn("url", F.regexp_extract(joined(F.col(base_col), F.col("url")), r"^([^#]*)", 1)).drop(base_col)
    out = out.where("url rlike '^https?://'")
    return out.groupBy(id_col, "url").agg(F.min("ord").alias("ord"))


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sections of full-content files: (id, ord, title, slug, markdown).

    Split at level 1 when there are two such headings, else at level 2 when there are two,
    else the whole text is one preamble; headings inside fences don't count.
    """
    w = Window.partitionBy(id_col).orderBy("line_no")
    out = lines(docs, id_col, text_col).withColumn("level", F.when(~F.col("inside") & ~F.col("fence"), heading_level(F.col("line"))).otherwise(0))
    per = Window.partitionBy(id_col)
    ones, twos = (F.count_if(F.col("level") == k).over(per) for k in (1, 2))
    out = out.withColumn("cut", F.when(ones >= 2, 1).when(twos >= 2, 2).otherwise(0))
    out = out.withColumn("sec", F.count_if((F.col("level") == F.col("cut")) & (F.col("cut") > 0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = out.groupBy(id_col, "cut", "sec").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    by = by.withColumn("markdown", F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    by = by.where((F.col("sec") > 0) | (F.col("cut") == 0) | (F.regexp_replace("markdown", r"\s", "") != ""))
    title = F.when(F.col("sec") > 0, heading_title(F.col("ls")[0]["line"])).otherwise("preamble")
    from .urls import slugify

    return by.select(id_col, F.col("sec").alias("ord"), title.alias("title"), slugify(title).alias("slug"), "markdown")


def breadcrumbs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, path) of heading lines: the latest heading of each level above, deeper ones dropped."""
    out = lines(docs, id_col, text_col).where(~F.col("inside") & ~F.col("fence")).withColumn("level", heading_level(F.col("line"))).where("level > 0").withColumn("title", heading_title(F.col("line")))
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    levels = []
    for k in range(1, 7):
        last = F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), ignorenulls=True).over(w)
        out = out.withColumn(f"h{k}", last)
        levels.append(k)
    for k in levels:
        above = F.greatest(*[F.coalesce(F.last(F.when(F.col("level") == j, F.col("line_no")), ignorenulls=True).over(w), F.lit(-1)) for j in range(1, k)], F.lit(-1), F.lit(-1))
        keep = (F.col("level") >= k) & (F.col(f"h{k}.line_no") > above)
        out = out.withColumn(f"p{k}", F.when(keep & (F.col(f"h{k}.title") != ""), F.col(f"h{k}.title")))
    return out.select(id_col, "line_no", F.concat_ws(" > ", *[f"p{k}" for k in levels]).alias("path"))
