"""Pages to documents: merging, markdown assembly, page limits and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import strip


def merge_pages(pages: DataFrame) -> DataFrame:
    """A row per document of its pages, in page order.

    pages: document_id, page, page_index, pdf_path, model, success, latency, rotation_applied,
    prompt_tokens, completion_tokens, total_tokens, content, src_pos. Missing page numbers are 0, a
    missing success is a failure, a total of nothing is prompt plus completion. Texts lose white
    space at their end, empty ones are left out. The first page read gives path and model; of
    repeated pages the last gives the rotation.
    """
    total = F.when(F.coalesce("total_tokens", F.lit(0)) != 0, F.col("total_tokens")).otherwise(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))
    text = F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)\s+$", "")
    place = F.struct(F.coalesce("page_index", F.lit(0)).alias("i"), F.coalesce("page", F.lit(0)).alias("p"), F.col("src_pos").alias("s"), text.alias("t"))
    turned = F.struct(F.coalesce("page", F.lit(0)).alias("p"), F.col("src_pos").alias("s"), F.coalesce("rotation_applied", F.lit(0)).alias("r"))
    out = pages.groupBy("document_id").agg(
        F.min_by("pdf_path", "src_pos").alias("pdf_path"),
        F.min_by("model", "src_pos").alias("model"),
        F.bool_and(F.coalesce("success", F.lit(False))).alias("success"),
        F.count("*").alias("page_count"),
        F.sum(F.coalesce("latency", F.lit(0.0))).alias("total_latency"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).cast("long").alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).cast("long").alias("completion_tokens"),
        F.sum(total).cast("long").alias("total_tokens"),
        F.array_sort(F.collect_list(place)).alias("_pages"),
        F.array_sort(F.collect_list(turned)).alias("_turned"),
    )
    # sorted by page and place, so the last of a page has another page behind it
    after = F.slice("_turned", 2, F.size("_turned"))
    last = F.filter(F.transform("_turned", lambda x, i: F.when(F.coalesce(F.get(after, i).p, x.p + 1) != x.p, F.struct(x.p, x.r))), lambda x: x.isNotNull())
    last = F.map_from_entries(last)
    body = F.array_join(F.filter(F.transform("_pages", lambda x: x.t), lambda t: t != ""), "\n")
    return out.withColumns({"rotation_applied": last, "text": body}).drop("_pages", "_turned")


def head_pages(pages: DataFrame, id_col: str, page_col: str, n: int) -> DataFrame:
    """The first n pages of each document."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(page_col))
    return pages.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def formula(text: Column) -> Column:
    """Inline or display mathematics; delimiters that are there stay."""
    t = strip(text)
    slashes = F.length(t) - F.length(F.replace(t, F.lit("\\"), F.lit("")))
    display = t.contains("\n") | (slashes > 3)
    return F.when(t.startswith("$") & t.endswith("$"), t).when(display, F.concat(F.lit("$$\n"), t, F.lit("\n$$"))).otherwise(F.concat(F.lit("$"), t, F.lit("$")))


def element_markdown(category: Column, text: Column, skip_margins: bool = False) -> Column:
    """Markdown of a layout element; empty text, pictures and (if asked for) page margins give nothing."""
    t = strip(F.coalesce(text, F.lit("")))
    wrap = lambda a, x, b: F.concat(F.lit(a), x, F.lit(b))
    margin = category.isin("Page-header", "Page-footer")
    listed = t.rlike(r"^([-*+] |[1-9]\.)")
    return (
        F.when((t == "") | (category == "Picture") | (F.lit(skip_margins) & margin), "")
        .when(category == "Title", wrap("# ", t, "\n\n"))
        .when(category == "Section-header", wrap("## ", t, "\n\n"))
        .when(category == "Formula", wrap("", formula(t), "\n\n"))
        .when(category == "Table", wrap("\n", t, "\n"))
        .when(category == "List-item", F.when(listed, wrap("", t, "\n")).otherwise(wrap("- ", t, "\n")))
        .when(category == "Caption", wrap("*", t, "*\n\n"))
        .when(category == "Footnote", wrap("^[", t, "]\n\n"))
        .when(margin, wrap("_", t, "_\n\n"))
        .otherwise(wrap("", t, "\n\n"))
    )


def assemble_markdown(pages: DataFrame, markers: bool = True, skip_margins: bool = False, header: bool = True) -> DataFrame:
    """(document_id, page_count, markdown) of pages (document_id, page, src_pos, elements array<struct<category,text>>).

    Pages are ordered by number, equal numbers as read. A page without elements gives its marker.
    """
    body = F.array_join(F.transform("elements", lambda e: element_markdown(F.coalesce(e.category, F.lit("Text")), e.text, skip_margins)), "")
    mark = F.concat(F.lit("<!-- Page "), F.col("page").cast("string"), F.lit(" -->\n\n")) if markers else F.lit("")
    page = pages.select("document_id", F.struct("page", "src_pos", F.concat(mark, F.coalesce(body, F.lit(""))).alias("md")).alias("p"))
    out = page.groupBy("document_id").agg(F.count("*").alias("page_count"), F.array_sort(F.collect_list("p")).alias("ps"))
    text = F.array_join(F.col("ps.md"), "")
    if header:
        top = F.concat(F.lit("# Document: "), F.col("document_id").cast("string"), F.lit("\n\n*Processed from "), F.col("page_count").cast("string"), F.lit(" pages*\n\n---\n\n"))
        text = F.concat(top, text)
    return out.select("document_id", "page_count", text.alias("markdown"))


def layout_elements(content: Column) -> Column:
    """Elements of a page's layout JSON; elements that aren't objects make the whole null."""
    return F.from_json(content, "array<struct<bbox:array<double>,category:string,text:string>>")


def page_failures(pages: DataFrame) -> DataFrame:
    """(document_id, failed, pages): failed pages of each document, in the order of their text."""
    bad = pages.where(~F.coalesce("success", F.lit(False)))
    return bad.groupBy("document_id").agg(F.count("*").alias("failed"), F.array_join(F.array_sort(F.collect_list(F.col("page").cast("string"))), ", ").alias("pages"))


def page_totals(pages: DataFrame) -> DataFrame:
    """Counts and mean latency of page results."""
    ok = F.coalesce("success", F.lit(False))
    return pages.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.avg("latency").alias("avg_latency"))
