"""Board captures: pages of nested items, and their wide form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("column_values", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("column", T.StructType([T.StructField("title", T.StringType())])),
    ]))),
])
PAGE = T.StructType([
    T.StructField("boards", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("items_page", T.StructType([
            T.StructField("cursor", T.StringType()),
            T.StructField("items", T.ArrayType(ITEM)),
        ])),
    ]))),
    T.StructField("page", T.LongType()),
])
PAGE_SIZE = 500


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages, many to a file, each with its number; or one to a folder page=1, page=2, ... that tells it."""
    return spark.read.schema(PAGE).json(path)


def page_items(pages: DataFrame) -> DataFrame:
    """Items of the first board, up to the first page that is empty or has no next cursor."""
    body = pages.select("page", F.get("boards", F.lit(0))["items_page"].alias("p"))
    is_last = F.col("p.cursor").isNull() | (F.coalesce(F.size("p.items"), F.lit(0)) <= 0)
    last = body.agg(F.min(F.when(is_last, F.col("page"))).alias("last_page"))
    wanted = body.crossJoin(F.broadcast(last)).filter(F.col("page") <= F.coalesce("last_page", "page"))
    return wanted.select(F.inline("p.items"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return page_items(read_pages(spark, path))


def title_of(cell: Column) -> Column:
    return F.coalesce(cell["column"]["title"], cell["id"], F.lit(""))


def unlisted_cells(titles: list[str], name_title: str) -> Column:
    """Cells of an item with a text under a title that is not listed, and those that a later cell of their title hides."""
    listed = F.array(*[F.lit(t) for t in dict.fromkeys([*titles, name_title])])
    places = F.transform("column_values", title_of)
    cells = F.transform("column_values", lambda cv, i: F.struct(
        title_of(cv).alias("title"), cv["text"].alias("text"),
        (~F.array_contains(listed, title_of(cv)) | (F.array_position(F.slice(places, i + 2, F.size(places)), title_of(cv)) > 0)).alias("out")))
    left = F.filter(cells, lambda c: c["out"] & (F.coalesce(c["text"], F.lit("")) != ""))
    return F.coalesce(F.transform(left, lambda c: F.struct(c["title"].alias("title"), c["text"].alias("text"))),
                      F.array().cast("array<struct<title:string,text:string>>"))


def unlisted(items: DataFrame, titles: list[str], name_title: str) -> DataFrame:
    """(title, cells) of all that `widen` with these titles has no column for."""
    return items.select(F.inline(unlisted_cells(titles, name_title))).groupBy("title").agg(F.count(F.lit(1)).alias("cells"))


def widen(items: DataFrame, titles: list[str], name_title: str, rest: str | None = None) -> DataFrame:
    """One column per title. Blank text is null; of repeated titles the last one counts. `rest` names a column for all
    other cells with a text, as (title, text).

    Titles are given, not discovered, and every item carries its own values, so
    this is a row-local projection: no explode, no pivot, no shuffle.
    """

    def value(title: str):
        hits = F.filter("column_values", lambda cv: title_of(cv) == title)
        return F.nullif(F.try_element_at(hits, F.lit(-1))["text"], F.lit(""))

    named = F.filter("column_values", lambda cv: title_of(cv) == name_title)
    name = F.when(F.size(named) > 0, value(name_title)).otherwise(F.coalesce("name", F.lit("")))
    more = [unlisted_cells(titles, name_title).alias(rest)] if rest else []
    return items.select(name.alias(name_title), *[value(t).alias(t) for t in titles if t != name_title], *more)


def write_pages(rows: DataFrame, page: Column | str, name_title: str, path: str) -> str:
    """Store a wide text table as board pages of at most PAGE_SIZE items; the caller gives the page of each row, as an
    expression or as the name of a column that is no cell.

    Rows meet as they are and become items, in which every cell carries its titles, only where their page is written.
    """
    cells = [c for c in rows.columns if c != page]
    page = F.col(page) if isinstance(page, str) else page
    paged = rows.select(page.cast("long").alias("page"), F.struct(*[F.col(f"`{c}`") for c in cells]).alias("row")).groupBy(
        "page").agg(F.collect_list("row").alias("rows"))

    def item(row: Column) -> Column:
        cell = lambda c: F.struct(
            F.lit(c).alias("id"), F.coalesce(row[c], F.lit("")).alias("text"), F.lit(None).cast("string")
            .alias("value"), F.lit("text").alias("type"), F.struct(F.lit(c).alias("title")).alias("column"))
        return F.struct(row[name_title].alias("id"), row[name_title].alias("name"),
                        F.array(*[cell(c) for c in cells if c != name_title]).alias("column_values"))

    cursor = F.concat(F.lit("next-"), (F.col("page") + 1).cast("string"))
    board = F.array(F.struct(F.lit("1").alias("id"), F.lit("board").alias("name"),
                             F.struct(cursor.alias("cursor"), F.transform("rows", item).alias("items")).alias("items_page")))
    paged.select("page", board.alias("boards")).write.mode("overwrite").option("compression", "gzip").json(path)
    return path
