"""From lines to units: paragraphs, repeated lines, page furniture, counters, merging, section titles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Words below which a unit takes in the next, words up to which that may be, and units of a work batch.
SHORT_WORDS, JOINED_WORDS, BATCH = 35, 100, 8


def _joined(order: str, value: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "\n")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Runs of non-blank lines of each document, with their first and last line. Only documents are kept together."""
    blank = (F.trim("line") == "").cast("int")
    island = F.sum(blank).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lines.withColumn("island", island).where(F.trim("line") != "")
    return rows.groupBy("doc_id", "island").agg(_joined("line_no", "line").alias("raw_content"), F.min("line_no").alias("source_start"), F.max("line_no").alias("source_end")).drop("island")


def repeated_lines(lines: DataFrame, most: int = 120, times: int = 3) -> DataFrame:
    """Lines of up to `most` characters that occur at least `times` times in their document."""
    text = F.trim("line")
    return lines.select("doc_id", text.alias("line")).where((F.col("line") != "") & (F.length("line") <= most)).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= times)


def _dealt(lines: DataFrame, unicode: Callable[[Column], Column] = X.nfkc) -> DataFrame:
    """Lines, a document's all in one task, with their Unicode form where it is another. It is made before, as Spark would
    deal the rows again after Python; windows, joins and groups of documents stay where the lines are."""
    return lines.withColumn("form", F.nullif(unicode(F.trim("line")), F.trim("line"))).repartition("doc_id")


def _characters() -> Column:
    """The Unicode form of a line of `_dealt`, without spaces at its ends."""
    return F.coalesce("form", F.trim("line"))


def page_furniture(lines: DataFrame, unicode: Callable[[Column], Column] = X.nfkc) -> DataFrame:
    """Keys of the first and last three non-blank lines of pages that occur on at least 35 % of a document's pages,
    and on two (three in a document of one page).

    Lines are dealt once, by document; places on pages, pages and keys are all counted where a document's lines then are.
    """
    filled = F.trim("line") != ""
    page = Window.partitionBy("doc_id", "page_number")
    down = F.count_if(filled).over(page.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    opens = (F.row_number().over(page.orderBy("line_no")) == 1).cast("int")
    rows = _dealt(lines.select("doc_id", "page_number", "line_no", "line"), unicode).withColumns({"down": down, "opens": opens, "filled": F.count_if(filled).over(page)})
    rows = rows.withColumn("pages", F.sum("opens").over(Window.partitionBy("doc_id"))).where(filled & ((F.col("down") <= 3) | (F.col("filled") - F.col("down") < 3)))
    # no line is on three pages of one, so the keys of such documents are not made
    edges = rows.where("pages > 1").select("doc_id", "page_number", "pages", X.line_key(_characters(), lambda text: text).alias("key"))
    counted = edges.groupBy("doc_id", "key").agg(F.count_distinct("page_number").alias("on_pages"), F.first("pages").alias("pages"))
    return counted.where(F.col("on_pages") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.35))).select("doc_id", "key", "on_pages")


def without_counters(lines: DataFrame) -> DataFrame:
    """C4: page counters go if they are a page's first or last non-blank line, bare page numbers if they are the last."""
    rows = lines.where(F.trim("line") != "")
    page = Window.partitionBy("doc_id", "page_number")
    edge = (F.col("line_no") == F.min("line_no").over(page)) | (F.col("line_no") == F.max("line_no").over(page))
    counter = F.col("line").rlike(r"(?i)^\s*(?:page|seite|slide)\s+\d{1,4}\s*(?:/\s*\d{1,4})?\s*$") | ((F.col("line_no") == F.max("line_no").over(page)) & (F.trim("line") == F.col("page_number").cast("string")))
    return rows.withColumn("counter", edge & counter).where("NOT counter").drop("counter")


def merge_short(units: DataFrame) -> DataFrame:
    """Within a page a unit that is short so far takes in the next one, if that is not long.

    Whether a unit is still short hangs on what it has taken in, so a page's units are folded in order. Units (doc_id,
    page_number, source_start, source_end, raw_content) come sorted, page after page, through one pass.
    """
    schema = "doc_id long, page_number int, source_start int, source_end int, raw_content string"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if held is not None and held[:2] == [row.doc_id, row.page_number] and len(held[4].split()) < SHORT_WORDS and len(row.raw_content.split()) < JOINED_WORDS:
                    held[3], held[4] = row.source_end, held[4] + "\n" + row.raw_content
                    continue
                if held is not None:
                    out.append(held)
                held = list(row)
            if out:
                yield pd.DataFrame(out, columns=batch.columns)
        if held is not None:
            yield pd.DataFrame([held], columns=["doc_id", "page_number", "source_start", "source_end", "raw_content"])

    columns = [F.col("doc_id").cast("long"), F.col("page_number").cast("int"), F.col("source_start").cast("int"), F.col("source_end").cast("int"), "raw_content"]
    # pages are dealt whole; a document's pages may go to different tasks
    ordered = units.select(*columns).repartition("doc_id", "page_number").sortWithinPartitions("doc_id", "page_number", "source_start")
    return ordered.mapInPandas(run, schema)


def titled(line: Column, characters: Column) -> Column:
    """The clean title that a line is, if it has two to ten words and no sign of a sentence or formula; else null. Its
    `characters` are those of its Unicode form."""
    words = F.size(F.split(F.trim(line), r"\s+"))
    return F.when(words.between(2, 10) & ~line.rlike(r"[.!?=∑√+]"), X.single_title(characters, lambda text: text))


def section_titles(lines: DataFrame, furniture: DataFrame) -> DataFrame:
    """The title of the Markdown heading above each line, carried down; and the page's topic, the first of its lines that
    are no page furniture (doc_id, key) if it reads like a title.

    Headings are cleaned like topics. One that has not just one title ends the section before it and names none. Lines are
    dealt once, by document, and meet its furniture there as one list; only documents that have any get keys, and only the
    first line of a page is read as a title.
    """
    mark = r"^#{1,6}\s+"
    marked = F.when(F.col("line").rlike(mark), F.col("line"))
    heading = F.when(marked.isNotNull(), F.struct(X.single_title(F.regexp_replace(marked, mark, "")).alias("title")))
    down = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _dealt(lines.where(F.trim("line") != "").withColumn("heading", heading)).withColumn("section_title", F.last("heading", ignorenulls=True).over(down)["title"])
    rows = rows.join(furniture.groupBy("doc_id").agg(F.collect_set("key").alias("own")), "doc_id", "left")
    furnished = F.array_contains("own", X.line_key(F.when(F.col("own").isNotNull(), _characters()), lambda text: text))
    rows = rows.withColumn("opening", ~F.coalesce(furnished, F.lit(False))).drop("own")
    page = Window.partitionBy("doc_id", "page_number")
    first = F.when(F.col("line_no") == F.min(F.when(F.col("opening"), F.col("line_no"))).over(page), F.struct("line", _characters().alias("characters")))
    rows = rows.withColumn("first", first).withColumn("title", titled(F.col("first.line"), F.col("first.characters")))
    return rows.withColumn("page_topic", F.max("title").over(page)).drop("first", "title", "opening", "heading", "form")


def unit_titles(units: DataFrame) -> DataFrame:
    """`section_title` of units (raw_content, section_title, page_topic): the unit's own first line if more lines follow
    and it reads like a title (cleaned, which may leave none), else the page's topic, else the heading above."""
    lines = F.filter(F.transform(F.split("raw_content", "\n"), F.trim), lambda line: line != "")
    first = F.get(lines, F.lit(0))
    reads = (F.size(lines) > 1) & F.size(F.split(first, r"\s+")).between(2, 10) & ~first.rlike(r"[.!?=∑√+]")
    return units.withColumn("section_title", F.when(reads, X.single_title(first)).otherwise(F.coalesce("page_topic", "section_title")))


def extraction_summary(lines: DataFrame) -> DataFrame:
    """How many pages of each document were processed, which are empty, and whether any text came out."""
    pages = lines.groupBy("doc_id", "page_number").agg(F.count_if(F.trim("line") != "").alias("n"))
    empty = F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.col("page_number"))))
    rows = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), empty.alias("empty_pages"))
    return rows.withColumn("state", F.when(F.size("empty_pages") == F.col("pages"), "no_extractable_text").otherwise("text_extracted"))


def work_batches(units: DataFrame, paged: Column) -> DataFrame:
    """Batches of work: the pages of paged sources, else groups of eight units."""
    line = Window.partitionBy("document_id").orderBy("source_start", "id")
    return units.withColumn("batch", F.when(paged, F.dense_rank().over(Window.partitionBy("document_id").orderBy("source_start")) - 1).otherwise(F.floor((F.row_number().over(line) - 1) / BATCH)).cast("int"))
