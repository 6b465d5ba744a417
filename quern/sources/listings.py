"""JSON listings of document libraries: one row of the table is one library's answer.

An answer is an object with a ``data`` array of rows, each an array with a cell for every
requested field. Cells are bound to names by the library's field list, so libraries with
other fields are one table. Every row is kept, with the reason to reject it or null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import urls as U

_HREF = r"""(?i)href\s*=\s*['"]([^'"]+)['"]"""


@dataclass(frozen=True)
class Columns:
    """Field names of what an entry holds; ``article`` has candidates, the first with a value counts."""

    link: str = "DocIcon"
    number: str = "Numero"
    published: str = "Data"
    subject: str = "Assunto"
    article: tuple[str, ...] = ("Artigo",)
    diploma: str = "Diploma"
    paragraph: str = "Paragrafo"


class ListingError(ValueError):
    """An answer has no data array."""


def rows_of(answers: DataFrame) -> DataFrame:
    """(library, row, cells): each row of the data array of ``answers``(library, json), cells as strings or null.

    A cell that is no string is empty. An answer without a data array is an error, not an
    empty listing; rows that are no arrays have null cells.
    """
    data = answers.select("library", F.try_variant_get(F.try_parse_json("json"), "$.data", "array<variant>").alias("data"))
    if not data.where("data IS NULL").isEmpty():
        raise ListingError("a listing has no data array")
    row = data.select("library", F.posexplode("data").alias("at", "v"))
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    cells = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda v: F.coalesce(text(v), F.lit("")))
    return row.select("library", (F.col("at") + 1).cast("int").alias("row"), cells.alias("cells"))


def entries(rows: DataFrame, libraries: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """``rows`` as entries with ``reject_reason``.

    ``libraries``: (library, origin, host, prefix, fields array); a row a library, joined to
    all rows. A library without a diploma field gives its own code as diploma.
    """
    bound = rows.join(libraries, "library")
    fits = F.col("cells").isNotNull() & (F.size("cells") == F.size("fields"))
    named = bound.withColumn("v", F.when(fits, F.map_from_arrays("fields", "cells")))
    cell = lambda name: F.coalesce(F.try_element_at("v", F.lit(name)), F.lit(""))
    # Each cell is read once; what is made of them are columns of their own.
    shown = {"number": columns.number, "subject": columns.subject, "paragraph": columns.paragraph, "stated_diploma": columns.diploma, "date": columns.published}
    read = named.withColumns({k: X.html_text(cell(c)) for k, c in shown.items()} | {"articles": F.transform(F.array(*map(cell, columns.article)), X.html_text), "href": F.trim(X.decode_entities(F.regexp_extract(cell(columns.link), _HREF, 1)))})
    linked = read.withColumn("source_url", U.resolve(F.col("origin"), F.col("href")))
    url = F.col("source_url")
    checked = linked.withColumns({"outside": U.verdict(url, F.col("host")), "shown_url": U.describe(url), "file_name": U.decode_percent(U.file_name(url))})
    reason = (
        F.when(F.col("v").isNull(), "unexpected shape")
        .when(F.col("href") == "", "no PDF link")
        .when(url.isNull(), "invalid PDF link")
        .when(F.col("outside").isNotNull(), F.concat(F.lit("PDF link "), "outside", F.lit(" ("), "shown_url", F.lit(")")))
        .when(~F.lower(U.part(url, "PATH")).endswith(".pdf"), F.concat(F.lit("link is not a PDF ("), "shown_url", F.lit(")")))
    )
    article = F.coalesce(F.get(F.filter("articles", lambda a: a != ""), F.lit(0)), F.lit(""))
    return checked.select(
        "library",
        "row",
        F.concat("prefix", X.file_id(F.col("file_name"))).alias("id"),
        "file_name",
        "source_url",
        F.when(F.array_contains("fields", columns.diploma), F.col("stated_diploma")).otherwise(F.col("library")).alias("diploma"),
        X.normalize_article(article).alias("article"),
        "paragraph",
        F.when(F.col("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(F.col("date"), F.lit("yyyy-MM-dd"))).cast("date").alias("published_on"),
        "number",
        "subject",
        reason.alias("reject_reason"),
    )


def distinct_entries(found: DataFrame) -> DataFrame:
    """Accepted entries, one a library and URL (the first); ids that clash in a library all get a hash of the file name."""
    first = found.where("reject_reason IS NULL").groupBy("library", "source_url").agg(F.min_by(F.struct(*(c for c in found.columns if c not in ("library", "source_url"))), "row").alias("e")).select("library", "source_url", "e.*")
    clash = first.groupBy("library", "id").agg((F.count(F.lit(1)) > 1).alias("clash"))
    tail = F.substr(F.sha2(F.col("file_name"), 256), F.lit(1), F.lit(8))
    named: Column = F.when(F.col("clash"), F.concat("id", F.lit("-"), tail)).otherwise(F.col("id"))
    return first.join(clash, ["library", "id"]).withColumn("id", named).drop("clash").select(*found.columns)


def summary(found: DataFrame) -> DataFrame:
    """Of each library: entries, those with a document, distinct ones, rejected and unlinked rows, dates and the numbers of values."""
    ok = F.col("reject_reason").isNull()
    dated = F.col("published_on").isNotNull()
    totals = found.groupBy("library").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(ok).alias("with_pdf"),
        F.countDistinct(F.when(ok, F.lower("source_url"))).alias("distinct_pdfs"),
        F.count_if(F.col("reject_reason") == "no PDF link").alias("no_link"),
        F.count_if(~ok & (F.col("reject_reason") != "no PDF link")).alias("rejected"),
        F.min("published_on").alias("first_date"),
        F.max("published_on").alias("last_date"),
        F.count_if(~dated).alias("undated"),
        F.count_if(F.col("number") == "").alias("empty_numbers"),
        F.countDistinct("article").alias("distinct_articles"),
    )

    def histogram(name: str, key: Column, of: DataFrame) -> DataFrame:
        """Counted before it is gathered: a row for each value, of which a library has few."""
        counts = of.groupBy("library", key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("library").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias(name))

    folders = histogram("folders", U.folder(F.col("source_url")), found.where(ok))
    return totals.join(histogram("diplomas", F.col("diploma"), found), "library", "left").join(folders, "library", "left")


def across_libraries(found: DataFrame) -> DataFrame:
    """(name, libraries): files that more than one library lists."""
    owners = found.where("reject_reason IS NULL").select(U.file_key(F.col("source_url")).alias("name"), "library").distinct()
    return owners.groupBy("name").agg(F.sort_array(F.collect_list("library")).alias("libraries")).where(F.size("libraries") > 1)


def fill(found: DataFrame, *fields: str) -> DataFrame:
    """(library, field, n): rows with a value in each field."""
    counts = found.groupBy("library").agg(*(F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c) for c in fields))
    return counts.unpivot("library", list(fields), "field", "n")


def union_fields(pages: DataFrame) -> DataFrame:
    """(library, fields) for pages(library, field_names array, list_sort): link first, then each safe name once, in order."""
    sort = F.transform(F.split(F.coalesce("list_sort", F.lit("")), ","), lambda p: F.trim(F.split_part(p, F.lit(":"), F.lit(1))))
    names = F.concat(F.array(F.lit("DocIcon")), F.coalesce("field_names", F.array().cast("array<string>")), sort)
    return pages.select("library", F.array_distinct(F.filter(names, lambda n: n.rlike("^[A-Za-z0-9_]+$"))).alias("fields"))
