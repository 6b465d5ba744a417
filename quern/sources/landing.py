"""Landing pages: script variables, libraries and their views, and which view lists a library best.

A page is cut into tokens by one pattern, in order: headings that a list follows, ends of
lists, and links. What a link belongs to is the last heading or category before it, a
window over the tokens of its page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import urls as U

# Groups are the heading's name, the end of a list, quote, address and label of a link, label of a category without address.
TOKEN = (
    r"(?is)<h4\b[^>]*>(?=(.*?)</h4>\s*<ul\b)|(</ul>)|<a\b[^>]*?\bhref\s*=\s*([\"'])(.*?)\3[^>]*>(.*?)</a>"
    r"|<a\b[^>]*class=[\"'][^\"']*accordion-toggle[^\"']*[\"'][^>]*>(.*?)</a>"
)
CATEGORY = r"(?is)^<a\b[^>]*class=[\"'][^\"']*accordion-toggle"
LIST_PAGE = r"(?i)^(.*?)/(?:Pages|Paginas)/[^/]+\.aspx$"
SERVICE = r"(?i)/_(?:layouts|vti_bin)\b"
VARIABLE = r"\bvar\s+__([A-Za-z]+)\s*=\s*('(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|-?\d+|null|true|false)\s*;"
WEB = r"\bwebServerRelativeUrl\s*:\s*(\"(?:[^\"\\]|\\.)*\")"
# Views by their labels, best first; the others by how soon they are compared with the chosen one.
NUMBERED, DATED = r"(?i)por\s+n[uú]mero", r"(?i)data\s+de\s+disponibiliza"
EXTRA = ((r"(?i)legisla[cç][aã]o\s+complementar", 1), (r"(?i)verba|artigos?\s+do\s+civa", 2), (r"(?i)diploma", 3), (r"(?i)artigo", 4))
CODES = {"beneficios_fiscais": "EBF"}
REASONS = ("numbered view", "single list page", "date view", "first view")


def unquoted(value: Column) -> Column:
    """The text of a script's string literal; other values as they are, null for null."""
    body = F.substr(value, F.lit(2), F.length(value) - 2)
    double = F.coalesce(F.get_json_object(F.concat(F.lit("["), value, F.lit("]")), "$[0]"), body)
    return F.when(value.startswith('"'), double).when(value.startswith("'"), F.regexp_replace(body, r"\\(['\"\\])", "$1")).when(value != "null", value)


def variables(html: Column) -> Column:
    """Map of the page's script variables, the last of a name; null values are absent."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(VARIABLE), F.lit(1)).alias("k"), F.regexp_extract_all(html, F.lit(VARIABLE), F.lit(2)).alias("v"))

    def last(p: Column) -> Column:
        named = F.transform(p, lambda x: F.struct(x["k"].alias("key"), unquoted(x["v"]).alias("value")))
        newest = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["key"] == x["key"]))
        return F.map_from_entries(F.filter(newest, lambda x: x["value"].isNotNull()))

    return X.let(pairs, last)


def web_path(path: Column, root: str) -> Column:
    """The library of a list page's path, or null: it lies below ``root`` and is no service."""
    web = F.regexp_extract(path, LIST_PAGE, 1)
    return F.when(F.lower(web).startswith(root.lower() + "/") & ~web.rlike(SERVICE), web)


def links(pages: DataFrame, base: str, host: str, root: str) -> DataFrame:
    """(page_id, at, web, path, label, heading, category) of the links of ``pages``(page_id, html) to list pages, in order."""
    part = lambda n: F.regexp_extract_all("html", F.lit(TOKEN), F.lit(n))
    cut = pages.select("page_id", F.posexplode(F.arrays_zip(*(part(n).alias(f"g{n}") for n in (0, 1, 2, 4, 5, 6)))).alias("at", "t"))
    named = cut.select("page_id", "at", *(F.col(f"t.{n}").alias(c) for n, c in zip(("g0", "g1", "g2", "g4", "g5", "g6"), ("token", "heading", "ends", "href", "label", "bare"), strict=True)))
    w = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("token").rlike("(?i)^<h4")
    group = F.when(is_heading, X.html_text(F.col("heading"))).when(F.col("ends") != "", F.lit(""))
    category = F.when(F.col("token").rlike(CATEGORY), X.html_text(F.coalesce(F.nullif("label", F.lit("")), "bare")))
    before = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = named.withColumns({"group": F.last(group, ignorenulls=True).over(w), "category": F.coalesce(F.last(category, ignorenulls=True).over(before), F.lit(""))})
    url = U.resolve(F.lit(base), X.decode_entities(F.col("href")))
    found = carried.where(F.col("href") != "").withColumn("url", url).where(U.is_allowed(F.col("url"), F.lit(host)))
    placed = found.withColumn("path", U.part(F.col("url"), "PATH")).withColumn("web", web_path(F.col("path"), root)).where("web IS NOT NULL")
    return placed.select("page_id", "at", "web", "path", X.html_text(F.col("label")).alias("label"), F.coalesce("group", F.lit("")).alias("heading"), "category")


def views(found: DataFrame) -> DataFrame:
    """(page_id, key, path, label, at): each view of a library once, case ignored, where it is first."""
    first = F.min_by(F.struct("path", "label", "at"), "at").alias("v")
    return found.groupBy("page_id", F.lower("web").alias("key"), F.lower("path").alias("_p")).agg(first).select("page_id", "key", "v.*")


def extra_rank(label: Column) -> Column:
    """How soon another view is compared with the chosen one."""
    ranked = F.when(label.rlike(EXTRA[0][0]), EXTRA[0][1])
    for pattern, rank in EXTRA[1:]:
        ranked = ranked.when(label.rlike(pattern), rank)
    return ranked.otherwise(5)


def code(name: Column, web: Column) -> Column:
    """The code proposed for a library: a hint, a short upper-case heading, else the last part of its path."""
    last = F.element_at(F.split(web, "/"), -1)
    hint = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(hint, F.lower(last)), F.when(F.trim(name).rlike("^[A-Z]{2,6}$"), F.trim(name)), F.upper(last))


def libraries(pages: DataFrame, base: str, host: str, root: str) -> DataFrame:
    """One row a library of each page: page_id, code, name, category, web_path, n_views, view, view_label, reason, others.

    The view that lists it is the numbered one, else the only one, else the one by date,
    else the first; ``others`` are the labels of the rest in the order of ``extra_rank``.
    """
    found = links(pages, base, host, root)
    named = found.groupBy("page_id", F.lower("web").alias("key")).agg(F.min_by(F.struct(F.coalesce(F.nullif("heading", F.lit("")), "label").alias("name"), "category", F.col("web").alias("web_path")), "at").alias("l"))
    v = views(found)
    n = v.groupBy("page_id", "key").agg(F.count(F.lit(1)).alias("n_views"))
    rank = F.when(F.col("label").rlike(NUMBERED), 0).when(F.col("n_views") == 1, 1).when(F.col("label").rlike(DATED), 2).otherwise(3)
    ranked = v.join(n, ["page_id", "key"]).withColumn("rank", rank)
    place = F.struct("rank", "at")
    # A library's views are the links of one page to it.
    listed = F.array_sort(F.collect_list(F.struct("rank", "at", "path", "label", extra_rank(F.col("label")).alias("extra"))))
    chosen = ranked.groupBy("page_id", "key").agg(F.first("n_views").alias("n_views"), F.min_by(F.struct("rank", "path", "label"), place).alias("c"), listed.alias("all"))
    rest = F.array_sort(F.transform(F.slice("all", 2, F.size("all")), lambda x: F.struct(x["extra"].alias("extra"), x["at"].alias("at"), x["label"].alias("label"))))
    reason = F.element_at(F.array(*map(F.lit, REASONS)), F.col("c.rank") + 1)
    return chosen.join(named, ["page_id", "key"]).select(
        "page_id", code(F.col("l.name"), F.col("l.web_path")).alias("code"), "l.name", "l.category", "l.web_path", "n_views",
        F.col("c.path").alias("view"), F.col("c.label").alias("view_label"), reason.alias("reason"), F.array_join(F.transform(rest, lambda x: x["label"]), "|").alias("others"),
    )


_PLAIN = r"^[A-Za-z0-9_,:.-]*$"


def listing(pages: DataFrame, origin: str) -> DataFrame:
    """(page_id, fields, filter, search, web, url): what each page's script lists and the address that answers it; pages without a listing go."""
    encoded = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    parameter = lambda c: F.when(c.rlike(_PLAIN), c).otherwise(encoded(c))
    v = pages.select("page_id", variables(F.col("html")).alias("v"), unquoted(F.nullif(F.regexp_extract("html", WEB, 1), F.lit(""))).alias("web"))
    value = lambda k: F.try_element_at("v", F.lit(k))
    fields = F.transform(F.split(value("fieldnames"), ","), lambda x: F.trim(x))
    item = F.trim(value("itemid"))
    read = v.select(
        "page_id", "web", F.when(F.trim(value("fieldnames")) != "", F.array_join(fields, ",")).alias("fields"), F.when(item != "", item).alias("item"), F.coalesce(value("listsort"), F.lit("")).alias("sort"),
        X.decode_entities(F.coalesce(value("filtervalue"), F.lit(""))).alias("filter"), F.coalesce(value("enableSearch").try_cast("int") != 0, F.lit(False)).alias("search"), F.coalesce(value("libraries"), F.lit("")).alias("libraries"),
    ).where("fields IS NOT NULL AND web IS NOT NULL AND item RLIKE '^[0-9]+$'")
    library = F.when(~F.col("search") & (F.col("libraries") != ""), F.concat(F.lit("&library="), encoded(F.get(F.split("libraries", ","), F.lit(0))))).otherwise("")
    url = F.concat(F.lit(origin), "web", F.lit("/_vti_bin/portalat/docs.svc/listdocs?fields="), parameter(F.col("fields")), F.lit("&sort="), parameter(F.col("sort")), F.lit("&filter="), encoded(F.col("filter")), F.lit("&id="), "item", library)
    return read.select("page_id", "fields", "filter", "search", "libraries", "web", url.alias("url"))


def relation(chosen: DataFrame, other: DataFrame) -> DataFrame:
    """(page_id, relation) of ``other`` listings to the chosen one of the same page_id: same list, different list, or no listing on page."""
    o = other.select("page_id", F.struct("web", "libraries").alias("o"), F.col("search").alias("os"))
    c = chosen.select("page_id", F.struct("web", "libraries").alias("c"), F.col("search").alias("cs"))
    same = (F.col("o") == F.col("c")) & ~F.col("os") & ~F.col("cs")
    return c.join(o, "page_id", "left").select("page_id", F.when(F.col("o").isNull(), "no listing on page").when(same, "same list").otherwise("different list").alias("relation"))
