"""Listings of libraries made from the pages: scan, rejects, summary, fields; rules for documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import urls as U
from quern.operators import rules as R
from quern.plans.registry import query
from quern.sources import listings as L
from quern.sources.tables import table

FIELDS = ("DocIcon", "Numero", "Data", "Assunto", "Artigo", "Diploma")
ORIGIN = "https://www.example.com/lists/all.aspx"

#: A listing's cells of each page, in both engines: link by page_id % 8, date by % 3, one cell short in every 16th.
_LINK_SQL = """CASE page_id % 8 WHEN 1 THEN 'no link' WHEN 2 THEN '<a href=''javascript:x''>' WHEN 3 THEN '<A HREF="http://www.example.com/a/p' || page_id || '.pdf">' WHEN 4 THEN '<a href="https://other.example.com/p.pdf">'
WHEN 5 THEN '<a href="page?' || page_id || '">' WHEN 7 THEN '<a href="/docs/file-' || ((page_id // 2) % 20) || '.pdf">' ELSE '<a href="/docs/File &amp; ' || ((page_id // 2) % 20) || '.PDF">' END"""
_URL_SQL = """CASE page_id % 8 WHEN 3 THEN 'http://www.example.com/a/p' || page_id || '.pdf' WHEN 4 THEN 'https://other.example.com/p.pdf' WHEN 5 THEN 'https://www.example.com/lists/page?' || page_id
WHEN 7 THEN 'https://www.example.com/docs/file-' || ((page_id // 2) % 20) || '.pdf' ELSE 'https://www.example.com/docs/File%20&%20' || ((page_id // 2) % 20) || '.PDF' END"""
_TITLE_SQL = "regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&[a-zA-Z#0-9]*;?', '', 'g')"
ENTRIES_SQL = f"""p AS (SELECT *, 'lib' || (page_id // 50) AS library, (page_id // 50) % 2 = 1 AS short, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) AS row, {_URL_SQL} AS url2 FROM pages),
e AS (SELECT page_id, library, row, url2 AS source_url, replace(regexp_extract(url2, '[^/]+$'), '%20', ' ') AS file_name,
  CASE WHEN short THEN library ELSE 'D' || (page_id % 3) END AS diploma, (page_id % 40) || '-B' AS article, CASE WHEN page_id % 3 = 1 THEN DATE '2024-01-01' + (page_id % 28)::int END AS published_on,
  page_id || ' éA' AS number, trim(regexp_replace({_TITLE_SQL}, '\\s+', ' ', 'g')) AS subject,
  CASE WHEN page_id % 16 = 0 THEN 'unexpected shape' WHEN page_id % 8 = 1 THEN 'no PDF link' WHEN page_id % 8 = 2 THEN 'invalid PDF link'
   WHEN page_id % 8 = 3 THEN 'PDF link uses http, not https (' || url2 || ')' WHEN page_id % 8 = 4 THEN 'PDF link leaves the allowlisted host (https://other.example.com/p.pdf)'
   WHEN page_id % 8 = 5 THEN 'link is not a PDF (https://www.example.com/lists/page)' END AS reject_reason FROM p)"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    """(library, json): what fifty libraries' services would answer for the pages, fifty rows each."""
    n, kind = F.col("page_id"), F.col("page_id") % 8
    number = F.floor(n / 2) % 20
    text = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in c))
    link = (
        F.when(kind == 1, "no link").when(kind == 2, "<a href='javascript:x'>").when(kind == 3, text('<A HREF="http://www.example.com/a/p', n, '.pdf">'))
        .when(kind == 4, '<a href="https://other.example.com/p.pdf">').when(kind == 5, text('<a href="page?', n, '">'))
        .when(kind == 7, text('<a href="/docs/file-', number, '.pdf">')).otherwise(text('<a href="/docs/File &amp; ', number, '.PDF">'))
    )
    day = F.date_format(F.expr("date_add(DATE'2024-01-01', cast(page_id % 28 AS int))"), "yyyy-MM-dd")
    date = F.when(n % 3 == 1, day).when(n % 3 == 2, F.replace(day, F.lit("-"), F.lit("/"))).otherwise("")
    title = F.regexp_replace(F.regexp_extract("html", "<title>(.*?)</title>", 1), "&[a-zA-Z#0-9]*;?", "")
    cells = [link, text("<b>", n, "</b> &#233;&#x41;"), date, title, text(F.lpad((n % 40).cast("string"), 3, "0"), " -B")]
    short = F.floor(n / 50) % 2 == 1
    row = F.concat(F.array(*cells), F.when(short, F.array().cast("array<string>")).otherwise(F.array(text("D", n % 3))))
    row = F.when(n % 16 == 0, F.slice(row, 1, 3)).otherwise(row)
    rows = table(spark, d, "pages").select(text("lib", F.floor(n / 50)).alias("library"), n.alias("n"), row.alias("row"))
    whole = rows.groupBy("library").agg(F.array_sort(F.collect_list(F.struct("n", "row"))).alias("r"))  # fifty rows
    return whole.select("library", F.to_json(F.struct(F.transform("r", lambda x: x["row"]).alias("data"))).alias("json"))


def scanned(spark: SparkSession, d: str) -> DataFrame:
    found = answers(spark, d)
    number = F.substr("library", F.lit(4)).cast("long")
    fields = F.when(number % 2 == 1, F.array(*map(F.lit, FIELDS[:-1]))).otherwise(F.array(*map(F.lit, FIELDS)))
    libraries = found.select("library", F.lit(ORIGIN).alias("origin"), F.lit("www.example.com").alias("host"), F.concat("library", F.lit("-")).alias("prefix"), fields.alias("fields"))
    return L.entries(L.rows_of(found), libraries)


@query(f"""WITH {ENTRIES_SQL}, u AS (SELECT *, library || '-file-' || ((page_id // 2) % 20) AS base FROM e WHERE reject_reason IS NULL QUALIFY row_number() OVER (PARTITION BY library, source_url ORDER BY row) = 1)
SELECT library, row::int AS row, CASE WHEN count(*) OVER (PARTITION BY library, base) > 1 THEN base || '-' || sha256(file_name)[1:8] ELSE base END AS id, file_name, source_url, diploma, article, published_on::varchar AS published_on, number, subject FROM u""")
def q_listing_scan(spark: SparkSession, d: str) -> DataFrame:
    """Accepted entries of JSON listings: cells bound by field, URLs resolved, ids by file name."""
    return L.distinct_entries(scanned(spark, d)).select("library", "row", "id", "file_name", "source_url", "diploma", "article", F.col("published_on").cast("string").alias("published_on"), "number", "subject")


@query(f"WITH {ENTRIES_SQL} SELECT library, row::int AS row, reject_reason FROM e WHERE reject_reason IS NOT NULL")
def q_listing_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Rejected rows of the listings, with all six reasons."""
    return scanned(spark, d).where("reject_reason IS NOT NULL").select("library", "row", "reject_reason")


@query(f"""WITH {ENTRIES_SQL},
v AS (SELECT library, reject_reason IS NULL AS ok, reject_reason, source_url, CASE WHEN reject_reason = 'unexpected shape' THEN NULL ELSE published_on END AS published_on,
  CASE WHEN reject_reason = 'unexpected shape' THEN '' ELSE number END AS number, CASE WHEN reject_reason = 'unexpected shape' THEN '' ELSE article END AS article, CASE WHEN reject_reason = 'unexpected shape' AND diploma LIKE 'D%' THEN '' ELSE diploma END AS diploma FROM e),
h AS (SELECT library, string_agg(diploma || ':' || n, ',' ORDER BY diploma) AS diplomas FROM (SELECT library, diploma, count(*) AS n FROM v GROUP BY ALL) GROUP BY library),
f AS (SELECT library, string_agg('/docs/:' || n, ',') AS folders FROM (SELECT library, count(*) AS n FROM v WHERE ok GROUP BY ALL) GROUP BY library)
SELECT library, count(*)::bigint AS entries, count(*) FILTER (ok)::bigint AS with_pdf, count(DISTINCT CASE WHEN ok THEN lower(source_url) END)::bigint AS distinct_pdfs, count(*) FILTER (reject_reason = 'no PDF link')::bigint AS no_link,
count(*) FILTER (NOT ok AND reject_reason <> 'no PDF link')::bigint AS rejected, min(published_on)::varchar AS first_date, max(published_on)::varchar AS last_date, count(*) FILTER (published_on IS NULL)::bigint AS undated,
count(*) FILTER (number = '')::bigint AS empty_numbers, count(DISTINCT article)::bigint AS distinct_articles, any_value(diplomas) AS diplomas, any_value(folders) AS folders FROM v JOIN h USING (library) LEFT JOIN f USING (library) GROUP BY library""")
def q_listing_totals(spark: SparkSession, d: str) -> DataFrame:
    """Each library's totals with the numbers of its diplomas and folders."""
    shown = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["k"], x["n"].cast("string"))), ",")).alias(c)
    s = L.summary(scanned(spark, d))
    return s.select(*(F.col(c).cast("string").alias(c) if c.endswith("_date") else shown(c) if c in ("diplomas", "folders") else F.col(c) for c in s.columns))


@query(f"""WITH {ENTRIES_SQL} SELECT lower(file_name) AS name, string_agg(DISTINCT library, ',' ORDER BY library) AS libraries FROM e WHERE reject_reason IS NULL GROUP BY 1 HAVING count(DISTINCT library) > 1""")
def q_listing_across(spark: SparkSession, d: str) -> DataFrame:
    """Files that several libraries list."""
    return L.across_libraries(scanned(spark, d)).select("name", F.array_join("libraries", ",").alias("libraries"))


@query(f"""WITH {ENTRIES_SQL}, v AS (SELECT library, reject_reason = 'unexpected shape' AS bad, published_on, subject FROM e)
SELECT library, 'number' AS field, count(*) FILTER (bad IS NOT TRUE)::bigint AS n FROM v GROUP BY library
UNION ALL SELECT library, 'published_on', count(*) FILTER (bad IS NOT TRUE AND published_on IS NOT NULL) FROM v GROUP BY library
UNION ALL SELECT library, 'subject', count(*) FILTER (bad IS NOT TRUE AND subject <> '') FROM v GROUP BY library""")
def q_listing_fill(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each library with a value in a field."""
    return L.fill(scanned(spark, d), "number", "published_on", "subject")


_FIELDS_SQL = "list_concat(['DocIcon'], list_concat(w[1:3], list_transform(w[3:6], lambda x: trim(split_part(replace(x, ',', ''), ':', 1)))))"


@query(f"""WITH t AS (SELECT page_id, string_split(regexp_extract(html, '<title>(.*?)</title>', 1), ' ') AS w FROM pages), f AS (SELECT page_id, list_filter({_FIELDS_SQL}, lambda x: regexp_full_match(x, '[A-Za-z0-9_]+')) AS f FROM t)
SELECT page_id, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ',') AS fields FROM f""")
def q_union_fields(spark: SparkSession, d: str) -> DataFrame:
    """Safe field names once each: the link's, then three words of a page's title, then a sort order of words."""
    w = F.split(F.regexp_extract("html", "<title>(.*?)</title>", 1), " ")
    order = F.array_join(F.transform(F.slice(w, 3, 4), lambda x: F.concat(F.replace(x, F.lit(",")), F.lit(":asc "))), ", ")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("library"), F.slice(w, 1, 3).alias("field_names"), order.alias("list_sort"))
    return L.union_fields(pages).select(F.col("library").alias("page_id"), F.array_join("fields", ",").alias("fields"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN h LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || h
ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(.*/)[^/]*$', 1) || h END AS resolved
FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN '/a/' || page_id || '.pdf' WHEN 1 THEN 'b-' || page_id || '.pdf?x=1' ELSE 'https://o.example.com/' || page_id END AS h FROM pages)""")
def q_url_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Links of three forms seen from every page's URL."""
    n = F.col("page_id").cast("string")
    href = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/a/"), n, F.lit(".pdf"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("b-"), n, F.lit(".pdf?x=1"))).otherwise(F.concat(F.lit("https://o.example.com/"), n))
    return table(spark, d, "pages").select("page_id", U.resolve(F.col("url"), href).alias("resolved"))


@query("SELECT doc_id, md5(replace(replace(text, 'e', 'é'), 'o', '😀')) AS body FROM documents")
def q_decode_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every text with letters written as numeric and hexadecimal references, decoded."""
    coded = F.replace(F.replace("text", F.lit("e"), F.lit("&#233;")), F.lit("o"), F.lit("&#x1F600;"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.decode_entities(coded)).alias("body"))


@query("""SELECT doc_id, trim(lower(lang)) AS q, source AS tax, CASE WHEN source IS NOT NULL THEN (doc_id % 90)::varchar END AS article, CASE WHEN doc_id % 3 > 0 THEN (1990 + doc_id % 40)::varchar END AS year FROM documents WHERE doc_id % 5 > 0
UNION ALL SELECT doc_id, trim(lower(lang)), NULL, NULL, CASE WHEN doc_id % 3 > 0 THEN (1990 + doc_id % 40)::varchar END FROM documents WHERE doc_id % 5 = 0""")
def q_search_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of a search URL made of each document: no article without a tax, no year that is none."""
    n = F.col("doc_id")
    tax = F.when(n % 5 > 0, F.concat(F.lit("&tax="), F.url_encode("source"))).otherwise("&tax=%20")
    year = F.when(n % 3 > 0, (1990 + n % 40).cast("string")).otherwise(F.lit("19x0"))
    url = F.concat(F.lit("https://h.example.com/s?q=+"), F.url_encode(F.lower("lang")), F.lit("%20"), F.coalesce(tax, F.lit("")), F.lit("&article="), (n % 90).cast("string"), F.lit("&year="), year)
    return table(spark, d, "documents").select("doc_id", U.search_parameters(url).alias("p")).select("doc_id", "p.*")


_RULES_SQL = """d AS (SELECT doc_id, text, doc_id % 4 AS k FROM documents), w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]'))) AS n FROM d),
l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM d)"""


@query(f"""WITH {_RULES_SQL}
SELECT doc_id, 'banned character' AS rule, (i + 4)::int AS "at" FROM l, unnest(range(1, len(l) + 1)) AS t(i) WHERE contains(l[i], '|')
UNION ALL SELECT doc_id, 'too many words', 0 FROM w JOIN d USING (doc_id) WHERE n + 3 + CASE k WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE 1 END > 400
UNION ALL SELECT doc_id, 'no image', 0 FROM d WHERE k = 3 UNION ALL SELECT doc_id, 'remote image', 0 FROM d WHERE k = 1 UNION ALL SELECT doc_id, 'image outside', 0 FROM d WHERE k = 2
UNION ALL SELECT doc_id, 'empty owner', 0 FROM d UNION ALL SELECT doc_id, 'no date', 0 FROM d""")
def q_document_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every text with a front matter and an image of some kind: the rules that it breaks."""
    k = F.col("doc_id") % 4
    image = F.when(k == 0, "\n![a](img/x.png)").when(k == 1, "\n![a](https://x.example/y.png)").when(k == 2, '\n<img alt="a" src="../a.svg">').otherwise("")
    text = F.concat(F.lit("---\nstate: open\nowner: ''\n---\n"), "text", image)
    return R.violations(table(spark, d, "documents").select("doc_id", text.alias("text")), "|", 400, ("state", "owner", "date"))
