"""Landing pages written into the pages' markup, with the rows that must be found again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.sources import landing as N
from quern.sources.tables import table

ORIGIN, ROOT, HOST = "https://h.example", "/pt/root", "h.example"
BASE = f"{ORIGIN}{ROOT}/Pages/home.aspx"

#: A page's landing part: three libraries (numbered, single or dated views by page_id % 3; one outside a group; one of two views), links that are none, script variables.
_TEMPLATE = (
    '<a class="accordion-toggle" href="#c">Direct &amp; more</a><h4>No list</h4><p>x</p><h4 id="l">Lib <b>@</b></h4> <ul class="v">~</ul>'
    '<a class="x accordion-toggle">Other</a><a href="/pt/root/beneficios_fiscais/Paginas/a.aspx">Benefits</a><a href="/pt/root/_layouts/x/Pages/a.aspx">no</a>'
    '<a href="http://h.example/pt/root/z/Pages/a.aspx">no</a><a href="/pt/rooted/z/Pages/a.aspx">no</a><h4>IVA</h4><ul><li><a href="../civa/Pages/d%.aspx">Por diploma</a>'
    "<li><a href='/pt/root/CIVA/Pages/e%.aspx'>Verba</a><li><a href=\"/pt/root/civa/pages/D%.ASPX\">again</a></ul>"
    "<script>var __fieldnames = 'A, B@';var __itemid = '7'; var __itemid = @;var __filtervalue = \"<q a=\\\"1\\\">\";var __enableSearch = $;var __libraries = 'L 1,L2';"
    'var __listsort = null; x = {webServerRelativeUrl : "\\/pt\\/root\\/lib@"}</script>'
)
_VIEWS = (
    '<li><a href="/pt/root/lib%/Pages/data.aspx">Data de Disponibilização</a></li><li><a href="/pt/root/lib%/Pages/Vinc.aspx">Visualização por número</a></li>',
    '<li><a href="/pt/root/lib%/Pages/only.aspx"><i>All</i> of it</a></li>',
    '<li><a href="/pt/root/lib%/Pages/a.aspx">Por artigo</a></li><li><a href="/pt/root/lib%/Pages/data.aspx?v=2">Por data de disponibilização</a></li>',
)


def _landing(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    small = (F.col("page_id") % 5).cast("string")
    kinds = F.element_at(F.array(*map(F.lit, _VIEWS)), (F.col("page_id") % 3 + 1).cast("int"))
    made = F.replace(F.replace(F.lit(_TEMPLATE), F.lit("~"), kinds), F.lit("@"), n)
    made = F.replace(F.replace(made, F.lit("%"), small), F.lit("$"), F.when(F.col("page_id") % 4 == 0, "1").otherwise("0"))
    return table(spark, d, "pages").select("page_id", F.concat(F.replace(F.coalesce("html", F.lit("")), F.lit("</body>"), F.lit("")), made).alias("html"))


@query("""WITH p AS (SELECT page_id, page_id % 3 AS k, page_id % 5 AS s FROM pages)
SELECT page_id, 'LIB' || s AS code, 'Lib ' || page_id AS name, 'Direct & more' AS category, '/pt/root/lib' || s AS web_path, CASE k WHEN 1 THEN 1 ELSE 2 END::bigint AS n_views,
'/pt/root/lib' || s || '/Pages/' || CASE k WHEN 0 THEN 'Vinc' WHEN 1 THEN 'only' ELSE 'data' END || '.aspx' AS view, CASE k WHEN 0 THEN 'Visualização por número' WHEN 1 THEN 'All of it' ELSE 'Por data de disponibilização' END AS view_label,
CASE k WHEN 0 THEN 'numbered view' WHEN 1 THEN 'single list page' ELSE 'date view' END AS reason, CASE k WHEN 0 THEN 'Data de Disponibilização' WHEN 1 THEN '' ELSE 'Por artigo' END AS others FROM p
UNION ALL SELECT page_id, 'EBF', 'Benefits', 'Other', '/pt/root/beneficios_fiscais', 1, '/pt/root/beneficios_fiscais/Paginas/a.aspx', 'Benefits', 'single list page', '' FROM p
UNION ALL SELECT page_id, 'IVA', 'IVA', 'Other', '/pt/root/civa', 2, '/pt/root/civa/Pages/d' || s || '.aspx', 'Por diploma', 'first view', 'Verba' FROM p""")
def q_landing_views(spark: SparkSession, d: str) -> DataFrame:
    """Libraries of every page, and the view that lists each."""
    return N.libraries(_landing(spark, d), BASE, HOST, ROOT)


@query("""WITH p AS (SELECT page_id, page_id % 4 = 0 AS search FROM pages), u AS (SELECT *, 'https://h.example/pt/root/lib' || page_id || '/_vti_bin/portalat/docs.svc/listdocs?fields=A,B' || page_id || '&sort=&filter=%3Cq%20a%3D%221%22%3E&id=' || page_id || CASE WHEN search THEN '' ELSE '&library=L%201' END AS url FROM p)
SELECT a.page_id, 'A,B' || a.page_id AS fields, '<q a="1">' AS filter, a.search, '/pt/root/lib' || a.page_id AS web, a.url,
CASE WHEN b.page_id IS NULL OR b.page_id % 3 = 1 THEN 'no listing on page' WHEN a.search OR b.search THEN 'different list' ELSE 'same list' END AS relation FROM u a LEFT JOIN u b ON b.page_id = a.page_id""")
def q_landing_listing(spark: SparkSession, d: str) -> DataFrame:
    """What the script of every page lists, and how the listing of its other view relates to it (a third of the pages have none)."""
    found = N.listing(_landing(spark, d), ORIGIN)
    other = found.where("page_id % 3 <> 1")
    return found.join(N.relation(found, other), "page_id").select("page_id", "fields", "filter", "search", "web", "url", "relation")
