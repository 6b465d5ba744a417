"""Text functions as Column expressions: terms, folding, body cleaning, headings, sentences."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of a query or passage: letters, numbers and combining marks.
WORD = r"[\p{L}\p{N}\p{M}]+"
MAX_TERMS = 32

# Function words that a query drops (folded forms).
STOP_WORDS = (
    "a ao aos as com como da das de do dos e ela elas ele eles em entre essa esse esta este eu foi ha isso isto ja lhe mais mas me "
    "meu meus minha minhas na nas nao nem no nos num numa o os ou para pela pelas pelo pelos pode por posso qual quais quando que se "
    "ser seu seus sua suas sao sem sobre tem ter um uma uns umas eh devo deve sim tambem so"
).split()

# Heading grammar on folded (upper-case, mark-free) lines.
_NUMBERING = r"^(?:[IVX]{1,4}|[0-9]{1,2})?\s*[.)\-–]?\s*"
HEADINGS = (
    ("request", _NUMBERING + r"(?:O\s+|DO\s+)?PEDIDO\s*:?$"),
    ("facts", _NUMBERING + r"(?:(?:DESCRICAO|RESUMO)\s+)?(?:D?OS\s+)?FACTOS(?:\s+[A-Z ,-]{0,60})?\s*:?$"),
    ("conclusion", _NUMBERING + r"CONCLUS(?:AO|OES)\s*:?$"),
    (
        "legal-framework",
        _NUMBERING
        + r"(?:N?INFORMACAO|PARECER|PONTO\s+PREVIO|FUNDAMENTACAO|APRECIACAO"
        + r"|ENQUADRAMENTO(?:\s+(?:JURIDICO-TRIBUTARIO|JURIDICO|LEGAL|FISCAL|TRIBUTARIO))?|ANALISE(?:\s+[A-Z ]{0,50})?)\s*:?$",
    ),
)

# How a body states its process number (1) and that it was decided (2), and the date of the decision.
PROCESS_NUMBER = r"(?i)Processo[ \t]*(?:n\.?[ \t]*[º°o]\.?)?[ \t]*:?[ \t]*([0-9][^\n,;]{0,40}?)[ \t]*(?:(,?\s*(?:com\s+despacho|sancionad))|(?=[,;\n]|$))"
PAGE_NUMBER = r"[ \t]{2,}[0-9]{1,3}$"
DECISION = r"(?i)despacho[^;]{0,150}?\bde\s+([0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})"
DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "yyyy/MM/dd", "dd/MM/yyyy", "dd.MM.yyyy")

# Lines repeated on every page, and the pattern of process-number headers.
BANNERS = ("INFORMACAO VINCULATIVA", "FICHA DOUTRINARIA", "DIRECCAO GERAL DOS IMPOSTOS")
LETTERHEAD = "MINISTERIO DAS FINANCAS"
#: First letters of such lines, folded or not: few other lines are folded at all.
BANNER_START = "^[IÍiíFfDdMm]"
PAGE_PROCESS = r"^[0-9]*\s*Processo:\s*[\p{L}\p{N}_./-]+(?:\s+[0-9]{1,3})?$"


# The three forms of image references.
MARKDOWN_IMAGE = r"!\[[^\]]*\]\(\s*(<[^>]+>|[^)\s]+)(?:\s+\"[^\"]*\")?\s*\)"
HTML_IMAGE = r"(?i)<img\b[^>]*?\bsrc\s*=\s*[\"']([^\"']+)[\"']"
IMAGE_LINK = r"(?im)^\s*\[[^\]]+\]:\s*<?(\S+?\.(?:png|jpe?g|gif|svg|webp))>?(?:\s|$)"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


_BEYOND_ASCII = r"[^\x00-\x7F]"
_HANGUL = "[\uac00-\ud7a3]"


def normalized(c: Column, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD of a text, for short ones such as questions and names; null stays null. An Arrow function: no built-in composes."""
    return F.pandas_udf(lambda texts: texts.str.normalize(form), "string")(c)


@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """What ``translate`` wants (letters with marks and then marks, the plain letters), and what gives several letters (no Hangul)."""
    marks = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Mn")
    marked = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if (d := unicodedata.decomposition(c)) and not d.startswith("<")]
    bare = {c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn") for c in marked}
    one = {c: b for c, b in bare.items() if len(b) == 1 and c != b}
    return "".join(one) + marks, "".join(one.values()), {c: b for c, b in bare.items() if len(b) > 1}


def _jamo(c: Column) -> Column:
    """Hangul syllables as the letters that they are made of."""
    char = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def parts(x: Column) -> Column:
        k = F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 10).cast("long") - 0xAC00
        tail = F.when(k % 28 > 0, char(0x11A7 + k % 28)).otherwise("")
        return F.when(x.rlike(_HANGUL), F.concat(char(0x1100 + F.floor(k / 588).cast("long")), char(0x1161 + F.floor(k % 588 / 28).cast("long")), tail)).otherwise(x)

    return F.when(c.rlike(_HANGUL), F.array_join(F.transform(F.split(c, ""), parts), "")).otherwise(c)


def _unmarked(c: Column) -> Column:
    """Decomposed text without non-spacing marks."""
    marked, plain, several = _plain_letters()
    whole = c
    for x, parts in several.items():
        whole = F.replace(whole, F.lit(x), F.lit(parts))
    whole = F.when(c.rlike("[" + "".join(several) + "]"), whole).otherwise(c)
    # One range is found far faster than a class of many letters: texts without any of its letters are translated alone.
    beyond = c.rlike(f"[{min(min(several), chr(0xAC00))}-\U0010FFFF]")
    return F.translate(F.when(beyond, let(whole, _jamo)).otherwise(c), marked, plain)


def fold(c: Column) -> Column:
    """Lower case without non-spacing marks, whether a letter and its marks are one code point or several.

    Letters are lowered one by one, so a capital sigma at the end of a word is a plain one.
    """
    return F.when(c.rlike(_BEYOND_ASCII), F.lower(F.replace(_unmarked(c), F.lit("Σ"), F.lit("σ")))).otherwise(F.lower(c))


def fold_upper(c: Column) -> Column:
    """Upper case without non-spacing marks, for comparisons."""
    return F.when(c.rlike(_BEYOND_ASCII), F.upper(_unmarked(c))).otherwise(F.upper(c))


def words(c: Column) -> Column:
    """Lower-case words in order, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def query_terms(c: Column) -> Column:
    """Distinct words of the composed text in order, without stop words unless nothing else is left, at most MAX_TERMS."""
    distinct = F.array_distinct(words(normalized(c, "NFC")))
    content = F.filter(distinct, lambda w: ~F.array_contains(F.array(*map(F.lit, STOP_WORDS)), fold(w)))
    return F.slice(F.when(F.size(content) > 0, content).otherwise(distinct), 1, MAX_TERMS)


def match_expression(terms: Column) -> Column:
    """Every term quoted, joined by OR; null without terms."""
    quoted = F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(terms) > 0, F.array_join(quoted, " OR "))


def is_furniture(line: Column) -> Column:
    repeated = lambda t: t.isin(*BANNERS) | t.startswith(LETTERHEAD)
    return let(line, lambda x: F.contains(x, F.lit("Processo:")) & x.rlike(PAGE_PROCESS) | F.when(x.rlike(BANNER_START), let(fold_upper(x), repeated)).otherwise(False))


#: White space of lines and fields, the no-break space too.
_BLANKS = " \t\n\x0b\f\r\u00a0"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def normalize_body(c: Column) -> Column:
    """Trimmed lines without blanks and page furniture."""
    lines = F.transform(F.split(c, "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~is_furniture(x)), "\n")


def heading(line: Column) -> Column:
    """The section a line opens, or null."""
    kinds = lambda t: F.coalesce(*(F.when(t.rlike(p), F.lit(name)) for name, p in HEADINGS))
    # Few lines are short and begin with a capital; only those are folded.
    return let(strip(line), lambda t: F.when(F.length(t).between(4, 80) & t.rlike(r"^\P{L}*\p{Lu}"), let(fold_upper(t), kinds)))


def sentences(c: Column) -> Column:
    """Parts between . ; : ! ? and the white space after them."""
    return F.split(c, r"(?<=[.;:!?])\s+")


def letters_and_digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))


def clean_extracted(c: Column) -> Column:
    """Line ends as LF, soft hyphens as hyphens, other white space and NUL as spaces, line ends trimmed."""
    lf = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")
    plain = F.regexp_replace(F.regexp_replace(lf, "­", "-"), r"[\x00\t\x0B\x0C\u0085   -     　]", " ")
    return F.regexp_replace(plain, r"(?m) +$", "")


def process_number(c: Column) -> Column:
    """The number of the first decided process, else of the first one; null if there is none."""
    decided = F.transform(F.regexp_extract_all(c, F.lit(PROCESS_NUMBER), F.lit(2)), lambda d: d != "")
    bare = F.transform(F.regexp_extract_all(c, F.lit(PROCESS_NUMBER), F.lit(1)), lambda n: F.regexp_replace(n, PAGE_NUMBER, ""))
    clean = F.transform(bare, lambda n: F.regexp_replace(strip(F.regexp_replace(n, r"\s+", " ")), r"[.,;]+$", ""))
    # Decided ones first, each kind in the order of the text.
    order = F.transform(clean, lambda n, i: F.struct((~F.get(decided, i)).alias("open"), i.alias("at"), n.alias("number")))
    named = F.filter(order, lambda x: x["number"] != "")
    return F.when(F.size(named) > 0, F.array_min(named)["number"])


def decision_date(c: Column) -> Column:
    """The first date after "despacho ... de" in one of five formats; null if malformed."""
    stated = F.regexp_extract(c, DECISION, 1)
    return F.coalesce(*(F.try_to_timestamp(stated, F.lit(f)).cast("date") for f in DATE_FORMATS))


#: Named character references that listings use.
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def decode_entities(c: Column) -> Column:
    """Numeric and hexadecimal references of valid code points, and the named ones of ENTITIES; others stay as they are."""
    number = lambda m: F.when(m.rlike("^[xX]"), F.conv(F.substr(m, F.lit(2)), 16, 10)).otherwise(m).try_cast("long")
    char = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    valid = lambda code: F.coalesce(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.lit(False))
    # The digits of each part that begins with a reference, then their code point, then its character.
    parts = F.transform(F.split(c, "(?=&#)"), lambda p: F.struct(p.alias("p"), F.regexp_extract(p, "^&#([0-9]{1,9}|[xX][0-9a-fA-F]{1,8});", 1).alias("m")))
    codes = F.transform(parts, lambda x: F.struct(x["p"].alias("p"), number(x["m"]).alias("code")))
    made = F.transform(codes, lambda x: F.when(valid(x["code"]), F.concat(char(x["code"]), F.regexp_replace(x["p"], "^&#[^;]*;", ""))).otherwise(x["p"]))
    named = F.when(F.contains(c, F.lit("&#")), F.array_join(made, "")).otherwise(c)
    for name, plain in ENTITIES:
        named = F.replace(named, F.lit(name), F.lit(plain))
    return named


def html_text(c: Column) -> Column:
    """A cell's text: tags to spaces, references decoded, white space collapsed."""
    bare = decode_entities(F.regexp_replace(c, "<[^>]*>", " "))
    return F.trim(F.regexp_replace(bare, r"[ \u00a0\t\n\r\f]+", " "))


def normalize_article(c: Column) -> Column:
    """Leading zeros dropped from a numbered article, and blanks around what follows the number."""

    def numbered(v: Column) -> Column:
        part = lambda n: F.regexp_extract(v, "^0*([0-9]+)(.*)$", n)
        return F.when(v.rlike("^[0-9]"), F.concat(part(1), strip(part(2)))).otherwise(v)

    return let(c, numbered)


def article_number(c: Column) -> Column:
    """Leading digits (up to eight) as a number; the largest int without them."""
    return F.coalesce(F.regexp_extract(c, r"^([0-9]{1,8})(?![0-9])", 1).try_cast("int"), F.lit(2147483647))


def article_label(c: Column) -> Column:
    """78-D as 78.º-D; other values as they are."""
    return F.when(c.rlike(r"^[0-9]+(-[A-Za-z]+)*$"), F.regexp_replace(c, "^([0-9]+)", "$1.º")).otherwise(c)


def count_words(c: Column) -> Column:
    """Parts between white space that hold a letter or digit."""
    return F.size(F.filter(F.split(c, r"[ \t\n\r\f]+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def image_references(c: Column) -> Column:
    """Targets of Markdown images, of HTML images, and of reference-style links to image files, in this order."""
    markdown = F.regexp_extract_all(c, F.lit(MARKDOWN_IMAGE), F.lit(1))
    tags = F.regexp_extract_all(c, F.lit(HTML_IMAGE), F.lit(1))
    links = F.regexp_extract_all(c, F.lit(IMAGE_LINK), F.lit(1))
    return F.concat(F.transform(markdown, lambda x: F.regexp_replace(x, "^<|>$", "")), tags, links)


def front_matter(c: Column) -> Column:
    """Map of key to value of the block between lines of three dashes at the top; null without one."""
    block = F.regexp_extract(c, r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    line = F.filter(F.split(block, "\n"), lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_]*:"))
    value = lambda x: strip(F.regexp_replace(strip(F.regexp_replace(x, "^[^:]*:", "")), "^([\"'])(.*)\\1$", "$2"))
    # A later line of a key replaces an earlier one.
    pairs = F.transform(line, lambda x: F.struct(F.regexp_extract(x, "^([^:]*):", 1).alias("key"), value(x).alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.when(c.rlike(r"(?s)^---\n.*?\n---(\n|$)"), F.map_from_entries(last))


def filter_summary(*labels: Column, default: str = "none") -> Column:
    """Labels that are not empty, joined by a middle dot; ``default`` without any."""
    shown = F.array_join(F.filter(F.array(*labels), lambda x: F.coalesce(x, F.lit("")) != ""), " · ")
    return F.when(shown == "", F.lit(default)).otherwise(shown)


def file_id(name: Column) -> Column:
    """Id of a remote file name: plain lower-case letters, digits, _ and -; long or empty ones get a hash.

    Ligatures, circled digits and the like count as what they stand for.
    """
    stem = F.lower(F.regexp_replace(normalized(F.regexp_replace(name, r"(?i)\.pdf$", ""), "NFKD"), r"\p{Mn}+", ""))
    safe = F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9_]", "-"), "-{2,}", "-")
    trimmed = F.regexp_replace(safe, "^[-_]+|[-_]+$", "")
    short = F.substr(F.sha2(name, 256), F.lit(1), F.lit(8))
    cut = F.concat(F.regexp_replace(F.substr(trimmed, F.lit(1), F.lit(100)), "[-_]+$", ""), F.lit("-"), short)
    made = F.when(F.length(trimmed) > 100, cut).when(trimmed == "", F.concat(F.lit("ruling-"), short)).otherwise(trimmed)
    return F.when(made.rlike("^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"), F.concat(made, F.lit("_"))).otherwise(made)


def is_valid_id(c: Column) -> Column:
    return F.length(c).between(1, 128) & c.rlike("^[a-z0-9_-]+$") & ~c.rlike("^(con|prn|aux|nul|com[1-9]|lpt[1-9])$")
