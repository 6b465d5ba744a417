"""Main text of web pages by line-block distribution.

Markup is stripped into lines (one for each block element), each with the length of its
text. Lines of menus, page headers and footers, sidebars, notices, adverts, forms and reader
comments, lines of a copyright notice and lines that are mostly links, count as empty; where
such a part or the main container begins or ends, the run of lines is broken. Elements that
mean such a part, hidden ones, adverts and comments beside the article are out by that; of
other parts a class, id or role that says so lowers the peak to an eighth, so the only or by
far the highest text of a page is kept whatever its container is called. Sums of lengths over a sliding window
of lines then rise from nothing at a surge point and fall back to nothing at a dive point,
and the text between them is a candidate. All candidates compete by their peaks, whatever
element holds them. Where an article or main element holds the highest (or ties with it),
the text outside such elements is left out; an article with a high candidate is kept whole,
so short paragraphs stay, an article without one (a teaser, a card) is left out, and what a
main element holds is never left out. Elsewhere the candidates whose peak is high are kept, and
with them the short ones in the same container, in one beside it of the same kind, or
directly in one around it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import memory

#: Lines of a window; the peak a candidate needs outside an article, in code points, and as a share of the highest.
WINDOW, PEAK, PEAK_SHARE = 3, 86, 0.25

#: Elements by their role in HTML.
RAW = "script style noscript template textarea svg math iframe object canvas select button audio video title head"
BLOCK = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul"
)
CONTAINER = "article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul"
#: Containers that part a page; lists, quotes and figures belong to the text around them.
GROUP = "article div main section table"
BOILERPLATE = "nav aside footer form menu dialog"
VOID = "area base br col embed hr img input link meta param source track wbr"
ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar note toolbar status"
NAMES = (
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies copyright disclaimer disclaimers disqus feedback footer gdpr login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted "
    "recommend recommended related replies reply respond responses search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget"
)
#: Second parts of a name that leave its meaning to the first ("related-links"); an advert is one whatever follows.
PLAIN = (
    "area articles bar block bottom box center container content footer form group header inner item items left link links list module "
    "outer panel posts region right section slot stories strip text top unit widget wrap wrapper zone"
)
ADVERT = "ad ads advert adverts advertisement advertising cookie cookies consent gdpr sponsor sponsored promo"

#: Names of what readers write; inside an article they are taken like other names.
READERS = "comment comments commentlist disqus replies reply respond responses"
#: What remains of the peak of a part whose name says that it is no main text.
NAMED_SHARE = 0.125

_RAW, _BLOCK, _CONTAINER, _GROUP, _BOILERPLATE, _ROLES, _NAMES, _PLAIN, _ADVERT, _READERS = (
    frozenset(x.split()) for x in (RAW, BLOCK, CONTAINER, GROUP, BOILERPLATE, ROLES, NAMES, PLAIN, ADVERT, READERS)
)
_VOID = frozenset(VOID.split())
_RAW_NAMES = "|".join(_RAW - {"head"})
# A comment or raw element that never ends takes the rest of the page.
_TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|(?P<open>\Z)))|<(?P<raw>{_RAW_NAMES})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|(?P<unended>\Z))"
    r"""|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?>[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A line that states who owns the page, outside an article.
_OWNER = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
OWNER_LENGTH = 200
_PART = re.compile(r"[a-z]+(?=[A-Z])|[A-Z]?[a-z]+|[A-Z]+")


#: What an element's name and attributes say of its text: nothing, that it counts less, that it is out.
KEEP, LESS, OUT = range(3)


def _named(word: str, in_article: bool) -> int:
    """What a class or id says: as a whole, by its last part, or by its first where the others are plain ("left_sidebar", "related-links", "ad-1x")."""
    parts = [p.lower() for p in _PART.findall(word)]
    if not parts or not (parts[-1] in _NAMES or parts[0] in _ADVERT or parts[0] in _NAMES and all(p in _PLAIN for p in parts[1:])):
        return KEEP
    out = parts[0] in _ADVERT or parts[-1] in _ADVERT or not in_article and not _READERS.isdisjoint(parts)
    return OUT if out else LESS


def _attributes(attrs: str) -> Iterator[tuple[str, str]]:
    for m in _ATTRIBUTE.finditer(attrs):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""


def _says(name: str, attrs: str, in_article: bool) -> int:
    if name in _BOILERPLATE or name == "header" and not in_article:
        return OUT
    if not attrs or name in ("body", "html"):
        return KEEP
    found = KEEP
    for key, value in _attributes(attrs):
        if key == "hidden" or key == "style" and _HIDDEN.search(value):
            return OUT
        if key == "role" and value.lower() in _ROLES:
            found = max(found, LESS)
        elif key in ("class", "id") and name != "main":
            found = max([found, *(_named(word, in_article) for word in value.split())])
    return found


def _mutes(attrs: str) -> bool:
    """Whether an element inside a line is hidden or an advert."""
    return bool(attrs) and _says("span", attrs, True) == OUT


def _kind(attrs: str) -> str:
    """The first class without its digits, else the id: parts of a page that repeat are of one kind."""
    if not attrs:
        return "#"
    found = {k: v for k, v in _attributes(attrs) if k in ("class", "id")}
    return re.sub(r"\d+", "", found["class"].split()[0]) if found.get("class", "").strip() else "#" + found.get("id", "")


#: The groups of what only the page holds and of main elements; others have larger numbers.
PAGE, MAIN = 0, 1


def lines(page: str) -> tuple[list[tuple[str, bool, int, int]], dict[int, int], list[tuple[int, ...]]]:
    """(text, whether it counts, group of the article that holds it or 0, own group) of each line, the group around each group, and the parts that count less around each line.

    An empty text breaks the run. A group has a larger number than the one around it.
    """
    out: list[tuple[str, bool, int, int]] = []
    less: list[tuple[int, ...]] = []
    around: dict[int, int] = {}
    # Open containers: name, whether it or one around it is out, group of the article around, own group, those that count less.
    stack: list[tuple[str, bool, int, int, tuple[int, ...]]] = [("", False, 0, PAGE, ())]
    parts = 0
    held: Counter[str] = Counter()
    groups: dict[tuple[int, str, str], int] = {}
    buffer: list[str] = []
    linked = 0
    in_link, passing = False, KEEP  # passing: what the open block that is no container says
    muted, depth = "", 0  # the open element inside a line whose text is out

    def flush() -> None:
        nonlocal linked
        if not buffer:
            return
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            _, gone, article, own, named = stack[-1]
            # Outside the article, a line that is mostly links is a menu.
            menu = not article and (2 * linked > len(text) or len(text) <= OWNER_LENGTH and bool(_OWNER.match(text)))
            out.append((text, not (gone or passing == OUT or menu), article, own))
            less.append(named + ((parts,) if passing == LESS else ()))
        linked = 0

    at = 0
    # Nothing after the last > is a tag; text there is text, but for a comment that opens.
    last = page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, last):
        if m.start() > at and not muted:
            buffer.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        name = m["name"]
        if not name:
            if m["open"] is not None or m["unended"] is not None:
                at = len(page)
            continue
        name = name.lower()
        if name == "br":
            buffer.append(" ")
        if name == "a":
            in_link = not m["end"]
        attrs = m["attrs"]
        if name not in _BLOCK:
            if muted:
                depth += (name == muted) * (-1 if m["end"] else 1)
                muted = muted if depth else ""
            elif not m["end"] and name not in _VOID and not attrs.endswith("/") and _mutes(attrs):
                muted, depth = name, 1
            continue
        flush()
        muted, depth = "", 0
        before = stack[-1][1:]
        if name not in _CONTAINER:
            passing = KEEP if m["end"] else _says(name, attrs, before[1] > 0)
            parts += passing == LESS
            continue
        passing = KEEP
        if m["end"]:
            if held[name]:
                while len(stack) > 1:
                    top = stack.pop()[0]
                    held[top] -= 1
                    if top == name:
                        break
        elif not attrs.endswith("/"):
            # Parts of one kind in one container are a group; what lies in the page itself, and each article, is a group of its own.
            _, gone, article, outer, named = stack[-1]
            group, inside = outer, name in ("article", "main") or bool(attrs) and bool(re.search(r"""\brole\s*=\s*["']?main\b""", attrs, re.I))
            if inside and name != "article":
                group = MAIN
            elif name in _GROUP:
                kind = (outer, name, _kind(attrs) if outer != PAGE and name != "article" else str(at))
                group = groups.setdefault(kind, MAIN + 1 + len(groups))
                around[group] = outer
            # The outermost article holds a line.
            says = _says(name, attrs, article > 0)
            parts += says == LESS
            stack.append((name, gone or says == OUT, article or (group if inside else 0), group, named + ((parts,) if says == LESS else ())))
            held[name] += 1
        if (stack[-1][1:3], stack[-1][4]) != (before[:2], before[3]):
            out.append(("", False, stack[-1][2], PAGE))
            less.append(())
    rest = page[at:]
    buffer.append(rest[: rest.find("<!--")] if "<!--" in rest else rest)
    flush()
    return out, around, less


def _promoted(found: list[tuple[str, bool, int, int]], less: list[tuple[int, ...]], window: int) -> set[int]:
    """Parts that count although their names speak against them: an eighth of their peak is above that of all others."""
    runs: dict[int, list[int]] = {0: []}
    around: dict[int, tuple[int, ...]] = {0: ()}
    for (text, counts, _, _), named in zip(found, less, strict=True):
        if not text:
            runs[0].append(0)
        elif counts:
            own = named[-1] if named else 0
            runs.setdefault(own, []).append(len(text))
            around[own] = named
    if len(runs) == 1:
        return set()

    def peak(sizes: list[int]) -> int:
        total = np.append(np.zeros(window, np.int64), np.cumsum(sizes))
        return int((total[window:] - total[:-window]).max(initial=0))

    top = peak(runs[0])
    return {p for own, sizes in runs.items() if own and NAMED_SHARE * peak(sizes) > top for p in around[own]}


def extract(page: str, window: int = WINDOW) -> str:
    """The main text: kept lines joined by one newline; empty if there is none."""
    rows: list[tuple[str, int, int, int]] = []
    found_lines, around, less = lines(page)
    counted = _promoted(found_lines, less, window)
    for (text, counts, article, own), named in zip(found_lines, less, strict=True):
        if not text or not counts or not counted.issuperset(named):
            # Nothing of a window before the break reaches what follows.
            rows.extend([("", 0, 0, PAGE)] * window)
        else:
            rows.append((text, len(text), article, own))
    if not any(r[0] for r in rows):
        return ""
    size = np.array([r[1] for r in rows] + [0] * window, np.int64)
    total = np.r_[0, np.cumsum(size)]
    blocks = total[window:] - total[:-window]  # of the window that begins at each line
    high = np.r_[False, blocks[: len(rows)] > 0, False]
    surges = np.flatnonzero(high[1:] & ~high[:-1])
    dives = np.flatnonzero(high[:-1] & ~high[1:])
    # (peak, article, rows) of each candidate; none reaches over the edge of an article.
    found = []
    for a, b in zip(surges.tolist(), dives.tolist(), strict=True):
        of = [r for r in rows[a:b] if r[0]]
        found.append((int(blocks[a:b].max()), of[0][2], of))
    top = max(peak for peak, _, _ in found)
    if any(peak == top and article for peak, article, _ in found):
        found = [c for c in found if c[1]]
    whole, above, wins = {MAIN}, set(), []
    for peak, article, of in found:
        least = PEAK_SHARE * top if article else max(PEAK, PEAK_SHARE * top)
        wins.append(peak >= least or peak == top)
        if wins[-1] and article:
            whole.add(article)
        elif wins[-1]:
            # The containers with enough of its text, and the one with the most.
            held: dict[int, int] = {}
            for _, n, _, own in of:
                held[own] = held.get(own, 0) + n
            most = max(held.values())
            for g in (g for g, n in held.items() if n >= least or n == most):
                whole.add(g)
                # Text that lies in the containers around these, in no other part of them.
                while (g := around.get(g, PAGE)) != PAGE and g not in above:
                    above.add(g)
    # What lies in a group is whole with it; of the page itself, only what no other container holds.
    for g in sorted(around):
        if around[g] != PAGE and around[g] in whole:
            whole.add(g)
    near = whole | above
    out = [t for win, (_, _, of) in zip(wins, found, strict=True) for t, _, _, own in of if win or own in near]
    return "\n".join(out)


@memory.tidy
def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page or "") for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; the whole html is read, null html is empty.

    A page without main text has an empty text. Repeated rows each give a row; other
    columns are not carried. An empty table gives no rows.
    """
    columns = pages.select("page_id", "url", "html")
    schema = ", ".join(f"{c} {columns.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return columns.mapInArrow(_extracted, f"{schema}, text string").withColumn("n_chars", F.char_length("text").cast("long"))
