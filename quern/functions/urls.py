"""URL policy and robots rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import let, normalized


def part(url: Column, what: str) -> Column:
    """PROTOCOL, HOST, PATH, QUERY or AUTHORITY of a URL; null for what is none."""
    return F.try_parse_url(url, F.lit(what))


def is_allowed(url: Column, host: Column) -> Column:
    """Absolute https on the allowed host, without user and with no port but the default one."""
    own = F.lower(part(url, "HOST"))
    plain = F.lower(part(url, "AUTHORITY")).isin(own, F.concat(own, F.lit(":443")))
    return F.coalesce((F.lower(part(url, "PROTOCOL")) == "https") & plain & (own == F.lower(host)), F.lit(False))


def on_domain(url: Column, domain: str) -> Column:
    """Whether the host is the domain or one below it."""
    host = F.lower(part(url, "HOST"))
    return F.coalesce((host == domain.lower()) | host.endswith("." + domain.lower()), F.lit(False))


def describe(url: Column) -> Column:
    """Without query and fragment, at most 200 characters and an ellipsis."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(F.length(bare) > 200, F.concat(F.substr(bare, F.lit(1), F.lit(200)), F.lit("..."))).otherwise(bare)


def decode_percent(c: Column) -> Column:
    """Percent escapes decoded, plus signs as they are; what is malformed stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


#: What a URL may not hold as it is after its host: blanks, controls, letters beyond ASCII, some signs, and a % that escapes nothing.
_FOREIGN = r"[^\x21-\x7e]|[\"<>\[\]{}|^`]"
_LONE_PERCENT = "%(?![0-9A-Fa-f]{2})"


def escape(c: Column) -> Column:
    """What a URL may not hold as percent escapes of its UTF-8 bytes; backslashes as slashes."""
    one = lambda x: F.when(x.rlike(_FOREIGN), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x)
    whole = lambda v: F.when(v.rlike(_FOREIGN), F.array_join(F.transform(F.split(v, ""), one), "")).otherwise(v)
    return let(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), _LONE_PERCENT, "%25"), whole)


def without_dots(path: Column) -> Column:
    """A path from / on with its . and .. segments followed."""
    step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.array_append(done, s))

    def followed(p: Column) -> Column:
        kept = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
        # A path that ends in a dot segment ends in a slash.
        return F.array_join(F.when(p.rlike(r"/\.{1,2}$"), F.array_append(kept, F.lit(""))).otherwise(kept), "/")

    return F.when(path.rlike(r"/\.{1,2}(/|$)"), let(path, followed)).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """``href`` seen from ``base``, an absolute URL: dot segments followed and what a URL may not hold escaped; null for what is no web address.

    A host with letters beyond ASCII is not translated: such an address is none.
    """
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    above = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?)", 1)

    def joined(h: Column) -> Column:
        return (
            F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.rlike(r"^[/\\]{2}"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h))
            .when(h.rlike(r"^[/\\]"), F.concat(origin, h))
            .when(h.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), h))
            .when(h.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h))
            .when(h != "", F.concat(F.coalesce(F.nullif(above, F.lit("")), F.concat(origin, F.lit("/"))), h))
        )

    def cleaned(full: Column) -> Column:
        place = lambda n: F.regexp_extract(full, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}[^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", n)
        path = without_dots(F.replace(place(2), F.lit("\\"), F.lit("/")))
        head = F.replace(place(1), F.lit("\\"), F.lit("/"))
        return F.when(place(1) == "", full).otherwise(F.concat(head, escape(path), escape(place(3)), escape(place(4))))

    return let(let(let(F.trim(href), joined), cleaned), lambda full: F.when(part(full, "HOST").isNotNull(), full))


def file_name(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), "[^/]+$", 0)


def file_key(url: Column) -> Column:
    """Decoded, composed lower-case file name: the key by which documents of different libraries are the same."""
    return F.lower(normalized(decode_percent(file_name(url)), "NFC"))


def folder(url: Column) -> Column:
    """Decoded path up to its last slash."""
    return decode_percent(F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "[^/]*$", ""))


def verdict(url: Column, host: Column) -> Column:
    """Why a URL is outside the policy, or null."""
    scheme = F.lower(part(url, "PROTOCOL"))
    why = F.when(scheme != "https", F.concat(F.lit("uses "), scheme, F.lit(", not https"))).otherwise("leaves the allowlisted host")
    return F.when(~is_allowed(url, host), why)


def robots_matches(path: Column, pattern: Column) -> Column:
    """``*`` matches anything, ``$`` at the end anchors, otherwise a prefix; both sides percent-decoded; an empty pattern matches nothing."""
    plain = decode_percent(pattern)
    anchored = plain.endswith("$")
    body = F.when(anchored, F.substr(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain)
    for special in ("\\", "_", "%"):
        body = F.replace(body, F.lit(special), F.lit("\\" + special))
    like = F.concat(F.replace(body, F.lit("*"), F.lit("%")), F.when(anchored, F.lit("")).otherwise(F.lit("%")))
    return (pattern != "") & F.like(decode_percent(path), like)


def search_parameters(url: Column) -> Column:
    """(q, tax, article, year) of a search URL: blanks trimmed, empty ones null, no article without a tax, a year of four digits."""
    raw = lambda name: F.trim(F.try_url_decode(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)))
    value = lambda name: F.when(raw(name) != "", raw(name))
    return F.struct(
        value("q").alias("q"),
        value("tax").alias("tax"),
        F.when(value("tax").isNotNull(), value("article")).alias("article"),
        F.when(value("year").rlike("^[0-9]{4}$"), value("year")).alias("year"),
    )
