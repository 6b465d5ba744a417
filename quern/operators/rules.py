"""Rules for documents: what breaks them, a row for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X


def violations(docs: DataFrame, banned: str, most_words: int, keys: tuple[str, ...] = (), allowed_remote: str = r"^https://shields\.example/") -> DataFrame:
    """(doc_id, rule, at) for docs(doc_id, text): lines with the banned character (at: line), missing or empty keys of the front matter, images and length.

    ``at`` is 0 but for lines. One pass over the texts.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.when(F.contains(x, F.lit(banned)), i + 1)), lambda x: x.isNotNull())
    fields = X.front_matter(text)
    images = F.filter(X.image_references(text), lambda r: ~r.rlike(allowed_remote))
    found = docs.select("doc_id", lines.alias("l"), fields.alias("f"), images.alias("i"), F.size(X.image_references(text)).alias("n"), X.count_words(text).alias("w"))
    one = lambda rule: F.array(F.struct(F.lit(rule).alias("rule"), F.lit(0).alias("at")))
    none = F.array().cast("array<struct<rule: string, at: int>>")
    parts = [F.transform("l", lambda at: F.struct(F.lit("banned character").alias("rule"), at.alias("at")))]
    parts += [
        F.when(F.col("w") > most_words, one("too many words")).otherwise(none),
        F.when(F.col("n") == 0, one("no image")).otherwise(none),
        F.when(F.exists("i", lambda r: r.rlike("(?i)^[a-z][a-z0-9+.-]*:") | r.startswith("//")), one("remote image")).otherwise(none),
        F.when(F.exists("i", lambda r: r.rlike(r"(^|/)\.\.(/|$)")), one("image outside")).otherwise(none),
    ]
    if keys:
        parts.append(F.when(F.col("f").isNull(), one("no front matter")).otherwise(none))
    for k in keys:
        value = F.try_element_at("f", F.lit(k))
        parts.append(F.when(F.col("f").isNotNull() & value.isNull(), one(f"no {k}")).when(value == "", one(f"empty {k}")).otherwise(none))
    return found.select("doc_id", F.explode(F.concat(*parts)).alias("r")).select("doc_id", "r.*")
