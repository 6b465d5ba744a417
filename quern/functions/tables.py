"""Table functions for SQL: sections, chunks, highlights and segments of a text, one row of it at a time.

After ``register(spark)`` they stand in a LATERAL join:
``SELECT d.doc_id, s.* FROM docs d, LATERAL sections(d.text) s``.
A null text counts as empty. What they are given is checked when the query is analysed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quern import scratch
from quern.operators import sections as P

_SPAN = "ordinal int, section string, start int, end int"


def _schema(ddl: str) -> AnalyzeResult:
    # Analysis runs without a session, so the text is not parsed by one.
    kinds = {"int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}
    return AnalyzeResult(schema=T.StructType([T.StructField(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))]))


def _check(name: str, given: AnalyzeArgument, *kinds: type) -> None:
    if not isinstance(given.dataType, (*kinds, T.NullType)):
        raise ValueError(f"{name} is a {given.dataType.simpleString()}, not a {kinds[0].typeName()}")


def _number(name: str, given: AnalyzeArgument | None, default: int) -> int:
    """A whole number that is known when the query is analysed."""
    if given is None:
        return default
    if not given.isConstantExpression or not isinstance(given.value, int) or given.value < 0:
        raise ValueError(f"{name} must be a constant whole number")
    return given.value


@udtf(useArrow=True)
class Sections:
    """sections(text): ordinal, section, start, end."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _check("text", text, T.StringType)
        return _schema(_SPAN)

    def eval(self, text: str | None) -> Iterator[tuple]:
        for k, span in enumerate(P.section_spans(text or "", *P.outline(text or ""))):
            yield k, *span


@udtf(useArrow=True)
class Chunks:
    """chunks(text, max_tokens => 512, overlap => 64): ordinal, section, start, end, text, token_count of passages of whole sentences."""

    @staticmethod
    def analyze(text: AnalyzeArgument, max_tokens: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        _check("text", text, T.StringType)
        most, shared = _number("max_tokens", max_tokens, 512), _number("overlap", overlap, 64)
        if most < 3 or 2 * shared > most - 2:
            raise ValueError("the overlap is at most half of what a passage holds")
        return _schema(f"{_SPAN}, text string, token_count int")

    def eval(self, text: str | None, max_tokens: int = 512, overlap: int = 64) -> Iterator[tuple]:
        body = text or ""
        for ordinal, name, start, end, n in P.passages(body, P.section_spans(body, *P.outline(body)), max_tokens, overlap):
            yield ordinal, name, start, end, body[start:end], n


@udtf(useArrow=True)
class Highlights:
    """highlights(text, terms): start, end and word of each word that matches a term, case and marks ignored."""

    @staticmethod
    def analyze(text: AnalyzeArgument, terms: AnalyzeArgument) -> AnalyzeResult:
        _check("text", text, T.StringType)
        _check("terms", terms, T.ArrayType)
        return _schema("start int, end int, word string")

    def eval(self, text: str | None, terms: list[str] | None) -> Iterator[tuple]:
        body = text or ""
        for a, b in P.highlights(body, [t for t in (terms if terms is not None else []) if t]).tolist():
            yield a, b, body[a:b]


@udtf(useArrow=True)
class Segments:
    """segments(text, terms, size => 280): ordinal, text, mark of the parts of the excerpt that shows most terms."""

    @staticmethod
    def analyze(text: AnalyzeArgument, terms: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        _check("text", text, T.StringType)
        _check("terms", terms, T.ArrayType)
        _number("size", size, 280)
        return _schema("ordinal int, text string, mark boolean")

    def eval(self, text: str | None, terms: list[str] | None, size: int = 280) -> Iterator[tuple]:
        body = (text or "").translate(P.FLAT)
        marks = P.merge(P.highlights(body, [t for t in (terms if terms is not None else []) if t]), len(body))
        for k, (part, mark) in enumerate(P.segments(body, marks, *P.excerpt_window(body, marks, size))):
            yield k, part, mark


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL of a session."""
    scratch.prepare(spark)
    for name, function in (("sections", Sections), ("chunks", Chunks), ("highlights", Highlights), ("segments", Segments)):
        spark.udtf.register(name, function)
