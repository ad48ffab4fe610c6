"""Chunkers as SQL table functions, for users who work in SQL.

    SELECT d.url, c.* FROM docs d, LATERAL chunk_headers(d.markdown, 1500, 150) c

They are plain SQL functions: the optimizer inlines them, no Python runs. The semantic cascade needs folds and choices by
result that a SQL function body repeats over and over, so it is a Python table function; its schema depends on an argument:

    SELECT d.url, c.* FROM docs d, LATERAL chunk_semantic(d.markdown, 1200, 150, true) c
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corpusloom.functions.chunks import LARGEST, OVERLAP, SECTION_PATTERNS, SMALLEST, TARGET
from corpusloom.functions.text import WS_CHARS

# White space as a Unicode-escaped SQL literal.
_WS = "'" + "".join(f"\\u{ord(c):04x}" for c in WS_CHARS) + "'"


def _strip(x: str) -> str:
    return f"btrim({x}, {_WS})"


def _windows(x: str) -> str:
    last = f"greatest(0, cast(ceil((length({x}) - max_len) / (max_len - overlap)) AS INT))"
    piece = _strip(f"substring({x}, i * (max_len - overlap) + 1, max_len)")
    return f"array_remove(transform(sequence(0, {last}), i -> {piece}), '')"


def _split(x: str, marks: str) -> str:
    return f"array_remove(transform(split({x}, r'(?md)^(?={marks} )'), s -> {_strip('s')}), '')"


def _headers(x: str) -> str:
    parts = _split(x, "#")
    for marks in ("##", "###"):
        parts = f"flatten(transform({parts}, p -> {_split('p', marks)}))"
    return f"flatten(transform({parts}, p -> CASE WHEN length(p) > max_len THEN {_windows('p')} ELSE array(p) END))"


def _sized_sections(parts: list[str]) -> list[str]:
    merged: list[str] = []
    for part in parts:
        if merged and len(merged[-1]) < SMALLEST:
            merged[-1] += "\n" + part
        else:
            merged.append(part)
    if len(merged) > 1 and len(merged[-1]) < SMALLEST:
        merged[-2:] = ["\n".join(merged[-2:])]
    cut = [[p] if len(p) <= LARGEST else [p[i:i + LARGEST].strip(WS_CHARS) for i in range(0, len(p), LARGEST)] for p in merged]
    return [t for texts in cut for t in texts if t]


def _sections(text: str) -> list[str]:
    for pattern in SECTION_PATTERNS:
        heads = list(re.finditer(pattern, text, re.A))
        if len(heads) < 2:
            continue
        starts = [0, *(h.end() for h in heads)]
        ends = [*(h.start() for h in heads[:-1]), len(text)]
        kept = [t for t in (text[a:b].strip(WS_CHARS) for a, b in zip(starts, ends)) if t]
        if any(SMALLEST <= len(t) <= LARGEST for t in kept) and (found := _sized_sections(kept)):
            return found
    return []


def _groups(parts: Iterator[str], glue: str, target: int) -> list[str]:
    done: list[str] = []
    for part in filter(None, (p.strip(WS_CHARS) for p in parts)):
        if done and len(done[-1]) + len(part) <= target:
            done[-1] += glue + part
        else:
            done.append(part)
    return done


def _overlapped(texts: list[str], overlap: int) -> list[str]:
    out = texts[:1]
    for before, text in zip(texts, texts[1:]):
        tail = before[max(0, len(before) - overlap):]
        cut = tail.find(" ")
        if cut > 0 and tail[0] not in WS_CHARS:
            tail = tail[cut + 1:]
        out.append(f"{tail} {text}".strip(WS_CHARS))
    return out


def semantic(text: str, target: int, overlap: int) -> tuple[str, list[str]]:
    """The cascade of `functions.chunks.chunk_semantic` over one text: kind and chunks."""
    if len(text) <= target:
        return "complete", [text]
    kind, found = "section", _sections(text)
    if not found:
        kind, found = "paragraph_group", _groups(re.split(r"\n\s*\n", text, flags=re.A), "\n\n", target)
    if not found:
        kind, found = "sentence_group", _groups(re.split(r"[.!?]+(?:\s+|\Z)", text, flags=re.A), ". ", target)
    if not found:
        cut = re.findall(rf"(?s)(?:.{{1,{target}}}(?=[ \n\t]|\Z)|.{{{target}}})", text)
        kind, found = "character_split", [t for t in (c.strip(WS_CHARS) for c in cut) if t]
    return kind, _overlapped(found, overlap)


@udtf
class SemanticChunks:
    """chunk_semantic(doc, target, overlap, typed): chunk_index, chunk_type (if typed), content."""

    @staticmethod
    def analyze(
        doc: AnalyzeArgument, target: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None,
        typed: AnalyzeArgument | None = None,
    ) -> AnalyzeResult:
        if not isinstance(doc.dataType, (T.StringType, T.NullType)):
            raise ValueError("doc must be a string")

        def constant(arg: AnalyzeArgument | None, name: str, kind: type, default):
            if arg is None:
                return default
            if not arg.isConstantExpression or not isinstance(arg.value, kind):
                raise ValueError(f"{name} must be a constant {kind.__name__}")
            return arg.value

        size, shared = constant(target, "target", int, TARGET), constant(overlap, "overlap", int, OVERLAP)
        if size < 1 or shared < 0:
            raise ValueError("target must be positive and overlap not negative")
        schema = T.StructType().add("chunk_index", T.IntegerType())
        if constant(typed, "typed", bool, False):
            schema = schema.add("chunk_type", T.StringType())
        return AnalyzeResult(schema.add("content", T.StringType()))

    def eval(self, doc: str | None, target: int = TARGET, overlap: int = OVERLAP, typed: bool = False):
        if doc is not None:
            kind, texts = semantic(doc, target, overlap)
            for i, text in enumerate(texts):
                yield (i, kind, text) if typed else (i, text)


def register(spark: SparkSession) -> None:
    """Create chunk_headers, chunk_windows and chunk_semantic as temporary table functions of the session."""
    spark.udtf.register("chunk_semantic", SemanticChunks)
    for name, body in (("chunk_headers", _headers("doc")), ("chunk_windows", _windows("doc"))):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(doc STRING, max_len INT, overlap INT) "
            f"RETURNS TABLE (chunk_index INT, content STRING) RETURN SELECT * FROM posexplode({body})"
        )
