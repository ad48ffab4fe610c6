"""Chunking columns: text -> array of chunks, without leaving the row.

A document's chunks depend on that document alone, so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import WS_CLASS, let, strip

# ---- fixed values -----------------------------------------------------------
SECTION_PATTERNS = [
    r"\n#{1,6}\s+.+\n",
    r"\n[A-Z][A-Z\s]{10,}\n",
    r"\n\d+\.\s+[A-Z].+\n",
    r"\n[A-Z][^.!?]*:[\s]*\n",
]
TARGET, LARGEST, SMALLEST, OVERLAP = 1200, 1800, 300, 150
# ------------------------------------------------------------------------------

_NONE = "array<string>"


def _drop_empty(parts: Column) -> Column:
    return F.array_remove(parts, "")


def chunk_fixed(c: Column, max_len: int = 1500, overlap: int = 150) -> Column:
    """Windows of max_len characters that start every max_len - overlap characters, trimmed."""
    if overlap >= max_len:
        raise ValueError("overlap must be smaller than max_len")
    step = max_len - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - max_len) / step).cast("int"))
    return _drop_empty(
        F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(c, i * step + 1, F.lit(max_len))))
    )


def _split_at(c: Column, marks: str) -> Column:
    """Parts that begin at a header of this level; text before the first is its own part."""
    return _drop_empty(F.transform(F.split(c, rf"(?md)^(?={marks} )"), strip))


def chunk_by_headers(c: Column, max_len: int = 1500, overlap: int = 150) -> Column:
    def split_all(parts: Column, marks: str) -> Column:
        return F.flatten(F.transform(parts, lambda p: _split_at(p, marks)))

    parts = split_all(split_all(_split_at(c, "#"), "##"), "###")
    return F.flatten(
        F.transform(
            parts,
            lambda p: F.when(F.length(p) > max_len, chunk_fixed(p, max_len, overlap)).otherwise(F.array(p)),
        )
    )


def _sized(parts: Column) -> Column:
    """No part is lost: short ones join the next (the last one the one before), long ones are cut into windows."""
    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = F.when(F.size(done) > 0, F.length(last) < SMALLEST).otherwise(False)
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(F.concat(last, F.lit("\n"), part)))).otherwise(F.concat(done, F.array(part)))

    def tail(done: Column) -> Column:
        n, last = F.size(done), F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(n - 2, F.lit(0))),
                          F.array(F.concat(F.try_element_at(done, F.lit(-2)), F.lit("\n"), last)))
        return F.when((n > 1) & (F.length(last) < SMALLEST), joined).otherwise(done)

    merged = let(F.aggregate(parts, F.array().cast(_NONE), step), tail)
    return F.flatten(F.transform(
        merged, lambda p: F.when(F.length(p) > LARGEST, chunk_fixed(p, LARGEST, 0)).otherwise(F.array(p))))


def _sections_by(c: Column, pattern: str) -> Column:
    """Sections for one header pattern.

    Section i runs from the end of header i-1 to the start of header i (the first
    from the start of the text); the last runs to the end of the text, header included.
    """
    pattern = "(?d)" + pattern

    def sections(heads: Column, gaps: Column) -> Column:  # n headers cut the text into n + 1 gaps
        n = F.size(heads)
        tail = F.concat(F.get(gaps, n - 1), F.get(heads, n - 1), F.get(gaps, n))
        texts = F.concat(F.slice(gaps, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(tail))
        kept = _drop_empty(F.transform(texts, strip))
        usable = F.exists(kept, lambda t: F.length(t).between(SMALLEST, LARGEST))
        return F.when((n >= 2) & usable, _sized(kept)).otherwise(F.array().cast(_NONE))

    return let(
        F.regexp_extract_all(c, F.lit(pattern), 0),
        lambda heads: let(F.split(c, pattern), lambda gaps: sections(heads, gaps)),
    )


def _first_non_empty(options: list[Column]) -> Column:
    """First array with elements; later options are computed only when the earlier ones are empty."""
    if len(options) == 1:
        return options[0]
    return let(
        options[0], lambda found: F.when(F.size(found) > 0, found).otherwise(_first_non_empty(options[1:]))
    )


def split_sections(c: Column) -> Column:
    """First section pattern with two headers and at least one section of usable length."""
    return _first_non_empty([_sections_by(c, p) for p in SECTION_PATTERNS])


def _fill(parts: Column, glue: str, target: int) -> Column:
    """Greedy fill: close the open group when the next part would take it past the target."""
    start = F.struct(F.lit("").alias("open"), F.array().cast(_NONE).alias("done"))

    def step(s: Column, part: Column) -> Column:
        closes = (s["open"] != "") & (F.length(s["open"]) + F.length(part) > target)
        return F.struct(
            F.when(closes | (s["open"] == ""), part)
            .otherwise(F.concat(s["open"], F.lit(glue), part)).alias("open"),
            F.when(closes, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
        )

    return F.aggregate(
        parts, start, step,
        lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))),
    )


def split_paragraphs(c: Column, target: int = TARGET) -> Column:
    return _fill(_drop_empty(F.transform(F.split(c, r"\n\s*\n"), strip)), "\n\n", target)


def split_sentences(c: Column, target: int = TARGET) -> Column:
    """Sentence groups; the terminators are lost at the cuts, groups are joined by '. '."""
    return _fill(_drop_empty(F.transform(F.split(c, r"[.!?]+(?:\s+|\z)"), strip)), ". ", target)


def split_chars(c: Column, target: int = TARGET) -> Column:
    """Cut every `target` characters, moved back to white space where there is any.

    One greedy pattern does it: up to `target` characters that white space or the
    end follows, else exactly `target` characters.
    """
    cut = rf"(?s)(?:.{{1,{target}}}(?=[ \n\t]|\z)|.{{{target}}})"
    return _drop_empty(F.transform(F.regexp_extract_all(c, F.lit(cut), 0), strip))


def overlap_chunks(chunks: Column, overlap: int = OVERLAP) -> Column:
    """Prefix each chunk with the end of the chunk before it, from a word boundary on."""

    def prefix(prev: Column) -> Column:
        tail = F.when(F.length(prev) > overlap, F.substring(prev, F.length(prev) - overlap + 1, F.lit(overlap)))
        tail = tail.otherwise(prev)
        cut = F.instr(tail, " ")
        starts_word = ~tail.rlike("^" + WS_CLASS)
        return F.when(starts_word & (cut > 1), F.substring(tail, cut + 1, F.length(tail))).otherwise(tail)

    return let(
        chunks,
        lambda all_: F.transform(
            all_,
            lambda t, i: F.when(i == 0, t).otherwise(
                let(F.get(all_, i - 1), lambda prev: strip(F.concat(prefix(prev), F.lit(" "), t)))
            ),
        ),
    )


def chunk_semantic(c: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """struct(chunk_type, texts): whole text when short, else sections, paragraphs, sentences, characters."""

    def typed(texts: Column, kind: str) -> Column:
        return F.struct(F.lit(kind).alias("chunk_type"), texts.alias("texts"))

    def first_of(texts: Column, kind: str, rest: Column) -> Column:
        return let(
            texts,
            lambda found: F.when(F.size(found) > 0, typed(overlap_chunks(found, overlap), kind)).otherwise(rest),
        )

    cascade = typed(overlap_chunks(split_chars(c, target), overlap), "character_split")
    cascade = first_of(split_sentences(c, target), "sentence_group", cascade)
    cascade = first_of(split_paragraphs(c, target), "paragraph_group", cascade)
    cascade = first_of(split_sections(c), "section", cascade)
    return F.when(F.length(c) <= target, typed(F.array(c), "complete")).otherwise(cascade)
