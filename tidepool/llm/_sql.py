"""SQL expressions shared by the operators that find spans in texts.

A text may hold hundreds of thousands of matches, so nothing here appends to
one long array or counts code points from the text's start for each match:
running values are made block by block, and pieces are read from blocks of the
text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of an array that are scanned in one go, and code points in a block of text.
STEP, BLOCK = 256, 512
SPAN = "array<struct<start:int,text:string>>"


def quote(pattern: str) -> str:
    """A regular expression as a SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(array: str, zero: str, step: str) -> str:
    """SQL: for every element of an array<int> what ``step`` (of c and v) makes of all before it, from ``zero`` on."""
    empty = "cast(array() as array<int>)"
    local = f"aggregate(q, struct({zero} as c, {empty} as a), (s, v) -> {let('c', 's.c', f'struct({step} as c, array_append(s.a, s.c) as a)')})"
    blocks = f"transform(sequence(0, greatest(cast((size(xs) - 1) / {STEP} as int), 0)), b -> slice(xs, b * {STEP} + 1, {STEP}))"
    totals = f"aggregate(ls, struct({zero} as c, {empty} as a), (s, l) -> {let('c', 's.c', let('v', 'l.c', f'struct({step} as c, array_append(s.a, s.c) as a)'))}).a"
    joined = f"flatten(zip_with(ls, {totals}, (l, c) -> transform(l.a, v -> {step})))"
    return let("xs", array, let("ls", f"transform({blocks}, q -> {local})", joined))


def matches(text: str, pattern: str) -> str:
    """SQL: leftmost non-overlapping matches of a text, array<struct<start, text>>; start counts code points from 0."""
    p = quote(pattern)
    sizes = "zip_with(slice(gaps, 1, size(hits)), hits, (g, h) -> length(g) + length(h))"
    spans = f"zip_with({running(sizes, '0', 'c + v')}, zip_with(slice(gaps, 1, size(hits)), hits, (g, h) -> struct(length(g) as n, h as h)), (at, x) -> struct(at + x.n as start, x.h as text))"
    return let("hits", f"regexp_extract_all({text}, {p}, 0)", f"if(size(hits) = 0, cast(array() as {SPAN}), {let('gaps', f'split({text}, {p}, -1)', spans)})")


def blocks(text: str) -> str:
    """SQL: a text cut into blocks, for :func:`near` and :func:`piece`."""
    return f"regexp_extract_all({text}, {quote(f'(?s).{{1,{BLOCK}}}')}, 0)"


def near(cut: str, start: str, length: str) -> str:
    """SQL: at most BLOCK code points of a text from ``start`` (from 0) on, out of its blocks."""
    at = f"cast(({start}) / {BLOCK} as int)"
    return f"substr(concat(coalesce(get({cut}, {at}), ''), coalesce(get({cut}, {at} + 1), '')), ({start}) % {BLOCK} + 1, {length})"


def piece(cut: str, start: str, end: str) -> str:
    """SQL: a text from ``start`` up to ``end``, of any length, out of its blocks."""
    first = f"cast(({start}) / {BLOCK} as int)"
    return f"substr(array_join(slice({cut}, {first} + 1, cast(({end}) / {BLOCK} as int) - {first} + 1), ''), ({start}) % {BLOCK} + 1, ({end}) - ({start}))"


def apart(firm: str, loose: str) -> str:
    """SQL: two arrays of structs with start and end in one, in order, without those of ``loose`` that overlap one of ``firm``."""
    z = f"array_sort(concat(transform({firm}, s -> struct(s.start as start, s.end as end, 1 as firm, s as span)), transform({loose}, s -> struct(s.start as start, s.end as end, 0 as firm, s as span))))"
    ends = running("transform(zs, z -> if(z.firm = 1, z.end, 0))", "0", "greatest(c, v)")
    starts = f"reverse({running('transform(reverse(zs), z -> if(z.firm = 1, z.start, 2147483647))', '2147483647', 'least(c, v)')})"
    kept = f"transform(filter(zip_with(zs, zip_with({ends}, {starts}, (e, s) -> struct(e as e, s as s)), (z, o) -> struct(z as z, o as o)), x -> x.z.firm = 1 or (x.o.e <= x.z.start and x.o.s >= x.z.end)), x -> x.z.span)"
    return f"if(size({loose}) = 0, array_sort({firm}), {let('zs', z, kept)})"


def first_of_overlapping(spans: str) -> str:
    """SQL: of an array of structs with start and end, in order, those that no earlier one reaches into."""
    ends = running("transform(zs, z -> z.end)", "0", "greatest(c, v)")
    kept = f"transform(filter(zip_with(zs, {ends}, (z, e) -> struct(z as z, e as e)), x -> x.e <= x.z.start), x -> x.z)"
    return let("ys", spans, f"if(size(ys) < 2, ys, {let('zs', 'array_sort(ys)', kept)})")


def replaced(text: str, spans: str, mark: str) -> str:
    """SQL: a text with its spans (in order, apart from each other; of a struct s) replaced by ``mark``."""
    ends = "transform(ss, s -> s.end)"
    parts = f"zip_with(concat(array(0), {ends}), concat(transform(ss, s -> struct(s.start as start, {mark} as mark)), array(struct(length({text}) as start, '' as mark))), (a, s) -> concat({piece('bs', 'a', 's.start')}, s.mark))"
    return let("ss", spans, let("bs", blocks(text), f"array_join({parts}, '')"))


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """The frame with columns that begin with two underscores, as operators' own do, under other names; these; and what gives the names back."""
    taken, other = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.startswith("__"):
            other[c] = next(n for n in (f"kept_{i}" for i in range(len(taken) + 1)) if n not in taken)
            taken.add(other[c])
    names = {n: c for c, n in other.items()}

    def named(out: DataFrame) -> DataFrame:
        return out.toDF(*(names.get(c, c) for c in out.columns)) if other else out

    return (df.toDF(*(other.get(c, c) for c in df.columns)) if other else df), other, named


def by_place(df: DataFrame, kept: list[str], **inputs: str) -> DataFrame:
    """The kept columns as k0, k1, ... and the inputs under the names given: in Arrow any name will do then, dots and clashes included."""
    return df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)), *(F.col(f"`{c}`").alias(name) for name, c in inputs.items()))
