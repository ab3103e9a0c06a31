"""Places of pattern matches in whole texts, with DataFrame functions only.

Spark's functions give matches without their places. The places follow from two linear scans: the matches themselves,
and the lengths of what lies between them. Running sums go by blocks of BLOCK matches, so that a text with very many
matches costs far less than the square of their number. Positions are code points from 0, ends exclusive.

A span is a struct (start, kind, end, name): arrays of spans sort by start, then by the kind's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
SPAN = "array<struct<start:bigint,kind:int,end:bigint,name:string>>"


def _total(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, s: a + s["gap"] + s["size"])


def _steps(found: Column, gaps: Column, values: Column | None) -> Column:
    """What each match needs for its place: the characters between it and the last match, its own, and its value. The
    arrays are arguments of zip_with, not looked up by index in a lambda: there they might be computed once per match."""
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda x, g: F.struct(g.alias("gap"), F.length(x).cast("bigint").alias("size"), x.alias("match")))
    return F.zip_with(pairs, found if values is None else values, lambda s, v: s.withField("value", v))


def _sums(steps: Column) -> Column:
    """Characters that each block of matches takes up."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
    return F.transform(blocks, lambda b: _total(F.slice(steps, b * BLOCK + 1, BLOCK)))


def _places(steps: Column, sums: Column) -> Column:
    blocks = F.sequence(F.lit(0), F.size(sums) - 1)

    def block(b: Column) -> Column:
        part = F.slice(steps, b * BLOCK + 1, BLOCK)
        before = F.aggregate(F.slice(sums, 1, b), F.lit(0).cast("bigint"), lambda a, s: a + s)
        return F.transform(part, lambda s, i: s.withField("start", before + _total(F.slice(part, 1, i)) + s["gap"]))

    return F.flatten(F.transform(blocks, block))


def matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds for each name a column of structs (start, end, match, value) in order, value being the group named beside the
    pattern. Matches are leftmost and don't overlap; texts must not be null. Columns whose names begin with `_` are the
    work's own and go away."""
    names = list(patterns)
    layer = {}
    for k, n in enumerate(names):
        pattern, group = patterns[n]
        layer[f"_m{k}"] = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if group:
            layer[f"_g{k}"] = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    df = df.withColumns(layer)
    df = df.withColumns({f"_l{k}": F.when(F.size(f"_m{k}") > 0, F.transform(F.split(text, patterns[n][0], -1), lambda x: F.length(x).cast("bigint"))) for k, n in enumerate(names)})
    steps = {}
    for k, n in enumerate(names):
        m, gaps = F.col(f"_m{k}"), F.col(f"_l{k}")
        steps[f"_s{k}"] = F.when(F.size(m) > 0, _steps(m, gaps, F.col(f"_g{k}") if patterns[n][1] else None))
    df = df.withColumns(steps)
    df = df.withColumns({f"_t{k}": F.when(F.size(f"_m{k}") > 0, _sums(F.col(f"_s{k}"))) for k in range(len(names))})
    df = df.withColumns({f"_w{k}": F.when(F.size(f"_m{k}") > 0, _places(F.col(f"_s{k}"), F.col(f"_t{k}"))) for k in range(len(names))})
    kind = "array<struct<start:bigint,end:bigint,match:string,value:string>>"
    out = {n: F.coalesce(F.transform(F.col(f"_w{k}"), lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["size"]).alias("end"), s["match"].alias("match"), s["value"].alias("value"))), F.array().cast(kind)) for k, n in enumerate(names)}
    df = df.withColumns(out)
    return df.drop(*[f"_{a}{k}" for a in "mglstw" for k in range(len(names))])


def packed(df: DataFrame, text: str) -> DataFrame:
    """(row, text): the whole row as a struct, so that no column of it meets a name of the work, and the text, not null."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def unpacked(found: DataFrame, columns: list[str], outputs: list[str], instead: dict[str, Column] | None = None) -> DataFrame:
    """The row's columns again, with outputs beside them; a column of an output's name gives way, one in `instead` is replaced."""
    taken, instead = {n.lower() for n in outputs}, instead or {}
    return found.select(*[instead.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns if c.lower() not in taken], *outputs)


def span(s: Column, kind: int, name: str) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(name).alias("name"))


def shown(found: Column) -> Column:
    """kind:start:end of each span by start, then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mark: str) -> Column:
    """The text with each stretch that spans cover replaced by a mark; spans that overlap or touch are one stretch."""
    state = "struct<text:string,at:bigint>"
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at")).cast(state)

    def step(a: Column, s: Column) -> Column:
        fresh = F.concat(a["text"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))
        new = (s["start"] > a["at"]) | ((s["start"] == 0) & (a["at"] == 0))
        return F.struct(F.when(new, fresh).otherwise(a["text"]).alias("text"), F.greatest(a["at"], s["end"]).alias("at")).cast(state)

    done = F.aggregate(F.array_sort(found), start, step, lambda a: F.concat(a["text"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)
