"""Regex matches with their positions in code points, as Spark expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEFORE, AFTER = 24, 8  # code points of context kept on either side of a match


def add_matches(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """For every (name, pattern) add ``name``: array<struct<start, end, match, before, after>>.

    Leftmost non-overlapping matches in order, ends exclusive, counted in code points.  The
    matches and the stretches between them are cut in one pass each; their running lengths
    give the places.  A text without a match is passed once.
    """
    found = df.select("*", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_m_{n}") for n, p in patterns.items()])
    gaps = {
        n: F.when(F.size(f"_m_{n}") > 0, F.split(F.col(text), p, -1)).otherwise(F.array().cast("array<string>"))
        for n, p in patterns.items()
    }
    cut = found.select("*", *[gap.alias(f"_g_{n}") for n, gap in gaps.items()])
    places = {n: _places(F.col(f"_m_{n}"), F.col(f"_g_{n}")).alias(n) for n in patterns}
    return cut.select(*[c for c in df.columns if c not in patterns], *places.values())


def _places(matches: Column, gaps: Column) -> Column:
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["g"]
        end = begin + s["m"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    placed = F.aggregate(steps, start, step, lambda acc: acc["out"])

    def whole(p: Column, i: Column) -> Column:
        return F.struct(
            p["start"].alias("start"), p["end"].alias("end"), F.get(matches, i).alias("match"),
            F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("after"),
        )

    return F.transform(placed, whole)


def of_kind(spans: Column, kind: str, rank: int) -> Column:
    """Spans as array<struct<start, rank, kind, end>>, ready to be sorted by start and rank."""
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")),
    )


def only(spans: Column | str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every maximal run of characters under ``spans`` replaced by [kind].

    ``spans`` must be sorted by start; of spans that touch or overlap the first names the run.
    """
    zero = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"),
    )

    def step(acc: Column, s: Column) -> Column:
        fresh = (s["start"] > acc["at"]) | (F.size(acc["out"]) == 0)
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]"))))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, finish)).otherwise(text)
