"""Lines of games files: valid games on one side, broken lines with their reason on the other.

For each schema one anchored pattern for whole rows is generated, and one pattern per prefix of
its fields. Rows that the first pattern takes are parsed; the others pass through the prefixes,
and the shortest prefix that fails names the first broken field. Everything stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Possessive quantifiers throughout: no backtracking, and no recursion however long a line is.
_NUMBER = r"[+-]?+(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+"
_TOKEN = {
    "players": (r"[^\t\" ][^\t\"]*+", r" *+(?:[^\"\t ]|\"\")(?:[^\"\t]++|\"\")*+"),
    "number": (_NUMBER + " *+", _NUMBER),
    "positive": (_NUMBER + " *+", _NUMBER),
}
_ANY = r" *+(?:\"(?:[^\"\t]++|\"\")*+\" *+|[^\"\t]*+)"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # players, number or positive
    optional: bool = False


GAMES = (Field("side1", "players"), Field("side2", "players"), Field("threshold", "number"), Field("count", "positive", True))


def field_pattern(f: Field) -> str:
    bare, quoted = _TOKEN[f.kind]
    return rf" *+(?:\"{quoted}\" *+|{bare})"


def row_pattern(schema: tuple[Field, ...] = GAMES) -> str:
    """The anchored pattern of a whole valid row."""
    out = ""
    for i, f in enumerate(schema):
        part = ("\\t" if i else "") + field_pattern(f)
        out += f"(?:{part})?+" if f.optional else part
    return rf"\A{out}\z"


def prefix_patterns(schema: tuple[Field, ...] = GAMES) -> list[tuple[str, str]]:
    """For each field the pattern of all fields up to it, and the same with only the field's quoting asked for."""
    out, head = [], r"\A"
    for i, f in enumerate(schema):
        part = ("\\t" if i else "") + field_pattern(f)
        loose = ("\\t" if i else "") + _ANY
        ends = r"(?:\t|\z)"
        if f.optional:
            out.append((rf"{head}(?:\z|{part}{ends})", rf"{head}(?:\z|{loose}{ends})"))
        else:
            out.append((head + part + ends, head + loose + ends))
        part = f"(?:{part})?+" if f.optional else part
        head += part
    return out


def _unquoted(field: Column) -> Column:
    x = F.trim(field)
    inside = F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return F.when(x.startswith('"'), inside).otherwise(x)


def _players(field: Column) -> Column:
    return F.filter(F.split(_unquoted(field), " +"), lambda p: p != "")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def parse_lines(lines: DataFrame, line: str = "raw_line") -> DataFrame:
    """Every row of ``lines`` with ``status`` (blank, game or broken), the four fields, and the reason of a broken one.

    Spaces, tabs and carriage returns around a line are dropped; a line then empty is blank. A null line is
    broken (``no line``). Other columns pass through, also ones named like a field, under their own names: the
    parsed fields are in a struct ``game``. Reasons: ``wrong number of fields``, ``broken quoting``, ``no
    player``, ``player twice``, ``not a number``, ``not finite``, ``not above zero``; ``broken_field`` names the first field
    concerned, if it is one.
    """
    base = set(lines.columns)
    tmp = "_line"
    while tmp in base:
        tmp += "_"
    x = lines.withColumn(tmp, F.btrim(F.col(line), F.lit(" \t\r")))
    # What later steps use several times are columns of their own, so that each line is matched and split once.
    s, fits, fields = F.col(tmp), F.col(f"{tmp}f"), F.col(f"{tmp}v")
    x = x.withColumns({f"{tmp}f": s.rlike(row_pattern()), f"{tmp}v": F.split(s, "\t", -1)})
    side1, side2 = _players(F.get(fields, F.lit(0))), _players(F.get(fields, F.lit(1)))
    threshold = _unquoted(F.get(fields, F.lit(2))).try_cast("double")
    given = F.get(fields, F.lit(3))
    count = F.when(given.isNull(), F.lit(1.0)).otherwise(_unquoted(given).try_cast("double"))
    g = f"{tmp}g"
    x = x.withColumn(
        g,
        F.when(fits, F.struct(side1.alias("side1"), side2.alias("side2"), threshold.alias("threshold"), count.alias("count"))),
    )
    in_game = lambda c: F.col(f"{g}.{c}")
    everyone = F.concat(in_game("side1"), in_game("side2"))
    n_fields = F.size(fields)
    said = lambda field, why: F.struct(F.lit(field).cast("string").alias("f"), (why if isinstance(why, Column) else F.lit(why)).alias("r"))
    first = said(None, F.lit(None).cast("string"))
    for f, (strict, loose) in reversed(list(zip(GAMES, prefix_patterns(), strict=True))):
        why = F.when(~s.rlike(loose), "broken quoting").otherwise("no player" if f.kind == "players" else "not a number")
        first = F.when(~s.rlike(strict), said(f.name, why)).otherwise(first)
    least, most = sum(not f.optional for f in GAMES), len(GAMES)
    structural = F.when(s.isNull(), said(None, "no line"))
    structural = structural.when(~n_fields.between(least, most), said(None, "wrong number of fields"))
    structural = structural.when(~fits, first)
    structural = structural.when(F.size(F.array_distinct(everyone)) < F.size(everyone), said("side2", "player twice"))
    structural = structural.when(~_finite(in_game("threshold")), said("threshold", "not finite"))
    structural = structural.when(~_finite(in_game("count")), said("count", "not finite"))
    structural = structural.when(~(in_game("count") > 0), said("count", "not above zero"))
    bad = f"{tmp}b"
    x = x.withColumn(bad, F.when(s != "", structural).when(s.isNull(), structural))
    status = F.when(s == "", "blank").when(F.col(bad).isNotNull(), "broken").otherwise("game")
    out = F.struct(status.alias("status"), F.when(F.col(bad).isNull() & (s != ""), F.col(g)).alias("game"), F.col(f"{bad}.f").alias("broken_field"), F.col(f"{bad}.r").alias("reason"))
    x = x.withColumn(f"{tmp}o", out)
    # A filter on what is found isn't pushed below a generator, where it would do all the work again.
    return x.select(*[F.col(c) for c in lines.columns], F.explode(F.array(f"{tmp}o")).alias(f"{tmp}x")).select(*[F.col(c) for c in lines.columns], f"{tmp}x.*")


def valid_games(lines: DataFrame, line: str = "raw_line") -> DataFrame:
    """The valid games: the columns of ``lines`` except the raw line and those named like a field, then the four fields."""
    x = parse_lines(lines, line).where("status = 'game'")
    names = [f.name for f in GAMES]
    return x.select(*[c for c in lines.columns if c != line and c not in names], *[F.col(f"game.{n}").alias(n) for n in names])


def broken_lines(lines: DataFrame, line: str = "raw_line") -> DataFrame:
    """The lines that are neither blank nor valid, with ``broken_field`` and ``reason``."""
    x = parse_lines(lines, line).where("status = 'broken'")
    keep = [c for c in lines.columns if c not in ("broken_field", "reason")]
    return x.select(*keep, "broken_field", "reason")
