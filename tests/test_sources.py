"""Readers, writers, and lines that fail to parse."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ranksmith.model import InvalidInput
from ranksmith.sources import readers, writers
from ranksmith.sources.games_lines import GAMES, broken_lines, parse_lines, prefix_patterns, row_pattern, valid_games

NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


def status(line):
    """The rules step by step, without a pattern of a whole row."""
    if line is None:
        return "broken"
    line = line.strip(" \t\r")
    if not line:
        return "blank"
    fields, values = line.split("\t"), []
    if len(fields) not in (3, 4):
        return "broken"
    for f in fields:
        f = f.strip(" ")
        if f.startswith('"'):
            inside = f[1:-1]
            if len(f) < 2 or not f.endswith('"') or '"' in inside.replace('""', ""):
                return "broken"
            values.append(inside.replace('""', '"'))
        elif '"' in f:
            return "broken"
        else:
            values.append(f)
    sides = [[p for p in s.split(" ") if p] for s in values[:2]]
    if not all(sides) or len(set(sum(sides, []))) < len(sum(sides, [])):
        return "broken"
    for k, x in enumerate(values[2:]):
        if not NUMBER.fullmatch(x) or abs(float(x)) == float("inf") or (k and not float(x) > 0):
            return "broken"
    return "game"


HAND = [
    "A\tB\t1", "A B\tC\t-2\t3", '"A ""x"""\tB\t1', '""\tB\t1', '"A\tB\t1', 'A"\tB\t1', '"A"x\tB\t1', " \t\r", "", None, "A\tA\t1", "A B\tC A\t1", "A\tB", "A\tB\t1\t2\t3",
    "A\tB\tnan", "A\tB\t1e400", "A\tB\t1\t0", "A\tB\t1\t-0", "A\tB\t.5", "A\tB\t5.", "A\tB\t.", "A\tB\t+1e-3\t", "\tA\tB\t1", "A\tB\t1 \t 2 ", "A\tB\t\"1\"", 'A\tB\t" 1"', "A\tB\t٣", "A\tB\t1\t1e-400", "A\t \t1", "A B\tC\t1",
    "A\tB\t1d", "A\tB\tInfinity", "“A”\tB\t1", 'A\tB\t"1', "A\tB\t1\t\t", "A" * 200_000 + "\tB\t1", '"' + "a " * 50_000 + '"\tB\t1', '"' + '""' * 100_000 + '"\tB\t1', "#",
]


def test_lines_by_hand(spark):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(HAND)], "file_name string, line_no long, raw_line string")
    got = {r.line_no: r for r in parse_lines(df).collect()}
    assert {i: r.status for i, r in got.items()} == {i: status(x) for i, x in enumerate(HAND)}
    assert all((r.reason is not None) == (r.status == "broken") for r in got.values())
    assert got[HAND.index("A\tB\tnan")].broken_field == "threshold" and got[HAND.index('"A\tB\t1')].reason == "broken quoting"
    assert got[HAND.index("A\tB")].reason == "wrong number of fields" and got[HAND.index("A\tB\t1\t0")].reason == "not above zero"
    assert got[HAND.index("A\tA\t1")].reason == "player twice" and got[HAND.index("A\tB\t1e400")].reason == "not finite"
    assert valid_games(df).count() + broken_lines(df).count() == sum(status(x) != "blank" for x in HAND)


def test_any_lines(spark):
    seen = []

    @settings(max_examples=300, deadline=None, derandomize=True)
    @given(st.text(alphabet='AB "\t1.-e+\r', max_size=14))
    def gather(x):
        seen.append(x)

    gather()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(seen)], "line_no long, raw_line string")
    assert {r.line_no: r.status for r in parse_lines(df).select("line_no", "status").collect()} == {i: status(x) for i, x in enumerate(seen)}


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([("x", "A\tB\t1\t2", "mine", 5)], "status string, raw_line string, side1 string, count int")
    assert valid_games(df.drop("status")).first().asDict() == {"side1": ["A"], "side2": ["B"], "threshold": 1.0, "count": 2.0}
    assert parse_lines(df.drop("status")).first().game.side1 == ["A"]
    assert broken_lines(df.limit(0).drop("status")).count() == 0


def test_patterns_come_from_the_schema():
    assert row_pattern(GAMES[:1]).startswith(r"\A") and len(prefix_patterns(GAMES)) == 4
    assert len(row_pattern(GAMES)) > len(row_pattern(GAMES[:2]))


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return f"file://{p}"


def test_readers(spark, tmp_path):
    g = readers.read_games(spark, write(tmp_path, "g", "A\tB\t1\n\n\nA\tC D\t-2\t3\n\n"), periods=True).orderBy("seq").collect()
    assert [(r.seq, r.period, r.side1, r.side2, r.margin, r.weight) for r in g] == [(1, 1, ["A"], ["B"], 1.0, 1.0), (4, 2, ["A"], ["C", "D"], -2.0, 3.0)]
    with pytest.raises(InvalidInput):
        readers.read_games(spark, write(tmp_path, "gb", "A\tB\n"))
    assert readers.read_games(spark, write(tmp_path, "gc", "A\tB\nA\tB\t1\n"), strict=False).count() == 1
    e = readers.read_graph(spark, write(tmp_path, "e", "a b 2\nb c\n"), swap=True).orderBy("seq").collect()
    assert [(r.src, r.dst, r.weight) for r in e] == [("b", "a", 2.0), ("c", "b", 1.0)]
    assert readers.read_rankings(spark, write(tmp_path, "r", "a b c\n\nb a\n")).count() == 2
    m = readers.read_matchups(spark, write(tmp_path, "m", "a b | c = d | e\n")).first().teams
    assert [(t["rank"], t["players"]) for t in m] == [(1, ["a", "b"]), (2, ["c"]), (2, ["d"]), (4, ["e"])]
    assert readers.read_annotated(spark, write(tmp_path, "an", "k a b\nk a b 2\n")).agg({"weight": "sum"}).first()[0] == 3
    assert readers.read_rewards(spark, write(tmp_path, "rw", "x 1\ny 0.5\n")).count() == 2
    assert readers.read_seeds(spark, write(tmp_path, "s", "x\ny 3\n")).agg({"weight": "sum"}).first()[0] == 4
    f = readers.read_features(spark, write(tmp_path, "f", "a 1 2\nb 3 4\n")).orderBy("entity").collect()
    assert f[1].x == [3.0, 4.0]
    with pytest.raises(InvalidInput):
        readers.read_features(spark, write(tmp_path, "f2", "a 1 2\nb 3\n"))
    assert readers.read_contextual(spark, write(tmp_path, "c", "a 1 0.5 0.25\n")).first().x == [0.5, 0.25]
    t = readers.read_trajectories(spark, write(tmp_path, "t", "s 1\nu 2\n\ns 3\n")).orderBy("step").collect()
    assert [(r.state, r.reward) for r in t] == [("s", 1.0), ("u", 2.0), ("s", 3.0)] and len({r.episode_id for r in t}) == 2
    assert readers.read_odds(spark, write(tmp_path, "o", "a 2\nb 2.1\n\nc 3\nd 1.5\n")).select("event_id").distinct().count() == 2
    assert readers.read_forecasts(spark, write(tmp_path, "fc", "s a 0.5\ns b 0.5\n")).count() == 2
    assert readers.read_market(spark, write(tmp_path, "mk", "a 10\na -2\n")).agg({"shares": "sum"}).first()[0] == 8
    assert readers.read_kelly(spark, write(tmp_path, "k", "x 0.6 1\n")).first().p == 0.6
    assert readers.read_clv(spark, write(tmp_path, "cv", "x 2.1 2.0\n")).first().taken == 2.1
    assert [r.outcome for r in readers.read_calibration(spark, write(tmp_path, "cb", "0.5 yes\n0.25 LOSS\n")).orderBy("p").collect()] == [False, True]


def test_datasets_and_models_round_trip(spark, tmp_path):
    from ranksmith.model import Model, ParamMismatch
    from ranksmith.operators.counting import Borda, WinRate

    df = spark.createDataFrame([(1, "a", "b", 2.0), (2, "b", None, 1.0)], "seq long, winner string, loser string, weight double")
    readers.save_dataset(df, "pairwise", f"file://{tmp_path}/d")
    back = readers.load_dataset(spark, f"file://{tmp_path}/d", "pairwise")
    assert sorted(back.collect()) == sorted(df.collect()) and back.dtypes == df.dtypes
    with pytest.raises(InvalidInput):
        readers.load_dataset(spark, f"file://{tmp_path}/d", "graph")
    op = WinRate()
    first = op.fit(df)
    first.save(f"file://{tmp_path}/m")
    more = spark.createDataFrame([(3, "b", "a", 1.0)], df.schema)
    resumed = op.update(Model.load(spark, f"file://{tmp_path}/m", "win-rate"), more)
    assert sorted(resumed.table.collect()) == sorted(op.fit(df.unionByName(more)).table.collect())
    with pytest.raises(ParamMismatch):
        WinRate("P90").update(first, more)
    assert [r.value for r in writers.lines(Borda().fit(df)).collect()] == ["a: 2.0", "b: 0.0"]
    writers.write_text(first, f"file://{tmp_path}/t")
    assert spark.read.text(f"file://{tmp_path}/t").count() == 2


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    sizes = {"a.txt": 700, "b.txt": 3, "c.txt": 40}
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(f"{name}{k:05d}\n" if k % 7 else "\n" for k in range(1, n + 1)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (was, "1000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = readers.numbered_lines(spark, str(tmp_path)).orderBy("seq").collect()
            assert [r.seq for r in rows] == list(range(743))
            assert [(r.file[-5:], r.line_no) for r in rows] == [(name, k) for name, n in sizes.items() for k in range(1, n + 1)]
            assert all(r.line == (f"{r.file[-5:]}{r.line_no:05d}" if r.line_no % 7 else "") for r in rows)
            if size != was:
                assert len({(r.file, r.split) for r in rows}) > 5
            blocks = readers.numbered_blocks(readers.numbered_lines(spark, str(tmp_path)), readers.F.col("line") == "").collect()
            assert {(r.file[-5:], r.line_no, r.block) for r in blocks} == {(name, k, k // 7 + 1) for name, n in sizes.items() for k in range(1, n + 1) if k % 7}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_blank_lines_at_the_edges_part_nothing(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\n \nA\tB\t1\n\n\n\nB\tA\t2\nC\tA\t1\n\t\n")
    rows = readers.read_games(spark, str(tmp_path), periods=True).orderBy("seq").collect()
    assert [(r.period, r.side1[0]) for r in rows] == [(1, "A"), (2, "B"), (2, "C")]
