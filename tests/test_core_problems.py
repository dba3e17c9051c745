"""Units, orphan references and field segmentation, with their edge cases."""
from datetime import datetime as dt
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import orphans as orp
from strandloom.operators import segment as seg
from strandloom.operators import units

H = 3600


@pytest.mark.parametrize("text,hours", [
    ("2 weeks + 3 days + 12 h", 420), ("approx. 44 640 minutes", 744), ("1,5 day", 36), ("2,160 hr in flight", 2160), ("P2DT12H", 60), ("PT6H", 6), ("thirty-five days", 840), ("weeks: 2,5", 420),
    ("~31 {day}", 744), ("5 day(s) in flight", 120), ("720 hr (nominal)", 720), ("1.5 mo", 1080), ("4w and 3d", 744), ("2419200s", 672), ("one hundred days", 2400), ("hrs: 1,080", 1080), ("12 hours", 12),
])
def test_quantity_with_unit(text, hours):
    assert units.parse_quantity(text) == (Fraction(hours * H), True)


@pytest.mark.parametrize("text", ["9 to 12 weeks", "9-12 days", "9–12 d", "3/4 days", "TBD", "?", "", "until landing", None, "3 days 4 days", "two or three days", 5, "mission length"])
def test_no_quantity(text):
    assert units.parse_quantity(text) == (None, False)


def test_bare_number():
    assert units.parse_quantity(" 35.0 ") == (Fraction(35), False)
    assert units.parse_quantity("2,160") == (Fraction(2160), False)
    assert units.parse_quantity("17,5") == (Fraction(35, 2), False)


@pytest.mark.parametrize("text,unit", [
    ("Durations are recorded in days. RNA was kept for 37 months.", "day"), ("For this study the duration column counts h, not days.", "hour"), ("Time on study (column duration): unit wk.", "week"),
    ("Animals were 50 weeks old. Lights were on for 12 hours a day.", None), ("Length of stay is given in days on orbit.", "day"), ("", None), (None, None),
])
def test_stated_unit(text, unit):
    assert units.stated_unit(text) == unit


def test_quantities_of_table(spark):
    rows = [(1, "A", "3 days"), (2, "A", "5"), (3, "B", "5"), (4, None, "2 h"), (5, "A", None), (6, "A", "n/a"), (6, "A", "7"), (6, "A", "7")]
    df = spark.createDataFrame(rows, "row_id long, src string, v string").withColumn("q_source_x", F.lit(1))
    desc = spark.createDataFrame([("A", "Durations are recorded in hours."), ("A", None), (None, "Durations are recorded in days.")], "src string, text string")
    out = {(r.row_id, r.v): (r.q_seconds_num, r.q_unit_from, r.q_number) for r in units.with_quantities(df, "v", "src", desc, "src", "text").collect()}
    assert out[1, "3 days"] == (3 * 86400, "text", None)
    assert out[2, "5"] == (5 * H, "statement", 5.0)
    assert out[3, "5"] == (None, None, 5.0)
    assert out[4, "2 h"][0] == 2 * H
    assert out[5, None] == (None, None, None)
    assert units.with_quantities(df.limit(0), "v", "src", desc, "src", "text").count() == 0


def _brute(logv, mu, penalty):
    import itertools

    c = units._costs(logv, mu)
    best = min(itertools.product(range(len(units.STATES)), repeat=len(c)), key=lambda p: sum(c[i, s] for i, s in enumerate(p)) + penalty * sum(a != b for a, b in zip(p, p[1:])))
    return sum(c[i, s] for i, s in enumerate(best)) + penalty * sum(a != b for a, b in zip(best, best[1:]))


def test_history_is_exact_over_ranges(spark):
    rng = np.random.default_rng(1)
    rows, true = [], {}
    for s in range(3):
        for i in range(7):
            unit = "day" if i < 4 else "hour"
            hours = 24 * rng.integers(20, 40)
            rows.append((f"S{s}", i, float(hours / (24 if unit == "day" else 1)), float(np.log(24 * 30))))
            true[f"S{s}", i] = unit
    rows += [("big", i, 30.0 if i < 300 else 720.0, float(np.log(720))) for i in range(600)]
    df = spark.createDataFrame(rows, "src string, pos int, x double, lv double")
    got = {(r.src, r.pos): r.unit for r in units.unit_history(df, "src", ["pos"], "x", "lv").collect()}
    assert len(got) == len(rows)
    assert all(got[k] == v for k, v in true.items())
    assert all(got["big", i] == ("day" if i < 300 else "hour") for i in range(600))
    c = units._costs(np.log([30.0, 31.0, 700.0, 29.0]), np.full(4, np.log(720)))
    path = units._viterbi(c, 6.0, np.zeros(len(units.STATES)), np.zeros(len(units.STATES)))
    cost = sum(c[i, s] for i, s in enumerate(path)) + 6.0 * sum(a != b for a, b in zip(path, path[1:]))
    assert cost == pytest.approx(_brute(np.log([30.0, 31.0, 700.0, 29.0]), np.full(4, np.log(720)), 6.0))
    assert units.unit_history(df.limit(0), "src", ["pos"], "x", "lv").count() == 0


def test_told_units_are_fixed_and_runs_are_whole(spark):
    """Written units stand whatever the level says, bare numbers follow their history, and a run over several ranges is one."""
    lv = float(np.log(720))
    rows = [("a", i, 30.0, lv, "day" if i % 7 == 0 else None) for i in range(200)] + [("a", 200 + i, 720.0, lv, None) for i in range(200)]
    rows += [("b", 0, 5.0, lv, "minute"), ("b", 1, 0.0, lv, "week"), ("b", 2, 0.0, lv, None), (None, 0, 3.0, lv, "month")]
    df = spark.createDataFrame(rows, "src string, pos int, x double, lv double, told string")
    h = units.unit_history(df, "src", ["pos"], "x", "lv", fixed="told")
    got = {(r.src, r.pos): r.unit for r in h.collect()}
    assert len(got) == len(rows) - 1 and ("b", 2) not in got
    assert all(got[k[0], k[1]] == k[4] for k in rows if k[4])
    assert {u for (s, i), u in got.items() if s == "a"} == {"day", "hour"} and got["a", 199] == "day" and got["a", 200] == "hour"
    runs = sorted(tuple(r) for r in units.unit_changes(h, "src", ["pos"]).collect())
    assert runs == [("a", 0, "day", 24.0, 0, 199, 200), ("a", 1, "hour", 1.0, 200, 399, 200), ("b", 0, "minute", 1 / 60, 0, 0, 1), ("b", 1, "week", 168.0, 1, 1, 1)]


@pytest.mark.parametrize("text,named", [
    ("Durations are recorded in days until 2020, later in hours.", ["day", "hour"]), ("The duration is in h or days. Durations in weeks were dropped.", ["hour", "day"]),
    ("Durations are in days, hours or minutes.", ["day", "hour", "minute"]), ("Exposure times are hours after launch; weeks of age differ.", ["hour"]),
    ("Duration counts h, not days or weeks.", ["hour"]), ("Durations are in days; samples froze within hours.", ["day"]), ("Durations in days, hours being rare.", ["day"]), (None, []),
])
def test_stated_units(text, named):
    assert units.stated_units(text) == named


def test_history_decides_hours_of_p2_found(spark, tmp_path):
    """Where a statement names several units, p2_found takes the one that the history gives; one unit stands whatever the history says."""
    from strandloom.plans import core_problems as cp

    shift = ["30", "31", "29 days", "29", "720", "30 days", "744", "31 days", "696", "0"]
    rows = [(100 * k + i, acc, dt(2024, 1, 1 + i), v) for k, acc in enumerate("ABCD") for i, v in enumerate(shift)]
    spark.createDataFrame(rows, "row_id long, `id.accession` string, ingested_at timestamp, `study.parameter value.duration` string").write.parquet(f"{tmp_path}/osdr_samples.parquet")
    said = [("A", "Durations are recorded in days until January, later in hours."), ("B", "Durations are recorded in days."), ("B", "Durations are recorded in hours."), ("C", "Durations are recorded in days."), ("D", "Free text.")]
    spark.createDataFrame(said, "accession string, description string").write.parquet(f"{tmp_path}/osdr_studies.parquet")
    got = {r.row_id: r.hours for r in cp.p2_found(spark, str(tmp_path)).collect()}
    both = [720, 744, 696, 696, 720, 720, 744, 744, 696, 0]
    assert [got[i] for i in range(10)] == both and [got[100 + i] for i in range(10)] == both
    assert [got[200 + i] for i in range(10)] == [720, 744, 696, 696, 720 * 24, 720, 744 * 24, 744, 696 * 24, 0]
    assert {k - 300 for k in got if k >= 300} == {2, 5, 7}


REFS = "id long, f string, at timestamp"
PARENTS = "f string, a timestamp, d timestamp"


def _orphans(spark, refs, parents):
    r, p = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
    marks = orp.parent_marks(p, [F.col("f")], F.col("a"), F.col("d"))
    return sorted((x.ref_id, x.status) for x in orp.orphans(r, "id", [F.col("f")], F.col("at"), marks).collect())


def test_orphan_statuses(spark):
    t = lambda n: dt(2024, 1, n)
    parents = [("x", t(5), None), ("y", t(1), t(5)), ("y", t(8), t(9)), ("z", t(20), None), ("never", t(9), t(3)), ("gone", None, None), (None, t(1), None)]
    refs = [(1, "x", t(5)), (2, "x", t(4)), (3, "y", t(4)), (4, "y", t(5)), (5, "y", t(8)), (6, "z", t(10)), (7, "q", t(10)), (8, "never", t(10)), (9, "gone", t(10)), (10, None, t(10)), (11, "x", None), (7, "q", t(10))]
    assert _orphans(spark, refs, parents) == [(2, "late"), (4, "deleted"), (6, "late"), (7, "missing"), (7, "missing"), (8, "missing"), (9, "missing"), (10, "missing"), (11, "undated")]
    assert _orphans(spark, [], parents) == []
    assert len(_orphans(spark, refs, [])) == len(refs)


def test_orphans_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(orp.math, "ceil", lambda x: 5)  # five salts even for a small table
    t = lambda n: dt(2024, 1, 1 + n // 60 // 24, n // 60 % 24, n % 60)
    refs = [(i, "hot" if i % 3 else f"k{i}", t(i)) for i in range(6000)]
    parents = [("hot", t(100), t(3000))]
    got = dict(_orphans(spark, refs, parents))
    want = {i: ("late" if i < 100 else "deleted") if i % 3 else "missing" for i in range(6000) if not (i % 3 and 100 <= i < 3000)}
    assert got == want


TRAITS = dict(delimiters=";,|\t\n", glue=":=")


@pytest.mark.parametrize("text,items", [
    ('batch: 1|tissue:"left, upper lobe"|Sex=male', ["batch: 1", "tissue:left, upper lobe", "Sex=male"]),
    ('"a; b";c', ["a; b", "c"]), ('x;;y; ;', ["x", "y"]), ('tissue:"clone ""B7"""', ['tissue:clone "B7"']), ("[a;b]", ["a", "b"]), ("", []), (None, []), ("a;a", ["a", "a"]),
    ('5" pipe; b', ['5" pipe', "b"]), ('"open; b', ['"open', "b"]), ("age: pool of 3, equal parts; b", ["age: pool of 3, equal parts", "b"]), ("pool of 3, equal partsX", ["pool of 3", "equal partsX"]),
])
def test_split(text, items):
    assert seg.Segmenter(values=["pool of 3, equal parts"], unquoted=True, **TRAITS).split(text) == items


def test_cover_prefers_the_longer_value():
    s = seg.Segmenter(values=["a, b", "b, c, d"], unquoted=True, **TRAITS)
    assert s.split("a, b, c, d") == ["a", "b, c, d"]


def test_ids_with_labels():
    s = seg.Segmenter(delimiters=";,|/ \n", glue="", bind=r"(?i)\bPM(?:ID|C):?$|:$")
    assert s.split("PMID: 12 PMC34/56;PMID:7") == ["PMID: 12", "PMC34", "56", "PMID:7"]


def test_split_field_of_table(spark):
    long = ";".join(f"k{i}: v" for i in range(20_000))
    df = spark.createDataFrame([(1, "a;b", "x"), (2, None, "x"), (3, " NA ", "x"), (4, long, "x"), (1, "a;b", "x")], "k long, t string, item string")
    out = seg.split_field(df, "k", "t", **TRAITS)
    assert out.columns == ["rec_key", "pos", "item"]
    rows = out.collect()
    assert len(rows) == 4 + 20_000
    assert max(r.pos for r in rows) == 20_000
    assert seg.split_field(df.limit(0), "k", "t", **TRAITS).count() == 0


def test_learned_values_come_from_quotes(spark):
    df = spark.createDataFrame([('a:"x, y";b',), ('"x, y"|c',), ('z: "q; r"',), ("plain, text",), (None,)], "t string")
    assert sorted(r.value for r in seg.learned_values(df, "t", ";,|\t\n", ":=").collect()) == ["q; r", "x, y"]  # however rare


def test_known_values_decide_unclear_quotes(spark):
    """The cover changes rows: inner quotes that were not doubled, and a stray quote before a value."""
    sure = [(1, 'batch: "line ""B7""; old"; age: 3'), (2, 'note: "left, upper"'), (3, "age: 3; left, upper")]
    odd = [(4, 'batch: "line "B7"; old"; age: 4'), (5, 'size: "; note: "left, upper"; x: "; y')]
    split = lambda rows: sorted((r.rec_key, r.pos, r.item) for r in seg.split_field(spark.createDataFrame(rows, "k int, t string"), "k", "t", **TRAITS).collect())
    got = {k: [i for key, _, i in split(sure + odd) if key == k] for k in "12345"}
    assert got["1"] == ['batch: line "B7"; old', "age: 3"] and got["2"] == ["note: left, upper"]
    assert got["3"] == ["age: 3", "left", "upper"]  # without quotes a known value is not protected
    assert got["4"] == ['batch: line "B7"; old', "age: 4"]
    alone = [i for key, _, i in split([r for r in odd if r[0] == 4])]
    assert alone != got["4"] and len(alone) == 3
    assert "note: left, upper" in got["5"]


def test_every_text_meets_the_whole_dictionary(spark, monkeypatch):
    """Known values of all rows are in the automaton of each text, whether its quotes are clear, unclear or absent."""
    rows = [(1, 'a: "x, y"; b'), (2, '"p; q"'), (3, "plain; text"), (4, 'c: "x, y; "d'), (5, '"no separator"')]

    class Told(seg.Segmenter):
        def split(self, text):
            return [",".join(sorted(v for _, v in self.auto.values()))]

    monkeypatch.setattr(seg, "Segmenter", Told)
    got = {r.rec_key: r.item for r in seg.split_field(spark.createDataFrame(rows, "k int, t string"), "k", "t", **TRAITS).collect()}
    assert got == {k: "p; q,x, y" for k in "12345"}


def test_clear_quotes_stand_against_known_values():
    """A known value does not reach from one clear stretch to another, though its cover would be longer."""
    s = seg.Segmenter(values=[";x;y;z;", 'p"; "q'], **TRAITS)
    assert s.split('"a;";x;y;z;";b"') == ["a;", "x", "y", "z", ";b"]
    assert s.split('"p"; "q"') == ["p", "q"] and s.split('"p""; ""q"; r') == ['p"; "q', "r"]
    assert s.split('k: "p"; "q" r') == ['k: p', '"q" r']
    assert s.split('k: "p"; "q"; "') == ['k: p"; "q', '"']  # unclear: the known value decides


def test_a_long_dictionary_is_narrowed(spark, monkeypatch):
    """The narrowed dictionary gives the rows of the whole one."""
    rows = [(i, t) for i, t in enumerate(['batch: "line ""B7""; old"; age: 3', 'batch: "line "B7"; old"; age: 4', 'size: "; note: "left, upper"; x: "; y', '["left, upper"; "a;"]', "age: 3; left, upper", '"a;";x;";b"', 'n: ";x;"', None, " "] * 3)]
    df = spark.createDataFrame(rows, "k int, t string")
    split = lambda: sorted(tuple(r) for r in seg.split_field(df, "k", "t", **TRAITS).collect())
    want = split()
    monkeypatch.setattr(seg, "LETTERS", 0)
    assert split() == want and ("1", 1, 'batch: line "B7"; old') in want and ("5", 2, "x") in want
