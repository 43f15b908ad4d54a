"""O10 against Python's ISO parser on generated stamps (the reference parses with
``datetime.fromisoformat(value.rstrip("Z"))`` and drops the offset)."""
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rivulet.functions.expr import parse_naive_utc


def _python(s):
    try:
        d = dt.datetime.fromisoformat(s.rstrip("Z"))
    except ValueError:
        return None
    return d.replace(tzinfo=None)


def _hms(draw, ext, hour_max=25):
    sep = ":" if ext else ""
    s = f"{draw(st.integers(0, hour_max)):02d}"
    for _ in range(draw(st.integers(0, 2))):
        s += f"{sep}{draw(st.integers(0, 61)):02d}"
    if draw(st.booleans()):
        s += draw(st.sampled_from(".,")) + "".join(draw(st.lists(
            st.sampled_from("0123456789"), min_size=1, max_size=8)))
    return s


@st.composite
def stamps(draw):
    y = draw(st.integers(1, 9999))
    m = draw(st.integers(0, 13))
    d = draw(st.integers(0, 32))
    s = f"{y:04d}-{m:02d}-{d:02d}" if draw(st.booleans()) else f"{y:04d}{m:02d}{d:02d}"
    if draw(st.booleans()):
        s += draw(st.sampled_from(["T", " ", "X", "+", "_"]))
        s += _hms(draw, draw(st.booleans()))
        if draw(st.booleans()):
            s += draw(st.sampled_from(["+", "-"])) + _hms(draw, draw(st.booleans()), 24)
    s += "Z" * draw(st.integers(0, 2))
    return s


JUNK = ["", "Z", "bad", "2024", "2024-01", "2024-1-5", "not-a-dateZ", "2024-01-05T",
        "2024-01-05 10:00:00 ", " 2024-01-05", "2024-01-05+02:00", "2024-01-0510:00",
        "20240105", "20240105T1030", "2024-01-05T10:3015", "2024-01-05T10:00+02:0030",
        "2024-01-05T10:00+0230", "202401051030", "2024-0105", "2024-01-05T10.5",
        "2024-01-05T1030:15", "2024-01-05T10301", "2024-01-05T1030159", "2024-01-05T10+020",
        "2024-01-05T10.5+02", "2024-01-05T10+02:00.5"]


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(stamps(), min_size=300, max_size=300))
def test_parse_matches_python_on_supported_grammar(spark, values):
    values = values + JUNK
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r[0] for r in df.select(parse_naive_utc("x")).collect()]
    want = [_python(v) for v in values]
    bad = [(v, g, w) for v, g, w in zip(values, got, want) if g != w]
    assert not bad, bad[:10]
    # the oracle's SQL form of the same parser agrees too
    import duckdb
    from rivulet.plans.oracle import parse_naive_utc as sql_parse
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    duck = [r[0] for r in con.execute(f"SELECT {sql_parse('x')} FROM t ORDER BY i").fetchall()]
    bad = [(v, g, w) for v, g, w in zip(values, duck, want) if g != w]
    assert not bad, bad[:10]
