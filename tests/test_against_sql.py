"""Queries against their SQL on small tables made of values at the edge of rounding."""

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402


@pytest.fixture
def both(spark, tmp_path):
    def run(query, table, rows):
        """Sorted rows of the query and of its SQL, on a table given as SQL."""
        db, path = duckdb.connect(), tmp_path / f"{table}.parquet"
        db.sql(f"COPY ({rows}) TO '{path}' (FORMAT parquet)")
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
        want = db.sql(entry.oracle_sql()[query])
        got = entry.queries()[query](spark, str(tmp_path)).select(*want.columns).collect()
        return sorted(map(tuple, got), key=repr), sorted(want.fetchall(), key=repr)

    return run


def events(*rows):
    """rows: event_id, user_id, milliseconds from the start of 2024, event_type, value."""
    values = ", ".join(str(r).replace("None", "NULL") for r in rows)
    return f"SELECT event_id::BIGINT AS event_id, make_timestamp((1704067200000 + ms) * 1000) AS ts, user_id::BIGINT AS user_id, event_type::VARCHAR AS event_type, value::DOUBLE AS value FROM (VALUES {values}) v(event_id, user_id, ms, event_type, value)"


@pytest.mark.parametrize("share", [0.145, 0.285, 0.565, 0.575, 0.5045, 0.5055, 0.125, 0.375])
def test_confidence_is_rounded_as_in_sql(both, share):
    # Word 1 lasts from 900 to 1000 s; the segment of event 9 covers its end.
    got, want = both("assign_overlap", "events", events((1, 1, 0, "a", 40.0), (9, 1, round(1000 * (1000 - 100 * share)), "b", 40.0)))
    assert got == want and len(got) == 2


@pytest.mark.parametrize("ms,value,other", [(888598, 20.68, 14748598), (98418, 159.87, 13958418), (453789, 199.05, 14313789)])
def test_nearest_tie_goes_to_the_first_segment(both, ms, value, other):
    # The middle of word 8 is as far from its own segment as from that of event 9, give or take the last bit of the clock.
    got, want = both("assign_overlap", "events", events((8, 1, ms, "a", value), (9, 1, other, "b", 1.0)))
    assert got == want and (1, 8, "a", 0.0) in got


def test_words_under_unnamed_segments(both):
    got, want = both("assign_overlap", "events", events((9, 1, 0, None, 40.0), (18, 1, 10**7, "b", 40.0), (9, 2, 0, "a", 40.0), (8, 3, 0, None, 40.0)))
    assert got == want and (1, 9, None, None) in got


def levels(*calls):
    """calls: decibels of each frame; a level is made of a vector's first number a as -90 + 300 |a|."""
    rows = ", ".join(f"({100 * c + k}, {(90 + db) / 300})" for c, frames in enumerate(calls) for k, db in enumerate(frames))
    return f"SELECT vec_id::BIGINT AS vec_id, [a, 0, 0]::FLOAT[] AS embedding FROM (VALUES {rows}) v(vec_id, a)"


def test_gate_on_its_edge(both):
    # As doubles, -69.51 + 6 is less than -63.51, and -72.54 + 6 is not less than -66.54.
    calls = [[floor] * 5 + [floor + d for d in (5.97, 6, 6.03)] for floor in (-69.51, -72.54, -71.28)]
    got, want = both("energy_gate", "embeddings", levels(*calls, [-90, -80, -90], [-90] + [-60] * 5 + [-53.97]))
    assert got == want and [r[1] for r in got if r[2]] == [7, 7, 7, 6]
