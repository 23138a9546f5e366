"""Games played in waves against the same games played one by one."""

from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from duelframe.operators.ratings import RatingParams, _Chain, rate
from duelframe.operators.waves import NO_ID, Waves, levels, previous_games

PARAMS = [
    RatingParams(),
    RatingParams(k=40.0, margin="log", keep=0.5, reset_before_read=True),
    RatingParams(k=10.0, margin="linear", margin_divisor=7.0, initial=1000.0, home_advantage=0.0),
    RatingParams(margin="log", reset_before_read=True),
]

games = st.lists(
    st.tuples(
        st.integers(0, 2), st.integers(0, 6), st.integers(0, 6), st.one_of(st.none(), st.integers(2000, 2004)),
        st.one_of(st.none(), st.integers(0, 9)), st.one_of(st.none(), st.integers(0, 9)),
    ),
    max_size=60,
)


def one_by_one(rows, params, start=()):
    chains, out = {}, []
    for league, side, year, rating in start:
        chain = chains.setdefault(league, _Chain(params))
        chain.rating[side] = rating
        chain.season = year if chain.season is None else max(chain.season, year)
    for league, home, away, year, hs, aw in rows:
        out.append(chains.setdefault(league, _Chain(params)).play(year, home, away, hs, aw))
    return out


def in_waves(rows, params, size, start=()):
    waves, out = Waves(params), [[None] * len(rows) for _ in params]
    if start:
        league, side, year, rating = (np.array(c) for c in zip(*start))
        waves.load(league, side, year.astype("f8"), rating.astype("f8"))
    for lo in range(0, len(rows), size):
        part = rows[lo : lo + size]
        ids = [np.array([r[i] for r in part], "i8") for i in range(3)]
        numbers = [np.array([np.nan if r[i] is None else r[i] for r in part], "f8") for i in (3, 4, 5)]
        order, scored, *values = waves.play(*ids, *numbers)
        for c in range(len(params)):
            for at, row in enumerate(order):
                *read, home, away = (float(v[at, c]) for v in values)
                out[c][lo + row] = (*read, *((home, away) if scored[at] else (None, None)))
    return out


@settings(max_examples=150, deadline=None)
@given(games, st.integers(1, 30))
def test_waves_equal_single_games(rows, size):
    got = in_waves(rows, PARAMS, size)
    for c, params in enumerate(PARAMS):
        want = one_by_one(rows, params)
        for g, w in zip(got[c], want, strict=True):
            assert g == pytest.approx(w, abs=1e-9)


def test_saved_ratings_start_the_waves():
    start = [(0, 1, 2001, 1600.0), (0, 2, 2002, 1400.0), (1, 1, 2000, 1500.0)]
    rows = [(0, 1, 2, 2002, 3, 1), (1, 1, 3, 2002, 0, 1), (0, 2, 1, 2003, None, None), (0, 2, 1, 2003, 1, 1), (0, 4, 4, 2004, 2, 1)]
    got = in_waves(rows, PARAMS, 2, start)
    for c, params in enumerate(PARAMS):
        for g, w in zip(got[c], one_by_one(rows, params, start), strict=True):
            assert g == pytest.approx(w, abs=1e-9)


def test_no_wave_holds_a_participant_twice():
    rng = np.random.default_rng(5)
    home, away = rng.integers(0, 40, 2000), rng.integers(0, 40, 2000)
    order, bounds = levels(previous_games(home, away))
    assert sorted(order.tolist()) == list(range(2000))
    place = np.empty(2000, int)
    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
        place[order[lo:hi]] = i
        seen = [s for g in order[lo:hi] for s in {int(home[g]), int(away[g])}]
        assert len(seen) == len(set(seen))
    last = {}
    for g, (h, a) in enumerate(zip(home.tolist(), away.tolist())):
        assert place[g] == 1 + max(last.get(h, -1), last.get(a, -1))
        last[h] = last[a] = place[g]


def test_rate_with_nulls_ties_blocks_and_a_hot_league(spark):
    """A third of the games in one league; null ids, dates and scores; sets over several blocks."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        league = [0, 0, 0, 1, 2, 3, None, 4, 5][i % 9]
        day = None if i % 50 == 0 else date(2000, 1, 1) + timedelta(days=int(rng.integers(0, 1200)))
        home = None if i % 40 == 3 else int(rng.integers(0, 30))
        score = None if i % 17 == 0 else int(rng.integers(0, 40))
        rows.append((league, day, i, day.year if day else None, home, int(rng.integers(0, 30)), score, int(rng.integers(0, 40)), "x"))
    names = "league int, event_date date, match_id long, year int, home_id int, away_id int, home_score int, away_score int, saved string"
    frame = spark.createDataFrame(rows, names).repartition(7)
    got = {(r.config, r.match_id): r for r in rate(frame, PARAMS, sets_per_task=3).collect()}
    assert len(got) == len(rows) * len(PARAMS)
    chained = sorted(rows, key=lambda r: (r[1] is not None, r[1] or date.min, r[2]))
    for c, params in enumerate(PARAMS):
        want = one_by_one([(r[0], r[4], r[5], r[3], r[6], r[7]) for r in chained], params)
        for r, w in zip(chained, want, strict=True):
            g = got[c, r[2]]
            assert (g.league, g.home_id, g.away_id, g.year) == (r[0], r[4], r[5], r[3])
            assert (g.home_elo, g.away_elo, g.home_elo_prob, g.home_after, g.away_after) == pytest.approx(w, abs=1e-9)
    assert rate(frame.limit(0)).count() == 0
    assert NO_ID > 2**31
