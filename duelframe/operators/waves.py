"""Games of many leagues rated in waves of games that share no participant.

A game waits for the previous game of each of its two sides and for nothing else, so games are played
by level of that dependency: all games of a level, of every league in the task and under every parameter
set, are one step on numpy arrays. A new season regresses all participants of a league; that is kept as a
running count of season turns and caught up when a participant plays next, so a season is no barrier.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NO_ID = 1 << 32  # stands for a null participant, which plays as one participant of its league


class _Places:
    """Dense places of integer keys, kept in order of key for lookup by bisection."""

    def __init__(self):
        self.keys, self.places = np.empty(0, "i8"), np.empty(0, "i8")

    def of(self, keys: np.ndarray) -> np.ndarray:
        each, back = np.unique(keys, return_inverse=True)
        new = each[~np.isin(each, self.keys, assume_unique=True)]
        if len(new):
            places = np.concatenate([self.places, len(self.places) + np.arange(len(new))])
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys, kind="stable")
            self.keys, self.places = keys[order], places[order]
        return self.places[np.searchsorted(self.keys, each)][back]

    def __len__(self):
        return len(self.keys)


def _grown(values: np.ndarray, size: int, fill) -> np.ndarray:
    """The array with at least ``size`` rows; it doubles, so growing costs a constant per row."""
    if len(values) >= size:
        return values
    more = np.empty((max(size, 2 * len(values)) - len(values), *values.shape[1:]), values.dtype)
    more[:] = fill
    return np.concatenate([values, more])


def previous_games(home: np.ndarray, away: np.ndarray) -> np.ndarray:
    """For each game and side the earlier game (row) of that participant, else -1."""
    n = len(home)
    games = np.arange(n)
    who = np.concatenate([home, np.where(home == away, -1 - games, away)])  # a side against itself counts once
    seat = np.concatenate([2 * games, 2 * games + 1])
    order = np.lexsort((seat, who))
    who, seat = who[order], seat[order]
    before = np.full(2 * n, -1, "i8")
    follows = np.flatnonzero(who[1:] == who[:-1]) + 1
    before[seat[follows]] = seat[follows - 1]
    return before


def levels(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Games in an order by level of dependency, and the bounds of the levels in it."""
    n = len(before) // 2
    after = np.full(2 * n, 2 * n, "i8")  # the last place stands for no later game
    linked = np.flatnonzero(before >= 0)
    after[before[linked]] = linked
    after = after.reshape(n, 2)
    came = np.zeros(2 * n + 2, "i8")
    came[:-2][before < 0] = 1
    came[-1] = 0
    wave = np.flatnonzero((before.reshape(n, 2) < 0).all(axis=1))
    waves, level = [], 1
    while len(wave):
        waves.append(wave)
        level += 1
        seats = after[wave].ravel()
        seats = seats[seats < 2 * n]
        came[seats] = level
        other = came[seats ^ 1]
        wave = seats[(other > 0) & ((other < level) | (seats & 1 == 0))] >> 1
    bounds = np.cumsum([0, *map(len, waves)])
    return np.concatenate(waves) if waves else np.empty(0, "i8"), bounds


class Waves:
    """Ratings of all participants a task has met, one column per parameter set."""

    def __init__(self, params):
        self.k = np.array([p.k for p in params])
        self.bonus = np.array([p.home_advantage for p in params], "f8")
        self.initial = np.array([p.initial for p in params], "f8")
        self.keep = np.array([p.keep for p in params], "f8")
        self.early = np.array([p.reset_before_read for p in params])
        self.params = list(params)
        self.leagues, self.sides = _Places(), _Places()
        self.rating = np.empty((0, len(params)))
        self.turned = np.empty(0, "i8")  # turns of its league that a participant's rating has seen
        self.season, self.turns = np.empty(0), np.empty(0, "i8")

    def meet(self, league: np.ndarray, *sides: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places of leagues and participants, with room for those not met before."""
        at = self.leagues.of(league)
        self.season, self.turns = _grown(self.season, len(self.leagues), np.nan), _grown(self.turns, len(self.leagues), 0)
        both = self.sides.of(np.concatenate([(at << 34) + s + (1 << 31) for s in sides]))
        self.rating, self.turned = _grown(self.rating, len(self.sides), self.initial), _grown(self.turned, len(self.sides), 0)
        return at, *np.split(both, len(sides))

    def load(self, league, side, year, rating) -> None:
        """Ratings of an earlier run."""
        at, place = self.meet(league, side)
        self.rating[place] = rating[:, None]
        self.turned[place] = self.turns[at]
        np.fmax.at(self.season, at, year)

    def season_turns(self, league, year, scored) -> tuple[np.ndarray, np.ndarray]:
        """Turns of its league before and after each game; scored games of a later season turn it."""
        order = np.argsort(league, kind="stable")
        at, y = league[order], year[order]
        dated = np.flatnonzero(scored[order] & ~np.isnan(y))
        if not len(dated):
            return self.turns[league], self.turns[league]
        lg, ys = at[dated], y[dated]
        first = np.r_[True, lg[1:] != lg[:-1]]
        last = np.where(first, self.season[lg], np.r_[np.nan, ys[:-1]])
        up = np.zeros(len(at), "i8")
        up[dated] = ys > last
        run = np.cumsum(up)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        base = np.repeat(run[starts] - up[starts], np.diff(np.r_[starts, len(at)]))
        after = run - base + self.turns[at]
        ends = np.r_[starts[1:], len(at)] - 1
        self.turns[at[ends]] = after[ends]
        self.season[lg[np.r_[first[1:], True]]] = ys[np.r_[first[1:], True]]
        before, out = np.empty_like(after), np.empty_like(after)
        before[order], out[order] = after - up, after
        return before, out

    def regressed(self, rating: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Ratings after so many season turns, one turn at a time as they would have come."""
        for step in range(int(turns.max(initial=0))):
            rating = np.where((turns > step)[:, None], self.initial + self.keep * (rating - self.initial), rating)
        return rating

    def expect(self, home: np.ndarray, away: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.power(10.0, (away - home - self.bonus) / 400.0))

    def weight(self, gap: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Size of a step per game and parameter set, 0 for games without a result."""
        kinds = {
            "none": lambda p: np.ones(len(gap)),
            "linear": lambda p: 1.0 + gap / p.margin_divisor,
            "log": lambda p: np.log(np.maximum(gap, 1.0) + 1.0),
        }
        each = np.stack([p.k * kinds.get(p.margin, kinds["none"])(p) for p in self.params], axis=1)
        return np.where(scored[:, None], each, 0.0)

    def play(self, league, home, away, year, home_score, away_score):
        """Rows in an order by level, with ratings before, the probability, and ratings after.

        Scores are NaN where missing. Games come in the order of the chain of their league.
        """
        at, home, away = self.meet(league, home, away)
        scored = ~(np.isnan(home_score) | np.isnan(away_score))
        gap = np.where(scored, home_score - away_score, 0.0)
        seen, then = self.season_turns(at, year, scored)
        before = previous_games(home, away)
        # turns a side has to catch up: since its previous game here, or since what it brought along
        prior = before.reshape(-1, 2)
        known = np.where(prior >= 0, then[np.maximum(prior, 0) >> 1], self.turned[np.stack([home, away], axis=1)])
        lag = np.where((home == away)[:, None], (seen - known[:, 0])[:, None], seen[:, None] - known)
        order, bounds = levels(before)
        home, away, gap, seen, then, scored, lag = (v[order] for v in (home, away, gap, seen, then, scored, lag))
        step, result, turn = self.weight(np.abs(gap), scored), (np.sign(gap)[:, None] + 1.0) / 2.0, then - seen
        behind = np.maximum(lag.max(axis=1, initial=0), turn)
        stale = np.maximum.reduceat(behind, bounds[:-1]) > 0 if len(order) else np.empty(0, bool)
        read_h, read_a, new_h, new_a = (np.empty((len(order), len(self.params))) for _ in range(4))
        rating = self.rating
        for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            hs, as_ = home[lo:hi], away[lo:hi]
            h, a = rating[hs], rating[as_]
            if stale[i]:
                h, a = self.regressed(h, lag[lo:hi, 0]), self.regressed(a, lag[lo:hi, 1])
                early = self.early & (turn[lo:hi] > 0)[:, None]
                h2, a2 = self.regressed(h, turn[lo:hi]), self.regressed(a, turn[lo:hi])
                read_h[lo:hi], read_a[lo:hi] = np.where(early, h2, h), np.where(early, a2, a)
                h, a = h2, a2
            else:
                read_h[lo:hi], read_a[lo:hi] = h, a
            d = step[lo:hi] * (result[lo:hi] - self.expect(h, a))
            h += d
            a -= d
            new_h[lo:hi], new_a[lo:hi] = h, a
            rating[hs], rating[as_] = h, a
        np.maximum.at(self.turned, home, then)
        np.maximum.at(self.turned, away, then)
        return order, scored, read_h, read_a, self.expect(read_h, read_a), new_h, new_a


def _floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def fold(params, block_size: int, schema: pa.Schema):
    """Arrow batches of games, sorted by block of parameter sets and then in time, to rated games."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waves = None, None
        for whole in batches:
            blocks = whole.column("block").to_numpy()
            cuts = np.r_[0, np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, len(blocks)] if len(blocks) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if blocks[lo] != block:
                    block = int(blocks[lo])
                    waves = Waves(params[block * block_size : (block + 1) * block_size])
                yield from rated(waves, block * block_size, whole.slice(lo, hi - lo))

    def rated(waves: Waves, first: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start = batch.filter(batch.column("saved").is_valid())
        if len(start):
            waves.load(_ids(start, "league"), _ids(start, "home_id"), _floats(start, "year"), _floats(start, "saved"))
            batch = batch.filter(batch.column("saved").is_null())
        if not len(batch):
            return
        order, scored, *found, new_h, new_a = waves.play(
            *(_ids(batch, c) for c in ("league", "home_id", "away_id")),
            *(_floats(batch, c) for c in ("year", "home_score", "away_score")),
        )
        kept = batch.select(["league", "match_id", "year", "home_id", "away_id"]).take(pa.array(order)).columns
        for c in range(new_h.shape[1]):
            config = pa.array(np.full(len(order), first + c, "i4"))
            read = [pa.array(v[:, c]) for v in found]
            after = [pa.array(v[:, c], mask=~scored) for v in (new_h, new_a)]
            yield pa.RecordBatch.from_arrays([config, *kept, *read, *after], schema=schema)

    return over
