"""Route solvers over a node graph held by one task: best-first, line-of-sight smoothed, replanned, ranked, and ant-colony.

A solver takes (Graph, start, goal) and returns (path, cost).  `solve` in graph.py gives each task the
graph once; a pair is one row, so pairs spread over the executors.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np

Edge = tuple[int, int]


@dataclass
class Graph:
    """near: node -> [(node, cost)]; at: node -> (x, y); blocked: nodes no path may use."""

    near: dict[int, list[tuple[int, float]]]
    at: dict[int, tuple[float, float]] = field(default_factory=dict)
    blocked: frozenset[int] = frozenset()

    def distance(self, a: int, b: int) -> float:
        (ax, ay), (bx, by) = self.at[a], self.at[b]
        return math.hypot(ax - bx, ay - by)

    def least_rate(self) -> float:
        """Least cost per metre over all edges, which makes the straight-line guess a lower bound."""
        rates = (c / d for u, vs in self.near.items() for v, c in vs if u in self.at and v in self.at and (d := self.distance(u, v)) > 0)
        return min(rates, default=0.0)


def _walk(back: dict[int, int], start: int, goal: int) -> list[int]:
    path = [goal]
    while path[-1] != start:
        path.append(back[path[-1]])
    return path[::-1]


def path_cost(g: Graph, path: list[int]) -> float:
    """Sum of the cheapest edges along a path; infinite if one is missing."""
    return sum(min((c for w, c in g.near.get(u, ()) if w == v), default=math.inf) for u, v in zip(path, path[1:]))


def astar(g: Graph, start: int, goal: int, penalty: dict[Edge, float] | None = None, shut: frozenset[int] = frozenset()) -> tuple[list[int], float]:
    """Best-first search under a straight-line lower bound; ties go to what was pushed first.

    `penalty` multiplies the cost of single edges (1 or more, so the bound still holds); `shut` adds blocked nodes.
    """
    away = (g.blocked | shut) - {start, goal}
    if start in g.blocked or goal in g.blocked:
        return [], math.inf
    rate = g.least_rate() if goal in g.at else 0.0
    guess = lambda v: rate * g.distance(v, goal) if v in g.at and goal in g.at else 0.0
    best, back, done, n = {start: 0.0}, {}, set(), 0
    queue = [(guess(start), 0, start)]
    while queue:
        _, _, u = heapq.heappop(queue)
        if u == goal:
            path = _walk(back, start, goal)
            return path, path_cost(g, path)
        if u in done:
            continue
        done.add(u)
        for v, c in g.near.get(u, ()):
            if v in away or v in done:
                continue
            cost = best[u] + c * (penalty or {}).get((u, v), 1.0)
            if cost < best.get(v, math.inf):
                best[v], back[v], n = cost, u, n + 1
                heapq.heappush(queue, (cost + guess(v), n, v))
    return [], math.inf


def in_sight(g: Graph, a: int, b: int, clearance: float) -> bool:
    """Whether no blocked node lies within `clearance` of the segment from a to b."""
    if not g.blocked:
        return True
    ax, ay = g.at[a]
    bx, by = g.at[b]
    pts = np.array([g.at[v] for v in g.blocked if v in g.at])
    if not len(pts):
        return True
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    t = np.zeros(len(pts)) if long == 0 else np.clip(((pts[:, 0] - ax) * dx + (pts[:, 1] - ay) * dy) / long, 0, 1)
    return bool((np.hypot(pts[:, 0] - ax - t * dx, pts[:, 1] - ay - t * dy) > clearance).all())


def theta(g: Graph, start: int, goal: int, clearance: float = 35.0, ahead: int = 300) -> tuple[list[int], float]:
    """A cheapest path, then shortcuts to the farthest node in sight, looking at most `ahead` nodes on.

    The cost is that of the shortcut legs: their length times the mean rate of the edges they replace.
    """
    path, cost = astar(g, start, goal)
    if len(path) < 3:
        return path, cost
    out, total, i = [path[0]], 0.0, 0
    while i < len(path) - 1:
        j = next(j for j in range(min(len(path) - 1, i + ahead), i, -1) if j == i + 1 or in_sight(g, path[i], path[j], clearance))
        leg = path[i:j + 1]
        metres = sum(g.distance(u, v) for u, v in zip(leg, leg[1:]))
        spent = path_cost(g, leg)
        total += spent if j == i + 1 or metres == 0 else spent * g.distance(path[i], path[j]) / metres
        out.append(path[j])
        i = j
    return out, total


def replanned(g: Graph, start: int, goal: int, found_blocked: list[tuple[int, frozenset[int]]]) -> tuple[list[int], float]:
    """The walk of an agent that learns of blocked nodes on its way: (steps walked, nodes then found blocked).

    After each discovery the rest is planned again from where the agent stands, without the nodes known by then.
    """
    walked, here, shut, steps = [start], start, frozenset(), 0
    for after, news in sorted(found_blocked, key=lambda x: x[0]):
        path, _ = astar(g, here, goal, shut=shut)
        take = path[1:max(0, after - steps) + 1]
        walked += take
        steps += len(take)
        here, shut = walked[-1], shut | news
        if here == goal:
            return walked, path_cost(g, walked)
    path, _ = astar(g, here, goal, shut=shut)
    return (walked + path[1:], path_cost(g, walked + path[1:])) if path else ([], math.inf)


def ranked(g: Graph, start: int, goal: int, k: int, factor: float = 50.0, most_overlap: float = 0.5) -> list[tuple[list[int], float]]:
    """Up to k paths, cheapest first; an accepted path's edges cost `factor` times as much for the next.

    A candidate that shares more than `most_overlap` of its inner nodes with an accepted path ends the list.
    """
    out: list[tuple[list[int], float]] = []
    penalty: dict[Edge, float] = {}
    while len(out) < k:
        path, cost = astar(g, start, goal, penalty)
        inner = set(path[1:-1])
        if not path or any(path == p or len(inner & set(p[1:-1])) > most_overlap * max(1, len(inner)) for p, _ in out):
            break
        out.append((path, cost))
        for u, v in zip(path, path[1:]):
            penalty[u, v] = penalty[v, u] = factor
    return out


def colony(g: Graph, start: int, goal: int, ants: int = 24, rounds: int = 30, alpha: float = 1.0, beta: float = 2.0, fade: float = 0.25, elite: int = 8, seed: int = 42) -> tuple[list[int], float]:
    """Ant-colony search: the `elite` best ants of a round leave scent; a plain search answers if no ant arrives."""
    rng = np.random.default_rng(seed)
    scent: dict[Edge, float] = {}
    best: tuple[list[int], float] = ([], math.inf)
    for _ in range(rounds):
        arrived = []
        for _ in range(ants):
            path, seen = [start], {start}
            while path[-1] != goal:
                open_ = [(v, c) for v, c in g.near.get(path[-1], ()) if v not in seen and v not in g.blocked]
                if not open_:
                    break
                pull = np.array([scent.get((path[-1], v), 1.0) ** alpha / max(c, 1e-9) ** beta for v, c in open_])
                v = open_[rng.choice(len(open_), p=pull / pull.sum())][0]
                path.append(v)
                seen.add(v)
            if path[-1] == goal:
                arrived.append((path_cost(g, path), path))
        for e in scent:
            scent[e] *= 1 - fade
        for cost, path in sorted(arrived)[:elite]:
            if cost < best[1]:
                best = path, cost
            for e in zip(path, path[1:]):
                scent[e] = scent.get(e, 1.0) + 1 / max(cost, 1e-9)
    return best if best[0] else astar(g, start, goal)


def swarm(loss, low: np.ndarray, high: np.ndarray, particles: int = 20, rounds: int = 50, inertia: float = 0.72, pull: float = 1.49, seed: int = 42) -> tuple[np.ndarray, float]:
    """Particle swarm: the least of `loss` over a box, particles kept inside it."""
    rng = np.random.default_rng(seed)
    low, high = np.asarray(low, float), np.asarray(high, float)
    x = rng.uniform(low, high, (particles, len(low)))
    v = np.zeros_like(x)
    own, own_loss = x.copy(), np.array([loss(p) for p in x])
    for _ in range(rounds):
        top = own[own_loss.argmin()]
        v = inertia * v + pull * rng.random(x.shape) * (own - x) + pull * rng.random(x.shape) * (top - x)
        x = np.clip(x + v, low, high)
        now = np.array([loss(p) for p in x])
        better = now < own_loss
        own[better], own_loss[better] = x[better], now[better]
    return own[own_loss.argmin()], float(own_loss.min())


def marched(slowness: np.ndarray, source: tuple[int, int], step: float = 1.0) -> np.ndarray:
    """Arrival times of |grad T| = slowness from one cell by fast marching, first order; infinite where slowness is not finite."""
    ny, nx = slowness.shape
    t = np.full((ny, nx), math.inf)
    done = ~np.isfinite(slowness)
    if done[source]:
        return t
    t[source] = 0.0
    queue = [(0.0, source)]

    def at(i: int, j: int) -> float:
        return t[i, j] if 0 <= i < ny and 0 <= j < nx else math.inf

    while queue:
        _, (i, j) = heapq.heappop(queue)
        if done[i, j]:
            continue
        done[i, j] = True
        for y, x in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
            if not (0 <= y < ny and 0 <= x < nx) or done[y, x]:
                continue
            a, b = min(at(y - 1, x), at(y + 1, x)), min(at(y, x - 1), at(y, x + 1))
            f = slowness[y, x] * step
            new = min(a, b) + f if abs(a - b) >= f else (a + b + math.sqrt(2 * f * f - (a - b) ** 2)) / 2
            if new < t[y, x]:
                t[y, x] = new
                heapq.heappush(queue, (new, (y, x)))
    return t


def descended(times: np.ndarray, goal: tuple[int, int]) -> list[tuple[int, int]]:
    """Cells from `goal` down the steepest of eight neighbours to the source, given first to last from the source."""
    ny, nx = times.shape
    if not math.isfinite(times[goal]):
        return []
    path = [goal]
    while times[path[-1]] > 0:
        i, j = path[-1]
        near = [((times[i, j] - times[y, x]) / math.hypot(y - i, x - j), (y, x)) for y in range(max(0, i - 1), min(ny, i + 2)) for x in range(max(0, j - 1), min(nx, j + 2)) if (y, x) != (i, j)]
        fall, cell = max(near)
        if fall <= 0:
            return []
        path.append(cell)
    return path[::-1]


def turning(g: Graph, start: int, goal: int, per_turn: float = 0.0, buckets: int = 8, shut: frozenset[Edge] = frozenset()) -> tuple[list[int], float]:
    """Cheapest path when each change of direction bucket costs `per_turn`; states are (node, bucket), so a dearer arrival may win by its direction.

    `shut` holds edges no path may use.  A start that is the goal is a path of one node and no cost.
    """
    if start in g.blocked or goal in g.blocked:
        return [], math.inf

    def bucket(a: int, b: int) -> int:
        if a not in g.at or b not in g.at:
            return -1
        (ax, ay), (bx, by) = g.at[a], g.at[b]
        return int((math.degrees(math.atan2(by - ay, bx - ax)) % 360) / 360 * buckets + 0.5) % buckets

    first = (start, -2)
    best, back, done, n = {first: 0.0}, {}, set(), 0
    queue = [(0.0, 0, first)]
    while queue:
        _, _, state = heapq.heappop(queue)
        if state in done:
            continue
        done.add(state)
        u, way = state
        if u == goal:
            path = [state]
            while path[-1] != first:
                path.append(back[path[-1]])
            return [v for v, _ in path[::-1]], best[state]
        for v, c in g.near.get(u, ()):
            if v in g.blocked or (u, v) in shut:
                continue
            new = (v, bucket(u, v))
            cost = best[state] + c + (per_turn if way != -2 and new[1] != way else 0.0)
            if new not in done and cost < best.get(new, math.inf):
                best[new], back[new], n = cost, state, n + 1
                heapq.heappush(queue, (cost, n, new))
    return [], math.inf


def alternatives(g: Graph, start: int, goal: int, k: int, per_turn: float = 0.0, buckets: int = 8) -> list[tuple[list[int], float]]:
    """Up to k different paths by cost, then nodes, then sequence: each found path is searched again without one of its edges at a time."""
    path, cost = turning(g, start, goal, per_turn, buckets)
    heap = [(cost, len(path), path, frozenset())] if path else []
    out: list[tuple[list[int], float]] = []
    seen: set[tuple] = set()
    while heap and len(out) < k:
        cost, _, path, shut = heapq.heappop(heap)
        if tuple(path) in seen:
            continue
        seen.add(tuple(path))
        out.append((path, cost))
        for edge in zip(path, path[1:]):
            more = shut | {edge}
            other, price = turning(g, start, goal, per_turn, buckets, more)
            if other and tuple(other) not in seen:
                heapq.heappush(heap, (price, len(other), other, more))
    return out


def lanes(g: Graph, start: int, goal: int, backups: int = 1, factor: float = 50.0) -> list[tuple[str, list[int], float]]:
    """Lanes of an undirected pair in the order forward main, forward backups, backward main, backward backups.

    Inner nodes of earlier lanes are locked: a lane first avoids them, and only if no such path exists may use them at `factor` times the cost.
    """
    locked: set[int] = set()
    out = []
    for way, a, b in (("forward", start, goal), ("backward", goal, start)):
        for kind in ["main"] + [f"backup_{i + 1:02d}" for i in range(backups)]:
            path, cost = astar(g, a, b, shut=frozenset(locked))
            if not path or (len(path) == 2 and any(p in (path, path[::-1]) for _, p, _ in out)):
                dear = {(u, v): factor for u, vs in g.near.items() for v, _ in vs if u in locked or v in locked}
                path, cost = astar(g, a, b, dear)
            if not path:
                continue
            out.append((f"{way}_{kind}", path, cost))
            locked |= set(path[1:-1])
    return out


def smooth_route(cost_at, start: tuple[float, float], goal: tuple[float, float], middles: int = 4, spread: float = 0.5, samples: int = 40, seed: int = 42, **how) -> tuple[np.ndarray, float]:
    """A line of start, `middles` free points and goal that a swarm optimises: its length times the mean of `cost_at` along it, plus its turns in radians.

    `cost_at` takes arrays x, y.  Free points stay within `spread` of the distance from the straight line's points.
    """
    a, b = np.array(start, float), np.array(goal, float)
    base = a + np.linspace(0, 1, middles + 2)[1:-1, None] * (b - a)
    reach = spread * max(float(np.hypot(*(b - a))), 1e-9)

    def line(v: np.ndarray) -> np.ndarray:
        return np.vstack([a, v.reshape(-1, 2), b])

    def loss(v: np.ndarray) -> float:
        p = line(v)
        d = np.diff(p, axis=0)
        length = np.hypot(d[:, 0], d[:, 1])
        t = np.linspace(0, 1, samples)
        xy = (p[:-1, None] + t[None, :, None] * d[:, None]).reshape(-1, 2)
        mean = cost_at(xy[:, 0], xy[:, 1]).reshape(len(d), samples).mean(axis=1)
        turn = np.diff(np.arctan2(d[:, 1], d[:, 0]))
        return float((length * mean).sum() + np.abs((turn + np.pi) % (2 * np.pi) - np.pi).sum())

    found, value = swarm(loss, (base - reach).ravel(), (base + reach).ravel(), seed=seed, **how)
    return line(found), value
