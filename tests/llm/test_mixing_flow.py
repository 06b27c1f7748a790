"""The mixing operator's flow against all integer flows of small networks, and its time on many patterns."""

import itertools
import random
import time

from waymark.llm import mixing


def _every(total, sources):
    """All ways to give up to total tokens to the sources."""
    if not sources:
        yield {}
        return
    for n in range(total + 1):
        for rest in _every(total - n, sources[1:]):
            yield {sources[0]: n} | rest


def _cost(given, capacity):
    return sum(max(0, given - k * capacity) for k in range(1, mixing.MAX_PASSES))


def _brute_force(capacity, quota, passes):
    best = None
    for chosen in itertools.product(*(list(_every(passes * c, p)) for p, c in capacity.items())):
        taken = {s: sum(x.get(s, 0) for x in chosen) for s in quota}
        if all(taken[s] <= q for s, q in quota.items()):
            value = (-sum(taken.values()), sum(_cost(sum(x.values()), c) for x, c in zip(chosen, capacity.values())))
            best = value if best is None else min(best, value)
    return best


def test_flow_is_largest_and_cheapest():
    rng = random.Random(3)
    for _ in range(150):
        names = ["a", "b", None][: rng.randint(1, 3)]
        every = [p for n in range(1, len(names) + 1) for p in itertools.combinations(names, n)]
        capacity = {p: rng.randint(0, 2) for p in rng.sample(every, min(len(every), rng.randint(1, 3)))}
        quota = {s: rng.randint(0, 7) for s in names}
        found = mixing.flow(capacity, quota)
        for p, by in found.items():
            assert set(by) <= set(p) and all(n > 0 for n in by.values()) and sum(by.values()) <= mixing.MAX_PASSES * capacity[p]
        assert all(sum(by.get(s, 0) for by in found.values()) <= q for s, q in quota.items())
        given = [sum(by.values()) for by in found.values()]
        assert (-sum(given), sum(map(_cost, given, capacity.values()))) == _brute_force(capacity, quota, mixing.MAX_PASSES)


def test_flow_without_patterns_or_sources():
    assert mixing.flow({}, {}) == {} and mixing.flow({(): 5}, {"a": 3}) == {(): {}} and mixing.flow({("a",): 0}, {"a": 3}) == {("a",): {}}


def test_many_patterns_take_seconds():
    rng = random.Random(5)
    names = [f"s{i}" for i in range(60)]
    capacity = {}
    while len(capacity) < 20_000:
        capacity[tuple(sorted(rng.sample(names, rng.randint(1, 5))))] = rng.randint(1, 10_000)
    total = sum(capacity.values())
    target = mixing.targets([sum(c for p, c in capacity.items() if s in p) for s in names], [1 + i % 3 for i in range(60)])
    began = time.time()
    found = mixing.flow(capacity, {s: round(t * total / sum(target)) for s, t in zip(names, target)})
    assert time.time() - began < 60
    assert sum(n for by in found.values() for n in by.values()) > 0.99 * total
