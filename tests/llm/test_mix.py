"""Mixing against brute force."""

import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from faultsieve.llm import source_mix as M


def brute_targets(sizes):
    """Water filling by weight under three times each size; sources in order."""
    total = sum(sizes)
    weights = [i % 3 + 1 for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        rest = sum(w for i, w in enumerate(weights) if i not in full and sizes[i])
        if not rest:
            return [3.0 * s for s in sizes]
        level = (total - sum(3 * sizes[i] for i in full)) / rest
        new = {i for i, s in enumerate(sizes) if s and 3 * s <= level * weights[i]} | full
        if new == full:
            return [0.0 if not s else 3.0 * s if i in full else level * weights[i] for i, s in enumerate(sizes)]
        full = new


def rows_of(spec):
    out = []
    for source, sizes in spec.items():
        for n in sizes:
            out.append((len(out), " ".join(["w"] * n) if n else "", source))
    return out


SPEC = {None: [40, 7], "a": [5, 5, 0], "b": [300] * 20, "c": [1], "é": [2000], "z": [0], "": [9] * 50, "B": [120, 3, 1]}


def test_taken_words_meet_targets(documents):
    rows = rows_of(SPEC) + [(0, "w w w", "a"), (0, "w w w", "a"), (500, None, "a"), (None, "w w", "b")]
    got = M.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.slot is None) == (r.taken == 0)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = brute_targets([sizes[s] for s in names])
    assert sum(taken.values()) <= sum(sizes.values()) + len(names)
    for s, w in zip(names, want):
        assert math.isclose(targets[s], w, rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - w) <= 4, (s, taken[s], w)  # words of a few blocks of one word
    assert all(r.source_size == sizes[r.source] for r in got)
    again = M.mix(documents(rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def brute_mix(rows, block):
    """Words taken of each row and its first slot by the same points, in plain Python."""
    sized = [(i, t.split() if t else [], s) for i, t, s in rows]
    names = sorted({s for _, _, s in sized if s is not None}) + ([None] if any(s is None for _, _, s in sized) else [])
    size = [sum(len(w) for _, w, s in sized if s == n) for n in names]
    words = [math.floor(t + 0.5) for t in brute_targets(size)]
    ends = [sum(words[: i + 1]) * M.TURN // sum(words) for i in range(len(words))]
    line = {n: [] for n in names}
    for i, w, s in sized:
        u = hashlib.md5(f"{M.SEED}|{i}|{hashlib.md5(' '.join(w).encode()).hexdigest()}".encode()).hexdigest()
        line[s].append((u, i, len(w)))
    flat = {n: [i for _ in range(3) for u, i, k in sorted(line[n]) for _ in range(k)] for n in names}
    taken, first, rank = defaultdict(int), {}, defaultdict(int)
    for slot in range(-(-sum(size) // block)):
        n = names[next(j for j, e in enumerate(ends) if slot * M.GOLDEN % M.TURN < e)]
        for i in flat[n][rank[n] * block : (rank[n] + 1) * block]:
            taken[i] += 1
            first.setdefault(i, slot)
        rank[n] += 1
    return {i: (taken[i], first.get(i)) for i, _, _ in sized}


def test_schedule_alone_decides(documents, monkeypatch):
    docs = documents(rows_of(SPEC))
    for block in (1, 16, 100):
        want = brute_mix(rows_of(SPEC), block)
        assert {r.doc_id: (r.taken, r.slot) for r in M.mix(docs, block).collect()} == want
    monkeypatch.setattr(M, "point", lambda slot: slot * 0)  # all slots fall to the first source
    got = M.mix(docs, 16).collect()
    assert {r.source for r in got if r.taken} == {""} and all(r.taken == 3 * r.size for r in got if r.source == "")


def test_schedule_is_even(spark, documents):
    docs = documents([(i, "w " * 200, f"s{i % 3}") for i in range(300)])
    placed, pieces = M.plan(docs, block=100)
    slots = pieces.select("slot", "sid").distinct().orderBy("slot").collect()
    assert len(slots) == 600
    seen = defaultdict(int)
    for n, r in enumerate(slots, 1):
        seen[r.sid] += 1
        for sid, share in ((1, 1 / 6), (2, 2 / 6), (3, 3 / 6)):
            assert abs(seen[sid] - n * share) < 3
    assert pieces.groupBy("sid", "k").agg(F.sum("words").alias("n")).where("n <> 100").count() == 0


def test_points_are_those_of_the_golden_ratio(spark):
    slots = [0, 1, 2, 3, 10**6, (1 << 31) + 7, (1 << 39) + 12345]
    got = spark.createDataFrame([(s,) for s in slots], "s long").select("s", M.point(F.col("s")).alias("u")).collect()
    assert all(r.u == r.s * M.GOLDEN % M.TURN for r in got) and abs(M.GOLDEN / M.TURN - (math.sqrt(5) - 1) / 2) < 1e-13


def test_many_sources_stand_in_ranges(documents):
    docs = documents([(i, "w " * (1 + i % 3), f"s{i:05d}") for i in range(3000)])
    got = M.mix(docs).collect()
    want = brute_targets([1 + i % 3 for i in range(3000)])
    for r in got:
        assert math.isclose(r.target, want[r.doc_id], rel_tol=1e-9) and abs(r.taken - r.target) <= 2


def test_mixture_and_empty_tables(documents):
    docs = documents(rows_of({"a": [10] * 4, "b": [10] * 40}) + [(900, "", "b"), (901, None, None)])
    out = M.mixture(docs)
    assert out.schema == docs.schema
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(counts[i] == 3 for i in range(4)) and 900 not in counts and 901 not in counts
    big = documents([(i, "w " * 64, f"s{i % 3}") for i in range(600)])
    order = {r.doc_id: r.slot for r in M.mix(big).collect()}
    sources = [r.source for r in M.mixture(big).collect()]
    assert [sources[:120].count(f"s{i}") for i in range(3)] == [pytest.approx(120 * w / 6, abs=6) for w in (1, 2, 3)] and len(order) == 600
    assert M.mix(documents([])).count() == 0 and M.mixture(documents([])).count() == 0
    assert [r.taken for r in M.mix(documents([(1, None, "a"), (2, "", None)])).collect()] == [0, 0]
