"""Speaker clustering: linkage against all pairs, two levels against one, labels of segments."""

import itertools

import numpy as np
import pandas as pd
import pytest

from voxtable.operators import embeddings

EMB = "recording_id long, pos long, vec array<double>, strict boolean"


def all_pairs(x, limit, most):
    """Average linkage by the mean of all pairs' distances, merging until the limit, or on to ``most`` clusters."""
    far = 1 - x @ x.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        d, a, b = min((far[np.ix_(a, b)].mean(), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        if d >= limit and len(groups) <= most:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def partition(labels):
    return {frozenset(np.flatnonzero(np.asarray(labels) == k).tolist()) for k in set(labels)}


def voices(seed, sizes, spread, dims=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(len(sizes), dims))
    who = np.repeat(np.arange(len(sizes)), sizes)
    rng.shuffle(who)
    x = centres[who] + spread * rng.normal(size=(len(who), dims))
    return who, x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("seed", range(6))
def test_linkage_by_all_pairs(seed):
    _, x = voices(seed, (8, 7, 5), 0.5)
    x[3] = x[9]
    for limit, most in ((0.35, 6), (0.1, 6), (0.6, 2)):
        frame = pd.DataFrame({"vec": list(x), "strict": False})
        got = embeddings._decide(frame, most, limit, gate=False)
        assert partition(got) == all_pairs(x, limit, most)


def frame(spark, recordings):
    rows = [(k, i, [float(v) for v in vec], strict) for k, (x, strict) in recordings.items() for i, vec in enumerate(x)]
    return spark.createDataFrame(rows, EMB)


@pytest.mark.parametrize("gate", [True, False])
def test_two_levels_are_one_while_directions_are_few(spark, gate):
    """Many copies of few directions: features are exact, so labels are those of one task, for several levels of blocks."""
    rng = np.random.default_rng(3)
    recordings = {}
    for k, strict in ((1, False), (2, True), (None, False)):
        _, x = voices(5 + (k or 0), (3, 3), 0.3)
        recordings[k] = (x[rng.integers(0, len(x), 900)], strict)
    recordings[4] = (voices(9, (5, 5), 0.3)[1], False)
    df = frame(spark, recordings)
    run = (lambda bound: embeddings.cluster_speakers(df, strict=df["strict"], bound=bound)) if gate else (lambda bound: embeddings.cluster_windows(df, bound=bound))
    for got, want in zip(*({k: labels(run(b), k) for k in recordings}.items() for b in (64, 2048)), strict=True):
        assert partition(got[1]) == partition(want[1]), got[0]


def labels(df, key):
    rows = sorted((r["pos"], r["label"]) for r in df.collect() if r["recording_id"] == key)
    assert [p for p, _ in rows] == list(range(len(rows)))
    return [x for _, x in rows]


def test_two_levels_agree_on_many_directions(spark):
    """3 000 different directions in blocks of 128: measured agreement of pairs with the true voices."""
    who, x = voices(11, (1600, 900, 500), 0.25, 24)
    got = np.array(labels(embeddings.cluster_speakers(frame(spark, {1: (x, False)}), bound=128), 1))
    one = embeddings._decide(pd.DataFrame({"vec": list(x[:1500]), "strict": False}), 6, 0.35, gate=True)
    same = lambda a: a[:, None] == a[None, :]
    agreement = (same(got) == same(who)).mean()
    exact = (same(one) == same(who[:1500])).mean()
    assert agreement >= min(0.99, exact - 0.01), (agreement, exact)


def test_global_voices(spark):
    who, x = voices(2, (40, 40, 40), 0.1)
    got = embeddings.cluster_global(frame(spark, {1: (x, False)}), 3).collect()
    found = {}
    for r in got:
        found.setdefault(r["voice"], set()).add(int(who[r["pos"]]))
    assert sorted(map(sorted, found.values())) == [[0], [1], [2]]


def test_labels_of_segments(spark):
    """Regions where a recording has three usable ones, windows elsewhere; also for a recording without an id."""
    _, x = voices(4, (6, 6), 0.1)
    region = [(k, i, float(i), i + (0.1 if k == 2 else 1.0), [float(v) for v in x[i]]) for k in (1, 2, None) for i in range(12)]
    window = [(k, i, i * 0.5, i * 0.5 + 0.6, [float(v) for v in x[i % 12]]) for k in (1, 2, None) for i in range(20)]
    schema = "recording_id long, pos long, start_sec double, end_sec double, vec array<double>"
    got = embeddings.label_speakers(spark.createDataFrame(region, schema), spark.createDataFrame(window, schema)).collect()
    count = {k: sum(r["recording_id"] == k for r in got) for k in (1, 2, None)}
    assert count == {1: 12, 2: 20, None: 12}
    for k in (1, None):
        mine = [r["speaker"] for r in sorted(got, key=lambda r: r["pos"]) if r["recording_id"] == k]
        assert set(mine) == {"Speaker 1", "Speaker 2"} and mine[0] == "Speaker 1"
