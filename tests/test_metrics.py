"""The stored 8 x 8 confusion matrix, clustering and the dialogue rule."""

import numpy as np

from voxtable.operators import embeddings, metrics, speakers

MATRIX = [
    [4, 5, 0, 8, 0, 2, 0, 0], [7, 27, 0, 3, 0, 0, 1, 0], [1, 0, 0, 6, 9, 4, 9, 9], [4, 7, 0, 13, 1, 5, 5, 3],
    [0, 0, 0, 0, 19, 1, 14, 5], [5, 0, 0, 4, 4, 7, 6, 13], [2, 3, 0, 1, 2, 0, 30, 0], [3, 0, 0, 0, 0, 1, 3, 32],
]


def predictions(spark):
    rows = [(a, b) for a, line in enumerate(MATRIX) for b, n in enumerate(line) for _ in range(n)]
    return spark.createDataFrame(rows, "y_true int, y_pred int")


def test_stored_scores(spark):
    s = metrics.score_summary(predictions(spark), 8).first()
    assert s.n_samples == 288
    got = [round(x, 6) for x in (s.accuracy, s.balanced_accuracy, s.macro_precision, s.macro_f1, s.micro_f1, s.weighted_f1)]
    assert got == [0.458333, 0.442476, 0.377287, 0.394931, 0.458333, 0.409950]


def test_stored_matrix(spark):
    cells = {(r.y_true, r.y_pred): r.n for r in metrics.confusion_matrix(predictions(spark), 8).collect()}
    assert cells == {(a, b): MATRIX[a][b] for a in range(8) for b in range(8)}


def brute_force_clusters(x, k):
    """Average linkage by definition: mean pairwise cosine distance."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x @ x.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        pairs = [(d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_linkage_from_sums_is_average_linkage():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    merges = embeddings.average_linkage(unit, np.ones(40))
    for k in (2, 3, 7):
        labels = embeddings.cut_tree(40, merges[: 40 - k])
        got = {frozenset(np.flatnonzero(labels == v)) for v in set(labels)}
        assert got == brute_force_clusters(x, k)


def test_two_voices_are_found(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(12):
        centre = np.eye(6)[i % 2] * 4
        rows.append((1, i, [float(v) for v in centre + rng.normal(size=6) * 0.1]))
        rows.append((2, i, [float(v) for v in np.eye(6)[0] * 4 + rng.normal(size=6) * 0.01]))
    df = spark.createDataFrame(rows, "recording_id long, pos long, vec array<double>")
    labels = embeddings.cluster_speakers(df).collect()
    first = [r.label for r in sorted(labels, key=lambda r: r.pos) if r.recording_id == 1]
    assert len(set(first[::2])) == 1 and len(set(first[1::2])) == 1 and first[0] != first[1]


def test_dialogue(spark):
    text = "Welcome all. Good morning Mrs. Roy. Hello Mrs. Gupta. How are you? I am fine. Nice day."
    df = spark.createDataFrame([(1, text), (2, "Only one voice. Nothing else.")], "recording_id long, text string")
    got = speakers.dialogue_from_text(df).orderBy("turn").collect()
    assert {r.recording_id for r in got} == {1}
    assert [(r.speaker, r.text) for r in got] == [
        ("Speaker 1", "Welcome all. Good morning Mrs. Roy."),
        ("Speaker 2", "Hello Mrs. Gupta. How are you?"),
        ("Speaker 1", "I am fine."),
        ("Speaker 2", "Nice day."),
    ]
