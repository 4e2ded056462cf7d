"""Near duplicates against all pairs, and how little of them is moved."""

import random

import numpy as np
import pyarrow as pa

from clauselake.operators import shingle_sets, similar


def brute(left, right, threshold, n):
    def grams(text):
        w = text.split()
        return {" ".join(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()

    sets = [[(i, grams(t)) for i, t in side] for side in (left, right)]
    return sorted((i, j, len(a & b)) for i, a in sets[0] for j, b in sets[1] if a and b and len(a & b) / len(a | b) >= threshold)


def test_signatures_and_sets():
    words = pa.array([[1, 2, 1, 2, 3], [], [7], None, [1, 2]], pa.list_(pa.int64()))
    row, gram = shingle_sets.sets(words, 2)
    assert np.bincount(row, minlength=5).tolist() == [3, 0, 1, 0, 1]
    assert gram[row == 4][0] in gram[row == 0] and gram[row == 2][0] not in gram[row == 0]


def test_near_duplicates_equal_all_pairs(spark):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    left = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(0, 60)))) for i in range(60)]
    right = [(i, " ".join(w for w in t.split() if draw.random() < draw.choice([0.5, 0.8, 1]))) for i, t in left] + [(99, left[7][1]), (98, left[7][1])]
    frames = [spark.createDataFrame(x, "id int, text string") for x in (left, right)]
    got = similar.near_duplicates(*frames, 0.3, 2)
    # What is left to the caller's job is small: keys and ids, neither texts nor shingles.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" not in plan and "text" not in plan
    assert sorted((r.left_id, r.right_id, r.shared) for r in got.collect()) == brute(left, right, 0.3, 2)
