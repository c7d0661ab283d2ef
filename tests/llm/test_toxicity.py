"""The label model against known truths, its share in the result, and odd rows."""

import numpy as np
import pytest

from halocline.llm import toxicity

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(20)]
BAD = ["zonk", "blarg", "frimp", "quib", "snarf", "trund"]


def corpus(n, seed, toxic_share=0.25):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        y = int(rng.random() < toxic_share)
        out.append((" ".join(rng.permutation([*rng.choice(WORDS, 40), *(rng.choice(BAD, 2) if y else [])])), y))
    return out


def test_label_model_recovers_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    truth = (rng.random(4000) < 0.3).astype(int)
    rates = [(0.8, 0.05), (0.7, 0.1), (0.6, 0.02), (0.5, 0.1), (0.9, 0.2)]
    votes = np.stack([(rng.random(4000) < np.where(truth == 1, a, b)).astype(int) for a, b in rates], axis=1)
    clean = -(rng.random(4000) < np.where(truth == 1, 0.05, 0.7)).astype(int)
    votes = np.column_stack([votes, votes[:, 0], clean])  # the sixth copies the first
    posterior, counts = toxicity.label_model(votes)
    assert ((posterior >= 0.5) == (truth == 1)).mean() > 0.95
    assert counts[0] < 0.6 and counts[5] < 0.6 and counts[2] > 0.9


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_posteriors_teach_better_than_wrong_labels(seed):
    """With three in ten labels of toxic texts wrong, the classifier trained on posteriors is the better one."""
    learn, held = corpus(1200, seed), corpus(600, seed + 100)
    rng = np.random.default_rng(seed)
    given = [1 - y if rng.random() < (0.3 if y else 0.05) else y for _, y in learn]
    error = {}
    for weak in (True, False):
        model = toxicity.fit([t for t, _ in learn], given, weak)
        scores = np.array([model.score(t) for t, _ in held])
        error[weak] = ((scores - [y for _, y in held]) ** 2).mean()
        if weak:
            assert all((s >= 0.5) == y for s, (_, y) in zip(scores, held, strict=True))
    assert error[True] < 0.6 * error[False]


def test_words_by_chance_are_no_voters():
    data = corpus(1000, 5)
    found = toxicity.find_lexicon([t for t, y in data if y], [t for t, y in data if not y])
    assert {w for (k, w), n in found if n == 1} == set(BAD)


def test_disguises_and_repeats():
    learn = corpus(800, 7)
    model = toxicity.fit([t for t, _ in learn], [y for _, y in learn])
    at = {name: len(model.voters) + i for i, name in enumerate(toxicity.PATTERNS)}
    votes = lambda t: {k: int(model.votes(t)[i]) for k, i in at.items()}
    assert votes("you z0nk there")["disguised"] == votes("you zooonk!")["disguised"] == 1 and votes("you there")["disguised"] == 0
    assert votes("you there")["no match"] == -1 and votes("a zonk")["no match"] == 0
    assert votes("WE ARE LOUD")["shouting"] == 1 and votes("")["shouting"] == 0
    assert votes(" ".join(WORDS))["long and clean"] == -1


def test_rows_of_every_kind(spark):
    learn = corpus(600, 9)
    docs = [(str(i), t, 1) for i, (t, _) in enumerate(learn)] + [("x", None, 1), (None, "", 1), ("y", "zonk " * 50000, 1), ("y", "zonk " * 50000, 1)]
    df = spark.createDataFrame(docs, "doc_id string, text string, score int")
    labels = spark.createDataFrame([(str(i), y, 0) for i, (_, y) in enumerate(learn)] + [("x", 7, 0), (None, 1, 0)], "doc_id string, toxic int, n int")
    got = toxicity.score_toxicity(df, toxicity.learn(df, labels)).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["predicted"] for r in by["y"]] == [1, 1] and by["y"][0]["score"] == by["y"][1]["score"]
    assert by["x"][0]["score"] == by[None][0]["score"] < 0.5
