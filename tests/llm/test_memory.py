"""What the pipeline's tasks leave behind in their Python workers."""

from __future__ import annotations

import pytest

from crosslight.llm import common, minhash, mixing, toxicity


def test_memory_is_given_back_before_and_after_a_task(monkeypatch):
    """Also where a task has no batch, is left before its end, or fails."""
    steps = []
    monkeypatch.setattr(common, "release", lambda: steps.append("release"))

    @common.tidied
    def run(batches):
        for x in batches:
            steps.append(x)
            yield 1 / x

    assert list(run(iter([1, 2]))) == [1, 0.5] and steps == ["release", 1, 2, "release"]
    steps.clear()
    assert list(run(iter([]))) == [] and steps == ["release", "release"]
    steps.clear()
    left = run(iter([1, 2]))
    next(left)
    left.close()
    assert steps == ["release", 1, "release"]
    with pytest.raises(ZeroDivisionError):
        list(run(iter([0])))
    assert steps[-1] == "release"


def test_the_stages_tasks_give_their_memory_back(spark, monkeypatch):
    """All functions that three stages hand to Spark for whole tasks."""
    rows = spark.createDataFrame([(f"some words {k} here", k % 2) for k in range(20)], "text string, label int")
    kind, seen = type(rows), []
    made = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, f, *a, **k: (seen.append(f), made(self, f, *a, **k))[1])
    toxicity.learn(rows)
    mixing.learn(rows, 2)
    minhash.document_frequencies(rows, "text")
    assert len(seen) == 5 and all(hasattr(f, "__wrapped__") for f in seen)
