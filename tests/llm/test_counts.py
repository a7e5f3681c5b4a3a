"""Ids of the vocabulary are counted by batch."""

import numpy as np
import pyarrow as pa

from segmint.llm import binary


def test_ids_are_counted_once_a_batch(monkeypatch):
    """Each count is as long as the vocabulary, so not one a text."""
    texts = [np.array(x, "<u2") for x in ([1, 5, 5], [], [65535, 1], [5])]
    batches = [pa.record_batch([pa.array([x.tobytes() for x in part], pa.binary())], ["ids"]) for part in (texts[:3], texts[3:], [])]
    calls, found, count = [], [], np.bincount
    monkeypatch.setattr(binary.np, "bincount", lambda x: calls.append(len(x)) or count(x))

    class Rows:
        def select(self, _):
            return self

        def mapInArrow(self, run, _):
            found.extend(run(iter(batches)))
            return self

        groupBy = agg = lambda self, *_: self

    monkeypatch.setattr(binary.F, "sum", lambda c: type("C", (), {"alias": lambda self, n: self})())
    binary.count_ids(Rows(), "<u2")
    assert {r["token"]: r["n"] for b in found for r in b.to_pylist()} == {1: 2, 5: 3, 65535: 1}
    assert len(calls) == len(batches)
