"""What a group's result and a chunk of texts may hold at once; small rows of their own."""

import numpy as np
import pyarrow as pa

from segmint.llm import common, jaccard_join, packing, suffix_dedup, tokens


def _raw(values, kind):
    return pa.array([np.asarray(values, kind).tobytes()], pa.binary())


def test_group_results_leave_in_batches():
    n = 70_000
    twice = np.arange(2 * n) // 2
    found = jaccard_join._repeated(pa.table({
        "bucket": [3], "docs": _raw(np.arange(2 * n), "<i8"), "kinds": _raw(np.zeros(2 * n), "u1"),
        "units": _raw(np.zeros(2 * n), "u1"), "low": _raw(twice, "<u4")}))
    met = suffix_dedup._met(pa.table({
        "rows": _raw(np.arange(2 * n), "<i8"), "places": _raw(np.zeros(2 * n), "<u2"), "places2": _raw(np.zeros(2 * n), "<u2"),
        "low": _raw(twice, "<u4"), "high": _raw(np.zeros(2 * n), "u1")}))
    for t, column in ((found, "id"), (met, "row")):
        assert sorted(t.column(column).to_pylist()) == list(range(2 * n))
        assert max(b.num_rows for b in t.to_batches()) <= 1 << 15
    empty = common.in_batches(pa.table({"a": pa.array([], pa.int64())}))
    assert empty.num_rows == 0 and empty.schema == pa.schema([("a", pa.int64())])


def test_packing_encodes_few_bytes_at_once(spark, monkeypatch):
    """Pieces are made of chunks of 4 MB of text, not of 8."""
    held = []

    class Fake:
        def encode(self, texts, end):
            held.append(sum(map(len, texts)))
            return [np.array([1, end], np.uint32) for _ in texts]

    monkeypatch.setattr(packing, "encoder", lambda *_: Fake())
    found = []

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            text = "a" * (1 << 20)
            found.extend(run([pa.record_batch([pa.array(range(7), pa.int64()), pa.array([text] * 7)], ["doc_id", "text"])]))

    packing.pieces_of(Rows(), "unused")
    assert sum(b.num_rows for b in found) == 7 and sum(held) == 7 << 20 and max(held) <= tokens.CHUNK_BYTES
