"""Regions of near-dedup that lie across two ranges."""

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import near_dedup


@pytest.mark.parametrize("first", [1, 40, 64, 90])
def test_rows_on_both_sides_of_a_boundary_share_a_name(first):
    keys = np.concatenate([np.full((120, near_dedup.DEPTH), 7), np.arange(120 * (near_dedup.KEY - near_dedup.DEPTH)).reshape(120, -1)], axis=1).astype(">u4")

    def names(at):
        b = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), dtype=np.int32)), pa.array([keys[i].tobytes() for i in at], pa.binary()), pa.array(at, pa.int64())], names=["tree", "key", "id"])
        rows = [x for out in near_dedup._regions(iter([b])) for x in out.to_pylist()]
        return {(x["kind"], x["a"], x["b"]) for x in rows if x["kind"] in (near_dedup.MEMBER, near_dedup.REGION)}

    found = names(list(range(first))) | names(list(range(first, 120)))
    held = [{(k, a) for k, a, b in found if b == i} for i in range(120)]
    assert all(held[0] & x for x in held)
