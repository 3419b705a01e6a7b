from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.shared import covered, merge_runs
from tidemark.llm.words import Words, buffers, hash_spans, rolling, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x1c 日", max_size=30)), max_size=6))
def test_words_are_those_of_the_pattern(texts: list[str | None]) -> None:
    data, offsets = buffers(pa.array(texts, pa.string()))
    words = Words(data, offsets)
    told = [data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert [told[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)] == [WORD.findall(t or "") for t in texts]
    hashes = hash_spans(data, words.starts, words.ends)
    for width in (1, 2, 3, 5, 7):
        rolled = rolling(hashes, width)
        groups: dict[tuple, set[int]] = {}
        for i in range(len(told) - width + 1):
            groups.setdefault(tuple(told[i : i + width]), set()).add(int(rolled[i]))
        assert all(len(v) == 1 for v in groups.values())
        assert len(set().union(*groups.values())) == len(groups)


def test_long_words_hash_by_content() -> None:
    data, offsets = buffers(pa.array(["a" * 300, "a" * 300, "a" * 301, "b" + "a" * 299, "a" * 250, "a" * 250 + "b"]))
    words = Words(data, offsets)
    a, b, *rest = hash_spans(data, words.starts, words.ends)
    assert a == b and len({a, *rest}) == 5


def test_slices_keep_rows_whole() -> None:
    batch = pa.record_batch({"text": pa.array(["x" * 10, None, "y" * 100, "", "z" * 5])})
    parts = list(slices(batch, limit=20))
    assert [t for p in parts for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert len(parts) == 3


def test_intervals() -> None:
    starts, ends = merge_runs(np.array([0, 2, 9, 9]), np.array([3, 4, 10, 12]))
    assert (starts.tolist(), ends.tolist()) == ([0, 9], [4, 12])
    assert covered(np.array([1, 2]), np.array([3, 9]), 5).tolist() == [False, True, True, True, True]
