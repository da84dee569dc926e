"""Groups of sorted batches."""

import random

import pyarrow as pa

from histora.llm.common import whole_groups


def test_whole_groups_keep_groups_together_and_lose_no_row():
    rng = random.Random(3)
    for limit in (1, 7, 100):
        sizes = [rng.choice([1, 2, 5, 60]) for _ in range(60)]
        keys = [(i // 3, i) for i, n in enumerate(sizes) for _ in range(n)]
        table = pa.table({"a": [None if a == 0 else a for a, _ in keys], "b": [b for _, b in keys], "row": list(range(len(keys)))})
        batches = [b for start in range(0, len(keys), 11) for b in table.slice(start, 11).to_batches()]
        found = list(whole_groups(iter(batches), ["a", "b"], limit))
        assert [r for t in found for r in t["row"].to_pylist()] == list(range(len(keys)))
        groups = [set(t["b"].to_pylist()) for t in found]
        assert all(x.isdisjoint(y) for i, x in enumerate(groups) for y in groups[i + 1 :])
    assert list(whole_groups(iter([]), ["a"], 3)) == []


def test_a_group_of_many_batches_is_put_together_once(monkeypatch):
    batch = pa.record_batch({"a": [7] * 1000})
    copies = []
    whole = pa.Table.from_batches
    monkeypatch.setattr(pa, "Table", type("T", (), {"from_batches": staticmethod(lambda b: copies.append(len(b)) or whole(b))}))
    found = list(whole_groups(iter([batch] * 300), ["a"], 1000))
    assert [t.num_rows for t in found] == [300_000] and copies == [300]
