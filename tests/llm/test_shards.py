"""What a task holds of a shard once it is done with it."""

import weakref

import pyarrow as pa

from skeinwork.llm import phrases


def test_a_shard_has_gone_before_the_next_one_grows():
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["a b c"] * 4)], ["lang", "text"])
    shards = phrases._shards(iter([batch, batch]), 4)
    first = next(shards)
    held = weakref.ref(first)
    del first
    assert held() is None
    assert sum(s.size for s in shards) > 0
