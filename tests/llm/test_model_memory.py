"""What a task of the language model holds and sends: counts of many pieces, in batches of bounded size."""

import functools
import os
import pickle
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from homelens.llm import bytesets, lm, storage


def drawn(rows=300, words=200):
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 3000, words)) for _ in range(rows)]
    return pa.RecordBatch.from_pydict({"text": texts}), Counter(bytesets.word_hashes(np.frombuffer(" ".join(texts).encode(), np.uint8), np.array([0, len(" ".join(texts))]))[0].tolist())


@pytest.mark.parametrize("held", [500, 10**6])
def test_counts_leave_a_task_in_small_batches(monkeypatch, held):
    batch, want = drawn()
    monkeypatch.setattr(lm, "HELD", held)
    monkeypatch.setattr(lm, "SENT", 100, raising=False)
    shard = lambda keys: (keys >> np.uint64(58)).astype(np.int64)
    give = lambda keys, counts: lm._pack(shard(keys[0]), [keys[0], counts], 64)
    got, most = Counter(), 0
    for out in lm._gathered(iter([batch.slice(k, 30) for k in range(0, 300, 30)]), lambda data, offsets: (bytesets.word_hashes(data, offsets)[0],), give):
        keys, counts = (lm._numbers(pa.Table.from_batches([out]), c, c == "a") for c in "ab")
        assert (np.diff(np.array(out.column("shard"))) > 0).all() and len(keys) == len(counts)
        most = max(most, len(keys))
        for k, n in zip(keys.tolist(), counts.tolist()):
            got[k] += n
    assert got == want
    assert most <= 100 + max(Counter(int(k) >> 58 for k in want).values())


def test_places_in_ranges():
    draw = np.random.default_rng(6)
    lasts = np.concatenate([np.sort(draw.choice(500, n, replace=False)) for n in (1, 2, 7, 300)]).astype("<u4")
    bounds = np.array([0, 1, 3, 10, 310])
    group, wanted = draw.integers(0, 4, 2000), draw.integers(0, 500, 2000).astype("<u4")
    place = lm.Grams._place(lasts, bounds[group], bounds[group + 1] - 1, wanted)
    for g, w, p in zip(group, wanted, place):
        inside = lasts[bounds[g] : bounds[g + 1]]
        assert p == bounds[g] + min(np.searchsorted(inside, w), len(inside) - 1)


def test_shuffles_of_training_leave_the_disk(spark):
    """Each count's shuffle goes when it is done; the setting is as before afterwards."""
    blocks = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    there = lambda: {x.name for x in blocks.rglob("shuffle_*.data")}
    kept, before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None), there()
    lm.train(spark.createDataFrame([(f"a b c{k} d",) for k in range(40)], "text string"))
    for _ in range(40):
        if not (left := there() - before):
            break
        time.sleep(0.25)
    assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == kept


def test_maps_of_a_model_are_few_and_hold_no_file_open(spark, monkeypatch):
    """A worker maps one file for each shard and kind, keeps a bounded number of them mapped and none open."""
    texts = [f"a b c{k} d{k % 7} a c{k % 3} b" for k in range(300)]
    model = lm.train(spark.createDataFrame([(x,) for x in texts], "text string"))
    joined = "\n".join(texts).encode()
    bounds = np.cumsum([0] + [len(x) + 1 for x in texts])
    bounds[-1] -= 1
    words = bytesets.word_hashes(np.frombuffer(joined, np.uint8), bounds)
    maps = lambda: Path("/proc/self/maps").read_text().count(model.folder.removeprefix("file://"))
    opened = lambda: sum(model.folder.removeprefix("file://") in os.path.realpath(x) for x in Path("/proc/self/fd").iterdir())
    want = [x.tolist() for x in model.score(*words)]
    kinds = 7  # words, n-grams of orders 2 and 3, their sums, and what comes before words and bigrams
    assert 0 < maps() <= kinds << model.bits
    if sys.version_info >= (3, 13):
        assert opened() == 0
    monkeypatch.setattr(storage, "map_arrays", functools.lru_cache(maxsize=5)(storage.map_arrays.__wrapped__))
    again = pickle.loads(pickle.dumps(model))
    kept = maps()
    assert [x.tolist() for x in again.score(*words)] == want
    assert maps() <= kept + 5


def test_arrays_of_a_file(tmp_path):
    arrays = [np.arange(5, dtype="<u4"), np.empty(0, "<i8"), np.arange(3, dtype="u1"), np.array([2**40], "<u8")]
    storage.write_arrays(f"file://{tmp_path}/x", *arrays)
    got = storage.map_arrays(f"file://{tmp_path}/x", tuple(a.dtype.str for a in arrays))
    assert [(a.dtype, a.tolist()) for a in got] == [(a.dtype, a.tolist()) for a in arrays]
