import os

import lectern.llm.store as store
import lectern.llm.toxicity as toxicity


def resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def test_written_leaves_no_garbage_in_a_full_heap(spark, monkeypatch):
    jvm = spark.sparkContext._jvm

    def whole_collections():
        beans = jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    def collections_of_a_write(share):
        monkeypatch.setattr(store, "HEAP_SHARE", share, raising=False)
        before = whole_collections()
        rows = store.written(spark.range(3), path := store.scratch(spark, "numbers")).collect()
        assert sorted(r.id for r in rows) == [0, 1, 2]
        store.dropped(spark, path)
        return whole_collections() - before

    assert collections_of_a_write(0.0) > 0
    assert collections_of_a_write(1.0) == 0


def test_fit_gives_freed_memory_back(spark, edges, sf_dir, monkeypatch):
    pinned = []

    def hoard(texts, labels, limits):
        freed = [bytes(2000) for _ in range(60_000)]
        pinned.append(bytes(2000))  # lies above the others, so they do not go by themselves
        del freed
        return toxicity.Machine(0.0)

    monkeypatch.setattr(toxicity, "fit", hoard)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    before = resident_mb()
    assert toxicity.learned(edges, labels).bias == 0.0
    assert resident_mb() - before < 60
