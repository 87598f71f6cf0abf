import weakref

import pyarrow as pa

from lectern.llm import common


def test_arrow_memory_is_given_back_at_the_end_of_a_task(monkeypatch):
    """After the last batch has gone (before: workers kept it while later tasks ran)."""
    let_go = []

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    class Pool:
        def release_unused(self):
            let_go.append([r() is None for r in refs])

    refs = []

    def batches():
        for texts in (["a b", None], ["c"]):
            batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
            refs.append(weakref.ref(batch))
            yield batch
            del batch

    run = common.map_batches(Rows(), lambda part: part.num_rows, "n long")
    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    assert list(run(batches())) == [2, 1]
    assert let_go == [[True, True]]
