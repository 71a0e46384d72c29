"""Python workers hold a slice of Spark's Arrow batches as objects, not whole batches."""

import tracemalloc

import pyarrow as pa
import pytest

from taskledger.llm import common, toxicity

NAMES = ["doc_id", "text"]


class Caught:
    """In place of a DataFrame: keeps what mapInArrow is given."""

    schema = type("Schema", (), {"fieldNames": staticmethod(lambda: NAMES)})

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def _batch(rows: int, length: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array(range(rows), pa.int64()), pa.array([f"{i} ".ljust(length, "x") for i in range(rows)])], names=NAMES)


@pytest.mark.parametrize("rows", [0, 1, 255, 256, 257, 1_000])
def test_slices_are_all_rows_in_order(rows):
    batches = [_batch(rows, 10), _batch(3, 10)]
    found = list(common.in_slices(iter(batches)))
    assert all(0 < b.num_rows <= common.ROWS_AT_ONCE for b in found)
    assert [i for b in found for i in b.column(0).to_pylist()] == [*range(rows), 0, 1, 2]


def test_dropping_toxic_rows_holds_few_texts_at_once():
    docs, batch = Caught(), _batch(4_000, 2_000)
    toxicity.drop_toxic(docs, toxicity.Lexicon({}))
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in docs.run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 4_000
    assert peak < 2_000_000  # the batch's texts have 8 MB
