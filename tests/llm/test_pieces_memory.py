"""encode_documents() holds a few hundred texts at once, whatever the batch."""

import public_tokenizers
import pyarrow as pa

from millrace.llm import common, pieces
from millrace.llm.queries import PIECES


class Docs:
    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_large_batches_are_cut(spark):
    texts = [f"some words {i}" for i in range(1203)] + [None, ""]
    run = pieces.encode_documents(Docs(), public_tokenizers.path(PIECES), keep_ids=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = list(run(iter([batch, batch.slice(0, 0), batch.slice(1000)])))
    assert max(b.num_rows for b in out) <= 500
    assert [i for b in out for i in b.column(0).to_pylist()] == [*range(1205), *range(1000, 1205)]
    assert out[0].column(4).to_pylist() == [x for b in run(iter([batch.slice(0, 500)])) for x in b.column(4).to_pylist()]


def test_batches_given_to_python_are_small(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    seen = common.materialize(spark.range(0, 1200, 1, 1).mapInArrow(sizes, "n long"), "sizes", batch_rows=500)
    assert sorted(r.n for r in seen.collect()) == [200, 500, 500]
    assert spark.conf.get(key) == before
