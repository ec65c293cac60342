import pyarrow as pa

from lexloom.functions import chunker
from lexloom.operators.chunks import chunk_documents


def test_chunks_are_handed_on_slice_by_slice(spark):
    texts = ["One sentence here. " * 200, None, "", "  \n", "Short.", "SECTION ONE\nSome words. " * 90] * 300
    batch = pa.RecordBatch.from_pydict({"document_id": list(range(len(texts))), "_text": texts})
    out = list(chunker.chunk_rows("_text")(iter([batch])))
    assert len(out) > 3 and max(b.nbytes for b in out) < 4 << 20  # one batch of rows, several of chunks
    got = [(r["document_id"], {k: v for k, v in r.items() if k != "document_id"}) for b in out for r in b.to_pylist()]
    assert got == [(i, c) for i, t in enumerate(texts) for c in chunker.split_text(t, 600, 120)]
    rows = spark.createDataFrame(list(enumerate(texts[:12])), "doc_id long, text string")
    assert chunk_documents(rows).columns == ["chunk_id", "document_id", *chunker.CHUNK_FIELDS.names]
    assert chunk_documents(rows).count() == sum(len(chunker.split_text(t, 600, 120)) for t in texts[:12])
