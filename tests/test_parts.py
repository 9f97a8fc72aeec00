import pyarrow as pa

from tessera.operators import chunk


def test_chunks_are_made_of_a_bounded_part_of_a_batch(spark, monkeypatch):
    texts = ["x" * 10, "y" * 95, None, "z" * 40, "", "w" * 70, "v" * 300, "u"]
    monkeypatch.setattr(chunk, "PART_BYTES", 100)
    held = [p.column("text").to_pylist() for p in chunk.parts(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}))]
    assert held == [["x" * 10], ["y" * 95, None], ["z" * 40, ""], ["w" * 70], ["v" * 300], ["u"]]
    assert list(chunk.parts(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}))) == []
