"""Streams on files made here."""

import json

from folioforge.streaming import state


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def row(book, progression, wall, device="a"):
    return {"book_id": book, "progression": progression, "wall": wall, "counter": 0, "device": device}


def test_progress_merges_over_batches_and_replays(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    put(source, "1.json", [row("x", 0.9, 5), row("y", 0.1, 1)])
    state.sync_progress(spark, str(source), target, str(tmp_path / "cp")).awaitTermination()
    put(source, "2.json", [row("x", 0.2, 7), row("y", 0.8, 0), row("z", 0.5, 3)])
    state.sync_progress(spark, str(source), target, str(tmp_path / "cp")).awaitTermination()
    got = {r.book_id: r.progression for r in state.current_state(spark, target).collect()}
    assert got == {"x": 0.2, "y": 0.1, "z": 0.5}
    again = spark.read.schema(state.PROGRESS).json(str(source / "2.json"))
    state.merge_batch(target)(again, 1)
    assert {r.book_id: r.progression for r in state.current_state(spark, target).collect()} == got


def test_events_wait_for_their_end(spark, tmp_path):
    assert state.split_events("da", ["ta: 1\r\n\r\nda", "ta: 2\n\n", "x"]) == (["data: 1", "data: 2"], "x")
    source = tmp_path / "chunks"
    put(source, "1.json", [{"stream_id": 1, "seq": 1, "chunk": "a: 1\n\na: "}, {"stream_id": 2, "seq": 1, "chunk": "b"}])
    schema = "stream_id long, seq long, chunk string"

    def drain():
        q = state.events_of_chunks(spark.readStream.schema(schema).json(str(source))).writeStream.format("memory").queryName("got").outputMode("append").start()
        q.processAllAvailable()
        put(source, "2.json", [{"stream_id": 1, "seq": 3, "chunk": "\n"}, {"stream_id": 1, "seq": 2, "chunk": "2\n"}])
        q.processAllAvailable()
        q.stop()

    drain()
    assert sorted(r.event for r in spark.sql("SELECT * FROM got").collect()) == ["a: 1", "a: 2"]
