from test_ranges import SCHEMA, collected, frame, model

from palimpsest.streaming.overlay import current, overlay_batches


def test_batches_lie_over_each_other(spark, tmp_path):
    first = {"m": [(0, 0, 100, "a"), (50, 0, 10, "b")], "n": [(5, 5, 5, "a")]}
    second = {"m": [(40, 7, 15, "c")], "o": [(0, 0, 1, "a")]}
    source = str(tmp_path / "in")
    for i, part in enumerate((first, second)):
        frame(spark, part).coalesce(1).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source)
        q = overlay_batches(stream, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive
    assert collected(current(spark, str(tmp_path / "out"), 0)) == {k: model(p) for k, p in first.items()}
    assert collected(current(spark, str(tmp_path / "out"), 1)) == {k: model(first.get(k, []) + second.get(k, [])) for k in "mno"}
