"""State of streams: kept, and ended by the events' own time."""

import datetime

import pytest

from maskwright import streaming as R

START = datetime.datetime(2026, 1, 1)


def replay(spark, tmp_path, batches, schema, stream, name):
    """The rows of a stream over the batches, one file each, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    query = stream(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).outputMode("append").start()
    assert query.awaitTermination(100)
    return spark.table(name).collect()


@pytest.mark.parametrize("forget", [None, "1 hour"])
def test_a_silent_canvas_is_forgotten(spark, tmp_path, forget):
    at = lambda h: START + datetime.timedelta(hours=h)
    schema = "canvas_id string, seq long, kind string, sig array<double>, ts timestamp"
    flat = [0.0] * 16
    batches = [[("a", 1, "drawn", flat, at(0))], [("a", 2, "read", None, at(0.1))], [("b", 1, "drawn", flat, at(3))], [("b", 2, "drawn", flat, at(3.1))], [("a", 3, "drawn", flat, at(3.2))]]
    got = {(r["canvas_id"], r["seq"]): (r["hidden"], r["w"], r["h"]) for r in replay(spark, tmp_path, batches, schema, lambda e: R.watch_redraws(e, 4, forget), f"watch_{forget is None}")}
    # the same picture again: nothing changed if the canvas is still known, all of it is new if it was forgotten
    assert got["a", 1] == (True, 4, 4) and got["a", 2][0] is False and got["a", 3] == ((False, 0, 0) if forget is None else (True, 4, 4))
    assert got["b", 2] == (True, 4, 4)
