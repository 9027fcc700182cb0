import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quincunx.operators.sketch import bin_error
from quincunx.sources.tables import program_texts, table_stream
from quincunx.streaming.progress import progress_events, read_progress, start_progress, work_folder, write_progress

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{FOLDER}/events.parquet")


def add(events, folder, rest):
    events.where(f"event_id % 4 = {rest}").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def run(spark, source, folder, measures):
    start_progress(table_stream(spark, str(source), "events"), measures, folder).awaitTermination()


def test_progress_counts_every_row_once(spark, events, tmp_path):
    folder, measures = work_folder(spark), {"root": "sqrt(value - 40)", "value": "value"}
    for rest in (0, 1):
        add(events, tmp_path, rest)
    run(spark, tmp_path, folder, measures)
    assert read_progress(spark, folder).select("batch").distinct().count() == 2
    # The stream stops, more data arrives, and it goes on where it was.
    for rest in (2, 3):
        add(events, tmp_path, rest)
    run(spark, tmp_path, folder, measures)
    total = events.count()
    rows = [r for r in read_progress(spark, folder, total).orderBy("batch").collect() if r.id == "root"]
    assert [r.batch for r in rows] == [0, 1, 2, 3] and rows[-1].progress == 1.0
    assert [r.total.candidates for r in rows] == np.cumsum([r.batch_state.candidates for r in rows]).tolist()
    values = np.array([r.value for r in events.collect()])
    roots = np.sqrt(values[values >= 40] - 40)
    last = rows[-1].total
    assert (last.candidates, last.n, last.low, last.high) == (total, roots.size, roots.min(), roots.max())
    assert last.mean == pytest.approx(roots.mean(), rel=1e-12)
    assert last.m2 == pytest.approx(((roots - roots.mean()) ** 2).sum(), rel=1e-12)

    log = [json.loads(r.value) for r in progress_events(read_progress(spark, folder, total), total, bins=8).orderBy("batch").collect()]
    assert [e["type"] for e in log] == ["start", *["batch"] * 8, *["complete"] * 2]
    for e in log[1:]:
        assert sum(b["count"] for b in e["histogram"]["bins"]) == e["histogram"]["total_count"] == e["valid_results"]
        assert len(e["histogram"]["bins"]) == 8 and e["p05"] <= e["p50"] <= e["p95"]
        assert e["valid_results"] + e["discarded_results"] == e["processed_iterations"] == e["diagnostics"]["candidate_results"]
    end = next(e for e in log if e["type"] == "complete" and e["id"] == "root")
    counts = np.histogram(roots, np.linspace(roots.min(), roots.max(), 9))[0]
    assert abs(np.array([b["count"] for b in end["histogram"]["bins"]]) - counts).max() < 2 * bin_error() * roots.size


def test_a_repeated_batch_replaces_itself(spark, events):
    folder = work_folder(spark)
    for number in (0, 1, 1, 0):
        write_progress(events.where(F.col("event_id") % 2 == number), {"x": "value"}, folder, number)
    rows = read_progress(spark, folder).orderBy("batch").collect()
    assert [r.batch for r in rows] == [0, 1] and rows[-1].total.candidates == events.count()


def test_a_table_may_be_a_file_or_a_folder(spark, events, tmp_path):
    folder = work_folder(spark)
    run(spark, FOLDER, folder, {"x": "value"})
    assert read_progress(spark, folder).first().total.n == events.count()
    for rest in range(4):
        add(events, tmp_path, rest)
    folder = work_folder(spark)
    run(spark, tmp_path, folder, {"x": "value"})
    assert read_progress(spark, folder).agg(F.max("total.n"), F.count("*")).first() == (events.count(), 4)


def test_work_folder_needs_a_shared_one(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert work_folder(spark).startswith(root) and work_folder(spark) != work_folder(spark)

    class Unset:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        work_folder(Unset)


def test_program_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.dsl").write_text(rf"\model{{y={name}}}")
    (tmp_path / "note.txt").write_text("no")
    assert {r.name: r.text for r in program_texts(spark, str(tmp_path)).collect()} == {n: rf"\model{{y={n}}}" for n in "ab"}
