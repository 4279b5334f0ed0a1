"""The keyed sink of the ingest stream: one row per id, the first arrival stays."""

import json

from cadenza.plans.q_features import DEDUP_ORDER
from cadenza.plans.q_ingest import write_json_tree
from cadenza.sources import json_ingest as J
from cadenza.streaming import jobs

from conftest import SF001


def test_sink_is_keyed_over_many_batches(spark):
    root = write_json_tree(spark, SF001)
    kept, _ = J.ingest(spark, root, multi_line=False, dedup_order=DEDUP_ORDER)
    rows = jobs.ingest_stream_keyed(spark, root, DEDUP_ORDER, max_files_per_trigger=9)
    ids = [r["id"] for r in rows.select("id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r["id"] for r in kept.select("id").collect()}
    one = jobs.ingest_stream_keyed(spark, root, DEDUP_ORDER)
    assert one.select(*sorted(one.columns)).exceptAll(kept.select(*sorted(one.columns))).count() == 0 and one.count() == len(ids)


def test_a_later_arrival_changes_nothing(spark, tmp_path):
    good = spark.read.text(write_json_tree(spark, SF001) + "/*/*")
    kept, _ = J.ingest(spark, write_json_tree(spark, SF001), multi_line=False, dedup_order=DEDUP_ORDER)
    lines = sorted(r["value"] for r in good.collect())[:60]
    root, base = tmp_path / "tree", str(tmp_path / "stream")
    root.mkdir()

    def run():
        return jobs.ingest_stream_keyed(spark, str(root), DEDUP_ORDER, max_files_per_trigger=1, base=base)

    (root / "a.json").write_text("\n".join(lines[:40]))
    before = sorted(map(tuple, run().collect()), key=str)
    assert before
    (root / "b.json").write_text("\n".join(lines))
    (root / "c.json").write_text("\n".join(lines[20:]))
    rows = run().collect()
    ids = [r["id"] for r in rows]
    assert set(before) <= set(map(tuple, rows)) and len(ids) == len(set(ids)) > len(before)
    assert set(ids) == {r["id"] for r in kept.where(kept["id"].isin(ids)).collect()}


def test_what_holds_of_a_batch_stays_small(spark, monkeypatch):
    """``foreachBatch`` asks the stream's optimised plan for its constraints, on the driver."""
    run, asked = jobs._run, []

    def watched(writer):
        state = spark._jsparkSession.sessionState()
        plan = state.optimizer().execute(writer._df._jdf.queryExecution().analyzed())
        asked.append(plan.validConstraints().size())
        assert asked[-1] < 1000
        return run(writer)

    monkeypatch.setattr(jobs, "_run", watched)
    rows = jobs.ingest_stream_keyed(spark, write_json_tree(spark, SF001), DEDUP_ORDER)
    assert len(asked) == 2 and rows.count() == rows.select("id").distinct().count() > 0
