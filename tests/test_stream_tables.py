import os
import shutil

import pytest

from cadenza.plans import q_stream, registry
from cadenza.session import read_table

from conftest import SF001
from test_streaming_and_entry import _same


@pytest.fixture
def parts(spark, tmp_path):
    """sf0.001 with the streamed tables as folders of part files."""
    registry.load_all()
    os.makedirs(tmp_path / "sf")
    shutil.copy(f"{SF001}/part.parquet", tmp_path / "sf")
    read_table(spark, SF001, "events").orderBy("ts", "event_id").limit(200).repartitionByRange(3, "ts", "event_id") \
        .write.parquet(str(tmp_path / "sf/events.parquet"))
    read_table(spark, SF001, "embeddings").limit(60).repartition(3).write.parquet(str(tmp_path / "sf/embeddings.parquet"))
    return str(tmp_path / "sf")


@pytest.mark.parametrize("files", [1, q_stream.FILES_PER_BATCH])
def test_stream_topk_reads_every_part_file(spark, parts, monkeypatch, files):
    monkeypatch.setattr(q_stream, "FILES_PER_BATCH", files)
    streamed = registry.QUERIES["stream_topk"](spark, parts)
    assert streamed.select("qid").distinct().count() == 60
    assert _same(registry.QUERIES["topk_cosine"](spark, parts), streamed)


def test_stream_replay_reads_every_part_file(spark, parts):
    streamed = registry.QUERIES["stream_replay"](spark, parts)
    assert streamed.count() == 200
    assert _same(registry.QUERIES["replay_requests"](spark, parts), streamed)


def test_streams_read_single_file_tables(spark):
    registry.load_all()
    assert registry.QUERIES["stream_topk"](spark, SF001).select("qid").distinct().count() == 500
    assert registry.QUERIES["stream_replay"](spark, SF001).count() == 1000
