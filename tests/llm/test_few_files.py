"""Near dedup on odd layouts: few files for few rows, whatever the number of shuffle partitions, and little memory for a group of many pairs."""

import tracemalloc

import numpy as np

from cadenza.llm import chosen_path, common
from cadenza.session import files_for, session_conf


def test_near_dedup_writes_few_files(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    rows = [(100 * g + i, " ".join(words[20 * g:20 * g + 60] + [f"x{i}"])) for g in range(10) for i in range(12)]
    written = []

    def noted(df, name="table", *args):
        out = keep(df, name, *args)
        written.append((name, len(out.inputFiles())))
        return out

    keep = common.cut_lineage
    monkeypatch.setattr(common, "cut_lineage", noted)
    monkeypatch.setattr(chosen_path, "cut_lineage", noted)
    most = files_for(spark, len(rows), 4000)
    with (session_conf(spark, "spark.sql.shuffle.partitions", 4 * most),
          session_conf(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false")):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in chosen_path.near_dedup(df).collect()}
    assert got == {100 * g + i: 100 * g for g in range(10) for i in range(12)}
    assert {"cc", "nodes", "tree"} <= {name for name, _ in written}
    assert [x for x in written if x[1] > most] == []


def test_files_for_many_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert files_for(spark, 0, 10) == 2 * cores
    assert files_for(spark, 1001, 10) == max(101, 2 * cores)


def test_pairs_of_a_large_group_need_little_memory():
    """A cell of near copies, all of different components: a million pairs, of which a few are new to their tree."""
    rng = np.random.default_rng(5)
    rows = chosen_path.FEW
    base = rng.integers(0, 256, chosen_path.HASHES, dtype=np.uint8)
    sk = np.where(rng.random((2 * rows, chosen_path.HASHES)) < 0.1, rng.integers(0, 256, (2 * rows, chosen_path.HASHES)), base).astype(np.uint8)
    group = {"sk": sk, "bins": np.full((2 * rows, chosen_path.BINS), 7, np.uint8), "comp": np.arange(2 * rows), "n": np.full(2 * rows, 300),
             "prints": np.tile(rng.integers(0, 9, (2 * rows, 1)), (1, chosen_path.TREES)).astype(np.uint32),
             "tree": np.full(2 * rows, 3), "whole": np.full(2 * rows, 1 << 2)}
    p, q = np.arange(rows), np.arange(rows, 2 * rows)
    tracemalloc.start()
    try:
        x, y, level = chosen_path._near_pairs(group, p, q, False, True, 80)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    agree = np.concatenate([(sk[p[a:a + 64]][:, None, :] == sk[q][None, :, :]).sum(2) for a in range(0, rows, 64)])
    want = (agree >= chosen_path.AGREE) & (group["prints"][p, 0][:, None] != group["prints"][q, 0][None, :])
    assert want.sum() > 500_000
    assert np.array_equal(np.stack((x, y - rows)), np.stack(np.nonzero(want))) and np.array_equal(-level, agree[want])
    assert peak < 100 << 20
    x, y, _ = chosen_path._near_pairs({k: v[:200] for k, v in group.items()}, np.arange(200), np.arange(200), True, False, 80)
    whole = (sk[:200][:, None, :] == sk[:200][None, :, :]).sum(2) >= chosen_path.AGREE
    assert np.array_equal(np.stack((x, y)), np.stack(np.nonzero(np.triu(whole, 1))))
