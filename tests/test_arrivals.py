"""Ingest of dropped files: each content once over restarts and re-uploads, batches run again, compaction broken off."""

import os
import shutil

from marginalia.streaming import arrivals as ST


def rows(spark, table):
    return sorted((r.text or "") for r in ST.ingested(spark, table).collect())


def drop(folder, **texts):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.txt").write_bytes(text.encode())


def test_restart_and_again(spark, tmp_path):
    inbox, table, point = (str(tmp_path / x) for x in ("in", "table", "point"))
    provider = spark.conf.get(ST._PROVIDER)
    assert ST.ingested(spark, table).count() == 0
    drop(tmp_path / "in", a="one", b="two", c="one", empty="", other=" ")
    ST.ingest(spark, inbox, table, point, files_per_batch=2)
    assert rows(spark, table) == [" ", "one", "two"] and spark.conf.get(ST._PROVIDER) == provider
    ST.ingest(spark, inbox, table, point)  # nothing new
    drop(tmp_path / "in" / "deep", z="two", y="three", x="two ")  # one of them again, under another name
    drop(tmp_path / "in", note="one")
    (tmp_path / "in" / "skipped.md").write_text("four")
    ST.ingest(spark, inbox, table, point)
    assert rows(spark, table) == [" ", "one", "three", "two", "two "]
    first = {r.text: r.first_seen for r in ST.ingested(spark, table).collect()}
    assert first["one"] < first["three"]


def test_batch_run_again(spark, tmp_path):
    """The last batch was written, but its end not noted: it is run again, with the same rows."""
    inbox, table, point = (str(tmp_path / x) for x in ("in", "table", "point"))
    drop(tmp_path / "in", a="one", b="two")
    ST.ingest(spark, inbox, table, point)
    drop(tmp_path / "in", c="three", d="one")
    ST.ingest(spark, inbox, table, point)
    last = max(int(n) for n in os.listdir(f"{point}/commits") if n.isdigit())
    os.remove(f"{point}/commits/{last}")
    if os.path.exists(f"{point}/commits/.{last}.crc"):
        os.remove(f"{point}/commits/.{last}.crc")
    shutil.rmtree(f"{table}/batch={last}")
    ST.ingest(spark, inbox, table, point)
    assert rows(spark, table) == ["one", "three", "two"]


def test_compaction(spark, tmp_path):
    inbox, table, point = (str(tmp_path / x) for x in ("in", "table", "point"))
    for k in range(3):
        drop(tmp_path / "in", **{f"f{k}": f"text {k}", f"g{k}": "same"})
        ST.ingest(spark, inbox, table, point)
    want = rows(spark, table)
    shutil.copytree(f"{table}/batch=0", f"{table}/merged=9")  # a compaction broken off before its mark
    os.remove(f"{table}/merged=9/_SUCCESS")
    assert rows(spark, table) == want == ["same", "text 0", "text 1", "text 2"]
    shutil.rmtree(f"{table}/merged=9")
    kept = tmp_path / "kept"
    shutil.copytree(f"{table}/batch=1", kept)
    ST.compact(spark, table)
    assert rows(spark, table) == want and [n for n in os.listdir(table) if "=" in n] == ["merged=2"]
    shutil.copytree(kept, f"{table}/batch=1")  # broken off between mark and removal
    assert rows(spark, table) == want
    drop(tmp_path / "in", later="text 1", new="text 9")
    ST.ingest(spark, inbox, table, point)
    ST.compact(spark, f"file://{table}")
    assert rows(spark, table) == [*want, "text 9"] and [n for n in os.listdir(table) if "=" in n] == ["merged=3"]


def test_files_are_looked_up_in_few_tasks(spark, tmp_path):
    """A batch's files are looked up in some tasks a core, not in a task a file; the session's setting stays."""
    stages = lambda: {i: x.numTasks for i in range(20_000) if (x := spark.sparkContext.statusTracker().getStageInfo(i))}
    drop(tmp_path / "in", **{f"f{k}": f"text {k}" for k in range(120)})
    known, setting = stages(), spark.conf.get(ST._LISTING)
    ST.ingest(spark, *(str(tmp_path / x) for x in ("in", "table", "point")))
    assert len(rows(spark, str(tmp_path / "table"))) == 120 and spark.conf.get(ST._LISTING) == setting
    new = [n for i, n in stages().items() if i not in known]
    assert new and max(new) <= 4 * spark.sparkContext.defaultParallelism
