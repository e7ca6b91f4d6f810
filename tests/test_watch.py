import datetime as dt
import os
import random

from palisade.streaming import watch


def rows_of(df):
    return {(r["name"], r["version"]) for r in df.collect()}


def snapshot(spark, folder, day, rows):
    data = [("npm", a, v, None, hash(a) % 1000) for a, v in rows]
    watch.write_snapshot(spark.createDataFrame(data, watch.BASE), f"{folder}/in", dt.datetime(2026, 1, 1) + dt.timedelta(days=day))


def run(spark, folder, complete=lambda changed: True):
    stream = watch.read_snapshots(spark, f"{folder}/in")
    watch.watch(stream, f"{folder}/base", f"{folder}/reports", complete).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination()


def test_late_snapshots_do_not_replace_newer_baselines(spark, tmp_path):
    snapshot(spark, tmp_path, 40, [("a", "2")])
    run(spark, tmp_path)
    snapshot(spark, tmp_path, 10, [("a", "1"), ("b", "1")])
    run(spark, tmp_path)
    assert rows_of(watch.read_baseline(spark, f"{tmp_path}/base")) == {("a", "2")}
    snapshot(spark, tmp_path, 41, [("a", "3")])
    run(spark, tmp_path)
    assert rows_of(watch.read_baseline(spark, f"{tmp_path}/base")) == {("a", "3")}


def test_only_changes_are_written(spark, tmp_path):
    many = [(f"p{k}", "1") for k in range(200)]
    snapshot(spark, tmp_path, 1, many)
    snapshot(spark, tmp_path, 2, [*many[1:], ("p0", "2"), ("new", "1")])
    snapshot(spark, tmp_path, 3, [("p0", "2"), *many[2:]])
    run(spark, tmp_path)
    steps = sorted(os.listdir(tmp_path / "base" / "delta"))
    assert [spark.read.parquet(f"{tmp_path}/base/delta/{s}").count() for s in steps] == [200, 2, 2]  # the third one takes two away
    assert rows_of(watch.read_baseline(spark, f"{tmp_path}/base")) == {("p0", "2"), *many[2:]}


def test_full_copies_and_repeated_steps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(watch, "STEPS", 3)
    rng, base = random.Random(2), f"{tmp_path}/base"
    states = {}
    for n in range(9):
        rows = {f"p{rng.randrange(12)}": str(rng.randrange(3)) for _ in range(8)}
        now = spark.createDataFrame([("npm", k, v, None, i) for i, (k, v) in enumerate(rows.items())], watch.BASE)
        for _ in range(2 if n % 2 else 1):  # every other step is repeated, as after a crash
            watch.move_baseline(watch.read_baseline(spark, base, before=n), now, base, n, n)
        states[n] = set(rows.items())
        assert rows_of(watch.read_baseline(spark, base)) == states[n]
    assert rows_of(watch.read_baseline(spark, base, before=8)) == states[7]
    assert len(os.listdir(f"{base}/delta")) < 9 and os.listdir(f"{base}/full")


def test_restart_from_a_checkpoint(spark, tmp_path):
    asked = []

    def fails_once(changed):
        asked.append(rows_of(changed))
        if len(asked) == 2:
            raise RuntimeError("lost")
        return True

    snapshot(spark, tmp_path, 1, [("a", "1")])
    run(spark, tmp_path, fails_once)
    snapshot(spark, tmp_path, 2, [("a", "2")])
    try:
        run(spark, tmp_path, fails_once)
    except Exception as error:
        assert "lost" in str(error)
    assert rows_of(watch.read_baseline(spark, f"{tmp_path}/base")) == {("a", "1")}
    run(spark, tmp_path, fails_once)
    assert asked == [{("a", "1")}, {("a", "2")}, {("a", "2")}]
    assert rows_of(watch.read_baseline(spark, f"{tmp_path}/base")) == {("a", "2")}


def test_files_changed_in_place(spark, tmp_path):
    project, state = tmp_path / "project", f"{tmp_path}/state"
    os.makedirs(project / "sub")
    (project / "notes.txt").write_text("no dependency file")
    (project / "go.mod").write_text("module m\n")
    seen = []
    take = lambda changes: seen.append({(os.path.basename(r["path"]), r["change"]) for r in changes.collect()})
    assert watch.folder_step(spark, str(project), state, 0, take) == 1
    assert watch.folder_step(spark, str(project), state, 1, take) == 0
    for n, version in ((2, "v1.0.0"), (3, "v2.0.0")):  # the same length
        (project / "go.mod").write_text(f"module m\nrequire a.b/c {version}\n")
        os.utime(project / "go.mod", (n * 1000, n * 1000))
        assert watch.folder_step(spark, str(project), state, n, take) == 1
    (project / "sub" / "Cargo.lock").write_text("version = 3\n")
    os.remove(project / "go.mod")

    def broken(changes):
        raise RuntimeError("lookup failed")

    try:
        watch.folder_step(spark, str(project), state, 4, broken)
    except RuntimeError:
        pass
    assert watch.folder_step(spark, str(project), state, 5, take) == 2  # what failed comes again
    assert seen == [{("go.mod", "added")}, {("go.mod", "changed")}, {("go.mod", "changed")}, {("Cargo.lock", "added"), ("go.mod", "removed")}]
