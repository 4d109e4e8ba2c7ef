import json

import pytest
from pyspark.sql import functions as F

from twinframe.sources import annotations as A
from twinframe.sources import files as V
from twinframe.sources import tables as T
from twinframe.sources.positions import aligned, match_report, with_positions
from twinframe.streaming import ingest


def test_tree_keys_come_from_the_path(spark, tmp_path):
    for model in ("m0", "m1"):
        spark.range(3).write.parquet(f"{tmp_path}/{model}/test")
    got = T.read_tree(spark, str(tmp_path), "part-*", ["model", "split"], "id long").groupBy("model", "split").count().collect()
    assert {(r.model, r.split, r["count"]) for r in got} == {("m0", "test", 3), ("m1", "test", 3)}


def test_splits_arrays_and_fallbacks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines ""quoted"""\n')
    (tmp_path / "b.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    rows = T.read_splits(spark, [str(tmp_path / "a.csv")], {"a.csv": "train"}, "id int, text string").collect()
    assert [tuple(r) for r in rows] == [(1, 'two\nlines "quoted"', "train")]
    assert T.read_json_array(spark, str(tmp_path / "b.json"), "id int").count() == 2
    assert T.read_or_empty(spark, "id int", ("parquet", str(tmp_path / "none")), ("json", str(tmp_path / "b.json"))).columns == ["id"]
    assert T.read_or_empty(spark, "id int", ("parquet", str(tmp_path / "none"))).collect() == []


def grid(*intervals, name="Doctor"):
    body = "\n".join(f'        intervals [{k}]:\n            xmin = {a} \n            xmax = {b} \n            text = "{t}" ' for k, (a, b, t) in enumerate(intervals, 1))
    return f'File type = "ooTextFile"\nObject class = "TextGrid"\nxmin = 0\nxmax = 9\nitem []:\n    item [1]:\n        class = "IntervalTier"\n        name = "{name}"\n        intervals: size = 4\n{body}'


def test_annotations_are_scanned_once(spark, tmp_path):
    long = "word " * 200_000 + 'quote "" ' * 30_000
    trap = 'he wrote intervals [9]:\n xmin = 1\n xmax = 2\n text = ""x""'
    text = grid((0, 2.5, ""), (2.5, 3, "Hi. <UNSURE>Hello how</UNSURE>\n are you?"), (3, 4, "<UNIN/>"), (4, 5, 'He said ""fine"".'), (5, 6, '""'), (6, 7, trap), (7, 8, long))
    (tmp_path / "day1_doctor.TextGrid").write_text(text + "\n" + grid((1, 2, "Yes."), name='Pat""ient') + '\n intervals [2]:\n xmin = 2\n xmax = 3\n text = "not closed')
    (tmp_path / "empty.TextGrid").write_text("")
    got = A.read_intervals(spark, f"file://{tmp_path}", "*.TextGrid").orderBy("tier", "start_s").collect()
    assert [(r.tier, r.start_s, r.end_s) for r in got] == [("Doctor", 2.5, 3.0), ("Doctor", 4.0, 5.0), ("Doctor", 5.0, 6.0), ("Doctor", 6.0, 7.0), ("Doctor", 7.0, 8.0), ('Pat"ient', 1.0, 2.0)]
    assert [r.text for r in got[:4]] == ["Hi. Hello how are you?", 'He said "fine".', '"', 'he wrote intervals [9]: xmin = 1 xmax = 2 text = "x"'] and len(got[4].text) == len(long.replace('""', '"')) - 1
    assert all(r.path.endswith("day1_doctor.TextGrid") for r in got)


def test_annotations_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"s{i % 2}", float(k), k + 0.5, t) for i in range(5) for k, t in enumerate(['a "b"\nc', "", None, 'x""', "é <other>"])], "i int, who string, start_s double, end_s double, text string")
    A.write_intervals(rows.withColumn("tier", F.concat_ws("|", "i", "who")), f"file://{tmp_path}/g", [], "tier", tiers=2)
    got = A.read_intervals(spark, f"file://{tmp_path}/g", "part-*").collect()
    want = {(f"{i}|s{i % 2}", float(k), t) for i in range(5) for k, t in ((0, 'a "b" c'), (3, 'x""'), (4, "é <other>"))}
    assert {(r.tier, r.start_s, r.text) for r in got} == want and len(got) == len(want)


def test_positions_follow_files_and_blocks(spark, tmp_path):
    for name, rows in (("b.json", range(300, 340)), ("a.json", range(300)), ("c.json", ())):
        (tmp_path / name).write_text("".join(json.dumps({"i": i, "t": "x" * (i % 50)}) + "\n" for i in rows))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # many blocks of a file, read in any order
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        read = spark.read.schema("i long, t string").json(f"file://{tmp_path}")
        assert read.rdd.getNumPartitions() > 4
        got = with_positions(read).collect()
        assert {(r.pos, r.i) for r in got} == {(i, i) for i in range(340)} and got[0].__fields__ == ["i", "t", "pos"]
        assert {r.pos for r in with_positions(read.filter("i % 3 = 0")).collect()} == set(range(114))
    finally:
        for k, v in zip(("maxPartitionBytes", "openCostInBytes"), was):
            spark.conf.set(f"spark.sql.files.{k}", v)


def test_releases_by_place(spark):
    frame = lambda rows: spark.createDataFrame(rows, "pos long, a string, b int")
    built = frame([(0, "x", 1), (1, "y", None), (2, "z", 3)])
    assert tuple(match_report(built, built, ["a", "b"]).first()) == (3, 3, 3, 3, None)
    assert tuple(match_report(built, frame([(0, "x", 1), (1, "z", None)]), ["a", "b"]).first()) == (2, 3, 1, 2, 1)
    labels = spark.createDataFrame([(i, "xyz"[i], i * 10) for i in range(3)], "pos long, a string, label int")
    assert sorted(tuple(r) for r in aligned(built, labels, ["a"]).select("pos", "label").collect()) == [(0, 0), (1, 10), (2, 20)]
    for bad in (labels.filter("pos < 2"), labels.withColumn("a", F.lit("x"))):
        with pytest.raises(Exception, match="not aligned"):
            aligned(built, bad, ["a"]).collect()


def test_files_against_a_manifest(spark, tmp_path):
    import hashlib

    root, out = tmp_path / "root", tmp_path / "outside"
    (root / "deep").mkdir(parents=True)
    out.mkdir()
    for path, text in ((root / "a.bin", b"one"), (root / "deep/b c.bin", b"\x00\xfftwo"), (root / "changed.bin", b"now"), (root / "more.bin", b"m"), (out / "secret.bin", b"s")):
        path.write_bytes(text)
    (root / "inner.bin").symlink_to(root / "a.bin")
    (root / "outer.bin").symlink_to(out / "secret.bin")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    listed = [("a.bin", sha(b"one").upper()), ("./deep/b c.bin", sha(b"\x00\xfftwo")), ("changed.bin", sha(b"then")), ("gone.bin", sha(b"")), ("inner.bin", sha(b"one")), ("outer.bin", sha(b"s")), ("../outside/secret.bin", sha(b"s")), ("/etc/passwd", sha(b"")), ("deep/../a.bin", sha(b"one")), (".", sha(b""))]
    files = V.hashed_files(spark, f"file://{root}")
    assert {(r.path, r.size) for r in files.collect()} == {("a.bin", 3), ("deep/b c.bin", 5), ("changed.bin", 3), ("more.bin", 1), ("inner.bin", 3), ("outer.bin", 1)}
    got = {r.path: r.status for r in V.verify(files, spark.createDataFrame(listed, "path string, sha256 string")).collect()}
    assert got == {"a.bin": "ok", "./deep/b c.bin": "ok", "changed.bin": "mismatch", "gone.bin": "missing", "inner.bin": "ok", "outer.bin": "unsafe", "../outside/secret.bin": "unsafe", "/etc/passwd": "unsafe", "deep/../a.bin": "unsafe", ".": "unsafe", "more.bin": "extra"}


def test_corrections_replace_their_row(spark, tmp_path):
    """A later reply to a request replaces its row, an older one does not; a batch that runs again changes nothing; buckets without new keys are left alone."""
    source, target, state = tmp_path / "in", f"file://{tmp_path}/out", str(tmp_path / "cp")
    source.mkdir()

    def put(name, *replies):
        (source / name).write_text("\n".join(json.dumps({"request_id": i, "received_at": f"2024-01-0{day}T00:00:00Z", "judge_raw": f'{{"contamination": {c}, "severity": 2, "reasoning": "r"}}' if c in (0, 1) else "broken"}) for i, day, c in replies))
        ingest.run_upsert(spark, str(source), target, state, buckets=8)

    def rows():
        return {r.request_id: (r.contamination, r.received_at.day) for r in ingest.read_upserted(spark, target).collect()}

    put("1.json", ("a", 2, 0), ("b", 2, 0), ("c", 2, 0), ("c", 1, 1), ("d", 2, 7))
    assert rows() == {"a": (0, 2), "b": (0, 2), "c": (0, 2)}
    put("2.json", ("a", 3, 1), ("b", 1, 1), ("d", 3, 1))
    want = {"a": (1, 3), "b": (0, 2), "c": (0, 2), "d": (1, 3)}
    assert rows() == want
    written = [{int(p.name.partition("=")[2]) for p in tmp_path.glob(f"out/batch={k}/bucket=*")} for k in (0, 1)]
    assert written[1] == {r.b for r in spark.createDataFrame([("a",), ("b",), ("d",)], "request_id string").select(ingest.bucket_of("request_id", 8).alias("b")).collect()}
    for lost in (tmp_path / "cp" / "commits").glob("*1*"):
        lost.unlink()
    ingest.run_upsert(spark, str(source), target, state, buckets=8)
    assert rows() == want
    put("3.json", ("c", 4, 1))
    assert rows() == want | {"c": (1, 4)}


def test_versions_and_results(spark, tmp_path):
    path = str(tmp_path / "t")
    T.write_table(spark.range(3), path, params={"a": 1})
    assert T.latest(spark, path).count() == 3
    table = spark.createDataFrame([(1, 123.456789012), (2, 0.0), (3, None)], "k int, v double")
    T.write_results(table, str(tmp_path / "r"))
    got = spark.read.option("header", True).csv(str(tmp_path / "r")).orderBy("k").collect()
    assert [r.v for r in got] == ["123.457", "0.0", None]


def reply(i, text):
    return json.dumps({"request_id": i, "received_at": "2024-01-01T00:00:00Z", "judge_raw": text})


def test_ingest_is_incremental(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    good = '{"contamination": 1, "severity": 2, "reasoning": "r"}'
    (source / "1.json").write_text("\n".join([reply("a", good), reply("a", good), reply("b", "broken"), reply("c", good)]))
    ingest.run_ingest(spark, str(source), target, str(tmp_path / "cp"))
    (source / "2.json").write_text("\n".join([reply("b", good), reply("c", good)]))
    for _ in range(2):
        ingest.run_ingest(spark, str(source), target, str(tmp_path / "cp"))
    assert sorted(r.request_id for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]
    assert [r.request_id for r in spark.read.parquet(target + "_errors").collect()] == ["b"]


def test_stream_rates_equal_batch(spark, tmp_path):
    rows = [reply(str(i), '{"contamination": 1, "severity": 2, "reasoning": "r"}' if i % 3 else "broken") for i in range(30)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(rows))
    stream = ingest.error_rates(ingest.reply_stream(spark, str(tmp_path / "in")))
    assert stream.isStreaming and ingest.first_success(ingest.reply_stream(spark, str(tmp_path / "in"))).isStreaming
    stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = ingest.error_rates(spark.read.schema(ingest.REPLY).json(str(tmp_path / "in")))
    assert {tuple(r) for r in spark.table("rates").collect()} == {tuple(r) for r in batch.collect()} and batch.select(F.sum("n_error")).first()[0] == 10


def test_replay_of_a_batch_keeps_its_rows(spark, tmp_path):
    """The commit of the second batch is lost, so the batch runs again: the target stays as it was."""
    source, target, good = tmp_path / "in", str(tmp_path / "out"), '{"contamination": 1, "severity": 2, "reasoning": "r"}'
    source.mkdir()
    for name, ids in (("1.json", "ab"), ("2.json", "bc")):
        (source / name).write_text("\n".join(reply(i, good) for i in ids))
        ingest.run_ingest(spark, str(source), target, str(tmp_path / "cp"))
    before = sorted(r.request_id for r in spark.read.parquet(target).collect())
    assert before == ["a", "b", "c"]
    for lost in (tmp_path / "cp" / "commits").glob("*1*"):
        lost.unlink()
    ingest.run_ingest(spark, str(source), target, str(tmp_path / "cp"))
    assert sorted(r.request_id for r in spark.read.parquet(target).collect()) == before


def test_folding_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "t")
    T.write_table(spark.createDataFrame([(1, 1), (2, 2)], "k int, score int"), path)
    first = T.spark_path(spark, path)
    counts = T.fold_table(spark, path, spark.createDataFrame([(2, 9), (3, 3)], "k int, score int"), ["k"], ["score"], {"why": "rerun"})
    assert tuple(counts.first()) == (1, 1)
    assert T.latest(spark, path).dtypes == [("k", "int"), ("score", "tinyint")]
    assert sorted(map(tuple, T.latest(spark, path).collect())) == [(1, 1), (2, 9), (3, 3)] and spark.read.parquet(first).count() == 2
    known = T.manifest(spark, path).orderBy("run_id").collect()
    assert [r.n_rows for r in known] == [2, 3] and known[1].params == {"why": "rerun"} and known[1].inputs == [first]
