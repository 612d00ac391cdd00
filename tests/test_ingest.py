"""The incremental store against a full build, and the upsert stream over restarts and replays."""

import os

from pyspark.sql import functions as F

from talentweave.operators import people
from talentweave.sources import readers, store
from talentweave.streaming import ingest


def part_files(path):
    return {p: sorted((f, os.stat(f"{path}/rows/{p}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/rows/{p}")) for p in os.listdir(f"{path}/rows") if p.startswith("part=")}


def test_an_update_touches_the_parts_of_changed_files_alone(spark, tmp_path):
    docs, at = tmp_path / "docs", str(tmp_path / "store")
    docs.mkdir()
    for i in range(40):
        (docs / f"f{i}.txt").write_text(f"text {i}\nline")
    calls = []

    def read(files):
        calls.append(files.count())
        texts = spark.read.format("binaryFile").load(str(docs)).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "utf-8").alias("t"))
        return texts.join(files, "name", "left_semi").select("name", F.posexplode(F.split("t", "\n")).alias("pos", "line"))

    build = lambda path=at: store.update(spark, path, readers.manifest(spark, str(docs), (".txt",)), read, parts=64)
    held = lambda path=at: sorted(map(tuple, store.rows(spark, path).select("name", "pos", "line").collect()))
    assert {r.change for r in build().collect()} == {"added"} and len(held()) == 80
    before = part_files(at)
    assert build().count() == 0 and part_files(at) == before and calls == [40]
    (docs / "f3.txt").write_text("other")
    (docs / "f7.txt").unlink()
    (docs / "new.txt").write_text("x")
    found = {r.name: (r.change, r.part) for r in build().collect()}
    assert {k: v[0] for k, v in found.items()} == {"f3.txt": "changed", "f7.txt": "removed", "new.txt": "added"}
    after, touched = part_files(at), {f"part={v[1]}" for v in found.values()}
    assert {p for p in after if after[p] != before.get(p)} == touched and calls[1] < 12
    build(str(tmp_path / "full"))
    assert held() == held(str(tmp_path / "full")) and ("f3.txt", 0, "other") in held()
    # Ended before the manifest was written: the next run builds anew, with the same rows.
    os.rename(f"{at}/manifest", f"{at}/_lost")
    assert build().count() == 40 and held() == held(str(tmp_path / "full"))
    for f in os.listdir(docs):
        (docs / f).unlink()
    none = spark.createDataFrame([], "name string, sha1 string")
    store.update(spark, at, none, lambda files: files.select("name", F.lit(0).alias("pos"), F.lit("").alias("line")), parts=64)
    assert store.rows(spark, at).count() == 0


KIND = "id int, version int, name string, phone string"


def test_a_stream_upserts_over_restarts_and_replays(spark, tmp_path):
    source, at, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    batches = [[(1, 1, "a", "x"), (2, 1, "b", None)], [(1, 3, None, "y"), (1, 2, "late", "z"), (3, 1, "c", None)], [(2, None, "n", None), (2, 5, None, "w"), (None, 1, "k", None)]]
    want = spark.createDataFrame([], KIND)
    for rows in batches:
        df = spark.createDataFrame(rows, KIND)
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KIND).parquet(source)
        assert ingest.start(stream, at, mark).awaitTermination(120)
        want = spark.createDataFrame(people.upsert(want, df.where("id is not null"), ["id"], "version", keep_old=("name",)).collect(), KIND)
    got = lambda: sorted(map(repr, ingest.current(spark, at, ["id"], "version", keep_old=("name",)).select("id", "version", "name", "phone").where("id is not null").collect()))
    assert got() == sorted(map(repr, want.select("id", "version", "name", "phone").collect()))
    assert ingest.current(spark, at, ["id"], "version").where("id is null").count() == 1
    ingest.write_batch(spark.createDataFrame(batches[1], KIND), 1, at)
    assert got() == sorted(map(repr, want.select("id", "version", "name", "phone").collect()))
    assert ingest.compact(spark, at, ["id"], "version", keep_old=("name",)) == 2
    assert spark.read.parquet(at).select("batch").distinct().count() == 1
    assert got() == sorted(map(repr, want.select("id", "version", "name", "phone").collect()))
    spark.createDataFrame([(3, 9, None, "new")], KIND).write.mode("append").parquet(source)
    assert ingest.start(spark.readStream.schema(KIND).parquet(source), at, mark).awaitTermination(120)
    assert [(r.name, r.phone) for r in ingest.current(spark, at, ["id"], "version", keep_old=("name",)).where("id = 3").collect()] == [("c", "new")]


def test_records_of_no_batches(spark):
    assert ingest.latest(spark.createDataFrame([], KIND + ", batch int"), ["id"], "version").count() == 0
