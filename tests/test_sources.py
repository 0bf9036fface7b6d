import datetime
import os
import zipfile

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from hearthcheck.plans.catalog import TableSet
from hearthcheck.sources import exports as X
from hearthcheck.sources import sinks as K
from hearthcheck.sources import tables as ST
from hearthcheck.streaming import refresh as SR


@pytest.mark.parametrize(
    "name, table, day",
    [
        ("FNewIndividual_2026-08-03.csv", "FNewIndividual", "2026-08-03"),
        ("FNewIndividual_20260803.CSV", "FNewIndividual", "2026-08-03"),
        ("03-08-2026 FNewDeath.xlsx", "FNewDeath", "2026-08-03"),
        ("FNewDeath.dta", "FNewDeath", None),
        ("x_2026-13-45_20260102.csv", "x", "2026-01-02"),
        ("120260803.csv", "120260803", None),
        ("2026.08.03.csv", "2026.08.03.csv", "2026-08-03"),
    ],
)
def test_names_tell_table_and_date(make, name, table, day):
    row = make("n string", (name,)).select(X.base_name(F.col("n")), X.export_date(F.col("n")).cast("string")).first()
    assert tuple(row) == (table, day)


LISTING = "path string, name string, folder string, modified timestamp_ntz, size int"


def file(path, modified="2026-01-01"):
    parts = path.split("/")
    return (path, parts[-1], parts[-2], datetime.datetime.fromisoformat(modified), 1)


def test_latest_file_of_each_table(make):
    files = make(
        LISTING, file("/e/a_2026-08-01.csv", "2026-09-01"), file("/e/a_2026-08-03.csv"), file("/e/a_2026-08-02.csv"),
        file("/e/b.csv", "2026-01-05"), file("/e/guide.pdf"), file("/e/c1/c.csv"), file("/e/c2/c.csv"),
    )
    chosen = X.latest_per_table(files)
    assert as_set(chosen, "table", "path") == {("a", "/e/a_2026-08-03.csv"), ("b", "/e/b.csv"), ("c", "/e/c1/c.csv")}


def test_latest_batch_and_archive_fallback(make):
    files = make(
        LISTING, file("/e/root.csv"), file("/e/export_2026-07-30_12-50-37/a.csv"), file("/e/export_2026-08-01_01-00-00/b.zip"),
        file("/e/export_2026-08-01_01-00-00/old_2020-01-01.zip", "2026-01-02"), file("/e/export_2026-08-01_01-00-00/deep/c.csv"),
    )
    batch = X.latest_batch(files, "/e")
    assert as_set(batch, "name") == {"b.zip", "old_2020-01-01.zip"}
    assert as_set(X.tables_or_archive(batch), "name") == {"b.zip"}
    flat = make(LISTING, file("/e/a.csv"), file("/e/z.zip"))
    assert as_set(X.tables_or_archive(X.latest_batch(flat, "/e")), "name") == {"a.csv"}


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_semicolons_are_found(spark, tmp_path):
    path = write(tmp_path, "t.csv", "﻿individid;respondid;agent_name;nom\n1;2;A;x\n3;4;B,C;y\n")
    assert ST.detect_delimiter(spark, path) == ";"
    assert as_set(ST.read_table(spark, path)) == {(1, 2, "A"), (3, 4, "B,C")}
    assert as_set(ST.read_csv(spark, path, "a int, b int, c string, d string"), "a") == {1, 3}
    assert ST.detect_delimiter(spark, write(tmp_path, "one.csv", "x\n1\n")) == ","
    with pytest.raises(ValueError, match="Unsupported"):
        ST.read_table(spark, "file.xyz")


def test_folder_is_loaded_and_failures_stay_apart(spark, tmp_path):
    write(tmp_path, "old_2020-01-01/FNewDeath.csv", "individid\n1\n")
    write(tmp_path, "new_2026-01-01/FNewDeath_2026-01-01.csv", "individid\n7\n8\n")
    write(tmp_path, "new_2026-01-01/empty.csv", "a,b\n")
    write(tmp_path, "new_2026-01-01/broken.parquet", "no parquet")
    tables, problems = ST.load_folder(spark, str(tmp_path))
    assert list(tables) == ["FNewDeath"] and tables["FNewDeath"].count() == 2
    assert {p[0] for p in problems} == {"empty", "broken"}
    again, _ = ST.load_files(spark, [("FNewDeath", str(tmp_path / "old_2020-01-01/FNewDeath.csv"))], tables)
    assert list(again) == ["FNewDeath", "old_2020-01-01_FNewDeath"]


def zip_file(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_csv", ".csv").replace("_pdf", ".pdf"), text)


def test_archives_are_expanded_and_bad_ones_reported(spark, tmp_path):
    zip_file(tmp_path / "good.zip", deep__t_csv="a;b\r\n1;2\r\n" + "3;4\n" * 400_000, notes_pdf="no")
    with zipfile.ZipFile(tmp_path / "good.zip", "a") as z:
        z.writestr("__MACOSX/t.csv", "no")
        z.writestr(".hidden.csv", "no")
    write(tmp_path, "bad.zip", "not an archive")
    # one member of two is damaged
    zip_file(tmp_path / "half.zip", ok_csv="a,b\n7,8\n", torn_csv="x,y\n" + "1,2\n" * 5_000)
    raw = bytearray((tmp_path / "half.zip").read_bytes())
    at = raw.index(b"torn.csv") + 12
    raw[at : at + 6] = b"\xff" * 6
    (tmp_path / "half.zip").write_bytes(raw)
    members, errors = X.expand_archives(spark, [str(tmp_path / n) for n in ("good.zip", "bad.zip", "half.zip")])
    assert {m[0] for m in members} == {"t.csv", "ok.csv"} and {e[0] for e in errors} == {"bad.zip", "torn.csv"}
    paths = dict(members)
    assert ST.read_csv(spark, paths["t.csv"]).agg(F.sum("a"), F.count("*")).first() == (1_200_001, 400_001)
    assert as_set(ST.read_csv(spark, paths["ok.csv"])) == {(7, 8)}


def test_folder_with_an_archive_only(spark, tmp_path):
    zip_file(tmp_path / "export_2026-01-01.zip", FNewDeath_csv="individid,nom\n1,x\n", FNewBirth_csv="individid\n2\n3\n")
    zip_file(tmp_path / "export_2025-01-01.zip", FNewDeath_csv="individid,nom\n9,x\n")
    tables, found = ST.load_folder(spark, str(tmp_path))
    assert {n: as_set(t) for n, t in tables.items()} == {"FNewDeath": {1}, "FNewBirth": {2, 3}} and found == []


def test_members_are_unpacked_apart_and_large_ones_become_several_files(spark, tmp_path):
    members = {f"t{k}_csv": "a,b\n" + "".join(f"{k},{n}\n" for n in range(50)) for k in range(20)}
    zip_file(tmp_path / "many.zip", **members, empty_csv="", big_csv="a,b\r\n" + "".join(f"99,{n}\r\n" for n in range(30_000)))
    found, errors = X.expand_archives(spark, [str(tmp_path / "many.zip")], piece_bytes=10_000, file_pieces=4)
    assert errors == [] and len(found) == 21
    rows = {name: spark.read.option("header", True).schema("a int, b int").csv(path) for name, path in found}
    big = rows["big.csv"]
    assert len(big.inputFiles()) > 5 and as_set(big) == {(99, n) for n in range(30_000)} and big.count() == 30_000
    assert all(as_set(rows[f"t{k}.csv"]) == {(k, n) for n in range(50)} for k in range(20))
    # one task per member: the parts differ, and each is unpacked in a partition of its own
    folder = next(path for _, path in found).rsplit("/members/", 1)[0]
    pieces = spark.read.schema(X.PIECES).parquet(f"{folder}/pieces").select(F.input_file_name().alias("f"), "part").distinct()
    assert pieces.select("part").distinct().count() == 21 and pieces.select("f").distinct().count() >= 15


def test_documents_and_pending_conversions(spark, make, tmp_path):
    for name in ("a.txt", "b.md", "c.pdf", "Skip.txt"):
        write(tmp_path, name, f"text of {name}\nsecond line")
    found = ST.read_documents(spark, str(tmp_path), ignored_stems=["skip"])
    assert as_set(found, "stem", "text") == {("a", "text of a.txt\nsecond line"), ("b", "text of b.md\nsecond line")}
    sources = make("stem string, modified int, text string", ("a", 5, "x"), ("b", 5, "x"), ("c", 5, " "), ("d", 5, "x"))
    done = make("stem string, modified int", ("a", 5), ("b", 4))
    assert as_set(ST.documents_to_convert(sources, done), "stem") == {"b", "d"}


def test_staleness(make):
    files = make("modified timestamp_ntz", (datetime.datetime(2026, 1, 2),))
    assert ST.is_index_stale(files, "2026-01-03").first()["stale"] is False
    assert ST.is_index_stale(files, "2026-01-01").first()["stale"] is True
    assert ST.is_index_stale(files, None).first()["stale"] is True


def test_database_options():
    assert ST.jdbc_options("jdbc:x", 'a"b') == {"url": "jdbc:x", "dbtable": '"a""b"', "fetchsize": "10000"}
    ranged = ST.jdbc_options("jdbc:x", "t", "id", (0, 100), 4)
    assert (ranged["partitionColumn"], ranged["numPartitions"]) == ("id", "4")


def test_restricted_names():
    long = "c" * 40
    assert K.restricted_names(["a b", "a_b", "2x", long, long, ""]) == ["a_b", "a_b_1", "v_2x", "c" * 32, "c" * 30 + "_1", "v_"]


def test_csv_export_starts_with_a_mark(spark, make, tmp_path):
    df = make("id int, ok boolean, t string", (1, True, "é"), (2, None, None))
    K.export(df, str(tmp_path / "out"), "CSV")
    part = next(p for p in os.listdir(tmp_path / "out") if p.startswith("part-") and p.endswith(".csv"))
    with open(tmp_path / "out" / part, "rb") as f:
        assert f.read(3) == b"\xef\xbb\xbf"
    assert ST.read_csv(spark, str(tmp_path / "out")).columns == ["id", "ok", "t"]
    K.export(df, str(tmp_path / "pq"), "parquet", restricted=True)
    assert as_set(spark.read.parquet(str(tmp_path / "pq")), "ok") == {"True", None}
    with pytest.raises(ValueError, match="Unsupported"):
        K.export(df, str(tmp_path / "no"), "docx")


def test_load_history_is_newest_first(spark, make, tmp_path):
    path = str(tmp_path / "history")
    schema = "file string, table string, n_rows int, export_date date, source string"
    K.record_loads(spark, path, make(schema, ("a.csv", "a", 3, datetime.date(2026, 1, 1), "folder")))
    K.record_loads(spark, path, make(schema, ("b.csv", "b", 4, None, "folder")))
    assert [r["table"] for r in K.load_history(spark, path).collect()] == ["b", "a"]


def refresh(spark, tmp_path, pattern="*.csv", schema="individid int, nom string", kind="csv"):
    inbox, target, mark = (str(tmp_path / n) for n in ("inbox", "table", "mark"))
    SR.refresh_tables(SR.incoming(spark, inbox, pattern), target, mark, schema, kind).awaitTermination()
    return target


def test_refresh_takes_each_file_once_and_keeps_the_newest(spark, tmp_path):
    inbox = str(tmp_path / "inbox")

    def now():
        return as_set(SR.current_snapshot(spark, refresh(spark, tmp_path, "t_*.csv"), "t"))

    write(inbox, "t_2026-01-01.csv", "individid,nom\n1,x\n2,y\n")
    write(inbox, "other_2027-01-01.csv", "individid,nom\n9,x\n")
    assert now() == {1, 2}
    write(inbox, "t_2026-02-01.csv", "individid,nom\n3,x\n")
    assert now() == {3}
    write(inbox, "t_2025-12-01.csv", "individid,nom\n4,x\n")
    assert now() == {3}
    assert now() == {3}


def test_refresh_keeps_every_table_of_an_inbox(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    write(inbox, "FNewBirth_2024-01-01.csv", "individid,nom\n1,x\n2,x\n")
    write(inbox, "FNewDeath_2024-01-01.csv", "individid,nom\n3,x\n")
    write(inbox, "FNewDeath_2023-01-01.csv", "individid,nom\n4,x\n")
    target = refresh(spark, tmp_path)
    assert as_set(SR.current_snapshot(spark, target), "table_name", "individid") == {("FNewBirth", 1), ("FNewBirth", 2), ("FNewDeath", 3)}


def test_unreadable_export_is_reported_and_tried_again(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    write(inbox, "t_2026-01-01.csv", "individid,nom\n1,x\n")
    write(inbox, "t_2026-02-01.csv", "individid,nom\nbroken line,x\n")
    write(inbox, "u_2026-02-01.csv", "individid,nom\n5,x\n")
    target = refresh(spark, tmp_path)
    assert as_set(SR.current_snapshot(spark, target), "table_name", "individid") == {("t", 1), ("u", 5)}
    assert as_set(SR.problems(spark, target), "table_name", "export") == {("t", "t_2026-02-01.csv")}
    write(inbox, "t_2026-02-01.csv", "individid,nom\n2,x\n")
    write(inbox, "u_2026-03-01.csv", "individid,nom\n6,x\n")
    refresh(spark, tmp_path)
    assert as_set(SR.current_snapshot(spark, target), "table_name", "individid") == {("t", 2), ("u", 6)}


def test_batch_replay_overwrites_itself(spark, make, tmp_path):
    inbox, target = str(tmp_path / "inbox"), str(tmp_path / "table")
    write(inbox, "t_2026-01-01.csv", "x\n1\n2\n")
    batch = make("path string", (f"file:{inbox}/t_2026-01-01.csv",)).withColumn("modified", F.current_timestamp())
    for _ in range(2):
        SR.keep_newest(target, "x int")(batch, 7)
    assert SR.current_snapshot(spark, target, "t").count() == 2


def test_snapshot_opens_one_export_per_table_and_old_ones_go(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    for month in range(1, 7):
        write(inbox, f"t_2026-{month:02d}-01.csv", f"individid,nom\n{month},x\n")
        write(inbox, f"u_2026-{month:02d}-01.csv", f"individid,nom\n{10 * month},x\n")
        target = refresh(spark, tmp_path)
    assert len(os.listdir(tmp_path / "table" / "exports")) == 2 * SR.KEPT_EXPORTS
    assert len(SR._versions(spark, target)) == SR.KEPT_MANIFESTS
    now = SR.current_snapshot(spark, target)
    assert as_set(now, "table_name", "individid") == {("t", 6), ("u", 60)}
    assert len({os.path.dirname(f) for f in now.inputFiles()}) == 2
    assert as_set(SR.manifest(spark, target), "table_name", "export") == {(t, f"{t}_2026-0{m}-01.csv") for t in "tu" for m in (5, 6)}


def test_a_batch_that_fails_before_its_commit_changes_nothing(spark, make, tmp_path, monkeypatch):
    inbox, target = str(tmp_path / "inbox"), str(tmp_path / "table")

    def batch(*names):
        return make("path string", *((f"file:{inbox}/{n}",) for n in names)).withColumn("modified", F.current_timestamp())

    write(inbox, "t_2026-01-01.csv", "x\n1\n")
    SR.keep_newest(target, "x int")(batch("t_2026-01-01.csv"), 1)
    write(inbox, "t_2026-02-01.csv", "x\n2\n")
    with monkeypatch.context() as broken:
        broken.setattr(SR, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            SR.keep_newest(target, "x int")(batch("t_2026-02-01.csv"), 2)
    assert as_set(SR.current_snapshot(spark, target, "t")) == {1}
    for _ in range(2):  # replayed, and once more
        SR.keep_newest(target, "x int")(batch("t_2026-02-01.csv"), 2)
        assert as_set(SR.current_snapshot(spark, target, "t")) == {2}
    assert len(os.listdir(tmp_path / "table" / "exports")) == 2
    with pytest.raises(ValueError):
        SR.current_snapshot(spark, target, "nothing")


def test_derived_tables_are_published(spark, make):
    tables = TableSet()
    tables.publish("difference_a_sans_b", make("x int", (1,)))
    assert spark.table("difference_a_sans_b").count() == 1
    with pytest.raises(ValueError):
        TableSet().summary()


def test_documents_are_written_into_few_folders_and_read_back(spark, make, tmp_path):
    """One folder per document would be listed, and renamed, one by one."""
    texts = {f"{k}.md": f" line {k}\r\n\nend\n" for k in range(60)}
    K.write_documents(make("name string, text string", *texts.items(), ("7.md", " line 7\r\n\nend\n")), str(tmp_path / "out"), 3)
    folders = list((tmp_path / "out").iterdir())
    assert len(folders) <= 3 and sum(len(list(x.iterdir())) for x in folders) == 60
    got = {r["stem"]: r["text"] for r in ST.read_documents(spark, str(tmp_path / "out")).collect()}
    assert got == {n[:-3]: (t + "\u0001") * (2 if n == "7.md" else 1) for n, t in texts.items()}


def test_documents_are_listed_and_read_by_tasks(spark, tmp_path):
    """The driver describes folders, not files; paths, times and texts are those that Spark's reader gives."""
    names = ["a.txt", "sub/b c.md", "sub/deep/é+%41#&=.TXT", "sub/_hidden.md", ".x/c.md", "_gone/d.md", "_k=1/e.md", "f.pdf", "sub/empty.md", "sub/g._COPYING_"]
    for name in names:
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        write(tmp_path / "in", name, "" if "empty" in name else f"text of {name}\r\n﻿end")
    (tmp_path / "in" / "sub" / "raw.md").write_bytes(b"\xff\xfea\x00")
    folder = f"file://{tmp_path}/in"
    found = ST.read_documents(spark, folder)
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() <= max(4, spark.sparkContext.defaultParallelism)
    plain = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    plain = plain.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").cast("binary").alias("text"))
    want = as_set(plain.where(F.lower("path").rlike(r"\.(txt|md)$")))
    assert len(want) == 5
    assert as_set(found.withColumn("text", F.col("text").cast("binary")), "path", "modified", "text") == want
    assert ST.read_documents(spark, f"{folder}/a.txt").count() == 1
