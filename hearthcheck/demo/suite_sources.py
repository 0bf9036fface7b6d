"""Registered source, sink and refresh queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthcheck.demo.registry import query
from hearthcheck.demo.views import base_table
from hearthcheck.session import new_work_path
from hearthcheck.sources import exports as X
from hearthcheck.sources import sinks as K
from hearthcheck.sources import tables as ST
from hearthcheck.streaming import refresh as SR

# Export files named after the events of a log: their table and date are written in several ways.
NAMES = {
    0: ("concat('FNewDeath_', {iso}, '.csv')", "FNewDeath", True),
    1: ("concat('FNewBirth', '_', {compact}, '.CSV')", "FNewBirth", True),
    2: ("concat({day_first}, ' - FNewEmploi.xlsx')", "FNewEmploi", True),
    3: ("'FNewSante.dta'", "FNewSante", False),
    4: ("concat('FNewDeath_2024-13-45_', {compact}, '.xls')", "FNewDeath", True),
    5: ("concat('guide ', {iso}, '.pdf')", "guide_pdf", True),
}


def names_sql(iso: str, compact: str, day_first: str) -> str:
    cases = " ".join(
        f"when {i} then {text.format(iso=iso, compact=compact, day_first=day_first)}" for i, (text, *_) in NAMES.items()
    )
    return f"case event_id % {len(NAMES)} {cases} end"


SPARK_NAME = names_sql("date_format(ts, 'yyyy-MM-dd')", "date_format(ts, 'yyyyMMdd')", "date_format(ts, 'dd.MM.yyyy')")
DUCK_NAME = names_sql("strftime(ts, '%Y-%m-%d')", "strftime(ts, '%Y%m%d')", "strftime(ts, '%d.%m.%Y')")
FILES = f"""
  files as (select {DUCK_NAME} as name, 'export_' || strftime(ts, '%Y-%m-%d') as folder, ts as modified, event_id as size,
    event_id % {len(NAMES)} as kind,
    case when event_id % {len(NAMES)} <> 3 then cast(ts as date) end as dated,
    case event_id % {len(NAMES)} when 0 then 'FNewDeath' when 1 then 'FNewBirth' when 2 then 'FNewEmploi' when 3 then 'FNewSante'
      when 4 then 'FNewDeath' else 'guide_pdf' end as table_name from events)
"""


def _files(spark, folder):
    named = base_table(spark, folder, "events").selectExpr(
        f"{SPARK_NAME} as name", "concat('export_', date_format(ts, 'yyyy-MM-dd')) as folder", "ts as modified", "event_id as size"
    )
    return named.withColumn("path", F.concat_ws("/", F.lit("/exports"), "folder", "name"))


@query(
    "export_dates",
    f"with {FILES} select name, table_name, cast(dated as varchar) as export_date, count(*) as n from files group by all",
)
def export_dates(spark, folder):
    named = _files(spark, folder)
    parsed = named.select(
        "name", X.base_name(F.col("name")).alias("table_name"), X.export_date(F.col("name")).cast("string").alias("export_date")
    )
    return parsed.groupBy("name", "table_name", "export_date").agg(F.count("*").alias("n"))


@query(
    "latest_export",
    f"""
    with {FILES}, ranked as (select *, row_number() over (partition by table_name
      order by coalesce(cast(dated as timestamp), modified) desc, modified desc, '/exports/' || folder || '/' || name) as rn
      from files where kind <> 5)
    select table_name, name, size, cast(dated as varchar) as export_date from ranked where rn = 1
    """,
)
def latest_export(spark, folder):
    chosen = X.latest_per_table(_files(spark, folder))
    return chosen.select(
        F.col("table").alias("table_name"), "name", "size", F.col("export_date").cast("string").alias("export_date")
    )


@query(
    "latest_batch",
    f"with {FILES} select name, count(*) as n from files where folder = (select max(folder) from files) group by name",
)
def latest_batch(spark, folder):
    batch = X.latest_batch(_files(spark, folder), "/exports")
    return batch.groupBy("name").agg(F.count("*").alias("n"))


@query(
    "batch_tables_or_archive",
    f"with {FILES} select name, count(*) as n from files where folder = (select max(folder) from files) and kind <> 5 group by name",
)
def batch_tables_or_archive(spark, folder):
    chosen = X.tables_or_archive(X.latest_batch(_files(spark, folder), "/exports"))
    return chosen.groupBy("name").agg(F.count("*").alias("n"))


@query(
    "folder_diagnostic",
    f"""
    with {FILES} select case when kind = 5 then 'other' else 'table' end as kind, table_name,
      cast(count(*) as bigint) as n_files, cast(sum(size) as bigint) as total_size, cast(max(dated) as varchar) as newest
    from files group by all
    """,
)
def folder_diagnostic(spark, folder):
    listed = X.diagnose(_files(spark, folder))
    return listed.groupBy("kind", F.col("table").alias("table_name")).agg(
        F.count("*").alias("n_files"), F.sum("size").alias("total_size"), F.max("export_date").cast("string").alias("newest")
    )


@query(
    "export_ready_columns",
    """
    select c_custkey as c_custkey, case when c_acctbal > 0 then 'True' else 'False' end as is_positive_,
      c_mktsegment as une_colonne_avec_un_nom_vraiment, c_nationkey as une_colonne_avec_un_nom_vraime_1, c_acctbal as v_2024_solde
    from customer
    """,
)
def export_ready_columns(spark, folder):
    """Names fit for a restricted target, booleans as text."""
    customers = base_table(spark, folder, "customer").select(
        "c_custkey",
        (F.col("c_acctbal") > 0).alias("is positive?"),
        F.col("c_mktsegment").alias("une colonne avec un nom vraiment trop long"),
        F.col("c_nationkey").alias("une colonne avec un nom vraiment bien trop long"),
        F.col("c_acctbal").alias("2024 solde"),
    )
    return K.booleans_as_text(K.with_restricted_names(customers))


@query("csv_semicolon_scan", "select s_suppkey::integer as s_suppkey, s_nationkey, s_acctbal from supplier")
def csv_semicolon_scan(spark, folder):
    """A table written with semicolons comes back whole, its delimiter found from the header."""
    path = new_work_path(spark, "semicolon")
    base_table(spark, folder, "supplier").write.option("sep", ";").csv(path, header=True)
    return ST.R.drop_person_names(ST.read_csv(spark, path))


def _inbox(spark, arrivals, schema, label):
    """Exports arrive one after another and are refreshed each time; gives the folder of the snapshots."""
    work = new_work_path(spark, label)
    inbox, target, checkpoint = f"{work}/inbox", f"{work}/snapshots", f"{work}/checkpoint"
    for name, rows in arrivals:
        if isinstance(rows, str):
            rows = spark.range(1).select(F.lit(rows))
            rows.write.text(f"{inbox}/{name}")
        else:
            rows.write.csv(f"{inbox}/{name}", header=True)
        SR.refresh_tables(SR.incoming(spark, inbox, "part-*"), target, checkpoint, schema).awaitTermination()
    return target


SUPPLIER = "s_suppkey bigint, s_nationkey int, s_acctbal double"


@query(
    "refresh_newest_snapshot",
    "select s_suppkey, s_nationkey, s_acctbal + 1 as s_acctbal from supplier where s_suppkey % 4 <> 0",
)
def refresh_newest_snapshot(spark, folder):
    """Three dated exports arrive, an older one last: the stream leaves the newest one as the table."""
    suppliers = base_table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    arrivals = (
        ("FNewAgents_2024-01-01", suppliers),
        ("FNewAgents_2024-03-01", suppliers.where("s_suppkey % 4 <> 0").withColumn("s_acctbal", F.col("s_acctbal") + 1)),
        ("FNewAgents_2024-02-01", suppliers.where("s_suppkey < 5")),
    )
    return SR.current_snapshot(spark, _inbox(spark, arrivals, SUPPLIER, "refresh"), "FNewAgents")


@query(
    "refresh_many_tables",
    """
    select 'FNewAgents' as table_name, count(*) as n, sum(s_suppkey)::bigint as keys, 0::bigint as problems from supplier
    union all select 'FNewTeams', count(*), sum(s_suppkey)::bigint, 1 from supplier where s_suppkey % 2 = 0
    """,
)
def refresh_many_tables(spark, folder):
    """Two tables share an inbox; the newest export of one cannot be read, so its older one stays and the report says why."""
    suppliers = base_table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    arrivals = (
        ("FNewTeams_2024-01-01", suppliers.where("s_suppkey % 2 = 0")),
        ("FNewTeams_2024-02-01", "s_suppkey,s_nationkey,s_acctbal\ntorn,line"),
        ("FNewAgents_2024-01-01", suppliers),
    )
    target = _inbox(spark, arrivals, SUPPLIER, "refresh-many")
    told = SR.problems(spark, target).groupBy("table_name").agg(F.countDistinct("export").alias("problems"))
    rows = SR.current_snapshot(spark, target).groupBy("table_name").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))
    return rows.join(told, "table_name", "left").na.fill(0)


def _zip_of(folder):
    """Write one archive per group of rows: a table member, and a damaged one beside it."""

    def write(rows):
        import io
        import re
        import zipfile

        import pandas as pd
        from pyarrow import fs

        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("deep/FNewAgents.csv", rows[["s_suppkey", "s_nationkey"]].to_csv(index=False, sep=";"))
            z.writestr("FNewTorn.csv", "a;b\n" * 9_000)
        raw = bytearray(held.getvalue())
        at = raw.index(b"FNewTorn.csv") + 14
        raw[at : at + 8] = b"\xff" * 8
        store, root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder)) if ":" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        name = f"export_{int(rows['part'].iloc[0])}.zip"
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(bytes(raw))
        return pd.DataFrame({"name": [name]})

    return write


@query(
    "archive_members_loaded",
    """
    select 'rows' as kind, count(*) as n, sum(s_suppkey)::bigint as keys from supplier
    union all select 'errors', count(distinct s_suppkey // 50), null from supplier
    """,
)
def archive_members_loaded(spark, folder):
    """Suppliers go into archives of fifty, each beside a damaged member; the good members load whole, the bad ones are reported."""
    work = f"{new_work_path(spark, 'zip')}/batch_2024-01-01"
    suppliers = base_table(spark, folder, "supplier").selectExpr("s_suppkey", "s_nationkey", "cast(floor(s_suppkey / 50) as bigint) as part")
    names = [r["name"] for r in suppliers.groupBy("part").applyInPandas(_zip_of(work), "name string").collect()]
    members, errors = X.expand_archives(spark, [f"{work}/{n}" for n in names])
    reader = spark.read.schema("s_suppkey bigint, s_nationkey int").option("header", True).option("sep", ";")
    loaded = reader.csv([path for _, path in members])
    rows = loaded.agg(F.lit("rows").alias("kind"), F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))
    told = spark.range(1).select(F.lit("errors").alias("kind"), F.lit(len(errors)).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("keys"))
    return rows.unionByName(told)


@query(
    "formats_round_trip",
    "select f as format, count(*) as n, sum(s_suppkey)::bigint as keys from supplier, (values ('csv'), ('json'), ('orc'), ('parquet')) t(f) group by f",
)
def formats_round_trip(spark, folder):
    """The reader is chosen by the extension of the file."""
    suppliers = base_table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    parts = []
    for kind in ("csv", "json", "orc", "parquet"):
        path = f"{new_work_path(spark, 'format')}/FNewAgents.{kind}"
        writer = suppliers.write.option("header", True) if kind == "csv" else suppliers.write
        writer.format(kind).save(path)
        parts.append(ST.read_table(spark, path).agg(F.lit(kind).alias("format"), F.count("*").alias("n"), F.sum("s_suppkey").cast("bigint").alias("keys")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("documents_read", "select doc_id, md5(text) as digest from documents where text <> ''")
def documents_read(spark, folder):
    """Each document is written as a text file of its own and the folder is read back."""
    path = new_work_path(spark, "texts")
    documents = base_table(spark, folder, "documents")
    named = documents.where("text <> ''").select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".md")).alias("name"), "text")
    K.write_documents(named, path, -(-documents.count() // K.FOLDER_FILES))
    found = ST.read_documents(spark, path)
    return found.select(F.col("stem").try_cast("bigint").alias("doc_id"), F.md5(F.rtrim("text", F.lit("\u0001"))).alias("digest"))


@query("csv_export", "select s_suppkey, s_nationkey, case when s_acctbal > 0 then 'True' else 'False' end as in_credit from supplier")
def csv_export(spark, folder):
    """Written with a byte-order mark and booleans as text, and read back."""
    path = f"{new_work_path(spark, 'export')}/agents"
    rows = base_table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") > 0).alias("in_credit"))
    K.export(rows, path, "CSV")
    back = ST.read_csv(spark, path)
    first = back.columns[0]
    return back.select(F.col(f"`{first}`").cast("bigint").alias("s_suppkey"), "s_nationkey", F.initcap(F.col("in_credit").cast("string")).alias("in_credit"))


HISTORY_BATCHES = 4


@query(
    "load_history",
    f"""
    select s_suppkey % {HISTORY_BATCHES} as batch, 'f' || s_suppkey as file, count(*) as n_rows, sum(ps)::bigint as checksum,
      {HISTORY_BATCHES} - s_suppkey % {HISTORY_BATCHES} as place
    from (select s_suppkey, s_nationkey as ps from supplier) q group by s_suppkey
    """,
)
def load_history(spark, folder):
    """One load per supplier, recorded in batches one after another and listed newest first."""
    path = new_work_path(spark, "history")
    suppliers = base_table(spark, folder, "supplier")
    loads = suppliers.groupBy("s_suppkey").agg(F.count("*").alias("n_rows"), F.sum("s_nationkey").cast("string").alias("source"))
    loads = loads.select("s_suppkey", F.concat(F.lit("f"), "s_suppkey").alias("file"), F.lit("t").alias("table"), "n_rows", F.lit(None).cast("date").alias("export_date"), "source")
    for k in range(HISTORY_BATCHES):
        K.record_loads(spark, path, loads.where(F.col("s_suppkey") % HISTORY_BATCHES == k))
    listed = K.load_history(spark, path)
    newest = listed.groupBy("loaded_at").agg(F.count("*").alias("n")).select("loaded_at", F.row_number().over(Window.orderBy(F.desc("loaded_at"))).cast("bigint").alias("place"))
    batch = F.substring("file", 2, 20).cast("bigint") % HISTORY_BATCHES
    return listed.join(F.broadcast(newest), "loaded_at").select(batch.alias("batch"), "file", "n_rows", F.col("source").cast("bigint").alias("checksum"), "place")
