"""Files that executors write from tables by the sinks, read again by the readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bytefiles as B
from ..sources import corpus as C
from ..sources import sinks as K
from ..sources.tables import table


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it goes when the driver's JVM ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="folioworks-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/files-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each supplier, which names files: its key ``k``, part ``pt``, chapter ``ch`` and name."""
    k = F.col("s_suppkey").cast("int")
    return table(spark, sf, "supplier").select(k.alias("k"), F.col("s_nationkey").cast("int").alias("pt"), (k % 3).cast("int").alias("ch"), F.trim("s_name").alias("name"))


def json_files(spark: SparkSession, sf: str) -> DataFrame:
    """[K1][K2][S7][S8] Lines of objects, and files that hold an array each."""
    folder = workspace(spark)
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit('é "'), "s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(None)).otherwise(F.col("s_nationkey")).cast("int").alias("nation"))
    K.write_json(rows, f"{folder}/lines")
    whole = F.format_string('[{"s_suppkey": -%d, "name": "a\\nb"},\n {"s_suppkey": -%d, "nation": 4}]', F.col("k") * 2, F.col("k") * 2 + 1)
    B.write_files(_suppliers(spark, sf).select(F.concat("k", F.lit(".json")).alias("path"), whole.alias("content")), f"{folder}/whole")
    schema = "s_suppkey long, name string, nation int"
    found = C.json_lines(spark, f"{folder}/lines", schema).unionByName(C.json_documents(spark, f"{folder}/whole", schema))
    return found.select("s_suppkey", F.coalesce("name", F.lit("-")).alias("name"), F.coalesce("nation", F.lit(-1)).alias("nation"))


def ledger_file(spark: SparkSession, sf: str) -> DataFrame:
    """[S10] Quoted commas, quotes and line breaks."""
    folder = workspace(spark)
    content = F.format_string('key,text\n%d,"%s, ""%d""\nend"\n', "k", "name", "pt")
    B.write_files(_suppliers(spark, sf).select(F.concat("k", F.lit(".csv")).alias("path"), content.alias("content")), folder)
    return C.ledger(spark, folder, "key int, text string")


def _section_folder() -> Column:
    return F.format_string("Rules-Pt%d-Chap%d-sec%d/", "pt", "ch", "k")


def section_files(spark: SparkSession, sf: str) -> DataFrame:
    """[S1][S2][S3][S5] Section folders, polished and raw, and ids that have none."""
    folder, rows = workspace(spark), _suppliers(spark, sf)
    texts = {"b.md": F.lit("second"), "a.md": F.concat(F.lit("text of "), "name"), "a_raw.md": F.concat(F.lit("raw "), "name"), "a_content.md": F.lit("none"), "a.txt": F.lit("none")}
    files = F.explode(F.array(*(F.struct(F.concat(_section_folder(), F.lit(n)).alias("path"), t.alias("content")) for n, t in texts.items()), F.struct(F.format_string("other%d/a.md", "k").alias("path"), F.lit("elsewhere").alias("content"))))
    B.write_files(rows.select(files.alias("f")).select("f.*"), folder)
    listed = C.markdown(spark, [folder])
    polished, raw = (C.sections(spark, [folder], raw=r, files=listed) for r in (False, True))
    ids = rows.select(F.format_string("Pt%d.Ch%d.Sec%d", F.col("pt"), F.col("ch"), F.col("k") + F.when(F.col("k") % 5 == 0, 1_000_000_000).otherwise(0)).alias("section_id"))
    return C.lookup(ids, polished).withColumn("variant", F.lit("polished")).unionByName(C.lookup(ids, raw).withColumn("variant", F.lit("raw")))


def section_listing(spark: SparkSession, sf: str) -> DataFrame:
    """[S4] A part's and a chapter's sections."""
    folder = workspace(spark)
    B.write_files(_suppliers(spark, sf).select(F.concat(_section_folder(), F.lit("a.md")).alias("path"), F.lit("text").alias("content")), folder)
    found = C.sections(spark, [folder])
    return C.listed(found, 1).withColumn("of", F.lit("part")).unionByName(C.listed(found, 2, 0).withColumn("of", F.lit("chapter")))


def regulation_file(spark: SparkSession, sf: str) -> DataFrame:
    """[S6] Subparts with sections, and appendices: a file for each supplier, and one that is cut short."""
    folder = workspace(spark)
    letter = F.expr("char(65 + k % 26)")
    part = F.format_string('<R><DIV6 N="%s" TYPE="SUBPART"><DIV8 N="217.%d" TYPE="SECTION"><HEAD> %s</HEAD><P>a <I>b%d</I>\n c</P></DIV8><DIV8 N="9" TYPE="OTHER"/></DIV6><DIV6 TYPE="X"/></R>', letter, "k", "name", "k")
    app = F.format_string('<R><DIV9 N="Appendix %s to Part 217"><HEAD>App %s</HEAD><P>x</P></DIV9></R>', letter, "name")
    content = F.when(F.col("k") == 8, "<R><DIV9>").otherwise(F.when(F.col("k") % 2 == 1, part).otherwise(app))
    B.write_files(_suppliers(spark, sf).select(F.concat("k", F.lit(".xml")).alias("path"), content.alias("content")), folder)
    found = C.xml_sections(spark, [folder])
    return found.select(F.coalesce("section_id", F.lit("-")).alias("section_id"), F.coalesce("subpart", F.lit("-")).alias("subpart"), F.coalesce("head", F.lit("-")).alias("head"), F.coalesce("text", F.lit("-")).alias("text"), F.coalesce("chars", F.lit(0)).alias("chars"), F.col("error").isNotNull().alias("broken"))


def file_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """[S14] Files by their first bytes."""
    folder = workspace(spark)
    content = F.get(F.array(*map(F.lit, ("%PDF-1.7", "GIF89a", "BM12", "none"))), F.col("k") % 4)
    B.write_files(_suppliers(spark, sf).select(F.concat("k", F.lit(".bin")).alias("path"), content.alias("content")), folder)
    found = C.binary_documents(spark, folder)
    return found.select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("int").alias("key"), F.coalesce("kind", F.lit("-")).alias("kind"), F.length("content").alias("size"))


def _document_files(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """Whole texts of documents as files, ASCII, in a folder for each third; returns the table."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.format_string("d%d/%d.bin", (F.col("doc_id") % 3).cast("int"), "doc_id").alias("name"))
    B.write_files(docs.select(F.col("name").alias("path"), K.ascii_bytes(F.coalesce("text", F.lit(""))).alias("content")), folder)
    return docs


def byte_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """[S11][S12][K5] Ranges of files that paths ask for: by a bucket, by the default bucket and by the file system's own path;
    whole files, ranges that cross the end, and paths of files and buckets that aren't there."""
    folder = workspace(spark)
    docs = _document_files(spark, sf, folder)
    stores = B.Stores({f"b{i}": f"{folder}/d{i}" for i in range(3)} | {"all": folder}, "all")
    k = F.col("doc_id").cast("int")
    base = F.when(k % 4 == 0, F.concat(F.lit("s3://b"), k % 3, F.lit("/"), "doc_id", F.lit(".bin"))).when(k % 4 == 1, F.col("name")).when(k % 4 == 2, F.concat(F.lit(f"{folder}/"), "name")).otherwise(F.concat(F.lit("s3a://b"), k % 5, F.lit("/"), "doc_id", F.lit(".bin")))
    path = F.when(k % 7 == 0, base).otherwise(F.concat(base, F.format_string("?bytes=%d,%d", (k * 37) % 900, k % 300 - 1)))
    got = B.read_ranges(docs.select("doc_id", F.when(k % 11 == 0, F.concat(base, F.lit(".gone"))).otherwise(path).alias("path")), stores)
    return got.select("doc_id", F.coalesce(F.col("content").cast("string"), F.lit("-")).alias("part"), F.col("error").isNotNull().alias("failed"))


def file_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """[S11] Blocks of files as a data source, chosen by offset and path before they are read."""
    folder = workspace(spark)
    _document_files(spark, sf, folder)
    blocks = B.byte_blocks(spark, folder, block=4000).where((F.col("offset") >= 4000) & (F.col("offset") < 20_000) & F.col("path").endswith("0.bin"))
    return blocks.select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long").alias("doc_id"), "offset", "length", "size", F.md5("content").alias("digest"))


def run_appends(spark: SparkSession, sf: str) -> DataFrame:
    """[K3][K4] A run that is written again replaces itself; artefacts stand in tables of their own."""
    folder = workspace(spark)
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    for run, keep in (("a", "s_nationkey < 20"), ("b", "s_nationkey > 10"), ("a", "s_nationkey < 5")):
        K.append_run(rows.where(keep), f"{folder}/runs", run)
    K.write_artefacts({"names": table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "none": rows.limit(0)}, f"{folder}/kinds")
    names = spark.read.parquet(f"{folder}/kinds/names")
    return spark.read.parquet(f"{folder}/runs").join(names, "s_nationkey").groupBy(F.col("run").cast("string").alias("run"), "n_name").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (json_files, ledger_file, section_files, section_listing, regulation_file, file_kinds, byte_ranges, file_blocks, run_appends)}

_SUPPLIERS = "s as (select s_suppkey::int as k, s_nationkey::int as pt, (s_suppkey % 3)::int as ch, trim(s_name) as name from supplier)"

ORACLES = {
    "json_files": """select s_suppkey::bigint as s_suppkey, 'é "' || s_name as name, case when s_suppkey % 3 = 0 then -1 else s_nationkey end::int as nation from supplier
union all select -2 * s_suppkey, 'a' || chr(10) || 'b', -1 from supplier union all select -2 * s_suppkey - 1, '-', 4 from supplier""",
    "ledger_file": f"with {_SUPPLIERS} select k as key, name || ', \"' || pt || '\"' || chr(10) || 'end' as text from s",
    "section_files": f"""with {_SUPPLIERS}, i as (select 'Pt' || pt || '.Ch' || ch || '.Sec' || (k + case when k % 5 = 0 then 1000000000 else 0 end) as section_id, name, k % 5 = 0 as gone from s)
select section_id, case when gone then '' else 'text of ' || name end as text, 'polished' as variant from i union all select section_id, case when gone then '' else 'raw ' || name end, 'raw' from i""",
    "section_listing": f"""with {_SUPPLIERS} select 'Pt1.Ch' || ch || '.Sec' || k as section_id, 'part' as of from s where pt = 1
union all select 'Pt2.Ch0.Sec' || k, 'chapter' from s where pt = 2 and ch = 0""",
    "regulation_file": f"""with {_SUPPLIERS}, n as (select *, chr(65 + k % 26) as letter from s),
r as (select case when k % 2 = 1 then 'Pt217.Subpart' || letter || '.Sec217.' || k else 'Pt217.App' || letter end as section_id, case when k % 2 = 1 then letter else '-' end as subpart, case when k % 2 = 1 then name else 'App ' || name end as head,
  case when k % 2 = 1 then name || ' a b' || k || ' c' else 'App ' || name || ' x' end as text from n where k <> 8) select *, length(text)::int as chars, false as broken from r union all select '-', '-', '-', '-', 0, true from n where k = 8""",
    "file_kinds": "select s_suppkey::int as key, (['pdf', 'gif', 'bmp', '-'])[s_suppkey % 4 + 1] as kind, ([8, 6, 4, 4])[s_suppkey % 4 + 1] as size from supplier",
    "byte_ranges": """with d as (select doc_id, doc_id::int as k, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g') as t from documents),
r as (select *, k % 11 = 0 or (k % 4 = 3 and k % 5 <> k % 3) as failed, k % 7 = 0 as whole, (k * 37) % 900 as o, k % 300 - 1 as n from d)
select doc_id, case when failed then '-' when whole then t when n < 0 then substr(t, o + 1) else substr(t, o + 1, n) end as part, failed from r""",
    "file_blocks": """with d as (select doc_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g') as t from documents),
b as (select doc_id, t, unnest(range(0, length(t), 4000)) as o from d where doc_id % 10 = 0)
select doc_id, o::bigint as "offset", least(4000, length(t) - o)::bigint as length, length(t)::bigint as size, md5(substr(t, o::int + 1, 4000)) as digest from b where o >= 4000 and o < 20000""",
    "run_appends": """select 'a' as run, n_name, count(*) as n from supplier join nation on s_nationkey = n_nationkey where s_nationkey < 5 group by all union all
select 'b', n_name, count(*) from supplier join nation on s_nationkey = n_nationkey where s_nationkey > 10 group by all""",
}
