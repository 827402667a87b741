"""Readers of dump files: typed JSON lines, nested documents, pages with a manifest; writers of sidecars and sheets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tanzaku.operators.merging import latest

#: Schemas of the dump files; no inference pass over the data.
SCHEMAS = {
    "subject": "id int, type int, name string, name_cn string, infobox string, platform int, summary string, nsfw boolean, date string, score double, rank int, favorite map<string,int>, score_details map<string,int>, tags array<struct<name:string,count:int>>, meta_tags array<string>",
    "subject-relations": "subject_id int, relation_type int, related_subject_id int",
    "person": "id int, name string, career array<string>, infobox string",
    "subject-persons": "subject_id int, person_id int, position int",
    "subject-characters": "subject_id int, character_id int, type int",
    "person-characters": "person_id int, subject_id int, character_id int",
    "character": "id int, name string, infobox string, summary string",
}
FORMS = ("TV", "WEB", "剧场版", "OVA")  # in order of priority
DONE_LEAST, KIND = 50, 2
#: Fields of an infobox that hold a date, longer names before their beginnings.
DATE_FIELDS = "放送开始日|放送开始|上映年度|上映日期|发行日期|首播|公开日|发售日"


def read_dump(spark: SparkSession, path: str, name: str) -> DataFrame:
    """JSON lines of a known dump; broken lines become null rows and are dropped."""
    df = spark.read.schema(SCHEMAS[name]).json(path)
    return df.where(F.coalesce(*[F.col(c).cast("string") for c, t in df.dtypes if t in ("int", "string", "boolean", "double")]).isNotNull())


def read_manifest(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """A manifest in JSON lines of which the last record of each key holds, by file and position."""
    df = spark.read.schema(schema).json(path).withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return latest(df, [key], [F.col("_at").desc()]).drop("_at")


def read_pages(spark: SparkSession, folder: str, manifest: DataFrame, key: str = "pageid") -> tuple[DataFrame, DataFrame]:
    """((key, html) of the gzipped pages ``folder/<key>.html.gz``, keys of the manifest without a page)."""
    number = lambda path: F.regexp_extract(path, r"([^/]+)\.html\.gz$", 1).try_cast("long").alias(key)
    raw = spark.read.text(f"{folder}/*.html.gz", wholetext=True).select(number(F.input_file_name()), F.col("value").alias("html"))
    there = spark.read.format("binaryFile").load(f"{folder}/*.html.gz").select(number(F.col("path")))  # the listing alone, no content
    wanted = manifest.select(F.col(key).cast("long").alias(key)).distinct()
    return raw.join(wanted, key, "left_semi"), wanted.join(there, key, "left_anti")


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """(item, site, id) of a document ``{items: [{sites: [{site, id}]}]}``; sites without an id are skipped."""
    doc = spark.read.schema("items array<struct<title:string,sites:array<struct<site:string,id:string>>>>").option("multiLine", True).json(path)
    sites = doc.select(F.posexplode("items").alias("item", "x")).select("item", F.inline("x.sites"))
    return sites.where("id is not null")


def year_of(date: Column, infobox: Column) -> Column:
    """The year of a date, else the first 19xx or 20xx of a date field of the infobox; null if there is none."""
    field = F.regexp_extract(infobox, rf"\|\s*(?:{DATE_FIELDS})\s*=[^\r\n]*?((?:19|20)\d\d)", 1)
    return F.coalesce(F.when(date.rlike(r"^\d{4}"), F.substring(date, 1, 4).try_cast("int")), F.nullif(field, F.lit("")).try_cast("int"))


def full_date(date: Column) -> Column:
    """Only texts of ten characters are dates; others, and days that are none, are null."""
    return F.when(F.length(date) == 10, F.try_to_date(date))


def candidates(subjects: DataFrame) -> DataFrame:
    """Works of the right kind with a year, a form and enough readers; ``form`` is the first of the forms in priority."""
    got = F.array_intersect(F.array(*map(F.lit, FORMS)), F.col("meta_tags"))
    s = subjects.withColumn("air_year", year_of(F.col("date"), F.col("infobox"))).withColumn("form", F.try_element_at(got, F.lit(1)))
    return s.where((F.col("type") == KIND) & F.col("air_year").isNotNull() & F.col("form").isNotNull() & (F.try_element_at("favorite", F.lit("done")) >= DONE_LEAST))


def write_sidecar(df: DataFrame, path: str) -> None:
    """Provenance of an output, as one small JSON file beside it."""
    df.coalesce(1).write.mode("overwrite").json(path)


def render_sheet(rows: list[dict]) -> str:
    """An evaluation sheet in blocks of fixed grammar; ``parse_sheet`` reads it back."""
    return "\n".join(f"## [{r['n']}] {r['kind']}　{r['question']}\n\nstate: `{r['state']}`\nretrieval: {r.get('retrieval', '')}\nanswer: {r.get('answer', '')}\n" for r in rows)


def parse_sheet(text: str) -> list[dict]:
    """Labelled blocks of a sheet: retrieval y or n, answer y, n or r; unlabelled ones are null."""
    out = []
    for m in re.finditer(r"^## \[(\d+)\] (\S+)　(.*?)\n(.*?)(?=^## \[|\Z)", text, re.M | re.S):
        body = m.group(4)
        mark = lambda name, allowed: (re.search(rf"^{name}:[ \t]*([{allowed}])", body, re.M) or [None, None])[1]  # noqa: B023, E731
        state = re.search(r"`([^`]*)`", body)
        out.append({"n": int(m.group(1)), "kind": m.group(2), "question": m.group(3), "state": state.group(1) if state else None, "retrieval": mark("retrieval", "yn"), "answer": mark("answer", "ynr")})
    return out


