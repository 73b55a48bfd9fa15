"""A Markdown corpus out of the driver's tables: one SQL text for Spark and DuckDB.

The tables hold no Markdown, so `documents` are dressed up: paths by source,
language and id, header cases by the id's last digit, headings, links and a
code fence in the body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.shipping import ship, spread
from quillmesh.sources.config import Hygiene, Manifest, Profile, Root, Split, TypeRules
from quillmesh.sources.tree import with_names

NL = "chr(10)"


def corpus_sql(div: str) -> str:
    """root_ord, root, rel_path, content; div is the integer division: `div` in Spark, `//` in DuckDB."""
    header = f"""
      CASE doc_id % 10
        WHEN 0 THEN ''
        WHEN 1 THEN '---' || {NL} || 'type: Decision' || {NL}
        WHEN 2 THEN '---' || {NL} || 'type: ""' || {NL} || '---' || {NL}
        WHEN 3 THEN '---' || {NL} || 'type: adr' || {NL} || 'status: open' || {NL} || 'created: 2026-05-01' || {NL} || '---' || {NL}
        WHEN 4 THEN '---' || {NL} || 'type: Memo' || {NL} || 'title: Memo ' || CAST(doc_id AS STRING) || {NL} || '---' || {NL}
        WHEN 5 THEN '---' || {NL} || 'type: Decision' || {NL} || 'status: open' || {NL} || 'created: 05/2026' || {NL} || '---' || {NL}
        WHEN 6 THEN '---' || {NL} || 'type: decision' || {NL} || 'status: stale' || {NL} || 'created: 2026-05-01' || {NL} || '---' || {NL}
        WHEN 7 THEN '---' || {NL} || 'type: Journal' || {NL} || 'created: 2026-05-01' || {NL} || 'owner: ops' || {NL} || 'area: north' || {NL} || '---' || {NL}
        WHEN 8 THEN '---' || {NL} || 'type: Journal' || {NL} || 'title: Entry ' || CAST(doc_id AS STRING) || {NL} || 'description: day ' || CAST(doc_id AS STRING) || {NL} || '---' || {NL}
        ELSE '---' || {NL} || 'type: Decision' || {NL} || 'status: open' || {NL} || 'created: 2026-05-01' || {NL} || '---' || {NL}
      END"""
    return f"""
    SELECT 0 AS root_ord, '/kb' AS root,
      source || '/' || lang || '/b' || CAST(doc_id {div} 97 AS STRING) || '/' ||
      CASE WHEN doc_id % 97 = 0 THEN 'index' WHEN doc_id % 97 = 1 THEN 'log'
           WHEN doc_id % 10 = 9 THEN 'd' || CAST(doc_id - 9 AS STRING) ELSE 'd' || CAST(doc_id AS STRING) END || '.md' AS rel_path,
      {header}
      || '# Doc ' || CAST(doc_id AS STRING) || {NL}
      || replace(coalesce(text, ''), {NL}, {NL} || {NL} || '## Part' || {NL}) || {NL} || {NL}
      || 'See [[d' || CAST((doc_id * 7) % 500 AS STRING) || ']] and [[gone' || CAST(doc_id % 3 AS STRING) || '#top|there]] or [[d' || CAST(doc_id {div} 10 * 10 AS STRING) || '|same]].' || {NL}
      || 'Near [next](d' || CAST(doc_id + 1 AS STRING) || '.md#x), [up](../b' || CAST(doc_id {div} 97 AS STRING) || '/./index.md), [web](https://example.org/a#b) and [here](#top), `[[inline]]`.' || {NL}
      || '```' || {NL} || '[[decoy]] [a](b.md)' || {NL} || '## Not a heading' || {NL} || '```' || {NL} AS content
    FROM documents"""


MANIFEST = Manifest(
    roots=(Root("/kb"),),
    reserved={"index": "index.md", "log": "log.md"},
    name="kb",
    external_refs=frozenset({"gone2"}),
    profile=Profile(
        date_fields=("created",),
        types={
            "Decision": TypeRules(("type", "status", "created"), ("title", "tags"), ("adr", "ADR"), {"status": ("open", "closed")}),
            "Journal": TypeRules(("type", "created"), ("title", "description")),
        },
    ),
    hygiene=Hygiene("warn", "warn", "error", "warn", Split(min_lines=8, tau=0.02)),
)


def kb_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files relation of that corpus."""
    ship(spark)
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = spark.sql(corpus_sql("div").replace("FROM documents", "FROM {docs}"), docs=docs)
    return with_names(rows.withColumn("read_error", F.lit(None).cast("string")))


def kb_paths(files: DataFrame) -> DataFrame:
    """Absolute paths of files, of their directories and of the root."""
    parts = F.split("rel_path", "/")
    upto = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.concat(F.array("root"), F.slice(parts, 1, k)), "/"))
    return files.select(F.explode(upto).alias("path")).distinct()
