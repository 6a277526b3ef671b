"""Queries of the operators in this subpackage and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.llm.components import consolidate
from tessaria.llm.encode import encode_corpus
from tessaria.llm.history import Store, admit
from tessaria.llm.leaks import find_leaks
from tessaria.llm.mainbody import main_body
from tessaria.llm.neardup import all_pairs, joined_text, near_duplicates
from tessaria.llm.subjects import subject_areas
from tessaria.runtime import delete_path, fresh_path, key, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(table(spark, sf_dir, "cyber_events"), "member_hashes")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("articles", "article_id", "title", "article_text"), ("crawl_records", "record_id", "article_title", "extracted_text")]
    pages = [table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(i).alias("row_id"), F.col(n).alias("title"), F.col(x).alias("text")) for t, i, n, x in parts]
    return main_body(reduce(DataFrame.unionByName, pages))


#: What the statement of problems 4 and 6 asks for: runs of three words, similarity 0.7.
ITEM_TEXT, ITEM_WORDS, ITEM_SIMILARITY = ["title", "summary", "content"], 3, 0.7


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = near_duplicates(table(spark, sf_dir, "raw_items"), "item_id", ITEM_TEXT, ITEM_WORDS, ITEM_SIMILARITY)
    return all_pairs(pairs, members, "item_id_a", "item_id_b")


def _replay(rows: DataFrame) -> DataFrame:
    """Admit the rows (id, batch_no, key[, text]) batch by batch in order of arrival; no batch number counts as 0.

    The rows are read once and dealt into a folder for each batch, which goes when the batch is admitted."""
    spark, no = rows.sparkSession, F.coalesce("batch_no", F.lit(0))
    store, home, schema = Store(spark), fresh_path(spark, "batches"), rows.drop("batch_no").schema
    numbers = sorted(r.n for r in rows.select(no.alias("n")).distinct().collect())  # one per batch
    if not numbers:
        return rows.select("id", F.col("id").alias("kept"))
    rows.withColumn("batch_no", no).write.partitionBy("batch_no").parquet(home)
    decided = []
    for n in numbers:
        decided.append(admit(store, spark.read.schema(schema).parquet(f"{home}/batch_no={n}"), n, ITEM_WORDS, ITEM_SIMILARITY))
        delete_path(spark, f"{home}/batch_no={n}")
    return reduce(DataFrame.unionByName, decided)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables go through one store: ids are doubled, odd ones for events, and keys name their table, so rows of different
    tables never match. Events have no text."""
    sep = F.lit("\x1f")
    items = table(spark, sf_dir, "raw_items").select((F.col("item_id") * 2).alias("id"), "batch_no", F.concat(F.lit("r"), sep, key("raw_hash")).alias("key"), joined_text(ITEM_TEXT).alias("text"))
    events = table(spark, sf_dir, "cyber_events").select((F.col("event_row") * 2 + 1).alias("id"), "batch_no", F.concat(F.lit("e"), sep, key("id"), sep, key("fingerprint")).alias("key"), F.lit(None).cast("string").alias("text"))
    found = _replay(items.unionByName(events.filter("key is not null")))
    row = lambda c: F.shiftright(c, 1)
    return found.select(F.when(F.col("id") % 2 == 0, "raw_items").otherwise("cyber_events").alias("tbl"), row("kept").alias("kept_id"), row("id").alias("dup_id"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"))


QUERIES = {"p9_found": p9_found, "p2_found": p2_found, "p4_found": p4_found, "p6_found": p6_found, "p8_found": p8_found, "p1_found": p1_found, "p7_ids": p7_ids}

_BLANKS = " || ".join(["' '", *(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))])


def _key(c: str) -> str:
    return f"nullif(lower(trim({c}, {_BLANKS})), '')"


_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"

SQL = {
    "p6_found": f"""
WITH w AS (SELECT item_id AS i, {_WORDS.format("coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(content, '')")} AS x FROM raw_items),
s AS (SELECT DISTINCT i, hash(x[k], x[k + 1], x[k + 2]) AS h FROM (SELECT i, x, unnest(range(1, len(x) - 1)) AS k FROM w WHERE len(x) >= 3)),
n AS (SELECT i, count(*) AS n FROM s GROUP BY i),
b AS (SELECT a.i AS a, b.i AS b, count(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.i < b.i GROUP BY a.i, b.i)
SELECT a AS item_id_a, b AS item_id_b FROM b JOIN n x ON x.i = a JOIN n y ON y.i = b WHERE 10 * m >= 7 * (x.n + y.n - m)
""",
    "p8_found": f"""
WITH e AS (SELECT eval_id, {_WORDS.format("passage")} AS x FROM eval_items WHERE passage IS NOT NULL), k AS (SELECT eval_id, x, least(10, len(x)) AS k FROM e WHERE len(x) > 0),
g AS (SELECT DISTINCT eval_id, k, array_to_string(x[j : j + k - 1], ' ') AS g FROM (SELECT eval_id, x, k, unnest(range(1, len(x) - k + 2)) AS j FROM k)),
d AS (SELECT doc_id, {_WORDS.format("text")} AS x FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, q.k AS k, array_to_string(x[j : j + q.k - 1], ' ') AS g FROM (SELECT doc_id, x, q.k AS k, unnest(range(1, len(x) - q.k + 2)) AS j FROM d, (SELECT DISTINCT k FROM g) q) q)
SELECT DISTINCT doc_id, eval_id FROM r JOIN g ON r.k = g.k AND r.g = g.g
""",
    "p1_found": f"""
WITH RECURSIVE m AS (SELECT DISTINCT event_row r, h FROM (SELECT event_row, {_key("x")} h FROM (SELECT event_row, unnest(member_hashes) x FROM cyber_events)) WHERE h IS NOT NULL),
f AS (SELECT r, min(h) c FROM m GROUP BY r),
e AS (SELECT DISTINCT m.h a, f.c b FROM m JOIN f USING (r) WHERE m.h <> f.c),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS n, a AS o FROM b UNION SELECT reach.n, b.b FROM reach JOIN b ON reach.o = b.a)
SELECT n AS raw_hash, min(o) AS group_hash FROM reach GROUP BY n
""",
}
