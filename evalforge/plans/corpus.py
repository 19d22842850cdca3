"""Corpus queries fed from ``documents``: a document is a prompt record.

``ord = doc_id``; ``prompt = text``; the prompt language is mapped from the
document language (en -> python, fr -> cpp, de -> rust, others kept, so they
raise language warnings).  JSON records are rendered from the rows with
some keys absent or null by content rule, to exercise the key checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import SAMPLE_PROMPTS
from ..operators.corpus import (assign_split, dataset_card, dataset_verdict, dedupe_first, field_issues,
                                head, language_warnings, sample_rows, split_counts)
from .registry import query
from .tables import table

LANG_MAP_SQL = "CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'cpp' WHEN 'de' THEN 'rust' ELSE lang END"


def prompt_language(lang):
    return (F.when(lang == "en", "python").when(lang == "fr", "cpp").when(lang == "de", "rust")
            .otherwise(lang))


def document_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.select(F.col("doc_id").alias("ord"), F.col("text").alias("prompt"),
                    prompt_language(F.col("lang")).alias("language"), "lang", "source")


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON line per document: Spanish documents lack ``prompt``; sources
    src3/src7 lack ``language``; src5 carries ``"language": null``."""
    p = document_prompts(spark, sf_dir)
    lang_val = F.when(F.col("source") == "src5", F.lit(None).cast("string")).otherwise(F.col("language"))
    m = F.map_from_arrays(F.array(F.lit("prompt"), F.lit("language")), F.array(F.col("prompt"), lang_val))
    drop_prompt = F.col("lang") == "es"
    drop_lang = F.col("source").isin("src3", "src7")
    kept = F.map_filter(m, lambda k, v: ~(((k == "prompt") & drop_prompt) | ((k == "language") & drop_lang)))
    return p.select("ord", F.to_json(kept).alias("raw"), lang_val.alias("language"),
                    (~drop_lang).alias("has_language"))


@query("prompt_dedupe", sql="""
SELECT doc_id, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY coalesce(text, ''), coalesce(nullif(lang, ''), 'python')
                           ORDER BY doc_id) = 1""")
def prompt_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return dedupe_first(d, "text", "lang", "doc_id").select("doc_id", "lang")


@query("prompt_head", sql="SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def prompt_head(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return head(d, 50, "doc_id")


ISSUE_SQL = """
SELECT doc_id AS ord,
       CASE WHEN lang = 'es' THEN 'prompt' WHEN source IN ('src3', 'src7') THEN 'language' END AS missing_field
FROM documents"""


@query("field_issues", sql=f"SELECT * FROM ({ISSUE_SQL}) WHERE missing_field IS NOT NULL")
def field_issues_q(spark, sf_dir):
    return field_issues(document_records(spark, sf_dir), "raw", "ord")


@query("language_warnings", sql=f"""
SELECT doc_id AS ord, CASE WHEN source = 'src5' THEN NULL ELSE {LANG_MAP_SQL} END AS language
FROM documents
WHERE source NOT IN ('src3', 'src7')
  AND (source = 'src5' OR ({LANG_MAP_SQL}) NOT IN ('python', 'cpp', 'rust'))""")
def language_warnings_q(spark, sf_dir):
    r = document_records(spark, sf_dir).where("has_language")
    return language_warnings(r, "language", "ord")


@query("dataset_verdict", sql=f"""
SELECT count(*) AS num_rows, count(missing_field) AS num_failing,
       min(ord) FILTER (WHERE missing_field IS NOT NULL) AS first_failure_ord,
       arg_min(missing_field, ord) FILTER (WHERE missing_field IS NOT NULL) AS first_missing_field,
       count(missing_field) = 0 AS valid
FROM ({ISSUE_SQL})""")
def dataset_verdict_q(spark, sf_dir):
    return dataset_verdict(document_records(spark, sf_dir), "raw", "ord")


def _catalog_sql_arrays():
    langs = list(SAMPLE_PROMPTS)
    flat = [p for lg in langs for p in SAMPLE_PROMPTS[lg]]
    q = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    return q(langs), q(flat)


_L, _P = _catalog_sql_arrays()


@query("sample_corpus", sql=f"""
WITH n AS (SELECT count(*) // 15 + 1 AS c FROM documents), r AS (SELECT doc_id AS range, c FROM documents, n)
SELECT r.range AS ord,
       ({_P})[CAST((r.range // (5 * c)) * 5 + (r.range % (5 * c)) // c + 1 AS BIGINT)] AS prompt,
       ({_L})[CAST(r.range // (5 * c) + 1 AS BIGINT)] AS language,
       ({_L})[CAST(r.range // (5 * c) + 1 AS BIGINT)] || '_' || CAST((r.range % (5 * c)) // c AS VARCHAR)
         || '_' || CAST(r.range % c AS VARCHAR) AS id
FROM r WHERE r.range < 15 * c""")
def sample_corpus_q(spark, sf_dir):
    """The documents' ids are the ordinals, their number the size of the corpus."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"))
    return sample_rows(d, d.count(), SAMPLE_PROMPTS)


SPLIT_SQL = """
SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'evaluation' END AS split
FROM (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(text, '') || '|' || coalesce(lang, 'python')), 1, 8)
                          AS BIGINT) % 100 AS INTEGER) AS b FROM documents)"""


def document_splits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    key = F.concat(F.coalesce("text", F.lit("")), F.lit("|"), F.coalesce("lang", F.lit("python")))
    return d.select("doc_id", assign_split(key).alias("split"))


@query("train_eval_split", sql=SPLIT_SQL)
def train_eval_split(spark, sf_dir):
    return document_splits(spark, sf_dir)


@query("split_counts", sql=f"""
SELECT s.split, s.split_order, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (VALUES ('train', 0), ('validation', 1), ('evaluation', 2)) s(split, split_order)
LEFT JOIN (SELECT split, count(*) AS n FROM ({SPLIT_SQL}) GROUP BY split) c USING (split)""")
def split_counts_q(spark, sf_dir):
    return split_counts(document_splits(spark, sf_dir))


@query("dataset_card", sql=f"""
WITH c AS (SELECT count(*) FILTER (WHERE split = 'train') AS t, count(*) FILTER (WHERE split = 'validation') AS v,
                  count(*) FILTER (WHERE split = 'evaluation') AS e FROM ({SPLIT_SQL}))
SELECT t AS train_count, v AS val_count, e AS eval_count,
       '---' || chr(10) || 'license: mit' || chr(10) || 'tags:' || chr(10) || '- python' || chr(10) || '- cpp' || chr(10) || '- rust'
       || chr(10) || '---' || chr(10) || chr(10) || '# Dataset' || chr(10) || chr(10) || '## Dataset Structure' || chr(10) || chr(10)
       || '- **Training Set**: ' || t || ' examples' || chr(10)
       || '- **Validation Set**: ' || v || ' examples' || chr(10)
       || '- **Evaluation Set**: ' || e || ' examples' || chr(10) || chr(10) || '## Data Fields' || chr(10) || chr(10)
       || '- `prompt` (string)' || chr(10) || '- `language` (string)' || chr(10) || '- `student_code` (string)' || chr(10)
       || '- `teacher_code` (string)' || chr(10) || '- `student_score` (float)' || chr(10) || '- `teacher_score` (float)' || chr(10)
       || '- `reward` (float)' || chr(10) || '- `scoring_breakdown` (dict)' || chr(10) || '- `timestamp` (string)' || chr(10) AS card
FROM c""")
def dataset_card_q(spark, sf_dir):
    return dataset_card(split_counts(document_splits(spark, sf_dir)))
