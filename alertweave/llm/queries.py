"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from alertweave.llm import alignment, ann, decontaminate, html, language, packing, pitman, quality, runs, simhash, suffixes, urls, warc
from alertweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_warc_bundles(spark, sf_dir):
    bundles = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_warc_bundles"] = """
with payloads as (select page_id, coalesce(html, '') as payload from pages),
digests as (select page_id, strlen(payload) as payload_bytes, sha256(payload) as payload_digest from payloads),
firsts as (select *, min(page_id) over (partition by payload_digest) as first from digests)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to from firsts"""


@query
def op2_suffix_dedup(spark, sf_dir):
    return suffixes.report(table(spark, sf_dir, "documents"))


@query
def op3_prefix_forest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op4_simhash_vantage(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_kneser_ney_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_main_text(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op7_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op8_language_id(spark, sf_dir):
    judged, _ = language.predict_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "held_out", "lang_pred", "score")


@query
def op9_decontaminate(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))


@query
def op11_periodic_runs(spark, sf_dir):
    return runs.digests(runs.detect(table(spark, sf_dir, "documents"), planted=True))


@query
def op12_pitman_yor(spark, sf_dir):
    return pitman.score(table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark, sf_dir):
    files = public_tokenizers.path(alignment.RANKS_A), public_tokenizers.PATTERN, public_tokenizers.path(alignment.TOKENIZER_B)
    return alignment.align(table(spark, sf_dir, "documents"), *files)
