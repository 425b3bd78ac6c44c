"""Plans: columns pruned at the scan, filters pushed down, no cross joins beside the bounded rule tables."""

import pytest

from factlode import plans
from factlode.operators import filters

SF = "/root/testdata/sf0.001"
#: Queries that join rows with a broadcast table of hand-written rules by a theta condition.
THETA = {"template_score", "manifest_cues", "quote_verify"}


def explained(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_no_cross_joins(spark, capsys, name):
    text = explained(plans.QUERIES[name](spark, SF), capsys)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text or name in THETA


def test_scans_read_only_what_they_need(spark, capsys):
    text = explained(plans.QUERIES["token_exact_search"](spark, SF), capsys)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "StringContains(text,with)" in text
    text = explained(plans.QUERIES["content_dedup"](spark, SF), capsys)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "partial_min" in text
    text = explained(plans.QUERIES["tombstone_prune"](spark, SF), capsys)
    assert "GreaterThan(l_quantity,25.0)" in text


def test_metadata_filters_reach_the_scan(spark, capsys):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = explained(docs.filter(filters.where({"$and": [{"lang": "en"}, {"source": {"$in": ["src0", "src1"]}}]})).select("doc_id"), capsys)
    assert "EqualNullSafe(lang,en)" in text and "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in text


def test_top_k_runs_in_every_task(spark, capsys):
    assert "TakeOrderedAndProject" in explained(plans.QUERIES["vector_topk_cosine"](spark, SF), capsys)
