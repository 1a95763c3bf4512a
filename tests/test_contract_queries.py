"""Queries over the application made from the parts are spread over tasks, and their texts are written once."""

import os
import re

import pytest
from pyspark.sql import functions as F

from factmill.operators import extraction as X
from factmill.operators import hierarchy
from factmill.operators import relational as R
from factmill.plans import catalog
from factmill.plans.contract_queries import _actions, _application, _files

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_texts_are_made_in_many_tasks(spark):
    """Before, the keys were merged into one partition, and one task made and split the texts of all."""
    at = _files(spark, DATA).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(at) > 1


@pytest.mark.parametrize("name", ["c4_models", "c5_resources", "z1_authorization", "r0_request_fields", "b0_responses"])
def test_plan_starts_from_written_texts(spark, name):
    """Planned from ``part`` the texts seem as small as its keys, and joins broadcast them."""
    read = catalog.QUERIES[name](spark, DATA).inputFiles()
    assert read and not [f for f in read if "/part.parquet" in f]


def test_texts_are_not_broadcast(spark):
    """Before, these joins broadcast whatever was written small, however much memory it takes."""
    rows = _actions(*_application(spark, DATA))[0]
    said = rows._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("strategy=merge") >= 5


def test_document_is_put_together_from_written_lists(spark):
    """Before, one plan held all lists of the document and filled the driver."""
    read = catalog.QUERIES["c3_route_contract"](spark, DATA).inputFiles()
    assert [f for f in read if "/list_controllers-" in f] and not [f for f in read if "/index-" in f]


@pytest.fixture
def broadcasting(spark):
    """Whatever is planned is small enough to be broadcast, as is what compresses well at any size."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "8g")
    yield
    spark.conf.set(key, was)


def _broadcasts(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_resources_are_merged_with_their_models(spark, broadcasting):
    """Before, the relations of all models, written small, were broadcast and filled the driver."""
    assert _broadcasts(catalog.QUERIES["c5_resources"](spark, DATA)) == 0


def test_ancestry_is_merged(spark, broadcasting, monkeypatch):
    """Before, the ids of all classes, written small, were broadcast and filled the driver of r0_request_fields."""
    write, found = hierarchy.materialize, {}

    def recorded(df, name):
        found[name] = _broadcasts(df)
        return write(df, name)

    monkeypatch.setattr(hierarchy, "materialize", recorded)
    rows = [("p", "A", None), ("p", "B", "A"), ("p", "C", "B"), ("p", "X", "Y"), ("p", "Y", "X"), ("p", "Z", "Y")]
    bases = R.ancestry(spark.createDataFrame(rows, "project_id string, fqcn string, extends string"))
    assert "forest_links" in found and "loop_links" in found and not any(found.values())
    assert sorted(r.fqcn for r in R.descending(bases, "A").collect()) == ["B", "C"]


def test_forms_of_actions_are_merged(spark):
    """Before, the join with the sources of the actions' forms was left to the threshold."""
    said = catalog.QUERIES["z1_authorization"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < len(re.findall(r"Join (?:LeftOuter|Inner)", said)) == said.count("strategy=merge")


def test_texts_are_parsed_once(spark):
    """Before, Spark asked for the size of a list that is exploded first, and parsed every text once for that and once for the list."""
    parses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    assert parses(catalog.QUERIES["z1_authorization"](spark, DATA)) == 1
    assert parses(X.controller_methods(X.classes_with_methods(_files(spark, DATA)))) == 1
