"""Files of a whole nation: links between suppliers of different hundreds are kept."""

import pytest

import factloom.plans.repository  # registers its queries
from factloom.plans.queries import QUERIES

#: Suppliers of one nation; 115 and 140 lie in another hundred than 90.
KEYS = (90, 115, 140)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, 7) for k in KEYS], "s_suppkey bigint, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    return folder


def test_cargo_links_leave_the_hundred(spark, tables):
    rows = {(r.lockfile, r.src, r.dst, r.forked) for r in QUERIES["lock_cargo_edges"](spark, tables).collect()}
    assert rows == {("n7/Cargo.lock", "s90", "s115", False), ("n7/Cargo.lock", "s115", "s140", True), ("n7/Cargo.lock", "s140", None, False)}


def test_yarn_links_leave_the_hundred(spark, tables):
    rows = {(r.name, r.pattern, r.resolved) for r in QUERIES["lock_yarn_edges"](spark, tables).collect()}
    assert rows == {("@acme/s90", "s115@^1.0.0", True), ("@acme/s115", "s140@^1.0.0", True), ("@acme/s140", "s165@^1.0.0", False)}


def test_berry_links_leave_the_hundred(spark, tables):
    rows = {(r.name, r.pattern, r.resolved) for r in QUERIES["lock_berry_edges"](spark, tables).collect()}
    assert rows == {("@acme/s90", "s115@npm:^1.0.0", True), ("@acme/s115", "s140@workspace:^", False), ("@acme/s140", "s165@npm:^1.0.0", False)}


def test_pull_request_projects_are_nations(spark, tables):
    rows = {(r.project, r.dependency, r.rule, r.host) for r in QUERIES["analysed_pull_request"](spark, tables).collect()}
    assert rows == {("n7", "s115", "unverified-no-imports", "host"), ("n7", "s140", "unused", None)}
