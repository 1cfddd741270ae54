"""Command line: compare the search results of two collections, migrate one into another, or undo a migration.

``python -m vecshift compare files:/data/a#docs files:/data/b#docs --queries 40 --k 10``
``python -m vecshift migrate files:/data/a#docs index:https://host#docs --id m1 --state /data/state --target-credential KEY``
``python -m vecshift rollback files:/data/a#docs files:/data/b#docs --id m1 --state /data/state``

A collection is ``provider:endpoint#resource``; credentials are names of environment variables. What comes out is one JSON object.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vecshift.functions.redaction import redact
from vecshift.functions.shipping import ship_package
from vecshift.functions.staging import checkpoint
from vecshift.functions.vectors import is_usable
from vecshift.operators import ranking
from vecshift.plans.embed import HashEmbedder, embed
from vecshift.plans.pipeline import Migration
from vecshift.plans.state import Request
from vecshift.sources.contract import Store, build_store


def located(text: str) -> tuple[str, str, str]:
    """(provider, endpoint, resource) of ``provider:endpoint#resource``."""
    provider, _, rest = text.partition(":")
    endpoint, _, resource = rest.rpartition("#")
    if not (provider and resource):
        raise argparse.ArgumentTypeError(f"{text!r} is not provider:endpoint#resource")
    return provider, endpoint, resource


def compare(source: Store, source_name: str, target: Store, target_name: str, queries: int, k: int, width: int | None = None) -> dict:
    """How well searches in the target give what they give in the source: the first records of the source, by id, whose id the target
    has, are searched with their own vectors on either side."""
    asked = source.sample(source_name, queries).where(is_usable(F.col("vector"))).select("id", "vector")
    there = checkpoint(target.fetch(target_name, asked.select("id")).where(is_usable(F.col("vector"))).select("id", "vector"))
    asked = checkpoint(asked.join(there.select("id"), "id", "left_semi"))
    measures = ranking.per_query(source.query(source_name, asked, k, width), target.query(target_name, there, k, width), k)
    return ranking.equivalence(measures).first().asDict()


def text_search(store: Store, name: str, text: str, k: int) -> list[dict]:
    """The k records nearest to a text, embedded by feature hashing in the collection's dimension."""
    dimension = store.info(name).dimension
    query = embed(store.spark.createDataFrame([("text", text)], "id string, text string"), "text", HashEmbedder(dimension or 64))
    return [r.asDict() for r in store.query(name, query.select("id", "vector"), k).orderBy("rank").collect()]  # k rows


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="vecshift", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("compare", "migrate", "rollback"):
        command = commands.add_parser(name)
        command.add_argument("source", type=located)
        command.add_argument("target", type=located)
        command.add_argument("--source-credential")
        command.add_argument("--target-credential")
        if name == "compare":
            command.add_argument("--queries", type=int, default=40)
            command.add_argument("--k", type=int, default=10)
            command.add_argument("--width", type=int, help="search width of approximate indexes")
            command.add_argument("--text", help="search the target for this text instead")
        else:
            command.add_argument("--id", required=True)
            command.add_argument("--state", required=True)
        if name == "migrate":
            command.add_argument("--dimension", type=int)
            command.add_argument("--policy", default="fail")
            command.add_argument("--page", type=int)
            command.add_argument("--resume", action="store_true")
            command.add_argument("--embedding-provider")
            command.add_argument("--embedding-model")
    asked = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("vecshift").getOrCreate()
    ship_package(spark)
    (sp, se, sr), (tp, te, tr) = asked.source, asked.target
    with build_store(spark, sp, se, asked.source_credential) as source, build_store(spark, tp, te, asked.target_credential) as target:
        if asked.command == "compare":
            found = {"matches": text_search(target, tr, asked.text, asked.k)} if asked.text else compare(source, sr, target, tr, asked.queries, asked.k, asked.width)
        else:
            options = {} if asked.command == "rollback" else {"target_dimension": asked.dimension, "id_collision_policy": asked.policy, "page_records": asked.page, "resume": asked.resume, "embedding_provider": asked.embedding_provider, "embedding_model": asked.embedding_model}
            work = Migration(spark, Request(asked.id, sp, sr, tp, tr, se, te, asked.source_credential, asked.target_credential, **options), source, target, asked.state)
            if asked.command == "rollback":
                found = {"batches_undone": work.rollback()}
            else:
                result = work.run()
                found = {"state": result.state, "status": result.status, "summary": result.summary, "written": result.report.get("written"), "selected": result.report.get("selected")}
    return redact(found)


if __name__ == "__main__":
    print(json.dumps(main(), default=str))
