"""Command lines: ``python -m loomgraph.cli tokens|filter-mentions|merge-clusters|triples ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import anchors, exports, tokens
from loomgraph.plans.profiles import runtime_profile
from loomgraph.runtime import build_session
from loomgraph.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomgraph")
    top.add_argument("--master", default=None, help="Spark master; the session's own where it is left out")
    commands = top.add_subparsers(dest="command", required=True)
    t = commands.add_parser("tokens", help="text files to a token table as TSV")
    t.add_argument("--input", required=True)
    t.add_argument("--output", required=True)
    t.add_argument("--glob", default="*.txt")
    f = commands.add_parser("filter-mentions", help="drop mentions that name another cluster's anchor")
    for name in ("mentions", "clusters", "output"):
        f.add_argument(f"--{name}", required=True)
    f.add_argument("--anchor-percentile", type=float, default=0.95)
    f.add_argument("--min-anchor-mentions", type=int, default=2)
    f.add_argument("--generic-anchor-blacklist", default=None, help="file with one more generic label a line")
    f.add_argument("--fuzzy-threshold", type=float, default=0.86)
    f.add_argument("--own-family-fuzzy-threshold", type=float, default=0.90)
    f.add_argument("--min-fuzzy-chars", type=int, default=5)
    m = commands.add_parser("merge-clusters", help="local clusters of one document to entities")
    for name in ("mentions", "clusters", "output"):
        m.add_argument(f"--{name}", required=True)
    m.add_argument("--strategy", choices=("greedy", "components"), default="greedy")
    m.add_argument("--no-veto", action="store_true")
    m.add_argument("--salience-percentile", type=float, default=0.95)
    commands.add_parser("profile", help="show the runtime profile").add_argument("--force", default=None)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    """Run one command; what it made is returned for callers inside Python."""
    args = parser().parse_args(argv)
    spark = spark or build_session("loomgraph", args.master)
    if args.command == "tokens":
        docs = files.read_texts(spark, args.input, args.glob).select(F.xxhash64("path").alias("doc_id"), "path", "text")
        made = tokens.token_export(tokens.tokenize(docs))
        files.write_tsv(made, args.output)
        return made
    if args.command == "filter-mentions":
        clusters = spark.read.option("header", True).option("escape", '"').csv(args.clusters)
        mentions = spark.read.option("header", True).option("escape", '"').csv(args.mentions)
        if "n_mentions" not in clusters.columns:
            clusters = anchors.mention_counts(clusters, mentions).withColumnRenamed("n", "n_mentions")
        return exports.filter_with_audit(
            mentions, clusters, args.output, args.anchor_percentile, args.min_anchor_mentions, anchors.generic_keys(args.generic_anchor_blacklist), foreign=args.fuzzy_threshold, family=args.own_family_fuzzy_threshold, least=args.min_fuzzy_chars,
        )
    if args.command == "merge-clusters":
        made = exports.merge_from_csv(spark, args.clusters, args.mentions, strategy=args.strategy, veto=not args.no_veto, percentile=args.salience_percentile)
        exports.export_resolution(made, args.output)
        return made
    profile = runtime_profile(spark, args.force)
    print(profile)
    return profile


if __name__ == "__main__":
    main()
