"""python -m mergeloom.cli profile | analyze | cluster | apply.  Exit codes: 0 done, 2 wrong input, 3 stopped for review."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.utils import AnalysisException

from mergeloom.operators import entity
from mergeloom.operators.dedup import DedupError, deduplicate
from mergeloom.operators.profile import profile_file
from mergeloom.operators.union import Merged, UnionError, check_unique_names, unify
from mergeloom.operators.validate import Settings, validate
from mergeloom.plans.contracts import ContractError, Mapping, TargetSchema, dump_clusters, dump_mapping, load_clusters, load_mapping, load_schema
from mergeloom.plans.guards import apply_guards
from mergeloom.plans.propose import FileProfile, embedder_from_environment, propose, provider_from_environment
from mergeloom.sources.sinks import write_merged
from mergeloom.sources.tables import SourceError, locate_schema, locate_sources, read_tables

DONE, WRONG, STOPPED = 0, 2, 3


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mergeloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("profile")
    c.add_argument("--input", required=True)
    c.add_argument("--sheet")
    c = sub.add_parser("analyze")
    c.add_argument("--inputs", nargs="+", required=True)
    c.add_argument("--target-schema", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--sheet")
    c = sub.add_parser("cluster")
    c.add_argument("--mapping", required=True)
    c.add_argument("--column", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--target-schema")
    c.add_argument("--inputs", nargs="+")
    c.add_argument("--sheet")
    c.add_argument("--strategy", nargs="+", default=["prefix"], choices=entity.STRATEGIES)
    c.add_argument("--high", type=float, default=entity.Thresholds.high)
    c.add_argument("--low", type=float, default=entity.Thresholds.low)
    c.add_argument("--no-llm", action="store_true")
    c = sub.add_parser("apply")
    c.add_argument("--mapping", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--format")
    c.add_argument("--target-schema")
    c.add_argument("--inputs", nargs="+")
    c.add_argument("--report")
    c.add_argument("--sheet")
    c.add_argument("--clusters")
    c.add_argument("--null-threshold", type=float)
    return p


def _merge(spark: SparkSession, args: argparse.Namespace, mapping: Mapping) -> tuple[Merged, TargetSchema]:
    schema = locate_schema(args.target_schema, args.mapping)
    files = [Path(x) for x in args.inputs] if args.inputs else locate_sources(mapping, args.mapping)
    check_unique_names([str(f) for f in files])
    tables = [t for f in files for t in read_tables(spark, f, args.sheet if f.suffix.lower() == ".xlsx" else None)]
    return unify(tables, mapping, schema), schema


def _stopped_for_review(mapping: Mapping) -> bool:
    pending = mapping.pending()
    for target, s in pending:
        print(f"review: {target} ← {s.file}:{s.column} ({s.confidence:.2f}) {s.reason or ''}".rstrip())
    if pending:
        print(f"{len(pending)} matches wait for review; nothing was written.")
    return bool(pending)


def _profile(spark, args, provider) -> int:
    if args.sheet and Path(args.input).suffix.lower() != ".xlsx":
        raise SourceError("only workbooks have sheets")
    for t, profile in profile_file(spark, args.input, args.sheet):
        print(f"{t.label}: {t.df.count()} rows")
        for r in profile.collect():
            print(f"  {r['name']}: type={r['inferred_type']}, null_ratio={r['null_ratio']:.2%}, unique={r['unique_count']}, samples={r['samples']}, min={r['min']}, max={r['max']}, pattern={r['format_pattern']}")
    return DONE


def _analyze(spark, args, provider) -> int:
    schema = load_schema(args.target_schema)
    check_unique_names(args.inputs)
    profiles = []
    for f in args.inputs:
        rows: dict[str, dict] = {}
        for _, profile in profile_file(spark, f, args.sheet if Path(f).suffix.lower() == ".xlsx" else None):
            for r in profile.collect():
                rows.setdefault(r["name"], r.asDict())
        profiles.append(FileProfile(Path(f).name, list(rows.values())))
    mapping = propose(profiles, schema, provider or provider_from_environment())
    samples = {k: v for p in profiles for k, v in p.samples().items()}
    mapping = apply_guards(mapping, samples)
    dump_mapping(mapping, args.out)
    print(f"{args.out}: " + ", ".join(f"{v} {k}" for k, v in mapping.status_counts().items()))
    return DONE


def _cluster(spark, args, provider) -> int:
    mapping = load_mapping(args.mapping)
    if _stopped_for_review(mapping):
        return STOPPED
    thresholds = entity.Thresholds(args.high, args.low)
    merged, schema = _merge(spark, args, mapping)
    kind = {c.name: c.type for c in schema.columns}.get(args.column)
    if kind != "string":
        raise SourceError(f"{args.column} is {'no target column' if kind is None else 'not a string column'}")
    records = entity.written(entity.value_frequency(merged.df, args.column, ("_file_idx", "_sheet_idx", "_row_idx")), "values")
    blocked = entity.with_blocks(records, args.strategy)
    if args.no_llm:
        provider = None
    elif provider is None and os.environ.get("LLM_PROVIDER"):
        provider = provider_from_environment()
    decisions = entity.resolve_pairs(blocked, embedder_from_environment(), provider.complete if provider else None, thresholds, include_unblocked=False)
    records = blocked.select("idx", "value", "row_count", "key")
    plan = entity.cluster_plan(decisions, records, args.column)
    dump_clusters(plan, args.out)
    print(f"{args.out}: {len(plan.approved())} approved, {len(plan.pending())} for review")
    return DONE


def _apply(spark, args, provider) -> int:
    mapping = load_mapping(args.mapping)
    if _stopped_for_review(mapping):
        return STOPPED
    merged, schema = _merge(spark, args, mapping)
    clusters = load_clusters(args.clusters) if args.clusters else None
    dedup = deduplicate(merged, clusters) if clusters and clusters.clusters else None
    if clusters is not None and not clusters.clusters:
        print("the clusters file is empty; values are as they were.")
    settings = Settings() if args.null_threshold is None else Settings(null_ratio=args.null_threshold)
    report = validate(merged, mapping, settings, dedup.df if dedup else None)
    for f in report.findings:
        print(f"{f.severity}: {f}")
    if report.blocking:
        print("errors stop the merge; nothing was written.")
        return STOPPED
    done = write_merged(merged, mapping, args.out, args.format, dedup, clusters, report, args.report)
    print(f"{done.path}: {done.rows} rows; report: {done.report}")
    return DONE


def main(argv: list[str] | None = None, spark: SparkSession | None = None, provider=None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    commands = {"profile": _profile, "analyze": _analyze, "cluster": _cluster, "apply": _apply}
    try:
        return commands[args.command](spark, args, provider)
    except (ContractError, SourceError, UnionError, DedupError, ValueError, OSError, AnalysisException) as e:
        print(f"error: {e}", file=sys.stderr)
        return WRONG


if __name__ == "__main__":
    sys.exit(main())
