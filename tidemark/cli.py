"""Command line: python -m tidemark.cli COMMAND …"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.errors import TidemarkError
from tidemark.functions.timebase import DAY
from tidemark.operators import describe, metrics
from tidemark.operators.checks import all_checks, run_checks
from tidemark.plans.gate import metadata_of, owners_from, run_dataset, split_from
from tidemark.session import Scratch
from tidemark.sources.digest import multiset_digest
from tidemark.sources.files import export_csv, read_table
from tidemark.sources.schema import table_names
from tidemark.synth.config import PROFILES, load_config
from tidemark.synth.generate import generate, write


def _simulate(spark: SparkSession, a: argparse.Namespace) -> int:
    cfg = load_config(a.profile, a.seed, path=a.config)
    data = generate(spark, cfg, Scratch(spark, "simulate"))
    write(data, a.out)
    print(json.dumps({"rows": data.metadata["row_counts"], "config_hash": data.metadata["config_hash"]}, indent=1))
    return 0


def _tables(spark: SparkSession, folder: str) -> dict:
    return {n: read_table(spark, n, folder) for n in table_names()}


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Digests against the metadata, then all checks."""
    meta, tables = metadata_of(a.dir), _tables(spark, a.dir)
    for name, df in tables.items():
        if [str(x) for x in multiset_digest(df).first()] != meta["digests"][name]:
            print(f"{name}: contents differ from the metadata")
            return 1
    c = meta["config"]
    print("\n".join(run_checks(tables, all_checks(meta["sim_end"], c["infrastructure"]["session_window"], c["validation"]["min_cv"], c["validation"]["min_instances"]))))
    return 0


def _sections(spark: SparkSession, folder: str) -> dict:
    meta, t = metadata_of(folder), _tables(spark, folder)
    owners, days = owners_from(spark, folder), meta["sim_end"] // DAY
    scratch = Scratch(spark, "sections")
    return {
        "Activity": describe.activity(t["transactions"], owners, days, scratch).orderBy("archetype"),
        "Status": describe.counts(t["transactions"], "status").orderBy("status"),
        "Types and channels": describe.counts(t["transactions"], "txn_type", "channel").orderBy(F.desc("n")),
        "Amounts": describe.nearest_quantiles(t["transactions"], [], "amount_minor", {"q10": 0.1, "q50": 0.5, "q90": 0.9, "q99": 0.99}, scratch),
        "Logins": describe.counts(t["logins"], "outcome").orderBy("outcome"),
        "Families": describe.families(t["ground_truth_networks"]).orderBy("family"),
        "Roles": describe.counts(t["labels"], "role_label").orderBy("role_label"),
        "Shared IPs": describe.shared_keys(t["logins"], "ip_id"),
    }


def _sanity(spark: SparkSession, a: argparse.Namespace) -> int:
    print(json.dumps({k: [r.asDict() for r in df.collect()] for k, df in _sections(spark, a.dir).items()}, indent=1, default=str))
    return 0


def _eda(spark: SparkSession, a: argparse.Namespace) -> int:
    t = _tables(spark, a.dir)
    more = {"Timing": describe.timing(t["transactions"], owners_from(spark, a.dir)).orderBy("archetype"), "Label intervals": describe.label_phases(t["labels"]).orderBy("phase"), "Detection latency in days": describe.latency(t["ground_truth_networks"])}
    index = split_from(spark, a.dir, 0)
    sizes = [(name, df.count()) for name, df in (("TRAIN", index.train_all), ("TRAIN, mature", index.train("mature_only")), ("VAL", index.val), ("TEST", index.test), ("OOD and reference", index.ood))]
    more["Split points"] = spark.createDataFrame(sizes, "block string, points bigint")
    describe.write_report(a.out, _sections(spark, a.dir) | more, f"Dataset {Path(a.dir).name}")
    return 0


def _gate(spark: SparkSession, a: argparse.Namespace) -> int:
    result = run_dataset(spark, a.dir, Scratch(spark, "gate"), sample=a.sample, resamples=a.resamples)
    text = json.dumps(result, indent=1)
    Path(a.out).write_text(text, encoding="utf-8") if a.out else print(text)
    return 0


def _combine(_: SparkSession | None, a: argparse.Namespace) -> int:
    results = [json.loads(Path(p).read_text(encoding="utf-8")) for p in a.results]
    rule = metrics.gate_rule([{k: r[k] for k in ("best_ap", "ap_lr", "ap_tree", "prevalence")} for r in results])
    print(json.dumps(rule, indent=1))
    return 0 if rule["passed"] else 1


def _csv(spark: SparkSession, a: argparse.Namespace) -> int:
    for name in a.tables or table_names():
        print(export_csv(spark, name, a.dir, a.out))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *arguments: tuple) -> None:
        c = sub.add_parser(name, help=(run.__doc__ or name).split("\n")[0])
        for flags, options in arguments:
            c.add_argument(*flags, **options)
        c.set_defaults(run=run)

    folder, out = (("dir",), {}), (("--out",), {"required": True})
    command("simulate", _simulate, (("--profile",), {"choices": sorted(PROFILES), "default": "dev"}), (("--seed",), {"type": int}), (("--config",), {}), out)
    command("validate", _validate, folder)
    command("sanity", _sanity, folder)
    command("eda", _eda, folder, out)
    command("gate", _gate, folder, (("--out",), {}), (("--sample",), {"type": int, "default": 200_000}), (("--resamples",), {"type": int, "default": 1_000}))
    command("gate-combine", _combine, (("results",), {"nargs": "+"}))
    command("export-csv", _csv, folder, out, (("--tables",), {"nargs": "*"}))
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.run is not _combine and spark is None:
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return a.run(spark, a)
    except TidemarkError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
