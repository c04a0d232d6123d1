"""Command line: ``python -m plyforge.cli survey|build|validate|best ...``; also for spark-submit."""

from __future__ import annotations

import argparse
import dataclasses
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plyforge import session
from plyforge.config import DatasetConfig
from plyforge.functions.rules import START
from plyforge.operators import label, nets, search, validate
from plyforge.plans import build
from plyforge.sources import shards


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plyforge", description=__doc__)
    p.add_argument("--config", help="YAML settings")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("survey", "build"):
        c = commands.add_parser(name)
        c.add_argument("dumps", nargs="*", help="name=path of each dump; by default those of the settings")
        c.add_argument("--min-elo", type=int)
        c.add_argument("--max-games", type=int, default=0)
        c.add_argument("--max-scanned", type=int, default=0)
        c.add_argument("--target-positions", type=int)
        c.add_argument("--dump", action="append", help="only these dumps of the settings")
        c.add_argument("--depth", type=int)
        c.add_argument("--workers", type=int)
        c.add_argument("--max-shards", type=int)
        c.add_argument("--out")
    v = commands.add_parser("validate")
    v.add_argument("path")
    b = commands.add_parser("best")
    b.add_argument("fen", nargs="?", default=START)
    b.add_argument("--weights")
    b.add_argument("--depth", type=int, default=1)
    b.add_argument("--top", type=int, default=5)
    return p


def settings(args: argparse.Namespace) -> DatasetConfig:
    """The settings file with what the command line overrides."""
    cfg = DatasetConfig.from_yaml(args.config) if args.config else DatasetConfig()
    if getattr(args, "min_elo", None) is not None:
        cfg = dataclasses.replace(cfg, filter=dataclasses.replace(cfg.filter, min_elo=args.min_elo))
    told = {k: getattr(args, k, None) for k in ("depth", "workers")} if args.command in ("survey", "build") else {}
    if any(v is not None for v in told.values()):
        cfg = dataclasses.replace(cfg, labeling=dataclasses.replace(cfg.labeling, **{k: v for k, v in told.items() if v is not None}))
    if getattr(args, "dump", None):
        cfg = dataclasses.replace(cfg, source=dataclasses.replace(cfg.source, dumps=tuple(args.dump)))
    if getattr(args, "out", None):
        out = Path(args.out)
        cfg = dataclasses.replace(cfg, output=dataclasses.replace(cfg.output, local_dir=str(out / "shards"), extract_dir=str(out / "extracts"), state_path=str(out / "state.json")))
    return cfg


def main(argv: list[str] | None = None) -> int:
    """0 if all went well, 1 if a check failed, 2 if there was nothing to do."""
    args = parser().parse_args(argv)
    cfg = settings(args)
    spark = session.ship(SparkSession.getActiveSession() or session.build_session())
    if args.command == "validate":
        data = shards.read(spark, args.path)
        if not data.limit(1).count():
            print("no rows")
            return 2
        report = validate.validate(data.select(*shards.SCHEMA.names), cfg).collect()
        for r in report:
            print(f"{'ok' if r.passed else 'FAILED':<8}{r.name} ({r.violations})")
        return int(not all(r.passed for r in report))
    if args.command == "best":
        scorer = nets.NetScorer.load(args.weights) if args.weights else search.material_scorer
        roots = spark.createDataFrame([(0, args.fen)], "root bigint, fen string")
        rows = search.search(roots, scorer, args.depth).filter(F.col("rank") <= args.top).orderBy("rank").collect()
        for r in rows:
            print(f"{r['rank']:>2} {r.move:<6}{r.value:>9.4f}")
        return 0 if rows else 2
    sources = dict(d.split("=", 1) for d in args.dumps) or {d: cfg.source.dump_url(d) for d in cfg.source.dumps}
    if not sources:
        print("no dumps")
        return 2
    if args.command == "survey":
        for r in build.survey(spark, cfg, sources, args.max_games).collect():
            print(f"{r.dump}: {r.games_accepted} of {r.games_seen} games accepted ({r.acceptance_rate:.2%})")
        return 0
    version = label.engine_version(cfg.labeling)
    report = build.run_build(spark, cfg, lambda fens: label.scored(fens, cfg.labeling), version, sources, args.max_shards, args.target_positions, max_games=args.max_games, max_scanned=args.max_scanned)
    for r in report.collect():
        print(f"{r.dump} shard {r.shard}: {r.n_positions} positions of {r.n_games} games, {r.n_duplicates} duplicates")
    print(build.summary(report).first().summary)
    return 0


if __name__ == "__main__":
    sys.exit(main())
