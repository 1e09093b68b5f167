"""The command line: ``python -m loomset.cli COMMAND``."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import functions as F

from loomset import build, settings
from loomset.operators import captioning, dedupe, lint, pixels, reports
from loomset.operators.answers import AnswerLog
from loomset.plans import training
from loomset.session import build_session
from loomset.sources import files, headers, packages, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomset")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("lint", "report on captions"), ("stats", "sizes and steps"), ("duplicates", "groups of like images"), ("quality", "measures of images")):
        c = sub.add_parser(name, help=text)
        c.add_argument("folder")
        c.add_argument("--trigger", default="")
        c.add_argument("--distance", type=int, default=5)
    c = sub.add_parser("preprocess", help="resize images into another folder")
    c.add_argument("folder")
    c.add_argument("out")
    c.add_argument("--target", type=int, default=1024)
    c = sub.add_parser("export", help="package a captioned folder")
    c.add_argument("folder")
    c.add_argument("root")
    c.add_argument("--name", default="")
    c.add_argument("--trigger", default="")
    c.add_argument("--zip", action="store_true")
    c = sub.add_parser("preview", help="what an export would hold, and what is odd about it")
    c.add_argument("folder")
    c.add_argument("--trigger", default="")
    c = sub.add_parser("caption", help="caption a folder's images and write their sidecars")
    c.add_argument("folder")
    c.add_argument("--backend", required=True, help="module:function; the function takes a model's name and options, and gives the function of an image")
    c.add_argument("--model", default="")
    c.add_argument("--kind", default="custom", choices=("local", "cloud", "tagger", "custom"))
    c.add_argument("--log", default="", help="folder of the answers: a second run asks for the rest only")
    c.add_argument("--style", default="prose")
    c.add_argument("--trigger", default="")
    c.add_argument("--skip-captioned", action="store_true")
    c = sub.add_parser("train", help="write a trainer's configuration")
    c.add_argument("folder")
    c.add_argument("form", choices=("job", "dataset", "subsets"))
    c.add_argument("--name", required=True)
    c.add_argument("--trigger", default="")
    c.add_argument("--model", default="")
    c.add_argument("--arch", default="flux")
    c.add_argument("--steps", type=int, default=2000)
    c = sub.add_parser("keys", help="list, set or unset keys")
    c.add_argument("action", choices=("list", "set", "unset"))
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    c.add_argument("--file", default=".env")
    return p


def _keys(args: argparse.Namespace) -> str:
    if args.action == "list":
        return "\n".join(f"{k}={settings.masked(v)}" for k, v in sorted(settings.read_env(args.file).items()))
    if not args.key or (args.action == "set") != (args.value is not None):
        raise SystemExit("keys set NAME VALUE, or keys unset NAME")
    if args.action == "set":
        settings.set_key(args.file, args.key, args.value)
        return f"{args.key} set"
    return f"{args.key} removed" if settings.unset_key(args.file, args.key) else f"{args.key} wasn't set"


def run(args: argparse.Namespace) -> str:
    if args.command == "keys":
        return _keys(args)
    if args.command == "train":
        model = {"name_or_path": args.model, "arch": args.arch}
        return training.write_config(training.Training(args.name, args.folder, args.trigger, model=model, steps=args.steps), args.form)
    spark = build_session("loomset", args.master)
    if args.command == "caption":
        module, _, function = args.backend.partition(":")
        backend = captioning.Backend(args.kind, getattr(importlib.import_module(module), function), args.model)
        done = build.caption_folder(spark, args.folder, backend, log=AnswerLog(args.log) if args.log else None, style=args.style, trigger=args.trigger, skip_existing=args.skip_captioned)
        return reports.failure_report(done)
    pairs = files.pairs(spark, args.folder)
    if args.command == "lint":
        return reports.lint_report(pairs.withColumn("caption", F.coalesce("caption", F.lit(""))), args.trigger)
    if args.command == "export":
        folder = packages.package(pairs, args.root, args.name, args.trigger)
        return packages.zipped(folder, spark) if args.zip else folder
    images = files.files(spark, args.folder).where(F.col("ext").isin(files.IMAGE_EXTENSIONS))
    if args.command == "preprocess":
        done = pixels.prepared(images, pixels.Preparation(args.target)).persist()
        named = F.concat(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", ""), F.lit("_prepped.png"))
        sinks.write_folder(done.where("content IS NOT NULL").select(named.alias("name"), "content"), args.out)
        n = done.where("content IS NOT NULL").count()
        failed = [f"{r.path}: {r.error}" for r in done.where("content IS NULL").select("path", "error").orderBy("path").collect()]
        return "\n".join([f"{n} written", *failed])
    if args.command == "stats":
        return reports.stats_report(headers.sized_pairs(spark, args.folder))
    found = pixels.measured(images)
    if args.command == "preview":
        seen = build.preview(pairs, found, args.trigger)
        lines = [f"{name.replace('_', ' ')}: {value}" for name, value in seen.counts.items()]
        return "\n".join([*lines, f"near duplicates: {seen.groups.count()}", f"groups of equal captions: {seen.duplicate_captions.count()}"])
    if args.command == "duplicates":
        numbered = found.join(pairs.select("path", "ord"), "path").persist()
        groups = dedupe.near_groups(numbered.select("ord", "hash"), args.distance)
        rows = groups.join(numbered.select(F.col("ord").alias("member"), "path"), "member").orderBy("seed", "member").collect()
        return "\n".join(f"{r.seed}\t{r.path}" for r in rows)
    return "\n".join(f"{r.path}\t{r.w}x{r.h}\t{r.sharpness:.1f}" for r in found.where("w IS NOT NULL").orderBy("path").toLocalIterator())


def main(argv: list[str] | None = None) -> int:
    print(run(parser().parse_args(argv)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
