"""Command line: ``python -m treeloom list|info|parse|process|download|clean|cache-dir|init|completions``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from treeloom.functions import cache, registry
from treeloom.operators import tree
from treeloom.plans import api
from treeloom.plans.config import PackConfig, ProcessConfig
from treeloom.plans.errors import TreeloomError
from treeloom.sources.readers import read_source

FLAGS = ("structure", "imports", "exports", "comments", "docstrings", "symbols", "diagnostics")


def build() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treeloom")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("list")
    x.add_argument("--filter")
    x = sub.add_parser("info")
    x.add_argument("language")
    x = sub.add_parser("parse")
    x.add_argument("file")
    x.add_argument("--language")
    x.add_argument("--format", choices=("sexp", "json"), default="sexp")
    x = sub.add_parser("process")
    x.add_argument("file")
    x.add_argument("--language")
    x.add_argument("--all", action="store_true")
    x.add_argument("--chunk-size", type=int)
    for f in FLAGS:
        x.add_argument(f"--{f}", action="store_true")
    x = sub.add_parser("download")
    x.add_argument("languages", nargs="*")
    x.add_argument("--groups", default="")
    x = sub.add_parser("init")
    x.add_argument("--cache-dir")
    x.add_argument("--languages", default="")
    x.add_argument("--groups", default="")
    sub.add_parser("clean")
    sub.add_parser("cache-dir")
    x = sub.add_parser("completions")
    x.add_argument("shell", choices=("bash", "zsh", "fish"))
    return p


def completions(shell: str) -> str:
    """A script that completes commands, and the options of each, in a shell."""
    sub = next(a for a in build()._actions if isinstance(a, argparse._SubParsersAction))
    options = {name: sorted(o for a in p._actions for o in a.option_strings if o.startswith("--")) for name, p in sub.choices.items()}
    names = " ".join(options)
    if shell == "fish":
        rows = ["complete -c treeloom -f", f"complete -c treeloom -n __fish_use_subcommand -a '{names}'"]
        return "\n".join(rows + [f"complete -c treeloom -n '__fish_seen_subcommand_from {k}' -l {o[2:]}" for k, v in options.items() for o in v])
    cases = "\n".join(f"    {k}) COMPREPLY=($(compgen -f -W '{' '.join(v)}' -- \"$word\"));;" for k, v in options.items())
    script = f"""_treeloom() {{
  local word="${{COMP_WORDS[COMP_CWORD]}}"
  if [ "$COMP_CWORD" -eq 1 ]; then COMPREPLY=($(compgen -W '{names}' -- "$word")); return; fi
  case "${{COMP_WORDS[1]}}" in
{cases}
  esac
}}
complete -F _treeloom treeloom"""
    return "autoload -U +X bashcompinit && bashcompinit\n" + script if shell == "zsh" else script


def source(spark: SparkSession, a: argparse.Namespace):
    from pyspark.sql import functions as F

    s = read_source(spark, a.file)
    if a.language:
        s = s.withColumn("language", F.lit(a.language))
    row = s.select("language", F.col("text").isNull().alias("bad")).first()
    if row.bad:
        raise TreeloomError(f"{a.file}: not valid UTF-8")
    if row.language is None:
        raise TreeloomError(f"{a.file}: can't tell the language; give --language")
    registry.get_parser(row.language)
    return s, row.language


def main(argv: list[str] | None = None) -> int:
    a = build().parse_args(argv)
    try:
        if a.command == "list":
            names = registry.list_languages(a.filter)
            print("\n".join([*names, f"{len(names)} languages"]))
        elif a.command == "info":
            print("\n".join(f"{k}: {v}" for k, v in registry.info(a.language).items()))
        elif a.command == "cache-dir":
            print(cache.cache_dir())
        elif a.command == "completions":
            print(completions(a.shell))
        elif a.command == "clean":
            cache.clean_cache()
        elif a.command == "download":
            got = [x for g in a.groups.split(",") if g for x in cache.ensure_group(g)]
            print(cache.download([*a.languages, *got]), "new")
        elif a.command == "init":
            print(PackConfig(a.cache_dir, tuple(filter(None, a.languages.split(","))), tuple(filter(None, a.groups.split(",")))).save("."))
        else:
            spark = SparkSession.builder.appName("treeloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
            s, language = source(spark, a)
            if a.command == "parse":
                print(tree.parse_result(s, a.format).first().output)
            else:
                config = ProcessConfig(language).folded(a.all, **{f: getattr(a, f) for f in FLAGS})
                if a.chunk_size is not None:
                    config = config.with_chunking(a.chunk_size)
                print(api.to_json(api.process(s, config)).first().json)
    except TreeloomError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
