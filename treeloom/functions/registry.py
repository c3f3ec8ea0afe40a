"""Languages, aliases, extensions and interpreters: dimension tables and the functions over them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.plans.errors import LanguageNotFound

#: Every registered language by group; a group is what ``groups`` of a configuration names.
GROUPS: dict[str, str] = {
    "web": "html css scss less javascript typescript tsx vue svelte astro angular php blade twig htmldjango http graphql jinja2 liquid heex eex pug superhtml templ wat wast wgsl wgsl_bevy glimmer embeddedtemplate razor qmljs jsdoc rasi",
    "systems": "c cpp rust go zig d nim odin v ada fortran pascal asm nasm x86asm llvm mlir cuda ispc hlsl glsl hare c3 objc swift arduino linkerscript devicetree verilog systemverilog vhdl firrtl move cairo solidity cobol",
    "scripting": "python ruby perl lua luau bash fish zsh nushell powershell tcl awk r julia elvish batch gdscript squirrel janet fennel vim hack ql starlark groovy matlab",
    "data": "json json5 jsonnet yaml toml xml csv tsv psv sql sql_bigquery ini properties proto textproto thrift capnp hcl terraform cue dhall kdl ron pkl cpon sparql promql prql prisma bibtex latex markdown markdown_inline rst asciidoc org typst",
    "jvm": "java kotlin scala clojure javadoc smali",
    "functional": "haskell ocaml ocaml_interface fsharp fsharp_signature elm erlang elixir gleam purescript idris agda lean scheme racket commonlisp elisp sml roc nix",
    "other": "vb al gn po jq nqc dtd rtf gpg jai abl kcl cel vrl bsl pem pgn gap rbs eds vhs wit dot cst tera elsa re2c cylc func make haxe diff ebnf norg yuck teal fidl cfml hurl foam stan gren hoon corn rego mojo luap bass tact djot dart test just udev apex tmux sway pony ninja gomod cmake slang forth chuck magik gosum hocon meson hjson bicep cedar robot faust regex nginx caddy ziggy query luadoc vimdoc phpdoc turtle printf prolog gowork uxntal nickel gotmpl circom csharp ledger qmldir puppet smithy mermaid enforce bitbake souffle kconfig crystal wolfram doxygen chatito desktop tlaplus comment gnuplot todotxt netlinx clarity typespec openscad readline xcompose cooklang hyprlang tablegen gdshader rescript ocamllex facility norg_meta snakemake earthfile gitignore gstlaunch smalltalk ungrammar gitcommit beancount dockerfile git_rebase ssh_config git_config sourcepawn poe_filter typoscript postscript pymanifest cedarschema ziggy_schema editorconfig requirements actionscript brightscript gitattributes godot_resource",
}
LANGUAGES: dict[str, str] = {name: group for group, names in GROUPS.items() for name in names.split()}

ALIASES: dict[str, str] = {"shell": "bash", "makefile": "make", "lisp": "commonlisp", "gradle": "groovy", "bazel": "starlark", "ignorefile": "gitignore"}

EXTENSIONS: dict[str, str] = {
    ext: lang
    for lang, exts in {
        "python": "py pyi pyw", "rust": "rs", "javascript": "js mjs cjs jsx", "typescript": "ts mts cts", "tsx": "tsx", "c": "c h", "cpp": "cpp cc cxx hpp hxx hh", "go": "go", "ruby": "rb rake gemspec", "java": "java", "csharp": "cs", "html": "html htm",
        "css": "css", "scss": "scss", "less": "less", "json": "json", "json5": "json5", "yaml": "yaml yml", "toml": "toml", "sql": "sql", "markdown": "md markdown", "php": "php", "kotlin": "kt kts", "scala": "scala sc", "swift": "swift", "bash": "sh bash", "fish": "fish", "zsh": "zsh",
        "perl": "pl pm", "lua": "lua", "r": "r", "julia": "jl", "haskell": "hs", "ocaml": "ml", "ocaml_interface": "mli", "fsharp": "fs fsx", "fsharp_signature": "fsi", "elixir": "ex exs", "erlang": "erl hrl", "elm": "elm", "clojure": "clj cljs cljc edn", "dart": "dart", "zig": "zig", "nim": "nim",
        "xml": "xml xsd xsl svg", "ini": "ini", "csv": "csv", "tsv": "tsv", "proto": "proto", "thrift": "thrift", "graphql": "graphql gql", "vue": "vue", "svelte": "svelte", "astro": "astro", "terraform": "tf tfvars", "hcl": "hcl", "nix": "nix", "objc": "m mm", "matlab": "mat", "verilog": "vh",
        "systemverilog": "sv svh", "v": "v", "gdscript": "gd", "gomod": "mod", "nginx": "conf", "vhdl": "vhd vhdl", "ada": "adb ads", "fortran": "f90 f95 f03 f08", "pascal": "pas", "d": "d", "tcl": "tcl", "vim": "vim", "powershell": "ps1 psm1", "batch": "bat cmd", "latex": "tex sty", "bibtex": "bib", "rst": "rst", "org": "org",
        "asm": "asm s", "cuda": "cu cuh", "glsl": "glsl vert frag", "hlsl": "hlsl", "wgsl": "wgsl", "groovy": "groovy", "racket": "rkt", "scheme": "scm ss", "commonlisp": "lisp", "elisp": "el", "solidity": "sol", "cmake": "cmake", "make": "mk", "diff": "diff patch", "properties": "properties", "purescript": "purs", "gleam": "gleam",
        "odin": "odin", "starlark": "bzl star", "typst": "typ", "just": "just", "meson": "meson", "ninja": "ninja", "prisma": "prisma", "prolog": "pro", "twig": "twig", "pug": "pug", "awk": "awk", "cobol": "cob cbl", "crystal": "cr", "agda": "agda", "lean": "lean", "idris": "idr", "jsonnet": "jsonnet libsonnet", "kdl": "kdl", "ron": "ron",
    }.items()
    for ext in exts.split()
}

AMBIGUITIES: dict[str, tuple[str, list[str]]] = {
    "h": ("c", ["cpp", "objc"]), "m": ("objc", ["matlab"]), "pl": ("perl", ["prolog"]), "sv": ("systemverilog", ["verilog"]), "svh": ("systemverilog", ["verilog"]),
    "v": ("v", ["verilog"]), "gd": ("gdscript", ["gap"]), "mod": ("gomod", ["fortran"]), "conf": ("nginx", ["hocon"]),
}

INTERPRETERS: dict[str, str] = {
    name: lang for lang, names in {"python": "python", "bash": "bash sh dash ash zsh", "javascript": "node nodejs", "ruby": "ruby jruby", "perl": "perl", "lua": "lua", "php": "php", "elixir": "elixir", "julia": "julia", "r": "Rscript r R"}.items() for name in names.split()
}

#: Bundled queries by (language, kind); kinds are highlights, injections and locals.
BUNDLED: dict[tuple[str, str], str] = {
    ("python", "highlights"): '(comment) @comment\n(string) @string\n(integer) @number\n(function_definition name: (identifier) @function)\n(class_definition name: (identifier) @type)\n(call function: (identifier) @function.call)',
    ("python", "locals"): "(module) @local.scope\n(function_definition) @local.scope\n(function_definition name: (identifier) @local.definition)\n(identifier) @local.reference",
    ("javascript", "highlights"): "(comment) @comment\n(string) @string\n(number) @number\n(function_declaration name: (identifier) @function)\n(class_declaration name: (identifier) @type)",
    ("javascript", "injections"): "((comment) @injection.content)",
    ("javascript", "locals"): "(program) @local.scope\n(identifier) @local.reference",
    ("json", "highlights"): "(pair key: (string) @property)\n(string) @string\n(number) @number\n(true) @constant\n(false) @constant\n(null) @constant",
    ("html", "highlights"): "(tag_name) @tag\n(attribute_name) @attribute\n(attribute_value) @string\n(comment) @comment",
    ("html", "injections"): "(script_element (raw_text) @injection.content)\n(style_element (raw_text) @injection.content)",
}

#: Parser factories that callers added: name -> function(bytes) -> root node.
_ADDED: dict[str, Callable] = {}


def check_tables(extensions: dict[str, str] | None = None, ambiguities: dict[str, tuple[str, list[str]]] | None = None) -> None:
    """Refuse an extension table that couldn't be looked up unambiguously."""
    extensions, ambiguities = EXTENSIONS if extensions is None else extensions, AMBIGUITIES if ambiguities is None else ambiguities
    for ext, lang in extensions.items():
        if not re.fullmatch(r"[a-z0-9_]+", ext):
            raise ValueError(f"extension {ext!r} must be lower-case ASCII letters, digits or _")
        if lang not in LANGUAGES:
            raise ValueError(f"extension {ext!r} names the unknown language {lang!r}")
    for ext, (assigned, others) in ambiguities.items():
        if extensions.get(ext) != assigned:
            raise ValueError(f"{ext!r} is assigned to {extensions.get(ext)!r}, not {assigned!r}")
        for x in others:
            if x not in LANGUAGES or x == assigned:
                raise ValueError(f"alternative {x!r} of {ext!r} is unknown or the assigned one")


check_tables()


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def resolve_alias(name: Column | str) -> Column | str:
    """The canonical name: one exact, case-sensitive step; other names stay as they are."""
    if isinstance(name, str):
        return ALIASES.get(name, name)
    return F.coalesce(F.element_at(literal_map(ALIASES), name), name)


def languages(spark: SparkSession) -> DataFrame:
    """(language, group, has_parser) of all registered languages."""
    from treeloom.operators.parsers import PARSERS

    return spark.createDataFrame([(k, g, k in PARSERS or k in _ADDED) for k, g in sorted({**LANGUAGES, **{k: None for k in _ADDED if k not in LANGUAGES}}.items())], 'language string, "group" string, has_parser boolean'.replace('"', "`"))


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(ALIASES.items()), "alias string, target string")


def extensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(EXTENSIONS.items()), "extension string, language string")


def ambiguities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, a, o) for k, (a, o) in sorted(AMBIGUITIES.items())], "extension string, assigned string, alternatives array<string>")


def bundled_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, q) for (a, b), q in sorted(BUNDLED.items())], "language string, kind string, query string")


def get_query(language: str, kind: str) -> str | None:
    """The bundled query of a kind, or None."""
    return BUNDLED.get((resolve_alias(language), kind))


def get_highlights_query(language: str) -> str | None:
    return get_query(language, "highlights")


def get_injections_query(language: str) -> str | None:
    return get_query(language, "injections")


def get_locals_query(language: str) -> str | None:
    return get_query(language, "locals")


def available_languages(spark: SparkSession) -> DataFrame:
    """(language): names and those aliases whose target is there, sorted and distinct."""
    names = languages(spark).select("language")
    known = aliases(spark).join(names, F.col("target") == F.col("language"), "left_semi").select(F.col("alias").alias("language"))
    return names.union(known).distinct().orderBy("language")


def list_languages(filter: str | None = None) -> list[str]:
    """Sorted names and aliases, those that contain ``filter`` where it is given."""
    names = sorted({*LANGUAGES, *_ADDED, *(a for a, t in ALIASES.items() if t in LANGUAGES)})
    return [x for x in names if filter is None or filter in x]


def language_count() -> int:
    return len(list_languages())


def has_language(name: Column | str) -> Column | bool:
    """Whether a name, alias resolved, is registered."""
    if isinstance(name, str):
        return resolve_alias(name) in LANGUAGES or resolve_alias(name) in _ADDED
    return F.coalesce(resolve_alias(name).isin(*sorted({*LANGUAGES, *_ADDED})), F.lit(False))


def get_language(name: str) -> str:
    """The canonical name of a registered language."""
    if not has_language(name):
        raise LanguageNotFound(name)
    return resolve_alias(name)


def get_parser(name: str) -> Callable:
    """The parser function of a language; LanguageNotFound where it has none here."""
    from treeloom.operators.parsers import PARSERS

    lang = get_language(name)
    parser = _ADDED.get(lang) or PARSERS.get(lang)
    if parser is None:
        raise LanguageNotFound(f"{name} (registered, but without a parser)")
    return parser


def register_parser(name: str, parser: Callable) -> None:
    """Add a parser for a language, new or known: ``parser(bytes)`` returns the root ``Node``."""
    _ADDED[name] = parser


def info(name: str) -> dict:
    lang = resolve_alias(name)
    from treeloom.operators.parsers import PARSERS

    return {"language": lang, "known": has_language(lang), "has_parser": lang in PARSERS or lang in _ADDED, "group": LANGUAGES.get(lang)}
