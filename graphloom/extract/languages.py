"""Language handlers as tables: extensions, declarations by kind, imports, and how far a declaration reaches.

A handler is data; `parse` is the one function that reads a file by it.  Declarations are looked for in the text with
blanks for comments and strings, so that neither is taken for code, and names, signatures and imports are read from the
text itself.  A project adds handlers with `Registry.add`; the last one of an extension holds.
"""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

N = r"(?P<name>[A-Za-z_$][\w$]*)"
Q = r"(?P<name>[A-Za-z_][\w.:]*)"


class Declared(NamedTuple):
    name: str
    kind: str
    start: int  # byte offsets into the file, end exclusive
    end: int
    signature: str
    summary: str
    meta: dict | None = None


class Imported(NamedTuple):
    specifier: str
    names: tuple[str, ...] = ()
    form: str = "import"  # import, dynamic-import or re-export
    type_only: bool = False


class Parsed(NamedTuple):
    symbols: list[Declared]
    imports: list[Imported]


C_LIKE = r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
HASH = r"#[^\n]*|\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
HIDE = {
    "c": re.compile(C_LIKE, re.S), "js": re.compile(C_LIKE + r"|`(?:\\.|[^`\\])*`", re.S), "hash": re.compile(HASH, re.S), "php": re.compile(C_LIKE + r"|#(?!\[)[^\n]*", re.S),
    "dash": re.compile(r"\{-.*?-\}|--[^\n]*|\"(?:\\.|[^\"\\\n])*\"", re.S), "sql": re.compile(r"/\*.*?\*/|--[^\n]*|'(?:''|[^'])*'", re.S), "lua": re.compile(r"--\[\[.*?\]\]|--[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
    "percent": re.compile(r"%[^\n]*|\"(?:\\.|[^\"\\])*\"", re.S), "bang": re.compile(r"![^\n]*|\"[^\"\n]*\"|'[^'\n]*'"), "xml": re.compile(r"<!--.*?-->", re.S), "hcl": re.compile(r"/\*.*?\*/|//[^\n]*|#[^\n]*", re.S), "css": re.compile(r"/\*.*?\*/", re.S),
    "scss": re.compile(r"/\*.*?\*/|//[^\n]*", re.S), "nix": re.compile(r"/\*.*?\*/|#[^\n]*|''.*?''", re.S),
}


@dataclass(frozen=True)
class Language:
    """rules: (kind, pattern with a group `name`); reach: brace, indent, end or line; inside: function -> method there."""

    name: str
    extensions: tuple[str, ...]
    rules: tuple[tuple[str, str], ...] = ()
    imports: tuple[str, ...] = ()
    reach: str = "brace"
    hide: str = "c"
    containers: tuple[str, ...] = ("class", "interface", "type", "enum")
    read: Callable[[str], Parsed] | None = None
    flags: int = re.M
    openers: str = ""  # what deepens a block that a line `end` closes
    compiled: tuple = field(default=(), compare=False)


JS_RULES = (
    ("class", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{N}"), ("function", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{N}"),
    ("function", rf"^(?:export\s+)?(?:const|let|var)\s+{N}\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|[\w$]+)\s*(?::[^=\n]+)?=>"), ("function", rf"^(?:export\s+)?(?:const|let|var)\s+{N}\s*=\s*(?:async\s+)?function\b"),
    ("const", rf"^(?:export\s+)?(?:const|let|var)\s+{N}\s*(?::[^=\n]+)?=(?!.*=>)(?!\s*(?:async\s+)?function\b)(?!\s*require\()"),
    ("method", rf"^[ \t]+(?:(?:public|private|protected|static|async|get|set|override|abstract|readonly)\s+)*\*?(?!(?:if|for|while|switch|catch|function|return|constructor|new|typeof|await|else|do|super)\b)(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:<[^>\n]*>)?\([^;{{}}]*\)\s*(?::[^;{{}}=]+)?\{{"),
)
TS_RULES = (*JS_RULES, ("interface", rf"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+{N}"), ("enum", rf"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+{N}"), ("type", rf"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+{N}[^=\n]*="), ("property", rf"^  (?:(?:public|private|protected|static|readonly|declare|override)\s+)+{N}[?!]?\s*(?::[^;=(\n]+)?(?:=|;)"))
JVM_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|partial|inline|suspend|data|readonly|extern|unsafe|default|synchronized|native|strictfp|implicit|lazy|case|inner|annotation|value|const|tailrec|operator|infix|new)\s+)*"
HEAD = r"^[ \t]*(?:@[\w.]+(?:\([^)\n]*\))?\s+)*" + JVM_MODS
NOT_CALL = r"(?!(?:if|for|while|switch|catch|return|new|else|do|throw|case|using|lock|synchronized|sizeof|typeof|foreach|when|try)\b)"
TYPED = r"[A-Za-z_][\w.]*(?:<[^;{}()=]*>)?(?:\[\s*\])*\??[*&]*"
CLASSY = (("class", HEAD + rf"(?:class|record|object)\s+{N}"), ("interface", HEAD + rf"(?:interface|trait|protocol|@interface)\s+{N}"), ("enum", HEAD + rf"enum\s+(?:class\s+)?{N}"))


def _typed_method(kind: str = "method") -> tuple[str, str]:
    return kind, HEAD + r"(?:<[^>\n]*>\s+)?" + NOT_CALL + TYPED + r"\s+" + NOT_CALL + N + r"\s*(?:<[^>\n]*>)?\([^;{}]*\)[^;{}=\n]*(?:\{|=>|;)"


LANGUAGES: tuple[Language, ...] = (
    Language("typescript", (".ts", ".mts", ".cts", ".tsx"), TS_RULES, hide="js"),
    Language("javascript", (".js", ".jsx", ".mjs", ".cjs"), JS_RULES, hide="js"),
    Language("go", (".go",), (("method", rf"^func\s+\([^)\n]*\)\s*{N}"), ("function", rf"^func\s+{N}"), ("struct", rf"^type\s+{N}[^\n]*\bstruct\b"), ("interface", rf"^type\s+{N}[^\n]*\binterface\b"), ("type", rf"^type\s+{N}\s+(?!struct|interface)[\w\[*]"), ("const", rf"^(?:const|var)\s+{N}")), (r"^import\s+(?:[\w.]+\s+)?\"(?P<spec>[^\"]+)\"", r"^\s+(?:[\w.]+\s+)?\"(?P<spec>[\w./\-]+)\"\s*$")),
    Language("java", (".java",), (*CLASSY, _typed_method(), ("const", HEAD + TYPED + rf"\s+(?P<name>[A-Z][A-Z0-9_]+)\s*=")), (r"^import\s+(?:static\s+)?(?P<spec>[\w.]+(?:\.\*)?)\s*;",)),
    Language("kotlin", (".kt", ".kts"), (*CLASSY, ("function", HEAD + rf"fun\s+(?:<[^>\n]*>\s*)?(?:[\w<>?]+\.)?{N}"), ("property", HEAD + rf"(?:val|var)\s+{N}"), ("type", HEAD + rf"typealias\s+{N}")), (r"^import\s+(?P<spec>[\w.]+(?:\.\*)?)",)),
    Language("csharp", (".cs",), (*CLASSY, ("struct", HEAD + rf"struct\s+{N}"), _typed_method(), ("property", HEAD + TYPED + rf"\s+{N}\s*\{{\s*(?:get|set|init)\b"), ("const", HEAD + rf"{TYPED}\s+(?P<name>[A-Z]\w*)\s*=\s*[^=>]")), (r"^\s*using\s+(?:static\s+)?(?P<spec>[\w.]+)\s*;",)),
    Language("scala", (".scala", ".sc"), (*CLASSY, ("function", HEAD + rf"def\s+{N}"), ("const", HEAD + rf"(?:val|var)\s+{N}"), ("type", HEAD + rf"type\s+{N}")), (r"^\s*import\s+(?P<spec>[\w.{}, *]+)",)),
    Language("groovy", (".groovy", ".gradle"), (*CLASSY, ("function", HEAD + rf"def\s+{N}\s*\("), _typed_method(), ("const", rf"^(?:def|final\s+\w+)\s+{N}\s*=")), (r"^import\s+(?P<spec>[\w.]+(?:\.\*)?)",)),
    Language("swift", (".swift",), (*CLASSY, ("struct", HEAD + rf"struct\s+{N}"), ("type", HEAD + rf"(?:extension|typealias|actor)\s+{N}"), ("function", HEAD + rf"(?:mutating\s+)?func\s+{N}"), ("const", HEAD + rf"(?:let|var)\s+{N}")), (r"^\s*(?:@testable\s+)?import\s+(?:class\s+|struct\s+)?(?P<spec>[\w.]+)",)),
    Language("dart", (".dart",), (("class", HEAD + rf"(?:class|mixin|extension)\s+{N}"), ("enum", HEAD + rf"enum\s+{N}"), ("type", HEAD + rf"typedef\s+{N}"), _typed_method("function"), ("const", rf"^(?:const|final)\s+(?:[\w<>]+\s+)?{N}\s*=")), (r"^(?:import|export|part)\s+'(?P<spec>[^']+)'", r"^(?:import|export|part)\s+\"(?P<spec>[^\"]+)\"")),
    Language("rust", (".rs",), (("function", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\S+\s+)*fn\s+{N}"), ("struct", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+{N}"), ("enum", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+{N}"), ("interface", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+{N}"), ("class", rf"^impl(?:<[^>\n]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?{N}"), ("type", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?type\s+{N}"), ("const", rf"^(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?{N}"), ("macro", rf"^macro_rules!\s+{N}")),
             (r"^\s*(?:pub\s+)?use\s+(?P<spec>[\w:{}, *]+);", r"^\s*(?:pub\s+)?mod\s+(?P<spec>\w+);")),
    Language("c", (".c", ".h"), (("struct", rf"^(?:typedef\s+)?(?:struct|union)\s+{N}\s*\{{"), ("enum", rf"^(?:typedef\s+)?enum\s+{N}"), ("macro", rf"^[ \t]*#[ \t]*define\s+{N}"), ("type", rf"^typedef\s+[^;{{}}]*?\b{N}\s*;"), ("function", rf"^(?!typedef|struct\s+\w+\s*\{{)(?:[A-Za-z_]\w*[ \t*]+)+\**{NOT_CALL}{N}\s*\([^;{{}}]*\)\s*\{{")), (r"^[ \t]*#[ \t]*include\s+[<\"](?P<spec>[^>\"]+)[>\"]",)),
    Language("cpp", (".cpp", ".cxx", ".cc", ".c++", ".hpp", ".hxx", ".hh", ".h++"), (("namespace", rf"^\s*(?:inline\s+)?namespace\s+{Q}"), ("class", rf"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?:[A-Z_]+\s+)?{N}[^;(){{}}]*\{{"), ("struct", rf"^\s*(?:template\s*<[^>]*>\s*)?(?:typedef\s+)?(?:struct|union)\s+{N}[^;(){{}}]*\{{"), ("enum", rf"^\s*enum\s+(?:class\s+|struct\s+)?{N}"), ("macro", rf"^[ \t]*#[ \t]*define\s+{N}"), ("type", rf"^\s*(?:using\s+{N}\s*=|typedef\b)"), ("method", rf"^(?:template\s*<[^>]*>\s*)?(?:[\w:<>,*&~]+[ \t*&]+)*\w[\w<>]*::(?P<name>~?\w+|operator\S+)\s*\([^;{{}}]*\)[^;{{}}]*\{{"), ("function", rf"^\s*(?:template\s*<[^>]*>\s*)?(?:[A-Za-z_][\w:<>,]*[ \t*&]+)+{NOT_CALL}{N}\s*\([^;{{}}]*\)[^;{{}}=]*\{{")),
             (r"^[ \t]*#[ \t]*include\s+[<\"](?P<spec>[^>\"]+)[>\"]",), containers=("class", "struct")),
    Language("objective-c", (".m", ".mm"), (("class", rf"^@(?:interface|implementation)\s+{N}"), ("interface", rf"^@protocol\s+{N}"), ("method", rf"^[-+]\s*\([^)]*\)\s*{N}"), ("property", rf"^@property[^;]*?\b{N}\s*;"), ("function", rf"^(?:[A-Za-z_]\w*[ \t*]+)+{NOT_CALL}{N}\s*\([^;{{}}]*\)\s*\{{")), (r"^#(?:import|include)\s+[<\"](?P<spec>[^>\"]+)[>\"]", r"^@import\s+(?P<spec>[\w.]+)")),
    Language("php", (".php",), (*CLASSY, ("function", HEAD + rf"function\s+&?{N}\s*\("), ("const", HEAD + rf"const\s+(?:\w+\s+)?{N}\s*="), ("const", r"\bdefine\(\s*['\"](?P<name>\w+)['\"]"), ("property", HEAD + rf"(?:\??[\w\\|]+\s+)?\$(?P<name>\w+)\s*(?:=|;)")), (r"^\s*use\s+(?:function\s+|const\s+)?(?P<spec>[\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?['\"](?P<spec>[^'\"]+)['\"]"), hide="php", containers=("class", "interface", "enum")),
    Language("protobuf", (".proto",), (("class", rf"^\s*message\s+{N}"), ("enum", rf"^\s*enum\s+{N}"), ("interface", rf"^\s*service\s+{N}"), ("method", rf"^\s*rpc\s+{N}")), (r"^import\s+(?:public\s+|weak\s+)?\"(?P<spec>[^\"]+)\"",)),
    Language("gleam", (".gleam",), (("function", rf"^(?:pub\s+)?fn\s+{N}"), ("type", rf"^(?:pub\s+)?(?:opaque\s+)?type\s+{N}\s*(?:\([^)]*\))?\s*="), ("class", rf"^(?:pub\s+)?(?:opaque\s+)?type\s+{N}[^=\n]*\{{"), ("const", rf"^(?:pub\s+)?const\s+{N}")), (r"^import\s+(?P<spec>[\w/]+)",)),
    Language("graphql", (".graphql", ".gql"), (("class", rf"^(?:extend\s+)?type\s+{N}"), ("interface", rf"^(?:extend\s+)?interface\s+{N}"), ("enum", rf"^(?:extend\s+)?enum\s+{N}"), ("type", rf"^(?:extend\s+)?(?:input|union|scalar)\s+{N}"), ("decorator", r"^directive\s+@(?P<name>\w+)"), ("function", rf"^(?:query|mutation|subscription)\s+{N}"), ("const", rf"^fragment\s+{N}")), (r"^#\s*import\s+['\"](?P<spec>[^'\"]+)['\"]",), hide="hash"),
    Language("hcl", (".hcl", ".tfvars"), (("class", r"^(?P<name>[a-z_]\w*)(?:\s+\"[^\"]*\")*\s*\{"), ("const", rf"^{N}\s*=")), (r"^\s*source\s*=\s*\"(?P<spec>[^\"]+)\"",), hide="hcl"),
    Language("terraform", (".tf",), (("class", r"^(?:resource|data)\s+\"[^\"]+\"\s+\"(?P<name>[^\"]+)\""), ("class", r"^(?:module|provider)\s+\"(?P<name>[^\"]+)\""), ("const", r"^(?:variable|output)\s+\"(?P<name>[^\"]+)\""), ("function", r"^(?P<name>locals|terraform)\s*\{")), (r"^\s*source\s*=\s*\"(?P<spec>[^\"]+)\"",), hide="hcl"),
    Language("css", (".css",), (("const", r"(?:^|[{;])\s*(?P<name>--[\w-]+)\s*:"), ("const", r"^(?P<name>[.#][\w-]+)[^{};]*\{"), ("const", r"^@(?:keyframes|font-face|media|layer)\s*(?P<name>[^{};\n]*?)\s*\{")), (r"@import\s+(?:url\()?['\"](?P<spec>[^'\"]+)['\"]",), hide="css"),
    Language("scss", (".scss", ".sass"), (("function", r"^@function\s+(?P<name>[\w-]+)"), ("type", r"^@mixin\s+(?P<name>[\w-]+)"), ("const", r"^\$(?P<name>[\w-]+)\s*:"), ("class", r"^(?P<name>[.#%][\w-]+)[^{};]*\{")), (r"@(?:import|use|forward)\s+['\"](?P<spec>[^'\"]+)['\"]",), hide="scss"),
    Language("less", (".less",), (("const", r"^@(?P<name>[\w-]+)\s*:(?!\s*\{)"), ("function", r"^(?P<name>[.#][\w-]+)\s*\([^)]*\)\s*(?:when\s*[^{]*)?\{"), ("type", r"^(?P<name>[.#][\w-]+)[^{};()]*\{")), (r"@import\s+(?:\([^)]*\)\s*)?['\"](?P<spec>[^'\"]+)['\"]",), hide="scss"),
    Language("bash", (".sh", ".bash", ".zsh", ".fish"), (("function", r"^[ \t]*(?:function\s+)?(?P<name>[\w:-]+)\s*\(\)\s*\{?"), ("function", r"^[ \t]*function\s+(?P<name>[\w:-]+)"), ("const", r"^(?:export\s+|readonly\s+|declare\s+(?:-\w+\s+)*)?(?P<name>[A-Z][A-Z0-9_]*)=")), (r"^\s*(?:source|\.)\s+['\"]?(?P<spec>[^'\"\s;]+)",), hide="hash"),
    Language("perl", (".pl", ".pm", ".t"), (("class", r"^package\s+(?P<name>[\w:]+)"), ("function", rf"^\s*sub\s+{N}"), ("const", r"^use\s+constant\s+(?P<name>\w+)")), (r"^\s*(?:use|require)\s+(?P<spec>[A-Z][\w:]*)",), hide="hash", containers=()),
    Language("r", (".r", ".rmd"), (("function", r"^(?P<name>[\w.]+)\s*(?:<-|=)\s*function\b"), ("class", r"\bset(?:Ref)?Class\(\s*['\"](?P<name>\w+)['\"]"), ("method", r"\bsetMethod\(\s*['\"](?P<name>\w+)['\"]"), ("const", r"^(?P<name>[A-Z][A-Z0-9_.]*)\s*(?:<-|=)\s*(?!function)")), (r"\b(?:library|require)\(\s*['\"]?(?P<spec>[\w.]+)", r"\bsource\(\s*['\"](?P<spec>[^'\"]+)['\"]"), hide="hash", containers=()),
    Language("nix", (".nix",), (("function", r"^\s*(?P<name>[\w-]+)\s*=\s*(?:\{[^}]*\}|[\w-]+)\s*:"), ("class", r"^\s*(?P<name>[\w-]+)\s*=\s*(?:rec\s+)?\{"), ("const", r"^\s*(?P<name>[\w-]+)\s*=\s*[^={\s][^:\n]*;")), (r"\bimport\s+(?P<spec>[<./][^\s;)]+)",), hide="nix"),
    Language("gdscript", (".gd",), (("class", rf"^(?:class_name|class)\s+{N}"), ("function", rf"^[ \t]*(?:static\s+)?func\s+{N}"), ("const", rf"^(?:const|enum)\s+{N}")), (r"\b(?:preload|load)\(\s*['\"](?P<spec>[^'\"]+)['\"]", r"^extends\s+['\"](?P<spec>[^'\"]+)['\"]"), reach="indent", hide="hash"),
    Language("ruby", (".rb",), (("class", r"^\s*class\s+(?P<name>[A-Z][\w:]*)"), ("type", r"^\s*module\s+(?P<name>[A-Z][\w:]*)"), ("method", r"^\s*def\s+(?:self\.)?(?P<name>[\w]+[?!=]?|[-+*/%<=>\[\]]+)"), ("const", r"^\s*(?P<name>[A-Z][A-Z0-9_]*)\s*=(?!=)")), (r"^\s*require(?:_relative)?\s+['\"](?P<spec>[^'\"]+)['\"]", r"\bautoload\s+:\w+,\s*['\"](?P<spec>[^'\"]+)['\"]"), reach="end", hide="hash", openers=r"^\s*(?:class|module|def|if|unless|case|while|until|for|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$"),
    Language("elixir", (".ex", ".exs"), (("class", r"^\s*defmodule\s+(?P<name>[\w.]+)"), ("interface", r"^\s*defprotocol\s+(?P<name>[\w.]+)"), ("function", r"^\s*defp?\s+(?P<name>\w+[?!]?)"), ("function", r"^\s*defmacrop?\s+(?P<name>\w+[?!]?)"), ("type", r"^\s*@(?:type|opaque|typep)\s+(?P<name>\w+)")), (r"^\s*(?:alias|import|use|require)\s+(?P<spec>[A-Z][\w.]*)",), reach="end", hide="hash", containers=("interface",), openers=r"\bdo\s*$|\bfn\b[^\n]*->\s*$"),
    Language("lua", (".lua",), (("method", r"^\s*function\s+\w[\w.]*:(?P<name>\w+)"), ("function", r"^\s*(?:local\s+)?function\s+(?P<name>[\w.]+)\s*\("), ("function", r"^\s*(?:local\s+)?(?P<name>[\w.]+)\s*=\s*function\b"), ("const", r"^local\s+(?P<name>[A-Z][A-Z0-9_]*)\s*=")), (r"\brequire\s*\(?\s*['\"](?P<spec>[^'\"]+)['\"]",), reach="end", hide="lua", containers=(), openers=r"\bfunction\b|\bthen\s*$|\bdo\s*$|^\s*repeat\b"),
    Language("fortran", (".f90", ".f95", ".f03", ".f08", ".for", ".f"), (("class", rf"^\s*(?:module(?!\s+procedure)|program|submodule\s*\([^)]*\))\s+{N}"), ("function", rf"^[ \t]*(?!end\b)(?:[\w()=*, ]+[ \t]+)??(?:function|subroutine)[ \t]+{N}"), ("type", rf"^\s*type\s*(?:,[^:\n]*)?(?:::)?\s*{N}\s*$"), ("interface", rf"^\s*(?:abstract\s+)?interface\s+{N}")), (r"^\s*use\s*(?:,\s*\w+\s*::)?\s*(?P<spec>\w+)", r"^\s*include\s+['\"](?P<spec>[^'\"]+)['\"]"), reach="end", hide="bang", flags=re.M | re.I, containers=("type",), openers=r"^\s*(?!end)(?:[\w()=*, ]+\s+)?(?:module(?!\s+procedure)|program|submodule|function|subroutine|type(?!\s*\()|interface|do|select|where)\b|\bthen\s*$"),
    Language("haskell", (".hs", ".lhs"), (("class", r"^(?:data|newtype)\s+(?:\w+\s+=>\s+)?(?P<name>[A-Z]\w*)"), ("type", r"^type\s+(?:family\s+)?(?P<name>[A-Z]\w*)"), ("interface", r"^class\s+(?:.*=>\s*)?(?P<name>[A-Z]\w*)"), ("function", r"^(?P<name>[a-z_][\w']*)\s*::[^\n]*->"), ("const", r"^(?P<name>[a-z_][\w']*)\s*::(?![^\n]*->)")), (r"^import\s+(?:safe\s+)?(?:qualified\s+)?(?P<spec>[A-Z][\w.]*)",), reach="indent", hide="dash"),
    Language("erlang", (".erl", ".hrl"), (("class", r"^-module\(\s*(?P<name>\w+)"), ("type", r"^-(?:type|opaque|record)\s*\(?\s*(?P<name>\w+)"), ("function", r"^(?P<name>[a-z]\w*)\s*\([^)\n]*\)\s*(?:when[^\n]*)?->")), (r"^-(?:include|include_lib)\(\s*\"(?P<spec>[^\"]+)\"", r"^-import\(\s*(?P<spec>\w+)"), reach="dot", hide="percent", containers=()),
    Language("sql", (".sql",), (("class", r"^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|materialized\s+)*(?:table|view)\s+(?:if\s+not\s+exists\s+)?[\"`\[]?(?P<name>[\w.]+)"), ("function", r"^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure|trigger)\s+[\"`\[]?(?P<name>[\w.]+)"), ("const", r"^\s*create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?[\"`\[]?(?P<name>[\w.]+)")), (r"\bref\(\s*['\"](?P<spec>[\w.]+)['\"]\s*\)",), reach="semicolon", hide="sql", flags=re.M | re.I, containers=()),
    Language("xml", (".xml", ".xul"), (("class", r"<(?P<name>[A-Za-z][\w:.-]*)(?=[^<>]*\bid=)"), ("const", r"\b(?:android:)?(?:id|name)=\"(?:@\+?id/)?(?P<name>[\w.-]+)\"")), (r"\b(?:src|href)=\"(?P<spec>[^\"#]+\.\w+)\"",), reach="line", hide="xml", containers=()),
    Language("angular-html", (".html",), (("component", r"<(?P<name>[a-z]\w*-[\w-]+)"), ("const", r"(?<=[\s<])#(?P<name>[A-Za-z]\w*)"), ("property", r"[\[(](?P<name>[A-Za-z][\w.]*)[\])]=\"")), (r"<script[^>]+src=\"(?P<spec>[^\"]+)\"",), reach="line", hide="xml", containers=()),
)
JS_IMPORTS = re.compile(
    r"(?P<word>\bimport|\bexport)\b(?P<type>\s+type\b)?(?P<clause>[^'\"`;()=]*?)\bfrom\s*(['\"])(?P<a>[^'\"\n]+)\4|\bimport\s*(['\"])(?P<b>[^'\"\n]+)\6|\bimport\s*\(\s*(['\"`])(?P<c>[^'\"`\n$]+)\8\s*\)|\brequire\s*\(\s*(['\"])(?P<d>[^'\"\n]+)\10\s*\)"
)


def hidden(text: str, how: str) -> str:
    """The text with blanks for comments and strings, at the same places."""
    return HIDE[how].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def reach_of(text: str, code: str, start: int, head: int, how: str, openers: re.Pattern | None) -> int:
    """Where a declaration ends that begins at `start` and whose name ends at `head`."""
    line_end = code.find("\n", head)
    line_end = len(code) if line_end < 0 else line_end
    if how == "line":
        return line_end
    if how == "semicolon":
        at = code.find(";", head)
        return len(code) if at < 0 else at + 1
    if how == "dot":
        m = re.compile(r"\.[ \t]*$", re.M).search(code, head)
        return m.end() if m else len(code)
    if how == "brace":
        opened, depth = -1, 0
        for m in re.compile(r"[{}();]").finditer(code, head):
            c = m[0]
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            elif depth <= 0:
                if c == ";":
                    return m.end()
                if c == "{":
                    opened = m.start()
                break
        if opened < 0 or "\n\n" in code[line_end:opened] or code.count("\n", line_end, opened) > 8:
            return line_end
        depth = 0
        for m in re.compile(r"[{}]").finditer(code, opened):
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return m.end()
        return len(code)
    first = code.rfind("\n", 0, start) + 1
    width = len(code[first:start].expandtabs(8)) + len(code[start:head]) - len(code[start:head].lstrip())
    if how == "indent":
        last = line_end
        for m in re.compile(r"[^\n]*\S[^\n]*").finditer(code, line_end + 1):
            if len(m[0].expandtabs(8)) - len(m[0].expandtabs(8).lstrip()) <= width:
                break
            last = m.end()
        return last
    depth = 1  # closed by lines that begin with `end`
    for m in re.compile(r"[^\n]+").finditer(code, line_end + 1):
        line = m[0]
        if re.match(r"\s*end\b|\s*until\b", line, re.I):
            depth -= 1
            if depth == 0:
                return m.end()
        elif openers is not None and openers.search(line) and not re.search(r"\bend\s*[),;]?\s*$", line):
            depth += 1
    return line_end


def comment_above(text: str, start: int) -> str:
    """The comment that ends on the line above `start`, without its marks."""
    out: list[str] = []
    at = text.rfind("\n", 0, start)
    while at > 0:
        first = text.rfind("\n", 0, at) + 1
        line = text[first:at].strip()
        if not re.match(r"//|#|/\*|\*|--|%|;|'''|\"\"\"|<!--|!", line) and not line.endswith("*/"):
            break
        out.append(re.sub(r"^(?://[/!]*|#+!?|/\*+!?|\*+/?|--+|%+|;+|<!--|!+<?)\s?|\s*(?:\*+/|-->)$", "", line).strip())
        if line.startswith("/*"):
            break
        at = first - 1
    return "\n".join(x for x in reversed(out) if x)


@lru_cache(maxsize=256)
def _compiled(lang: Language) -> tuple:
    return tuple((k, re.compile(p, lang.flags)) for k, p in lang.rules), tuple(re.compile(p, lang.flags) for p in lang.imports), re.compile(lang.openers, lang.flags) if lang.openers else None


def js_imports(text: str) -> list[Imported]:
    code = re.sub(r"/\*.*?\*/|(?<![:\"'`\w])//[^\n]*", lambda m: " " * len(m[0]), text, flags=re.S)
    out = []
    for m in JS_IMPORTS.finditer(code):
        spec = m["a"] or m["b"] or m["c"] or m["d"]
        names = []
        for part in re.sub(r"[{}]", ",", m["clause"] or "").split(","):
            words = part.split()
            if words and words[-1] != "type":
                names.append(words[-1])
        form = "re-export" if m["word"] == "export" else "dynamic-import" if m["c"] else "import"
        out.append(Imported(spec, tuple(dict.fromkeys(names)), form, m["type"] is not None))
    return out


def by_rules(lang: Language, text: str) -> Parsed:
    rules, imports, openers = _compiled(lang)
    code = hidden(text, lang.hide)
    found: list[tuple[int, int, int, str, str]] = []
    taken: set[tuple[int, str]] = set()
    look = text if lang.name in ("r", "php") else code  # names that stand in strings there
    for kind, pattern in rules:
        for m in pattern.finditer(look):
            name = m.groupdict().get("name")
            if not name or (m.start("name"), name) in taken:
                continue
            taken.add((m.start("name"), name))
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            how = lang.reach
            if how == "end":
                line = code[m.start() + len(m[0]) - len(m[0].lstrip()) : (code + "\n").find("\n", m.end("name"))]
                how = "end" if openers.search(line) and not re.search(r"\bend\s*$", line) else "line"
            elif kind in ("const", "property", "type", "macro") and how != "dot" and not re.search(r"[{(\[]", code[m.end("name") : (code + "\n").find("\n", m.end("name"))]):
                how = "line"
            found.append((start, reach_of(text, code, start, m.end("name"), how, openers), m.end("name"), kind, name))
    found.sort()
    spans = [(a, b) for a, b, _, k, _ in found if k in lang.containers or k == "struct"]
    symbols = []
    to_byte = byte_places(text)
    for a, b, head, kind, name in found:
        if kind == "function" and any(x < a and b <= y for x, y in spans):
            kind = "method"
        stop = min((p for p in (code.find("{", head, b), code.find("\n", head, b) if lang.reach in ("indent", "end", "line") else -1, b) if p >= 0), default=b)
        symbols.append(Declared(name, kind, to_byte(a), to_byte(b), " ".join(text[a:stop].split()).rstrip(" ;"), comment_above(text, text.rfind("\n", 0, a) + 1)))
    specs = js_imports(text) if lang.hide == "js" else [Imported(m["spec"].strip()) for p in imports for m in p.finditer(text) if m["spec"]]
    return Parsed(symbols, list(dict.fromkeys(specs)))


def byte_places(text: str) -> Callable[[int], int]:
    """From places in the text to places in its UTF-8 bytes."""
    if text.isascii():
        return lambda i: i
    wide = [i for i, c in enumerate(text) if c > "\x7f"]
    total = [0]
    for i in wide:
        total.append(total[-1] + len(text[i].encode("utf-8", "surrogateescape")) - 1)
    return lambda i: i + total[bisect_right(wide, i - 1)]


def python(text: str) -> Parsed:
    """By the syntax tree; a file that does not parse is read by declarations at line starts."""
    try:
        tree = ast.parse(text.encode("utf-8", "replace").decode() if not text.isascii() else text)
    except (SyntaxError, ValueError, RecursionError):
        return by_rules(PYTHON_LINES, text)
    lines = [0]
    for x in text.split("\n"):
        lines.append(lines[-1] + len(x) + 1)
    raw = text.encode("utf-8", "replace")
    starts = [0]
    for x in raw.split(b"\n"):
        starts.append(starts[-1] + len(x) + 1)
    symbols: list[Declared] = []
    imports: list[Imported] = []

    def put(node: ast.AST, name: str, kind: str) -> None:
        a, b = starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset
        body = getattr(node, "body", None)
        stop = starts[body[0].lineno - 1] + body[0].col_offset if isinstance(body, list) and body else b
        head = " ".join(raw[a:stop].decode("utf-8", "replace").split("\n")[0 : max(1, 1 if not isinstance(body, list) else body[0].lineno - node.lineno)]).strip()
        decorators = [ast.unparse(d) for d in getattr(node, "decorator_list", [])]
        doc = ast.get_docstring(node) if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None
        symbols.append(Declared(name, kind, a, b, " ".join(head.rstrip(":").split()), doc or comment_above(text, lines[node.lineno - 1]), {"decorators": decorators} if decorators else None))

    def visit(node: ast.AST, inside: bool, top: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                put(child, child.name, "method" if inside else "function")
                visit(child, False, False)
            elif isinstance(child, ast.ClassDef):
                put(child, child.name, "class")
                visit(child, True, False)
            elif isinstance(child, ast.Import):
                imports.extend(Imported(a.name, (a.asname or a.name,)) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.append(Imported("." * child.level + (child.module or ""), tuple(a.asname or a.name for a in child.names)))
            elif top and isinstance(child, (ast.Assign, ast.AnnAssign)):
                target = child.targets[0] if isinstance(child, ast.Assign) else child.target
                if isinstance(target, ast.Name):
                    put(child, target.id, "const")
            elif isinstance(child, getattr(ast, "TypeAlias", ())):
                put(child, child.name.id, "type")
            else:
                visit(child, inside, False)

    visit(tree, False, True)
    return Parsed(symbols, imports)


def openapi(text: str) -> Parsed:
    """Operations and schemas of an OpenAPI or Swagger document, in JSON or YAML."""
    if not re.search(r"^\s*[\"']?(?:openapi|swagger)[\"']?\s*:", text, re.M):
        return Parsed([], [])
    to_byte = byte_places(text)
    out: list[Declared] = []
    if text.lstrip().startswith("{"):
        try:
            doc = json.loads(text)
        except ValueError:
            return Parsed([], [])
        for path, item in (doc.get("paths") or {}).items():
            for verb, op in item.items() if isinstance(item, dict) else ():
                if verb in ("get", "put", "post", "delete", "patch", "head", "options"):
                    out.append(Declared((op or {}).get("operationId") or f"{verb.upper()} {path}", "route", 0, to_byte(len(text)), f"{verb.upper()} {path}", (op or {}).get("summary") or ""))
        schemas = (doc.get("components") or {}).get("schemas") or doc.get("definitions") or {}
        out += [Declared(n, "type", 0, to_byte(len(text)), f"schema {n}", (s or {}).get("description") or "" if isinstance(s, dict) else "") for n, s in schemas.items()]
        return Parsed(out, [])
    section, path = "", ""
    for m in re.finditer(r"^(?P<pad> *)(?P<key>[^\s#:][^:\n]*|['\"][^'\"]+['\"]):(?P<rest>[^\n]*)$", text, re.M):
        pad, key = len(m["pad"]), m["key"].strip("'\" ")
        if pad == 0:
            section = key
        elif section == "paths" and key.startswith("/"):
            path = key
        elif section == "paths" and path and key in ("get", "put", "post", "delete", "patch", "head", "options"):
            out.append(Declared(f"{key.upper()} {path}", "route", to_byte(m.start("key")), to_byte(m.end()), f"{key.upper()} {path}", ""))
        elif section in ("components", "definitions") and pad == (4 if section == "components" else 2):
            out.append(Declared(key, "type", to_byte(m.start("key")), to_byte(m.end()), f"schema {key}", ""))
    return Parsed(out, [Imported(x) for x in dict.fromkeys(re.findall(r"\$ref['\"]?\s*:\s*['\"](\.{1,2}/[^#'\"]+)", text))])


PYTHON_LINES = Language("python", (".py",), (("class", rf"^[ \t]*class\s+{N}"), ("function", rf"^[ \t]*(?:async\s+)?def\s+{N}"), ("const", rf"^{N}\s*(?::[^=\n]+)?=(?!=)")), (r"^\s*from\s+(?P<spec>[.\w]+)\s+import\b", r"^\s*import\s+(?P<spec>[\w.]+)"), reach="indent", hide="hash")


class Registry:
    """Handlers by extension; of several for one extension the last that was added holds."""

    def __init__(self, languages: tuple[Language, ...] = ()):
        self.by_extension: dict[str, Language] = {}
        for lang in languages:
            self.add(lang)

    def add(self, lang: Language) -> None:
        for e in lang.extensions:
            self.by_extension[e] = lang

    def of(self, path: str) -> Language | None:
        name = path.rsplit("/", 1)[-1].lower()
        return self.by_extension.get("." + name.rsplit(".", 1)[-1]) if "." in name else None

    def parse(self, path: str, text: str) -> Parsed:
        lang = self.of(path)
        if lang is None:
            return Parsed([], [])
        return lang.read(text) if lang.read else by_rules(lang, text)


def standard() -> Registry:
    return Registry((*LANGUAGES, Language("python", (".py",), read=python), Language("openapi", (".yaml", ".yml", ".json"), read=openapi)))
