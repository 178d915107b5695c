"""Six metrics of a piece of source: lines, cyclomatic and cognitive complexity, parameters, returns, nesting.

All but the line count are read off the source without its comments and strings.  `#` and `//` begin a comment in every
language; template literals are kept, as they may hold code.
"""

from __future__ import annotations

import re
from typing import NamedTuple

HIDDEN = re.compile(r"/\*.*?\*/|//[^\n]*|#[^\n]*|\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
#: What adds a path through a function.
BRANCH = re.compile(r"\b(?:if|elif|elsif|for|foreach|while|until|case|when|catch|except|rescue|guard|unless)\b|&&|\|\||\?(?=[^.?:\[])|\band\b|\bor\b")
RETURN = re.compile(r"\b(?:return|yield)\b")
#: Words that open, close or continue a structure.
WORDS = re.compile(r"[{}]|\b(?:else\s+if|elif|elsif|else|finally|goto|if|for|foreach|while|until|switch|match|catch|except|rescue|do)\b|&&|\|\|")


class Metrics(NamedTuple):
    line_count: int
    cyclomatic_complexity: int
    cognitive_complexity: int
    param_count: int
    return_count: int
    nesting_depth: int


def visible(source: str) -> str:
    """The source with blanks for comments and strings; line ends stay."""
    return HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def parameters(code: str) -> int:
    """Parameters of the first bracket of a declaration; self, cls and this are none."""
    start = code.find("(")
    if start < 0:
        return 0
    depth, parts, piece = 0, [], []
    for c in code[start:]:
        if c in "([{<":
            depth += 1
            if depth == 1:
                continue
        elif c in ")]}>":
            depth -= 1
            if depth == 0:
                break
        if c == "," and depth == 1:
            parts.append("".join(piece))
            piece = []
        else:
            piece.append(c)
    parts.append("".join(piece))
    names = [p.strip() for p in parts if p.strip()]
    return sum(re.split(r"[\s:=]", n)[0].lstrip("&*").removeprefix("mut ") not in ("self", "cls", "this", "/", "") for n in names)


def cognitive(code: str, braces: bool) -> tuple[int, int]:
    """(cognitive complexity, nesting depth): a structure costs one and its depth; else, else if and logic cost one."""
    score = depth = deepest = 0
    if braces:
        opened: list[bool] = []  # whether a brace belongs to a structure
        waiting = False
        for m in WORDS.finditer(code):
            t = m[0]
            if t == "{":
                opened.append(waiting)
                depth += waiting
                deepest = max(deepest, depth)
                waiting = False
            elif t == "}":
                if opened:
                    depth -= opened.pop()
            elif t in ("&&", "||", "goto"):
                score += 1
            elif t.startswith("else") or t in ("elif", "elsif", "finally"):
                score += 1
                waiting = True
            else:
                score += 1 + depth
                waiting = True
        return score, deepest
    stack: list[int] = []
    for line in code.split("\n"):
        if not line.strip():
            continue
        width = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
        while stack and width <= stack[-1]:
            stack.pop()
        words = line.split()
        first = words[0].rstrip(":")
        score += len(re.findall(r"\b(?:and|or)\b", line)) + len(re.findall(r"\bif\b", line)) * (first not in ("if", "elif"))
        if first in ("else", "elif", "finally"):
            score += 1
            stack.append(width)
        elif first in ("if", "for", "while", "except", "match", "async", "with", "try") and line.rstrip().endswith(":"):
            if first in ("if", "for", "while", "except", "match"):
                score += 1 + len(stack)
                stack.append(width)
        deepest = max(deepest, len(stack))
    return score, deepest


def measure(source: str) -> Metrics:
    """Metrics of one function, with its declaration."""
    if not source.strip():
        return Metrics(0, 1, 0, 0, 0, 0)
    code = visible(source)
    head = code.split("\n", 1)[0]
    braces = "{" in code and not re.match(r"\s*(?:async\s+)?def\s", code)
    hits = len(BRANCH.findall(code))
    if not braces:
        cog, nest = cognitive(code.split("\n", 1)[1] if "\n" in code else "", False)
    else:
        body = code[code.find("{") :] if not re.search(r"\b(?:if|for|while|switch)\b", head.split("{")[0]) else code
        cog, nest = cognitive(body, True)
    return Metrics(source.rstrip("\n").count("\n") + 1, 1 + hits, cog, parameters(code), len(RETURN.findall(code)), nest)
