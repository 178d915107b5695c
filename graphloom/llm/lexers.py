"""Lexers that label tokens with their place: owners of brackets, roles of colons, owners of indented blocks.

`lex(lang, text)` gives the distinct pairs of adjacent labels (a, b, on_new_line) of a file, and its brackets in
windows, each reduced to what does not cancel inside it.  Labels are those of `grammars`; anything that no token of
the language begins with is labelled BAD, which no grammar permits.
"""

from __future__ import annotations

import re

WINDOW = 256
OPEN, CLOSE = "([{", ")]}"


def reduced(brackets: str) -> str:
    """Brackets without the pairs that cancel."""
    stack: list[str] = []
    for c in brackets:
        if stack and c in CLOSE and stack[-1] == OPEN[CLOSE.index(c)]:
            stack.pop()
        else:
            stack.append(c)
    return "".join(stack)


def windows(brackets: list[str]) -> list[str]:
    text = "".join(brackets)
    return [r for i in range(0, len(text), WINDOW) if (r := reduced(text[i : i + WINDOW]))]


# ---------------------------------------------------------------------------------------------------- JSON

_JSON = re.compile(r'(?P<ws>[ \t\r\n]+)|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<lit>(?:true|false|null)\b)|(?P<p>[\[\]{}:,])|(?P<bad>.)', re.S)
_KEY = re.compile(r"[ \t\r\n]*:")


def lex_json(text: str) -> tuple[set, list[str]]:
    pairs: set = set()
    brackets: list[str] = []
    prev = "BOF"
    if not text.strip():
        return pairs, brackets
    for m in _JSON.finditer(text):
        kind = m.lastgroup
        if kind == "ws":
            continue
        if kind == "p":
            label = m[0]
            if label in "[]{}":
                brackets.append(label)
        elif kind == "str":
            label = "KEY" if _KEY.match(text, m.end()) else "STR"
        else:
            label = {"num": "NUM", "lit": "LIT", "bad": "BAD"}[kind]
        pairs.add((prev, label, False))
        prev = label
    pairs.add((prev, "EOF", False))
    return pairs, brackets


#: patterns that look ahead from a token
_P0 = re.compile(r"\s+(def|for|with)\b")
_TYPE_ALIAS = re.compile(r"[ \t]+[^\W\d]\w*[ \t]*[=\[]")
_P1 = re.compile(r"[(\[{]|[)\]}]|\belse\b|\bfor\b|\bif\b|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_P2 = re.compile(r"[ \t]*(?:function\b|\(|[A-Za-z_$][\w$]*[ \t]*(?:=>|\()|\*|\[)")
_P3 = re.compile(r"\s*const\b")
_ARROW = re.compile(r"\s*(?:=>|:[^;{}]*=>)")
_BRACKET = re.compile(r"[(\[{]|[)\]}]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|/\*.*?\*/|//[^\n]*", re.S)
_GENERIC_ARROW = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*(?:\s+extends\s[^()=;]*?)?(?:\s*=[^()>;]*)?\s*(?:,[^()=;]*)?>\s*\(|<[\w\s.,\[\]|&<>]*>\s*[\w({\[\"'`]")
_P4 = re.compile(r"[ \t]+[A-Za-z_$][\w$]*\s*[=<]|[ \t]+\{|[ \t]+[A-Za-z_$][\w$]*[ \t]*(?:,|from\b|\})")
_P5 = re.compile(r"[ \t]+[A-Za-z_$][\w$]*")
_P6 = re.compile(r"\s*=")
_P7 = re.compile(r"[ \t]+[A-Za-z_$\"'{\[#*]")
_P8 = re.compile(r"\s*[:),;=}]")
_P9 = re.compile(r"\(")
_P10 = re.compile(r"[^\n]*\}\s*\{")
_P12 = re.compile(r"[A-Za-z_$][\w$.]*(?:<[^;(){}=]*>)?")
_P13 = re.compile(r"\s*(\w+|\.\.\.)")
_P14 = re.compile(r"\s+\w")
_P15 = re.compile(r"\s*[A-Za-z_$][\w$.]*(?:<[^;(){}=]*>)?")
_P17 = re.compile(r"<[\w\s,.\[\]&?<>@]*>")
_P18 = re.compile(r"\s*(?:\(|::)")
_P19 = re.compile(r"interface\b")

# -------------------------------------------------------------------------------------------------- Python

_PY_STR = r"""(?:[rRbBuUfFtT]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.|\\\n)*\"|'(?:[^'\\\n]|\\.|\\\n)*')"""
_PY = re.compile(
    r"(?:[ \t\f]+|\\\n)*(?:(?P<com>\#[^\n]*)|(?P<nl>\n)|(?P<str>" + _PY_STR + r")|(?P<num>(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)(?![A-Za-z0-9_]))|(?P<id>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^]=|[-+*/%@&|^~<>=.,:;()\[\]{}])|(?P<bad>.)|(?P<fin>\Z))",
    re.S,
)
_PY_KW = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PY_HEAD = {"def": "D_def", "class": "D_def", "if": "D_if", "elif": "D_if", "else": "D_end", "for": "D_if", "while": "D_if", "with": "D_end", "try": "D_try", "except": "D_except", "finally": "D_end", "match": "D_end", "case": "D_end"}
_PY_SOFT = re.compile(r"(?:match|case)\b[^\n]*:[ \t]*(?:#[^\n]*)?\n")
_PY_SIMPLE = {
    **dict.fromkeys(["==", "!=", "<=", ">=", "<", ">", "//", "%", "|", "&", "^", "<<", ">>"], "BIN"), **dict.fromkeys(["+", "-"], "ADD"), "*": "STAR", "**": "POW", "=": "EQ",
    **dict.fromkeys(["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="], "AUG"), ".": ".", ",": ",", "->": "->", "/": "/", "...": "...", ":=": ":=", "~": "~", ";": ";",
}
#: labels that no target of an assignment holds outside brackets, and labels that end none
_NO_TARGET = frozenset(["BIN", "ADD", "POW", "/", "~", ":=", "not", "and", "or", "is", "in", "lambda", "TIF", "await", "yield"])
_NO_TARGET_END = frozenset(["NUM", "STR", "CONST", ")call", "..."])
_PY_AUG = frozenset(["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="])


class _Elements:
    """What the elements of a bracket have been so far: of a call's arguments, a function's parameters or a display."""

    __slots__ = ("kind", "named", "double", "bare", "pairs", "plain", "default", "star", "now_named", "now_star", "now_pair")

    def __init__(self, kind: str):
        self.kind = kind
        self.named = self.double = self.bare = self.pairs = self.plain = self.default = self.star = False
        self.now_named, self.now_star, self.now_pair = False, "", False

    def end(self, empty: bool) -> bool:
        """An element ends; whether the elements so far may stand in this order."""
        named, star, pair = self.now_named, self.now_star, self.now_pair
        self.now_named, self.now_star, self.now_pair = False, "", False
        if empty:
            return True
        if self.kind == "call":
            if star == "**":
                self.double = True
            elif named:
                self.named = True
            elif self.double or not star and self.named:
                return False
        elif self.kind == "def":
            if star == "*":
                self.star = True
            elif star != "**":
                if self.default and not named and not self.star:
                    return False
                self.default |= named
        elif self.kind == "{":
            self.pairs |= pair
            self.plain |= not pair and star != "**"
            return not (self.pairs and self.plain)
        return True


def lex_python(text: str) -> tuple[set, list[str]]:
    pairs: set = set()
    brackets: list[str] = []
    stack: list[list] = []  # [bracket, saw comprehension for, ternaries, lambdas, elements, call?]
    indents = [(0, 0)]  # columns with tabs of eight, and of one
    owners: list[str] = []  # the owner of each indented block
    prev, head, colon, tern, lam, start, ann = "BOF", "", False, 0, 0, True, False
    pending = ""  # the owner whose block must come next
    last_if = ""
    last = ""  # what ends the element before the current place: CONST and )call are no labels
    target, listed = True, False  # whether what stands since the last = may be a target, and holds a comma
    lambdas: list[tuple[int, _Elements]] = []  # of lambdas whose parameters are being read: depth, elements

    def put(label: str) -> None:
        nonlocal prev, last
        pairs.add((prev, label, False))
        prev = last = label

    def close(owner: str) -> None:
        put(owner)

    for m in _PY.finditer(text):
        kind = m.lastgroup
        tok = m[kind]
        if not start or stack:
            if kind == "id":
                if tok not in _PY_KW:
                    pairs.add((prev, "ID", False))
                    prev = last = "ID"
                    continue
            elif tok in _PY_SIMPLE:
                label = _PY_SIMPLE[tok]
                if lambdas and lambdas[-1][0] == len(stack):
                    e = lambdas[-1][1]
                    if label == ",":
                        if not e.end(False):
                            put("BAD")
                    elif label == "EQ":
                        e.now_named = True
                    elif label in ("STAR", "POW") and prev in ("lambda", ","):
                        e.now_star = tok
                elif stack:
                    e = stack[-1][4]
                    if e is not None:
                        if label == ",":
                            e.bare = e.kind == "def" and prev == "STAR"
                            if not e.end(prev in ("(", "{", ",")):
                                put("BAD")
                        elif label == "EQ":
                            e.now_named = True
                        elif label in ("STAR", "POW") and prev in ("(", "{", ","):
                            e.now_star = tok
                            if e.bare:
                                put("BAD")
                elif label == "EQ" or label == "AUG":
                    if not ann and (not target or last in _NO_TARGET_END or label == "AUG" and listed):
                        put("BAD")
                    target, listed = True, False
                elif label == ",":
                    listed = True
                    if last in _NO_TARGET_END:
                        target = False
                elif label in _NO_TARGET:
                    target = False
                elif label == ";":
                    target, listed, ann = True, False, False
                pairs.add((prev, label, False))
                prev = last = label
                continue
        at = m.start(kind)
        if kind == "com" or kind == "fin":
            continue
        if kind == "nl":
            if stack or start:
                continue
            if tern or lam:
                put("BAD")
            if head and not colon:
                put("BAD")
            if head and prev == "COLON":
                put("NLC")
                pending = _PY_HEAD[head] if head != "else" else ("D_else" if last_if == "D_except" else "D_end")
            else:
                put("NL")
                if head:  # a suite on the header's line
                    put(_PY_HEAD[head] if head != "else" else "D_end")
                pending = ""
            start, head, colon, tern, lam, ann, target, listed = True, "", False, 0, 0, False, True, False
            lambdas.clear()
            continue
        if start and not stack:
            white = text[text.rfind("\n", 0, at) + 1 : at]
            begin = (len(white.expandtabs(8)), len(white)) if "\t" in white else (len(white), len(white))
            wide = begin[0] - indents[-1][0]
            if wide > 0:
                put("INDENT") if pending and begin[1] > indents[-1][1] else put("BAD")
                indents.append(begin)
                owners.append(pending)
            else:
                if pending:
                    put("BAD")
                while begin[0] < indents[-1][0]:
                    indents.pop()
                    last_if = owners.pop()
                    close(last_if)
                if begin != indents[-1]:
                    put("BAD")
            pending = ""
            start = False
            if kind == "id" and (tok in _PY_HEAD and tok not in ("match", "case") or tok in ("match", "case") and _PY_SOFT.match(text, at)):
                head = tok
                put(tok)
                continue
            if kind == "id" and tok == "type" and _TYPE_ALIAS.match(text, m.end()):
                put(tok)
                continue
            if kind == "id" and tok == "async":
                head = ""
                put("async")
                start = False
                nxt = _P0.match(text, m.end())
                if nxt:
                    head = nxt[1]
                continue
        if kind == "id":
            if tok == "if" and not (head == "if" and prev == "if"):
                if stack and stack[-1][1] and not stack[-1][2]:
                    # a comprehension's condition, unless a ternary is open in it
                    nxt = "CIF"
                    depth_if = _tern_ahead(text, m.end())
                    if depth_if:
                        nxt = "TIF"
                        stack[-1][2] += 1
                    put(nxt)
                    continue
                if stack:
                    stack[-1][2] += 1
                else:
                    tern += 1
                    target = False
                put("TIF")
                if head == "case" and not stack:
                    tern -= 1
            elif tok == "else" and prev not in ("D_if", "D_except", "D_try"):
                if stack and stack[-1][2]:
                    stack[-1][2] -= 1
                    put("TEL")
                elif not stack and tern:
                    tern -= 1
                    put("TEL")
                else:
                    put("BAD")
            elif tok == "for" and stack:
                stack[-1][1] = True
                put("CFOR")
            elif tok == "lambda":
                if stack:
                    stack[-1][3] += 1
                else:
                    lam += 1
                    target = False
                put("lambda")
                lambdas.append((len(stack), _Elements("def")))
            elif tok in ("None", "True", "False"):
                put("ID")
                last = "CONST"
            elif tok in _PY_KW:
                if not stack:
                    if tok == "in" and head == "for" and not colon:
                        if not target or last in _NO_TARGET_END:
                            put("BAD")
                    elif tok in _NO_TARGET:
                        target = False
                put(tok)
            else:
                put("ID")
        elif kind == "str":
            put("STR")
        elif kind == "num":
            put("NUM")
        elif kind == "bad":
            put("BAD")
        elif tok in OPEN:
            called = tok == "(" and prev in ("ID", ")", "]", "STR")
            params = called and head == "def" and not stack and not colon
            put(tok)
            stack.append([tok, False, 0, 0, _Elements("def" if params else "call" if called else "{") if called or tok == "{" else None, called])
            brackets.append(tok)
        elif tok in CLOSE:
            brackets.append(tok)
            called = False
            if stack:
                while lambdas and lambdas[-1][0] == len(stack):
                    lambdas.pop()
                frame = stack.pop()
                e = frame[4]
                if frame[2] or frame[3] or frame[0] != OPEN[CLOSE.index(tok)]:
                    put("BAD")
                elif e is not None:
                    if e.kind == "def" and prev == "STAR" or not frame[1] and not e.end(prev in ("(", "{", ",")):
                        put("BAD")
                called = frame[5]
            put(tok)
            if called:
                last = ")call"
        elif tok == ":":
            if lambdas and lambdas[-1][0] == len(stack):
                if not lambdas.pop()[1].end(prev == "lambda"):
                    put("BAD")
            if stack:
                top = stack[-1]
                if top[3]:
                    top[3] -= 1
                    put("ANN")
                elif top[0] == "[":
                    put("SLICE")
                elif top[0] == "{":
                    top[4].now_pair = True
                    put("KCOLON")
                else:
                    put("ANN")
            elif lam:
                lam -= 1
                put("ANN")
            elif head and not colon:
                colon = True
                target, listed = True, False
                put("COLON")
            elif not ann and (not head or colon):
                ann = True
                put("ANN")
            else:
                put("BAD")
        elif tok == "@":
            put("@" if at == 0 or text[text.rfind("\n", 0, at) + 1 : at].strip() == "" else "BIN")
            if not stack and prev == "BIN":
                target = False
        elif tok in _PY_SIMPLE:
            put(_PY_SIMPLE[tok])
        else:
            put("BIN")
    if prev != "BOF":
        if not start:
            if tern or lam or (head and not colon):
                put("BAD")
            if head and prev == "COLON":
                put("BAD")
            put("NL")
            if head:
                put(_PY_HEAD[head] if head != "else" else "D_end")
        elif pending:
            put("BAD")
        while len(indents) > 1:
            indents.pop()
            close(owners.pop())
        if stack:
            put("BAD")
        put("EOF")
    return pairs, brackets


def _tern_ahead(text: str, at: int) -> bool:
    """Whether an else follows before the bracket closes: then the if is a conditional expression."""
    depth = 0
    for m in _P1.finditer(text, at):
        t = m[0]
        if t in OPEN:
            depth += 1
        elif t in CLOSE:
            if not depth:
                return False
            depth -= 1
        elif not depth and t == "else":
            return True
        elif not depth and t in ("for", "if"):
            return False
    return False


# ------------------------------------------------------------------------------------------- C-like languages

_DOTTED = re.compile(r"[\w$]+(?:\.[\w$]+)*")
_COMMENT = r"(?P<com>//[^\n]*|/\*.*?\*/)"
_STRING = r"(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
_NUMBER = r"(?P<num>(?:0[xX][0-9a-fA-F_]+[nlL]?|0[bB][01_]+[nlL]?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[nlLfFdDi]?)(?![A-Za-z0-9_$]))"
_JS = re.compile(
    r"[ \t\f\v\u00a0\ufeff]*(?:(?P<nl>\n)|" + _COMMENT + "|" + _STRING + r"|(?P<tpl>`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`)|" + _NUMBER
    + r"|(?P<id>[#]?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\*\*|<<|>>|[-+*/%&|^]=|[-+*/%&|^!~<>=?:.,;()\[\]{}@])|(?P<bad>.)|(?P<fin>\Z))",
    re.S,
)
_RE = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_JS_KW = frozenset("break case catch class const continue debugger default do else export extends finally for function if import in instanceof new return switch throw try var while let static yield await async of get set as from".split())
_JS_HARD = frozenset("break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return switch throw try typeof var void while with".split())
_TS_SOFT = frozenset("public private protected readonly abstract declare override interface namespace module implements enum keyof infer unique is asserts satisfies".split())
_WORDS = _JS_KW | _JS_HARD | _TS_SOFT | {"typeof", "void", "delete", "type"}
#: operators whose label needs no look at their place
_JS_SIMPLE = {
    **dict.fromkeys(["===", "!==", "==", "!=", "<=", ">=", "&&", "||", "??", "**", "%", "^", "<<"], "BIN"), **dict.fromkeys(["+", "-"], "ADD"), **dict.fromkeys(["++", "--"], "INC"),
    **dict.fromkeys(["+=", "-=", "*=", "%=", "&=", "|=", "^=", "**=", "<<=", ">>=", ">>>=", "&&=", "||=", "??="], "AUG"), "*": "STAR", "!": "NOT", "~": "PRE", ".": ".", "?.": "?.", "...": "...", "=>": "=>", "@": "@",
}
_END_OPERAND = frozenset(["ID", "NUM", "STR", "TPL", "RE", ")g", "]", "}o", "}fx", "}c", "INC"])
_TYPE_ARGS = re.compile(r"<[\w\s,.\[\]|&<>\"'{}:;?]*?>(?=\s*[({=,)\];>|\[]|\s*$|\s+(?:extends|implements)\b)")
_MEMBER = re.compile(r"\s*[:(,}?=;<!]")


def _arrow_ahead(text: str, at: int) -> bool:
    """Whether the bracket that opens at `at` is closed and an arrow follows: then it holds parameters."""
    depth = 0
    for m in _BRACKET.finditer(text, at):
        if m[0] in OPEN:
            depth += 1
        elif m[0] in CLOSE:
            depth -= 1
            if depth == 0:
                return _ARROW.match(text, m.end()) is not None
    return False


#: what a statement may begin after
_STATEMENT = frozenset([";", "{b", "}b", "}try", "BOF", "C:", ")h", "else", "do", "}c", "}t"])


def lex_ecma(text: str, typed: bool) -> tuple[set, list[str]]:
    pairs: set = set()
    brackets: list[str] = []
    # frame: [label, ternaries, in case, key pending, type mode, owner]
    stack: list[list] = [["{b", 0, False, False, False, ""]]
    prev, line = "BOF", False
    pos, n = 0, len(text)
    fn_header = ""  # pending function body: decl, expr, method
    klass = ""  # pending class or type body
    mod_list = False
    owner_paren = ""
    before_id, before_async = "BOF", "BOF"  # what stands before the last name, and the last async; "" after a line end
    constant, valued = 0, False  # depth of a declaration of constants, and whether its last name has a value
    alias = 0  # depth of a type alias whose = is to come
    if text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else n
    match = _JS.match

    def put(label: str) -> None:
        nonlocal prev, line
        pairs.add((prev, label, line))
        prev, line = label, False

    while pos < n:
        m = match(text, pos)
        kind = m.lastgroup
        tok = m[kind]
        if kind == "id":
            if tok not in _WORDS and prev != "@":
                pairs.add((prev, "ID", line))
                if prev == "declare" and tok == "global":
                    klass = "{b"
                before_id = "" if line else prev
                prev, line, pos = "ID", False, m.end()
                continue
        elif tok in _JS_SIMPLE:
            label = _JS_SIMPLE[tok]
            pairs.add((prev, label, line))
            prev, line, pos = label, False, m.end()
            continue
        elif kind == "nl":
            line, pos = True, m.end()
            top = stack[-1]
            if top[4] and top[0] in ("{c", "{t") and prev not in ("A:", "PIPE", ","):
                top[4] = False
            continue
        at = m.start(kind)
        if tok == "/" or tok == "/=":
            if prev not in _END_OPERAND:
                r = _RE.match(text, at)
                if r:
                    put("RE")
                    pos = r.end()
                    continue
        pos = m.end()
        if kind == "fin":
            break
        if kind == "com":
            if "\n" in tok:
                line = True
            continue
        top = stack[-1]
        at_start = kind == "id" and tok in _WORDS and (prev in (";", "{b", "}b", "}try", "BOF", "C:", ")h", "else", "do") or line and prev in _END_OPERAND and top[0] == "{b")
        if kind == "id" and prev == "@":
            pos = _DOTTED.match(text, at).end()
            put("ANAME")
            continue
        if kind == "id":
            member = prev in (".", "?.")
            key_place = top[0] in ("{o", "{c", "{t", "{m") and (prev in ("{o", "{c", "{t", "{m", ",", ";", "}b", "static", "ASYNC", "get", "set", "STAR", "public", "private", "protected", "readonly") or line) and not (top[0] == "{o" and prev == "K:")
            if member or key_place and _MEMBER.match(text, pos) and not (top[0] == "{m" and tok == "as"):
                put("ID")
                continue
            if top[4] and typed:
                if tok in ("keyof", "infer", "readonly", "unique", "is", "asserts", "extends") and prev not in ("A:",) or tok == "extends" or tok in ("asserts", "keyof", "unique", "readonly") and _P14.match(text, pos):
                    put(tok)
                elif tok in ("typeof",):
                    put("PRE")
                elif tok in ("as", "satisfies"):
                    put(tok)
                elif tok in ("new",):
                    put("new")
                elif tok in ("const", "let", "var", "function", "class", "export", "import", "return", "if", "for", "interface") and line:
                    top[4] = False
                    pos = at
                    continue
                else:
                    put("ID")
                continue
            if tok in ("typeof", "void", "delete"):
                put("PRE")
            elif tok == "of":
                if constant == len(stack) and not valued and prev in ("ID", "}o", "]"):
                    constant = 0
                put("of" if top[0] == "(h" and prev in ("ID", "}o", "]") else "ID")
            elif tok == "async":
                nx = _P2.match(text, pos)
                opening = nx is not None and nx[0].endswith("(") and nx[0].strip() == "("
                before_async = "" if line else prev
                put("ASYNC" if nx and not (opening and top[0] not in ("{c", "{o") and not _arrow_ahead(text, nx.end() - 1)) else "ID")
            elif tok in ("get", "set", "static"):
                put(tok if top[0] in ("{c", "{o") and key_place else "ID")
            elif tok in ("as", "from"):
                ok = top[0] == "{m" or mod_list or prev in ("STAR", "}m") or typed and prev in _END_OPERAND | {"NOT"} and not line
                if ok and typed and tok == "as" and top[0] != "{m" and not mod_list and prev != "STAR":
                    put("as")
                    if text[pos : pos + 7].strip().startswith("const"):
                        put("ID")
                        pos = _P3.match(text, pos).end()
                    else:
                        top[4] = True
                else:
                    put(tok if ok else "ID")
                    if tok == "from":
                        mod_list = False
            elif tok in ("let", "yield", "await"):
                if tok == "let":
                    put("let" if at_start or prev in ("(h", "export", "for") else "ID")
                else:
                    put(tok)
            elif tok == "type" and typed:
                nx = _P4.match(text, pos)
                if nx and (at_start or prev in ("export", "import", "declare", "{m", ",")):
                    put("TYPEKW")
                    if "=" in nx[0] or "<" in nx[0]:
                        stack[-1][4] = False
                        alias = len(stack)
                        # the alias's right side is a type
                        eq = _P5.match(text, pos)
                        put("ID")
                        pos = eq.end()
                        g = _TYPE_ARGS.match(text, pos)
                        if g is None:
                            eq2 = _P6.match(text, pos)
                            if eq2:
                                put("EQ")
                                pos = eq2.end()
                                alias = 0
                        stack[-1][4] = True
                else:
                    put("ID")
            elif typed and tok in _TS_SOFT:
                nx = _P7.match(text, pos)
                place = at_start or prev == "ADD" and top[0] == "{t" or prev in ("export", "default", "declare", "abstract", "{c", "(f", ",", "public", "private", "protected", "static", "readonly", "const", "}b", ";", ")g", "@", "override") or line
                if tok in ("implements", "satisfies"):
                    put(tok)
                    if tok == "satisfies":
                        top[4] = True
                elif nx and place:
                    put(tok)
                    if tok in ("interface", "enum"):
                        klass = "{t"
                    elif tok in ("namespace", "module"):
                        klass = "{b"
                else:
                    put("ID")
            elif tok in _JS_HARD:
                if tok == "with":
                    tok = "while"
                if tok == "enum":
                    put("BAD")
                    continue
                if tok == "in" and typed and top[0] == "[" and stack[-2][0] == "{t":
                    put(tok)
                    top[4] = True
                    continue
                ahead = before_async if prev == "ASYNC" else "" if line and prev in _END_OPERAND else prev
                if tok == "const" and not typed and prev != "ID":
                    constant, valued = len(stack), False
                elif tok == "in" and constant == len(stack) and not valued:
                    constant = 0
                put(tok)
                if tok == "function":
                    fn_header = "decl" if ahead in _STATEMENT or ahead in ("", "export", "default", "declare") else "expr"
                elif tok == "class":
                    klass = "{c"
                elif tok in ("if", "while", "for", "switch", "catch"):
                    owner_paren = tok
                elif tok in ("import", "export"):
                    mod_list = tok == "import"
                elif tok == "case":
                    top[2] = True
            else:
                put("ID")
            continue
        if kind == "str":
            put("STR")
            continue
        if kind == "num":
            put("NUM")
            continue
        if kind == "tpl":
            put("TPL")
            continue
        if kind == "bad":
            put("BAD")
            continue
        if tok == "(":
            brackets.append(tok)
            if owner_paren and prev in ("if", "while", "for", "switch", "catch", "await"):
                label, owner = "(h", owner_paren
                owner_paren = ""
            elif fn_header in ("decl", "expr") and prev in ("function", "ID", "STAR", "T>"):
                label, owner = "(f", fn_header
            elif (top[0] == "{c" and not top[4] and prev in ("ID", "STR", "NUM", "]", "T>", "O?") and not top[3]) or (top[0] == "{t" and not top[4] and prev in ("ID", "STR", "O?", "T>", "{t", ";", ",")) or (top[0] == "{o" and top[3] and prev in ("ID", "STR", "NUM", "]", "T>")):
                label, owner = "(f", "method" if top[0] != "{t" else "sig"
            else:
                label, owner = "(g", ""
            put(label)
            stack.append([label, 0, False, False, False, owner])
            if owner == "":
                stack[-1][4] = top[4]
            continue
        if tok == "[":
            brackets.append(tok)
            put("[")
            stack.append(["[", 0, False, False, top[4], ""])
            continue
        if tok == "{":
            brackets.append(tok)
            owner = ""
            if top[4] and prev in ("A:", "PIPE", "EQ", "T<", ",", "(g", "=>", "as", "[", "keyof", "satisfies", "extends"):
                label = "{t"
            elif klass and prev in ("ID", "class", "T>", "}o", ")g", "STR", "]"):
                label, klass = klass, ""
            elif fn_header and (prev == ")f" or prev in ("ID", "T>", "]", "}t", "STR") and top[4]):
                label, owner = "{b", {"decl": "b", "expr": "fx", "method": "b"}[fn_header]
                fn_header = ""
                top[4] = False
            elif prev == ")f":
                label, owner = "{b", "b" if top[0] == "{c" else ("b" if top[0] == "{o" else "fx")
            elif top[0] == "{c" and not top[3] and prev in ("ID", "T>", "]", "}t", "STR") and top[4]:
                label, owner = "{b", "b"
                top[4] = False
            elif prev in ("import", "export", "TYPEKW") or mod_list and prev == ",":
                label = "{m"
            elif prev == "=>":
                label, owner = "{b", "fx"
                top[4] = False
            elif prev in (")h", "else", "do", "finally", "catch", "try", "static"):
                label, owner = "{b", "try" if prev == "try" else "b"
            elif prev in (";", "{b", "}b", "}try", "BOF", "C:") or line and prev in _END_OPERAND and top[0] == "{b":
                label, owner = "{b", "b"
            else:
                label = "{o"
            if label == "{b" and not owner:
                owner = "b"
            put(label)
            stack.append([label, 0, False, label == "{o", False, owner])
            continue
        if tok in ")]}":
            brackets.append(tok)
            if top[1] > 0:
                put("BAD")
            if len(stack) == 1:
                put("BAD")
                put({")": ")g", "]": "]", "}": "}b"}[tok])
                continue
            frame = stack.pop()
            if frame[0][0] != OPEN[CLOSE.index(tok)]:
                put("BAD")
            if tok == "]":
                put("]")
            elif tok == ")":
                put(")" + frame[0][1:] if frame[0][0] == "(" else ")g")
                if frame[0] == "(f" and frame[5] in ("decl", "expr", "method"):
                    fn_header = frame[5]
            else:
                if frame[0] == "{b":
                    put("}" + {"b": "b", "fx": "fx", "try": "try"}[frame[5]])
                else:
                    put("}" + frame[0][1:] if frame[0][0] == "{" else "}b")
            continue
        if tok == ";":
            if constant == len(stack):
                if not valued:
                    put("BAD")
                constant = 0
            if top[1] > 0:
                put("BAD")
                top[1] = 0
            put(";")
            top[2] = top[4] = False
            top[3] = False
            if fn_header == "method":
                fn_header = ""
            continue
        if tok == ",":
            if constant == len(stack):
                if not valued:
                    put("BAD")
                valued = False
            put(",")
            if top[0] == "{o":
                top[3] = True
            if top[0] in ("(f", "(g", "{t", "[", "{b") and stack[-1][5] != "<":
                if not (top[0] == "{b" and top[4]):
                    top[4] = top[0] == "[" and top[4] or (top[0] == "(g" and False)
            continue
        if tok == "?":
            if typed and _P8.match(text, pos) or typed and top[0] in ("{c", "{t") and _P9.match(text, pos):
                put("O?")
            else:
                top[1] += 1
                put("T?")
            continue
        if tok == ":":
            if top[1] > 0 and not top[4] or top[1] > 0:
                top[1] -= 1
                put("T:")
            elif top[2]:
                top[2] = False
                put("C:")
            elif top[0] == "{o" and top[3]:
                top[3] = False
                put("K:")
            elif prev == "default" or top[0] == "{b" and prev == "ID" and (before_id == "" or before_id in _STATEMENT) and not fn_header:
                put("C:")
            else:
                put("A:")
                top[4] = True
            continue
        if tok == "=":
            put("EQ")
            if constant == len(stack):
                valued = True
            top[4] = alias == len(stack)
            if top[4]:
                alias = 0
            if top[0] == "{c":
                top[3] = True
            continue
        if tok == "<" and typed and (top[4] or prev in ("ID", "function") and text[at - 1 : at].strip() and _TYPE_ARGS.match(text, at) or prev not in _END_OPERAND and prev != "super" and _GENERIC_ARROW.match(text, at)):
            put("T<")
            stack.append(["<", 0, False, False, True, "<"])
            continue
        if tok in (">", ">>", ">>>") and typed and stack[-1][5] == "<":
            for _ in tok:
                if stack[-1][5] == "<":
                    stack.pop()
                    put("T>")
                else:
                    put("BIN")
            continue
        if tok == "=>":
            put("=>")
            continue
        if tok in ("+", "-"):
            put("ADD")
        elif tok == "*":
            put("STAR")
        elif tok in ("++", "--"):
            put("INC")
        elif tok == "!":
            put("NOT")
        elif tok == "~":
            put("PRE")
        elif tok in ("|", "&") and top[4]:
            put("PIPE")
        elif tok in (".", "?.", "...", "@"):
            put(tok)
        elif tok.endswith("=") and tok not in ("==", "===", "!=", "!==", "<=", ">="):
            put("AUG")
        else:
            put("BIN")
    if stack[-1][1] > 0:
        put("BAD")
    put("EOF")
    return pairs, brackets


_GO = re.compile(
    r"[ \t\r]*(?:(?P<nl>\n)|" + _COMMENT + r"|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{1,10}?)')|" + _NUMBER.replace("$", "")
    + r"|(?P<id>[^\W\d]\w*)|(?P<op>&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|<<|>>|&\^|[-+*/%&|^]=|[-+*/%&|^!<>=.,;:()\[\]{}~])|(?P<bad>.)|(?P<fin>\Z))",
    re.S,
)
_GO_KW = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO_SIMPLE = {
    **dict.fromkeys(["==", "!=", "<=", ">=", "<", ">", "&&", "||", "/", "%", "|", "<<", ">>", "&^"], "BIN"), **dict.fromkeys(["+", "-", "&", "^"], "ADD"), **dict.fromkeys(["++", "--"], "INC"),
    **dict.fromkeys(["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="], "AUG"), "*": "MUL", "!": "NOT", "<-": "ARROW", ".": ".", ",": ",", ":": ":", "...": "...", "=": "EQ", ":=": "DEF", ";": ";",
}
#: where a name may stand before its type
_GO_NAMES, _GO_DECL = frozenset(["(f", "(d", "{s", "["]), frozenset(["var", "const", "type"])
_GO_TYPED = re.compile(r"[ \t]+(?:[A-Za-z_*\[]|\.\.\.|<-)")
_GO_SEMI = frozenset(["ID", "NUM", "STR", "INC", ")g", ")f", ")d", "]", "}b", "}o", "}s", "break", "continue", "return", "fallthrough"])


def lex_go(text: str) -> tuple[set, list[str]]:
    pairs: set = set()
    brackets: list[str] = []
    stack: list[list] = [["", ""]]  # [label, owner]
    prev = "BOF"
    header = ""  # pending: func, control
    header_depth = 0
    decl = ""
    top_level = True

    def put(label: str) -> None:
        nonlocal prev
        pairs.add((prev, label, False))
        prev = label

    def semi() -> None:
        nonlocal header
        if prev in _GO_SEMI:
            put(";")
            if header == "func":
                header = ""

    for m in _GO.finditer(text):
        kind = m.lastgroup
        tok = m[kind]
        if len(stack) > 1:
            if kind == "id":
                if tok not in _GO_KW and stack[-1][0] not in _GO_NAMES and prev not in _GO_DECL:
                    pairs.add((prev, "ID", False))
                    prev = "ID"
                    continue
            elif tok in _GO_SIMPLE:
                label = _GO_SIMPLE[tok]
                pairs.add((prev, label, False))
                prev = label
                continue
        at = m.start(kind)
        if kind == "fin":
            continue
        if kind == "nl" or kind == "com" and ("\n" in tok):
            semi()
            continue
        if kind == "com":
            continue
        if len(stack) == 1 and prev in (";", "BOF") and not (kind == "id" and tok in ("package", "import", "func", "var", "const", "type")):
            if kind != "op" or tok != ";":
                put("BAD")
        if kind == "id":
            if tok in _GO_KW and prev != ".":
                if tok == "func":
                    header = "func" if header != "control" else header
                    fn = True
                elif tok in ("if", "for", "switch", "select"):
                    header, header_depth = "control", len(stack)
                elif tok in ("import", "var", "const", "type"):
                    decl = tok
                put(tok)
                if tok == "func" and header == "control":
                    stack[-1][1] = "func-in-control"
            else:
                typed = (stack[-1][0] in _GO_NAMES or prev in _GO_DECL or prev == "," and decl in _GO_DECL) and prev not in (".", "MUL", "]", "map", "chan")
                put("NAME" if typed and _GO_TYPED.match(text, m.end()) else "ID")
        elif kind == "str":
            put("STR")
        elif kind == "num":
            put("NUM")
        elif kind == "bad":
            put("BAD")
        elif tok == "(":
            brackets.append(tok)
            if prev in ("import", "var", "const", "type"):
                label = "(d"
            elif prev == "func" or header == "func" and prev in ("ID", ")f", "]") and len(stack) == 1 or header == "func" and prev == ")f" or stack[-1][0] == "{s" and prev in ("ID", ")f"):
                label = "(f"
            else:
                label = "(g"
            put(label)
            stack.append([label, ""])
        elif tok == "[":
            brackets.append(tok)
            put("[")
            stack.append(["[", ""])
        elif tok == "{":
            brackets.append(tok)
            if prev in ("struct", "interface"):
                label = "{s"
            elif prev == "else":
                label = "{b"
            elif header == "control" and len(stack) == header_depth:
                literal = prev == "]" or False
                label = "{o" if literal and _P10.match(text, m.end()) else "{b"
                if label == "{b":
                    header = ""
            elif header == "func" and prev in (")f", "ID", "]", ")g", "}s", "MUL"):
                label, header = "{b", ""
            elif prev in ("ID", "]", "}s"):
                label = "{o"
            elif stack[-1][0] == "{o" and prev in ("{o", ",", ":"):
                label = "{o"
            elif prev in (";", "{b", "}b", ":", "BOF"):
                label = "{b"
            else:
                label = "{b" if prev == ")f" else "{o" if prev in (",", ":", "{o") else "{b"
            put(label)
            stack.append([label, ""])
        elif tok in ")]}":
            brackets.append(tok)
            if len(stack) == 1:
                put("BAD")
                continue
            frame = stack.pop()
            if frame[0][0] != OPEN[CLOSE.index(tok)]:
                put("BAD")
            put("]" if tok == "]" else tok + frame[0][1:])
        elif tok == ";":
            put(";")
        elif tok == ":=":
            put("DEF")
        elif tok == "=":
            put("EQ")
        elif tok in ("++", "--"):
            put("INC")
        elif tok in ("+", "-", "&", "^"):
            put("ADD")
        elif tok == "*":
            put("MUL")
        elif tok == "<-":
            put("ARROW")
        elif tok == "!":
            put("NOT")
        elif tok in (".", ",", ":", "..."):
            put(tok)
        elif tok == "~":
            put("BIN1")
        elif tok.endswith("=") and tok not in ("==", "!=", "<=", ">="):
            put("AUG")
        else:
            put("BIN")
    semi()
    if prev != "BOF":
        put("EOF")
    return pairs, brackets


_JAVA = re.compile(
    r"[ \t\f\r\n]*(?:" + _COMMENT + r"|(?P<txt>\"\"\"[ \t]*\n.*?(?<!\\)\"\"\")|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\u[0-9a-fA-F]{4}|\\.[0-7]{0,2})')|" + _NUMBER
    + r"|(?P<id>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<op>>>>=|\.\.\.|<<=|>>=|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|<<|[-+*/%&|^]=|[-+*/%&|^!~<>=?:.,;()\[\]{}@])|(?P<bad>.)|(?P<fin>\Z))",
    re.S,
)
_JAVA_SIMPLE = {
    **dict.fromkeys(["==", "!=", "<=", ">=", ">", "&&", "||", "/", "%", "|", "&", "^", "<<"], "BIN"), **dict.fromkeys(["+", "-"], "ADD"), **dict.fromkeys(["++", "--"], "INC"),
    **dict.fromkeys(["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="], "AUG"), "*": "STAR", "!": "PRE", "~": "PRE", ".": ".", ",": ",", "...": "...", "->": "->", "::": "::",
}
_JAVA_KW = frozenset("abstract assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try volatile while".split())
_JAVA_SOFT = frozenset(["record", "sealed", "yield", "permits", "when", "non"])
_RECORD_PATTERN = re.compile(r"[A-Za-z_$][\w$.]*(?:<[^;(){}=]*>)?\s*\((?=\s*(?:\)|(?:final\s+)?[A-Za-z_$][\w$.]*(?:<[^;(){}=]*>)?(?:\[\s*\])*\s*(?:\s[A-Za-z_$]|\()))")
_JAVA_TYPE = re.compile(r"(?:[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)(?:\.[A-Za-z_$][\w$]*)*(?:<[^;(){}=+\-\"]*?>+)?(?:\s*\[\s*\])*(?=\s+[A-Za-z_$\u0080-￿]|\s*\.\.\.)")
_JAVA_NOTYPE = frozenset("return throw new else case package import assert break continue do instanceof yield goto extends implements throws public private protected static final abstract native synchronized transient volatile class interface enum default if for while switch try catch finally this super".split())
_JAVA_LAMBDA_TYPE = re.compile(r"[^()]*\)\s*->")


def lex_java(text: str) -> tuple[set, list[str]]:
    pairs: set = set()
    brackets: list[str] = []
    stack: list[list] = [["{top", 0, False, ""]]  # [label, ternaries, in case, owner]
    prev = "BOF"
    pos, n = 0, len(text)
    klass, owner_paren, record, last_h = "", "", False, ""
    created = pattern = False  # a created type's arguments, a record pattern's components are to come
    closed_new = False  # the last bracket closed held the arguments of a created type
    asserting = False

    def put(label: str) -> None:
        nonlocal prev
        pairs.add((prev, label, False))
        prev = label

    starts = {";", "{b", "}b", "}try", "}catch", "{c", "}c", "}e", "BOF", "C:", "(f", "(h", ")h", "final", "public", "private", "protected", "static", "abstract", "native", "synchronized", "transient", "volatile", "else", "do", "default", "sealed", "T>", "->"}
    while pos < n:
        m = _JAVA.match(text, pos)
        kind = m.lastgroup
        tok = m[kind]
        pos = m.end()
        if tok in _JAVA_SIMPLE:
            label = _JAVA_SIMPLE[tok]
            pairs.add((prev, label, False))
            prev = label
            continue
        at = m.start(kind)
        if kind == "com":
            continue
        if kind == "fin":
            break
        top = stack[-1]
        if kind == "id":
            if prev == "@":
                pos = _DOTTED.match(text, at).end()
                put("ANAME")
                continue
            if prev == ".":
                put(tok if tok in ("class", "this", "new") else "ID")
                continue
            caught = top[0] == "(h" and top[3] == "catch"
            if (prev == "ID" or prev == "BIN" or prev == "EQ") and not caught:
                if tok not in _JAVA_KW and tok not in _JAVA_SOFT:
                    put("ID")
                    continue
            type_place = prev in starts or caught and prev == "BIN" or prev in ("instanceof", "case") or prev == "," and (top[0] == "(f" or top[2]) or prev in ("extends", "implements", "throws") or prev == "," and klass or prev == ")g" and stack[-1][3] == "anno" or prev == "(g" and _JAVA_LAMBDA_TYPE.match(text, at) or prev in ("(k", ",") and top[3] == "pattern"
            if tok == "permits" and klass and prev in ("ID", "TYPE", "T>"):
                put(tok)
                continue
            if tok == "non" and text.startswith("-sealed", pos):
                put("sealed")
                pos += 7
                continue
            if tok == "when" and top[2] and prev in ("ID", ")k"):
                put(tok)
                continue
            if (prev in ("instanceof", "case") or prev in ("(k", ",") and top[3] == "pattern") and (t := _RECORD_PATTERN.match(text, at)):
                put("ID")
                pos, pattern = t.end() - 1, True
                continue
            if prev in ("extends", "implements", "throws", "permits") or prev == "," and klass and top[0] in ("{top", "{c"):
                t = _P12.match(text, at)
                put("TYPE")
                pos = t.end()
                continue
            if type_place and tok not in _JAVA_NOTYPE and top[0] != "{top":
                t = _JAVA_TYPE.match(text, at)
                if t:
                    nxt = _P13.match(text, t.end())
                    if nxt and nxt[1] not in ("instanceof",):
                        put("TYPE")
                        pos = t.end()
                        continue
            if tok in ("record", "sealed", "yield") and _P14.match(text, pos) and (prev in starts):
                put(tok)
                if tok == "record":
                    klass, record = "{c", True
                continue
            if tok in _JAVA_KW:
                if tok in ("this", "super"):
                    put("ID" if tok == "super" else "this")
                    continue
                put(tok)
                if tok in ("class", "interface"):
                    klass = "{c"
                elif tok == "enum":
                    klass = "{e"
                elif tok in ("if", "while", "for", "switch", "catch", "synchronized", "try"):
                    owner_paren = tok
                elif tok == "case":
                    top[2] = True
                elif tok == "new":
                    t = _P15.match(text, pos)
                    if t:
                        put("ID")
                        pos = t.end()
                        created = True
                elif tok == "assert":
                    asserting = True
            else:
                put("ID")
            continue
        if kind in ("str", "txt"):
            put("STR")
        elif kind == "num":
            put("NUM")
        elif kind == "bad":
            put("BAD")
        elif tok == "(":
            brackets.append(tok)
            if owner_paren and prev in ("if", "while", "for", "switch", "catch", "synchronized", "try"):
                label = "(h"
            elif record and prev == "ID":
                label, record = "(f", False
            elif top[0] in ("{c", "{e") and prev == "ID" and top[3] != "init" and not (top[0] == "{e" and top[3] != "members"):
                label = "(f"
            else:
                label = "(k" if prev in ("ID", "this") else "(g"
            owner = owner_paren if label == "(h" else "new" if created and prev == "ID" else "pattern" if pattern else ""
            created = pattern = False
            put(label)
            stack.append([label, 0, False, owner])
            if label == "(h":
                owner_paren = ""
        elif tok == "[":
            brackets.append(tok)
            put("[")
            stack.append(["[", 0, False, ""])
        elif tok == "{":
            brackets.append(tok)
            owner = ""
            if klass and prev in ("ID", "TYPE", ")f", "T>"):
                label, klass = klass, ""
            elif prev in ("EQ", "]", "{o") or prev == "," and top[0] == "{o":
                label = "{o"
            elif prev == ")k" and closed_new:
                label = "{c"
            else:
                label = "{b"
                owner = {"try": "try", "catch": "catch"}.get(prev, "")
                if prev == ")h" and stack and last_h == "catch":
                    owner = "catch"
            put(label)
            stack.append([label, 0, False, owner])
        elif tok in ")]}":
            brackets.append(tok)
            if top[1] > 0:
                put("BAD")
            if len(stack) == 1:
                put("BAD")
                continue
            frame = stack.pop()
            if frame[0][0] != OPEN[CLOSE.index(tok)]:
                put("BAD")
            if frame[0] == "(h":
                last_h = frame[3]
            closed_new = frame[3] == "new"
            if tok == "]":
                put("]")
            else:
                label = tok + frame[0][1:]
                if frame[0] == "{b" and frame[3] in ("try", "catch"):
                    label = "}" + frame[3]
                put(label)
        elif tok == ";":
            if top[1] > 0:
                put("BAD")
                top[1] = 0
            top[2] = asserting = False
            if top[0] in ("{c", "{e"):
                top[3] = "members"
            put(";")
        elif tok == "?":
            top[1] += 1
            put("T?")
        elif tok == ":":
            if top[1] > 0:
                top[1] -= 1
                put("T:")
            elif asserting:
                put("AC")
            else:
                top[2] = False
                put("C:")
        elif tok == "=":
            put("EQ")
            if top[0] in ("{c", "{e"):
                top[3] = "init"
        elif tok == "<" and prev in ("ID", "public", "private", "static", "final", "protected", ".", "class") and (g := _P17.match(text, at)) and (prev != "ID" or klass or _P18.match(text, g.end())):
            put("T<")
            put("TYPE")
            put("T>")
            pos = g.end()
        elif tok in ("+", "-"):
            put("ADD")
        elif tok == "*":
            put("STAR")
        elif tok in ("++", "--"):
            put("INC")
        elif tok in ("!", "~"):
            put("PRE")
        elif tok in (".", ",", "...", "->", "::", "@"):
            put("AT" if tok == "@" and _P19.match(text, pos) else tok)
        elif tok.endswith("=") and tok not in ("==", "!=", "<=", ">="):
            put("AUG")
        else:
            put("BIN")
    put("EOF")
    return pairs, brackets


def lex(lang: str, text: str) -> tuple[set, list[str]]:
    """(pairs of adjacent labels, bracket windows) of a file; a byte order mark is no token, an empty file has no pair."""
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if not text.strip():
        return set(), []
    if lang == "json":
        pairs, brackets = lex_json(text)
    elif lang == "py":
        pairs, brackets = lex_python(text)
    elif lang == "go":
        pairs, brackets = lex_go(text)
    elif lang == "java":
        pairs, brackets = lex_java(text)
    else:
        pairs, brackets = lex_ecma(text, lang == "ts")
    return pairs, windows(brackets)
