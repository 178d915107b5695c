"""Compact grammars over labelled tokens, and the pairs of adjacent tokens that they permit.

A grammar is text: one rule a line, `name = alternatives`, with `( )`, `|`, `?`, `*`, `+`.  Words that are rules are
rules, all others are tokens.  A pair (a, b) is permitted when a may end and b may begin neighbouring symbols of a
rule; FIRST, LAST and nullability are computed to a fixed point.  The tokens' labels carry what the lexer knows of
their place (the owner of a bracket, the role of a colon), so that the pairs say more than bare tokens would.
"""

from __future__ import annotations

import re
from functools import lru_cache

JSON = """
file = BOF value? EOF
value = STR | NUM | LIT | '{' (member (',' member)*)? '}' | '[' (value (',' value)*)? ']'
member = KEY ':' value
"""

PYTHON = """
file = BOF NL? stmt* EOF
stmt = simple NL | compound
block = NLC INDENT stmt+
simple = small (';' small)* ';'?
small = exprs | exprs (EQ exprs)+ | exprs AUG exprs | target ANN expr (EQ exprs)? | pass | break | continue | return exprs? | raise (expr (from expr)?)? | assert expr (',' expr)? | del exprs | import dotted (as ID)? (',' dotted (as ID)?)* | from ('.' | '...')* dotted? import (STAR | names | '(' names ','? ')') | (global | nonlocal) ID (',' ID)* | type ID tsub? EQ expr
names = ID (as ID)? (',' ID (as ID)?)*
dotted = ID ('.' ID)*
target = postfix
compound = deco* (async? def ID tsub? '(' params? ')' ('->' expr)? COLON suite D_def | class ID tsub? ('(' args? ')')? COLON suite D_def) | if_ | for_ | while_ | with_ | try_ | match_
deco = '@' expr NL
suite = block | simple NL
if_ = if expr COLON suite D_if (elif expr COLON suite D_if)* (else COLON suite D_end)?
for_ = async? for exprs in exprs COLON suite D_if (else COLON suite D_end)?
while_ = while expr COLON suite D_if (else COLON suite D_end)?
with_ = async? with expr (as target)? (',' expr (as target)?)* COLON suite D_end
try_ = try COLON suite D_try ((except STAR? (exprs (as ID)?)? COLON suite D_except)+ (else COLON suite D_else)? (finally COLON suite D_end)? | finally COLON suite D_end)
match_ = match exprs COLON NLC INDENT (case exprs (as ID)? (TIF expr)? COLON suite D_end)+ D_end
params = param (',' param)* ','?
param = (STAR | POW)? (ID (ANN expr)? (EQ expr)?)? | '/'
args = arg (',' arg)* ','?
arg = expr (EQ expr)? comp? | (STAR | POW) expr | ID ':=' expr
exprs = expr (',' expr)* ','?
expr = STAR? unary ((BIN | STAR | POW | ADD | in | is | and | or | not in | is not | '/' | ':=' | TIF expr TEL | as) unary)* | lambda params? ANN expr | yield exprs? | yield from expr
unary = (ADD | not | '~' | await)* postfix
postfix = atom ('.' ID | '(' args? ')' | '[' subs ']')*
subs = sub1 (',' sub1)* ','?
sub1 = expr? (SLICE expr?)* | STAR expr
tsub = '[' tpar (',' tpar)* ','? ']'
tpar = (STAR | POW)? ID (SLICE expr)? (EQ expr)?
atom = ID | NUM | STR+ | '...' | '(' (exprs | expr comp | yield exprs)? ')' | '[' (exprs | expr comp)? ']' | '{' (pairs | exprs | expr comp | pair comp)? '}'
pairs = pair (',' pair)* ','?
pair = expr KCOLON expr | POW expr
comp = (async? CFOR exprs in expr (CIF expr)*)+
"""

ECMA = """
file = BOF body EOF
body = stmt* open?
open = simple | (if | while) '(h' exprs ')h' (stmt else)? open | for await? '(h' forhead ')h' open | ID 'C:' open
end = ';' | ASI
stmt = simple end | compound | ';'
simple = exprs | vars | return exprs? | throw exprs | (break | continue) ID? | import_ | export exporting | debugger | do stmt while '(h' exprs ')h'
vars = (const | let | var) binding (',' binding)*
binding = target note? (EQ expr)?
target = ID | '{o' props? '}o' | '[' elems? ']'
import_ = import (STR | TYPEKW? (ID (',' clause)? | clause) from STR) | import TYPEKW? ID EQ expr
clause = STAR as ID | '{m' specs? '}m'
specs = spec (',' spec)* ','?
spec = TYPEKW? ID (as ID)?
exporting = vars | default (exprs | funct | klass) | '{m' specs? '}m' (from STR)? | STAR (as ID)? from STR | EQ expr
compound = export (funct | klass | tdecl) | export default (funct | klass) | funct | klass | tdecl | '{b' body '}b' | if '(h' exprs ')h' stmt (else stmt)? | while '(h' exprs ')h' stmt | for await? '(h' forhead ')h' stmt | switch '(h' exprs ')h' '{b' cases '}b' | try '{b' body '}try' (catch ('(h' target note? ')h')? '{b' body '}b' (finally '{b' body '}b')? | finally '{b' body '}b') | ID 'C:' stmt
cases = ((case exprs | default) 'C:' body)*
forhead = (vars | exprs)? ';' exprs? ';' exprs? | (const | let | var)? target (of | in) exprs
funct = ASYNC? function STAR? ID generic? params ret? '{b' body '}b'
params = '(f' (param (',' param)* ','?)? ')f'
param = deco* mod* '...'? target 'O?'? note? (EQ expr)?
klass = deco* abstract? class ID generic? (extends unary generic?)? (implements types)? '{c' members '}c'
members = member* lastm?
lastm = mod* key 'O?'? note? (EQ expr)?
member = ';' | deco | mod* (STAR)? key 'O?'? generic? params ret? ('{b' body '}b' | end) | mod* key ('O?' | NOT)? note? (EQ expr)? end | static '{b' body '}b' | mod* '[' ID 'A:' type ']' note end
key = ID | STR | NUM | '[' exprs ']'
props = prop (',' prop)* ','?
prop = key 'K:' expr | ID (EQ expr)? | '...' expr | (ASYNC | get | set | STAR)* key generic? params ret? '{b' body '}b'
elems = ','* (elem (','+ elem)*)? ','*
elem = '...'? expr
exprs = expr (',' expr)*
expr = unary ((BIN | ADD | STAR | EQ | AUG | in | of_ | instanceof | 'T?' expr 'T:') unary)* | yield STAR? expr? | arrow
of_ = OFOP
arrow = ASYNC? (ID | '(g' elems ')g') '=>' (expr | '{b' body '}b')
unary = (PRE | ADD | INC | NOT | await)* postfix
postfix = atom suffix* INC?
suffix = ('.' | '?.') ID | '?.' ('(g' args ')g' | '[' exprs ']') | '(g' args ')g' | '[' exprs ']' | TPL | tsuffix
args = (elem (',' elem)* ','?)?
atom = ID | NUM | STR | TPL | RE | '(g' exprs ')g' | '[' elems ']' | '{o' props? '}o' | function STAR? ID? params ret? '{b' body '}fx' | ASYNC function STAR? ID? params ret? '{b' body '}fx' | class ID? (extends unary)? '{c' members '}c' | new postfix | arrow | import '(g' args ')g' | import '.' ID
deco = NEVER
mod = static | ASYNC | get | set
generic = NEVER
note = NEVER
ret = NEVER
tdecl = NEVER
types = NEVER
type = NEVER
tsuffix = NEVER
"""

#: What TypeScript adds; these rules replace the ones of the same name.
TYPED = """
deco = '@' ANAME ('(g' args ')g')?
mod = static | ASYNC | get | set | public | private | protected | readonly | abstract | declare | override
generic = 'T<' const? type (extends type)? (EQ type)? (',' const? type (extends type)? (EQ type)?)* ','? 'T>'
note = 'A:' type
ret = 'A:' (ID is type | asserts ID (is type)? | type)
types = type (',' type)*
tdecl = declare? (interface ID generic? (extends types)? '{t' tmembers '}t' | const? enum ID '{t' enums '}t' | (namespace | module) (ID | STR) ('.' ID)* '{b' body '}b' | declare ID '{b' body '}b' | abstract klass | declare (vars end | funct | klass)) | TYPEKW ID generic? EQ type end
tm = (ADD? readonly)? (key | '[' ID 'A:' type ']' | '[' ID in type (as type)? ']') (ADD? 'O?')? (note | params ret?)? | params ret?
tmembers = (tm (';' | ',' | ASI))* tm?
enums = (key (EQ expr)? ',')* (key (EQ expr)?)?
type = PIPE? tunary (PIPE tunary)* | tunary extends tunary 'T?' type 'T:' type
tunary = (keyof | typeof_ | readonly | infer | unique)* tatom ('[' type? ']')*
typeof_ = PRE
tatom = ID ('.' ID)* generic? | STR | NUM | TPL | '{t' tmembers '}t' | '(g' (tparam (',' tparam)*)? ')g' ('=>' type)? | '[' (type (',' type)*)? ']' | new '(g' (tparam (',' tparam)*)? ')g' '=>' type
tparam = '...'? type 'O?'? note?
tsuffix = NOT | generic | (as | satisfies) type
unary = (PRE | ADD | INC | NOT | await | 'T<' type 'T>')* postfix
arrow = ASYNC? (ID | generic? '(g' (tsparam (',' tsparam)*)? ')g' note?) '=>' (expr | '{b' body '}b')
tsparam = '...'? target 'O?'? note? (EQ expr)?
"""

GO = """
file = BOF package ID ';' (import_ ';')* (decl ';')* EOF
import_ = import (ispec | '(d' (ispec ';')* ispec? ')d')
ispec = (ID | '.')? STR
decl = cdecl | func ('(f' params? ')f')? ID generic? sig ('{b' body '}b')?
cdecl = (var | const) (vspec | '(d' (vspec ';')* vspec? ')d') | type (tspec | '(d' (tspec ';')* tspec? ')d')
vspec = ids EQ exprs | (ID ',')* NAME typ (EQ exprs)? | ids
tspec = (ID generic | ID EQ | NAME) typ
ids = ID (',' ID)*
named = (ID ',')* NAME
generic = '[' named typ (',' named typ)* ']'
sig = '(f' params? ')f' result?
result = typ | '(f' params ')f'
params = param (',' param)* ','?
param = NAME typ | NAME? '...' typ | typ
typ = ID ('.' ID)? targs? | MUL typ | '[' (expr | '...')? ']' typ | map '[' typ ']' typ | chan typ | ARROW chan typ | chan ARROW typ | func sig | struct '{s' (field ';')* field? '}s' | interface '{s' (imember ';')* imember? '}s' | '(g' typ ')g'
targs = '[' typ (',' typ)* ']'
field = named typ STR? | MUL? ID ('.' ID)? STR?
imember = ID sig | typ (BIN typ)*
body = (stmt ';')* stmt?
stmt = simple | cdecl | return exprs? | (break | continue | goto) ID? | fallthrough | (go | defer) expr | '{b' body '}b' | if_ | for forhead? '{b' body '}b' | switch (simple ';')? (simple)? '{b' cases '}b' | select '{b' cases '}b' | ID ':' stmt? | ';'
simple = exprs | exprs (EQ | AUG | DEF) exprs | expr INC | expr ARROW expr
if_ = if (simple ';')? simple '{b' body '}b' (else (if_ | '{b' body '}b'))?
forhead = simple | simple? ';' expr? ';' simple? | (exprs (EQ | DEF))? range expr
cases = ((case exprs | case simple | case types | default) ':' body)*
types = typ (',' typ)*
exprs = expr (',' expr)*
expr = unary ((BIN | ADD | MUL | ARROW) unary)*
unary = (ADD | MUL | NOT | ARROW | BIN1)* postfix
postfix = atom ('.' (ID | '(g' (typ | type) ')g') | '(g' args? ')g' | '[' (expr | typ) (',' typ)* ']' | '[' expr? ':' expr? (':' expr)? ']' | '{o' elems? '}o')*
args = (expr | typ) (',' (expr | typ))* '...'? ','?
atom = ID | NUM | STR | '(g' (expr | typ) ')g' | func sig '{b' body '}b' | ctype '{o' elems? '}o' | ctype
ctype = '[' (expr | '...')? ']' typ | map '[' typ ']' typ | struct '{s' (field ';')* field? '}s' | interface '{s' '}s' | chan typ
elems = elem (',' elem)* ','?
elem = expr (':' expr)? | '{o' elems? '}o' | expr ':' '{o' elems? '}o'
"""

JAVA = """
file = BOF (package name ';')? (import static? name ('.' STAR)? ';' | ';')* (typedecl | ';')* EOF
name = ID ('.' ID)*
mods = (mod | anno)*
mod = public | private | protected | static | final | abstract | native | synchronized | transient | volatile | strictfp | default | sealed
anno = '@' ANAME ('(g' annoargs? ')g')?
annoargs = expr (EQ expr)? (',' expr (EQ expr)?)*
typedecl = mods (class ID generic? (extends TYPE)? (implements TYPE (',' TYPE)*)? (permits TYPE (',' TYPE)*)? '{c' members '}c' | interface ID generic? (extends TYPE (',' TYPE)*)? (permits TYPE (',' TYPE)*)? '{c' members '}c' | enum ID (implements TYPE (',' TYPE)*)? '{e' enums? (';' members)? '}e' | record ID generic? params (implements TYPE (',' TYPE)*)? '{c' members '}c' | AT interface ID '{c' members '}c')
generic = 'T<' TYPE 'T>'
enums = anno* ID ('(k' args? ')k')? ('{c' members '}c')? (',' anno* ID ('(k' args? ')k')? ('{c' members '}c')?)* ','?
members = (mods generic? TYPE ID params dims? throws_? ('{b' body '}b' | default expr ';' | ';') | mods generic? ID params throws_? '{b' body '}b' | mods TYPE ID dims? init? (',' ID dims? init?)* ';' | typedecl | static? '{b' body '}b' | ';' | mods ID '{b' body '}b')*
throws_ = throws TYPE (',' TYPE)*
params = '(f' (param (',' param)*)? ')f'
param = (final | anno)* TYPE '...'? (ID | this) dims?
dims = ('[' ']')+
init = EQ (expr | arrayinit)
arrayinit = '{o' ((expr | arrayinit) (',' (expr | arrayinit))* ','?)? '}o'
body = stmt*
stmt = (final | anno)* TYPE ID dims? init? (',' ID dims? init?)* ';' | typedecl | expr ';' | return expr? ';' | throw expr ';' | (break | continue) ID? ';' | yield expr ';' | assert expr (AC expr)? ';' | ';' | '{b' body '}b' | if '(h' expr ')h' stmt (else stmt)? | while '(h' expr ')h' stmt | for '(h' forhead ')h' stmt | do stmt while '(h' expr ')h' ';' | switch '(h' expr ')h' '{b' cases '}b' | try ('{b' body '}try' (catches | finally '{b' body '}b') | '(h' res (';' res)* ';'? ')h' '{b' body '}b' catches?) | synchronized '(h' expr ')h' '{b' body '}b' | ID 'C:' stmt
catches = (catch '(h' final? (ID BIN)* TYPE ID ')h' '{b' body '}catch')+ (finally '{b' body '}b')?
res = final? TYPE ID EQ expr | name
forhead = forinit? ';' expr? ';' exprs? | final? TYPE ID 'C:' expr
forinit = final? TYPE ID init? (',' ID init?)* | exprs
exprs = expr (',' expr)*
cases = ((case label | default) ('C:' body | '->' (expr ';' | '{b' body '}b' | throw expr ';')))*
label = (expr | TYPE ID | pattern) (',' (expr | TYPE ID | pattern | default))* (when expr)?
pattern = ID '(k' (component (',' component)*)? ')k'
component = final? TYPE ID | pattern
expr = unary ((BIN | ADD | STAR | EQ | AUG | 'T?' expr 'T:') unary | instanceof final? (name | TYPE ID | pattern))* | lambda
lambda = (ID | '(g' (lparam (',' lparam)*)? ')g') '->' (expr | '{b' body '}b')
lparam = TYPE? ID
unary = (PRE | ADD | INC | '(g' name ')g' | '(g' TYPE ')g')* postfix
postfix = atom ('.' (ID | new ID | class | this | 'T<' TYPE 'T>' ID) | '(k' args? ')k' | '[' expr ']' | INC | '::' (ID | new))*
args = expr (',' expr)*
atom = ID | NUM | STR | this | '(g' expr ')g' | lambda | new creator | switch '(h' expr ')h' '{b' cases '}b' | ID dims '.' class | ID dims '::' new
creator = name generic? (dims arrayinit | ('[' expr ']')+ dims? | '(k' args? ')k' ('{c' members '}c')?)
"""


def _parse(text: str) -> dict[str, tuple]:
    rules: dict[str, tuple] = {}
    for line in text.strip().splitlines():
        name, _, right = line.partition(" = ")
        words = re.findall(r"'[^']+'|[A-Za-z_0-9]+|[()|?*+]", right)
        at = 0

        def alternatives() -> tuple:
            nonlocal at
            options = [sequence()]
            while at < len(words) and words[at] == "|":
                at += 1
                options.append(sequence())
            return ("or", options)

        def sequence() -> tuple:
            nonlocal at
            items = []
            while at < len(words) and words[at] not in "|)":
                if words[at] == "(":
                    at += 1
                    item = alternatives()
                    at += 1
                else:
                    item = ("sym", words[at].strip("'") if words[at][0] == "'" else words[at])
                    at += 1
                while at < len(words) and words[at] in "?*+":
                    item = (words[at], item)
                    at += 1
                items.append(item)
            return ("seq", items)

        rules[name.strip()] = alternatives()
    return rules


def permitted(text: str) -> set[tuple[str, str]]:
    """All pairs of adjacent tokens of a grammar."""
    rules = _parse(text)
    info: dict[str, tuple[bool, frozenset, frozenset]] = {r: (False, frozenset(), frozenset()) for r in rules}

    def look(node: tuple, pairs: set | None) -> tuple[bool, frozenset, frozenset]:
        kind = node[0]
        if kind == "sym":
            return info.get(node[1]) or (False, frozenset([node[1]]), frozenset([node[1]]))
        if kind == "or":
            parts = [look(x, pairs) for x in node[1]]
            return any(p[0] for p in parts), frozenset().union(*(p[1] for p in parts)), frozenset().union(*(p[2] for p in parts))
        if kind == "seq":
            null, first, last = True, frozenset(), frozenset()
            for x in node[1]:
                n, f, e = look(x, pairs)
                if pairs is not None:
                    pairs.update((a, b) for a in last for b in f)
                first = first | f if null else first
                last = last | e if n else e
                null = null and n
            return null, first, last
        n, f, e = look(node[1], pairs)
        if pairs is not None and kind in "*+":
            pairs.update((a, b) for a in e for b in f)
        return n or kind in "?*", f, e

    changed = True
    while changed:
        changed = False
        for r, node in rules.items():
            got = look(node, None)
            if got != info[r]:
                info[r], changed = got, True
    pairs: set[tuple[str, str]] = set()
    for node in rules.values():
        look(node, pairs)
    return pairs


@lru_cache(maxsize=1)
def tables() -> dict[str, frozenset]:
    """Language -> permitted (a, b, on_new_line) triples."""
    typed = {**{k: v for k, v in (x.partition(" = ")[::2] for x in ECMA.strip().splitlines())}, **{k: v for k, v in (x.partition(" = ")[::2] for x in TYPED.strip().splitlines())}}
    grammars = {"json": JSON, "py": PYTHON, "js": ECMA, "ts": "\n".join(f"{k} = {v}" for k, v in typed.items()), "go": GO, "java": JAVA}
    out = {}
    for lang, text in grammars.items():
        pairs = permitted(text)
        same = {(a, b, False) for a, b in pairs}
        if lang in ("js", "ts"):
            ends = {a for a, b in pairs if b == "ASI"}
            starts = {b for a, b in pairs if a == "ASI"}
            never = {("return", "ASI")}
            line = {(a, b, True) for a, b in pairs if a not in ("throw",)} | {(a, b, True) for a in ends for b in starts if (a, b) not in never}
        else:
            line = {(a, b, True) for a, b in pairs}
        out[lang] = frozenset(same | line)
    return out
