"""Framework adapters as tables: where a framework is at work, and what its calls, decorators and files register.

An adapter looks at files of its extensions that hold its mark (an import, an annotation, a place in the tree).  A rule
gives a kind and a pattern; its groups `verb`, `path` and `name` make the symbol's name (`GET /users`, or the name) and
its framework meta.  Patterns run over the text with comments blanked.  A project adds its own with `Adapters.add`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from graphloom.extract.languages import Declared, byte_places

VERBS = r"(?P<verb>get|post|put|delete|patch|head|options|all|any)"
STR = r"(?P<q>['\"`])(?P<path>[^'\"`\n]*)(?P=q)"
JS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")
JVM_MAPPING = (
    ("route", r"@(?P<verb>Get|Post|Put|Delete|Patch)Mapping\s*(?:\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*\"(?P<path>[^\"]*)\"[^)]*\)|(?:\(\s*\))?)"),
    ("route", r"@RequestMapping\s*\([^)]*?\"(?P<path>[^\"]*)\"(?:[^)]*RequestMethod\.(?P<verb>\w+))?[^)]*\)"),
)
SPRING_BEANS = r"@(?:RestController|Controller|Service|Repository|Component|Configuration)\b(?:\([^)]*\))?\s*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:(?:public|open|final|abstract|internal|data)\s+)*class\s+(?P<name>\w+)"
JAX_RS = (("route", r"@(?P<verb>GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b(?:\s*@(?!Path\b)\w+(?:\([^)]*\))?)*\s*(?:@Path\(\s*\"(?P<path>[^\"]*)\"\s*\))?"), ("route", r"@Path\(\s*\"(?P<path>[^\"]*)\"\s*\)\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public\s+)?(?:class|interface)\s+(?P<name>\w+)"))
MARKUP_SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script>", re.S)


@dataclass(frozen=True)
class Adapter:
    name: str
    extensions: tuple[str, ...]
    mark: str  # a pattern of the text; "path:" before it, of the path
    rules: tuple[tuple[str, str], ...]
    component: str = ""  # kind of the symbol that the file itself is, named by its stem


ADAPTERS: tuple[Adapter, ...] = (
    Adapter("express", JS, r"['\"]express['\"]", (("route", rf"\b(?:app|router|\w*[Rr]outer)\.{VERBS}\(\s*{STR}"), ("middleware", r"\b(?:app|router|\w*[Rr]outer)\.use\(\s*(?:['\"](?P<path>[^'\"]*)['\"]\s*,\s*)?(?P<name>[\w.]+)"))),
    Adapter("fastify", JS, r"['\"]fastify['\"]", (("route", rf"\b(?:fastify|app|server|instance)\.{VERBS}\(\s*{STR}"), ("route", r"\.route\(\s*\{[^}]*?method:\s*['\"](?P<verb>\w+)['\"][^}]*?url:\s*['\"](?P<path>[^'\"]*)['\"]"), ("middleware", r"\.(?:register|addHook)\(\s*(?:['\"](?P<path>\w+)['\"]\s*,\s*)?(?P<name>[\w.]+)"))),
    Adapter("nestjs", (".ts", ".mts"), r"['\"]@nestjs/", (("route", r"@(?P<verb>Get|Post|Put|Delete|Patch|Head|Options|All)\(\s*(?:['\"`](?P<path>[^'\"`]*)['\"`])?\s*\)"), ("class", r"@(?:Controller|Injectable|Module|Resolver|WebSocketGateway)\([^)]*\)\s*(?:export\s+)?class\s+(?P<name>\w+)"), ("middleware", r"class\s+(?P<name>\w+)\s+implements\s+[^{]*\b(?:NestMiddleware|CanActivate|NestInterceptor|PipeTransform|ExceptionFilter)\b"))),
    Adapter("nextjs", JS, r"path:(^|/)(pages|app)/.+\.(js|jsx|ts|tsx)$|(^|/)middleware\.(js|ts)$", (("route", r"export\s+(?:async\s+)?function\s+(?P<verb>GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"), ("component", r"export\s+default\s+(?:async\s+)?function\s+(?P<name>[A-Z]\w*)"), ("middleware", r"export\s+(?:async\s+)?function\s+(?P<name>middleware)\b"))),
    Adapter("nuxt", (*JS, ".vue"), r"\b(?:defineEventHandler|defineNuxtRouteMiddleware|definePageMeta|defineNuxtPlugin|defineNuxtConfig|useNuxtApp)\b", (("route", r"export\s+default\s+(?P<name>defineEventHandler)"), ("middleware", r"export\s+default\s+(?P<name>defineNuxtRouteMiddleware|defineNuxtPlugin)"))),
    Adapter("react", JS, r"['\"]react['\"]|</?[A-Z]\w*[\s/>]", (("component", r"function\s+(?P<name>[A-Z]\w*)\s*[(<]"), ("component", r"const\s+(?P<name>[A-Z]\w*)\s*(?::[^=\n]+)?=\s*(?:[\w.]+\(\s*)?(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=\n]+)?=>|\w+\s*=>)"), ("hook", r"(?:function|const)\s+(?P<name>use[A-Z]\w*)\s*[(=:<]"), ("component", r"class\s+(?P<name>[A-Z]\w*)\s+extends\s+(?:React\.)?(?:Pure)?Component\b"))),
    Adapter("angular", (".ts",), r"['\"]@angular/", (("component", r"@(?:Component|Directive|Pipe)\(\s*\{[\s\S]*?\}\s*\)\s*(?:export\s+)?class\s+(?P<name>\w+)"), ("route", r"\{\s*path:\s*['\"](?P<path>[^'\"]*)['\"]\s*,\s*(?:component|loadChildren|loadComponent|redirectTo)"), ("middleware", r"class\s+(?P<name>\w+)\s+implements\s+[^{]*\b(?:CanActivate|CanDeactivate|HttpInterceptor|Resolve)\b"), ("class", r"@(?:Injectable|NgModule)\([\s\S]*?\)\s*(?:export\s+)?class\s+(?P<name>\w+)"))),
    Adapter("vue", (".vue",), r"<(?:template|script)\b", (("composable", r"(?:function|const)\s+(?P<name>use[A-Z]\w*)\s*[(=]"),), "component"),
    Adapter("svelte", (".svelte",), r"", (("composable", r"(?:function|const)\s+(?P<name>use[A-Z]\w*)\s*[(=]"),), "component"),
    Adapter("astro", (".astro",), r"", (), "component"),
    Adapter("flask", (".py",), r"\bflask\b", (("route", r"@\w+\.route\(\s*['\"](?P<path>[^'\"]*)['\"](?:[^)]*?methods\s*=\s*\[\s*['\"](?P<verb>\w+)['\"])?[^)]*\)"), ("route", r"@\w+\.(?P<verb>get|post|put|delete|patch)\(\s*['\"](?P<path>[^'\"]*)['\"]"), ("view", r"class\s+(?P<name>\w+)\([^)]*\b(?:MethodView|View|Resource)\b"))),
    Adapter("fastapi", (".py",), r"\bfastapi\b", (("route", r"@\w+\.(?P<verb>get|post|put|delete|patch|head|options|websocket)\(\s*['\"](?P<path>[^'\"]*)['\"]"), ("route", r"\.add_api_route\(\s*['\"](?P<path>[^'\"]*)['\"]"))),
    Adapter("django", (".py",), r"\bdjango\b", (("route", r"\b(?:re_)?path\(\s*r?['\"](?P<path>[^'\"]*)['\"]\s*,\s*(?P<name>[\w.]+)"), ("route", r"\burl\(\s*r?['\"](?P<path>[^'\"]*)['\"]\s*,\s*(?P<name>[\w.]+)"), ("view", r"class\s+(?P<name>\w+)\([^)]*\b(?:\w*View|ViewSet|ModelViewSet|APIView)\b"), ("model", r"class\s+(?P<name>\w+)\([^)]*\bmodels\.Model\b"), ("signal", r"@receiver\(\s*[\w.\[\], ]+[^)]*\)\s*def\s+(?P<name>\w+)"))),
    Adapter("django-orm", (".py",), r"\bmodels\.(?:Model|ForeignKey|\w+Field)\b", (("class", r"class\s+(?P<name>\w+)\([^)]*\b(?:models\.Model|AbstractUser|AbstractBaseUser|Manager|QuerySet)\b"), ("const", r"^\s+(?P<name>\w+)\s*=\s*models\.(?P<path>\w+(?:Field|Key))\("))),
    Adapter("sqlalchemy", (".py",), r"\bsqlalchemy\b", (("class", r"class\s+(?P<name>\w+)\([^)]*\b(?:Base|DeclarativeBase|Model|SQLModel)\b"), ("const", r"^\s+(?P<name>\w+)\s*(?::\s*Mapped\[[^\n]*\]\s*)?=\s*(?:\w+\.)?(?P<path>Column|mapped_column|relationship)\("))),
    Adapter("spring-boot", (".java",), r"org\.springframework", (*JVM_MAPPING, ("class", SPRING_BEANS), ("function", r"@(?:Bean|Scheduled|EventListener|KafkaListener)\b(?:\([^)]*\))?\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public\s+)?[\w<>\[\], ]+?\s+(?P<name>\w+)\("))),
    Adapter("spring-kotlin", (".kt", ".kts"), r"org\.springframework", (*JVM_MAPPING, ("class", SPRING_BEANS), ("route", r"\b(?P<verb>GET|POST|PUT|DELETE|PATCH)\(\s*\"(?P<path>[^\"]*)\""))),
    Adapter("micronaut", (".java", ".kt", ".groovy"), r"io\.micronaut", (("route", r"@(?P<verb>Get|Post|Put|Delete|Patch|Head|Options)\b(?:\(\s*(?:(?:value|uri)\s*=\s*)?\"(?P<path>[^\"]*)\"[^)]*\))?"), ("class", r"@(?:Controller|Singleton|Factory|Prototype|Context)\b(?:\([^)]*\))?\s*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:(?:public|open|final|abstract)\s+)*class\s+(?P<name>\w+)"), ("interface", r"@Client\([^)]*\)\s*(?:public\s+)?interface\s+(?P<name>\w+)"), ("function", r"@(?:Bean|Scheduled|EventListener)\b(?:\([^)]*\))?\s*(?:public\s+)?[\w<>\[\], ]+?\s+(?P<name>\w+)\("))),
    Adapter("quarkus", (".java", ".kt"), r"io\.quarkus|jakarta\.ws\.rs|javax\.ws\.rs", (*JAX_RS, ("class", r"@(?:ApplicationScoped|RequestScoped|Singleton|Dependent)\b\s*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:(?:public|open|final)\s+)*class\s+(?P<name>\w+)"), ("interface", r"@RegisterRestClient\b(?:\([^)]*\))?\s*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:public\s+)?interface\s+(?P<name>\w+)"), ("function", r"@(?:Scheduled|Incoming|Outgoing|ConsumeEvent)\b(?:\([^)]*\))?\s*(?:public\s+)?[\w<>\[\], ]+?\s+(?P<name>\w+)\("))),
    Adapter("hibernate", (".java", ".kt"), r"(?:javax|jakarta)\.persistence|org\.hibernate", (("class", r"@(?:Entity|Embeddable|MappedSuperclass)\b(?:\([^)]*\))?\s*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:(?:public|open|data|abstract|final)\s+)*class\s+(?P<name>\w+)"), ("const", r"@(?P<path>Id|Column|OneToMany|ManyToOne|OneToOne|ManyToMany|JoinColumn|Embedded)\b(?:\([^)]*\))?\s*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:private|protected|public|var|val)\s+(?:[\w<>, ]+\s+)?(?P<name>\w+)\s*[;:=]"), ("function", r"@(?:Query|NamedQuery|PrePersist|PostLoad|PreUpdate)\b(?:\([^)]*\))?\s*(?:public\s+)?[\w<>\[\], ]+?\s+(?P<name>\w+)\("))),
    Adapter("ktor", (".kt", ".kts"), r"io\.ktor", (("route", r"\b(?P<verb>get|post|put|delete|patch|head|options|webSocket)\s*\(\s*\"(?P<path>[^\"]*)\""), ("route", r"\broute\(\s*\"(?P<path>[^\"]*)\""))),
    Adapter("android", (".kt", ".java", ".xml"), r"\bandroidx?\.|<manifest\b|<navigation\b", (("composable", r"@Composable\s+(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:private|internal|public)\s+)?fun\s+(?:\w+\.)?(?P<name>\w+)"), ("route", r"\bcomposable\(\s*(?:route\s*=\s*)?\"(?P<path>[^\"]*)\""), ("route", r"<activity\b[^>]*android:name=\"(?P<path>[^\"]+)\""), ("route", r"<fragment\b[^>]*android:id=\"@\+id/(?P<path>[^\"]+)\""))),
    Adapter("flutter", (".dart",), r"package:flutter", (("widget", r"class\s+(?P<name>\w+)\s+extends\s+(?:Stateless|Stateful|Inherited|Consumer|Hook)Widget\b"), ("class", r"class\s+(?P<name>\w+)\s+extends\s+State<"))),
    Adapter("laravel", (".php",), r"Illuminate\\|\bRoute::", (("route", r"Route::(?P<verb>get|post|put|patch|delete|options|any|match|resource|apiResource)\(\s*['\"](?P<path>[^'\"]*)['\"]"), ("model", r"class\s+(?P<name>\w+)\s+extends\s+(?:Model|Authenticatable|Pivot)\b"), ("class", r"class\s+(?P<name>\w+)\s+extends\s+(?:Controller|BaseController|ServiceProvider|Command|Job)\b"), ("middleware", r"class\s+(?P<name>\w+)[^{]*\{[^}]*function\s+handle\(\s*(?:Request\s+)?\$request\s*,\s*(?:Closure\s+)?\$next"), ("view", r"\bview\(\s*['\"](?P<path>[^'\"]+)['\"]"))),
    Adapter("symfony", (".php",), r"Symfony\\", (("route", r"#\[Route\(\s*(?:path:\s*)?['\"](?P<path>[^'\"]*)['\"](?:[^\]]*?methods:\s*\[\s*['\"](?P<verb>\w+)['\"])?[^\]]*\]"), ("route", r"@Route\(\s*\"(?P<path>[^\"]*)\""), ("class", r"class\s+(?P<name>\w+)\s+extends\s+(?:AbstractController|Command|AbstractType)\b"))),
    Adapter("rails", (".rb",), r"\bRails\b|\bApplication(?:Record|Controller|Job|Mailer)\b|\bActive(?:Record|Job)::", (("route", r"^\s*(?P<verb>get|post|put|patch|delete)\s+['\"](?P<path>[^'\"]+)['\"]"), ("route", r"^\s*(?P<verb>resources?|namespace|root)\s+:?['\"]?(?P<path>[\w/#]+)"), ("model", r"class\s+(?P<name>[\w:]+)\s*<\s*(?:ApplicationRecord|ActiveRecord::Base)\b"), ("class", r"class\s+(?P<name>[\w:]+)\s*<\s*(?:ApplicationController|ActionController::\w+|ApplicationJob|ApplicationMailer)\b"), ("view", r"^\s*render\s+['\":](?P<path>[\w/]+)"))),
    Adapter("sinatra", (".rb",), r"['\"]sinatra|Sinatra::", (("route", r"^\s*(?P<verb>get|post|put|patch|delete|head|options)\s+['\"](?P<path>[^'\"]+)['\"]"),)),
    Adapter("gin", (".go",), r"gin-gonic/gin", (("route", r"\.(?P<verb>GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Any)\(\s*\"(?P<path>[^\"]*)\""), ("middleware", r"\.Use\(\s*(?P<name>[\w.]+)"))),
    Adapter("echo", (".go",), r"labstack/echo", (("route", r"\.(?P<verb>GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Any)\(\s*\"(?P<path>[^\"]*)\""), ("middleware", r"\.Use\(\s*(?P<name>[\w.]+)"))),
    Adapter("fiber", (".go",), r"gofiber/fiber", (("route", r"\.(?P<verb>Get|Post|Put|Delete|Patch|Head|Options|All)\(\s*\"(?P<path>[^\"]*)\""), ("middleware", r"\.Use\(\s*(?:\"(?P<path>[^\"]*)\"\s*,\s*)?(?P<name>[\w.]+)"))),
    Adapter("actix-web", (".rs",), r"\bactix_web\b", (("route", r"#\[(?P<verb>get|post|put|delete|patch|head)\(\s*\"(?P<path>[^\"]*)\""), ("route", r"\.route\(\s*\"(?P<path>[^\"]*)\"\s*,\s*web::(?P<verb>\w+)\(\)"), ("middleware", r"\.wrap\(\s*(?P<name>[\w:]+)"), ("type", r"web::(?:Json|Path|Query|Data|Form)<(?P<name>[\w:]+)>"))),
    Adapter("axum", (".rs",), r"\baxum\b", (("route", r"\.route\(\s*\"(?P<path>[^\"]*)\"\s*,\s*(?:\w+::)*(?P<verb>get|post|put|delete|patch|any)\("), ("middleware", r"\.layer\(\s*(?P<name>[\w:]+)"), ("type", r"\b(?:Json|Path|Query|State|Extension)<(?P<name>[\w:]+)>"))),
    Adapter("rocket", (".rs",), r"\brocket\b", (("route", r"#\[(?P<verb>get|post|put|delete|patch|head)\(\s*\"(?P<path>[^\"]*)\""), ("middleware", r"\.attach\(\s*(?P<name>[\w:]+)"), ("type", r"\b(?:Json|Form|State)<(?P<name>[\w:]+)>"))),
    Adapter("vapor", (".swift",), r"\bimport\s+Vapor\b", (("route", r"\.(?P<verb>get|post|put|delete|patch)\(\s*\"(?P<path>[^\"]*)\""), ("model", r"class\s+(?P<name>\w+)\s*:\s*[^{]*\bModel\b"), ("class", r"struct\s+(?P<name>\w+)\s*:\s*[^{]*\bRouteCollection\b"), ("middleware", r"(?:struct|class)\s+(?P<name>\w+)\s*:\s*[^{]*\b(?:Async)?Middleware\b"))),
)
_COMMENT = {
    "#": re.compile(r"#(?!\[)[^\n]*|\"\"\".*?\"\"\"", re.S), "//": re.compile(r"/\*.*?\*/|(?<![:\"'`\w])//[^\n]*", re.S), "<": re.compile(r"<!--.*?-->", re.S),
}


@lru_cache(maxsize=512)
def _ready(a: Adapter) -> tuple:
    on_path = a.mark.startswith("path:")
    return on_path, re.compile(a.mark.removeprefix("path:"), re.I if on_path else 0), tuple((k, re.compile(p, re.M)) for k, p in a.rules)


def page_route(path: str) -> str | None:
    """The address that a file-based router gives a file below pages/ or app/: [id] becomes :id, index and groups vanish."""
    m = re.search(r"(?:^|/)(pages|app)/(.+)\.(?:jsx?|tsx?|vue)$", path)
    if not m:
        return None
    steps = m[2].split("/")
    if m[1] == "app":
        if steps[-1] not in ("page", "route"):
            return None
        steps = steps[:-1]
    elif steps[-1].startswith("_"):
        return None
    steps = [re.sub(r"\[(?:\.\.\.)?(\w+)\]", r":\1", s) for s in steps if s != "index" and not re.fullmatch(r"\(.*\)", s)]
    return "/" + "/".join(steps)


class Adapters:
    """Adapters by name; one that is added again replaces the one before."""

    def __init__(self, adapters: tuple[Adapter, ...] = ADAPTERS):
        self.by_name = {a.name: a for a in adapters}

    def add(self, adapter: Adapter) -> None:
        self.by_name[adapter.name] = adapter

    def extract(self, path: str, text: str) -> list[Declared]:
        """What the frameworks at work in a file register, in order of place."""
        ext = "." + path.rsplit(".", 1)[-1].lower()
        out: list[tuple[int, Declared]] = []
        code, to_byte = None, None
        for a in self.by_name.values():
            if ext not in a.extensions:
                continue
            on_path, mark, rules = _ready(a)
            if not mark.search(path if on_path else text):
                continue
            if code is None:
                marks = "#" if ext in (".py", ".rb") else "<" if ext in (".xml",) else "//"
                code = _COMMENT[marks].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
                to_byte = byte_places(text)
            stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            if a.component:
                out.append((0, Declared(stem, a.component, 0, to_byte(len(text)), f"{a.component} {stem}", "", {"framework": a.name})))
            if a.name in ("nextjs", "nuxt") and (address := page_route(path)) is not None:
                out.append((0, Declared(f"PAGE {address}", "route", 0, to_byte(len(text)), f"PAGE {address}", "", {"framework": a.name, "path": address})))
            for kind, pattern in rules:
                for m in pattern.finditer(code):
                    g = m.groupdict()
                    verb, address, name = (g.get("verb") or "").upper(), g.get("path"), g.get("name")
                    meta = {"framework": a.name} | ({"method": verb} if verb else {}) | ({"path": address} if address is not None else {})
                    label = f"{verb or 'ANY'} {address or '/'}" if kind == "route" and (verb or not name) else name or address or verb
                    if label:
                        line = text[text.rfind("\n", 0, m.start()) + 1 : (text + "\n").find("\n", m.start())]
                        out.append((m.start(), Declared(label, kind, to_byte(m.start()), to_byte(m.end()), " ".join(line.split()), "", meta)))
        out.sort(key=lambda x: x[0])
        seen: dict[tuple, Declared] = {}
        for _, d in out:
            seen.setdefault((d.name, d.kind, d.start, d.meta["framework"]), d)
        return list(seen.values())
