"""What a query asks for and what a path is: roles of paths, intents, identifiers.

The rules are tables; ``path_role`` and the intents turn them into column expressions, so
a whole query set, or all files, are classified in one projection."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(*names: str) -> str:
    """A component of the path that is one of ``names``."""
    return rf"(?:^|/)(?:{'|'.join(names)})(?:/|$)"


def _named(*names: str) -> str:
    return rf"(?:^|/)(?:{'|'.join(names)})$"


_SETTINGS = r"\.(?:json|yaml|yml|toml|ini|cfg|conf|env)$"
_SPRING = r"(?:^|/)(?:application|bootstrap)(?:-[^/]+)?\.(?:properties|yaml|yml)$|(?:^|/)(?:logback|log4j)[^/]*\.xml$|(?:^|/)(?:persistence|beans)\.xml$|(?:^|/)configs?/(?:[^/]+/)*[^/]+\.properties$"
_ARTIFACT = f"{_SETTINGS}|{_SPRING}"

# Roles of paths with their priority, in the order in which they are tried. A
# rule holds if all of its patterns do: on the path in small letters (low), as it is
# (path), or on the code without comments and literals (code).
PATH_RULES: tuple[tuple[str, int, tuple[tuple[str, str], ...]], ...] = (
    ("test", 90, (("low", _part("tests?") + r"|_test\.(?:go|rs)$|_spec\.rs$|\.(?:test|spec)\.[jt]sx?$|test\.java$"),)),
    ("lockfile", 90, (("low", _named(r"cargo\.lock", r"go\.sum", r"package-lock\.json", r"pnpm-lock\.ya?ml", r"yarn\.lock")),)),
    ("config", 70, (("low", _named(r"vite\.config\.[tj]s", r"webpack\.config\.js", r"tsconfig\.json")),)),
    ("deployment_config", 75, (("low", _named("dockerfile", r"(?:docker-)?compose\.ya?ml")),)),
    ("deployment_config", 75, (("low", _part("docker", "deploy", "deployment", "k8s", "helm")), ("low", _ARTIFACT))),
    ("config_example", 75, (("low", r"\.example$"),)),
    ("config_example", 75, (("low", _part("examples?", "sample")), ("low", _ARTIFACT))),
    ("generated_output", 85, (("low", _part("history", "outputs?", "generated", "gen")), ("low", _ARTIFACT))),
    ("runtime_config", 65, (("low", _SPRING),)),
    ("runtime_config", 65, (("low", _part("configs?", "settings?")), ("low", _SETTINGS))),
    ("runtime_config", 65, (("low", r"(?:config|provider|setting)[^/]*\.[^./]+$"), ("low", _SETTINGS))),
    ("doc", 80, (("low", r"\.(?:mdx?|rst|txt|adoc|asciidoc)$|" + _named("authors", "changelog", "code_of_conduct", "contributors", "copying", "history", "license", "notice", "readme")),)),
    ("service_impl", 10, (("low", r"/service/impl/|serviceimpl[^/]*$"),)),
    ("service_interface", 35, (("low", "/service/"), ("code", r"(?:^|[\n;{}])\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|abstract|static|sealed|strictfp)\s+)*interface\s+\w"))),
    ("executor", 20, (("low", r"(?:executor|exe)(?:\.[^./]+)?$"),)),
    ("data_type", 45, (("low", _part("dto", "vo", "entity", "models?", "types?") + r"|(?:^|/)types?\.[^./]+$|\.types\.tsx?$"),)),
    ("state_store", 20, (("low", _part("stores?", "state") + r"|\.store\.ts$"),)),
    ("composable", 20, (("low", _part("composables?", "hooks?")),)),
    ("composable", 20, (("path", r"(?:^|/)use\p{Lu}[^/]*\.(?:ts|tsx|js|jsx|vue|svelte)$"),)),
    ("entrypoint", 10, (("low", _part("controllers?") + r"|controller[^/]*$"),)),
    ("router", 15, (("low", _part("routers?", "routes") + "|" + _named(r"router\.go")),)),
    ("command", 15, (("low", _part("commands?") + r"|(?:^|/)commands(?:\.[^./]+)?$"),)),
    ("engine", 20, (("low", r"(?:^|/)engine(?:\.[^./]+)?$"),)),
    ("handler", 25, (("low", _part("handlers?") + r"|handler[^/]*$"),)),
    ("middleware", 25, (("low", _part("middlewares?") + r"|middleware[^/]*$"),)),
    ("storage", 30, (("low", _part("storages?")),)),
    ("service", 30, (("low", _part("services?")),)),
    ("repository", 40, (("low", _part("repository", "repositories", "repos?") + r"|_repo(?:\.[^./]+)?$"),)),
    ("repository", 40, (("path", r"Repository\.(?:java|JAVA)$"),)),
    ("source_adapter", 40, (("low", _part("sources?", "adapters?", "clients?")),)),
    ("view", 50, (("low", _part("views?", "pages?") + r"|\.(?:vue|svelte)$"),)),
    ("view", 50, (("low", r"\.html$"), ("low", _part("templates")))),
    ("component", 50, (("low", _part("components?")),)),
    ("scheduler", 25, (("low", _part("scheduler") + r"|scheduler[^/]*$"),)),
    ("config", 70, (("low", r"(?:^|/)(?:settings|config)(?:\.[^./]+)?$"),)),
    ("data_type", 45, (("path", r"(?:Dto|DTO|Vo|VO|Request|Response|Entity|Model)\.(?:java|JAVA)$"),)),
    ("data_type", 45, (("low", r"\.java$"), ("code", r"(?:^|[\n;{}])\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|abstract|static|final|sealed|strictfp)\s+)*(?:record|enum)\s+\w"))),
    ("data_type", 45, (("low", r"\.java$"), ("code", r"@(?:[\w.]+\.)?(?:Document|Embeddable|Entity|MappedSuperclass)\b[^;{}]*\b(?:class|interface)\s+\w"))),
)
OTHER_ROLE = ("source", 60)
#: Comments and literals, which declare nothing.
NO_CODE = r"""//[^\n]*|/\*(?s:.*?)\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""


def path_role(path: Column, content: Column) -> Column:
    """``struct<name, priority>``: the first rule that holds; a null path is plain source."""
    path = F.coalesce(path, F.lit(""))
    code = F.regexp_replace(F.coalesce(content, F.lit("")), NO_CODE, " ")
    texts = {"low": F.lower(path), "path": path, "code": code}
    role = lambda name, priority: F.struct(F.lit(name).alias("name"), F.lit(priority).alias("priority"))
    chain = None
    for name, priority, patterns in PATH_RULES:
        holds = functools.reduce(Column.__and__, [texts[which].rlike(pattern) for which, pattern in patterns])
        chain = F.when(holds, role(name, priority)) if chain is None else chain.when(holds, role(name, priority))
    return chain.otherwise(role(*OTHER_ROLE))


# Words by which a query names an operation, a target or an artifact.
OPERATIONS = {
    "save": "save saving persist persistence 保存 持久化 存储",
    "update": "update modify edit 更新 修改",
    "delete": "delete remove 删除 移除",
    "download": "download zip export 下载 导出 打包",
    "scan": "scan sync synchronize 扫描 同步",
    "generate": "generate generated 生成 创建",
    "retry": "retry regenerate 重试 重新生成",
}
TARGETS = {
    "entrypoint": "api endpoint route router controller 接口 路由",
    "implementation": "service handler logic impl 实现 逻辑 服务",
    "ui": "page view component form store 页面 表单 组件",
    "config": "config configs setting settings yaml yml 配置 服务商",
    "deploy": "docker compose deployment deploy 部署 容器",
    "history": "record records 历史记录",
    "test": "test tests spec specs 测试",
    "doc": "doc docs documentation document documents readme 文档 说明",
}
ARTIFACTS = {
    "config_artifact": "yaml yml json toml docker compose dockerfile config configs setting settings 配置文件",
    "generated_artifact": "output dist build generate generated 生成文件 产物",
    "doc_artifact": "doc docs documentation document documents readme markdown 文档",
    "test_artifact": "test tests spec specs 测试",
}
ARTIFACT_HINTS = "file files artifact artifacts docker compose deployment deploy readme docs documentation document documents generated 文件 配置文件 部署 文档 产物"
#: Words of ideographs are looked for in the text, others among its words.
IDEOGRAPH = "[一-鿿]"


def query_words(query: Column, tokens: Column) -> Column:
    """Words of a query: its tokens and its runs of letters, digits and underscores."""
    return F.array_union(F.transform(tokens, lambda t: F.lower(t)), F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9_]+"), 0))


def _says(query: Column, words: Column, keywords: str) -> Column:
    plain = [w for w in keywords.split() if not any("一" <= c <= "鿿" for c in w)]
    ideographs = [w for w in keywords.split() if w not in plain]
    said = F.arrays_overlap(words, F.array(*[F.lit(w) for w in plain])) if plain else F.lit(False)
    return functools.reduce(Column.__or__, [F.contains(F.lower(query), F.lit(w)) for w in ideographs], said)


def _groups(query: Column, words: Column, table: dict[str, str]) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(_says(query, words, keywords), F.lit(name)) for name, keywords in table.items()])))


def with_query_intent(rows, query: str = "query_text", tokens: str = "query_tokens"):
    """Adds ``operations, targets, artifacts`` (sorted names), ``wants_artifact`` and
    ``confidence``, the number of groups named; a null query names none."""
    text = F.coalesce(F.col(query), F.lit(""))
    named = rows.withColumn("_words", query_words(text, F.col(tokens)))
    words = F.col("_words")
    named = named.withColumns({"operations": _groups(text, words, OPERATIONS), "targets": _groups(text, words, TARGETS), "artifacts": _groups(text, words, ARTIFACTS)})
    asked = _says(text, words, ARTIFACT_HINTS) | F.arrays_overlap("targets", F.array(F.lit("deploy"), F.lit("doc"), F.lit("test")))
    named = named.withColumn("wants_artifact", (F.size("artifacts") > 0) & asked)
    return named.withColumn("confidence", F.size("operations") + F.size("targets") + F.col("wants_artifact").cast("int")).drop("_words")


# Words that hint at the role of the file that is looked for.
ROLE_HINTS = {
    "state_store": "store stores pinia redux zustand", "composable": "composable composables hook hooks", "service": "service services", "handler": "handler handlers", "middleware": "middleware middlewares",
    "router": "router route routes", "entrypoint": "controller controllers", "repository": "repository repositories repo", "source_adapter": "source adapter client", "storage": "storage storages", "view": "view views page pages",
    "component": "component components", "data_type": "type types dto entity model", "command": "command commands", "engine": "engine",
}
CAMEL = r"[A-Z]{3,}[a-z][A-Za-z0-9]*|[A-Z]?[a-z]+[A-Z][A-Za-z0-9]*"
SNAKE = r"[a-z][a-z0-9]+(?:_[a-z0-9]+)+"
SCREAMING = r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+"
#: A letter or digit beyond ASCII belongs to a word; two underscores stand for it, which no
#: identifier pattern goes over.
BEYOND_ASCII = r"[\p{L}\p{N}&&[^\x00-\x7F]]"


def with_identifiers(rows, query: str = "query_text", tokens: str = "query_tokens"):
    """Adds ``identifiers`` (camel and snake case, sorted), ``file_hints``, ``suffix_hints``,
    ``role_hints`` (in order of mention) and ``exact_identifier`` (the whole query, if it is
    one identifier)."""
    text = F.coalesce(F.col(query), F.lit(""))
    ascii_text = F.regexp_replace(text, BEYOND_ASCII, "__")
    found = F.concat(F.regexp_extract_all(ascii_text, F.lit(rf"\b(?:{CAMEL})\b"), 0), F.regexp_extract_all(ascii_text, F.lit(rf"\b{SNAKE}\b"), 0))
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_.-]+"), 0)
    files = F.array_distinct(F.transform(F.filter(runs, lambda r: r.rlike(r"^[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+$")), lambda r: F.lower(r)))
    hint_of = F.create_map(*[F.lit(x) for role, words in ROLE_HINTS.items() for word in words.split() for x in (word, role)])
    said = F.concat(F.col(tokens), F.regexp_extract_all(text, F.lit("[A-Za-z0-9_+-]+"), 0))
    hints = F.array_distinct(F.array_compact(F.transform(said, lambda t: F.element_at(hint_of, F.lower(t)))))
    trimmed = F.trim(text)
    exact = F.when(trimmed.rlike(rf"^(?:{CAMEL}|{SNAKE}|{SCREAMING})$"), trimmed)
    return rows.withColumns(
        {
            "identifiers": F.array_sort(F.array_distinct(found)),
            "file_hints": files,
            "suffix_hints": F.array_distinct(F.transform(files, lambda f: F.concat(F.lit("."), F.substring_index(f, ".", -1)))),
            "role_hints": hints,
            "exact_identifier": exact,
        }
    )
