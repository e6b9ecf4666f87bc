"""Scalar functions on names, URLs, paths and SQL texts as column expressions; all stay in the JVM.

A null argument gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions.source import masked

#: Words that follow FROM, JOIN, INTO or UPDATE without being a table.
NOT_TABLES = ("select", "where", "set", "values", "on", "as")
#: How far each way of resolving a call is trusted; others have 0.5.
TIER_CONFIDENCE = {
    "local": 1.0, "serviceMap": 0.95, "objectMethodImport": 0.93, "hookMethodBridge": 0.90, "destructuredBinding": 0.88, "destructuredHookBridge": 0.87,
    "contextHook": 0.90, "dynamicImport": 0.88, "globalCallGraph": 0.85, "serviceMapBroadSearch": 0.82, "eventGraph": 0.80, "eventGraph+serviceMap": 0.75,
    "eventGraph+globalCallGraph": 0.70, "dispatchAction": 0.82, "crossFileNameMatch": 0.50, "stateFlowGraph": 0.65, "architecturalLayerGraph": 0.55, "fuzzyGlobalMatch": 0.45,
}
#: Verbs of convention endpoints -> (HTTP method, operation); the first class that matches holds.
CONVENTION_VERBS = (
    ("(?i)^(delete|remove|destroy|archive|purge|clear|deactivate)", "POST", "DELETE"),
    ("(?i)^(update|edit|patch|modify|save|set|reorder|move|assign|unassign|link|unlink|reactivate)", "POST", "UPDATE"),
    ("(?i)^(create|add|new|register|insert|import|bulk|generate|provision|upsert|approve|reject|submit|process|apply|sync|cancel|close|open|finish|start|recalculate)", "POST", "CREATE"),
    ("(?i)^(find|get|list|search|count|export|validate|resolve|calculate|preview|check|download|view|simulate|suggest|score|fetch|read|analyze)", "GET", "READ"),
)
#: Verbs that may begin an operation's name before its entity.
LEADING_VERB = "(?i)^(bulkcreate|bulk|create|add|new|register|insert|import|generate|provision|duplicate|clone|copy|update|edit|patch|modify|change|rename|delete|remove|destroy|archive|purge|list|search|browse|query|find|get|fetch|load|read|view|show|resolve|count|export|download)"



def snake_case(name: Column) -> Column:
    """FN-01"""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def bare_table(name: Column) -> Column:
    """Without quotes, brackets and schema."""
    return F.element_at(F.split(F.regexp_replace(name, '[`"\\[\\]]', ""), "\\."), -1)


def table_of_entity(explicit: Column, class_name: Column) -> Column:
    """FN-02: the stated table name without schema, else the class name in snake case."""
    named = F.lower(bare_table(F.trim(explicit)))
    return F.when(named != "", named).otherwise(snake_case(class_name))


def tables_of_sql(sql: Column) -> Column:
    """FN-03: names after FROM, JOIN, INTO and UPDATE, bare and in lower case, in order, without repeats."""
    found = F.regexp_extract_all(sql, F.lit('(?i)\\b(?:from|join|into|update)\\s+([`"\\[\\]\\w.$]+)'), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(bare_table(x))), lambda t: (t != "") & ~t.isin(*NOT_TABLES)))


def tables_of_span(tags: Column) -> Column:
    """FN-04: the collection tag, else the older table tag, else the tables of the statement; empty without any."""
    one = lambda k: F.when(tags[k] != "", F.array(tags[k]))
    sql = F.coalesce(F.when(tags["db.query.text"] != "", tags["db.query.text"]), tags["db.statement"])
    return F.coalesce(one("db.collection.name"), one("db.sql.table"), tables_of_sql(sql), F.array().cast("array<string>"))


def normalize_table(name: Column) -> Column:
    """FN-05"""
    return snake_case(bare_table(name))


def db_operation(tags: Column) -> Column:
    """FN-06: upper case; empty without a tag."""
    new = F.when(tags["db.operation.name"] != "", tags["db.operation.name"])
    return F.upper(F.coalesce(new, tags["db.operation"], F.lit("")))


def strip_query(url: Column) -> Column:
    """FN-07: what comes before the first question mark."""
    return F.split(url, "\\?").getItem(0)


def strip_url(url: Column) -> Column:
    """FN-07: without query, fragment and trailing slashes; repeated slashes as one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", ""), "/{2,}", "/")


def normalize_url(url: Column) -> Column:
    """FN-08: template expressions become {param}; quotes, concatenated names and repeated slashes go."""
    u = F.regexp_replace(F.regexp_replace(url, "\\$\\{[^}]+\\}", "{param}"), "`", "")
    return F.trim(F.regexp_replace(F.regexp_replace(u, "\\+\\s*\\w+", ""), "/+", "/"))


def is_external(url: Column) -> Column:
    """FN-08"""
    return url.rlike("(?i)^https?://")


def external_domain(url: Column) -> Column:
    """FN-08: authority of an absolute URL as written, port included; null for others."""
    host = F.regexp_extract(url, "(?i)^https?://([^/]+)", 1)
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path of a URL without host, query, fragment and trailing slashes."""
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "(?i)^https?://[^/]*", ""), "/+$", "")
    return F.when(p == "", "/").otherwise(p)


def normalize_segment(segment: Column) -> Column:
    """FN-09: without a version suffix and a file extension."""
    return F.regexp_replace(F.regexp_replace(segment, "\\.v\\d+$", ""), "(?i)\\.(json|xml|html|csv|pdf)$", "")


def is_param(segment: Column) -> Column:
    """FN-09: {name} or :name."""
    return segment.startswith("{") | segment.startswith(":")


def tidy_path(url: Column) -> Column:
    """Repeated slashes as one, then one trailing slash and the query gone."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "/+", "/"), "/$", ""), "\\?.*$", "")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def match_score(front: Column, front_raw: Column, front_parts: Column, back: Column, back_parts: Column) -> Column:
    """FN-10: 0 to 100. Tidy texts, raw segments of the URL, normalized segments of both.

    Equal: 100. Segments align whole, or the shorter with the longer's end; a parameter counts 0.8 and a difference rules out
    an alignment at the end. Weights: 100 for equal lengths, 85 behind a base placeholder, 70 and 65 for a longer URL or path."""
    nf, nb = F.size(front_parts), F.size(back_parts)
    points = lambda a, b: F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).when(is_param(y) | is_param(x), 0.8).otherwise(0.0))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    whole = lambda p: ~F.exists(p, lambda x: x == 0)
    literal = lambda p: F.exists(p, lambda x: x == 1)
    tail = lambda a, n: F.slice(a, F.size(a) - n + 1, n)
    behind = F.slice(front_parts, 2, F.greatest(nf - 1, F.lit(0)))
    based = points(behind, tail(back_parts, F.size(behind)))
    equal, longer, shorter = points(front_parts, back_parts), points(tail(front_parts, nb), back_parts), points(front_parts, tail(back_parts, nf))
    fs, bs = F.array_join(front_parts, "/"), F.array_join(back_parts, "/")
    return (
        F.when(front == back, 100.0).when((nb <= 1) & (nf > 2), 0.0)
        .when(F.get(front_raw, 0) == "{base}", F.when((nf > 1) & (nb >= nf - 1), F.when(whole(based), total(based) / (nf - 1) * 85).otherwise(0.0)).otherwise(0.0))
        .when(nf == nb, F.when((nf > 1) & ~literal(equal), 0.0).when(nf > 0, total(equal) / nf * 100).otherwise(0.0))
        .when((nf > 0) & (nb >= 2) & (fs.contains(bs) | bs.contains(fs)) & (F.least(nf, nb) / F.greatest(nf, nb) >= 0.5), 60.0)
        .when((nf > nb) & (nb >= 2), F.when(whole(longer) & literal(longer), total(longer) / nb * 70).otherwise(0.0))
        .when((nb > nf) & (nf >= 2), F.when(whole(shorter) & literal(shorter), total(shorter) / nf * 65).otherwise(0.0))
        .otherwise(0.0)
    )


def class_base(name: Column) -> Column:
    """FN-11: without the suffix of its kind, in lower case."""
    return F.lower(F.regexp_replace(name, "(?i)(?:WsV\\d+|ServiceV\\d+|Ws|Handler|Action|Command|Controller|Resource|Endpoint)$", ""))


def operation_score(operation: Column, class_name: Column) -> Column:
    """FN-11: 90 equal, 80 or 70 one within the other (80 from six tenths of the length on), else 0."""
    o, c = F.lower(operation), class_base(class_name)
    ratio = F.least(F.length(o), F.length(c)) / F.greatest(F.length(o), F.length(c))
    return F.when(o.isNull() | c.isNull(), None).when(o == c, 90).when(~(o.contains(c) | c.contains(o)), 0).when(ratio >= 0.6, 80).otherwise(70)


def operation_of_url(url: Column) -> Column:
    """FN-11: the last segment in camel case, five letters or more, without its version; null if none."""
    parts = F.transform(F.filter(segments(F.regexp_replace(url, "\\?.*$", "")), lambda x: ~is_param(x)), lambda x: F.regexp_replace(x, "(?i)\\.v\\d+$", ""))
    return F.get(F.reverse(F.filter(parts, lambda x: x.rlike("^[a-z][a-zA-Z]{4,}$") & x.rlike("[A-Z]"))), 0)


def entity_of_operation(operation: Column) -> Column:
    """FN-12: struct(entity, cardinality) from what follows the verb; null without a verb or with under three letters."""
    rest = F.lower(F.regexp_replace(F.regexp_replace(operation, LEADING_VERB, ""), "(?i)V\\d+$", ""))
    entity = F.when(rest.endswith("ies"), F.regexp_replace(rest, "ies$", "y")).when(rest.rlike("(ses|xes|zes|ches|shes)$"), F.regexp_replace(rest, "es$", "")).when(rest.rlike("s$") & ~rest.rlike("ss$"), F.regexp_replace(rest, "s$", "")).otherwise(rest)
    kind = F.when(entity == rest, "single").otherwise("collection")
    return F.when(operation.rlike(LEADING_VERB) & (F.length(rest) >= 3), F.struct(entity.alias("entity"), kind.alias("cardinality")))


def convention_verb(operation: Column) -> Column:
    """FN-13: struct(http_method, operation) of a convention endpoint; nulls for unknown verbs."""
    method = operation_class = F
    for pattern, verb, kind in CONVENTION_VERBS:
        method, operation_class = method.when(operation.rlike(pattern), verb), operation_class.when(operation.rlike(pattern), kind)
    return F.struct(method.alias("http_method"), operation_class.alias("operation"))


def class_key(node_id: Column, node_type: Column | None = None) -> Column:
    """FN-14: the class of a node id: entities lose their member, methods their name and parameters."""
    pre = F.substring_index(node_id, "(", 1)
    method = F.when(F.instr(node_id, "(") == 0, node_id).when(F.instr(pre, ".") > 1, F.regexp_replace(pre, "\\.[^.]*$", "")).otherwise(pre)
    if node_type is None:
        return method
    return F.when((node_type == "ENTITY") & node_id.contains("::"), F.substring_index(node_id, "::", 1)).when((node_type == "ENTITY") & node_id.contains("#"), F.substring_index(node_id, "#", 1)).otherwise(method)


def qualified_name(key: Column) -> Column:
    """What follows the stereotype of a class key."""
    return F.regexp_replace(key, "^[^:]*:", "")


def class_name(key: Column) -> Column:
    """FN-14"""
    return F.coalesce(F.get(F.reverse(F.filter(F.split(qualified_name(key), "\\."), lambda x: x != "")), 0), qualified_name(key))


def name_suffixes(path: Column) -> Column:
    """FN-15: dotted suffixes of a source path without its extension, the longest first."""
    parts = F.filter(F.split(F.regexp_replace(path, "(?i)\\.(?:java|kt|kts|scala|groovy|tsx?|jsx?|mts|cts)$", ""), "[/\\\\]"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


def camel_segments(name: Column) -> Column:
    """FN-16"""
    return F.regexp_extract_all(name, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+"), 0)


def strong_symbols(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """FN-18: distinct camel-case or capitalized words (four letters or more) without the caller's stopwords: words of a project's language that are no symbols."""
    found = F.regexp_extract_all(text, F.lit("\\b([A-Z][a-z]+(?:[A-Z][a-z0-9]+)+|[A-Z][a-z]{3,})\\b"), 1)
    return F.array_except(found, F.array(*map(F.lit, stopwords))) if stopwords else F.array_distinct(found)


def normalize_declaration(line: Column) -> Column:
    """FN-20: one space between words, without an opening brace or semicolon at the end."""
    return F.regexp_replace(F.regexp_replace(F.trim(line), "\\s+", " "), "\\s*[{;]\\s*$", "")


def git_sha(text: Column) -> Column:
    """FN-28: 40 hex digits, lower-cased, or null."""
    t = F.lower(F.trim(text))
    return F.when(t.rlike("^[0-9a-f]{40}$"), t)


def tier_confidence(tier: Column) -> Column:
    """FN-31"""
    out = F
    for name, value in TIER_CONFIDENCE.items():
        out = out.when(tier == name, value)
    return out.otherwise(0.5)


def root_segment(name: Column) -> Column:
    """FN-33: the first package segment of a dotted Java name; null for other names."""
    return F.when(name.rlike("^[A-Za-z_$][\\w$]*(?:\\.[A-Za-z_$][\\w$]*)+$"), F.substring_index(name, ".", 1))


def matches_glob(path: Column, glob: Column) -> Column:
    """FN-34: a leading dot asks for an ending, anything else for a part; no glob matches all."""
    return F.when(F.coalesce(glob, F.lit("")) == "", True).when(glob.startswith("."), path.endswith(glob)).otherwise(path.contains(glob))


def is_server_side(path: Column) -> Column:
    """FN-36"""
    built = F.lower(path).rlike("node_modules|dist/|build/")
    server = path.rlike("(?i)^(server|backend)/|/(server|backend|middlewares?|controllers?|services?|routes?|api)/")
    return ~built & server & ~path.rlike("/src/(views|pages|components|layouts)/")


def tokenized(value: Column) -> Column:
    """FN-17: lower-case words of a name in camel case or with separators, then those that end in s without it (four letters or more)."""
    parts = F.transform(F.filter(F.split(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+"), lambda x: x != ""), F.lower)
    singular = F.transform(F.filter(parts, lambda x: (F.length(x) > 3) & x.endswith("s")), lambda x: F.left(x, F.length(x) - 1))
    return F.array_join(F.concat(parts, singular), " ")


def is_comment(line: Column) -> Column:
    """FN-19: blank, or beginning with the mark of a comment."""
    return F.trim(line).rlike("^($|\\*|//|/\\*|#|<!--|-->)")


def masked_line(line: Column) -> Column:
    """FN-19: without its comments, and with the insides of strings as blanks; null for a comment. A mark inside of a string begins no comment."""
    return F.when(~is_comment(line), masked(line, comments=False))


def age_hours(at: Column, now: Column) -> Column:
    """FN-23: hours between two times, none below 0; null for an unknown one."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 3.6e9)


def iso_time(at: Column) -> Column:
    """FN-23, FN-29: ISO 8601 with milliseconds, UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


#: Folders of tests and builds, and folders that say nothing about the architecture.
TEST_FOLDER, BUILD_FOLDER = "(?i)^(tests?|__tests__|specs?|mocks?|__mocks__|fixtures?)$", "(?i)^(node_modules|dist|build|target)$"
BOILERPLATE = ("src", "main", "java", "com", "org")


def _folders(path: Column) -> Column:
    parts = segments(path)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def package_key(path: Column, depth: int = 2) -> Column:
    """FN-24: the first `depth` folders behind the boilerplate; "(raiz)" at the root, empty for tests."""
    parts = _folders(path)
    last = F.size(parts) - 1
    lead = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x.isin(*BOILERPLATE, "app"), 1).otherwise(0)).alias("n"), (s["on"] & x.isin(*BOILERPLATE, "app")).alias("on")), lambda s: s["n"])
    rest = F.array_join(F.slice(parts, F.least(lead, last) + 1, F.lit(depth)), "/")
    return F.when(F.size(parts) == 0, "(raiz)").when(F.exists(parts, lambda x: x.rlike(TEST_FOLDER)), "").otherwise(rest)


def component_key(path: Column) -> Column:
    """FN-24: the last two folders that say something; empty for tests and builds."""
    parts = _folders(path)
    last_two = lambda a: F.array_join(F.slice(a, F.greatest(F.size(a) - 1, F.lit(1)), F.lit(2)), "/")
    good = F.filter(parts, lambda x: ~x.isin(*BOILERPLATE))
    return F.when(F.exists(parts, lambda x: x.rlike(TEST_FOLDER) | x.rlike(BUILD_FOLDER)), "").when(F.size(good) > 0, last_two(good)).otherwise(last_two(parts))


def container_of(node_type: Column, stack: Column, path: Column) -> Column:
    """FN-24: db, frontend, backend, gateway or null."""
    t, s = F.upper(node_type), F.lower(F.coalesce(stack, F.lit("")))
    return F.when(t.isin("ENTITY", "SUPERTYPE"), "db").when(t.isin("VIEW", "COMPONENT", "COMPOSABLE") | s.rlike("vue|react|vite"), "frontend").when(s.rlike("spring|java"), "backend").when(s.rlike("express|node") | F.coalesce(path, F.lit("")).contains("services/gateway"), "gateway")


def route_domain(endpoint: Column, path: Column) -> Column:
    """FN-24: the first part of a route that is no parameter or version, behind `api`; else the file's folder, else "geral"."""
    parts = F.filter(segments(F.coalesce(endpoint, F.lit(""))), lambda x: ~x.startswith(":") & ~x.rlike("^v\\d+$"))
    files = segments(F.coalesce(path, F.lit("")))
    return F.when(F.size(parts) > 0, F.when(F.get(parts, 0) == "api", F.coalesce(F.get(parts, 1), F.lit("api"))).otherwise(F.get(parts, 0))).when(F.size(files) > 2, F.get(files, F.size(files) - 2)).otherwise("geral")


def safe_id(raw: Column) -> Column:
    """FN-27"""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "n").otherwise(s)


def clamp(value: Column, most: int = 40) -> Column:
    """FN-27: one space between words, cut with an ellipsis."""
    t = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "\\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most - 1)), F.lit("…"))).otherwise(t)


def diagram_confidence(method: Column, resolution: Column) -> Column:
    """FN-32"""
    proven = method.isin("STATIC_PROVEN", "CONFIG_PROVEN") | (resolution == "compiler")
    return F.when(method == "RUNTIME_OBSERVED", "observed").when(F.coalesce(proven, F.lit(False)), "proven").otherwise("inferred")


#: Roles and the types that older readers know them by.
LEGACY_TYPES = {"Controller": "CONTROLLER", "Service": "SERVICE", "Repository": "REPOSITORY", "Entity": "ENTITY", "View": "VIEW", "UiComponent": "COMPONENT", "Composable": "COMPOSABLE", "Route": "ROUTE"}


def legacy_type(role: Column) -> Column:
    """FN-35: fails on a role that isn't active."""
    out = F
    for name, value in LEGACY_TYPES.items():
        out = out.when(role == name, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("no type for role "), role)).cast("string"))


def repo_slug(url: Column) -> Column:
    """FN-37: owner/name of a repository's URL; null for others."""
    t = F.regexp_replace(F.trim(url), "\\.git$", "")
    m = F.nullif(F.regexp_extract(t, "[/:]([^/:\\s]+/[^/\\s]+)$", 1), F.lit(""))
    return F.coalesce(m, F.when(t.rlike("^[^/\\s]+/[^/\\s]+$"), t))


def bare_symbol(name: Column) -> Column:
    """FN-37"""
    return F.trim(F.element_at(F.split(name, "\\."), -1))


#: Tables that frameworks keep for themselves.
INFRASTRUCTURE = "^(databasechangelog|flyway_schema_history$|schema_migrations$|__drizzle_migrations$|qrtz_|shedlock$|scheduled_job_lock$|spring_session|session$|sessions$|oauth2?_|pg_)|_lock$"


def is_infrastructure(table: Column) -> Column:
    """PRJ-13"""
    return F.lower(F.trim(F.coalesce(table, F.lit("")))).rlike(INFRASTRUCTURE)


#: Handlers that change nothing but the screen.
UI_HANDLERS = (
    "stopPropagation", "preventDefault", "onChange", "onClose", "onBlur", "onFocus", "cancelSelection", "formatDate", "getSortIcon", "onCancel", "handleCancel", "copyToClipboard", "copyJsonToClipboard", "toggleRegistration", "handleDismiss",
    "handlePrev", "handleNext", "handleSkip", "handleSort", "handleReset", "handleCapture", "startCamera", "exportToCSV", "onBackToLogin", "toggleExtractedFields", "handleDataManagerOpen", "handleCancelEdit", "handleSelectAllProcesses", "onClick",
)
UI_PATTERN = "^set[A-Z]|^toggle[A-Z]|^on(Close|Cancel|Blur|Focus|Back|Dismiss)|^copy\\w*ToClipboard$|^(show|hide|open|close)[A-Z]|^handle(Cancel|Close|Dismiss|Back|Reset|Clear|Toggle)$"


def is_ui_only(endpoint: Column, category: Column, interaction: Column) -> Column:
    """PRJ-18"""
    handler = F.regexp_replace(interaction, "^(button|input|element|link): ", "")
    return F.when(F.coalesce(endpoint, F.lit("")) != "", False).otherwise(F.coalesce(category.isin("UI_ONLY", "STATE_ONLY"), F.lit(False)) | handler.rlike(UI_PATTERN) | handler.isin(*UI_HANDLERS))
