"""Classification of catalog entries, nodes and interactions, lenses over edges, and reports made of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.operators import evidence

#: Producer types -> (role, layer).
ROLES = {
    "CONTROLLER": ("Controller", "api"), "SERVICE": ("Service", "domain"), "REPOSITORY": ("Repository", "data"), "ENTITY": ("Entity", "data"),
    "VIEW": ("View", "presentation"), "COMPONENT": ("UiComponent", "presentation"), "COMPOSABLE": ("Composable", "presentation"), "ROUTE": ("Route", "api"),
}
#: Criticality of an operation before its entities count; others have 20.
BASE_CRITICALITY = {"DELETE": 60, "WRITE": 40, "CREATE": 40, "UPDATE": 45, "STATE_CHANGE": 50, "AUTHENTICATION": 80, "EXTERNAL_INTEGRATION": 70, "FILE_IO": 55, "EXPORT": 30, "READ": 10, "CLIENT_STATE": 2, "NAVIGATION": 5}
#: How an operation reads in a sentence; others are "Access".
VERB_TEXT = {"READ": "View", "WRITE": "Create", "CREATE": "Create", "UPDATE": "Update", "DELETE": "Delete", "STATE_CHANGE": "Modify", "CLIENT_STATE": "Toggle", "EXPORT": "Export", "FILE_IO": "Process file for", "EXTERNAL_INTEGRATION": "Integrate with", "AUTHENTICATION": "Authenticate", "NAVIGATION": "Navigate to"}
SENSITIVE_ENTITY = "user|auth|token|password|credential|payment|invoice|order|transaction|role|permission|session"
CLIENT_STATE = "(?i)^(set|toggle|reset|clear|show|hide|open|close|enable|disable|expand|collapse)."
AUTH_ACTION = "login|logout|signin|signout|signup|register|authenticate|authorize|resetpassword|forgotpassword|changepassword|verifyemail|confirmemail|resendemail|refreshtoken"
FILE_ACTION = "upload|download|import|export|selectfile|choosefile|openfile|savefile"
#: Types and relations that the lenses ask for.
SENSITIVE_TYPES, DATA_TYPES, DATA_RELATIONS, BUSINESS_TYPES = "(?i)AUTH|PERMISSION|SECURITY|TOKEN|CREDENTIAL", "(?i)ENTITY|REPOSITORY|TABLE|MODEL", "(?i)READS|WRITES", "(?i)CONTROLLER|ENDPOINT|SCREEN|ROUTE|COMPONENT|PAGE"
#: Class names of operation endpoints and of action controllers.
WS_CLASS = "(?i)(?:WsV\\d+|ServiceV\\d+|Ws)$"
VERB_ENTITY = "^(?:Find|Create|Update|Delete|Save|List|Get|Set|Remove|Restore|Overwrite|Import|Export|Revoke|Grant|Apply|Validate|Generate|Calculate|Process|Check|Search|Upload|Download|Send|Activate|Deactivate|Toggle|Execute|Cancel|Approve|Reject)[A-Z]"
MVC_NAME = "(?i)Servlet|Action|Controller|Bean|Managed|Faces|Struts"


def _lookup(column: Column, values: dict, other) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(column == k, v)
    return out.otherwise(other)


def operation_of_entry() -> Column:
    """PRJ-08: of (http_method, interaction): by method if there is one, else by the name of the action."""
    m = F.upper("http_method")
    inter = F.coalesce("interaction", F.lit(""))
    named = F.regexp_extract(inter, ":\\s*(\\w+)", 1)
    name = F.when(named != "", named).otherwise(inter)
    action = F.when(name.rlike(CLIENT_STATE), "CLIENT_STATE").when(F.lower(name).rlike(AUTH_ACTION), "AUTHENTICATION")
    moves = F.lower(name).rlike("navigate|redirect|goto|goback|pushstate|replacestate|openurl|openlink|opentab") | F.lower(inter).rlike("window\\.location|router\\.|history\\.push|href|routerlink")
    action = action.when(moves, "NAVIGATION").when(F.lower(name).rlike(FILE_ACTION), "FILE_IO").otherwise("NAVIGATION")
    by_method = F.when(m == "GET", "READ").when(m.isin("POST", "PUT"), "WRITE").when(m == "PATCH", "STATE_CHANGE").when(m == "DELETE", "DELETE").otherwise("NAVIGATION")
    return F.when(F.coalesce(m, F.lit("")) != "", by_method).otherwise(action)


def classified(entries: DataFrame) -> DataFrame:
    """PRJ-08: entries(entry_id, technical_operation, http_method, interaction, screen, endpoint, controller_method, entities,
    persistence) -> entry_id, operation, criticality (0 to 100), meaning."""
    given = F.coalesce("technical_operation", F.lit("UNKNOWN"))
    e = entries.withColumn("operation", F.when(given == "UNKNOWN", operation_of_entry()).otherwise(given))
    n = F.size("entities")
    base = _lookup(F.col("operation"), BASE_CRITICALITY, 20) + F.least(n * 5, F.lit(15)) + F.when(F.exists("entities", lambda x: F.lower(x).rlike(SENSITIVE_ENTITY)), 15).otherwise(0)
    floor = lambda word, least: F.when(F.exists("persistence", lambda x: F.lower(x).contains(word)), least).otherwise(0)
    score = F.least(F.lit(100), F.greatest(base, floor("delete", 60), floor("save", 35)))
    verb, names = _lookup(F.col("operation"), VERB_TEXT, "Access"), F.array_join("entities", ", ")
    meaning = F.when((n > 0) & (F.col("controller_method") != ""), F.concat(verb, F.lit(" "), names, F.lit(" via "), "controller_method")).when(n > 0, F.concat(verb, F.lit(" "), names)).when(F.col("endpoint") != "", F.concat(verb, F.lit(" "), "endpoint")).otherwise(F.concat("interaction", F.lit(" on "), "screen"))
    return e.select("entry_id", "operation", score.cast("long").alias("criticality"), meaning.alias("meaning"))


def operation_type(service_methods: str, repository_methods: str, http_method: str, persistence: str) -> Column:
    """PRJ-09: DELETE, CREATE, UPDATE, EXPORT, READ or UNKNOWN from what an endpoint calls, else from its method."""
    methods = F.transform(F.concat(service_methods, repository_methods), F.lower)
    ops = F.transform(persistence, F.lower)
    some = lambda p: F.exists(methods, lambda x: x.rlike(p))
    saves = F.array_contains(ops, "save") | F.array_contains(ops, "state_change")
    m = F.upper(http_method)
    return (
        F.when(F.array_contains(ops, "delete") | some("delete|remove"), "DELETE").when(saves & (F.col(http_method) == "POST"), "CREATE").when(saves & F.col(http_method).isin("PUT", "PATCH"), "UPDATE")
        .when(some("create|add|insert"), "CREATE").when(some("update|edit|modify|toggle|change"), "UPDATE").when(some("export|download|csv"), "EXPORT").when(some("find|get|list|fetch|search"), "READ")
        .when(m == "GET", "READ").when(m == "POST", "CREATE").when(m.isin("PUT", "PATCH"), "UPDATE").when(m == "DELETE", "DELETE").otherwise("UNKNOWN")
    )


def structural_confidence(hops: str, controller: str, repository_methods: str) -> Column:
    """PRJ-10: of the files on the path from a call to its endpoint (array); null without a path."""
    real = F.size(F.filter(hops, lambda x: (x != "") & (x != "unknown")))
    score = F.lit(0.3) + F.when(F.col(controller).isNotNull(), 0.35).otherwise(0.0) + F.when(F.size(repository_methods) > 0, 0.2).otherwise(0.0) + F.when(real == 1, 0.15).when(real == 2, 0.1).when(real >= 3, 0.05).otherwise(0.0)
    return F.when(F.size(hops) > 0, F.least(F.lit(1.0), F.floor(score * 100 + 0.5) / 100))


def canonical_role(nodes: DataFrame) -> DataFrame:
    """PRJ-06: nodes(id, type, source_file, http) of known types -> role, layer, stack, evidence, confidence."""
    role, layer = _lookup(F.col("type"), {k: v[0] for k, v in ROLES.items()}, None), _lookup(F.col("type"), {k: v[1] for k, v in ROLES.items()}, None)
    n = nodes.select("id", "http", F.nullif("source_file", F.lit("")).alias("sf"), role.alias("role"), layer.alias("layer")).where("role is not null")
    p, r = F.lower("sf"), F.col("role")
    stack = F.when(p.endswith(".vue"), "vue").when(p.endswith(".java"), "spring").when(r.isin("View", "UiComponent", "Composable"), "vue").when(r == "Route", "express").when(p.endswith(".ts") | p.endswith(".js"), "node").otherwise("spring")
    agree = F.when(r == "Controller", F.when(p.rlike("controller|/web/|wsv1|resource"), True).when(p.rlike("/service|repositor|/entit"), False))
    agree = agree.when(r == "Service", F.when(p.contains("service"), True).when(p.rlike("controller|repositor|/entit"), False)).when(r == "Repository", F.when(p.contains("repositor"), True).when(p.rlike("controller|/service"), False))
    agree = agree.when(r == "Entity", F.when(p.rlike("/entit|/persistence/|/domain/|/model/"), True)).when(r == "View", F.when(~p.endswith(".vue"), False).when(p.rlike("/pages?/|/views?/"), True))
    agree = agree.when(r == "UiComponent", F.when(~p.endswith(".vue"), False).when(p.rlike("/components?/"), True)).when(r == "Composable", F.when(p.rlike("/composables?/") | F.col("sf").rlike("\\buse[A-Z]"), True)).when(r == "Route", F.when(p.contains("route"), True))
    kind = F.when((r == "Controller") & F.col("http"), "http-endpoint").when(agree, "path-corroborated").when(~agree, "path-conflict").otherwise("producer-type")
    out = n.select("id", "role", "layer", stack.alias("stack"), kind.alias("evidence"))
    return out.withColumn("confidence", F.when(F.col("evidence").isin("http-endpoint", "path-corroborated"), "high").when(F.col("evidence") == "path-conflict", "low").otherwise("medium"))


def backend_type(path: Column) -> Column:
    """PRJ-07"""
    return F.when(F.lower(path).rlike("/(repositor(y|ies)|repos?)/|repository\\.(js|ts|mjs|cjs)$"), "REPOSITORY").otherwise("SERVICE")


def lenses(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """PRJ-14: the edges that each persona looks at: (persona, src, dst, rel)."""
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("type").alias(f"{s}_type"), F.col("sensitive").alias(f"{s}_sensitive"), _lookup(F.col("type"), {k: v[1] for k, v in ROLES.items()}, None).alias(f"{s}_layer"))
    e = evidence.existing_edges(edges, nodes).join(side("src"), "src").join(side("dst"), "dst")
    either = lambda p: F.col("src_type").rlike(p) | F.col("dst_type").rlike(p)
    keep = {
        "dev": F.lit(True), "security": F.col("src_sensitive") | F.col("dst_sensitive") | either(SENSITIVE_TYPES), "data": either(DATA_TYPES) | F.col("rel").rlike(DATA_RELATIONS),
        "architect": F.coalesce(F.col("src_layer") != F.col("dst_layer"), F.lit(False)), "business": either(BUSINESS_TYPES), "impact": F.lit(True),
    }
    who = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), k) for k, c in keep.items())), lambda x: x.isNotNull())
    return e.select(F.explode(who).alias("persona"), "src", "dst", "rel")


def entry_points(nodes: DataFrame) -> DataFrame:
    """PRJ-17: nodes(id, type, seq, http_method, endpoint, triggers, observed) -> id, label, kind, observed.

    Routes are one per method and path: observed ones first, then runtime ids (the last of them), then the first."""
    parsed = lambda k: F.nullif(F.regexp_extract("id", "^route:(?:runtime:)?([A-Z]+):(.+)$", k), F.lit(""))
    n = nodes.withColumns({"m": F.coalesce("http_method", parsed(1)), "p": F.coalesce("endpoint", parsed(2)), "o": F.coalesce("observed", F.lit(False)), "is_route": F.upper("type").isin("CONTROLLER", "ROUTE") | F.startswith("id", F.lit("route:"))})
    name = F.concat("m", F.lit(" "), "p")
    runtime = F.contains("id", F.lit(":runtime:"))
    order = F.struct((~F.col("o")).alias("a"), (~runtime).alias("b"), F.when(runtime, -F.col("seq")).otherwise(F.col("seq")).alias("c"))
    routes = n.where("is_route").groupBy(F.coalesce(name, "id").alias("key")).agg(F.min_by(F.struct("id", "m", "p", "o"), order).alias("r"))
    routes = routes.select("r.id", F.coalesce(F.concat("r.m", F.lit(" "), "r.p"), "r.id").alias("label"), F.lit("route").alias("kind"), F.col("r.o").alias("observed"))
    trigger = F.get("triggers", 0)
    jobs = n.where("not is_route and size(triggers) > 0").select("id", F.concat(trigger, F.lit(" "), "id").alias("label"), F.when(trigger.rlike("(?i)schedul|cron|job"), "batch").otherwise("job").alias("kind"), F.col("o").alias("observed"))
    return routes.unionByName(jobs)


def missing_endpoints(interactions: DataFrame, least: float = 0.5) -> DataFrame:
    """SEC-07: interactions(seq, category, url, http_method, mapped, confidence) that call what no backend offers: one per method and URL, the first."""
    bad = interactions.where((F.col("category") == "HTTP") & (F.col("url") != "") & ~F.coalesce("mapped", F.lit(False)) & (F.coalesce("confidence", F.lit(1.0)) >= least))
    g = bad.groupBy(F.upper(F.coalesce("http_method", F.lit("ANY"))).alias("http_method"), "url").agg(F.min("seq").alias("seq"))
    return g.select("http_method", "url", "seq", F.when(F.col("http_method").isin("POST", "PUT", "PATCH", "DELETE"), "high").otherwise("medium").alias("severity"))


def architecture(controllers: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """EXT-28: one row (type, confidence) from shares of controllers(class_name, method_name, path, rest) and files(path)."""
    c = controllers.agg(
        F.count("*").alias("n"), F.count_if(F.col("method_name") == "handle").alias("handle"), F.count_if(F.col("class_name").rlike(WS_CLASS)).alias("ws"), F.count_if(F.col("class_name").rlike(VERB_ENTITY)).alias("verb"),
        F.count_if(F.coalesce("path", F.lit("")).isin("", "/")).alias("root"), F.count_distinct(F.nullif("method_name", F.lit(""))).alias("methods"), F.count_if(~F.col("rest") & F.col("class_name").rlike(MVC_NAME)).alias("mvc"),
    )
    pages = files.where(F.col("path").rlike("\\.(jsp|xhtml|jsf)$") | F.col("path").rlike(MVC_NAME)).agg(F.count("*")).scalar() if files is not None else F.lit(0)
    share = lambda k: F.col(k) / F.col("n")
    ws = _steps(share("handle"), (0.7, 0.35), (0.4, 0.15)) + _steps(share("ws"), (0.7, 0.3), (0.4, 0.15)) + _steps(share("verb"), (0.5, 0.2)) + _steps(share("root"), (0.7, 0.15))
    rest = _steps(share("methods"), (0.3, 0.3)) + _steps(1 - share("root"), (0.5, 0.35)) + _steps(1 - share("ws"), (0.7, 0.2))
    mvc = F.when(pages > 0, 0.4).otherwise(0.0) + F.when(F.col("mvc") > 0, 0.3).otherwise(0.0)
    s = c.select("n", F.round(ws, 2).alias("ws"), F.round(rest, 2).alias("rest"), F.round(mvc, 2).alias("mvc"))
    pick = lambda kind, score: F.struct(F.lit(kind).alias("type"), score.alias("confidence"))
    w, r, m = F.col("ws"), F.col("rest"), F.col("mvc")
    got = F.when(F.col("n") == 0, pick("EXTERNAL_API_GATEWAY", F.lit(0.9))).when((w >= 0.5) & (w >= m), pick("WS_OPERATION_BASED", w)).when((m >= 0.7) & (m > w), pick("MVC_ACTION_BASED", m)).when((w > r) & (w >= 0.5), pick("WS_OPERATION_BASED", w)).otherwise(pick("REST_CONTROLLER", F.when(r >= 0.3, r).otherwise(0.3)))
    return s.select(got.alias("g")).select("g.*")


def _steps(x: Column, *steps: tuple) -> Column:
    out = F
    for least, points in steps:
        out = out.when(x >= least, points)
    return out.otherwise(0.0)


def delivery_risk(changes: DataFrame, alerts: Column, fan_in: Column, group: str = "grp") -> DataFrame:
    """AGG-21: changes(grp, path, lines, alerts, fan_in) -> the level of each facet and the highest, per delivery.

    Churn: over 800 lines or 25 files high, over 200 or 8 medium. Entropy (three files or more): 0.85 high, 0.6 medium.
    Touched hub: 20 callers high, 5 medium. Sensitive paths: migrations and security high, one of them medium."""
    per = changes.groupBy(group, "path").agg(F.sum("lines").alias("n"), F.sum(alerts).alias("a"), F.max(fan_in).alias("f"))
    mig, sec = F.col("path").rlike("(?i)(^|/)(db/)?(migrations?|liquibase|flyway|changelog)s?/"), F.col("path").rlike("(?i)security|auth|permission|rbac|crypto|token|secret")
    g = per.groupBy(group).agg(F.sum("n").alias("lines"), F.count("*").alias("files"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2("n")).otherwise(0.0)).alias("s"), F.sum("a").alias("alerts"), F.max("f").alias("fan"), F.bool_or(mig).alias("mig"), F.bool_or(sec).alias("sec"))
    h = F.round((F.log2("lines") - F.col("s") / F.col("lines")) / F.log2("files"), 4)
    level = lambda high, mid: F.when(high, 2).when(mid, 1).otherwise(0)
    some = F.col("files") >= 3
    facets = {
        "breakage": level(F.col("alerts") > 0, F.lit(False)), "churn": level((F.col("lines") > 800) | (F.col("files") > 25), (F.col("lines") > 200) | (F.col("files") > 8)),
        "entropy": level(some & (h >= 0.85), some & (h >= 0.6)), "hub": level(F.col("fan") >= 20, F.col("fan") >= 5), "sensitive": level(F.col("mig") & F.col("sec"), F.col("mig") | F.col("sec")),
    }
    name = lambda x: F.when(x == 2, "high").when(x == 1, "medium").otherwise("low")
    return g.withColumns(facets).select(group, *(name(F.col(k)).alias(k) for k in facets), name(F.greatest(*facets)).alias("level"))


def drift(pairs: DataFrame) -> DataFrame:
    """STR-10: pairs(id, analyzed, deployed) of commits -> status and reason; a missing commit is unknown, never drift."""
    a = text.git_sha(F.col("analyzed"))
    status = F.when(a.isNull() | (F.coalesce("deployed", F.lit("")) == ""), "unknown").when(a == F.col("deployed"), "in-sync").otherwise("drift")
    reason = F.when(a.isNull(), "no-analyzed-sha").when(F.coalesce("deployed", F.lit("")) == "", "health-no-commit").when(a != F.col("deployed"), "sha-mismatch")
    return pairs.select("id", status.alias("status"), reason.alias("reason"))


def grounded(claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """GRA-24: claims(seq, anchor, text) -> seq, verdict: kept, empty-text, off-map or repeated (a later one of an anchor)."""
    proven = anchors.select("anchor").distinct().withColumn("known", F.lit(True))
    c = claims.withColumn("blank", F.trim(F.coalesce("text", F.lit(""))) == "").join(proven, "anchor", "left")
    usable = F.col("known") & ~F.col("blank")
    first = c.where(usable).groupBy("anchor").agg(F.min("seq").alias("first"))
    c = c.join(first, "anchor", "left")
    return c.select("seq", F.when(F.col("blank"), "empty-text").when(F.col("known").isNull(), "off-map").when(F.col("seq") == F.col("first"), "kept").otherwise("repeated").alias("verdict"))


def recent_history(runs: DataFrame, points: int = 90) -> DataFrame:
    """TOP-08: runs(run_id, status) that have ended, the newest `points` of them, in the order of time."""
    return runs.where("status in ('completed', 'failed')").orderBy(F.desc("run_id")).limit(points).orderBy("run_id")


def domain_evidence(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """UI-04: nodes(id, domain) -> per domain its size, touching edges (one within counts once), worst method and proven share (-1 without edges)."""
    d = nodes.select("id", "domain")
    e = evidence.edge_evidence(edges).join(d.toDF("src", "sd"), "src", "left").join(d.toDF("dst", "dd"), "dst", "left")
    touch = e.select(F.explode(F.array_distinct(F.filter(F.array("sd", "dd"), lambda x: x.isNotNull()))).alias("domain"), "method", "confidence")
    t = touch.groupBy("domain").agg(F.count("*").alias("edges"), F.min_by("method", "confidence").alias("worst"), F.count_if(F.col("method").isin(*evidence.PROVEN)).alias("proven"))
    sizes = d.groupBy("domain").agg(F.count("*").alias("size"))
    return sizes.join(t, "domain", "left").select("domain", "size", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), F.coalesce("worst", F.lit("UNKNOWN")).alias("worst"), F.coalesce(F.round(F.col("proven") / F.col("edges"), 6), F.lit(-1.0)).alias("proven_share"))


def center(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """UI-10: the node to begin a view with: twice the calls out and once those in, entry points and hot nodes ahead, pure sinks last; the least id on ties."""
    n = evidence.degrees(edges, nodes).join(nodes.select("id", "type", "runtime_hot"), "id")
    score = F.col("out_degree") * 2 + F.col("in_degree") + F.when(F.col("type").isin("CONTROLLER", "ROUTE", "SERVICE", "VIEW", "COMPONENT"), 100).otherwise(0) + F.when(F.col("runtime_hot"), 60).otherwise(0) - F.when((F.col("out_degree") <= 1) & (F.col("in_degree") >= 20), 500).otherwise(0)
    return n.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(1)


def operation_overlap(operations: DataFrame, verb: Column) -> DataFrame:
    """AGG-13: operations(operation, endpoint): (verb, entity, cardinality) that two or more different operations serve."""
    e = operations.select(verb.alias("verb"), text.entity_of_operation(F.col("operation")).alias("t"), "operation", "endpoint").where("verb <> 'OTHER' and t is not null")
    return e.groupBy("verb", "t.entity", "t.cardinality").agg(F.count_distinct("operation").alias("operations"), F.count_distinct("endpoint").alias("endpoints")).where("operations >= 2")


def inferred_backend(endpoint: Column) -> Column:
    """PRJ-16: struct(controller, entities) that a URL suggests: its parts behind `api`, placeholders and common actions left out."""
    parts = F.split(F.regexp_replace(endpoint, "^/", ""), "/")
    after = F.slice(parts, F.array_position(parts, "api").cast("int") + 1, F.size(parts))
    real = F.filter(after, lambda x: (x != "") & ~text.is_param(x) & (x != "api"))
    #: Parts that name actions, not entities.
    actions = "list all export import search count stats available-fields duplicate set-default analyze refresh chat discover-functionalities analyze-function-points resend-verification verify-email well-known openid-configuration".split()
    title = lambda x: F.array_join(F.transform(F.split(x, "-"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), "")
    nouns = F.filter(real, lambda x: ~F.lower(x).isin(*actions))
    entities = F.transform(nouns, lambda x: title(F.when(x.endswith("s") & (F.length(x) > 3), F.left(x, F.length(x) - 1)).otherwise(x)))
    controller = F.coalesce(F.concat(title(F.get(real, 0)), F.lit("Controller")), F.lit(""))
    return F.struct(controller.alias("controller"), F.array_distinct(F.filter(entities, lambda x: F.length(x) > 1)).alias("entities"))

