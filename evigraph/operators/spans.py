"""Balanced spans of source files, and what they show: routes, handlers and the tables they touch, schemas, Java types and beans.

Brackets are matched as a set operation: the marks of a file are rows, their depth is a running sum, and at one depth a bracket's partner is the
next one. Marks inside comments and strings don't count. files(path, content); positions are code points, from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.source import line_at, masked, without_generics
from evigraph.operators import runtime
from evigraph.operators.fixpoint import cut

#: Beyond every position.
FAR = (1 << 31) - 2
SCRIPT = "path rlike '[.](ts|tsx|js|jsx|mjs|cjs|vue)$'"
NAME = r"[A-Za-z_$][\w$]*"
#: Verbs of a router.
VERBS = ("get", "post", "put", "patch", "delete", "options", "head", "all")
#: Guards whose string arguments are roles, the first one in this order decides.
GUARDS = (
    "requirePermission", "requirePermissions", "requireRole", "requireRoles", "requireAnyRole", "requireTenantRole", "requireScope", "requiredScopes",
    "hasPermission", "hasRole", "hasAnyRole", "authorize", "checkPermission", "ensurePermission", "can",
)
#: Guards that stand for a role by their name alone.
BARE_GUARDS = {
    "requireAdmin": "admin", "requireSuperAdmin": "super_admin", "requireOwner": "owner", "requireSystemAdmin": "system_admin", "requireOrgAdmin": "org_admin", "requireTenantAdmin": "tenant_admin",
    "requireBillingAdmin": "billing_admin", "hasAdminRole": "admin", "requireSystemAccess": "system_access", "requireRebacAccess": "rebac", "requireGrantAccess": "grant", "hasAccess": "access",
    "requireValidationAuth": "system", "requireSystemAuth": "system", "requireSystemApiKey": "system", "requireSystemOwnApiKey": "system", "requireSystemCredentials": "system",
}


def marks(files: DataFrame, chars: str) -> DataFrame:
    """path, i, p, mark, head (the code before it, up to the mark before), level: brackets and separators out of `chars`, which may be ( ) { } [ ] , ;

    An opening bracket, its partner and the separators directly between them have one level."""
    some = "".join("\\" + c for c in chars)
    t = files.select("path", F.posexplode(F.regexp_extract_all(masked(F.col("content")), F.lit(f"[{some}]|[^{some}]+"), 0)).alias("i", "mark"))
    w = Window.partitionBy("path").orderBy("i")
    is_mark = F.col("mark").rlike(f"^[{some}]$")
    t = t.select("path", "i", "mark", (F.coalesce(F.sum(F.length("mark")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("int").alias("p"), F.lag("mark").over(w).alias("head"), is_mark.alias("is_mark"))
    step = F.when(F.col("mark").isin("(", "{", "["), 1).when(F.col("mark").isin(")", "}", "]"), -1).otherwise(0)
    t = t.where("is_mark").withColumn("step", step)
    depth = F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    level = F.when(F.col("step") < 0, depth + 1).otherwise(depth).cast("int")
    return t.select("path", "i", "p", "mark", F.when(F.length("head") > 1, F.col("head")).otherwise(F.when(~F.col("head").rlike(f"^[{some}]$"), F.col("head"))).alias("head"), level.alias("level"))


def groups(files: DataFrame, chars: str = "(){}[],", open_ended: bool = False) -> DataFrame:
    """path, start, end, opened (the bracket), head, level, after (start of the next group at that level, if nothing but code is between), parts
    (array of start and length, between separators); one row per closed bracket, and, if `open_ended`, per one that nothing closes, whose end is far beyond the file's."""
    w = Window.partitionBy("path", "level").orderBy("i")
    opens = F.col("mark").isin("(", "{", "[")
    t = marks(files, chars).withColumns({
        "start": F.last(F.when(opens, F.col("p")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "before": F.lag("p").over(w),
        "next": F.when(F.lead("mark").over(w).isin("(", "{", "["), F.lead("p").over(w)),
        "closes": F.col("mark").isin(")", "}", "]"),
    })
    part = F.when(~opens, F.struct((F.col("before") + 1).alias("start"), (F.col("p") - F.col("before") - 1).alias("length")))
    g = t.where("start is not null").groupBy("path", "level", "start").agg(
        F.max(F.when(F.col("closes"), F.col("p"))).alias("end"), F.max(F.when(opens, F.col("mark"))).alias("opened"), F.max(F.when(opens, F.col("head"))).alias("head"),
        F.max(F.when(F.col("closes"), F.col("next"))).alias("after"), F.array_sort(F.collect_list(part)).alias("parts"),
    )
    return g.withColumn("end", F.coalesce("end", F.lit(FAR))) if open_ended else g.where("end is not null")


def sliced(files: DataFrame, found: DataFrame, texts: dict[str, tuple[str, bool]], lines: dict[str, str] | None = None) -> DataFrame:
    """found(path, ...) with texts of its spans. texts: name -> (column with a start and a length, or an array of them; whether comments and strings
    are blanked); lines: name -> column with a position. A file's spans are brought to its text, which is never repeated."""
    lines = lines or {}
    others = [c for c in found.columns if c != "path"]
    per = found.groupBy("path").agg(F.collect_list(F.struct(*others)).alias("_spans"))
    j = per.join(files.select("path", "content"), "path").withColumn("_masked", masked(F.col("content")))

    def cut(span: Column, source: str) -> Column:
        return F.substr(F.col(source), span["start"], span["length"])

    def one(s: Column, column: str, source: str) -> Column:
        return F.transform(s[column], lambda x: cut(x, source)) if found.schema[column].dataType.typeName() == "array" else cut(s[column], source)

    rows = F.transform("_spans", lambda s: F.struct(*[s[c].alias(c) for c in others], *[one(s, c, "_masked" if blank else "content").alias(n) for n, (c, blank) in texts.items()], *[line_at(F.col("content"), s[c]).alias(n) for n, c in lines.items()]))
    return j.select("path", rows.alias("_rows")).select("path", F.explode("_rows").alias("_r")).select("path", "_r.*")


def _literal(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*['\"`]([^'\"`]*)['\"`]\s*$", 1), F.lit(""))


def _word(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, rf"^\s*({NAME})\s*$", 1), F.lit(""))


def script_groups(files: DataFrame) -> DataFrame:
    """groups() of the scripts among the files, as a table, since several operators look into them."""
    return cut(groups(files.where(SCRIPT)))


def route_calls(files: DataFrame, spans: DataFrame) -> DataFrame:
    """path, start, end, no, receiver, verb, args: calls of a router's verbs and of use(), over any number of lines."""
    call = rf"({NAME})\s*\.\s*([a-z]+)\s*$"
    f = files.where(SCRIPT).where(F.col("content").rlike(r"\bexpress\b|\bRouter\b|\.\s*use\s*\("))
    g = spans.join(f.select("path"), "path", "left_semi").where("opened = '('").withColumns({"receiver": F.regexp_extract("head", call, 1), "verb": F.regexp_extract("head", call, 2)}).where(F.col("verb").isin("use", *VERBS))
    g = g.withColumn("at", F.col("start") - F.length(F.regexp_extract("head", call, 0)))
    return sliced(f, g.select("path", "start", "end", "at", "receiver", "verb", "parts"), {"args": ("parts", False), "code": ("parts", True)}, {"no": "at"})


def routers(files: DataFrame) -> DataFrame:
    """path, receiver: variables that hold a router or an application."""
    made = rf"(?:const|let|var)\s+({NAME})\s*(?::\s*[^=;]+)?\s*=\s*(?:express\s*\(\s*\)|express\s*\.\s*Router\s*\(\s*\)|Router\s*\(\s*\))"
    return files.where(SCRIPT).select("path", F.explode(F.array_distinct(F.regexp_extract_all(masked(F.col("content")), F.lit(made), 1))).alias("receiver"))


def mounts(files: DataFrame, calls: DataFrame) -> DataFrame:
    """path, receiver, prefix: where a file mounts a variable, the first time; and where it mounts what it imports from a router's file."""
    m = calls.where("verb = 'use' and size(args) = 2").select("path", "start", _literal(F.col("args")[0]).alias("prefix"), _word(F.col("args")[1]).alias("receiver")).where("startswith(prefix, '/') and receiver is not null")
    return m.groupBy("path", "receiver").agg(F.min_by("prefix", "start").alias("prefix"))


def imported_prefixes(files: DataFrame, mounted: DataFrame) -> DataFrame:
    """module (path without its ending), far: the prefix at which another file mounts the router that it imports from there; the least one."""
    line = rf"(?m)^\s*import\s+({NAME})\s+from\s+['\"]\./([\w./-]+)['\"]"
    i = files.where(SCRIPT).select("path", F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(line), 1).alias("receiver"), F.regexp_extract_all("content", F.lit(line), 2).alias("target"))).alias("i")).select("path", "i.*")
    module = F.concat(F.regexp_replace("path", "[^/]*$", ""), F.regexp_replace("target", "[.](ts|js|mjs)$", ""))
    return i.join(mounted, ["path", "receiver"]).groupBy(module.alias("module")).agg(F.min("prefix").alias("far"))


def guards(files: DataFrame, spans: DataFrame, calls: DataFrame) -> DataFrame:
    """path, start (of the route's call), roles, expression: of the guard calls anywhere among a route's arguments the first one, in the order of the
    list, that names roles."""
    head = rf"\b({'|'.join(GUARDS)})\s*$"
    g = spans.where("opened = '('").withColumn("guard", F.regexp_extract("head", head, 1)).where("guard <> ''")
    g = g.select("path", F.col("start").alias("p"), "guard", F.struct((F.col("start") + 1).alias("start"), (F.col("end") - F.col("start") - 1).alias("length")).alias("inner"))
    g = sliced(files, g, {"text": ("inner", False)})
    ranges = calls.select(F.col("path").alias("doc"), F.col("start").alias("lo"), F.col("end").alias("hi"), F.col("start").cast("string").alias("name"))
    held = runtime.innermost(g.select(F.col("path").alias("doc"), "p"), ranges).select(F.col("doc").alias("path"), "p", F.col("name").cast("int").alias("start"))
    first = g.join(held, ["path", "p"]).groupBy("path", "start", "guard").agg(F.min_by("text", "p").alias("text"))
    first = first.withColumns({"roles": F.regexp_extract_all("text", F.lit("['\"`]([^'\"`]+)['\"`]"), 1), "rank": F.array_position(F.array(*map(F.lit, GUARDS)), F.col("guard"))}).where("size(roles) > 0")
    told = F.struct("roles", F.concat("guard", F.lit("("), F.trim("text"), F.lit(")")).alias("expression"))
    return first.groupBy("path", "start").agg(F.min_by(told, "rank").alias("t")).select("path", "start", "t.*")


def routes(files: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """EXT-09: path, no, start, end, http_method, endpoint, router, roles, expression, handler (a name, null for one written in place).

    A route is a verb of a variable that holds a router, with its path as first argument. Its own paths lie under the prefix at which its file
    mounts the variable, else under that at which a file that imports the router mounts it."""
    spans = script_groups(files) if spans is None else spans
    calls = cut(route_calls(files, spans))
    r = calls.join(routers(files), ["path", "receiver"])
    mounted = mounts(files, calls)
    own = r.where("verb <> 'use'").withColumn("own", F.regexp_extract(F.col("args")[0], r"^\s*['\"`]([^'\"`]*)['\"`]\s*$", 1)).where(F.col("args")[0].rlike(r"^\s*['\"`][^'\"`]*['\"`]\s*$"))
    j = own.join(mounted, ["path", "receiver"], "left").withColumn("module", F.regexp_replace("path", "[.](ts|js|mjs)$", "")).join(imported_prefixes(files, mounted), "module", "left")
    whole = F.regexp_replace(F.concat(F.coalesce("prefix", "far", F.lit("")), F.lit("/"), "own"), "/{2,}", "/")
    endpoint = F.when(F.length(whole) > 1, F.regexp_replace(whole, "/$", "")).otherwise(whole)
    j = j.join(guards(files, spans, own), ["path", "start"], "left")
    bare = [F.when(F.array_join("code", ",").rlike(rf"\b{g}\b"), F.struct(F.array(F.lit(role)).alias("roles"), F.lit(g).alias("expression"))) for g, role in BARE_GUARDS.items()]
    j = j.withColumn("bare", F.coalesce(*bare))
    handler = F.when(F.size("args") > 1, _word(F.element_at("code", -1)))
    return j.select("path", "no", "start", "end", F.upper("verb").alias("http_method"), endpoint.alias("endpoint"), F.col("receiver").alias("router"), F.coalesce("roles", "bare.roles", F.array().cast("array<string>")).alias("roles"), F.coalesce("expression", "bare.expression").alias("expression"), handler.alias("handler"))


def functions(g: DataFrame) -> DataFrame:
    """path, name, start, end: bodies of named functions and of arrow functions that a constant holds. g: script_groups()."""
    named = F.coalesce(F.nullif(F.regexp_extract("head", rf"\bfunction\s*\*?\s*({NAME})\s*$", 1), F.lit("")), F.nullif(F.regexp_extract("head", rf"\b(?:const|let|var)\s+({NAME})\s*=\s*(?:async\s*)?$", 1), F.lit("")))
    heads = g.where("opened = '('").withColumn("name", named).where("name is not null and after is not null").select("path", "level", F.col("after").alias("start"), "name")
    return heads.join(g.where("opened = '{'").select("path", "level", "start", "end"), ["path", "level", "start"]).select("path", "name", "start", "end")


def touches(files: DataFrame, spans: DataFrame, tables: DataFrame) -> DataFrame:
    """path, p, table, access: places that read or write a table of a schema (tables: table, variable)."""
    call = r"\.\s*(from|insert|update|delete)\s*$"
    g = spans.where("opened = '(' and size(parts) = 1").withColumn("how", F.regexp_extract("head", call, 1)).where("how <> ''")
    t = sliced(files, g.select("path", F.col("start").alias("p"), "how", "parts"), {"args": ("parts", True)}).withColumn("variable", _word(F.col("args")[0])).where("variable is not null")
    return t.join(tables.select("table", "variable"), "variable").select("path", "p", "table", F.when(F.col("how") == "from", "read").otherwise("write").alias("access"))


def _held_by(found: DataFrame, units: DataFrame) -> DataFrame:
    at = runtime.innermost(found.select(F.col("path").alias("doc"), "p"), units.select(F.col("path").alias("doc"), F.col("start").alias("lo"), F.col("end").alias("hi"), "name"))
    return found.join(at.select(F.col("doc").alias("path"), "p", "name"), ["path", "p"])


def handler_tables(files: DataFrame, tables: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """EXT-10: path, handler, table, access: what the body of a named function touches, by the innermost function around it."""
    spans = script_groups(files) if spans is None else spans
    return _held_by(touches(files, spans, tables), functions(spans)).select("path", F.col("name").alias("handler"), "table", "access").distinct()


def route_tables(files: DataFrame, tables: DataFrame) -> DataFrame:
    """EXT-10: path, no, http_method, endpoint, table, access: what a route touches in place, or in the function of its file that it names."""
    spans = script_groups(files)
    r = cut(routes(files, spans))
    found = cut(touches(files, spans, tables))
    inline = _held_by(found, r.select("path", "start", "end", F.col("start").cast("string").alias("name"))).select("path", F.col("name").cast("int").alias("start"), "table", "access").join(r, ["path", "start"])
    called = r.where("handler is not null").join(handler_tables(files, tables, spans), ["path", "handler"])
    columns = ["path", "no", "http_method", "endpoint", "table", "access"]
    return inline.select(columns).unionByName(called.select(columns)).distinct()


def schema_tables(files: DataFrame) -> DataFrame:
    """EXT-12: path, variable, table, columns of the tables that a schema file declares, however nested the columns' definitions are."""
    declared = rf"\bconst\s+({NAME})\s*(?::[^=]+)?=\s*(?:pg|mysql|sqlite)Table\s*$"
    g = script_groups(files)
    t = g.where("opened = '('").withColumn("variable", F.regexp_extract("head", declared, 1)).where("variable <> '' and size(parts) > 1")
    t = t.select("path", "variable", "start", "end", "level", F.col("parts")[0].alias("first"))
    braces = g.where("opened = '{'").select("path", F.col("start").alias("p"), "level", "parts")
    held = runtime.innermost(braces.select(F.col("path").alias("doc"), "p"), t.select(F.col("path").alias("doc"), F.col("start").alias("lo"), F.col("end").alias("hi"), F.col("start").cast("string").alias("name")))
    held = held.select(F.col("doc").alias("path"), "p", F.col("name").cast("int").alias("start")).join(braces, ["path", "p"]).withColumn("level", F.col("level") - 1)
    body = held.groupBy("path", "start", "level").agg(F.min_by("parts", "p").alias("columns_at"))
    j = sliced(files, t.join(body, ["path", "start", "level"]), {"name": ("first", False), "parts": ("columns_at", False)})
    columns = F.filter(F.transform("parts", lambda x: F.regexp_extract(x, r"^\s*(?://[^\n]*\s*|/\*[\s\S]*?\*/\s*)*['\"]?\w+['\"]?\s*:\s*\w+\s*\(\s*['\"](\w+)['\"]", 1)), lambda x: x != "")
    return j.select("path", "variable", _literal(F.col("name")).alias("table"), F.array_join(columns, ",").alias("columns")).where("table is not null")


_ANNOTATION = r"@(?!interface\b)(\w+)(?:\s*\([^()]*\))?"


def _java(files: DataFrame) -> DataFrame:
    """path, start, end, head of the braces of Java files; the head reaches back to the last brace or semicolon."""
    return groups(files.where("endswith(path, '.java')"), "{};", open_ended=True).select("path", "start", "end", "level", without_generics(F.col("head")).alias("head"))


def java_types(files: DataFrame) -> DataFrame:
    """EXT-33: path, fqn, kind, outer, parent, interfaces, annotations, supers, start, end of all types that Java files declare, nested ones under
    the name of what holds them."""
    kind = r"(?:^|[^\w.@])(class|interface|enum|record)\s+(\w+)|(@interface)\s+(\w+)"
    g = _java(files).where(F.col("head").rlike(kind))
    name = F.concat(F.regexp_extract("head", kind, 2), F.regexp_extract("head", kind, 4))
    package = files.select("path", F.nullif(F.regexp_extract(masked(F.col("content")), r"\bpackage\s+([\w.]+)\s*;", 1), F.lit("")).alias("package"))
    t = g.select("path", "start", "end", "head", name.alias("name"), F.when(F.col("head").rlike("@interface"), "annotation").otherwise(F.regexp_extract("head", kind, 1)).alias("kind"))
    around = t.select("path", F.col("start").alias("s"), F.col("end").alias("e"), F.col("name").alias("n"))
    chain = t.join(around, "path").where("s <= start and end <= e").groupBy("path", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "n"))), lambda x: x["n"]).alias("names"))
    listed = lambda word, stop: F.filter(F.transform(F.split(F.regexp_extract("head", rf"\b{word}\s+(.*?)\s*(?:\b(?:{stop})\b.*)?$", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    t = t.withColumn("head", F.regexp_replace("head", r"\s+", " ")).withColumns({"extended": listed("extends", "implements|permits"), "interfaces": listed("implements", "permits"), "annotations": F.array_sort(F.array_distinct(F.regexp_extract_all("head", F.lit(_ANNOTATION), 1)))})
    t = t.join(chain, ["path", "start"]).join(package, "path")
    dotted = lambda names: F.array_join(names, ".")
    outer = F.slice("names", 1, F.size("names") - 1)
    simple = F.array_distinct(F.transform(F.concat("extended", "interfaces"), lambda x: F.element_at(F.split(x, r"\."), -1)))
    return t.select(
        "path", F.concat_ws(".", "package", dotted(F.col("names"))).alias("fqn"), "kind", F.when(F.size("names") > 1, F.concat_ws(".", "package", dotted(outer))).alias("outer"),
        F.when(F.col("kind") == "class", F.get("extended", F.lit(0))).alias("parent"), "interfaces", "annotations", simple.alias("supers"), "start", "end",
    )


def java_beans(files: DataFrame) -> DataFrame:
    """EXT-33: path, holder, method, returns, concrete, is_primary: factory methods of beans. What one makes is the first type that its body returns new,
    else makes new, else the type of the parameter that it returns; null if that is what it says it returns."""
    sign = r"(?:^|\s)([\w.]+)\s+(\w+)\s*\(([^;{]*)\)\s*(?:throws\s+[\w.,\s]+)?$"
    bare = F.trim(F.regexp_replace("head", r"@\w+(?:\s*\([^()]*\))?", " "))
    b = _java(files).where(F.col("head").rlike(r"@Bean\b")).withColumns({"bare": bare, "annotations": F.regexp_extract_all("head", F.lit(_ANNOTATION), 1)}).where(F.col("bare").rlike(sign))
    b = b.select("path", "start", "end", *[F.regexp_extract("bare", sign, i).alias(n) for i, n in enumerate(("type", "method", "params"), 1)], F.array_contains("annotations", "Primary").alias("is_primary"), F.struct("start", (F.col("end") - F.col("start") + 1).alias("length")).alias("body"))
    b = sliced(files, b.where("type <> 'void'"), {"code": ("body", True)}).withColumnRenamed("start", "p")
    last = lambda x: F.element_at(F.split(x, r"\."), -1)
    found = lambda p: F.nullif(F.regexp_extract("code", p, 1), F.lit(""))
    back = found(r"\breturn\s+([A-Za-z_]\w*)\s*;")
    words = F.transform(F.split("params", ","), lambda x: F.split(F.trim(x), r"\s+"))
    of_param = F.filter(words, lambda w: (F.size(w) > 1) & (F.element_at(w, -1) == back))
    concrete = F.coalesce(found(r"\breturn\s+new\s+([\w.]+)"), found(r"\bnew\s+([\w.]+)\s*[<(]"), F.get(F.get(of_param, F.lit(0)), F.size(F.get(of_param, F.lit(0))) - 2))
    types = java_types(files).select("path", "start", "end", F.col("fqn").alias("name"))
    b = _held_by(b, types)
    return b.select("path", F.col("name").alias("holder"), "method", last(F.col("type")).alias("returns"), F.nullif(last(concrete), last(F.col("type"))).alias("concrete"), "is_primary")
