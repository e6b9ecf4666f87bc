"""EXT-22: the layers of a front end and of its gateway as nodes and edges.

A view calls components, these call composables, and all of them call endpoints or routes; a route calls the modules of its handler, and
the last of these touches tables. What may follow depends on the layer, so the walk is a sequence of joins on names, with
fixpoints where a layer calls itself (composables of composables, components in components).

Frames: files(seq, file, content), endpoints(seq, id, path), routes(seq, id, method, path). Nodes that `existing` holds are matched, others
minted. A null content is empty. Of files with one base name, and of exports with one name, the last by seq counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.operators import fixpoint

_ROOT = r"(^|/)(frontend|client)/src/"
SOURCE, LAYERS = _ROOT + r".*\.(vue|tsx|jsx|ts)$", _ROOT + "(api|composables)/"
API, COMPOSABLES = _ROOT + r"api/[\w-]+\.ts$", _ROOT + r"composables/.*\.ts$"
ROUTER = _ROOT + r"(router|routes|App)\.(ts|js|tsx|jsx)$"
SERVICE, NO_SERVICE = r"(^|/)server/services/.+\.(ts|js)$", r"\.(test|spec)\.|\.d\.ts$"
REPOSITORY = r"/(repositor(y|ies)|repos?)/|repository\.(js|ts|mjs|cjs)$"
WRITES = r"(?i)write|insert|update|delete|upsert"
EXPORT = r"export\s+(?:async\s+)?(?:function\s+(\w+)|const\s+(\w+)\s*=)"
IMPORT = r"""import\s*(?:type\s*)?\{([^}]+)\}\s*from\s*['"](?:@/|\.{1,2}/(?:\.\./)*)(api|composables)/([\w-]+)['"]"""
VUE_IMPORT = r"""import\s+\w+\s+from\s+['"]([^'"]+\.vue)['"]"""
CALL = r"(?<=[^\w.])(\w+)(?=\s*\()"
#: How a router names modules, and how it shows them.
NAMED = (r"""import\s+([A-Za-z_$][\w$]*)\s*(?:,\s*\{[^}]*\})?\s+from\s+['"]([^'"]+)['"]""", r"""(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:React\.)?lazy\s*\(\s*(?:async\s*)?\(\)\s*=>\s*import\s*\(\s*['"]([^'"]+)['"]""")
SHOWN = (r"component=\{\s*([A-Za-z_$][\w$]*)\s*\}", r"element\s*[=:]\s*\{?\s*<\s*([A-Za-z_$][\w$]*)", r"\b[Cc]omponent\s*:\s*([A-Za-z_$][\w$]*)")


def _base(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.(vue|tsx|jsx|ts|js)$", "")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _url_pattern(prefixes: tuple[str, ...]) -> str:
    return "(/(?:" + "|".join(r"\Q" + p.strip("/") + r"\E" for p in prefixes) + r")/[A-Za-z0-9_\-./${}:]*[A-Za-z0-9_\-.}])"


def first_route(urls: DataFrame, routes: DataFrame, by: tuple[str, ...] = (), holes: bool = True) -> DataFrame:
    """urls(*by, url), routes(*by, seq, id, path) -> *by, url, id: the first route with as many parts, each equal, a parameter of the route
    (`:x`) or, with `holes`, a part of the url that holds `${`. What stands behind a `?` doesn't count.

    Both sides are joined on the parts that neither leaves open: a side is repeated once for each pattern of open parts
    that occurs on the other side, and of the routes with one key only the first is joined."""
    parts = lambda c: F.filter(F.split(F.substring_index(c, "?", 1), "/"), lambda x: x != "")
    u = urls.select(*by, "url").distinct().withColumn("p", parts("url")).where(F.size("p") > 0)
    u = u.withColumn("um", F.transform("p", lambda x: F.contains(x, F.lit("${")) & F.lit(holes)))
    r = routes.select(*by, "seq", "id", parts("path").alias("p"))
    r = r.withColumn("rm", F.transform("p", lambda x: F.startswith(x, F.lit(":"))))
    key = F.transform("p", lambda x, i: F.when(~F.get("um", i) & ~F.get("rm", i), x).otherwise("")).alias("key")
    masks = lambda df, m: df.select(m, F.size(m).alias("n")).distinct()
    left = u.withColumn("n", F.size("p")).join(masks(r, "rm"), "n").select(*by, "url", "um", "rm", key)
    right = r.withColumn("n", F.size("p")).join(masks(u, "um"), "n").select(*by, "seq", "id", "um", "rm", key)
    right = right.groupBy(*by, "um", "rm", "key").agg(F.min(F.struct("seq", "id")).alias("m"))
    return left.join(right, [*by, "um", "rm", "key"]).groupBy(*by, "url").agg(F.min("m").alias("m")).select(*by, "url", "m.id")


def resolved(urls: DataFrame, endpoints: DataFrame, routes: DataFrame) -> DataFrame:
    """urls(url) -> url, target: the endpoint of that very path, the last one; else the first route that fits."""
    exact = endpoints.groupBy(F.col("path").alias("clean")).agg(F.max_by("id", "seq").alias("exact"))
    asked = urls.select("url").distinct().withColumn("clean", F.substring_index("url", "?", 1))
    j = asked.join(exact, "clean", "left").join(first_route(asked, routes), "url", "left")
    return j.select("url", F.coalesce("exact", "id").alias("target")).where("target is not null")


def routed_bases(files: DataFrame) -> DataFrame:
    """base: the modules that a router shows: every Vue file that it names, and imports that stand in a route."""
    router = files.where(F.col("file").rlike(ROUTER)).select("file", F.coalesce("content", F.lit("")).alias("content"))
    vue = router.select(F.explode(_all(F.col("content"), r"""['"]([^'"]+\.vue)['"]""")).alias("path"))
    named = None
    for order, pattern in enumerate(NAMED):
        found = router.select("file", F.posexplode(_all(F.col("content"), pattern, 0)).alias("pos", "text"))
        found = found.select("file", F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("path"), F.lit(order).alias("order"), "pos")
        named = found if named is None else named.unionByName(found)
    named = named.groupBy("file", "name").agg(F.max_by("path", F.struct("order", "pos")).alias("path"))
    shown = router.select("file", F.explode(F.array_distinct(F.concat(*[_all(F.col("content"), p) for p in SHOWN]))).alias("name"))
    return vue.unionByName(shown.join(named, ["file", "name"]).select("path")).select(_base(F.col("path")).alias("base")).where("base <> ''").distinct()


def _blocks(files: DataFrame) -> DataFrame:
    """seq, file, mod, pos, fn, body: a file from each export up to the next."""
    cut = files.select("seq", "file", _base(F.col("file")).alias("mod"), F.posexplode(F.split("content", f"(?={EXPORT})")).alias("pos", "body"))
    name = lambda i: F.nullif(F.regexp_extract("body", "^" + EXPORT, i), F.lit(""))
    return cut.withColumn("fn", F.coalesce(name(1), name(2))).where("fn is not null")


def _imports(files: DataFrame) -> DataFrame:
    """file, kind, mod, fn: named imports from the api and composable layers."""
    found = files.select("file", F.explode(_all(F.col("content"), IMPORT, 0)).alias("text"))
    part = lambda i: F.regexp_extract("text", IMPORT, i)
    names = found.select("file", part(2).alias("kind"), part(3).alias("mod"), F.explode(F.split(part(1), ",")).alias("name"))
    return names.select("file", "kind", "mod", F.trim(F.get(F.split(F.regexp_replace("name", r"^\s+", ""), r"\s+as\s+"), 0)).alias("fn")).where("fn <> ''").distinct()


def _used(bodies: DataFrame, imports: DataFrame, *keys: str) -> DataFrame:
    """keys, kind, amod, afn: what a body both imports (by its file) and calls."""
    calls = bodies.select(*dict.fromkeys((*keys, "file")), F.explode(F.array_distinct(_all(F.col("body"), CALL))).alias("afn"))
    return calls.join(imports.select("file", "kind", F.col("mod").alias("amod"), F.col("fn").alias("afn")), ["file", "afn"]).select(*keys, "kind", "amod", "afn")


def front_end(files: DataFrame, endpoints: DataFrame, routes: DataFrame, existing: DataFrame, prefixes: tuple[str, ...] = ("api",)) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): views, components and composables that reach an endpoint or a route, and what calls what.

    nodes(id, type, name, file, minted), edges(src, dst, convention, via). A view is a file that the router shows, or, where no file is
    a router, one below /pages/. Imported functions count if they are called. Composables inherit the urls of those that they call,
    the nearest first, until nothing changes; components that reach nothing are left out. Of equal edges the direct call stays."""
    url = _url_pattern(prefixes)
    files = files.select("seq", "file", F.coalesce("content", F.lit("")).alias("content")).where(F.col("file").rlike(SOURCE) | F.col("file").rlike(ROUTER))
    imports = fixpoint.cut(_imports(files))
    called = _blocks(files.where(F.col("file").rlike(API))).withColumn("url", F.regexp_extract("body", url, 1)).where("url <> ''")
    api = fixpoint.cut(called.groupBy(F.col("mod").alias("amod"), F.col("fn").alias("afn")).agg(F.max_by("url", F.struct("seq", "pos")).alias("url")))

    # composables: key, url, via
    name = F.concat("mod", F.lit("."), "fn")
    last = _blocks(files.where(F.col("file").rlike(COMPOSABLES))).groupBy(name.alias("key")).agg(F.max_by(F.struct("file", "body"), F.struct("seq", "pos")).alias("m"))
    bodies = fixpoint.cut(last.select("key", "m.file", "m.body"))
    used = fixpoint.cut(_used(bodies, imports, "key"))
    by_api = used.where("kind = 'api'").join(api, ["amod", "afn"]).select("key", "url", F.concat(F.lit("composables/"), "key", F.lit("→api/"), "amod", F.lit("."), "afn").alias("via"), F.lit(0).alias("rank"))
    inline = bodies.select("key", F.explode(_all(F.col("body"), url)).alias("url"), F.concat(F.lit("composables/"), "key", F.lit(":inline")).alias("via"), F.lit(1).alias("rank"))
    have = frontier = fixpoint.cut(by_api.unionByName(inline).groupBy("key", "url").agg(F.min_by("via", F.struct("rank", "via")).alias("via")).withColumn("depth", F.lit(0)))
    kids = used.where("kind = 'composables'").select(F.col("key").alias("parent"), F.concat("amod", F.lit("."), "afn").alias("key"))
    while True:
        up = kids.join(frontier, "key").select(F.col("parent").alias("key"), "url", F.concat(F.lit("composables/"), "parent", F.lit("→"), "via").alias("via"), (F.col("depth") + 1).alias("depth"))
        frontier = fixpoint.cut(up.groupBy("key", "url").agg(F.min("via").alias("via"), F.min("depth").alias("depth")).join(have, ["key", "url"], "left_anti"))
        if not frontier.take(1):
            break
        have = fixpoint.cut(have.unionByName(frontier))

    # files of pages and components: base, file, vue, routed
    routed = fixpoint.cut(routed_bases(files))
    pages = files.where(F.col("file").rlike(SOURCE) & ~F.col("file").rlike(LAYERS)).groupBy(_base(F.col("file")).alias("base")).agg(F.max_by(F.struct("file", "content"), "seq").alias("m")).select("base", "m.file", F.col("m.content").alias("body"))
    if routed.take(1):
        pages = pages.join(routed.withColumn("routed", F.lit(True)), "base", "left").withColumn("routed", F.coalesce("routed", F.lit(False)))
    else:
        pages = pages.withColumn("routed", F.col("file").rlike(r"/pages/.*\.(vue|tsx|jsx)$"))
    pages = fixpoint.cut(pages)
    uses = fixpoint.cut(_used(pages, imports, "base"))
    own = uses.where("kind = 'api'").join(api, ["amod", "afn"]).select("base", "url", F.concat(F.lit("api/"), "amod", F.lit("."), "afn").alias("via"), F.lit(0).alias("rank"))
    own = fixpoint.cut(own.unionByName(pages.select("base", F.explode(_all(F.col("body"), url)).alias("url"), F.lit("inline-url").alias("via"), F.lit(1).alias("rank"))))
    at = fixpoint.cut(resolved(own.select("url").unionByName(have.select("url")), endpoints, routes))
    direct = own.join(at, "url").groupBy("base", "target").agg(F.min_by("via", F.struct("rank", "via")).alias("via"))
    leads = fixpoint.cut(have.join(at, "url").groupBy("key", "target").agg(F.min_by("via", F.struct("depth", "via")).alias("via")))
    through = fixpoint.cut(uses.where("kind = 'composables'").select("base", F.concat("amod", F.lit("."), "afn").alias("key")).join(leads, "key", "left_semi").distinct())
    kinds = pages.select("base", "file", "routed")
    inner = pages.select("base", F.explode(F.array_distinct(F.transform(_all(F.col("body"), VUE_IMPORT), _base))).alias("child")).where("child <> base")
    inner = fixpoint.cut(inner.join(kinds.select(F.col("base").alias("child"), F.col("file").alias("child_file"), F.col("routed").alias("child_routed")), "child").where("not child_routed"))
    reaching = fixpoint.cut(fixpoint.reached(inner.select(F.col("child").alias("src"), F.col("base").alias("dst")), direct.select(F.col("base").alias("id")).unionByName(through.select(F.col("base").alias("id")))))
    held = fixpoint.cut(inner.where("endswith(child_file, '.vue')").join(reaching.withColumnRenamed("id", "child"), "child", "left_semi").select("base", "child"))
    views = kinds.where("routed").join(reaching.withColumnRenamed("id", "base"), "base", "left_semi")
    seen = fixpoint.cut(fixpoint.reached(held.toDF("src", "dst"), views.select(F.col("base").alias("id"))).withColumnRenamed("id", "base").join(kinds, "base"))

    who = seen.select("base", F.concat(F.when(F.col("routed"), "view:").otherwise("component:"), F.col("base")).alias("src"))
    minted = fixpoint.cut(through.join(seen, "base", "left_semi").select("key").distinct())
    edges = direct.join(who, "base").select("src", F.col("target").alias("dst"), F.lit("api-layer").alias("convention"), "via")
    edges = edges.unionByName(through.join(who, "base").select("src", F.concat(F.lit("composable:"), "key").alias("dst"), F.lit("frontend-chain").alias("convention"), F.lit(None).cast("string").alias("via")))
    edges = edges.unionByName(held.join(who, "base").select("src", F.concat(F.lit("component:"), "child").alias("dst"), F.lit("frontend-chain").alias("convention"), F.lit(None).cast("string").alias("via")))
    edges = edges.unionByName(leads.join(minted, "key").select(F.concat(F.lit("composable:"), "key").alias("src"), F.col("target").alias("dst"), F.lit("api-layer").alias("convention"), "via"))
    nodes = seen.select(F.when(F.col("routed"), "view:").otherwise("component:").alias("k"), F.when(F.col("routed"), "VIEW").otherwise("COMPONENT").alias("type"), F.col("base").alias("name"), "file")
    nodes = nodes.unionByName(minted.join(bodies, "key").select(F.lit("composable:").alias("k"), F.lit("COMPOSABLE").alias("type"), F.col("key").alias("name"), "file"))
    return _with_minted(nodes.select(F.concat("k", "name").alias("id"), "type", "name", "file"), existing), edges


def _with_minted(nodes: DataFrame, existing: DataFrame) -> DataFrame:
    known = existing.select("id").distinct().withColumn("known", F.lit(True))
    return nodes.join(known, "id", "left").withColumn("minted", F.col("known").isNull()).drop("known")


def interactions(asked: DataFrame, routes: DataFrame, routed: DataFrame | None = None) -> DataFrame:
    """src, dst, convention: from views to what their requests meet. asked(component, file, method, url, category, mapped).

    Only HTTP ones, and those of routed files if there are any routed ones (a null file counts). A mapped backend node is met; else the first route
    of the same method that fits the url as it stands."""
    asked = asked.where("category = 'HTTP'").withColumn("src", F.concat(F.lit("view:"), F.coalesce("component", F.lit("UnknownView"))))
    if routed is not None and routed.take(1):
        asked = asked.withColumn("base", _base(F.col("file"))).join(routed.withColumn("shown", F.lit(True)), "base", "left").where("file is null or shown")
    else:
        asked = asked.where(F.col("file").isNull() | F.col("file").rlike(r"/pages/.*\.(vue|tsx|jsx)$"))
    mapped = asked.where("mapped is not null").select("src", F.col("mapped").alias("dst"), F.lit("frontend-http").alias("convention"))
    open_ = asked.where("mapped is null").select("src", "method", "url")
    met = open_.join(first_route(open_, routes, ("method",), holes=False), ["method", "url"]).select("src", F.col("id").alias("dst"), F.lit("frontend-gateway").alias("convention"))
    return mapped.unionByName(met).groupBy("src", "dst").agg(F.max("convention").alias("convention"))


def gateway(routes: DataFrame, files: DataFrame, tables: DataFrame, entities: DataFrame, endpoints: DataFrame, touches: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of routes(method, path, chain, tables, ops, proxies), all but the first two arrays.

    nodes(id, type, origin, minted), edges(src, dst, rel, convention). A route of a method (ALL is none) calls the files of its chain, one
    after the other; the last one touches its tables, written if an operation writes. A table is an entity of that table name
    (entities(id, table)), one that a schema declares (tables(name)), or minted. Files that are repositories touch what touches(file, tables, ops)
    tells of them. Files of services are nodes whether a route calls them or not. A route calls the endpoints whose paths it proxies."""
    r = routes.where("method is not null and method <> 'ALL' and path <> ''").withColumn("id", F.concat(F.lit("route:"), "method", F.lit(":"), "path"))
    hops = F.transform(F.filter(F.transform(F.coalesce("chain", F.array().cast("array<string>")), lambda x: F.substring_index(x, "::", 1)), lambda x: x != ""), lambda x: F.concat(F.lit("node:"), x))
    r = r.withColumn("way", F.concat(F.array("id"), hops)).withColumn("way", F.filter("way", lambda x, i: (i == 0) | (x != F.get("way", i - 1))))
    r = fixpoint.cut(r.select("id", "way", "tables", "ops", "proxies"))
    step = r.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("way")), lambda i: F.struct(F.get("way", i - 1).alias("src"), F.get("way", i).alias("dst")))).alias("s")).select("s.*").where("dst is not null")
    calls = step.distinct().select("src", "dst", F.lit("CALLS").alias("rel"), F.lit("node-chain").alias("convention"))
    path = endpoints.groupBy(F.col("path").alias("proxied")).agg(F.max_by("id", "seq").alias("dst"))
    proxied = r.select(F.col("id").alias("src"), F.explode("proxies").alias("proxied")).join(path, "proxied").where("src <> dst").select("src", "dst", F.lit("CALLS").alias("rel"), F.lit("gateway-proxy").alias("convention")).distinct()

    kind = F.when(F.lower("file").rlike(REPOSITORY), "REPOSITORY").otherwise("SERVICE")
    services = files.where(F.col("file").rlike(SERVICE) & ~F.col("file").rlike(NO_SERVICE)).select("file", F.lit("declared").alias("origin"))
    modules = r.select(F.explode("way").alias("id")).where("startswith(id, 'node:')").select(F.substr("id", F.lit(6)).alias("file"), F.lit("chain").alias("origin"))
    modules = fixpoint.cut(services.unionByName(modules).groupBy("file").agg(F.max("origin").alias("origin")).select(F.concat(F.lit("node:"), "file").alias("id"), kind.alias("type"), "origin", "file"))

    told = r.select(F.element_at("way", -1).alias("src"), "tables", "ops").unionByName(modules.where("type = 'REPOSITORY'").join(touches, "file").select(F.col("id").alias("src"), "tables", "ops"))
    writes = F.coalesce(F.exists("ops", lambda x: x.rlike(WRITES)), F.lit(False))
    told = told.select("src", F.explode("tables").alias("name"), F.when(writes, "WRITES_ENTITY").otherwise("READS_ENTITY").alias("rel")).distinct()
    known = entities.groupBy(F.col("table").alias("name")).agg(F.max("id").alias("known"))
    touched = fixpoint.cut(told.join(known, "name", "left").select("src", F.coalesce("known", F.concat(F.lit("table:"), "name")).alias("dst"), "rel", "name", "known"))
    of_tables = tables.select("name", F.lit("declared").alias("origin")).join(known, "name", "left_anti").unionByName(touched.where("known is null").select("name", F.lit("touched").alias("origin")))
    of_tables = of_tables.groupBy("name").agg(F.min("origin").alias("origin")).select(F.concat(F.lit("table:"), "name").alias("id"), F.lit("ENTITY").alias("type"), "origin")
    nodes = r.select("id").distinct().select("id", F.lit("ROUTE").alias("type"), F.lit("route").alias("origin")).unionByName(modules.drop("file")).unionByName(of_tables)
    edges = calls.unionByName(proxied).unionByName(touched.select("src", "dst", "rel", F.lit("table-touch").alias("convention")))
    return _with_minted(nodes, existing), edges
