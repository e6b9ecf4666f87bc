"""Facts of source code: routes, tables, declarations, decision records, indexed symbols, wiring, and the closures over them.

files(path, content); occurrences(doc, symbol, p, line, is_def). Lines are numbered from 1; nothing spans files unless it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.functions.source import masked
from evigraph.operators import extract, fixpoint, runtime

#: HTTP verbs of a router; citations by how sure they are.
ROUTER_VERB = "(get|post|put|patch|delete)"
CITATIONS = ("file", "backtick", "prose")
#: Path parts that every route may begin with.
COMMON_ANCHORS = ("api", "app", "v1", "v2", "rest", "admin")


def _found(column: str | Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def annotation_closure(metas: DataFrame) -> DataFrame:
    """EXT-02: metas(annotation, meta) -> annotation, carries: all that an annotation carries, itself included."""
    edges = metas.select(F.col("annotation").alias("src"), F.col("meta").alias("dst"))
    roots = metas.select(F.explode(F.array("annotation", "meta")).alias("id")).distinct()
    return fixpoint.reach(edges, roots, None).select(F.col("root").alias("annotation"), F.col("node").alias("carries"))


def inherited_paths(classes: DataFrame) -> DataFrame:
    """EXT-03: classes(cls, parent, base_path) -> cls, base_path: its own, or that of the nearest class above that has one."""
    edges = classes.where("parent is not null").select(F.col("cls").alias("src"), F.col("parent").alias("dst"))
    at = fixpoint.reach(edges, classes.select(F.col("cls").alias("id")), None)
    known = classes.where("base_path <> ''").select(F.col("cls").alias("node"), "base_path")
    best = at.join(known, "node").groupBy("root").agg(F.min_by("base_path", F.struct("depth", "node")).alias("base_path"))
    return classes.select("cls").distinct().join(best.withColumnRenamed("root", "cls"), "cls", "left").select("cls", "base_path")


def convention_endpoints(files: DataFrame, base: str = "/app") -> DataFrame:
    """EXT-04: operation classes in .../<operation>/v<N>/ that carry @Ws: endpoint, cls, path, the first by path."""
    f = files.where("endswith(path, '.java')").withColumns({"op": _found("path", r"/([a-z][A-Za-z0-9]*)/v\d+/[^/]+$"), "v": _found("path", r"/(v\d+)/[^/]+$")})
    f = f.where(F.col("op").isNotNull() & F.col("content").rlike(r"@Ws\b"))
    return f.groupBy(F.concat(F.lit(base + "/"), "op", F.lit("."), "v").alias("endpoint")).agg(F.min_by(F.struct(extract.file_class(F.col("path")).alias("cls"), "path"), "path").alias("m")).select("endpoint", "m.*")


def augmented(endpoints: DataFrame, nodes: DataFrame) -> DataFrame:
    """EXT-08: endpoints(endpoint, cls), nodes(id, type, class_name) -> src, dst, rel: the endpoint calls its class's service, and reads or writes the
    entity that its operation's name says."""
    src = F.concat(F.lit("wsv1:"), "endpoint")
    op = F.regexp_extract("endpoint", r"/([A-Za-z0-9]+)\.v\d+$", 1)
    e = endpoints.select(src.alias("src"), F.lower("cls").alias("cls"), text.entity_of_operation(op)["entity"].alias("entity"), text.convention_verb(op)["operation"].alias("kind"))
    service = nodes.where("type = 'SERVICE'").select(F.lower("class_name").alias("cls"), F.col("id").alias("dst"))
    entity = nodes.where("type = 'ENTITY'").select(F.lower("class_name").alias("entity"), F.col("id").alias("dst"))
    calls = e.join(service, "cls").select("src", "dst", F.lit("CALLS").alias("rel"))
    data = e.where("kind is not null").join(entity, "entity").select("src", "dst", F.when(F.col("kind") == "READ", "READS_ENTITY").otherwise("WRITES_ENTITY").alias("rel"))
    return calls.unionByName(data).distinct()


def proxies(files: DataFrame) -> DataFrame:
    """EXT-11: (path, target): files that hand requests on to another server, with the path they hand on."""
    call = r"(?:createProxyMiddleware|fetch|axios\.\w+)\([^\n]*?['\"`][^'\"`]*?(/app/[\w.]+)"
    return files.where("path rlike '[.](ts|js|mjs)$'").select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(call), 1))).alias("target"))


def masked_lines(lines: DataFrame) -> DataFrame:
    """FN-19 over lines: the lines and `code`, the line as it is masked in the text of its file."""
    others = [c for c in lines.columns if c not in ("file", "no")]
    t = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("no", *others))).alias("l"))
    code = F.split(masked(F.array_join(F.transform("l", lambda x: F.coalesce(F.translate(x["line"], "\n", " "), F.lit(""))), "\n")), "\n", -1)
    return t.select("file", F.explode(F.arrays_zip(F.col("l"), code.alias("code"))).alias("x")).select("file", "x.l.*", "x.code")


def declarations(lines: DataFrame) -> DataFrame:
    """EXT-15: lines(file, no, line) -> file, no, kind, name: what a line of code declares, comments and the insides of strings aside, also where they reach
    over several lines. The lines of a file are read as one text, in the order of `no`: those of one side of a hunk, if only they are known."""
    code = masked_lines(lines).where(~text.is_comment(F.col("line"))).withColumn("code", F.rtrim("code")).where("code <> ''")
    java = F.col("file").rlike("[.](java|kt)$")
    of = lambda pattern, kind: F.when(_found("code", pattern).isNotNull(), F.struct(F.lit(kind).alias("kind"), _found("code", pattern).alias("name")))
    kinds = F.array(
        of(r"\b(?:class|interface|enum|record)\s+([A-Za-z_]\w*)", "class"), F.when(~java, of(r"\bfunction\s+([A-Za-z_]\w*)", "method")), F.when(~java, of(r"\b(?:const|let|var)\s+([A-Za-z_]\w*)\s*[=:]", "const")),
        F.when(java, of(r"\b(?:public|protected|private)\s+(?:static\s+|final\s+)*[\w.<>,\[\]]+\s+(\w+)\s*\(", "method")), F.when(java, of(r"\b(?:public|protected|private)\s+(?:static\s+|final\s+)*[\w.<>,\[\]]+\s+(\w+)\s*[;=]", "field")),
    )
    return code.select("file", "no", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("d")).select("file", "no", "d.*")


def decision_index(records: DataFrame, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """EXT-16: records(path, content) -> id, title, status, symbols of decision records named NNNN-...md (four digits or more)."""
    r = records.withColumn("id", _found("path", r"(?<!\d)(\d{4,})-[^/]*\.md$")).where("id is not null")
    return r.select("id", _found("content", r"(?m)^#\s+(.+?)\s*$").alias("title"), F.lower(_found("content", r"(?mi)^status:\s*(\w+)")).alias("status"), F.array_join(F.array_sort(text.strong_symbols(F.col("content"), stopwords)), ",").alias("symbols"))


def citations(records: DataFrame, most: int = 200, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """EXT-17: (id, symbol, citation, no): what a record cites: a file's name, a name in backticks, or a strong name in its prose; of a symbol
    the surest citation, then its first line; at most `most` of a record, the first ones by line."""
    lines = records.withColumn("id", _found("path", r"(?<!\d)(\d{4,})-[^/]*\.md$")).where("id is not null").select("id", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    bare = F.regexp_replace("line", "`[^`]*`", " ")
    named = lambda rank, values: F.transform(values, lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("symbol")))
    found = F.concat(named(0, F.regexp_extract_all("line", F.lit(r"\b(\w+)\.(?:java|ts|vue|kt)\b"), 1)), named(1, F.regexp_extract_all("line", F.lit(r"`(\w+)(?:\(\))?`"), 1)), named(2, text.strong_symbols(bare, stopwords)))
    cited = lines.select("id", (F.col("n") + 1).alias("no"), F.explode(found).alias("f")).select("id", "no", "f.*")
    best = cited.groupBy("id", "symbol").agg(F.min(F.struct("rank", "no")).alias("b")).select("id", "symbol", F.element_at(F.array(*map(F.lit, CITATIONS)), F.col("b.rank") + 1).alias("citation"), F.col("b.no").alias("no"))
    w = Window.partitionBy("id").orderBy("no", "symbol")
    return best.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def linked_decisions(cited: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRA-26: citations of symbols that the graph knows: id, symbol, node."""
    known = nodes.select(F.col("class_name").alias("symbol"), F.col("id").alias("node")).distinct()
    return cited.select("id", "symbol").join(known, "symbol").select("id", "symbol", "node").distinct()


def bodies(definitions: DataFrame) -> DataFrame:
    """WIN-02: definitions(doc, symbol, start, end) with an end: the next definition's start where none is given; the last one goes on."""
    w = Window.partitionBy("doc").orderBy("start", "symbol")
    return definitions.withColumn("end", F.coalesce("end", F.lead("start").over(w), F.lit(1 << 62)))


def call_edges(occurrences: DataFrame, definitions: DataFrame, implementations: DataFrame) -> DataFrame:
    """EXT-18: (src, dst, resolution): references attributed to the innermost body around them; a reference to an interface's symbol fans out to
    what implements it; calls of a symbol to itself are left out, and compiler beats interface-impl."""
    ranges = bodies(definitions).select("doc", F.col("start").alias("lo"), F.col("end").alias("hi"), F.col("symbol").alias("name"))
    refs = occurrences.where("not is_def").select("doc", "p", "symbol")
    owner = runtime.innermost(refs.select("doc", "p"), ranges)
    direct = refs.join(owner, ["doc", "p"]).select(F.col("name").alias("src"), F.col("symbol").alias("dst"), F.lit("compiler").alias("resolution"))
    fan = direct.join(implementations.select(F.col("symbol").alias("dst"), "impl"), "dst").select("src", F.col("impl").alias("dst"), F.lit("interface-impl").alias("resolution"))
    return direct.unionByName(fan).where("src <> dst").groupBy("src", "dst").agg(F.min("resolution").alias("resolution"))


def next_symbol(occurrences: DataFrame) -> DataFrame:
    """WIN-03: each occurrence beside the one that follows it in its document."""
    w = Window.partitionBy("doc").orderBy("p", "symbol")
    return occurrences.select("doc", "p", "symbol", F.lead("symbol").over(w).alias("next"), F.lead("line").over(w).alias("next_line"))


def data_access(occurrences: DataFrame, definitions: DataFrame, tables: DataFrame) -> DataFrame:
    """EXT-19: occurrences of access verbs (read:..., write:...) whose next symbol on the same line is a table: src, table, access."""
    near = next_symbol(occurrences).join(occurrences.select("doc", "p", "line"), ["doc", "p"]).where("next_line = line and symbol rlike '^(read|write):'")
    hit = near.join(tables.select(F.col("symbol").alias("next"), "table"), "next").select("doc", "p", F.substring_index("symbol", ":", 1).alias("access"), "table")
    ranges = bodies(definitions).select("doc", F.col("start").alias("lo"), F.col("end").alias("hi"), F.col("symbol").alias("name"))
    owner = runtime.innermost(hit.select("doc", "p"), ranges)
    return hit.join(owner, ["doc", "p"]).select(F.col("name").alias("src"), "table", "access").distinct()


def wiring(beans: DataFrame, supers: DataFrame) -> DataFrame:
    """EXT-20: beans(interface, concrete, is_primary, opaque), supers(cls, parent) -> interface, concrete, reason: what an interface is wired to. A
    bean stands for all that its interface is derived from. One agreed primary wins; else one concrete class, unless some bean of the
    interface is opaque; else it is ambiguous and left out."""
    up = fixpoint.reach(supers.select(F.col("cls").alias("src"), F.col("parent").alias("dst")), beans.select(F.col("interface").alias("id")).distinct(), None).select(F.col("root").alias("interface"), F.col("node").alias("port"))
    g = beans.join(up, "interface").groupBy("port").agg(
        F.count_distinct(F.when(F.col("is_primary"), F.col("concrete"))).alias("primaries"), F.min(F.when(F.col("is_primary"), F.col("concrete"))).alias("primary"),
        F.count_distinct("concrete").alias("concretes"), F.min("concrete").alias("one"), F.bool_or("opaque").alias("opaque"),
    )
    pick = F.when(F.col("primaries") == 1, F.struct(F.col("primary").alias("concrete"), F.lit("primary").alias("reason"))).when((F.col("primaries") == 0) & (F.col("concretes") == 1) & ~F.col("opaque"), F.struct(F.col("one").alias("concrete"), F.lit("single").alias("reason")))
    return g.where(pick.isNotNull()).select(F.col("port").alias("interface"), pick.alias("p")).select("interface", "p.*")


def routed_pages(routes: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """EXT-22, EXT-23: routes(path, component), imports(src, dst) -> page, kind, route: pages that a route shows (routed), files that those
    import, directly or not (reached), and Vue files that neither (orphan)."""
    pages = routes.groupBy(F.col("component").alias("page")).agg(F.min("path").alias("route"))
    reached = fixpoint.reach(imports, pages.select(F.col("page").alias("id")), None).select(F.col("node").alias("page")).distinct()
    vue = files.where("endswith(path, '.vue')").select(F.col("path").alias("page")).distinct()
    j = vue.join(pages, "page", "left").join(reached.withColumn("hit", F.lit(True)), "page", "left")
    return j.select("page", F.when(F.col("route").isNotNull(), "routed").when(F.col("hit"), "reached").otherwise("orphan").alias("kind"), "route")


def route_anchors(routes: DataFrame, least: int = 5, most: int = 12, deny: tuple[str, ...] = COMMON_ANCHORS) -> DataFrame:
    """EXT-25: routes(file, endpoint) -> anchor, files: first path parts that routes of `least` files or more begin with."""
    part = F.get(F.filter(text.segments(F.col("endpoint")), lambda x: ~F.lower(x).isin(*deny) & ~text.is_param(x)), 0)
    return routes.select("file", part.alias("anchor")).where("anchor is not null").groupBy("anchor").agg(F.count_distinct("file").alias("files")).where(F.col("files") >= least).orderBy(F.desc("files"), "anchor").limit(most)


def call_chains(routes: DataFrame, calls: DataFrame, imports: DataFrame, depth: int = 8) -> DataFrame:
    """EXT-29: routes(endpoint, file, handler), calls(file, src, dst), imports(file, name, target) -> endpoint, file, function, depth: functions
    that a handler reaches; a call of an imported name goes on in the file that it comes from."""
    resolved = calls.join(imports.select("file", F.col("name").alias("dst"), "target"), ["file", "dst"], "left")
    key = lambda f, n: F.concat_ws("#", f, n)
    edges = resolved.select(key("file", "src").alias("src"), key(F.coalesce("target", "file"), "dst").alias("dst"))
    roots = routes.select("endpoint", key("file", "handler").alias("id"))
    at = fixpoint.reach(edges, roots.select("id").distinct(), depth)
    return roots.join(at, roots.id == at.root).select("endpoint", F.substring_index("node", "#", 1).alias("file"), F.substring_index("node", "#", -1).alias("function"), F.col("depth").cast("long").alias("depth"))


def aggregated_edges(edges: DataFrame, modules: DataFrame, budget: int) -> DataFrame:
    """EXT-30: edges(src_file, dst_file, kind, resolution), modules(file, external) -> src, dst, kind, resolution, kept: edges between files of the
    project, each once, compiler before interface-impl; external files never. Beyond the budget what is architectural (kind other than
    local) goes first, then by name; the rest is reported with kept = false, not lost."""
    inside = modules.where("not external").select("file")
    e = edges.join(inside.toDF("src_file"), "src_file", "left_semi").join(inside.toDF("dst_file"), "dst_file", "left_semi").where("src_file <> dst_file")
    one = e.groupBy(F.col("src_file").alias("src"), F.col("dst_file").alias("dst")).agg(F.min("resolution").alias("resolution"), F.min(F.when(F.col("kind") != "local", F.col("kind"))).alias("kind"))
    order = F.struct(F.col("kind").isNull().alias("k"), "src", "dst")
    keep = one.select("src", "dst", order.alias("o")).orderBy("o").limit(budget).select("src", "dst", F.lit(True).alias("kept"))
    return one.join(keep, ["src", "dst"], "left").select("src", "dst", F.coalesce("kind", F.lit("local")).alias("kind"), "resolution", F.coalesce("kept", F.lit(False)).alias("kept"))


def sequence_steps(steps: DataFrame) -> DataFrame:
    """GRA-25: steps(root, order, src, dst, rel) -> root, order, participant_from, participant_to, message: a sequence diagram's messages; a run of equal
    ones is one message with its number."""
    w = Window.partitionBy("root").orderBy("order")
    kind = F.when(F.col("rel") == "READS_ENTITY", "read").when(F.col("rel") == "WRITES_ENTITY", "write").otherwise("call")
    s = steps.select("root", "order", F.substring_index("src", ":", 1).alias("a"), F.substring_index("dst", ":", 1).alias("b"), kind.alias("message"))
    new = F.coalesce(F.struct("a", "b", "message") != F.lag(F.struct("a", "b", "message")).over(w), F.lit(True))
    runs = s.withColumn("run", F.sum(new.cast("int")).over(w))
    return runs.groupBy("root", "run").agg(F.min("order").alias("order"), F.first("a").alias("participant_from"), F.first("b").alias("participant_to"), F.first("message").alias("message"), F.count("*").alias("times")).drop("run")


def statements(narrative: DataFrame, least: int = 1) -> DataFrame:
    """GRA-23: narrative(src, dst, rel, verdict) -> symbol, walkable, refuted, statement: what can be said of each source; with fewer than `least` walkable
    edges nothing is, and the statement is `abstained`."""
    g = narrative.groupBy(F.col("src").alias("symbol")).agg(F.count_if(F.col("verdict") == "walkable").alias("walkable"), F.count_if(F.col("verdict") == "refuted").alias("refuted"))
    said = F.when(F.col("walkable") < least, "abstained").otherwise(F.concat("symbol", F.lit(" reaches "), "walkable", F.lit(" proven target(s)")))
    return g.select("symbol", "walkable", "refuted", said.alias("statement"))


def impact_of_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """IMP-03: files(file, candidates: array), symbols(symbol, endpoint) -> file, endpoint, via: endpoints that a file's names stand in: exactly, else (only
    for files without an exact hit) by a name that holds one of them."""
    from evigraph.operators import matching

    c = files.select("file", F.explode(F.transform("candidates", F.lower)).alias("name")).distinct()
    s = symbols.select(F.lower("symbol").alias("symbol"), "endpoint").distinct()
    exact = c.join(s, c.name == s.symbol).select("file", "endpoint", F.lit("exact").alias("via")).distinct()
    rest = c.join(exact.select("file").distinct(), "file", "left_anti")
    near = matching.contained(s.select(F.col("symbol").alias("a")), rest.where("length(name) >= 3").select(F.col("name").alias("b"))).where("contains(a, b)")
    part = rest.join(near, rest.name == near.b).join(s, F.col("a") == s.symbol).select("file", "endpoint", F.lit("part").alias("via")).distinct()
    return exact.unionByName(part)


def breaking_reach(broken: DataFrame, uses: DataFrame) -> DataFrame:
    """IMP-05: broken(symbol, kind, change), uses(symbol, endpoint) -> symbol, change, endpoints, verdict: alert where something uses what broke,
    suppressed-dead where nothing does."""
    n = uses.select(F.lower("symbol").alias("key"), "endpoint").distinct().groupBy("key").agg(F.count("*").alias("endpoints"))
    j = broken.withColumn("key", F.lower("symbol")).join(n, "key", "left")
    return j.select("symbol", "change", F.coalesce("endpoints", F.lit(0)).cast("long").alias("endpoints"), F.when(F.col("endpoints") > 0, "alert").otherwise("suppressed-dead").alias("verdict"))


def unknown_files(changed: DataFrame, known: DataFrame) -> DataFrame:
    """IMP-11: changed(file) that no known(path) is: equal, or one the end of the other at a slash. Endings are joined by equality."""
    tidy = lambda c: F.regexp_replace(c, r"^\.?/+", "")
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))
    c, k = changed.select("file", tidy("file").alias("f")).distinct(), known.select(tidy("path").alias("p")).distinct()
    one = c.join(k.select(F.explode(ends("p")).alias("f")).distinct(), "f").select("file")
    two = c.select("file", F.explode(ends("f")).alias("p")).join(k, "p").select("file")
    return c.select("file").join(one.unionByName(two).distinct(), "file", "left_anti")
