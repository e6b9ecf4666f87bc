"""Joins by likeness: URLs to endpoints, routes with parameters, prefixes, suffixes, names in files, decision records.

None of them compares all pairs: each derives keys that any matching pair must share, joins on these, then checks the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text


def _grams(s: Column, k: int) -> Column:
    """All distinct substrings of up to k characters, the empty one included."""
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))).otherwise(none)

    sizes = [of(n) for n in range(1, k + 1)]
    return F.array_distinct(F.flatten(F.array(F.array(F.lit("")), *sizes)))


def contained(left: DataFrame, right: DataFrame, k: int = 3) -> DataFrame:
    """Distinct (a, b) of left.a and right.b where one contains the other; joined on the shorter one's first k characters."""
    a, b = left.select("a").distinct(), right.select("b").distinct()
    one = a.withColumn("g", F.explode(_grams(F.col("a"), k))).join(b.withColumn("g", F.left("b", F.lit(k))), "g").where("contains(a, b)")
    two = b.withColumn("g", F.explode(_grams(F.col("b"), k))).join(a.withColumn("g", F.left("a", F.lit(k))), "g").where("contains(b, a)")
    return one.select("a", "b").unionByName(two.select("a", "b")).distinct()


def _path_keys(s: str, front: bool) -> Column:
    """Keys that a URL and a path with a score above 0 share: a literal segment, the characters around a slash (for one path
    within the other), the lengths behind a base placeholder, or both being single segments."""
    parts, joined = F.col(f"{s}_parts"), F.array_join(f"{s}_parts", "/")
    n = F.size(parts)
    literal = F.transform(parts, lambda x: F.concat(F.lit("s"), x))
    around = F.regexp_extract_all(joined, F.lit("(?=(./.))"), 1)
    around = F.transform(around, lambda x: F.concat(F.lit("c"), x))
    if front:
        based = F.when(F.get(f"{s}_raw", 0) == "{base}", F.array(F.concat(F.lit("b"), n - 1)))
    else:
        based = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("b"), i)))
    single = F.when(n == 1, F.array(F.lit("1")))
    whole = F.array(F.concat(F.lit("w"), F.col(f"{s}_tidy")))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(literal, around, F.coalesce(based, none), F.coalesce(single, none), whole))


def match_endpoints(urls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """JOIN-06: urls(url_id, method, url) to endpoints(seq, method, path, class_name): url_id, tier, seq and score of the best.

    Tier 1: same method, score 50 or more; tier 2: the operation named in the URL is the class's, 70 or more; tier 3: any method,
    40 or more. Within a tier the highest score, then the least seq. A URL without a method takes any; external ones match none.
    Distinct URLs and paths are scored, not rows."""
    u = urls.where(~text.is_external(F.col("url"))).select("url_id", F.upper("method").alias("um"), text.normalize_url(F.col("url")).alias("url"))
    prep = lambda df, c, s: df.select(c).distinct().withColumn(f"{s}_tidy", text.tidy_path(F.col(c)) if s == "f" else F.regexp_replace(F.regexp_replace(c, "/+", "/"), "/$", "")).withColumn(f"{s}_raw", text.segments(F.col(f"{s}_tidy"))).withColumn(f"{s}_parts", F.transform(f"{s}_raw", text.normalize_segment))
    front = prep(u, "url", "f").withColumn("k", F.explode(_path_keys("f", True)))
    back = prep(endpoints.where("path <> ''"), "path", "b").withColumn("k", F.explode(_path_keys("b", False)))
    pairs = front.join(back, "k").dropDuplicates(["url", "path"])
    scored = pairs.select("url", "path", text.match_score(F.col("f_tidy"), F.col("f_raw"), F.col("f_parts"), F.col("b_tidy"), F.col("b_parts")).alias("score")).where("score >= 40")
    ends = endpoints.select("seq", F.upper("method").alias("em"), "path", "class_name")
    by_path = u.join(scored, "url").join(ends, "path")
    same = F.coalesce(F.col("um"), F.lit("")) == ""
    first = by_path.where((F.col("score") >= 50) & (F.col("em") != "") & (same | (F.col("um") == F.col("em")))).select("url_id", F.lit(1).alias("tier"), "seq", "score")
    third = by_path.select("url_id", F.lit(3).alias("tier"), "seq", "score")
    named = u.withColumn("op", text.operation_of_url(F.col("url"))).where("op is not null")
    likely = contained(named.select(F.lower("op").alias("a")), ends.select(text.class_base(F.col("class_name")).alias("b")))
    second = named.withColumn("a", F.lower("op")).join(likely, "a").join(ends.withColumn("b", text.class_base(F.col("class_name"))), "b").where(same | (F.coalesce("em", F.lit("")) == "") | (F.col("um") == F.col("em")))
    second = second.select("url_id", F.lit(2).alias("tier"), "seq", text.operation_score(F.col("op"), F.col("class_name")).cast("double").alias("score")).where("score >= 70")
    best = first.unionByName(second).unionByName(third).groupBy("url_id").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"), "seq")).alias("m"))
    return best.select("url_id", "m.tier", "m.seq", (-F.col("m.s")).alias("score"))


def match_routes(urls: DataFrame, routes: DataFrame) -> DataFrame:
    """JOIN-08: urls(url_id, url) to routes(seq, path) whose :params match any one segment; the first route by seq.

    Routes have few distinct shapes (length and places of parameters). A URL is masked by each shape of its length, and the
    masked URL is joined by equality."""
    mask = lambda parts: F.transform(parts, lambda x: x.startswith(":"))
    r = routes.withColumn("p", text.segments(F.col("path"))).where("size(p) > 0").withColumn("shape", mask(F.col("p")))
    r = r.withColumn("key", F.array_join(F.transform("p", lambda x: F.when(x.startswith(":"), "*").otherwise(x)), "/"))
    shapes = r.select("shape").distinct().withColumn("n", F.size("shape"))
    u = urls.withColumn("p", text.segments(text.strip_query(F.col("url")))).withColumn("n", F.size("p")).join(shapes, "n")
    u = u.withColumn("key", F.array_join(F.zip_with("p", "shape", lambda x, m: F.when(m, "*").otherwise(x)), "/"))
    return u.join(r.select("shape", "key", "seq"), ["shape", "key"]).groupBy("url_id").agg(F.min("seq").alias("seq"))


def under_prefix(urls: DataFrame, prefixes: DataFrame) -> DataFrame:
    """JOIN-09: urls(url_id, url) that equal a prefix or lie under it, with the longest one: every prefix of the URL at a slash is joined by equality."""
    u = urls.select("url_id", text.strip_url(F.col("url")).alias("p")).where("p <> ''").withColumn("parts", F.split("p", "/"))
    u = u.select("url_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "/"))).alias("prefix"))
    return u.join(prefixes.select("prefix").distinct(), "prefix").groupBy("url_id").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def gateway_prefixes(files: DataFrame, excluded: tuple[str, ...] = ("/api", "/api/v1/admin")) -> DataFrame:
    """EXT-07: mount paths that files (path, content) declare, but for Java sources and excluded ones."""
    quote = "['\"`](/[a-zA-Z0-9/_-]+)['\"`]"
    found = F.concat(*(F.regexp_extract_all("content", F.lit(p + quote), 1) for p in ("app\\.use\\(\\s*", "\\bmount:\\s*")))
    out = files.where("not endswith(path, '.java')").select(F.explode(found).alias("prefix")).select(F.regexp_replace("prefix", "/$", "").alias("prefix"))
    return out.where((F.col("prefix") != "") & ~F.col("prefix").isin(*excluded)).distinct()


def share_ending(left: DataFrame, right: DataFrame) -> DataFrame:
    """JOIN-10: distinct (a, b) of left.a and right.b, non-empty, where one is the other's ending; endings are joined by equality."""
    a, b = left.select("a").where("a <> ''").distinct(), right.select("b").where("b <> ''").distinct()
    ends = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.right(F.col(c), n)))
    one = a.select("a", ends("a").alias("b")).join(b, "b", "left_semi")
    two = b.select("b", ends("b").alias("a")).join(a, "a", "left_semi")
    return one.unionByName(two).distinct()


def name_index(nodes: DataFrame) -> DataFrame:
    """JOIN-12: nodes(id, seq, method_name, source_file) -> name, id: the node that a qualified name means.

    Names come from ids and from all dotted endings of source paths (one node stands for a file, a class node if there is one).
    A class node always wins, the last one if there are several; otherwise the first, unless two classes claim the name."""
    key = text.class_key(F.col("id"))
    of_id = nodes.select(text.qualified_name(key).alias("name"), "id", (F.col("id") == key).alias("bare"), F.concat(F.lit("i"), key).alias("owner"), F.struct(F.lit(0).alias("s"), F.col("seq").alias("q")).alias("at"))
    rep = nodes.where("source_file <> ''").groupBy("source_file").agg(F.min_by(F.struct("id", "method_name"), F.struct(F.col("method_name").isNotNull().alias("m"), "seq")).alias("r"), F.min("seq").alias("seq"))
    rk = text.class_key(F.col("r.id"))
    of_file = rep.select(F.explode(text.name_suffixes(F.col("source_file"))).alias("name"), F.col("r.id").alias("id"), ((F.col("r.id") == rk) & F.col("r.method_name").isNull()).alias("bare"), F.concat(F.lit("f"), "source_file").alias("owner"), F.struct(F.lit(1).alias("s"), F.col("seq").alias("q")).alias("at"))
    g = of_id.unionByName(of_file).where("name <> ''").groupBy("name").agg(F.max_by(F.when(F.col("bare"), F.col("id")), F.when(F.col("bare"), F.col("at"))).alias("class_id"), F.min_by("id", "at").alias("first_id"), F.min("owner").alias("o1"), F.max("owner").alias("o2"))
    return g.where("class_id is not null or o1 = o2").select("name", F.coalesce("class_id", "first_id").alias("id"))


def file_symbols(path: Column) -> Column:
    """Strong symbols of a file's name, as it is and without the suffix of its kind."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(?i)\\.(java|ts|tsx|js|jsx|vue|kt)$", "")
    bare = F.regexp_replace(base, "(?i)(WsV\\d+|Ws|ServiceV\\d+|Service|RepositoryImpl|Repository|Controller|ParamsV\\d+|ReturnV\\d+|Component|Resolver|Executor)$", "")
    return F.array_union(text.strong_symbols(base), text.strong_symbols(bare))


def candidate_symbols(path: Column) -> Column:
    """IMP-02: names that a changed file may stand for: its name, the name without its kind, the path; three characters or more."""
    ext = "(?i)\\.(java|ts|tsx|js|jsx|vue|kt)$"
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), ext, "")
    bare = F.regexp_replace(name, "(?i)(WsV\\d+|Ws|ServiceV\\d+|Service|RepositoryImpl|Repository|Controller|Resource|Endpoint|\\.routes|\\.route|\\.spec|\\.test|\\.vue|\\.component)$", "")
    return F.array_distinct(F.filter(F.array(name, bare, F.regexp_replace(path, ext, "")), lambda x: F.length(x) >= 3))


def decisions_for(files: DataFrame, decisions: DataFrame, top: int = 5) -> DataFrame:
    """IMP-08, JOIN-13, SET-06: the decision records (id, symbols) that share most symbols with the changed files (path)."""
    changed = files.select(F.explode(file_symbols(F.col("path"))).alias("symbol")).distinct()
    hits = decisions.select("id", F.explode(F.array_distinct("symbols")).alias("symbol")).join(changed, "symbol")
    return hits.groupBy("id").agg(F.count("*").alias("score"), F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("matched")).orderBy(F.desc("score"), "id").limit(top)


def crowded_endpoints(entries: DataFrame, fan_in: int = 5) -> DataFrame:
    """WIN-08: endpoints of `fan_in` entries or more."""
    return entries.where("endpoint is not null").groupBy("endpoint").agg(F.count("*").alias("n")).where(F.col("n") >= fan_in)


def symbol_match(asked: DataFrame, names: DataFrame) -> DataFrame:
    """PRJ-15: asked(symbol), names(name): (symbol, name, via): names of which the symbol is a whole part between dots; a symbol that is none anywhere
    is looked for inside of names, from three characters on."""
    a = asked.select("symbol", F.lower("symbol").alias("s")).distinct()
    parts = names.select("name", F.explode(F.array_distinct(F.split(F.lower("name"), "\\."))).alias("s")).distinct()
    exact = a.join(parts, "s").select("symbol", "name", F.lit("exact").alias("via"))
    rest = a.join(exact.select("symbol").distinct(), "symbol", "left_anti").where("length(s) >= 3")
    near = contained(names.select(F.lower("name").alias("a")), rest.select(F.col("s").alias("b"))).where("contains(a, b)")
    part = rest.join(near, rest.s == near.b).join(names.select("name", F.lower("name").alias("low")).distinct(), F.col("a") == F.col("low")).select("symbol", "name", F.lit("part").alias("via"))
    return exact.unionByName(part)


def regex_hits(names: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """JOIN-11: names(id, name) -> id, concept for each pattern that finds something in the name: all patterns in one pass, no join."""
    tries = F.array(*(F.when(F.col("name").rlike(p), F.lit(k)) for k, p in patterns.items()))
    return names.select("id", F.explode(F.filter(tries, lambda x: x.isNotNull())).alias("concept"))


def overlapping(rows: DataFrame, items: list[str]) -> DataFrame:
    """JOIN-13: rows(id, items: array) that share an element with a list: id, shared."""
    both = F.size(F.array_intersect("items", F.array(*map(F.lit, items))))
    return rows.select("id", both.cast("long").alias("shared")).where("shared > 0")


def gateway_operations(entries: DataFrame, controllers: DataFrame, fan_in: int = 5, least: int = 6) -> DataFrame:
    """JOIN-16, WIN-08: entries(entry_id, endpoint, hint, resolved) behind an endpoint of `fan_in` or more entries, with the
    controllers(seq, class_name) that their hint names: equal names first, else the longest common part of `least` characters,
    then the least seq. Result: entry_id, seq."""
    crowded = entries.where("endpoint is not null").groupBy("endpoint").agg(F.count("*").alias("n")).where(F.col("n") >= fan_in)
    open_ = entries.where("not resolved and hint <> ''").join(crowded, "endpoint", "left_semi")
    open_ = open_.withColumn("a", F.lower(F.regexp_replace(F.regexp_replace("hint", "[._-]", ""), "(?i)v\\d+$", "")))
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace("class_name", "(?i)Controller$", ""), "(?i)WsV\\d+$", ""), "(?i)Ws$", "")
    keys = controllers.select("seq", F.explode(F.array_distinct(F.array("class_name", short))).alias("key")).where("key <> ''").select("seq", F.lower("key").alias("key"))
    keys = keys.groupBy("key").agg(F.max("seq").alias("seq"), F.min("seq").alias("at")).withColumn("b", F.regexp_replace("key", "[_-]", ""))
    pairs = contained(open_, keys, 3).where((F.col("a") == F.col("b")) | (F.least(F.length("a"), F.length("b")) >= least))
    rank = F.struct((F.col("a") != F.col("b")).alias("part"), (-F.least(F.length("a"), F.length("b"))).alias("len"), "at", "key")
    return open_.join(pairs, "a").join(keys, "b").groupBy("entry_id").agg(F.min_by("seq", rank).alias("seq"))
