"""Facts read from the lines of source files: columns, dispatch tables, event wiring, convention rules, broken declarations.

files(path, content). A file's lines are ordered by their number in windows of one file; no window spans files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text

#: Lines that are comments; column annotations; method declarations with a first parameter; listeners.
COMMENT = "^\\s*(//|\\*|/\\*|#|<!--)"
COLUMN_NAME = '@(?:[\\w.]*\\.)?Column\\b[^)]*\\bname\\s*=\\s*"([^"]+)"'
METHOD = "\\b(?:public|protected|private)\\s+(?:void|[\\w.<>,]+)\\s+(\\w+)\\s*\\(\\s*(?:final\\s+)?([\\w.]+)\\s+\\w+"
LISTENER = "@(?:Transactional)?EventListener\\b"
MOST_COVERED = 0.8


def _found(column: str | Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def lines(files: DataFrame) -> DataFrame:
    """path, no (from 1), line."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "line")).select("path", (F.col("n") + 1).alias("no"), "line")


def file_class(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.java$", "")


def entity_columns(files: DataFrame) -> DataFrame:
    """EXT-06: path, field, column: a column annotation names the field on the next line that is neither blank nor an annotation,
    unless that line has a parenthesis; a later annotation replaces an earlier one, and so does a later field of the same name."""
    t = F.trim("line")
    rows = lines(files).withColumn("column", _found(t, COLUMN_NAME)).where(F.col("column").isNotNull() | ~((t == "") | t.startswith("@")))
    w = Window.partitionBy("path").orderBy("no")
    rows = rows.withColumns({"next": F.lead(t).over(w), "next_column": F.lead("column").over(w)})
    field = _found("next", "(\\w+)\\s*[;=]")
    out = rows.where(F.col("column").isNotNull() & F.col("next_column").isNull() & ~F.col("next").contains("(")).select("path", "no", field.alias("field"), "column").where("field is not null")
    return out.groupBy("path", "field").agg(F.max_by("column", "no").alias("column"))


def rule_dispatch(files: DataFrame, enum: str = "RuleActionType", interface: str = "ActionExecutor") -> tuple[DataFrame, DataFrame]:
    """EXT-13: (action, executor, path) of Java classes that implement the interface, the first by path; and the enum's values
    without one. The enum is read from the file of its name, up to its first semicolon."""
    java = files.where("endswith(path, '.java')").withColumn("cls", file_class(F.col("path")))
    action = _found("content", f"getActionType\\s*\\(\\s*\\)\\s*\\{{[\\s\\S]*?return\\s+(?:{enum}\\.)?([A-Z][A-Z0-9_]+)\\s*;")
    made = java.where((F.col("cls") != interface) & F.col("content").rlike(f"\\bclass\\s+\\w+[\\s\\S]*?\\bimplements\\b[^{{]*\\b{interface}\\b")).withColumn("action", action).where("action is not null")
    mapped = made.groupBy("action").agg(F.min_by(F.struct(F.col("cls").alias("executor"), "path"), "path").alias("m")).select("action", "m.*")
    body = F.substring_index(F.regexp_replace("content", "^[^{]*\\{", ""), ";", 1)
    values = java.where(F.col("path").endswith(f"{enum}.java")).select(F.explode(F.regexp_extract_all(body, F.lit("(?m)\\b([A-Z][A-Z0-9_]+)\\s*(?:\\([^)]*\\))?\\s*(?:,|$)"), 1)).alias("action")).distinct()
    return mapped, values.join(mapped, "action", "left_anti")


def event_listeners(files: DataFrame) -> DataFrame:
    """EXT-14: path, class, method, event, trigger, entity, routing, line of the Java methods declared within five lines of a
    listener annotation; guards count within thirty lines from the declaration on. Ready events are left out."""
    rows = lines(files.where("endswith(path, '.java')"))
    w = Window.partitionBy("path").orderBy("no")
    trigger = F.coalesce(_found("line", "getTriggerType\\(\\)\\s*!=\\s*(?:RuleTriggerType\\.)?(\\w+)"), _found("line", '"(\\w+)"\\.equals\\(\\s*\\w+\\.getTriggerType\\(\\)\\.name\\(\\)\\)'))
    body = w.rowsBetween(0, 29)
    rows = rows.withColumns({"trigger": F.first(trigger, True).over(body), "entity": F.first(_found("line", "getEntityType\\(\\)\\s*!=\\s*(?:RuleEntityType\\.)?(\\w+)"), True).over(body)})
    named = F.when(F.col("line").rlike(METHOD), F.struct(_found("line", METHOD).alias("method"), F.element_at(F.split(_found("line", METHOD, 2), "\\."), -1).alias("event"), "trigger", "entity", "no"))
    got = rows.withColumn("d", F.first(named, True).over(w.rowsBetween(1, 5))).where(F.col("line").rlike(LISTENER) & F.col("d").isNotNull() & ~F.col("d.event").rlike("ReadyEvent$"))
    routing = F.when(F.col("d.trigger").isNotNull() | F.col("d.entity").isNotNull(), "guarded").otherwise("dynamic")
    return got.select("path", file_class(F.col("path")).alias("class"), "d.method", "d.event", "d.trigger", "d.entity", routing.alias("routing"), F.col("d.no").alias("line"))


def event_publishers(files: DataFrame) -> DataFrame:
    """EXT-14: path, class, method, trigger, line: triggers that a method emits, the first line of each; the method is the last one declared before."""
    rows = lines(files.where("endswith(path, '.java') and contains(content, '.triggerType(')"))
    w = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"method": F.last(_found("line", METHOD), True).over(w), "trigger": _found("line", "\\.triggerType\\(\\s*(?:RuleTriggerType\\.)?(\\w+)\\s*\\)")})
    hits = rows.where("trigger is not null and method is not null").withColumn("class", file_class(F.col("path")))
    return hits.groupBy("class", "method", "trigger").agg(F.min(F.struct("path", "no")).alias("m")).select("m.path", "class", "method", "trigger", F.col("m.no").alias("line"))


def rule_hits(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows (rule, path, no, groups) for lines, comments aside, that a rule's pattern finds in files that its glob takes.

    Rules are data of the caller (id, pattern, optional glob and flags): each becomes an expression, so all are tried in one pass."""
    none = F.lit(None).cast("struct<rule:string,groups:array<string>>")
    tries = [none]
    for r in rules:
        pattern = (f"(?{r['flags']})" if r.get("flags") else "") + r["pattern"]
        groups = F.array(*(F.regexp_extract("line", pattern, i) for i in range(1, r.get("groups", 0) + 1))).cast("array<string>")
        tries.append(F.when(text.matches_glob(F.col("path"), F.lit(r.get("glob"))) & F.col("line").rlike(pattern), F.struct(F.lit(r["id"]).alias("rule"), groups.alias("groups"))))
    hit = lines(files).where(~F.col("line").rlike(COMMENT)).select("path", "no", F.explode(F.filter(F.array(*tries), lambda x: x.isNotNull())).alias("h"))
    return hit.select("h.rule", "path", "no", "h.groups")


def verify_rules(files: DataFrame, rules: list[dict], least: int = 3) -> DataFrame:
    """EXT-26: rule, sites, files, verdict: admitted, few-sites (fewer than its `min_sites` files), too-wide (over four fifths of
    ten or more files) or citation-missed (`cited`: file, first and last line)."""
    hits = rule_hits(files, rules)
    cited = F.lit(False)
    for r in rules:
        if c := r.get("cited"):
            cited = cited | ((F.col("rule") == r["id"]) & (F.col("path") == c[0]) & F.col("no").between(c[1], c[2]))
    got = hits.groupBy("rule").agg(F.count("*").alias("sites"), F.count_distinct("path").alias("files"), F.bool_or(cited).alias("hit"))
    takes = files.agg(*(F.count_if(text.matches_glob(F.col("path"), F.lit(r.get("glob")))).alias(r["id"]) for r in rules)).unpivot([], [r["id"] for r in rules], "rule", "candidates")
    asks = files.sparkSession.createDataFrame([(r["id"], r.get("min_sites", least), bool(r.get("cited"))) for r in rules], "rule string, asked long, cites boolean")
    j = asks.join(takes, "rule").join(got, "rule", "left").na.fill(0, ["sites", "files"])
    wide = (F.col("candidates") >= 10) & (F.col("files") / F.col("candidates") > MOST_COVERED)
    verdict = F.when(F.col("files") < F.col("asked"), "few-sites").when(wide, "too-wide").when(F.col("cites") & ~F.coalesce("hit", F.lit(False)), "citation-missed").otherwise("admitted")
    return j.select("rule", "sites", "files", verdict.alias("verdict"))


def rule_endpoints(files: DataFrame, rules: list[dict]) -> DataFrame:
    """EXT-27: endpoints that rules with a `path` template ($1..$9 for groups) and a `method` read from lines: one per method and
    path, by the rules' order, then path and line. A missing group or a path without a leading slash gives none."""
    out = None
    for k, r in enumerate(r for r in rules if r.get("path")):
        path, whole = F.lit(r["path"]), F.lit(True)
        for i in range(1, 10):
            if f"${i}" in r["path"]:
                group = F.get("groups", i - 1)
                path, whole = F.replace(path, F.lit(f"${i}"), F.coalesce(group, F.lit(""))), whole & (F.coalesce(group, F.lit("")) != "")
        one = rule_hits(files, [r]).where(whole).select(F.lit(k).alias("k"), "rule", F.lit(r.get("method", "POST")).alias("http_method"), path.alias("endpoint"), "path", "no")
        out = one if out is None else out.unionByName(one)
    first = out.where("startswith(endpoint, '/')").groupBy("http_method", "endpoint").agg(F.min(F.struct("k", "path", "no", "rule")).alias("m"))
    return first.select("http_method", "endpoint", "m.rule", F.col("m.path").alias("source_file"), F.col("m.no").alias("line"))


def merge_rules(existing: DataFrame, mined: DataFrame) -> DataFrame:
    """EXT-32: existing rules and the mined ones whose id is new."""
    return existing.unionByName(mined.join(existing.select("id"), "id", "left_anti"), allowMissingColumns=True)


def dominant_suffixes(classes: DataFrame, least: int = 5, most: int = 12, shortest: int = 3) -> DataFrame:
    """EXT-24: classes(path, name) -> suffix, ext, files: the last one to three camel segments that at least `least` files of the
    suffix's commonest extension end in, without those that a longer suffix explains (nine tenths of the files or more)."""
    seg = classes.select("path", F.concat(F.lit("."), F.element_at(F.split("path", "\\."), -1)).alias("ext"), text.camel_segments(F.col("name")).alias("s")).where(F.size("s") > 1)
    tails = F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size("s") - 1)), lambda k: F.array_join(F.slice("s", -k, k), ""))
    per = seg.select("path", "ext", F.explode(tails).alias("suffix")).where(F.length("suffix") >= shortest).groupBy("suffix", "ext").agg(F.count_distinct("path").alias("files"))
    best = per.groupBy("suffix").agg(F.max_by(F.struct("ext", "files"), F.struct("files", "ext")).alias("b")).select("suffix", "b.*").where(F.col("files") >= least)
    longer = best.select(F.col("suffix").alias("longer"), F.col("files").alias("n"))
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.length("longer") - 1), lambda k: F.right(F.col("longer"), k)))
    shadow = longer.where(F.length("longer") > 1).select("n", ends.alias("suffix")).groupBy("suffix").agg(F.max("n").alias("n"))
    out = best.join(shadow, "suffix", "left").where("n is null or n < files * 0.9").select("suffix", "ext", "files")
    return out.orderBy(F.desc("files"), F.desc(F.length("suffix")), "suffix").limit(most)


def broken_declarations(removed: DataFrame, added: DataFrame, added_lines: DataFrame) -> DataFrame:
    """IMP-04: removed and added declarations (file, kind, name, line), added_lines(file, line) -> file, kind, name, change, into.

    signature-changed: declared again with another text; renamed: one added declaration of a new name is the same but for the
    name; inconclusive: the name still stands in an added line; removed otherwise. Declared again alike: no row."""
    mask = F.replace(text.normalize_declaration(F.col("line")), F.col("name"), F.lit("§"))
    key = ["file", "kind", "name"]
    r = removed.groupBy(*key).agg(F.min("line").alias("line")).withColumns({"old": text.normalize_declaration(F.col("line")), "masked": mask})
    a = added.groupBy(*key).agg(F.max("line").alias("line")).withColumns({"new": text.normalize_declaration(F.col("line")), "masked": mask})
    fresh = a.join(removed.select("file", "name").distinct(), ["file", "name"], "left_anti").groupBy("file", "kind", "masked").agg(F.min("name").alias("into"))
    words = added_lines.select("file", F.explode(F.regexp_extract_all("line", F.lit("\\w+"), 0)).alias("name")).distinct().withColumn("stands", F.lit(True))
    j = r.join(a.select(*key, "new"), key, "left").join(fresh, ["file", "kind", "masked"], "left").join(words, ["file", "name"], "left")
    change = F.when(F.col("new") == F.col("old"), None).when(F.col("new").isNotNull(), "signature-changed").when(F.col("into").isNotNull(), "renamed").when(F.col("stands"), "inconclusive").otherwise("removed")
    return j.select(*key, change.alias("change"), F.when(F.col("new").isNull(), F.col("into")).alias("into")).where("change is not null")
