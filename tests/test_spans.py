"""Masking against a plain scanner; routes, handlers, schemas and Java types of nested sources over many lines."""

import random

import pytest
from pyspark.sql import functions as F

from evigraph.functions.source import masked
from evigraph.operators import spans


def plain_mask(text):
    """One character after the other, with the state of a small automaton."""
    out, i, state = [], 0, None
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if state is None:
            if two in ("//", "/*"):
                state = two
                out.append("  ")
                i += 2
                continue
            if c in "\"'`":
                state = c
            out.append(c)
        elif state == "//":
            state = None if c == "\n" else state
            out.append(c if c == "\n" else " ")
        elif state == "/*":
            if two == "*/":
                state = None
                out.append("  ")
                i += 2
                continue
            out.append(c if c == "\n" else " ")
        elif c == "\\" and i + 1 < len(text) and not (state != "`" and text[i + 1] == "\n"):
            out.append(" " + ("\n" if text[i + 1] == "\n" else " "))
            i += 2
            continue
        elif c == state or (c == "\n" and state != "`"):
            out.append(c)
            state = None
        else:
            out.append(c if c == "\n" else " ")
        i += 1
    return "".join(out)


def test_masking_equals_a_plain_scanner(spark):
    rng = random.Random(9)
    fixed = ['x = "http://y"; // "no', "/* a\n ' b */ c", "`t\n${x} // in` y", "a 'it\\'s' b", '"\\\\" c', "/* open", "`open\n\"", "'", "", "/", "é😀'é😀' // 😀", '"' + "\\n" * 9000 + '"', "/" * 50_000, "x" * 100_000 + "'"]
    texts = fixed + ["".join(rng.choice(["a", "\n", '"', "'", "`", "/", "*", "//", "/*", "*/", "\\\\", "\\n", "(", " "]) for _ in range(rng.randrange(40))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", masked(F.col("t")).alias("m")).collect()
    assert all(len(r["m"]) == len(texts[r["i"]]) for r in rows)
    wrong = [(texts[r["i"]], r["m"], plain_mask(texts[r["i"]])) for r in rows if r["m"] != plain_mask(texts[r["i"]])]
    assert wrong == []


def files(spark, **contents):
    return spark.createDataFrame([(k.replace("__", "/").replace("_dot_", "."), v) for k, v in contents.items()], "path string, content string")


MAIN = """
import express from 'express';
import far from "./far";
const app = express();
const r: Router = express.Router();
// app.get('/ghost', h);
/* r.get('/ghost2',
   h) */
const text = "r.get('/ghost3', h)";
app.use('/api', r);
app.use("/far", far);
r
  .post(
    '/orders/:id',
    requireAuth,
    requireRole("clerk (junior)", 'boss'),
    async (req, res) => {
      const a = [1, (2), { b: ")" }];
      if (a) { await db.insert(orders).values({ x: f(1) }); }
      res.json(await db.select().from(lines));
    },
  );
r.get('/list/', requireAdmin, list);
r.delete('/x', can(), hasRole("r1"), (q) => q);
other.get('/no', list);
r.get(notAPath, list);
r.all('/', list);
function list(req, res) {
  const inner = () => { db.delete(lines); };
  return db.select().from(orders);
}
const save = async (x) => {
  // db.insert(lines)
  return db.update(orders).set(x);
};
"""
FAR = """import { Router } from 'express';
const router = Router();
router.put("/a", function (req, res) { go(); });
export default router;
"""


def test_routes_over_several_lines(spark):
    got = {(r["path"], r["http_method"], r["endpoint"], r["router"], tuple(r["roles"]), r["expression"], r["handler"], r["no"]) for r in spans.routes(files(spark, s__main_dot_ts=MAIN, s__far_dot_ts=FAR)).collect()}
    line = lambda part: MAIN[: MAIN.index(part)].count("\n") + 1
    assert got == {
        ("s/main.ts", "POST", "/api/orders/:id", "r", ("clerk (junior)", "boss"), "requireRole(\"clerk (junior)\", 'boss')", None, line("r\n  .post")),
        ("s/main.ts", "GET", "/api/list", "r", ("admin",), "requireAdmin", "list", line("r.get('/list")),
        ("s/main.ts", "DELETE", "/api/x", "r", ("r1",), 'hasRole("r1")', None, line("r.delete")),
        ("s/main.ts", "ALL", "/api", "r", (), None, "list", line("r.all")),
        ("s/far.ts", "PUT", "/far/a", "router", (), None, None, 3),
    }


TABLES = [("orders_t", "orders"), ("lines_t", "lines")]


def test_tables_of_handlers_and_routes(spark):
    f, t = files(spark, s__main_dot_ts=MAIN, s__far_dot_ts=FAR), spark.createDataFrame(TABLES, "table string, variable string")
    assert {tuple(r)[1:] for r in spans.handler_tables(f, t).collect()} == {("list", "orders_t", "read"), ("inner", "lines_t", "write"), ("save", "orders_t", "write")}
    assert {tuple(r)[2:] for r in spans.route_tables(f, t).collect()} == {
        ("POST", "/api/orders/:id", "orders_t", "write"),
        ("POST", "/api/orders/:id", "lines_t", "read"),
        ("GET", "/api/list", "orders_t", "read"),
        ("ALL", "/api", "orders_t", "read"),
    }


SCHEMA = """export const users = pgTable("users", {
  id: serial("id").primaryKey(),
  // gone: text("gone"),
  meta: jsonb('meta').$type<{ a: string, b: text("no") }>().default({ a: x(1), b: [1, 2] }),
  "kind": varchar("kind_of", { length: 3 }),
}, (t) => ({ idx: index("idx").on(t.id) }));
const lines = mysqlTable('lines', { n: int("n") });
"""


def test_schemas_with_nested_definitions(spark):
    got = {(r["variable"], r["table"], r["columns"]) for r in spans.schema_tables(files(spark, s_dot_ts=SCHEMA)).collect()}
    assert got == {("users", "users", "id,meta,kind_of"), ("lines", "lines", "n")}


JAVA = """package shop.core; // class Ghost {
import a.b;
/* class No { } */
@Service @Primary
public final class Outer<T extends Map<String, List<T>>> extends Base<T, X> implements api.Port<A, B>, Second {
  String s = "class Fake {";
  interface Inner extends One, Two {}
  enum Kind { A, B; static class Deep { } }
  record Pair(int a, int b) implements Second {
    void run() { new Object() { void x() {} }; }
  }
}
@interface Mark { }
@Configuration class Config {
  @Bean(name = "x") @Primary
  public Port<Foo> port(@Qualifier("q") final Dep dep, Other o) throws E { if (a) { b(); } return new impl.RealPort<>(dep); }
  @Bean Evaluator evaluator(CamundaEvaluator c) { return c; }
  @Bean Same same() { return new Same(); }
  @Bean void nothing() { }
  Port plain() { return new Other(); }
}
"""


def test_nested_java_types_and_beans(spark):
    f = files(spark, J_dot_java=JAVA, x_dot_ts="class T {}")
    got = {r["fqn"]: (r["kind"], r["outer"], r["parent"], tuple(r["interfaces"]), tuple(r["annotations"]), tuple(r["supers"])) for r in spans.java_types(f).collect()}
    assert got == {
        "shop.core.Outer": ("class", None, "Base", ("api.Port", "Second"), ("Primary", "Service"), ("Base", "Port", "Second")),
        "shop.core.Outer.Inner": ("interface", "shop.core.Outer", None, (), (), ("One", "Two")),
        "shop.core.Outer.Kind": ("enum", "shop.core.Outer", None, (), (), ()),
        "shop.core.Outer.Kind.Deep": ("class", "shop.core.Outer.Kind", None, (), (), ()),
        "shop.core.Outer.Pair": ("record", "shop.core.Outer", None, ("Second",), (), ("Second",)),
        "shop.core.Mark": ("annotation", None, None, (), (), ()),
        "shop.core.Config": ("class", None, None, (), ("Configuration",), ()),
    }
    beans = {(r["holder"], r["method"], r["returns"], r["concrete"], r["is_primary"]) for r in spans.java_beans(f).collect()}
    assert beans == {("shop.core.Config", "port", "Port", "RealPort", True), ("shop.core.Config", "evaluator", "Evaluator", "CamundaEvaluator", False), ("shop.core.Config", "same", "Same", None, False)}


@pytest.mark.parametrize("content", ["", "(", ")", "r.get('/a', (", "}}}} const app = express(); app.get('/a', h)"])
def test_broken_files_give_what_is_closed(spark, content):
    f = files(spark, s_dot_ts=content + "\n// Router()")
    assert spans.routes(f).count() == (1 if "h)" in content else 0)
    assert spans.schema_tables(f).count() == 0 and spans.java_types(f).count() == 0
