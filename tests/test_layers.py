"""Layers of front ends and gateways on small cases with known answers."""

from evigraph.operators import frontend

API = "export async function find(q = {}) {\n  const r = await send(`${B}/api/find.v1?${p}`);\n  return r;\n}\nexport async function bare() { return 1; }\n"
ROUTED = "seq long, id string, method string, path string"


def front(spark, files, endpoints=(), routes=(), existing=()):
    frames = (
        spark.createDataFrame([(i, f, c) for i, (f, c) in enumerate(files)], "seq long, file string, content string"),
        spark.createDataFrame([(i, x, p) for i, (x, p) in enumerate(endpoints)], "seq long, id string, path string"),
        spark.createDataFrame([(i, f"route:{m}:{p}", m, p) for i, (m, p) in enumerate(routes)], ROUTED),
        spark.createDataFrame([(x,) for x in existing], "id string"),
    )
    nodes, edges = frontend.front_end(*frames)
    return {(r["id"], r["minted"]) for r in nodes.collect()}, {(r["src"], r["dst"], r["via"]) for r in edges.collect()}


def test_imported_functions_count_if_they_are_called(spark):
    api = ("client/src/api/find.ts", API)
    page = ("client/src/pages/Page.vue", "import { find as f, bare } from '@/api/find';\nimport { find } from '@/api/find';\nconst load = () => find({});")
    idle = ("client/src/pages/Idle.vue", "import { find } from '@/api/find';\nconst x = y.find(1);")
    nodes, edges = front(spark, [api, page, idle, ("client/src/pages/Null.vue", None)], [("old", "/api/find.v1"), ("ws", "/api/find.v1")], existing=["view:Page"])
    assert (nodes, edges) == ({("view:Page", False)}, {("view:Page", "ws", "api/find.find")})


def test_holes_of_urls_and_parameters_of_routes(spark):
    api = ("client/src/api/g.ts", "export const g = (id) => send(`${B}/api/x/${id}/graph`);\nexport const h = () => send('/api/x/7/other');")
    page = ("client/src/pages/P.tsx", "import { g, h } from '../api/g';\nuse( g(1), h(2));")
    routes = [("GET", "/api/x/:id"), ("GET", "/api/:any/7/graph"), ("GET", "/api/x/:id/graph"), ("GET", "/api/x/:id/:what")]
    assert front(spark, [api, page], routes=routes)[1] == {("view:P", "route:GET:/api/:any/7/graph", "api/g.g"), ("view:P", "route:GET:/api/x/:id/:what", "api/g.h")}


def test_circles_of_composables_and_components_end(spark):
    files = [
        ("client/src/api/find.ts", API),
        ("client/src/composables/useA.ts", "import { useB } from './../composables/useB';\nexport function useA() { return useB(); }"),
        ("client/src/composables/useB.ts", "import { useA } from '@/composables/useA';\nimport { find } from '@/api/find';\nexport const useB = () => useA() || find();\nexport const quiet = () => 1;"),
        ("client/src/components/C.vue", "import D from './D.vue';"),
        ("client/src/components/D.vue", "import C from './C.vue';\nimport { useA } from '@/composables/useA';\nconst a = useA();"),
        ("client/src/components/Dead.vue", "import { quiet } from '@/composables/useB';\nquiet ();"),
        ("client/src/pages/Lone.vue", "fetch('/api/find.v1')"),
        ("client/src/pages/Page.vue", "import C from '../components/C.vue';\nimport Dead from '../components/Dead.vue';"),
        ("client/src/App.tsx", 'import Page from "./pages/Page.vue";\nimport Other from "./Other";\n<Route path="/" component={Page}/>'),
    ]
    nodes, edges = front(spark, files, [("ws", "/api/find.v1")])
    assert {x for x, _ in nodes} == {"view:Page", "component:C", "component:D", "composable:useA.useA"}
    assert {(s, d) for s, d, _ in edges} == {("view:Page", "component:C"), ("component:C", "component:D"), ("component:D", "component:C"), ("component:D", "composable:useA.useA"), ("composable:useA.useA", "ws")}


def test_no_files(spark):
    assert front(spark, []) == (set(), set())


def test_pages_that_a_router_shows(spark):
    text = "const A = lazy(() => import('./pages/A'));\nimport B from './pages/B';\nimport C, { x } from './C.tsx';\n<Route element={<A/>} />; const r = { Component: C, other: B }; <Route component={Nowhere} />"
    files = spark.createDataFrame([(0, "client/src/routes.tsx", text), (1, "client/src/other.tsx", "import B from './B'; component={B}"), (2, "frontend/src/router.ts", "import('../x/V.vue')")], "seq long, file string, content string")
    assert {r["base"] for r in frontend.routed_bases(files).collect()} == {"A", "C", "V"}


def test_interactions(spark):
    kinds = "component string, file string, method string, url string, category string, mapped string"
    asked = spark.createDataFrame(
        [
            ("P", "src/pages/P.vue", "POST", "/api/flows/abc/run?x=/", "HTTP", None), ("P", "src/pages/P.vue", "GET", "/api/flows/abc/run", "HTTP", None), ("M", None, "GET", "/no", "HTTP", "ws"),
            ("U", "src/pages/U.vue", "POST", "/api/flows/abc/run", "UI_ONLY", None), ("Part", "src/parts/Part.vue", "POST", "/api/flows/abc/run", "HTTP", None), (None, None, "POST", "/api/flows/${x}/run", "HTTP", None), ("N", None, None, None, "HTTP", None),
        ],
        kinds,
    )
    routes = spark.createDataFrame([(1, "r1", "POST", "/api/flows/:code/run"), (2, "r2", "POST", "/api/:x/:y/run"), (3, "r3", "POST", "/api/flows/one/run")], ROUTED)
    got = {tuple(r) for r in frontend.interactions(asked, routes).collect()}
    assert got == {("view:P", "r1", "frontend-gateway"), ("view:M", "ws", "frontend-http"), ("view:UnknownView", "r1", "frontend-gateway")}


def test_gateway(spark):
    df = spark.createDataFrame
    routes = df(
        [
            ("GET", "/a", ["s/one.ts::f", "s/one.ts::g", "", "s/repos/r.ts::h"], ["t", "u"], ["select"], ["/e", "/none"]), ("POST", "/b", None, ["t"], ["bulkInsert"], None),
            ("ALL", "/c", ["s/no.ts::f"], ["v"], [], []), ("GET", "/a", ["s/one.ts::f"], [], None, []), (None, "/d", [], [], [], []),
        ],
        "method string, path string, chain array<string>, tables array<string>, ops array<string>, proxies array<string>",
    )
    files = df([("server/services/p/index.ts",), ("server/services/p/index.test.ts",), ("server/routes/x.ts",), ("server/services/types.d.ts",)], "file string")
    nodes, edges = frontend.gateway(
        routes, files, df([("u",), ("w",), ("t",)], "name string"), df([("E", "t")], "id string, table string"), df([(0, "ws", "/e")], "seq long, id string, path string"),
        df([("s/repos/r.ts", ["own"], ["update"]), ("s/one.ts", ["never"], [])], "file string, tables array<string>, ops array<string>"), df([("node:s/one.ts",)], "id string"),
    )
    assert {tuple(r) for r in nodes.collect()} == {
        ("route:GET:/a", "ROUTE", "route", True), ("route:POST:/b", "ROUTE", "route", True), ("node:s/one.ts", "SERVICE", "chain", False), ("node:s/repos/r.ts", "REPOSITORY", "chain", True),
        ("node:server/services/p/index.ts", "SERVICE", "declared", True), ("table:u", "ENTITY", "declared", True), ("table:w", "ENTITY", "declared", True), ("table:own", "ENTITY", "touched", True),
    }
    assert {(r["src"], r["dst"], r["rel"]) for r in edges.collect()} == {
        ("route:GET:/a", "node:s/one.ts", "CALLS"), ("node:s/one.ts", "node:s/repos/r.ts", "CALLS"), ("route:GET:/a", "ws", "CALLS"), ("node:s/repos/r.ts", "E", "READS_ENTITY"),
        ("node:s/repos/r.ts", "table:u", "READS_ENTITY"), ("node:s/repos/r.ts", "table:own", "WRITES_ENTITY"), ("route:POST:/b", "E", "WRITES_ENTITY"),
    }
