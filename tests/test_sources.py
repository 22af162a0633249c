"""Documents, stores, manifests, parsers and diagrams."""

import json

import pytest
from graphs import EDGES, NODES, edge, node
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.graph import SNAP
from graphloom.operators import relations as rl
from graphloom.operators import trees as tr
from graphloom.operators import typeflow as tf
from graphloom.operators.incremental import analyse
from graphloom.operators.snapshot_changes import snapshot_pairs
from graphloom.sources import export as ex
from graphloom.sources import interchange as ic
from graphloom.sources import items as it
from graphloom.sources import manifests as mf
from graphloom.sources.registry import PluginError, Registry
from graphloom.sources.store import Store, StoreError

DOC = "format: graph/v1\nkind: design\nnodes:\n  - canonical_path: /a\n    kind: system\n    children:\n      - {canonical_path: /a/b, kind: service}\nedges:\n  - {source: /a, target: /a/b, kind: depends}\n"


def test_documents():
    d = ic.parse_yaml(DOC)
    assert [n["canonical_path"] for n in d["nodes"]] == ["/a", "/a/b"] and d["edges"][0]["kind"] == "contains"
    for bad in (DOC.replace("graph/v1", "graph/v2"), DOC.replace("kind: design", "kind: dream"), DOC + "surprise: 1\n", "[", "- 1"):
        with pytest.raises(ic.DocumentError):
            ic.parse_yaml(bad)
    with pytest.raises(ic.DocumentError):
        ic.parse_json('{"format": "graph/v1", "kind": "design", "nodes": [{"canonical_path": "/a", "kind": "unit", "children": [{"canonical_path": "/a/b", "kind": "unit"}]}]}')


@settings(max_examples=30, deadline=None)
@given(st.recursive(st.just([]), lambda kids: st.lists(kids, max_size=3), max_leaves=12))
def test_flatten_keeps_all(tree):
    n = [0]

    def make(kids, at):
        n[0] += 1
        path = f"{at}/n{n[0]}"
        return {"canonical_path": path, "kind": "unit", "children": [make(k, path) for k in kids]}

    flat, edges = ic.flatten([make(tree, "")])
    assert len(flat) == n[0] and len(edges) == n[0] - 1 and all("children" not in x for x in flat)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.create_project("demo", "Demo")
    for bad in ("demo", "Demo", "", "1x"):
        with pytest.raises(StoreError):
            s.create_project(bad, "x")
    assert s.create_snapshot("demo", "design") == 1 and s.create_snapshot("demo", "analysis") == 2
    rows = spark.createDataFrame([("a", "/old", 1), ("a", "/new", 2), ("b", "/b", 3)], "id string, canonical_path string, seq int")
    assert s.put("nodes", "demo", 1, rows) == 2
    assert s.put("nodes", "demo", 1, spark.createDataFrame([("b", "/b2")], "id string, canonical_path string")) == 2
    assert {r["id"]: r["canonical_path"] for r in s.read("nodes", "demo", 1).collect()} == {"a": "/new", "b": "/b2"}
    assert s.copy("nodes", "demo", 1, 2) == 2 and s.copy("edges", "demo", 1, 2) == 0
    s.create_project("other", "Other")
    assert s.create_snapshot("other", "analysis") == 1
    assert s.create_snapshot("demo", "analysis") == 3
    assert s.compact("demo") == [2] and s.latest_version("demo") == 3
    assert s.read("nodes", "demo").count() == 2 and s.read("snapshots", "other").count() == 1
    v = ic.load(s, "demo", ic.parse_yaml(DOC))
    assert v == 4 and s.read("edges", "demo", 4).count() == 2
    assert {r["name"] for r in s.read("nodes", "demo", 4).collect()} == {"a", "b"}
    with pytest.raises(ic.DocumentError):
        ic.load(s, "demo", ic.parse_yaml(DOC.replace("source: /a,", "source: /x,")))
    (tmp_path / "newer").mkdir()
    spark.createDataFrame([('{"schema": 99}',)], "value string").write.text(str(tmp_path / "newer" / "_schema"))
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "newer"))


def test_diagrams(spark):
    ns = [node("app", "/app", kind="system"), node("core", "/app/core"), node("cli", "/app/cli"), node("model", "/app/core/model")]
    es = [edge("1", "app", "core"), edge("2", "app", "cli"), edge("3", "core", "model"), edge("4", "cli", "core", "depends")]
    n, e = spark.createDataFrame(ns, NODES), spark.createDataFrame(es, EDGES)
    pairs = tr.parent_table(n, e)
    paths = rl.path_edges(e.filter("kind <> 'contains'"), n)
    assert ex.text_of(ex.mermaid_lines(n, paths, pairs), "p", 1) == (
        'flowchart TD\n    subgraph app["/app"]\n        app_cli["/app/cli"]\n        subgraph app_core["/app/core"]\n            app_core_model["/app/core/model"]\n        end\n    end\n    app_cli -->|depends| app_core\n'
    )
    dot = ex.text_of(ex.dot_lines(n, paths, pairs), "p", 1)
    assert dot.splitlines()[3:6] == ["    subgraph cluster_app {", '        label="/app";', '        app_cli [label="/app/cli"];'] and dot.endswith('    app_cli -> app_core [label="depends"];\n}\n')
    c4 = ex.text_of(ex.c4_lines(n, e.filter("kind <> 'contains'"), pairs), "p", 1)
    assert 'System_Boundary(app, "app") {' in c4 and "Rel(" not in c4  # core holds a node, so it is a boundary
    seq = ex.text_of(ex.sequence_lines(e, n), "p", 1)
    assert "No call edges found" in seq


def test_manifests():
    assert mf.manifest_name("go.mod", "module code.example/a/b\n", "x/y") == "b"
    assert mf.manifest_name("package.json", "{broken", "x/y") == "y"
    assert mf.manifest_name("pom.xml", "<project><parent><artifactId>p</artifactId></parent><artifactId>me</artifactId></project>", "x") == "me"
    assert mf.go_dependencies("require (\n\ta.b/c v1\n\t// x\n)\nrequire d.e/f v2\n") == ["a.b/c", "d.e/f"]
    assert mf.python_dependencies('[project]\ndependencies = ["a-b>=1", "c[x]; python_version>\'3\'"]') == ["a_b", "c"]
    assert mf.gradle_dependencies("implementation 'g:a:1'\napi(\"g:b:2\")\nfoo 'g:c:1'") == ["a", "b"]
    assert mf.ts_dependencies("[1]") == [] and mf.cargo_dependencies("[dependencies]\nserde = '1'") == ["serde"]
    assert mf.workspace_name(["app-core", "app-cli"]) == "app" and mf.workspace_name(["x"]) is None


def test_parsers():
    py = it.parse_python("import os\nfrom . import a\nclass A(B):\n    def m(self):\n        f(1)\n    def _hidden(self): ...\ndef test_x(): ...\n", "pkg/sub/mod.py")
    assert [(i["name"], i["sub_kind"]) for i in py.items] == [("A", "class"), ("m", "method"), ("test_x", "function")]
    assert {("pkg::sub::mod::A::m", "f", "calls"), ("pkg::sub::mod::A", "B", "extends"), ("pkg::sub::mod", "pkg::sub", "depends")} <= {(r["source"], r["target"], r["kind"]) for r in py.relations}
    assert it.parse_python("def broken(:\n", "x.py").items == []
    rs = it.PARSERS["rs"]('pub struct S;\nimpl T for S {\n    fn go(&self) { run("{ fn no() {}"); }\n}\n#[test]\nfn works() {}\n', "crates/x/src/a.rs")
    assert [(i["name"], i["sub_kind"], i["line"], i["tags"]) for i in rs.items] == [("S", "struct", 1, []), ("go", "function", 3, []), ("works", "function", 6, ["test"])]
    assert {(r["target"], r["kind"]) for r in rs.relations} == {("T", "implements"), ("run", "calls")}
    go = it.PARSERS["go"]('package a\nimport "fmt"\ntype S struct { x int }\nfunc (s *S) Do() { fmt.Print(1) }\nfunc TestX(t *T) {}\n', "cmd/a/a_test.go")
    assert [(i["name"], i["sub_kind"]) for i in go.items] == [("S", "struct"), ("Do", "method"), ("TestX", "function")] and go.items[2]["tags"] == ["test"]


ITEMS = "qualified_name string, kind string, sub_kind string, name string, parent string, metadata string"


def test_type_flow(spark):
    items = spark.createDataFrame(
        [
            ("app::api::load", "unit", "function", "load", "app::api", '{"param_types":[{"name":"id","type":"app::Id"}],"return_type":"app::Row"}'),
            ("app::api::get_row", "unit", "function", "get_row", "app::api", '{"param_types":[{"name":"id","type":"app::Id"}],"return_type":"app::Row"}'),
            ("app::db::find", "unit", "function", "find", "app::db", '{"param_types":[{"name":"r","type":"app::Row"},{"name":"k","type":"String"}],"return_type":"app::Hit"}'),
            ("app::db::save", "unit", "method", "save", None, '{"param_types":[{"name":"h","type":"app::Hit"}]}'),
            ("app::Row", "unit", "struct", "Row", "app", None),
            ("app::conv", "unit", "impl", "conv", "app::Row", '{"trait":"From","impl_for":"app::Hit"}'),
            ("app::conv2", "unit", "impl", "conv2", "app::Row", '{"trait":"Display","impl_for":"app::Hit"}'),
        ],
        ITEMS,
    )
    calls = [("app::api::load", "app::db::find", "calls"), ("app::db::find", "app::api::load", "calls"), ("app::api::load", "app::api::get_row", "calls"), ("app::db::find", "app::Row", "depends"), ("app::db::find", "nowhere::X", "depends"), ("app::db::find", "app::Row", "depends")]
    relations = spark.createDataFrame(calls, "source string, target string, kind string")
    sigs = tf.signatures(items)
    assert sorted((r["qualified_name"], r["module"], r["returns"]) for r in sigs.collect()) == [("app::api::get_row", "app::api", "app::Row"), ("app::api::load", "app::api", "app::Row"), ("app::db::find", "app::db", "app::Hit"), ("app::db::save", "app::db", None)]
    assert [tuple(r) for r in tf.from_transforms(items).collect()] == [("app::Row", "app::Hit")]
    assert sorted(map(tuple, tf.signature_transforms(sigs).collect())) == [("app::Id", "app::Row"), ("app::Row", "app::Hit")]
    assert [tuple(r) for r in tf.cross_module_flows(relations, sigs).collect()] == [("app::api", "app::db", "app::Row")]
    assert tf.called_signatures(relations, sigs).count() == 3
    nodes, edges, warnings = tf.map_to_graph(items, relations)
    assert nodes.count() == 7 and [(r["unresolved"], r["kind"]) for r in warnings.collect()] == [("nowhere::X", "depends")]
    assert {(r["source_path"], r["target_path"], r["kind"]) for r in edges.collect()} >= {("/app/db/find", "/app/row", "depends"), ("/app/api/load", "/app/db/find", "calls")}


def test_reparenting(spark):
    rows = [
        ("a", "a::types::Row", "struct", "a::types"), ("a", "a::api::Row::new", "method", "a::api::Row"),  # the only Row of its crate
        ("b", "b::Hit", "enum", "b"), ("a", "a::api::Hit::go", "method", "a::api::Hit"),  # the only Hit anywhere
        ("b", "b::Key", "struct", "b"), ("c", "c::Key", "struct", "c"), ("a", "a::x::Key::of", "method", "a::x::Key"),  # two, but a depends on c
        ("b", "b::protocol::Record", "struct", "b::protocol"), ("d", "d::other::Record", "struct", "d::other"), ("a", "a::client::protocol::Record::f", "method", "a::client::protocol::Record"),  # by its path
        ("b", "b::Pair", "struct", "b"), ("d", "d::Pair", "struct", "d"), ("a", "a::z::Pair::f", "method", "a::z::Pair"),  # open
        ("a", "a::api::None::f", "method", "a::api::None"), ("a", "a::f", "function", "a"),
    ]
    items = spark.createDataFrame(rows, "crate string, qualified_name string, sub_kind string, parent string")
    deps = spark.createDataFrame([("a", "c"), ("d", "b")], "crate string, dependency string")
    got = {(r["parent"], r["new_parent"]) for r in tf.reparent(items, deps).collect()}
    want = {("a::api::Row", "a::types::Row"), ("a::api::Hit", "b::Hit"), ("a::x::Key", "c::Key"), ("a::client::protocol::Record", "b::protocol::Record")}
    assert {x for x in got if x[0] in {"a::api::Row", "a::api::Hit", "a::x::Key", "a::client::protocol::Record", "a::z::Pair", "a::api::None"}} == want


def test_signatures_out_of_sources():
    def meta(ext, text, path):
        return {i["name"]: json.loads(i["metadata"]) for i in it.PARSERS[ext](text, path).items if i["metadata"]}

    rs = meta("rs", "use ws::db::Row;\npub struct Hit;\nimpl From<Row> for Hit { fn from(r: Row) -> Self { Hit } }\npub fn find(r: &Vec<Row>, n: usize, o: Option<Box<Hit>>) -> Result<Hit, E> { go(r) }\nfn get_x(&self) -> String { a }\n", "crates/x/src/a.rs")
    hit = "crates::x::a::Hit"
    assert rs["find"] == {"param_types": [{"name": "r", "type": "ws::db::Row"}, {"name": "o", "type": hit}], "return_type": hit} and rs["From<Row>"] == {"trait": "From", "impl_for": hit} and "get_x" not in rs
    ts = meta("ts", "import { Row } from './db';\nexport class Hit {}\nexport function find(r: Row[], n?: number): Promise<Hit> { return go(r) }\n", "packages/x/src/a.ts")
    assert ts == {"find": {"param_types": [{"name": "r", "type": "packages::db::Row"}], "return_type": "packages::x::a::Hit"}}
    go = meta("go", "package a\ntype Hit struct { x int }\nfunc Find(a, b *Hit, n int) (*Hit, error) {\n}\nfunc (s *Hit) Do(r []Hit) string {\n}\n", "cmd/a/a.go")
    assert go["Find"] == {"param_types": [{"name": "a", "type": "cmd::a::Hit"}, {"name": "b", "type": "cmd::a::Hit"}], "return_type": "cmd::a::Hit"} and go["Do"] == {"param_types": [{"name": "r", "type": "cmd::a::Hit"}]}
    py = meta("py", "from a.b import Row\nclass Hit: ...\ndef f(r: list[Row], n: int) -> Hit: ...\n", "x/m.py")
    assert py == {"f": {"param_types": [{"name": "r", "type": "a::b::Row"}], "return_type": "x::m::Hit"}}
    java = meta("java", "package a;\nimport p.q.Row;\npublic class W {\n  public W size(final Row x, int c) { return x; }\n}\n", "src/main/java/a/W.java")
    assert java["size"]["param_types"] == [{"name": "x", "type": "p::q::Row"}] and java["size"]["return_type"].endswith("::W")


def test_incremental(spark):
    m = spark.createDataFrame([("p", 1, "a.py", "h1", "u", "python"), ("p", 1, "b.py", "h2", "w", "python"), ("p", 2, "a.py", "h9", "u", "python"), ("p", 2, "b.py", "h2", "w", "python")], "project_id string, version long, path string, hash string, unit_name string, language string")
    files = spark.createDataFrame([("a.py", "def f(): ...\ndef g(): ...\n"), ("b.py", "def h(): ...\n")], "path string, content string")
    out, _ = analyse(m, files, snapshot_pairs(m))
    got = sorted((r["version"], r["unit_name"], r["name"], r["copied"]) for r in out.collect())
    assert got == [(1, "u", "f", False), (1, "u", "g", False), (1, "w", "h", False), (2, "u", "f", False), (2, "u", "g", False), (2, "w", "h", True)]


def test_long_headers_and_comments():
    java = it.PARSERS["java"]("class A extends B<" + "x.y.Z, " * 100 + "Q> implements I {\n}\n", "src/A.java")
    assert {(r["target"], r["kind"]) for r in java.relations} >= {("B", "extends"), ("I", "implements")}
    rust = it.PARSERS["rs"]("fn a() {}\n#[test]\n// " + "long " * 60 + "\nfn b() {}\n", "crates/x/src/a.rs")
    assert [(i["name"], i["tags"]) for i in rust.items] == [("a", []), ("b", ["test"])]


def test_registry():
    class Good:
        """Adds nothing."""

        API_VERSION = 1

        @staticmethod
        def register(registry):
            registry.exporters["x"] = lambda *a: None

    r = Registry()
    r.add("good", Good)
    assert "x" in r.exporters and r.info() == [("good", "Adds nothing.")]
    r.remove("good")
    with pytest.raises(PluginError):
        r.remove("good")
    assert SNAP == ["project_id", "version"]
