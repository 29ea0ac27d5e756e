import subprocess

from pyspark.sql import functions as F

from codeloom.operators import chunking, extract, inference, routes, store
from codeloom.sources import scan

FILES = {
    "src/auth.py": "import os\nfrom db import users\n\nclass Auth(Base):\n    def login(self, user):\n        return check(user)\n\n\nasync def check(user):\n    if user and os:\n        return 1\n",
    "tests/test_auth.py": "from src.auth import Auth\n\ndef test_login():\n    Auth().login('x')\n",
    "src/bad.py": "def (:\n",
    "web/server.ts": "import { helper } from './util'\nexport class Server {\n}\nconst run = (a) => {\n  helper(a)\n}\nfunction start() {\n  run(1)\n}\napp.post('/login', start)\n",
    "web/util.ts": "export function helper() {\n}\n",
    "main.go": 'package main\n\nimport (\n  "fmt"\n  "os"\n)\n\nfunc Run(x int) {\n  fmt.Println(x)\n}\n\ntype Thing struct {\n}\n',
    "lib.rs": "use std::io;\npub fn go() {\n}\npub struct S {\n}\n",
    "A.java": "import java.util.List;\npublic class A {\n  public void run(int x) {\n  }\n}\n",
    "db/schema.sql": "CREATE TABLE users (id INT);\nSELECT * FROM users JOIN roles ON 1=1;\n",
    "docs/README.md": "# Title\n\ntext\n\n## Auth\n\nlogin\n\n## Auth\n",
    "docs/x.rst": "Title\n=====\n\ntext\n",
    ".env": "API_KEY=abc\n# note\nexport NAME=x\n",
    "conf/a.json": '{"b": 1, "a": 2}',
    "conf/b.json": "{broken",
    "conf/c.toml": "[tool]\nx = 1\n",
    "k8s/app.yaml": "apiVersion: v1\nkind: Pod\nmetadata:\n  name: p\n---\nkind: Service\n",
    "infra/main.tf": 'resource "aws_x" "y" {\n}\n',
    "Dockerfile": "FROM x\n",
    "node_modules/x.js": "function no() {}\n",
    "_app.py": "x = 1\n",
    "data.bin": "?",
}


def tree(tmp_path):
    for name, text in FILES.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(tmp_path)


def test_scan_extract_infer_and_store(spark, tmp_path):
    root = tree(tmp_path / "r")
    files = scan.files(spark, root).cache()
    assert {r.path for r in files.collect()} == set(FILES) - {"node_modules/x.js", "data.bin"}
    facts = extract.facts(files).cache()
    nodes, edges = extract.nodes(facts).cache(), extract.edges(facts).cache()
    named = {(r.type, r.name) for r in nodes.collect()}
    for want in (
        ("class", "Auth"), ("function", "login"), ("function", "check"), ("test", "test_login"), ("module", "os"), ("class", "Server"), ("function", "run"), ("function", "start"),
        ("function", "Run"), ("type", "Thing"), ("module", "fmt"), ("function", "go"), ("type", "S"), ("class", "A"), ("database_table", "users"), ("section", "Auth"), ("section", "Title"),
        ("config", "a.json"), ("config", "c.toml"), ("resource", "app.yaml"), ("resource", "resource.aws_x.y"), ("resource", "Dockerfile"), ("module", "./util"),
    ):
        assert want in named, want
    assert facts.where("fact = 'warning'").count() == 1
    by_id = {r.id: r for r in nodes.collect()}
    assert ("api_endpoint", "POST /login") in named
    used = [e for e in edges.collect() if e.type in ("calls", "routes_to")]
    assert used and all(e.source_id in by_id and e.target_id in by_id for e in used)
    assert ("server", "routes_to", "POST /login") in {(by_id[e.source_id].name, e.type, by_id[e.target_id].name) for e in used}
    kinds = {(by_id[e.source_id].name, e.type, by_id[e.target_id].name) for e in edges.collect() if e.source_id in by_id and e.target_id in by_id}
    assert {("login", "calls", "check"), ("Auth", "inherits", "Base"), ("start", "calls", "run"), ("schema.sql", "writes_to", "users"), ("schema.sql", "reads_from", "roles"), ("README.md", "contains", "Auth")} <= kinds
    assert nodes.where("type = 'section' and name = 'Auth'").count() == 2
    go = nodes.where("name = 'Run'").first()
    assert (go.line_start, go.line_end) == (8, 10)

    tested = inference.test_edges(nodes.select("id", "type", "name", "file_path")).collect()
    assert ("login", "test_login") in {(by_id[e.source_id].name, by_id[e.target_id].name) for e in tested}
    imports = facts.where("fact = 'import'").select(F.col("source").alias("source_id"), F.lit("x").alias("target_id"), F.col("target").alias("imported"), F.col("path").alias("source_file"))
    local = inference.import_edges(imports, nodes.where("type = 'module'").select(F.col("qualified_name").alias("id"), "qualified_name"))
    assert ("web.server.ts", "web.util.ts") in {(r.source_id, r.target_id) for r in local.collect()}

    spans = chunking.materialized(chunking.symbols(files.where("path = 'src/auth.py'").select("path", "content"), nodes)).collect()
    assert any(s.content.startswith("async def check") and s.line_start == 9 for s in spans)

    catalog = store.Catalog(spark, f"file://{tmp_path}/store")
    assert catalog.version() is None and catalog.read("nodes").count() == 0
    catalog.commit({"files": files, "nodes": nodes, "edges": edges})
    assert scan.unindexed(files, catalog.read("files")).count() == 0
    (tmp_path / "r/src/auth.py").write_text("def login():\n    pass\n")
    changed = scan.unindexed(scan.files(spark, root), catalog.read("files"))
    assert [r.path for r in changed.collect()] == ["src/auth.py"]
    more = extract.facts(changed)
    made = store.replace_files(catalog.read("nodes"), catalog.read("edges"), catalog.read("chunks"), changed.select("path"), {"nodes": extract.nodes(more)})
    again = catalog.commit(made | {"files": store.upsert(catalog.read("files"), changed.select("path", "language", "category", "size_bytes", "content_hash", "raw_hash", F.lit(False).alias("is_deleted"), "is_generated", "is_test"), ["path"])})
    assert again == 2 and catalog.read("nodes").where("name = 'check'").count() == 0 and catalog.read("nodes", 1).where("name = 'check'").count() == 1
    assert scan.unindexed(scan.files(spark, root), catalog.read("files")).count() == 0


def test_routes(spark):
    text = "@app.get('/health')\n\n\n@router.websocket('/ws')\n@bp.route('/f', methods=['POST', 'PUT'])\nurlpatterns = [path('users/', views.users)]\n"
    files = spark.createDataFrame([("a.py", text)], "path string, content string")
    got = {(r.method, r.route, r.line) for r in routes.python_routes(files).collect()}
    assert got == {("GET", "/health", 1), ("WEBSOCKET", "/ws", 4), ("ANY", "/f", 5), ("POST", "/f", 5), ("PUT", "/f", 5), ("ANY", "users/", 6)}
    nest = "@Get()\nx() {}\n@Controller('users')\nclass U {\n @Get(':id')\n a() {}\n @Post()\n b() {}\n}\n@Controller()\nclass V { @All('z') c() {} }\n"
    got = {(r.method, r.route) for r in routes.nest_routes(spark.createDataFrame([("u.ts", nest)], "path string, content string")).collect()}
    assert got == {("GET", "/"), ("GET", "/users/:id"), ("POST", "/users"), ("ANY", "/z")}
    pages = [("app/page.tsx", ""), ("app/users/[id]/page.tsx", ""), ("app/api/health/route.ts", "export async function GET() {}\nexport const POST = 1\n"), ("pages/api/version.ts", ""), ("pages/_app.tsx", ""), ("app/(shop)/cart/page.js", ""), ("lib/x.ts", "")]
    got = {(r.method, r.route) for r in routes.next_routes(spark.createDataFrame(pages, "path string, content string")).collect()}
    assert got == {("GET", "/"), ("GET", "/users/[id]"), ("GET", "/api/health"), ("ANY", "/api/version"), ("GET", "/cart")} | {("POST", "/api/health")} - set()


def test_git_sources(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", "."), run("commit", "-qm", "first")
    assert [r.subject for r in scan.commits(spark, str(tmp_path)).collect()] == ["first"]
    (tmp_path / "a.py").write_text("x = 2\n")
    assert [tuple(r) for r in scan.changed_files(spark, str(tmp_path)).collect()] == [("a.py", "M")]
    assert "+x = 2" in scan.patches(spark, str(tmp_path)).first().patch
    assert scan.porcelain(" M a.py\nR  old -> new") == [("a.py", "M"), ("new", "R")]
    assert scan.branch(str(tmp_path / "none")) == "unknown"
