"""The syntax readers and the rules over their nodes."""

import pytest
from pyspark.sql import functions as F

from crosscut.operators import blocks, merge, nodes, source_lines, structural_rules
from crosscut.plans import source_queries

from .test_entry import check

TS = """
import x from 'y'
const cache = []
let n = 0
// comment "no"
export async function load(id) {
  const r = await fetch(`/a/${id}`)
  try {
    await axios.get("/x")
  } catch (e) {
    console.log(e)
  }
  for (const u of users) {
    await db.query(u)
  }
  fetch('/fire')
  fetch('/b').then(r => r.json()).catch(() => {})
  cache.push(r)
  n++
  return fetch('/r')
}
async function race() {
  const user = await users.findOne(1)
  if (!user) {
    await users.create(1)
  }
}
fs.writeFileSync('./a.txt', t)
class K { async m() { orders.find().limit(5); orders.find().sort().limit(3) } }
"""
PY = """
import requests
items = []
LIMIT = {"a": 1}

@app.get("/x")
async def f(request):
    time.sleep(1)
    try:
        requests.get("u")
    except Exception:
        pass
    for i in range(3):
        requests.post(i)
    items.append(1)

def g():
    try:
        h()
    except ValueError as e:
        logger.info(e)
        raise
    users = session.query(User)
    few = session.query(User)[:10]
    return requests.get("u")

def view(request):
    time.sleep(2)
"""
GO = """
package main
var cache = make(map[string]int)
var MAX_SIZE = 5
func handler(w http.ResponseWriter, r *http.Request) {
    rows, err := db.Query("q")
    if err != nil { return }
    for _, id := range ids {
        db.Exec("x", id)
    }
    _, _ = os.Open("f")
    os.WriteFile("a", b, 0)
    db.Query("select").Limit(3)
}
"""
RB = """
class UsersController
  LIST = []
  @@count = 0
  def show
    user = User.find(1)
    users.each do |u|
      u.update(a: 1)
    end
    begin
      File.read("x")
    rescue
    end
    all = User.where(a: 1).limit(3)
    User.all
  end
end
"""


def found(spark, name, source, changed=None):
    df = spark.createDataFrame([(1, name, source)], "file_key long, filename string, content string")
    c = None if changed is None else spark.createDataFrame([(1, x) for x in changed], "file_key long, line int")
    return {(r["kind"], r["line"]) for r in structural_rules.analyze_structure(df, c).collect()}


def test_typescript(spark):
    got = found(spark, "a.ts", TS)
    yes = {("UNSAFE_IO", 7), ("SILENT_ERROR", 10), ("LOOPED_IO", 14), ("ASYNC_MISUSE", 16), ("SILENT_ERROR", 17), ("GLOBAL_MUTATION", 3), ("GLOBAL_MUTATION", 4), ("CHECK_THEN_ACT_RACE", 23), ("BLOCKING_OPERATION", 28), ("SHARED_FILE_WRITE", 28), ("UNBOUNDED_QUERY", 14)}
    no = {("UNSAFE_IO", 9), ("UNSAFE_IO", 14), ("UNSAFE_IO", 17), ("ASYNC_MISUSE", 20), ("ASYNC_MISUSE", 7), ("LOOPED_IO", 7)}
    assert yes <= got, yes - got
    assert not no & got, no & got


def test_pagination_counts_only_if_chained_directly(spark):
    got = found(spark, "a.js", "orders.find().limit(5)\norders.find().sort().limit(3)\norders.findMany({ take: 3 })\n")
    assert ("UNBOUNDED_QUERY", 1) not in got and ("UNBOUNDED_QUERY", 2) in got and ("UNBOUNDED_QUERY", 3) not in got


def test_python(spark):
    got = found(spark, "a.py", PY)
    yes = {("BLOCKING_OPERATION", 8), ("SILENT_ERROR", 11), ("LOOPED_IO", 14), ("GLOBAL_MUTATION", 3), ("UNBOUNDED_QUERY", 23), ("UNSAFE_IO", 25), ("BLOCKING_OPERATION", 28)}
    no = {("UNSAFE_IO", 10), ("SILENT_ERROR", 20), ("GLOBAL_MUTATION", 4), ("UNBOUNDED_QUERY", 24)}
    assert yes <= got, yes - got
    assert not no & got, no & got


def test_go(spark):
    got = found(spark, "a.go", GO)
    yes = {("GLOBAL_MUTATION", 3), ("LOOPED_IO", 9), ("SILENT_ERROR", 11), ("UNSAFE_IO", 12), ("UNBOUNDED_QUERY", 6)}
    no = {("GLOBAL_MUTATION", 4), ("UNSAFE_IO", 6), ("UNSAFE_IO", 9), ("UNBOUNDED_QUERY", 13)}
    assert yes <= got, yes - got
    assert not no & got, no & got
    assert not found(spark, "a_test.go", GO)


def test_ruby(spark):
    got = found(spark, "a.rb", RB)
    yes = {("GLOBAL_MUTATION", 3), ("GLOBAL_MUTATION", 4), ("UNSAFE_IO", 6), ("LOOPED_IO", 8), ("SILENT_ERROR", 12), ("UNBOUNDED_QUERY", 15)}
    no = {("UNSAFE_IO", 11), ("UNBOUNDED_QUERY", 14)}
    assert yes <= got, yes - got
    assert not no & got, no & got


def test_changed_lines_only(spark):
    assert found(spark, "a.ts", TS, [7]) == {("UNSAFE_IO", 7), ("UNBOUNDED_QUERY", 7)}


def test_broken_files_are_read_as_far_as_they_go(spark):
    df = spark.createDataFrame([(1, "a.py", "def ("), (2, "b.py", "x = 1"), (3, "c.md", "x"), (4, "d.ts", None), (5, "e.ts", "{{{ ((( ` /* "), (6, "f.rb", ""), (7, "g.go", "}}}")], "file_key long, filename string, content string")
    got = {r["file_key"]: (r["language"], r["parse_success"]) for r in source_lines.read_status(df).collect()}
    assert got == {1: ("python", True), 2: ("python", True), 4: ("typescript", False), 5: ("typescript", True), 6: ("ruby", True), 7: ("go", True)}
    assert {r["file_key"] for r in nodes.syntax_nodes(df).collect()} <= {2}


@pytest.mark.parametrize(
    ("name", "source", "want"),
    [
        ("a.ts", "x // c\n/* a\nb */ 'q' + `t\nu`", {(1, 1, "comment"), (2, 3, "comment"), (3, 3, "string"), (3, 4, "string")}),
        ("a.js", "u = 'http://x' // y", {(1, 1, "string"), (1, 1, "comment")}),
        ("a.py", "x = '#no' # yes\n'''a\nb'''", {(1, 1, "string"), (1, 1, "comment"), (2, 3, "string")}),
        ("a.go", "s := `a\nb` // c", {(1, 2, "string"), (2, 2, "comment")}),
        ("a.rb", "=begin\nx\n=end\ny = \"s\" # c\n:sym", {(1, 3, "comment"), (4, 4, "string"), (4, 4, "comment"), (5, 5, "string")}),
    ],
)
def test_ranges(spark, name, source, want):
    df = spark.createDataFrame([(1, name, source)], "file_key long, filename string, content string")
    assert {(r["start_line"], r["end_line"], r["range_type"]) for r in source_lines.ignored_ranges(source_lines.source_lines(df)).collect()} == want


def test_positions_in_ranges(spark):
    df = spark.createDataFrame([(2, 5, 4, 3)], "start_line int, start_col int, end_line int, end_col int")
    for line, col, want in [(2, 4, False), (2, 5, True), (3, 0, True), (4, 3, True), (4, 4, False), (1, 9, False)]:
        assert df.select(source_lines.in_range(F.lit(line), F.lit(col))).first()[0] == want
        assert df.select(source_lines.inside_lines(F.lit(line))).first()[0] == (line == 3)


def test_ranges_and_structure_feed_the_merge(spark):
    df = spark.createDataFrame([(1, "a.ts", TS)], "file_key long, filename string, content string")
    text = spark.createDataFrame([(1, 1, 7, "CONSOLE_DEBUG"), (1, 2, 5, "CONSOLE_DEBUG"), (1, 3, 7, "UNSAFE_IO")], "file_key long, seq long, line int, kind string")
    kept = merge.outside_ranges(text, source_lines.ignored_ranges(source_lines.source_lines(df)))
    assert kept.count() == 0  # line 5 is a comment and line 7 holds a string
    got = merge.merge_structural(structural_rules.analyze_structure(df).select("file_key", "seq", "line", "kind"), text)
    rows = {(r["line"], r["kind"]): r["origin"] for r in got.collect()}
    assert rows[(7, "UNSAFE_IO")] == "structural" and rows[(7, "CONSOLE_DEBUG")] == "textual"


@pytest.mark.parametrize("name", list(source_queries.QUERIES))
def test_query_equals_sql(spark, name):
    check(spark, name)


def files(spark, *sources):
    return spark.createDataFrame([(k, *f) for k, f in enumerate(sources)], "file_key long, filename string, content string")


def test_line_states_of_long_and_odd_files(spark):
    long = "x = `a\n" + "b\n" * 700 + "c` // d\n" + "'q' /* e */\n" * 300
    df = files(spark, ("a.ts", long), ("b.rb", "x = <<~SQL.strip + 'a'\n  select 'b\n  SQL\ny = 1"), ("c.ts", "const r = /[\"'/]/g // c\nlet s = 'a\\'b' + \"\\\\\"\n/*\n\n*/ x = a / b / c"), ("d.py", ""), ("e.go", "\\" * 60_000 + "\n\"" + "\\n" * 60_000 + "\" // x"), ("f.py", "é = '😀' # ü"))
    got = {}
    for r in source_lines.ignored_ranges(source_lines.source_lines(df)).collect():
        got.setdefault(r["file_key"], set()).add((r["start_line"], r["end_line"], r["start_col"], r["end_col"], r["range_type"]))
    assert {(1, 702, 4, 2, "string"), (702, 702, 3, 7, "comment"), (703, 703, 0, 3, "string"), (703, 703, 4, 11, "comment")} <= got[0] and len(got[0]) == 602
    assert got[1] == {(1, 1, 4, 10, "string"), (1, 1, 19, 22, "string"), (2, 3, 0, 5, "string")}
    assert got[2] == {(1, 1, 10, 18, "string"), (1, 1, 19, 23, "comment"), (2, 2, 8, 14, "string"), (2, 2, 17, 21, "string"), (3, 5, 0, 2, "comment")}
    assert 3 not in got and {r[-1] for r in got[4]} == {"string", "comment"} and got[5] == {(1, 1, 4, 7, "string"), (1, 1, 8, 11, "comment")}


def scope(spark, name, source):
    return {r["line"]: r for r in blocks.line_scopes(files(spark, (name, source))).collect()}


def test_scopes_of_braces(spark):
    got = scope(spark, "a.ts", "}\nfor (let i = 0; i < n; i++) {\n  a()\n}\nclass K {\n  async m(x: string): Promise<void> {\n    try {\n      list.map((v) => fetch(v))\n    } finally {\n      b()\n    }\n  }\n}\nconst f = async (a) => {\n  const g = function () {\n    c()\n  }\n  while (x) d()\n  do {\n    e()\n  } while (y)\n}\nrest()")
    assert got[3]["in_loop"] and not got[3]["in_function"]
    assert (got[6]["class_name"], got[7]["in_async"], got[7]["parent_fn"]) == ("K", True, "m") and got[8]["in_try"] and not got[10]["in_try"]
    assert (got[16]["parent_fn"], got[16]["in_async"], got[15]["in_async"]) == ("g", False, True)
    assert got[20]["in_loop"] and not got[19]["in_loop"] and got[23]["module_scope"] and not got[23]["in_loop"]


def test_scopes_of_indents_and_ends(spark):
    got = scope(spark, "a.py", "def f(a,\n      b):\n    for x in a:\n        g()\n\n        # note\n        h()\n    try: i()\n    except E:\n        j()\nclass K:\n\tasync def m(self):\n\t\tk()\nl()")
    assert got[7]["in_loop"] and not got[8]["in_loop"] and got[10]["in_function"] and not got[10]["in_try"]
    assert (got[13]["class_name"], got[13]["parent_fn"], got[13]["in_async"], got[14]["module_scope"]) == ("K", "m", True, True)
    got = scope(spark, "a.rb", "end\nclass K\n  def m\n    xs.each do |x|\n      if x\n        y\n      end\n      z\n    end\n    v = begin\n      w\n    end\n  end\nend\nq")
    assert got[8]["in_loop"] and not got[10]["in_loop"] and got[11]["in_try"] and got[15]["module_scope"]


def test_only_the_next_four_statements_count(spark):
    body = lambda *ls: "async function f() {\n" + "\n".join(ls) + "\n}"
    sources = [
        body("const a = await users.findOne(1)", "b()", "c()", "d()", "if (!a) {\n  users.create(1)\n}"),
        body("const a = await users.findOne(1)", "b()", "c()", "d()", "e()", "users.create(1)"),
        body("return users.findOne(1)", "users.create(1)"),
        "const a = users.findOne(1)\nusers.create(1)",
        body("const a = await users\n  .findOne(1)", "users.create(1); users.save(1); users.add(2)"),
        body("if (await users.exists(1)) {\n  x()\n}", "users.create(1)"),
    ]
    df = files(spark, *[("a.ts", s) for s in sources])
    lines = blocks.placed(source_lines.source_lines(df))
    marks = blocks.brackets(lines)
    got = {}
    for r in blocks.checks_then_acts(marks, blocks.statements(lines, marks)).collect():
        got.setdefault(r["file_key"], []).append((r["line"], r["act_line"]))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(2, 7)], 4: [(3, 4), (3, 4), (3, 4)]}
