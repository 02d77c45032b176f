"""Code-like inputs derived from the star-schema tables, in Spark and as SQL: ordered lines, findings, hook events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import DEFAULT_LEVELS, RULE_IDS

#: One line of code for each slot; a slot is a part's number mod 40.
PALETTE = [
    "const total = left + right;",
    "  width: 12,",
    "}",
    "",
    "  return res.json({ ok: true, id: row });",
    "  let label = names[0];",
    "// explains the next step",
    "  if (ready) {",
    "  res.send({ error: text });",
    "function area(w, h) {",
    "  } else {",
    "  height += 2",
    "  const answer = await fetch(address);",
    "  rows = db.run(statement)",
    "  try {",
    "  } catch (e) {",
    "  for (const user of users) {",
    "  users.forEach(show)",
    "  const found = orders.findMany(where)",
    "    .limit(10)",
    "app.get('/orders', handler)",
    "  const name = req.body.name as string",
    "  schema.check(name)",
    "  // TODO: replace this",
    "  console.log(name)",
    "  const first = list!.head",
    "async function load() {",
    "  client.send(message).then(show)",
    "  const raw = fs.readFileSync(path)",
    "  writeFile('./out.json', text)",
    "  retryCall(() => fetch(address))",
    "while (true) {",
    "  const known = await users.findOne(key)",
    "  users.create(key)",
    "  const password = 'abcdefghijklmnopqrstuvwx'",
    "  this.cache = new Map()",
    "import sqlite3",
    "  eval(source)",
    "  got('http://localhost:8080/items')",
    None,
]
#: Slot 39: by the supplier's number, odd ones a module variable, even ones a directive by their last digit, or by all of it.
ODD = "let counter = 0"
EVEN = {
    0: "// risk-ignore-next-line UNSAFE_IO, HARDCODED_SECRET",
    2: "// risk-ignore-next-line ALL",
    4: "// TODO soon, RISK-IGNORE-LINE TEMPORARY_HACK",
    6: "// risk-ignore-file CONSOLE_DEBUG, MADE_UP_RULE",
    8: "// risk-ignore-line MADE_UP_RULE",
}
WHOLE = "// risk-ignore-file ALL"  # suppliers whose number ends in 50
#: What each of those says; the one that names no known rule says nothing.
DIRECTIVES = {
    EVEN[0]: ("next-line", False, "UNSAFE_IO,HARDCODED_SECRET"),
    EVEN[2]: ("next-line", True, ""),
    EVEN[4]: ("line", False, "TEMPORARY_HACK"),
    EVEN[6]: ("file", False, "CONSOLE_DEBUG"),
    WHOLE: ("file", True, ""),
}
MUTATION = "counter = counter + 1"  # slot 5 of suppliers divisible by 3
CATCH = "  catch (e) {"  # slot 15 of suppliers with odd numbers: its block goes on below


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_slots = " ".join(f"WHEN {i} THEN {_text(p)}" for i, p in enumerate(PALETTE) if p is not None)
_even = " ".join(f"WHEN {i} THEN {_text(p)}" for i, p in EVEN.items())
BODY_SQL = f"""CASE WHEN l_partkey % 40 = 5 AND l_suppkey % 3 = 0 THEN {_text(MUTATION)} WHEN l_partkey % 40 = 15 AND l_suppkey % 2 = 1 THEN {_text(CATCH)}
 WHEN l_partkey % 40 <> 39 THEN CASE l_partkey % 40 {_slots} END WHEN l_suppkey % 2 = 1 THEN {_text(ODD)} WHEN l_suppkey % 100 = 50 THEN {_text(WHOLE)} ELSE CASE l_suppkey % 10 {_even} END END"""
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]

LINES_SQL = f"""
src_lines AS (
  SELECT o_custkey AS file_key, row_number() OVER (PARTITION BY o_custkey ORDER BY {", ".join(ORDER)}) AS idx,
    CASE WHEN l_returnflag <> 'R' THEN '+' WHEN l_linestatus = 'F' THEN '-' ELSE ' ' END || {BODY_SQL} AS raw
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
corpus AS (
  SELECT file_key, idx, raw FROM src_lines
  UNION ALL SELECT DISTINCT file_key, 0, '@@ -1,1 +' || (1 + file_key % 3) || ',1 @@' FROM src_lines),
lines AS MATERIALIZED (
  SELECT file_key, CASE file_key % 5 WHEN 0 THEN 'src/api/' WHEN 1 THEN 'src/core/' WHEN 2 THEN 'src/infra/' WHEN 3 THEN 'playground/' ELSE 'tests/' END
    || 'f' || file_key || CASE WHEN file_key % 11 = 0 THEN '.test.' ELSE '.' END
    || CASE file_key % 7 WHEN 0 THEN 'ts' WHEN 1 THEN 'js' WHEN 2 THEN 'py' WHEN 3 THEN 'go' WHEN 4 THEN 'rb' WHEN 5 THEN 'java' ELSE 'md' END AS filename,
    idx, raw FROM corpus)"""


def _pick(slot: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (slot + 1).cast("int"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_name(key: Column) -> Column:
    where = _pick(key % 5, ["src/api/", "src/core/", "src/infra/", "playground/", "tests/"])
    return F.concat(where, F.lit("f"), key.cast("string"), F.when(key % 11 == 0, ".test.").otherwise("."), _pick(key % 7, ["ts", "js", "py", "go", "rb", "java", "md"]))


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_key, filename, idx, raw): one pseudo-file a customer, one line an item, below a hunk header."""
    x = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sign = F.when(F.col("l_returnflag") != "R", "+").when(F.col("l_linestatus") == "F", "-").otherwise(" ")
    x = x.withColumn("idx", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*ORDER)))
    x = x.select(F.col("o_custkey").alias("file_key"), "idx", F.concat(sign, F.expr(BODY_SQL.replace("\\", "\\\\"))).alias("raw"))
    head = x.where("idx = 1").select("file_key", F.lit(0).alias("idx"), F.concat(F.lit("@@ -1,1 +"), (1 + F.col("file_key") % 3).cast("string"), F.lit(",1 @@")).alias("raw"))
    return x.unionByName(head).select("file_key", file_name(F.col("file_key")).alias("filename"), "idx", "raw")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_key, filename, content): added and context lines of corpus_lines as whole files, at most about a hundred lines each."""
    x = corpus_lines(spark, sf_dir).where((F.col("idx") > 0) & ~F.col("raw").startswith("-"))
    x = x.groupBy("file_key", "filename").agg(F.sort_array(F.collect_list(F.struct("idx", F.substring("raw", 2, 1000).alias("t")))).alias("l"))
    return x.select("file_key", "filename", F.array_join(F.transform("l", lambda s: s["t"]), "\n").alias("content"))


_rule = ", ".join(_text(r) for r in RULE_IDS)
_levels = " ".join(f"WHEN {_text(r)} THEN {_text(v)}" for r, v in DEFAULT_LEVELS.items())
FINDINGS_SQL = f"""
raw_findings AS (
  SELECT o_custkey AS pr_id, row_number() OVER (PARTITION BY o_custkey ORDER BY {", ".join(ORDER)}) AS seq,
    'src/f' || (l_suppkey % 20) || '.ts' AS file, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_partkey % 200 + 1 END AS line,
    ([{_rule}])[l_partkey % 25 + 1] AS kind, CASE l_linenumber % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
    'note ' || (l_partkey % 7) AS message, CASE WHEN l_tax = 0 THEN NULL ELSE round(l_discount * 10, 2) END AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
findings AS MATERIALIZED (SELECT *, CASE kind {_levels} END AS level FROM raw_findings)"""


def findings_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pr_id, seq, file, line, kind, severity, level, message, confidence): one synthetic finding an item."""
    from ..functions.rules import lookup

    x = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.withColumn("seq", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*ORDER)))
    x = x.select(
        F.col("o_custkey").alias("pr_id"),
        "seq",
        F.concat(F.lit("src/f"), (F.col("l_suppkey") % 20).cast("string"), F.lit(".ts")).alias("file"),
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey") % 200 + 1).alias("line"),
        _pick(F.col("l_partkey") % 25, RULE_IDS).alias("kind"),
        F.when(F.col("l_linenumber") % 3 == 0, "high").when(F.col("l_linenumber") % 3 == 1, "medium").otherwise("low").alias("severity"),
        F.concat(F.lit("note "), (F.col("l_partkey") % 7).cast("string")).alias("message"),
        F.when(F.col("l_tax") != 0, F.round(F.col("l_discount") * 10, 2)).alias("confidence"),
    )
    return x.withColumn("level", lookup(DEFAULT_LEVELS, F.col("kind")))


HOOKS_SQL = """
hooks AS (
  SELECT event_id, ts, user_id AS installation_id,
    CASE event_type WHEN 'click' THEN 'pull_request' WHEN 'view' THEN 'check_suite' WHEN 'signup' THEN 'installation' WHEN 'purchase' THEN 'marketplace_purchase' ELSE 'other' END AS event,
    CASE event_id % 4 WHEN 0 THEN 'opened' WHEN 1 THEN 'synchronize' WHEN 2 THEN 'closed' ELSE 'reopened' END AS action,
    CAST(round(value * 100) AS BIGINT) AS tokens,
    CASE event_id % 5 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'pending_change' WHEN 2 THEN 'changed' ELSE 'purchased' END AS purchase,
    CASE event_id % 3 WHEN 0 THEN 'Team Monthly' WHEN 1 THEN 'Starter' ELSE 'Hobby' END AS plan_name
  FROM events)"""


def hook_events(events: DataFrame) -> DataFrame:
    """Hook events (event_id, ts, installation_id, event, action, tokens, purchase, plan_name) from the events table, or a stream of it."""
    kind = F.col("event_type")
    n = F.col("event_id")
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("installation_id"),
        F.when(kind == "click", "pull_request").when(kind == "view", "check_suite").when(kind == "signup", "installation").when(kind == "purchase", "marketplace_purchase").otherwise("other").alias("event"),
        _pick(n % 4, ["opened", "synchronize", "closed", "reopened"]).alias("action"),
        F.round(F.col("value") * 100).cast("long").alias("tokens"),
        _pick(n % 5, ["cancelled", "pending_change", "changed", "purchased", "purchased"]).alias("purchase"),
        _pick(n % 3, ["Team Monthly", "Starter", "Hobby"]).alias("plan_name"),
    )


# Sources with blocks, comments and texts over several lines: (line, what its bracket or word opens, whether that is async, its name)
BRACE_LINES: list[tuple[str, str | None, bool, str]] = [
    ("async function load(id) {", "func", True, "load"),
    ("  for (const u of users) {", "loop", False, ""),
    ("  try {", "try", False, ""),
    ("  } catch (e) {", "catch", False, ""),
    ("}", None, False, ""),
    ("} // closed", None, False, ""),
    ("  if (ready) {", "block", False, ""),
    ("users.forEach(async (u) => {", "func", True, ""),
    ("})", None, False, ""),
    ("class Store {", "class", False, "Store"),
    ("/* opened here {", None, False, ""),
    ("closed here */ const b = 'x'", None, False, ""),
    ("const text = `one ${name}", "other", False, ""),
    ("two` // after", None, False, ""),
    ("const known = await users.findOne(key)", None, False, ""),
    ("users.create(key)", None, False, ""),
    ("const s = \"a { b\" + '} c'", None, False, ""),
    ("// note } {", None, False, ""),
    ("const go = async (a) => {", "func", True, "go"),
    ("function plain(a, b) {", "func", False, "plain"),
    ("while (more(a)) {", "loop", False, ""),
    ("total += 1;", None, False, ""),
    ("", None, False, ""),
    ("}", None, False, ""),
]
PYTHON_LINES: list[tuple[str, str | None, bool, str]] = [
    ("def load(a):", "func", False, "load"),
    ("    for u in users:", "loop", False, ""),
    ("        requests.get(u)", None, False, ""),
    ("    try:", "try", False, ""),
    ("        call(u)", None, False, ""),
    ("    except ValueError:", "catch", False, ""),
    ("        pass", None, False, ""),
    ("async def run(request):", "func", True, "run"),
    ("    time.sleep(1)", None, False, ""),
    ("class K:", "class", False, "K"),
    ("    def m(self):", "func", False, "m"),
    ("        return 1", None, False, ""),
    ('"""text def x():', None, False, ""),
    ('end of text"""', None, False, ""),
    ("x = '#no' # yes", None, False, ""),
    ("", None, False, ""),
    ("# note", None, False, ""),
    ("while more:", "loop", False, ""),
    ("    go()", None, False, ""),
    ("        async def inner():", "func", True, "inner"),
    ("            deep()", None, False, ""),
    ("    s = '''one", None, False, ""),
    ("two'''", None, False, ""),
    ("y = \"a\" + 'b'", None, False, ""),
]
RUBY_LINES: list[tuple[str, str | None, bool, str]] = [
    ("class K", "class", False, "K"),
    ("  def m(a)", "func", False, "m"),
    ("  end", "end", False, ""),
    ("end", "end", False, ""),
    ("users.each do |u|", "loop", False, ""),
    ("  fetch(u)", None, False, ""),
    ("begin", "try", False, ""),
    ("rescue => e", None, False, ""),
    ("=begin", None, False, ""),
    ("=end", None, False, ""),
    ("x = 'a' # b", None, False, ""),
    ('y = "one', None, False, ""),
    ('two"', None, False, ""),
    ("if ready", "block", False, ""),
    ("puts 'if' + \"end\"", None, False, ""),
    ("# end", None, False, ""),
    ("", None, False, ""),
    ("def self.k", "func", False, "self.k"),
    ("end", "end", False, ""),
    ("  end", "end", False, ""),
    ("list.map(&block)", None, False, ""),
    ("while more", "block", False, ""),
    ("end", "end", False, ""),
    ("work", None, False, ""),
]
_SLOT = "(l_partkey + 3 * l_suppkey) % 24 + 1"


def sql_texts(rows: list[tuple]) -> str:
    return "[" + ", ".join(_text(r[0]) for r in rows) + "]"


SOURCES_SQL = f"""
source_lines AS MATERIALIZED (
  SELECT o_custkey AS file_key, row_number() OVER (PARTITION BY o_custkey ORDER BY {", ".join(ORDER)}) AS line, CASE WHEN o_custkey % 5 < 3 THEN 1 WHEN o_custkey % 5 = 3 THEN 2 ELSE 3 END AS family,
    {_SLOT} AS slot FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sources AS MATERIALIZED (
  SELECT file_key, family, 'src/s' || file_key || (['.ts', '.js', '.go', '.py', '.rb'])[file_key % 5 + 1] AS filename,
    string_agg(CASE family WHEN 1 THEN ({sql_texts(BRACE_LINES)})[slot] WHEN 2 THEN ({sql_texts(PYTHON_LINES)})[slot] ELSE ({sql_texts(RUBY_LINES)})[slot] END, chr(10) ORDER BY line) AS content
  FROM source_lines GROUP BY ALL)"""


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_key, filename, content): one source a customer in five languages, its lines in the order of corpus_lines, as they come."""
    x = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    slot, lang = F.expr(_SLOT).cast("int"), F.col("o_custkey") % 5
    pick = lambda rows: F.element_at(F.array(*[F.lit(r[0]) for r in rows]), slot)
    body = F.when(lang < 3, pick(BRACE_LINES)).when(lang == 3, pick(PYTHON_LINES)).otherwise(pick(RUBY_LINES))
    x = x.groupBy(F.col("o_custkey").alias("file_key")).agg(F.array_sort(F.collect_list(F.struct(*ORDER, body.alias("body")))).alias("l"))
    name = F.concat(F.lit("src/s"), F.col("file_key").cast("string"), _pick(F.col("file_key") % 5, [".ts", ".js", ".go", ".py", ".rb"]))
    return x.select("file_key", name.alias("filename"), F.array_join(F.transform("l", lambda s: s["body"]), "\n").alias("content"))
