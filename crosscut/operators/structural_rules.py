"""Rules over syntax nodes, for each language, as predicates of one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_of
from .nodes import syntax_nodes

# What calls of each language are looked for.
JS_IO = "fetch axios axios.get axios.post axios.put axios.delete axios.patch axios.request http.get http.request https.get https.request fs.readFile fs.writeFile fs.appendFile fs.readFileSync fs.writeFileSync fs.appendFileSync fs.unlink fs.mkdir fs.readdir readFile writeFile readFileSync writeFileSync query execute findMany findAll findOne findFirst findUnique create insert update delete save find aggregate insertOne insertMany updateOne updateMany deleteOne deleteMany".split()
JS_QUERIES = "findMany findAll find aggregate query select getAll list fetch".split()
JS_PAGES = "limit take skip offset slice page paginate first top".split()
JS_WRITES = "writeFile writeFileSync appendFile appendFileSync".split()
JS_BLOCKING = "readFileSync writeFileSync appendFileSync existsSync mkdirSync readdirSync statSync unlinkSync copyFileSync execSync spawnSync execFileSync pbkdf2Sync scryptSync randomFillSync".split()
PY_IO = "requests.get requests.post requests.put requests.delete requests.patch requests.head requests.options httpx.get httpx.post httpx.put httpx.delete httpx.AsyncClient aiohttp.ClientSession urllib.request.urlopen open read write readlines cursor.execute cursor.executemany session.execute session.query connection.execute objects.all objects.filter objects.get objects.create query execute".split()
PY_QUERIES = "objects.all objects.filter query find select fetchall".split()
PY_PAGES = "limit offset slice first [:1] paginate page_size per_page".split()
PY_BLOCKING = "time.sleep os.system subprocess.run subprocess.call".split()
GO_IO = "http.Get http.Post http.Do http.NewRequest client.Do client.Get client.Post os.Open os.Create os.ReadFile os.WriteFile ioutil.ReadFile ioutil.WriteFile ioutil.ReadAll io.ReadAll io.Copy db.Query db.QueryRow db.Exec db.Prepare rows.Scan tx.Query tx.Exec net.Dial net.Listen conn.Read conn.Write".split()
GO_QUERIES, GO_PAGES = "db.Query db.QueryRow tx.Query Find Where Select".split(), "Limit LIMIT Offset OFFSET First Take Page".split()
GO_ERRORS = "Read Write Open Close Query Exec Parse Unmarshal Marshal Dial Listen".split()
RUBY_IO = "Net::HTTP HTTParty Faraday RestClient .get .post .put .delete .patch File.read File.write File.open IO.read .find .where .all .first .last .create .update .save .destroy".split()
RUBY_QUERIES, RUBY_PAGES = ".all .where .find_each .find_in_batches .pluck .select".split(), ".limit .first .take .page .paginate .per .offset".split()


def is_io(name: Column, text: Column, language: Column) -> Column:
    """Whether a call node does input or output: of JavaScript by its name, of the others by its text."""
    last = F.substring_index(name, ".", -1)
    js = name.isin(JS_IO) | last.isin(JS_IO) | any_of(name, ["fetch", "axios", "prisma.", "mongoose.", "redis.", "db."]) | name.rlike(r"fs\.(?:read|write|append|unlink|mkdir)")
    py = any_of(text, PY_IO) | text.rlike(r"(?:requests|httpx)\.\w+\(")
    return F.when(language == "python", py).when(language == "go", any_of(text, GO_IO)).when(language == "ruby", any_of(text, RUBY_IO)).otherwise(js)


def structural_findings(nodes: DataFrame) -> DataFrame:
    """Findings (file_key, seq, line, severity, kind, message, snippet, confidence, and the node's surroundings) of syntax nodes.

    seq is the order of rules, then of nodes. Every rule is one predicate over a node, so nodes are read once and not
    shuffled; what a rule needs of other nodes of its file (changes of a variable, acts after a check) the reader notes.
    """
    c = F.col
    # a reader leaves out what its language does not have
    nodes = nodes.na.fill(False).na.fill("", ["args", "stmt"])
    lang, name, text = c("language"), c("name"), c("text")
    js, py, go, rb = lang.isin("typescript", "javascript"), lang == "python", lang == "go", lang == "ruby"
    last = F.substring_index(name, ".", -1)
    x = nodes.withColumn("io", (c("kind") == "call") & is_io(name, text, lang))
    call, catch = c("kind") == "call", c("kind") == "catch"

    err_checked = (c("role") == "assigned") & ~text.startswith("_") & any_of(c("args"), ["if err !=", "if err =="])
    unsafe = c("io") & ~c("in_loop") & F.when(go, (c("role") == "statement") & ~err_checked).otherwise(~c("in_try")) & ~c("has_catch")
    js_query = last.isin(JS_QUERIES) & ~F.coalesce(c("next_method").isin(JS_PAGES), F.lit(False)) & ~any_of(F.lower(c("args")), ["limit", "take", "pagesize"])
    py_query = any_of(text, PY_QUERIES) & ~any_of(text, PY_PAGES) & ~F.coalesce(c("role") == "sliced", F.lit(False)) & ~any_of(c("stmt"), ["[:", "limit", "first()"])
    go_query = any_of(text, GO_QUERIES) & ~any_of(c("stmt"), GO_PAGES)
    rb_query = any_of(text, RUBY_QUERIES) & ~any_of(text, RUBY_PAGES) & ~any_of(c("stmt"), RUBY_PAGES)
    query = F.when(py, py_query).when(go, go_query).when(rb, rb_query).otherwise(js_query)
    go_silent = (c("kind") == "assignment") & (text.contains("_, _") | text.rlike(r"^_\s*[=:]")) & any_of(text, [*GO_IO, *GO_ERRORS])
    blocking_py = any_of(text, PY_BLOCKING)
    fire = c("io") & c("in_async") & ~c("awaited") & ~c("returned") & ~c("has_catch") & ~c("has_then") & ~c("declared")
    go_global = (c("kind") == "declaration") & any_of(text, ["[]", "map[", "*", "= make(", "= &"]) & ~text.rlike(r"var\s+[A-Z_]+\s*=")
    rb_shared = (c("kind") == "assignment") & text.contains("@@")
    rb_module = (c("kind") == "assignment") & c("module_scope") & any_of(text, ["= []", "= {}", "= Hash.new"])

    rules = [
        ("UNSAFE_IO", "high", unsafe, "high"),
        ("LOOPED_IO", "high", c("io") & c("in_loop"), "high"),
        ("UNBOUNDED_QUERY", "high", call & query, "high"),
        ("GLOBAL_MUTATION", "high", go & go_global, "high"),
        ("GLOBAL_MUTATION", "high", rb & rb_shared, "high"),
        ("GLOBAL_MUTATION", "medium", rb & rb_module, "medium"),
        ("SILENT_ERROR", "high", (catch & c("silent")) | (go & go_silent), "high"),
        ("BLOCKING_OPERATION", "medium", js & call & last.isin(JS_BLOCKING), "high"),
        ("BLOCKING_OPERATION", "high", py & call & blocking_py & c("in_async"), "high"),
        ("BLOCKING_OPERATION", "medium", py & call & text.contains("time.sleep") & ~c("in_async") & c("in_route"), "medium"),
        ("SHARED_FILE_WRITE", "high", js & call & last.isin(JS_WRITES) & c("literal_arg"), "high"),
        ("ASYNC_MISUSE", "medium", js & fire, "medium"),
        ("GLOBAL_MUTATION", "high", c("changed") & c("role").isin("let", "var", "literal") & ~go, "high"),
    ]
    context = ["in_try", "in_loop", "in_async", "module_scope", "in_route", "parent_fn", "class_name"]
    hit = [F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(i).alias("rule"), F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.lit(conf).alias("confidence"))) for i, (k, s, p, conf) in enumerate(rules)]
    race = lambda a: F.struct(F.lit(len(rules)).alias("rule"), F.lit("CHECK_THEN_ACT_RACE").alias("kind"), F.lit("medium").alias("severity"), F.lit("high").alias("confidence"), F.concat(F.substring("text", 1, 60), F.lit(" ... "), F.substring(a, 1, 40)).alias("snippet"))
    plain = F.transform(F.array_compact(F.array(*hit)), lambda f: F.struct(f["rule"].alias("rule"), f["kind"].alias("kind"), f["severity"].alias("severity"), f["confidence"].alias("confidence"), F.substring("text", 1, 100).alias("snippet")))
    races = F.transform(F.coalesce("acts", F.array().cast("array<string>")), race)
    every = x.select("file_key", "at", "line", *context, F.explode(F.concat(plain, races)).alias("f")).select("file_key", "at", "line", *context, "f.*")

    from ..functions.rules import lookup
    from .patch_rules import MESSAGES

    # contents have fewer than 2^40 characters, so this is the order of nodes within a rule
    return every.withColumns({"seq": F.col("rule").cast("long") * (1 << 40) + F.col("at"), "message": lookup(MESSAGES, F.col("kind"))}).drop("rule", "at")


def analyze_structure(files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """structural_findings of (file_key, filename, content); only on changed (file_key, line) if given. Test files of Go and Ruby give none."""
    from ..functions.text import is_go_test, is_ruby_test

    f = F.col("filename")
    found = structural_findings(syntax_nodes(files.where(~is_go_test(f) & ~is_ruby_test(f))))
    return found if changed is None else found.join(changed.select("file_key", "line").distinct(), ["file_key", "line"], "left_semi")


def support_table(spark: SparkSession) -> DataFrame:
    """(language, extensions, rules): what is read of which files."""
    rules = {
        "typescript": "UNSAFE_IO LOOPED_IO UNBOUNDED_QUERY GLOBAL_MUTATION SILENT_ERROR CHECK_THEN_ACT_RACE BLOCKING_OPERATION SHARED_FILE_WRITE ASYNC_MISUSE",
        "javascript": "UNSAFE_IO LOOPED_IO UNBOUNDED_QUERY GLOBAL_MUTATION SILENT_ERROR CHECK_THEN_ACT_RACE BLOCKING_OPERATION SHARED_FILE_WRITE ASYNC_MISUSE",
        "python": "UNSAFE_IO LOOPED_IO UNBOUNDED_QUERY GLOBAL_MUTATION SILENT_ERROR BLOCKING_OPERATION",
        "go": "UNSAFE_IO LOOPED_IO UNBOUNDED_QUERY GLOBAL_MUTATION SILENT_ERROR",
        "ruby": "UNSAFE_IO LOOPED_IO UNBOUNDED_QUERY GLOBAL_MUTATION SILENT_ERROR",
    }
    from ..functions.text import STRUCTURAL_LANGUAGES

    rows = [(lang, sorted(e for e, x in STRUCTURAL_LANGUAGES.items() if x == lang), r.split()) for lang, r in rules.items()]
    return spark.createDataFrame(rows, "language string, extensions array<string>, rules array<string>")
