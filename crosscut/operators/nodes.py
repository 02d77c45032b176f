"""Syntax nodes of source files with what is around them: calls, catches, declarations, changes and assignments, as columns.

Nodes come from the brackets, blocks and statements of blocks.py; their texts are cut out of their file's content, which is joined by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of
from ..sources.staging import staged
from .blocks import BRACES, ITERATORS, RUBY_ITERATORS, at_blocks, blocks, brackets, call_name, checks_then_acts, placed, scopes, statements, within
from .source_lines import source_lines

NODES = (
    "file_key, at, language, kind, name, text, line, args, stmt, in_try, in_loop, in_async, module_scope, in_route, parent_fn, class_name, next_method, "
    "has_catch, has_then, awaited, returned, declared, literal_arg, role, silent, changed, acts"
).split(", ")

# Words before a parenthesis that call nothing, and methods that change what they are called on.
WORDS = "if for while switch catch function return typeof new await async else do try class extends in of instanceof void delete yield throw case with func range go defer select elif except and or not is lambda assert del raise import from def print_function".split()
MUTATORS, PY_MUTATORS = "push pop shift unshift splice sort reverse fill".split(), "append extend insert pop remove clear update add".split()

_NAME = r"((?:\??\.\s*)?[A-Za-z_$][\w$]*(?:\s*\??\.\s*[A-Za-z_$][\w$]*)*\s*)\z"
_QUIET = r"console\.(?:log|error|warn|info|debug)\s*\("


def _cut(text: str, start: Column, end: Column) -> Column:
    """The text from one place to before another."""
    return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def _silent_braces(body: Column) -> Column:
    """Whether a body does nothing but write to the console, and does not leave."""
    left = F.regexp_replace(body, r"console\.(?:log|error|warn|info|debug)\s*\([^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+\)\s*;?", "")
    return ~left.rlike(r"\S") & ~any_of(body, ["throw", "return", "reject"])


def _silent_python(body: Column) -> Column:
    b = F.trim(F.regexp_replace(body, r"^\s+|\s+\z", ""))
    rows = F.filter(F.transform(F.split(b, "\n"), lambda r: F.trim(r)), lambda r: r != "")
    quiet = (F.size(rows) > 0) & F.forall(rows, lambda r: (r == "pass") | r.rlike(r"^(?:print\(|logging\.|logger\.|log\.)"))
    return F.when(b.isin("pass", "..."), True).otherwise(~any_of(b, ["raise", "return", "sys.exit"]) & quiet)


def _calls(marks: DataFrame, texts: DataFrame, steps: DataFrame) -> DataFrame:
    """Calls of every language but Ruby, without what encloses them."""
    c = F.col
    js, go, py = c("language").isin("typescript", "javascript"), c("language") == "go", c("language") == "python"
    file = Window.partitionBy("file_key").orderBy("at")
    x = marks.withColumns({"prev": F.lag("mark").over(file), "brace": F.first(F.when(c("mark") == "{", F.struct("at", "mate")), ignorenulls=True).over(file.rowsBetween(1, Window.unboundedFollowing))})
    x = x.where("mark = '(' and language <> 'ruby'").withColumns({"called": call_name(c("before")), "tail": F.regexp_extract("before", _NAME, 1)})
    last = F.substring_index("called", ".", -1)
    x = x.withColumn("linked", c("called").startswith(".") & (c("prev") == ")") & c("before").rlike(r"^\s*\??\.\s*[\w$]+\s*\z"))
    chain = Window.partitionBy("file_key", "level").orderBy("at")
    x = x.withColumn("chain", F.sum((~c("linked")).cast("int")).over(chain))
    x = x.withColumn("start", c("at") - F.length("tail"))
    link = Window.partitionBy("file_key", "level", "chain").orderBy("at")
    later = link.rowsBetween(1, Window.unboundedFollowing)
    any_later = lambda names: F.coalesce(F.max(last.isin(names)).over(later), F.lit(False))
    x = x.withColumns(
        {
            "first": F.first("start").over(link.rowsBetween(Window.unboundedPreceding, 0)), "first_line": F.first("line").over(link.rowsBetween(Window.unboundedPreceding, 0)), "next_method": F.lead(last).over(link),
            "has_catch": any_later(["catch"]), "then": any_later(["then"]), "iterated": any_later(ITERATORS),
        }
    )
    head = F.regexp_replace(F.left("before", F.length("before") - F.length("tail")), r"(?s)^.*\n", "")
    method = js & ~c("called").contains(".") & F.coalesce((c("end.next") == "{") & c("end.after").rlike(r"^\s*(?::[^;]*)?\z"), F.lit(False)) & head.rlike(r"^\s*(?:(?:async|static|public|private|protected|get|set|export|default)\s+)*\z")
    defined = head.rlike(r"\b(?:function\s*\*?|def|class|func)\s*\z") | (go & c("before").rlike(r"\bfunc\s*\z")) | method
    x = x.where((c("called") != "") & ~c("called").isin(WORDS) & ~defined).drop("before", "after", "prev", "mark")
    # the statement it is in, for languages with braces
    points = x.select("file_key", c("start").alias("at"), F.struct(*x.columns).alias("x"))
    placed_ = at_blocks(points.where(c("x.language").isin(*BRACES)), marks).select("file_key", "at", "x", "depth", "block")
    both = steps.select("file_key", "at", "depth", F.struct("at", "block").alias("s")).unionByName(placed_, allowMissingColumns=True)
    both = both.withColumn("s", F.last("s", ignorenulls=True).over(Window.partitionBy("file_key", "depth").orderBy("at", c("x").isNotNull()))).where("x is not null")
    within_it = c("s.block") == c("block")
    braces = both.select("x.*", F.when(within_it, c("s.at")).alias("begun"))
    x = braces.unionByName(points.where(c("x.language") == "python").select("x.*"), allowMissingColumns=True)
    x = x.join(texts, "file_key")
    close = F.coalesce("end.at", F.length("content") - 1)
    eol = F.coalesce("end.eol", F.length("content"))
    text = _cut("content", c("start"), close + 1)
    whole = F.when(c("linked"), _cut("content", c("first"), c("at"))).otherwise(c("called"))
    # a statement of Python is its line, up to where the call ends
    line_start = c("first") - F.length(F.substring_index(F.left("content", c("first").cast("int")), "\n", -1))
    begun = F.when(py, line_start).otherwise(F.coalesce("begun", "first"))
    lead = _cut("code", begun, c("first"))
    behind, ahead = _cut("content", close + 1, close + 80), _cut("code", close + 1, eol)
    stmt = _cut("content", begun, F.greatest(eol, close))
    role = (
        F.when(py & behind.rlike(r"^\s*\[[^\]\n]*:"), "sliced")
        .when(go & (lead == "") & c("next_method").isNull() & ~c("linked"), "statement")
        .when(go & lead.rlike(r"(?::=|[^=!<>]=)\s*\z"), "assigned")
    )
    return x.select(
        "file_key", c("start").alias("at"), "language", F.lit("call").alias("kind"), whole.alias("name"), F.when(c("linked"), _cut("content", c("first"), close + 1)).otherwise(text).alias("text"), c("first_line").alias("line"),
        F.when(go, F.lit("")).otherwise(_cut("content", c("at") + 1, close)).alias("args"), stmt.alias("stmt"), "next_method", (c("has_catch") | whole.rlike(r"\.catch\b")).alias("has_catch"), c("then").alias("has_then"),
        (lead.rlike(r"\bawait\s*\z") & c("next_method").isNull()).alias("awaited"), lead.rlike(r"^return\b").alias("returned"), lead.rlike(r"^(?:export\s+)?(?:const|let|var)\b").alias("declared"),
        _cut("content", c("at") + 1, c("at") + 400).rlike(r"""^\s*(?:"[^"\n]*"|'[^'\n]*'|`[^`$]*`)\s*[,)]""").alias("literal_arg"), role.alias("role"),
        # a comprehension loops over what stands before its for
        ((py & ((lead.rlike(r"\[[^\]]*\z") & ahead.rlike(r"^[^\]\n]*\bfor\s")) | (lead.rlike(r"\([^()]*\z") & ahead.rlike(r"^[^()\n]*\bfor\s")))) | (js & (c("iterated") | (whole.contains(".") & last.isin(ITERATORS))))).alias("loops"),
        F.when(js & (last == "catch") & whole.contains(".") & (c("brace.at") < close), _silent_braces(_cut("code", c("brace.at") + 1, F.least(c("brace.mate"), close)))).alias("silent_handler"),
        F.greatest("first", "start").alias("order"),
    )


def _catches(of: DataFrame, texts: DataFrame) -> DataFrame:
    c = F.col
    x = of.where((c("kind") == "catch") & (c("language") != "go")).join(texts, "file_key")
    close = F.least("close", F.length("content"))
    py = c("language") == "python"
    body = _cut("code", c("open") + 1, close)
    below = F.when(F.substring_index(_cut("code", c("open"), close), "\n", 1).rlike(r":\s*\S"), F.regexp_replace(F.substring_index(_cut("code", c("open"), close), "\n", 1), r"^[^:]*:", "")).otherwise(F.regexp_replace(_cut("code", c("open"), close), r"^[^\n]*\n", ""))
    silent = F.when(py, _silent_python(below)).otherwise(_silent_braces(body))
    return x.select("file_key", c("open").alias("at"), "language", F.lit("catch").alias("kind"), F.when(py, "except").otherwise("catch").alias("name"), F.concat(F.when(py, "").otherwise("catch "), _cut("content", c("open"), close + 1)).alias("text"), "line", silent.alias("silent"))


def _in_lines(lines: DataFrame) -> DataFrame:
    """Nodes that a line tells of by itself: declarations, changes of names, assignments, and all of Ruby's."""
    c = F.col
    code = lines.where(c("code").rlike(r"\S")).withColumn("first", c("at") + F.length("code") - F.length(F.ltrim("code")))
    js, py, go, rb = c("language").isin("typescript", "javascript"), c("language") == "python", c("language") == "go", c("language") == "ruby"
    trimmed = F.trim("text")
    node = lambda kind, name, text=trimmed, role="", **more: F.struct(F.lit(kind).alias("kind"), name.alias("name"), text.alias("text"), (role if isinstance(role, Column) else F.lit(role)).alias("role"), more.get("silent", F.lit(False)).alias("silent"), more.get("stmt", F.lit("")).alias("stmt"), more.get("inline", F.lit(False)).alias("inline"))

    # declarations
    js_decl = r"^\s*(?:export\s+)?(const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]*)?(?:=\s*(\S)|;|$)"
    how, value = F.regexp_extract("code", js_decl, 1), F.regexp_extract("code", js_decl, 3)
    declared = F.when(js & (how != ""), node("declaration", F.regexp_extract("code", js_decl, 2), role=F.when(how != "const", how).when(value.isin("[", "{"), "literal").otherwise("const")))
    py_decl = r"^(\w+)\s*=(?!=)"
    declared = declared.when(py & c("code").rlike(py_decl), node("declaration", F.regexp_extract("code", py_decl, 1), role=F.when(c("text").rlike(r"\[|\{|list\(|dict\(|set\("), "literal").otherwise("other")))
    declared = declared.when(go & c("code").rlike(r"^\s*var\s+\w"), node("declaration", F.regexp_extract("code", r"^\s*var\s+(\w+)", 1), role="var"))
    # changes: names that a line assigns, or whose inside it changes
    own = r"(?<![\w$.])"
    assigned = F.concat(F.regexp_extract_all("code", F.lit(own + r"(?<!\b(?:const|let|var)\s)([A-Za-z_$][\w$]*)\s*(?:=(?![=>])|\+\+|--|[-+*/]=)"), F.lit(1)), F.regexp_extract_all("code", F.lit(r"(?:\+\+|--)([A-Za-z_$][\w$]*)"), F.lit(1)))
    inside = F.regexp_extract_all("code", F.lit(own + r"([A-Za-z_$][\w$]*)(?:\s*\??\.\s*[\w$]+\s*=(?![=>])|\s*\??\.\s*(?:" + "|".join(MUTATORS) + r")\s*\(|\s*\[[^\]]*\]\s*=(?![=>]))"), F.lit(1))
    py_inside = F.regexp_extract_all("code", F.lit(r"(\w+)(?:\.(?:" + "|".join(PY_MUTATORS) + r")\(|\[)"), F.lit(1))
    each = lambda names, role: F.transform(names, lambda n: node("mutation", n, n, role))
    none = F.array(node("", F.lit(""))).cast("array<struct<kind:string,name:string,text:string,role:string,silent:boolean,stmt:string,inline:boolean>>")
    changes = F.when(js, F.concat(each(assigned, "assign"), each(inside, "inside"))).when(py & c("code").rlike("[(=]"), each(py_inside, "inside"))
    # assignments
    go_assign = F.when(go & c("code").rlike(r"^\s*[\w.*\[\]]+(?:\s*,\s*[\w.*\[\]]+)*\s*:?=[^=]"), node("assignment", F.regexp_extract("code", r"^\s*([\w.*\[\]]+)", 1)))
    rb_assign = r"^\s*(@{0,2}[A-Za-z_][\w.]*|\w+\[[^\]]*\])\s*(?:\|\||&&|[-+*/])?=(?![=~>])"
    rb_is = rb & c("code").rlike(rb_assign)
    # calls of Ruby: every part of a chain is one
    one = r"[A-Za-z_@][\w@:]*(?:\([^()]*\))?(?:\.\w+[?!]?(?:\([^()]*\))?)+|Net::HTTP[\w:.]*"
    part = F.lit(r"\.\w+[?!]?(?:\([^()]*\))?")

    def chain(m: Column) -> Column:
        parts = F.regexp_extract_all(m, part, F.lit(0))
        ends = F.when(F.size(parts) > 0, F.transform(parts, lambda p, k: F.concat(F.regexp_extract(m, r"^[A-Za-z_@][\w@:]*(?:\([^()]*\))?", 0), F.array_join(F.slice(parts, 1, k + 1), "")))).otherwise(F.array(m))
        return F.transform(ends, lambda e: node("call", F.substring_index(e, "(", 1), e, stmt=F.when(rb_is, trimmed).otherwise(""), inline=c("code").rlike(r"\.(?:" + "|".join(RUBY_ITERATORS) + r")\b[^{}]*\{[^}]*" + r"\}")))

    ruby_calls = F.flatten(F.transform(F.regexp_extract_all("code", F.lit(one), F.lit(0)), chain))
    rescue = r"^\s*rescue\b"
    ruby_catch = F.when(rb & (c("code").rlike(rescue) | c("code").rlike(r"\w\s+rescue\b")), node("catch", F.lit("rescue"), c("below"), silent=c("code").rlike(rescue) & c("below").rlike(r"(?is)^.*?rescue\s*(=>)?\s*\w*\s*(?:nil|#[^\n]*)?\s*end")))
    ruby_assign = F.when(rb_is, node("assignment", F.regexp_extract("code", rb_assign, 1)))
    ahead = Window.partitionBy("file_key").orderBy("line")
    x = code.withColumn("below", F.when(rb, F.concat_ws("\n", "text", *[F.lead("text", k).over(ahead) for k in (1, 2, 3)])))
    some = F.array_compact(F.array(declared, go_assign, ruby_assign, ruby_catch))
    nodes = F.concat(some, F.coalesce(changes, F.slice(none, 1, 0)), F.when(rb, ruby_calls).otherwise(F.slice(none, 1, 0)))
    x = x.select("file_key", c("first").alias("at"), "language", "line", F.explode(nodes).alias("n"))
    return x.select("file_key", "at", "language", "n.kind", "n.name", "n.text", "line", "n.stmt", "n.role", "n.silent", c("n.inline").alias("loops"))


def _changed(nodes: DataFrame) -> DataFrame:
    """Declarations at module scope, those whose name the file changes marked."""
    c = F.col
    told = nodes.where("kind = 'mutation'").groupBy("file_key", "name").agg(F.max(c("role") == "inside").alias("inside"), F.max(c("role") == "assign").alias("assign"))
    d = nodes.where("kind = 'declaration'").where(F.when(c("language") == "go", ~c("in_function")).otherwise(c("module_scope"))).join(told, ["file_key", "name"], "left")
    return d.withColumn("changed", (c("language") != "go") & (F.coalesce("inside", F.lit(False)) | (c("role").isin("let", "var") & F.coalesce("assign", F.lit(False))))).drop("inside", "assign")


def syntax_nodes(files: DataFrame) -> DataFrame:
    """NODES of (file_key, filename, content) in the languages that are read; others, and null contents, give none."""
    c = F.col
    lines = staged(placed(source_lines(files)), "lines")
    marks = staged(brackets(lines), "marks")
    of, steps = staged(blocks(lines, marks), "blocks"), staged(statements(lines, marks), "statements")
    join = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", n))), lambda s: s[n]), "\n")
    texts = lines.groupBy("file_key").agg(join("text").alias("content"), join("code").alias("code"))
    texts = staged(texts, "texts")
    calls = staged(_calls(marks, texts, steps), "calls")
    handlers = calls.where("silent_handler is not null").select("file_key", "at", "language", F.lit("catch").alias("kind"), F.lit(".catch").alias("name"), "text", "line", c("silent_handler").alias("silent"))
    points = calls.drop("silent_handler", "order").unionByName(handlers, allowMissingColumns=True).unionByName(_catches(of, texts), allowMissingColumns=True).unionByName(_in_lines(lines), allowMissingColumns=True)
    x = within(points, scopes(of, marks)).withColumn("module_scope", F.when(c("language") == "ruby", ~c("in_function")).otherwise(c("module_scope")))
    x = staged(x, "points")
    acts = checks_then_acts(marks, steps).join(texts.select("file_key", "content"), "file_key")
    x = x.where("kind <> 'mutation' and kind <> 'declaration'").unionByName(_changed(x), allowMissingColumns=True)
    go_body = c("language") == "go"
    x = x.withColumn("in_loop", c("in_loop") | F.coalesce("loops", F.lit(False))).withColumn("has_then", F.coalesce("has_then", F.lit(False)) | c("in_then"))
    # a call that checks, with the texts of acts that follow; and for Go what stands around a call
    told = acts.groupBy("file_key", c("at").alias("mark")).agg(F.transform(F.array_sort(F.collect_list(F.struct("act_at", _act_text().alias("t")))), lambda s: s["t"]).alias("acts"))
    around = of.where("language = 'go'").select("file_key", "open", "close")
    errors = _go_bodies(x.where(go_body & (c("kind") == "call")).select("file_key", "at"), marks, texts, around)
    x = x.withColumn("mark", F.when(c("kind") == "call", c("at") + F.length(F.regexp_extract("text", r"^[^(]*", 0)))).join(told, ["file_key", "mark"], "left").drop("mark", "args_")
    x = x.join(errors, ["file_key", "at"], "left").withColumn("args", F.coalesce("body", "args")).drop("body")
    return x.select(*NODES)


def _act_text() -> Column:
    """The act's call, from its name to where its arguments seem to end, cut."""
    lead = F.regexp_extract(_cut("content", F.lit(0), F.col("act_at")), r"((?:[A-Za-z_$][\w$]*\s*\??\.\s*)*[A-Za-z_$][\w$]*\s*)\z", 1)
    return F.regexp_extract(F.concat(lead, _cut("content", F.col("act_at"), F.col("act_at") + 40)), r"(?s)^[^)]*\)?", 0)


def _go_bodies(calls: DataFrame, marks: DataFrame, texts: DataFrame, around: DataFrame) -> DataFrame:
    """file_key, at, body: the block around each call, or nothing at the top."""
    x = at_blocks(calls.distinct().withColumn("a", F.lit(0)), marks).where("block >= 0")
    x = x.join(around.withColumnRenamed("open", "block"), ["file_key", "block"]).join(texts.select("file_key", "content"), "file_key")
    return x.select("file_key", "at", _cut("content", F.col("block"), F.least(F.col("close"), F.length("content")) + 1).alias("body"))
