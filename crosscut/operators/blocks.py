"""Blocks of source files and what encloses each place in them, as windows: brackets paired by depth, bodies by indentation, do by end.

A place is a number of characters from the start of its file. Everything is dealt by file once; pairs are neighbours in
(file, kind of bracket, depth), so no place is compared with all brackets of its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The place of what never ends.
END = 1 << 60
BRACES = ("typescript", "javascript", "go")
#: A balanced pair of parentheses in a header.
PAIR = "¤"

# Methods that call what they are given for each element, and what makes a route.
ITERATORS = "forEach map filter reduce every some flatMap".split()
ROUTE_METHODS, ROUTE_OBJECTS = "get post put patch delete all use".split(), "app router express server".split()
RUBY_ITERATORS = "each map collect select find_each".split()

SCOPES = "file_key, open, close, func, async, name, loop, try, class, class_name, route"


def placed(lines: DataFrame) -> DataFrame:
    """lines with at, the place of each line's first character, and eol and eol2, those of its end and of the next line's."""
    file = Window.partitionBy("file_key").orderBy("line")
    x = lines.withColumn("at", F.coalesce(F.sum(F.length("text") + 1).over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("eol", F.col("at") + F.length("text"))
    return x.withColumn("eol2", F.coalesce(F.lead("eol").over(file), F.col("eol")))


def brackets(lines: DataFrame) -> DataFrame:
    """file_key, language, line, at, mark, before, after, next, level, mate, and end of each bracket or semicolon in code.

    lines come from placed(source_lines(...)). before and after are the text since the mark before it and up to the one that follows, next that
    mark. mate is the place of the bracket that closes an open one (END if none does), end its line, eol, eol2, after and next; level is the depth among
    brackets of its kind; closes tells whether a closing bracket closes one.
    """
    x = lines.select("file_key", "language", "line", "at", "eol", "eol2", F.posexplode(F.split(F.concat("code", F.lit("\n")), r"(?<=[{}();])")).alias("k", "piece"))
    line = Window.partitionBy("file_key", "line").orderBy("k")
    x = x.withColumn("at", F.col("at") + F.sum(F.length("piece")).over(line) - 1)
    x = x.withColumn("mark", F.when(F.col("piece").rlike(r"[{}();]\z"), F.right("piece", F.lit(1))))
    # text that no mark ends runs on into the next piece
    file = Window.partitionBy("file_key").orderBy("at")
    x = x.withColumn("run", F.coalesce(F.count("mark").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda s: s["piece"]), "")
    x = x.groupBy("file_key", "language", "run").agg(text.alias("before"), F.max("at").alias("last"), F.max(F.when(F.col("mark").isNotNull(), F.struct("at", "mark", "line", "eol", "eol2"))).alias("m"))
    x = x.select("file_key", "language", "m.line", "m.eol", "m.eol2", F.coalesce("m.at", "last").alias("at"), "m.mark", F.when(F.col("m.mark").isNotNull(), F.left("before", F.length("before") - 1)).otherwise(F.col("before")).alias("before"))
    x = x.withColumns({"after": F.lead("before").over(file), "next": F.lead("mark").over(file)}).where("mark is not null")
    x = x.withColumn("sort", F.when(F.col("mark").isin("{", "}"), 1).when(F.col("mark").isin("(", ")"), 2).otherwise(0))
    step = F.when(F.col("mark").isin("{", "("), 1).when(F.col("mark").isin("}", ")"), -1).otherwise(0)
    x = x.withColumn("depth", F.sum(step).over(Window.partitionBy("file_key", "sort").orderBy("at")))
    x = x.withColumn("level", F.col("depth") + F.col("mark").isin("}", ")").cast("int"))
    same = Window.partitionBy("file_key", "sort", "level").orderBy("at")
    mate = F.lead(F.struct("at", "line", "eol", "eol2", "after", "next")).over(same)
    x = x.withColumns({"end": F.when(F.col("mark").isin("{", "("), mate), "closes": F.col("mark").isin("}", ")") & F.coalesce(F.lag("mark").over(same).isin("{", "("), F.lit(False))})
    return x.withColumn("mate", F.when(F.col("mark").isin("{", "("), F.coalesce(F.col("end.at"), F.lit(END)))).drop("sort", "depth", "eol", "eol2")


def headers(marks: DataFrame) -> DataFrame:
    """The rows of { with head: the text since the statement before, balanced parentheses as one sign."""
    file = Window.partitionBy("file_key").orderBy("at")
    ends = F.col("mark").isin("{", "}", ";")
    x = marks.withColumn("part", F.coalesce(F.count(F.when(ends, 1)).over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat("before", "mark").alias("t")))), lambda s: s["t"]), "")
    x = x.groupBy("file_key", "language", "part").agg(text.alias("head"), F.max(F.struct("at", "mark", "mate", "line", "level")).alias("m"))
    # the head of for (a; b; c) lies in three parts
    parts = Window.partitionBy("file_key").orderBy("part")
    open_, close = F.regexp_count("head", F.lit(r"\(")), F.regexp_count("head", F.lit(r"\)"))
    x = x.withColumn("head", F.when((close > open_) & (F.lag("m.mark", 1).over(parts) == ";"), F.concat(F.coalesce(F.lag("head", 2).over(parts), F.lit("")), F.lag("head", 1).over(parts), "head")).otherwise(F.col("head")))
    x = x.where("m.mark = '{'").select("file_key", "language", "m.*", F.rtrim(F.regexp_replace(F.left("head", F.length("head") - 1), r"\s+\z", "")).alias("head"))
    for _ in range(4):
        x = x.withColumn("head", F.regexp_replace("head", r"\([^()]*\)", PAIR))
    return x


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def brace_blocks(marks: DataFrame) -> DataFrame:
    """file_key, open, close, level, line, kind, async and name of { blocks: func, loop, try, catch, class, block or other.

    name is a function's or class's own, or the variable or key that a function is given to; empty if it has none.
    """
    h, go = F.col("head"), F.col("language") == "go"
    last = F.substring_index(h, "\n", -1)
    arrow = h.rlike("=>$")
    method = h.rlike(rf"[\w$]\s*(?:<[^<>]*>)?\s*{PAIR}\s*(?::[^\n;=]*)?$")
    js = (
        F.when(arrow, "func")
        .when(h.rlike(rf"\b(?:for|while)\s*(?:await\s*)?{PAIR}$|\bdo$"), "loop")
        .when(h.rlike(r"\btry$"), "try")
        .when(h.rlike(rf"\bcatch\s*{PAIR}?$"), "catch")
        .when(h.rlike(rf"\b(?:if|switch|with)\s*{PAIR}$|\b(?:else|finally)$"), "block")
        .when(h.rlike(r"\bclass\b[^\n;()]*$"), "class")
        .when(h.rlike(rf"\bfunction\s*\*?\s*{PAIR}\s*(?::[^\n;=]*)?$") | method, "func")
        .otherwise("other")
    )
    kind = F.when(go, F.when(last.rlike(r"(?:^|[\s(,=])func\b"), "func").when(last.rlike(r"^\s*for\b"), "loop").otherwise("block")).otherwise(js)
    is_async = ~go & F.when(arrow, h.rlike(rf"\basync\s*(?:[\w$]+\s*|{PAIR}\s*(?::[^=\n]*)?)=>$")).otherwise(h.rlike(rf"\basync\s+(?:function\b\s*\*?\s*)?[\w$]*\s*(?:<[^<>]*>)?\s*{PAIR}[^\n]*$"))
    given = F.regexp_extract(h, rf"([\w$]+)\s*(?::[^=\n]*)?=\s*(?:async\s*)?(?:[\w$]+|{PAIR})\s*(?::[^=\n]*)?=>$", 1)
    own = F.regexp_extract(h, rf"([\w$]+)\s*(?:<[^<>]*>)?\s*{PAIR}\s*(?::[^\n;=]*)?$", 1)
    var = F.regexp_extract(h, rf"([\w$]+)\s*[=:]\s*(?:async\s+)?function\s*\*?\s*{PAIR}[^\n]*$", 1)
    go_name = F.regexp_extract(last, rf"\bfunc\s*(?:{PAIR}\s*)?(\w+)\s*{PAIR}", 1)
    name = F.when(go, go_name).when(arrow, given).when(own.isin("function", "async"), var).otherwise(own)
    name = F.when(F.col("kind") == "func", name).when(F.col("kind") == "class", F.regexp_extract(h, r"\bclass\s+([\w$]+)[^\n;()]*$", 1)).otherwise("")
    x = marks.where(F.col("language").isin(*BRACES))
    x = headers(x).withColumn("kind", kind)
    return x.select("file_key", "language", F.col("at").alias("open"), F.col("mate").alias("close"), "level", "line", "kind", ((F.col("kind") == "func") & is_async).alias("async"), name.alias("name"), "head")


def _logical(lines: DataFrame) -> DataFrame:
    """Lines of Python that begin a statement: in code, not blank, within no bracket."""
    file = Window.partitionBy("file_key").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(F.regexp_count("code", F.lit(r"[(\[{]")) - F.regexp_count("code", F.lit(r"[)\]}]"))).over(file), F.lit(0))
    x = lines.where("language = 'python'").withColumn("depth", depth)
    starts = F.col("code").rlike(r"^(?:async\s+def|def|class|import|from|@)\b|^@")
    x = x.where((F.col("begins") == 0) & F.col("code").rlike(r"\S") & ((F.col("depth") <= 0) | starts))
    return x.withColumn("indent", F.length("code") - F.length(F.ltrim(F.regexp_replace("code", r"^\t+", " "))))


def indent_blocks(lines: DataFrame) -> DataFrame:
    """brace_blocks' columns for Python: a body ends at the next statement that is not indented more than its header.

    That statement is the next row among those that are indented no more, so each statement is laid out for the indents, few in a
    file, of headers that it can end.
    """
    x = _logical(lines)
    word = F.regexp_extract("code", r"^\s*(async\s+def|async\s+for|def|class|for|while|try|except)\b", 1)
    kind = F.when(word.rlike("def$"), "func").when(word == "class", "class").when(word.rlike("for$|while"), "loop").when(word == "try", "try").when(word == "except", "catch")
    x = x.withColumns({"kind": kind, "async": word.rlike("^async") & word.rlike("def$"), "name": F.regexp_extract("code", r"^\s*(?:async\s+def|def|class)\s+(\w+)", 1)})
    # decorators stand above their function
    file = Window.partitionBy("file_key").orderBy("line")
    above = F.concat_ws("\n", *[F.when(F.lag("code", k).over(file).rlike(r"^\s*@"), F.lag("code", k).over(file)) for k in (2, 1)])
    x = x.withColumn("head", F.when(F.col("kind") == "func", F.concat_ws("\n", above, "code")).otherwise(F.col("code")))
    indents = F.collect_set(F.when(F.col("kind").isNotNull(), F.col("indent"))).over(Window.partitionBy("file_key"))
    x = x.withColumn("indents", indents).withColumn("for", F.explode(F.filter("indents", lambda v: v >= F.col("indent"))))
    x = x.withColumn("close", F.coalesce(F.lead("at").over(Window.partitionBy("file_key", "for").orderBy("line")) - 1, F.lit(END)))
    x = x.where("kind is not null and `for` = indent")
    return x.select("file_key", "language", (F.col("at") + F.col("indent")).alias("open"), "close", F.col("indent").alias("level"), "line", "kind", "async", "name", "head")


def end_blocks(lines: DataFrame) -> DataFrame:
    """brace_blocks' columns for Ruby: words that begin a block, paired with end by depth."""
    x = lines.where("language = 'ruby' and begins = 0")
    word = F.regexp_extract("code", r"^\s*(class|module|def|begin|if|unless|while|until|case|for)\b", 1)
    do = F.col("code").rlike(r"\bdo\b(?:\s*\|[^|]*\|)?\s*$")
    inner = F.col("code").rlike(r"=\s*(?:if|case|begin|unless)\b")
    opens = ((word != "") | do | inner) & ~F.col("code").rlike(r"\bend\s*$")
    iterates = F.col("code").rlike(r"\.(?:" + "|".join(RUBY_ITERATORS) + r")\b")
    kind = F.when(word == "def", "func").when(word == "class", "class").when((word == "begin") | ((word == "") & inner & F.col("code").rlike(r"=\s*begin\b")), "try").when((word == "") & do & iterates, "loop").otherwise("block")
    first = F.col("at") + F.length("code") - F.length(F.ltrim("code"))
    x = x.select("file_key", "language", "at", first.alias("first"), "line", "code", F.explode(F.array_compact(F.array(F.when(F.col("code").rlike(r"^\s*end\b"), F.lit(-1)), F.when(opens, F.lit(1))))).alias("step"), kind.alias("kind"), word.alias("word"))
    file = Window.partitionBy("file_key").orderBy("line", "step")
    x = x.withColumn("depth", F.sum("step").over(file)).withColumn("level", F.col("depth") + (F.col("step") < 0).cast("int"))
    mate = F.lead("at").over(Window.partitionBy("file_key", "level").orderBy("line", "step"))
    x = x.withColumn("close", F.coalesce(mate - 1, F.lit(END))).where("step > 0")
    name = F.when(F.col("kind").isin("func", "class"), F.regexp_extract("code", r"^\s*(?:def|class)\s+([^\s(]+)", 1)).otherwise("")
    return x.select("file_key", "language", F.col("first").alias("open"), "close", "level", "line", "kind", F.lit(False).alias("async"), name.alias("name"), F.col("code").alias("head"))


def blocks(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """All blocks of placed lines and their brackets."""
    return brace_blocks(marks).unionByName(indent_blocks(lines)).unionByName(end_blocks(lines))


def call_name(before: Column) -> Column:
    """What is called where text ends before a parenthesis; empty if nothing is, with a dot in front if it is called on a result."""
    return F.regexp_replace(F.regexp_extract(before, r"((?:\??\.\s*)?[A-Za-z_$][\w$]*(?:\s*\??\.\s*[A-Za-z_$][\w$]*)*)\s*\z", 1), r"\s+|\?(?=\.)", "")


def is_route(block_head: Column, language: Column) -> Column:
    """Whether a function's or class's head makes it handle requests, outside JavaScript, where the call around it tells."""
    python = block_head.rlike(r"@(?:app|router|blueprint)\.|@\w*\.?route|\([^)]*request")
    return F.when(language == "python", python).when(language == "ruby", block_head.contains("Controller")).otherwise(F.lit(False))


FLAGS = ("func", "loop", "try", "class", "route", "then", "named")


def scopes(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """file_key, open, close, FLAGS, async, name, class_name: blocks, and the arguments of calls that loop over what they are called on, make routes or go on with a promise.

    The head of a loop is in the loop as well, and so is a statement below a head without braces up to its line's end.
    """
    c, no = F.col, F.lit(False)
    flag = {f: no for f in FLAGS} | {"async": no, "name": _none("string"), "class_name": _none("string")}
    columns = lambda **x: [v.alias(k) for k, v in (flag | x).items()]
    func, cls = c("kind") == "func", c("kind") == "class"
    of = blocks.select(
        "file_key", "open", "close",
        *columns(**{"func": func, "named": func & (c("name") != ""), "async": c("async"), "name": F.when(func, c("name")), "loop": c("kind") == "loop", "try": c("kind") == "try", "class": cls, "class_name": F.when(cls, c("name")), "route": (func | cls) & is_route(c("head"), c("language"))}),
    )
    p = marks.where("mark = '('").withColumn("called", call_name(c("before")))
    last, owner = F.substring_index("called", ".", -1), c("called").rlike(r"\b(?:" + "|".join(ROUTE_OBJECTS) + r")\w*\.")
    dotted, js = c("called").contains("."), c("language").isin("typescript", "javascript")
    head = js & c("called").isin("for", "while") | js & c("called").rlike("^await$") & c("before").rlike(r"\bfor\s+await\s*\z")
    loop, route, then = (js & dotted & last.isin(ITERATORS)) | head, c("language").isin(*BRACES) & dotted & last.isin(ROUTE_METHODS) & owner, js & dotted & (last == "then")
    bare = head & ~((c("end.next") == "{") & (F.trim(F.regexp_replace("end.after", r"\s+", "")) == ""))
    below = F.when(F.trim(F.substring_index("end.after", "\n", 1)) == "", c("end.eol2")).otherwise(c("end.eol"))
    close = F.when(bare, F.coalesce(F.greatest(below, c("mate")), c("mate"))).otherwise(c("mate"))
    calls = p.withColumn("close", close).where(loop | route | then).select("file_key", c("at").alias("open"), "close", *columns(loop=loop, route=route, then=then))
    arrows = _bare_arrows(marks)
    return of.unionByName(calls).unionByName(arrows.select("file_key", "open", "close", *columns(**{"func": F.lit(True), "named": c("given") != "", "async": c("async"), "name": c("given")})))


def _bare_arrows(marks: DataFrame) -> DataFrame:
    """file_key, open, close, async, given of arrow functions without braces: up to the end of the parentheses around them, or of the line."""
    c = F.col
    file = Window.partitionBy("file_key").orderBy("at")
    x = marks.where(c("language").isin("typescript", "javascript") & (c("mark") != ";"))
    x = x.withColumns({"params": F.when(F.lag("mark", 1).over(file) == ")", F.lag("before", 2).over(file)), "arrow": c("before").rlike(r"=>\s*[^\s{]") | (c("before").rlike(r"=>\s*\z") & (c("mark") != "{"))})
    x = x.where(c("mark").isin("(", ")"))
    # the parentheses around an arrow: its own level for one that closes, the level below for one that opens
    x = x.withColumn("around", F.when(c("mark") == "(", c("level") - 1).otherwise(c("level")))
    opens = x.where("mark = '('").select("file_key", "at", c("level").alias("around"), c("mate").alias("outer"), F.lit(0).alias("rank"))
    asked = x.where("arrow").select("file_key", "at", "around", F.lit(1).alias("rank"), "before", "params", c("end.eol").alias("eol"))
    both = opens.unionByName(asked, allowMissingColumns=True)
    before = Window.partitionBy("file_key", "around").orderBy("at", F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("outer", F.last("outer", ignorenulls=True).over(before)).where("rank = 1").withColumn("outer", F.when(c("outer") >= c("at"), c("outer")))
    head = F.concat(F.when(F.col("params").isNull(), "").otherwise(F.concat("params", F.lit(PAIR))), F.regexp_extract("before", r"(?s)^(.*?)=>", 1))
    return both.select(
        "file_key", (c("at") - F.length("before") + F.length(F.regexp_extract("before", r"(?s)^(.*)=>", 1))).alias("open"), F.coalesce("outer", "eol", "at").alias("close"),
        head.rlike(rf"\basync\s*(?:[\w$]+|{PAIR})\s*(?::[^=]*)?\z").alias("async"), F.regexp_extract(head, rf"([\w$]+)\s*=\s*(?:async\s*)?(?:[\w$]+|{PAIR})\s*(?::[^=]*)?\z", 1).alias("given"),
    )


def within(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """points (file_key, at, ...) with in_function, in_loop, in_try, in_async, module_scope, in_route, in_then, parent_fn, class_name.

    Starts and ends of scopes are marks among the points; running sums over a file tell how many scopes of a kind are open, and the last function
    that was opened at the present depth of functions is the nearest one. A point at a scope's first place is not in it, one at its last is.
    parent_fn is the nearest function that has a name.
    """
    c = F.col
    opened = scopes.select(
        "file_key", c("open").alias("at"), F.lit(2).alias("rank"), *[c(f).cast("int").alias(f"d_{f}") for f in FLAGS],
        F.when(c("func"), c("async")).alias("fn"), F.when(c("named"), c("name")).alias("fn_name"), F.when(c("class"), c("class_name")).alias("cls"),
    )
    closed = scopes.where(c("close") < END).select("file_key", c("close").alias("at"), F.lit(1).alias("rank"), *[(-c(f).cast("int")).alias(f"d_{f}") for f in FLAGS])
    asked = points.select("file_key", "at", F.lit(0).alias("rank"), *[F.lit(0).alias(f"d_{f}") for f in FLAGS], F.struct(*[n for n in points.columns if n not in ("file_key", "at")]).alias("point"))
    x = opened.unionByName(closed, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    # of what lies at one place, points come first, then ends, then starts
    order = ("at", "rank")
    run = Window.partitionBy("file_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"n_{f}": F.sum(f"d_{f}").over(run) for f in FLAGS})
    for what, n in (("fn", "n_func"), ("fn_name", "n_named"), ("cls", "n_class")):
        level = Window.partitionBy("file_key", n).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn(what, F.when(c(n) > 0, F.last(what, ignorenulls=True).over(level)))
    return x.where("point is not null").select(
        "file_key", "at", "point.*", (c("n_func") > 0).alias("in_function"), (c("n_loop") > 0).alias("in_loop"), (c("n_try") > 0).alias("in_try"), F.coalesce(c("fn"), F.lit(False)).alias("in_async"),
        ((c("n_func") <= 0) & (c("n_class") <= 0)).alias("module_scope"), (c("n_route") > 0).alias("in_route"), (c("n_then") > 0).alias("in_then"), c("fn_name").alias("parent_fn"), c("cls").alias("class_name"),
    )


def line_scopes(files: DataFrame) -> DataFrame:
    """file_key, line and within's columns for each line of (file_key, filename, content) that has code, at its first character."""
    from ..sources.staging import staged
    from .source_lines import source_lines

    lines = staged(placed(source_lines(files)), "lines")
    marks = staged(brackets(lines), "marks")
    first = lines.where(F.col("code").rlike(r"\S")).select("file_key", (F.col("at") + F.length("code") - F.length(F.regexp_replace("code", r"^\s+", ""))).alias("at"), "line")
    return within(first, scopes(blocks(lines, marks), marks)).drop("at", "in_then")


def _begins_statement(text: Column, last: Column) -> Column:
    """Whether text begins a statement below a line whose last character is last; null is the file's start."""
    goes_on = text.rlike(r"^(?:in|of|instanceof|else|catch|finally|extends)\b")
    return F.when(last.isNull() | last.isin("{", ";"), ~text.rlike(r"^[}]")).when(last == "}", ~goes_on & ~text.rlike(r"^[)\].,;(}?]")).otherwise(text.rlike(r'^(?:[\w$"@]|\+\+|--)') & ~goes_on & last.rlike(r'[\w$)\]"+\-]'))


def at_blocks(points: DataFrame, marks: DataFrame) -> DataFrame:
    """points (file_key, at, ...) with depth, the number of { open there, block, the place of the innermost one, and bare: whether no ( is open inside it."""
    c = F.col
    braces = c("mark").isin("{", "}")
    step = F.when(c("mark").isin("{", "("), 1).when(c("closes"), -1).otherwise(0)
    m = marks.where("mark <> ';'").select("file_key", "at", F.lit(1).alias("rank"), F.when(braces, step).otherwise(0).alias("d_brace"), F.when(~braces, step).otherwise(0).alias("d_paren"), (c("mark") == "{").alias("opens"))
    asked = points.select("file_key", "at", F.lit(0).alias("rank"), F.lit(0).alias("d_brace"), F.lit(0).alias("d_paren"), F.lit(False).alias("opens"), F.struct(*[n for n in points.columns if n not in ("file_key", "at")]).alias("point"))
    run = Window.partitionBy("file_key").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
    x = m.unionByName(asked, allowMissingColumns=True).withColumns({"depth": F.sum("d_brace").over(run), "parens": F.sum("d_paren").over(run)})
    level = Window.partitionBy("file_key", "depth").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
    inner = F.last(F.when(c("opens"), F.struct(c("at").alias("open"), "parens")), ignorenulls=True).over(level)
    x = x.withColumn("inner", F.when(c("depth") > 0, inner)).where("point is not null")
    return x.select("file_key", "at", "point.*", "depth", F.coalesce("inner.open", F.lit(-1)).alias("block"), (c("parens") <= F.coalesce("inner.parens", F.lit(0))).alias("bare"))


def statements(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """file_key, at, word, depth, block and ord of each statement of languages with braces: its place among those of its block, from 1, and its first word.

    A statement begins after a mark, or on a line below one that is complete; not within parentheses of its block.
    """
    c = F.col
    code = lines.where(c("language").isin(*BRACES) & c("code").rlike(r"\S"))
    text = F.regexp_replace("code", r"^\s+", "")
    last = F.lag(F.right(F.regexp_replace("code", r"\s+\z", ""), F.lit(1))).over(Window.partitionBy("file_key").orderBy("line"))
    first = code.select("file_key", (c("at") + F.length("code") - F.length(text)).alias("at"), _begins_statement(text, last).alias("ok"), text.alias("t"))
    line = F.substring_index("after", "\n", 1)
    rest = F.regexp_replace(line, r"^\s+", "")
    # what follows on the line: up to the next mark, or that mark
    more = F.when((rest == "") & ~c("after").contains("\n"), c("next")).otherwise(rest)
    after = marks.where(c("language").isin(*BRACES) & c("mark").isin("{", "}", ";")).select("file_key", (c("at") + 1 + F.length(line) - F.length(rest)).alias("at"), ((more != "") & _begins_statement(more, c("mark"))).alias("ok"), more.alias("t"))
    x = first.unionByName(after).where("ok").groupBy("file_key", "at").agg(F.max(F.regexp_extract("t", r"^\w*", 0)).alias("word"))
    x = at_blocks(x, marks).where("bare").drop("bare")
    return x.withColumn("ord", F.row_number().over(Window.partitionBy("file_key", "block").orderBy("at")))


# What a check is called, the act that may depend on it, and how many of the statements after the check's are looked at.
CHECKS, ACTS, NEXT = "findOne findUnique findFirst get getOne exists find".split(), "create insert insertOne save add".split(), 4
#: Statements that begin so are no expressions or declarations.
OTHERS = "return if for while throw switch try do import function class".split()


def checks_then_acts(marks: DataFrame, statements: DataFrame) -> DataFrame:
    """file_key, at, line, act_at, act_line: calls that check, each with the first act in each of the NEXT statements after its own in its block.

    An act inside a block counts for every statement around it: at each depth that is the last statement begun there before it.
    """
    c = F.col
    calls = marks.where(c("language").isin("typescript", "javascript") & (c("mark") == "(")).withColumn("last", F.substring_index(call_name(c("before")), ".", -1))
    calls = at_blocks(calls.where(c("last").isin(CHECKS + ACTS)).select("file_key", "at", "line", "last", c("end.at").alias("to")), marks).where("depth > 0")
    each = F.when(c("last").isin(ACTS), F.sequence(F.lit(1), "depth")).otherwise(F.array("depth"))
    calls = calls.withColumn("level", F.explode(each))
    s = statements.select("file_key", c("depth").alias("level"), "at", F.struct("block", "ord", "at", "word").alias("s"))
    before = Window.partitionBy("file_key", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    x = s.unionByName(calls, allowMissingColumns=True).withColumn("s", F.last("s", ignorenulls=True).over(before)).where("last is not null and s is not null")
    acts = x.where(c("last").isin(ACTS)).groupBy("file_key", c("s.block").alias("block"), c("s.ord").alias("ord")).agg(F.min(F.struct("at", "line")).alias("act"))
    looks = x.where(c("last").isin(CHECKS) & (c("s.block") == c("block")) & ~c("s.word").isin(OTHERS)).select("file_key", "at", "line", "block", c("s.at").alias("statement"), F.explode(F.sequence(c("s.ord") + 1, c("s.ord") + NEXT)).alias("ord"))
    return looks.join(acts, ["file_key", "block", "ord"]).select("file_key", "at", "line", "statement", c("act.at").alias("act_at"), c("act.line").alias("act_line"))
