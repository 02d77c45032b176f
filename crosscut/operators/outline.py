"""Outlines of source files: imports, definitions and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim
from .lines import content_lines
from .source_lines import let

# What counts as an import, and definitions in the order in which they are tried, all on trimmed lines.
IMPORTS = [
    r"^import\s+.*\z", r"^import\s*\{[^}]*\}\s*from\s*['\"][^'\"]+['\"]", r"^import\s+\*\s+as\s+\w+\s+from\s*['\"][^'\"]+['\"]", r"^import\s+['\"][^'\"]+['\"]",
    r"^(?:const|let|var)\s+(?:\{[^}]*\}|\w+)\s*=\s*require\s*\(['\"][^'\"]+['\"]\)", r"^require\s*\(['\"][^'\"]+['\"]\)",
    r"^import\s+[\w.]+(?:\s+as\s+\w+)?\z", r"^from\s+[\w.]+\s+import\s+.+\z", r"^using\s+[\w.]+;\z",
]
DEFINITIONS = [
    (r"^export\s+(?:default\s+)?(?:abstract\s+)?class\s+\w+", "class"),
    (r"^(?:abstract\s+)?class\s+\w+", "class"),
    (r"^export\s+interface\s+\w+", "interface"),
    (r"^interface\s+\w+", "interface"),
    (r"^export\s+type\s+\w+\s*=", "type"),
    (r"^type\s+\w+\s*=", "type"),
    (r"^export\s+(?:default\s+)?(?:async\s+)?function\s+\w+", "function"),
    (r"^export\s+(?:default\s+)?const\s+\w+\s*=\s*(?:async\s*)?\(", "function"),
    (r"^export\s+(?:default\s+)?const\s+\w+\s*=\s*(?:async\s*)?(?:<[^>]+>)?\s*\(", "function"),
    (r"^export\s+const\s+\w+\s*(?::\s*[^=]+)?\s*=\s*(?!(?:async\s*)?\()", "const"),
    # begins with white space, so it never matches a trimmed line
    (r"^\s+(?:public\s+|private\s+|protected\s+)?(?:static\s+)?(?:async\s+)?(?:get\s+|set\s+)?\w+\s*(?:<[^>]*>)?\s*\([^)]*\)\s*(?::\s*[^{]+)?(?:\s*\{)?\z", "method"),
    (r"^class\s+\w+(?:\([^)]*\))?:", "class"),
    (r"^(?:async\s+)?def\s+\w+\s*\([^)]*\)", "function"),
    (r"^@\w+(?:\([^)]*\))?\z", "decorator"),
]
BREAKS = [" {", "(", " =>", " ="]
MAX_IMPORTS, MAX_DEFINITIONS = 10, 20


def is_import(line: Column) -> Column:
    return line.rlike("|".join(IMPORTS))


def definition(line: Column) -> Column:
    out = None
    for p, kind in DEFINITIONS:
        out = F.when(line.rlike(p), kind) if out is None else out.when(line.rlike(p), kind)
    return out


def shorten(line: Column, n: int = 80) -> Column:
    """A trimmed line; one over n characters is cut after the first kind of break that it has before that, else at n."""
    cut = None
    for b in BREAKS:
        at = F.instr(line, b)
        hit = (at > 1) & (at <= n)
        text = F.concat(F.substring(line, F.lit(1), at + len(b) - 1), F.lit("..."))
        cut = F.when(hit, text) if cut is None else cut.when(hit, text)
    return F.when(F.length(line) <= n, line).otherwise(cut.otherwise(F.concat(F.substring(line, 1, n), F.lit("..."))))


def compact(files: DataFrame) -> DataFrame:
    """(file_key, filename, lines, imports, classes, functions, summary) of (file_key, filename, content)."""
    x = content_lines(files).withColumn("t", trim(F.col("text"))).withColumn("imp", is_import(F.col("t")))
    x = x.withColumn("def", F.when(~F.col("imp"), definition(F.col("t"))))
    g = x.groupBy("file_key", "filename").agg(F.count("*").alias("lines"), F.count_if("imp").alias("imports"), F.count_if(F.col("def") == "class").alias("classes"), F.count_if(F.col("def") == "function").alias("functions"))
    plural = lambda c, one, many: F.when(F.col(c) > 1, F.concat(F.col(c).cast("string"), F.lit(many))).when(F.col(c) == 1, F.lit(one))
    parts = F.array_compact(F.array(F.concat(F.col("lines").cast("string"), F.lit(" lines")), F.when(F.col("imports") > 0, F.concat(F.col("imports").cast("string"), F.lit(" imports"))), plural("classes", "1 class", " classes"), plural("functions", "1 fn", " fns")))
    return g.withColumn("summary", F.concat(F.col("filename"), F.lit(": "), F.array_join(parts, ", ")))


def _islands(lines: Column) -> Column:
    """Imports that span lines, as (lo, hi) in order, of the lines of a file: a start opens an island, which the next closing line ends.

    A start that lies within an open island belongs to it. Each file's few starts and ends are paired in order by one fold.
    """
    empty = F.array().cast("array<struct<lo:int,hi:int>>")
    init = F.struct(F.lit(None).cast("int").alias("open"), empty.alias("all"))

    def step(s: Column, m: Column) -> Column:
        closes = s["open"].isNotNull() & m["ends"] & (m["line_no"] > s["open"])
        opens = s["open"].isNull() & m["starts"]
        island = F.array(F.struct(s["open"].alias("lo"), m["line_no"].alias("hi")))
        return F.struct(F.when(closes, F.lit(None).cast("int")).when(opens, m["line_no"]).otherwise(s["open"]).alias("open"), F.when(closes, F.concat(s["all"], island)).otherwise(s["all"]).alias("all"))

    tail = lambda s: F.when(s["open"].isNotNull(), F.array(F.struct(s["open"].alias("lo"), (F.size(lines) + 1).alias("hi")))).otherwise(empty)
    return let(F.aggregate(F.filter(lines, lambda m: m["starts"] | m["ends"]), init, step), lambda s: F.concat(s["all"], tail(s)))


def outline(files: DataFrame) -> DataFrame:
    """(file_key, filename, outline): a Markdown outline with up to 10 imports and 20 definitions.

    Blank and comment lines are passed over. A decorator goes before the definition that follows it at once. A file's lines are dealt once, and
    no table is joined, so none is broadcast however small Spark takes it for.
    """
    c = F.col
    x = files.select("file_key", "filename", F.posexplode_outer(F.split("content", "\n")).alias("p", "text"))
    x = x.select("file_key", "filename", (c("p") + 1).alias("line_no"), trim(c("text")).alias("t"))
    skip = (c("t") == "") | c("t").rlike(r"^(?://|#|/\*|\*)")
    x = x.withColumn("skip", skip).withColumn("imp", ~c("skip") & is_import(c("t")))
    x = x.withColumn("starts", c("imp") & c("t").contains("{") & ~c("t").contains("}") & ~c("t").contains("from"))
    x = x.withColumn("ends", c("t").contains(";") | (c("t").contains("from") & c("t").contains("'")))
    x = x.withColumn("kind", F.when(~c("skip") & ~c("imp"), definition(c("t"))))
    line = F.when(c("line_no").isNotNull(), F.struct("line_no", "t", "skip", "imp", "starts", "ends", "kind"))
    x = x.groupBy("file_key", "filename").agg(F.sort_array(F.collect_list(line)).alias("all"))
    # islands lie among the lines, each before the first of its own
    none = lambda kind: F.lit(None).cast(kind)
    places = F.transform(_islands(c("all")), lambda i: F.struct(i["lo"].alias("at"), F.lit(0).alias("rank"), i.alias("i"), none("string").alias("t"), F.lit(True).alias("skip"), F.lit(False).alias("imp"), none("string").alias("kind")))
    rows = F.transform("all", lambda m: F.struct(m["line_no"].alias("at"), F.lit(1).alias("rank"), none("struct<lo:int,hi:int>").alias("i"), m["t"].alias("t"), m["skip"].alias("skip"), m["imp"].alias("imp"), m["kind"].alias("kind")))
    x = x.select("file_key", "filename", F.size("all").alias("n"), F.explode_outer(F.concat(places, rows)).alias("m")).select("file_key", "filename", "n", "m.*")
    near = Window.partitionBy("file_key", "filename").orderBy("at", "rank")
    x = x.withColumn("i", F.last("i", ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("i", F.when(c("i.hi") >= c("at"), c("i"))).where("rank = 1 or rank is null")
    # lines that may be definitions, and the one before each, among themselves
    plain = ~c("skip") & ~c("imp") & c("i").isNull()
    among = Window.partitionBy("file_key", "filename", plain).orderBy("at")
    x = x.withColumn("pending", F.when(plain & (F.lag("kind").over(among) == "decorator"), F.lag("t").over(among)))
    # an island's text, at the line that ends it
    island = Window.partitionBy("file_key", "filename", "i.lo")
    ends = c("i").isNotNull() & (c("at") == c("i.hi"))
    buf = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c("i").isNotNull(), F.struct("at", "t"))).over(island)), lambda s: s["t"]), " ")
    module = F.nullif(F.regexp_extract("buf", r"from\s*['\"]([^'\"]+)['\"]", 1), F.lit(""))
    x = x.withColumn("buf", F.when(ends, buf))
    text = F.concat(F.coalesce(F.concat(shorten(c("pending")), F.lit(" ")), F.lit("")), shorten(c("t")))
    imported = F.when(ends, F.coalesce(F.concat(F.lit("import { ... } from '"), module, F.lit("'")), shorten(c("buf")))).when(c("imp") & c("i").isNull(), shorten(c("t")))
    defined = F.when(plain & (c("kind") != "decorator"), F.concat(F.upper(F.substring("kind", 1, 1)), F.substring("kind", 2, 20), F.lit(": `"), text, F.lit("`")))
    listed = lambda what: F.transform(F.sort_array(F.collect_list(F.when(what.isNotNull(), F.struct("at", what.alias("text"))))), lambda s: s["text"])
    out = x.groupBy("file_key", "filename").agg(F.nullif(F.max("n"), F.lit(0)).alias("n"), listed(imported).alias("imports"), listed(defined).alias("defs"))

    def section(title: str, col: str, cap: int, word: str, show) -> Column:
        items = F.transform(F.slice(col, 1, cap), show)
        more = F.when(F.size(col) > cap, F.array(F.concat(F.lit("- *... and "), (F.size(col) - cap).cast("string"), F.lit(f" more {word}*")))).otherwise(F.array().cast("array<string>"))
        return F.when(F.col(col).isNotNull() & (F.size(col) > 0), F.concat(F.array(F.lit(f"### {title}")), items, more, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))

    stats = F.array_compact(F.array(F.concat(F.lit("Total lines: "), F.col("n").cast("string")), F.when(F.size("imports") > 0, F.concat(F.lit("Imports: "), F.size("imports").cast("string"))), F.when(F.size("defs") > 0, F.concat(F.lit("Definitions: "), F.size("defs").cast("string")))))
    head = F.array(F.concat(F.lit("## File Structure: "), F.col("filename")), F.lit(""), F.concat(F.lit("*"), F.array_join(stats, " | "), F.lit("*")), F.lit(""))
    body = F.concat(head, section("Imports", "imports", MAX_IMPORTS, "imports", lambda s: F.concat(F.lit("- `"), s, F.lit("`"))), section("Definitions", "defs", MAX_DEFINITIONS, "definitions", lambda s: F.concat(F.lit("- "), s)))
    return out.select("file_key", "filename", F.array_join(body, "\n").alias("outline"))
