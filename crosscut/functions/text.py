"""Text functions on columns: trimming, snippets, file names, languages, globs, redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns

#: White space that is trimmed.
SPACE = " \t\n\r\f\x0b ﻿"

# File name tables.
CODE_EXTENSIONS = ".ts .tsx .js .jsx .py .go .rb .java .cs".split()
REVIEW_EXTENSIONS = ".ts .tsx .js .jsx .mjs .cjs .py .pyw .go .rb .rake .java .kt .scala .cs .fs .rs .c .cpp .cc .h .hpp .php .swift .vue .svelte".split()
STRUCTURAL_LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyw": "python", "go": "go", "rb": "ruby", "rake": "ruby", "ru": "ruby"}
LABELLED_LANGUAGES = [(".ts", "TypeScript"), (".tsx", "TSX"), (".js", "JavaScript"), (".jsx", "JSX"), (".py", "Python"), (".go", "Go"), (".rb", "Ruby"), (".java", "Java"), (".cs", "CSharp")]
BASELINE_SKIPS = ["/test/", "/tests/", "__tests__", ".test.", ".spec.", "_test.", "node_modules/", "vendor/", "dist/"]
TRANSIENT_ERRORS = ["network", "timeout", "econnreset", "econnrefused", "socket", "rate limit", "429", "500", "502", "503", "504"]
REDACTED = "[REDACTED_SECRET]"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def snippet(c: Column, n: int = 100) -> Column:
    return F.substring(trim(c), 1, n)


def any_of(c: Column, parts: list[str]) -> Column:
    """Whether c contains any of parts."""
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def is_code_file(name: Column) -> Column:
    """Case-sensitive suffixes."""
    return name.rlike("(?:" + "|".join(re.escape(e) for e in CODE_EXTENSIONS) + r")\z")


def is_review_file(name: Column) -> Column:
    """The last extension, in any case, is one of source code; a name without a dot is its own extension."""
    dot = F.length(name) - F.coalesce(F.nullif(F.instr(F.reverse(name), "."), F.lit(0)), F.length(name)) + 1
    return F.lower(F.substring(name, dot, F.length(name))).isin(REVIEW_EXTENSIONS)


def is_test_file(name: Column) -> Column:
    return any_of(name, [".test.", ".spec.", "__tests__"])


def is_go_test(name: Column) -> Column:
    return name.contains("_test.go")


def is_ruby_test(name: Column) -> Column:
    return any_of(name, ["_spec.rb", "_test.rb", "/spec/"])


def extension(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1))


def structural_language(name: Column) -> Column:
    out = F.create_map(*[F.lit(x) for kv in STRUCTURAL_LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(out, extension(name)), F.lit("unknown"))


def language_label(name: Column) -> Column:
    """Case-sensitive suffixes; null for other files."""
    out = None
    for end, label in LABELLED_LANGUAGES:
        out = F.when(name.endswith(end), label) if out is None else out.when(name.endswith(end), label)
    return out


def outline_language(name: Column) -> Column:
    return F.when(name.rlike(r"\.tsx?\z"), "typescript").when(name.rlike(r"\.(?:jsx?|mjs|cjs)\z"), "javascript").when(name.endswith(".py"), "python").otherwise("other")


def truncate(c: Column, n: int = 2000) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("\n... [truncated]"))).otherwise(c)


def redact(c: Column, token: str = REDACTED) -> Column:
    """Every secret replaced, one kind after another."""
    for m in patterns.GROUPS["secret"]:
        c = F.regexp_replace(c, patterns.java_member(m), token.replace("$", r"\$"))
    return c


def glob_regex(glob: str) -> str:
    """A path pattern as a regular expression over / separated paths; * stays within a part, ** spans parts, dots are plain."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Whether the path, with \\ read as /, matches any of globs; false for none."""
    if not globs:
        return F.lit(False)
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(r"\A(?:" + "|".join(glob_regex(g) for g in globs) + r")\z")


def is_transient_error(message: Column) -> Column:
    return any_of(F.lower(message), TRANSIENT_ERRORS)
