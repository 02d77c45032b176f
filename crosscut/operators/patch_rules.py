"""The rules over added lines of a patch: one sort a file, one pass of flags and frames, one unpivot."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.patterns import EXTERNAL_CALLS, flag, in_lower_case, java_member
from ..functions.rules import RULE_IDS, lookup
from . import neighbourhood
from .lines import before, counted, in_file, marked, number

#: Once a file has as many findings, no further line of it is looked at.
MAX_FINDINGS = 50
#: In rule_ord: a changed name, which is no finding itself.
CHANGE = 200
#: A text of at most so many bytes that makes up 1/COMMON of all lines or more is read once for all of them.
COMMON, COMMON_BYTES = 20_000, 400

# Our own messages.
MESSAGES: dict[str, str] = {
    "MIXED_RESPONSE_SHAPES": "Responses of one handler have different shapes.",
    "TEMPORARY_HACK": "A marker says that this is unfinished.",
    "UNSAFE_IO": "An outside call without error handling near it.",
    "CONSOLE_DEBUG": "Debug output.",
    "UNVALIDATED_INPUT": "Request input is used without validation near it.",
    "DATA_SHAPE_ASSUMPTION": "An assertion takes the shape of data for granted.",
    "LOOPED_IO": "An outside call for each turn of a loop.",
    "SILENT_ERROR": "A caught error is swallowed.",
    "GLOBAL_MUTATION": "Module-level state is changed later.",
    "ASYNC_MISUSE": "An asynchronous result is not waited for, or its failure not handled.",
    "UNBOUNDED_QUERY": "A query without a limit.",
    "UNBOUNDED_COLLECTION_PROCESSING": "A request handler goes through a whole collection.",
    "MISSING_BATCHING": "A loop makes calls that could be batched.",
    "NO_CACHING": "The same outside call is made several times.",
    "MEMORY_RISK": "A whole file or result is held in memory.",
    "SHARED_FILE_WRITE": "Workers may write to the same fixed path.",
    "RETRY_STORM_RISK": "Retries without growing delays.",
    "BUSY_WAIT_OR_TIGHT_LOOP": "An endless loop without delay or exit.",
    "CHECK_THEN_ACT_RACE": "A check and the act that depends on it can interleave with others.",
    "HARDCODED_SECRET": "A credential stands in the code.",
    "BLOCKING_OPERATION": "A call that blocks its thread.",
    "STATEFUL_SERVICE": "State is held in the memory of one instance.",
    "PROTOTYPE_INFRA": "Embedded or file-based infrastructure.",
    "UNSAFE_EVAL": "Text is executed as code.",
    "HARDCODED_URL": "A fixed address.",
}


SHAPE = r"(?:res\.(?:json|send)|return)\s*\(\s*\{([^}]*)\}"
#: A word that the text after it changes.
CHANGED = r"\w+(?=\.push\(|\[.+\]\s*=|\.\w+\s*=|\s*=)"
DECLARED = r"^\+(?:let|var|const)\s+(\w+)\s*="


def line_rules(low: Column | None = None, told: Callable[[str], Column] | None = None) -> list[tuple[str, str | Column, Column, list[str]]]:
    """(kind, severity, predicate, frames it reads) in the order in which one line's findings are reported. body and the frames are columns, low is body in lower case.

    told gives the test of a group if it is known already.
    """
    b, c = F.col("body"), F.col
    low = F.lower(b) if low is None else low
    has = (lambda g: flag(b, g, low)) if told is None else told
    test = X.is_test_file(c("filename"))
    io = c("_body_io") if told is None else told("io")
    call = has("async_call") & ~has("async_handled")
    rules = [
        ("TEMPORARY_HACK", "medium", has("hack")),
        ("UNSAFE_IO", "high", io & ~c("near_error_handling") & ~c("after_loop"), "near_error_handling", "after_loop"),
        ("CONSOLE_DEBUG", "low", ~test & has("debug")),
        ("UNVALIDATED_INPUT", "medium", c("in_route_handler") & ~c("near_validation") & has("request_input"), "in_route_handler", "near_validation"),
        ("DATA_SHAPE_ASSUMPTION", "medium", has("non_null")),
        ("DATA_SHAPE_ASSUMPTION", "medium", has("request_input") & has("cast")),
        ("LOOPED_IO", "high", io & c("after_loop"), "after_loop"),
        ("SILENT_ERROR", F.when(c("io_around"), "high").otherwise("medium"), b.contains("catch") & neighbourhood.silent_catch(c("_ahead")), "io_around"),
        ("ASYNC_MISUSE", "medium", c("in_async") & b.contains(".then(") & ~c("near_error_handling"), "in_async", "near_error_handling"),
        ("ASYNC_MISUSE", "medium", c("in_async") & call, "in_async"),
        ("UNBOUNDED_QUERY", "high", ~c("near_pagination") & has("db_query"), "near_pagination"),
        ("UNBOUNDED_COLLECTION_PROCESSING", "high", c("in_request") & has("large_collection") & has("collection"), "in_request"),
        ("MISSING_BATCHING", "high", c("before_io") & ~c("near_batching") & has("loop"), "before_io", "near_batching"),
        ("MEMORY_RISK", "high", has("memory") & ~has("streaming_hint")),
        ("SHARED_FILE_WRITE", "high", has("hardcoded_path") & has("file_write")),
        ("RETRY_STORM_RISK", "high", io & ~c("near_backoff") & (flag(low, "retry") if told is None else told("retry")), "near_backoff"),
        ("BUSY_WAIT_OR_TIGHT_LOOP", "high", ~c("before_delay") & has("tight_loop"), "before_delay"),
        ("CHECK_THEN_ACT_RACE", "medium", c("before_act") & has("check"), "before_act"),
        ("HARDCODED_SECRET", "high", has("secret")),
        ("BLOCKING_OPERATION", "medium", ~test & has("blocking")),
        ("STATEFUL_SERVICE", "high", has("stateful")),
        ("PROTOTYPE_INFRA", "high", has("prototype_infra")),
        ("UNSAFE_EVAL", "high", has("unsafe_eval")),
        ("HARDCODED_URL", "medium", ~test & has("hardcoded_url")),
    ]
    return [(kind, severity, holds, list(frames)) for kind, severity, holds, *frames in rules]


def response_keys() -> Column:
    """The sorted keys of a response literal on an added line, or null."""
    raw = F.col("raw")
    near = raw.contains("res.") | raw.contains("return")
    keys = F.array_sort(F.regexp_extract_all(F.regexp_extract(raw, SHAPE, 1), F.lit(r"(\w+)\s*:"), F.lit(1)))
    return F.when((F.col("op") != "@") & raw.startswith("+") & near & raw.rlike(SHAPE), F.when(F.size(keys) > 0, keys))


def call_signature(body: Column) -> tuple[Column, Column]:
    """(signature, whether it is outside): the first kind of call on the line and its first quoted text, else the line's start."""
    near = X.any_of(body, ["fetch", "axios", "http", "request", "got", "superagent"])
    kind = None
    for i, m in enumerate(EXTERNAL_CALLS):
        hit = body.rlike(java_member(m))
        kind = F.when(hit, i) if kind is None else kind.when(hit, i)
    spelled = [i for i, m in enumerate(EXTERNAL_CALLS) if "http" in (m if isinstance(m, str) else m[1])]
    kind = F.when(near, kind)
    quoted = F.nullif(F.regexp_extract(body, "[\"'`]([^\"'`]+)[\"'`]", 1), F.lit(""))
    rest = F.coalesce(quoted, F.concat(F.lit(":"), F.substring(X.trim(body), 1, 50)))
    sig = F.when(kind.isNotNull(), F.concat(kind.cast("string"), F.lit(" "), rest))
    return sig, kind.isin(spelled) | X.any_of(rest, ["http", "api.", "fetch("])


#: Groups that the rules test an added line for, by bit.
TESTS = (
    "io hack debug request_input non_null cast async_call async_handled db_query large_collection collection loop memory streaming_hint hardcoded_path file_write retry tight_loop check secret blocking stateful "
    "prototype_infra unsafe_eval hardcoded_url"
).split()


def _apart(value: Column) -> Column:
    """value, kept out of the generated method of its stage, which it would make too long to be compiled to machine code."""
    return F.element_at(F.transform(F.array(F.lit(0)), lambda _: value), 1)


def _declared(raw: Column) -> Column:
    return F.when((F.col("op") == "+") & flag(raw, "top_level_mutable"), F.regexp_extract(raw, DECLARED, 1))


def _name_bit(name: Column) -> Column:
    """One of 64 bits. A file's names together are a few bits, however many they are."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(name), F.lit(64)).cast("int"))


def _changed_words(raw: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(raw, F.lit(CHANGED), F.lit(0)))
    return F.when(raw.startswith("+") & (raw.contains("=") | raw.contains(".push(")), words)


def _before_frames() -> Column:
    """What a marked line says by its text alone and the lines around it ask for."""
    near = {f for r in line_rules() for f in r[3]}
    return F.struct(neighbourhood.flags_of(near).alias("flags"), _declared(F.col("raw")).alias("name"))


def _after_frames() -> Column:
    """What else a marked line says by its text alone: the groups that an added line matches as bits, a response's keys, an outside call, changed words."""
    body = F.col("body")

    def tests(low: Column) -> Column:
        hit = lambda i, g: F.when(flag(low if g == "retry" else body, g, low), F.lit(1 << i)).otherwise(0)
        out = hit(0, TESTS[0])
        for i, g in enumerate(TESTS[1:], 1):
            out = out + hit(i, g)
        return out

    sig, outside = call_signature(body)
    return F.struct(in_lower_case(body, tests).alias("tests"), response_keys().alias("keys"), sig.alias("sig"), outside.alias("outside"), _changed_words(F.col("raw")).alias("words"))


def _common(lines: DataFrame) -> DataFrame:
    """(text, before, after) of the texts that many of the lines have. lines is read twice."""
    least = lines.count() / COMMON
    x = lines.where(F.octet_length("raw") <= COMMON_BYTES).groupBy("raw").count().where(F.col("count") >= least)
    return marked(x.select("raw")).select(F.col("raw").alias("text"), _before_frames().alias("before"), _after_frames().alias("after"))


def _said(x: DataFrame, common: DataFrame, part: str, otherwise: Column) -> DataFrame:
    """x with part: taken from common, or made for a text that is not there."""
    told = F.broadcast(common.select("text", F.col(part).alias(f"_{part}")))
    x = x.join(told, x["raw"] == told["text"], "left")
    return x.withColumn(part, F.when(F.col("text").isNotNull(), F.col(f"_{part}")).otherwise(otherwise)).drop("text", f"_{part}")


def analyze_lines(lines: DataFrame, max_findings: int | None = MAX_FINDINGS, kinds: Iterable[str] | None = None) -> DataFrame:
    """Findings (file_key, filename, idx, rule_ord, line, severity, kind, snippet, message) of patch lines.

    lines has file_key, filename, idx and raw. A file's lines must fit in one sort group, as one file's do; all
    frames share one order, so the lines are dealt by file once and read once. rule_ord orders findings of one line;
    idx -1 comes before all lines, and repeated calls and changed globals come after them. With kinds, only those are
    looked for; as the cap counts findings of all kinds, it must be off then (max_findings None).

    Without kinds, lines are written once, and what a text says by itself is found once for all lines that have it if these are
    many (at most COMMON texts, which are broadcast), else for each line.
    """
    from ..sources.staging import staged

    wanted = set(RULE_IDS if kinds is None else kinds)
    if kinds is not None and max_findings is not None:
        raise ValueError("the cap counts findings of all kinds")
    rules = line_rules()
    mine = [(i + 1, *r) for i, r in enumerate(rules) if r[0] in wanted]
    near = {f for r in mine for f in r[4]}
    raw, added = F.col("raw"), F.col("op") == "+"
    shapes, names, calls, catches = ("MIXED_RESPONSE_SHAPES" in wanted, "GLOBAL_MUTATION" in wanted, "NO_CACHING" in wanted, "SILENT_ERROR" in wanted)

    common = None
    if kinds is None:
        lines = staged(lines.select("file_key", "filename", "idx", "raw"), "patch-lines")
        common = staged(_common(lines), "common-lines")

    # what a line says by itself, then what those around it say, in two steps that share one order
    own = {"_flags": neighbourhood.flags_of(near)} if near else {}
    if any(r[1] in ("UNSAFE_IO", "LOOPED_IO", "RETRY_STORM_RISK") for r in mine):
        own["_body_io"] = F.coalesce(flag(F.col("body"), "io"), F.lit(False))
    if names:
        own["_name"] = _declared(raw)
    first = {**counted(), **neighbourhood.frames(near)}
    if shapes:  # responses are numbered with file headers counted too: + headers as added lines, - headers as removed ones
        first["_shape_steps"] = F.coalesce(F.sum(F.when((F.col("op") == "@") | raw.startswith("-"), 0).otherwise(1)).over(before()), F.lit(0))
    if names:
        first["_longest"] = F.max(F.length("_name")).over(in_file().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        first["_names"] = F.bit_or(_name_bit(F.col("_name"))).over(in_file().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    if catches:  # only lines in reach of a catch are carried
        first["_reach"] = F.when(F.coalesce(F.bool_or(F.col("body").contains("catch")).over(in_file().rowsBetween(-9, 0)), F.lit(False)), raw)
    second = {"new_line": number()}
    if shapes:
        second["_shape_line"] = number("_shape_steps")
    if catches:
        second["_ahead"] = F.array("_reach", *[F.lead("_reach", k).over(in_file()) for k in range(1, 10)])
    x = marked(lines)
    if common is None:
        x = x.withColumns(own)
    else:
        x = _said(x, common, "before", _apart(_before_frames())).withColumns({"_flags": F.col("before.flags"), "_name": F.col("before.name")}).drop("before")
    x = x.withColumns(first).withColumns(second)

    # numbers of the findings of each line, and what else it has to say; blank added lines count as lines but are not looked at
    looked_at = added & (X.trim(F.col("body")) != "")
    ints, none, no_keys = F.array().cast("array<int>"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def tests(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(holds, F.lit(i + 1)) for i, (kind, _, holds, _) in enumerate(line_rules(low)) if kind in wanted]))

    if common is not None:
        x = _said(x, common, "after", _apart(_after_frames()))
        told = lambda g: F.coalesce(F.col("after.tests").bitwiseAND(F.lit(1 << TESTS.index(g))) != 0, F.lit(False))
        hits = _apart(F.array_compact(F.array(*[F.when(holds, F.lit(i + 1)) for i, (_, _, holds, _) in enumerate(line_rules(told=told))])))
    else:
        hits = in_lower_case(F.col("body"), tests) if mine else ints
    x = x.withColumn("_hits", F.when(looked_at, hits).otherwise(ints))
    if max_findings is not None:
        x = x.withColumn("_before", F.coalesce(F.sum(F.size("_hits")).over(before()), F.lit(0)))

    def entry(order, sig=none, keys=no_keys, outside=None):
        return F.struct(F.lit(order).alias("rule_ord"), sig.alias("sig"), keys.alias("keys"), F.coalesce(F.lit(False) if outside is None else outside, F.lit(False)).alias("outside"))

    more, parts = [], [F.transform("_hits", lambda h: entry(h))]
    if shapes:
        keys = response_keys() if common is None else F.col("after.keys")
        more.append(F.when(keys.isNotNull(), entry(0, keys=keys)))
    if names:
        more.append(F.when(looked_at & F.col("_name").isNotNull(), entry(101, F.concat(F.lit("v "), F.col("_name")))))
        # a name is no whole word where it is changed, so every end of a changed word counts, down to one letter, that may be a name of the file
        words = _changed_words(raw) if common is None else F.col("after.words")
        some = lambda e: F.col("_names").bitwiseAND(_name_bit(e)) != 0
        ends = lambda w: F.filter(F.transform(F.sequence(F.lit(1), F.least(F.length(w), F.col("_longest"))), lambda n: F.right(w, n)), some)
        changes = F.when(F.col("_longest").isNotNull(), F.array_distinct(F.flatten(F.transform(words, ends))))
        parts.append(F.coalesce(F.transform(changes, lambda w: entry(CHANGE, F.concat(F.lit("v "), w))), F.array()))
    if calls:
        sig, outside = call_signature(F.col("body")) if common is None else (F.col("after.sig"), F.col("after.outside"))
        more.append(F.when(looked_at & sig.isNotNull(), entry(102, sig, outside=outside)))
    if more:
        parts.append(F.array_compact(F.array(*more)))
    carried = ["file_key", "filename", "idx", "new_line", *(["_shape_line"] if shapes else []), *(["io_around"] if catches else []), *(["_before"] if max_findings is not None else [])]
    said = F.concat(*parts)
    e = x.select(*carried, X.snippet(F.col("body")).alias("snippet"), F.explode(said).alias("f")).select(*carried, "snippet", "f.*")

    # all windows go by file, as the lines are dealt already. Of a file's responses, the first and the first unlike it count
    file = Window.partitionBy("file_key")
    mixed, had_mixed, order = F.col("rule_ord") == 0, F.lit(0), F.col("rule_ord")
    if shapes:
        e = e.withColumn("_one", F.min(F.when(mixed, F.struct("idx", "keys"))).over(file))
        e = e.withColumn("_two", F.min(F.when(F.col("keys") != F.col("_one.keys"), F.struct("idx", F.col("_shape_line").alias("line")))).over(file))
        e = e.where(~mixed | (F.col("_two").isNotNull() & (F.col("idx") == F.col("_one.idx"))))
        had_mixed = F.when(F.col("_two").isNotNull(), 1).otherwise(0)
    if max_findings is not None:
        e = e.where((order == CHANGE) | mixed | (F.col("_before") + had_mixed < max_findings))
    if calls or names:  # a call counts once if its signature occurs again; a declaration if a later line changes its name
        same = Window.partitionBy("file_key", "sig")
        about = {"_calls": F.count("*").over(same), "_first": F.min(F.col("idx")).over(same), "_changed": F.max(F.when(order == CHANGE, F.col("idx"))).over(same)}
        holds = F.when(order == 102, (F.col("_calls") >= 2) & (F.col("_first") == F.col("idx"))).when(order == 101, F.coalesce(F.col("_changed") > F.col("idx"), F.lit(False)))
        e = e.withColumns(about).where(holds.otherwise(order != CHANGE))
    if max_findings is not None:
        had = F.count(F.when(order != 102, 1)).over(file)
        nth = F.sum((order == 102).cast("int")).over(file.orderBy("idx", "rule_ord"))
        e = e.withColumns({"_had": had, "_call": nth}).where((order != 102) | (F.col("_had") + F.col("_call") <= max_findings))

    rows = [(i + 1, kind, sev if isinstance(sev, str) else None) for i, (kind, sev, _, _) in enumerate(rules)]
    kinds_of = {o: k for o, k, _ in rows} | {0: "MIXED_RESPONSE_SHAPES", 101: "GLOBAL_MUTATION", 102: "NO_CACHING"}
    severities = {o: s for o, _, s in rows if s} | {0: "medium", 101: "high"}
    severity = F.coalesce(lookup(severities, order), F.when(order == 102, F.when(F.col("outside"), "high").otherwise("medium")))
    if catches:
        severity = F.coalesce(severity, F.when(F.col("io_around"), "high").otherwise("medium"))
    line, snippet = F.col("new_line"), F.col("snippet")
    if shapes:
        line = F.when(mixed, F.col("_shape_line")).otherwise(line)
        snippet = F.when(mixed, F.concat(F.lit("Shapes differ at lines "), F.col("_shape_line").cast("string"), F.lit(" and "), F.col("_two.line").cast("string"))).otherwise(snippet)
    if names:
        snippet = F.when(order == 101, F.concat(F.lit("Variable '"), F.substring("sig", 3, 1_000_000_000), F.lit("' is mutated after declaration"))).otherwise(snippet)
    e = e.select("file_key", "filename", F.when(mixed, -1).otherwise(F.col("idx")).alias("idx"), "rule_ord", line.alias("line"), severity.alias("severity"), lookup(kinds_of, order).alias("kind"), snippet.alias("snippet"))
    return e.withColumn("message", lookup(MESSAGES, F.col("kind")))


def analyze_patches(files: DataFrame, max_findings: int | None = MAX_FINDINGS) -> DataFrame:
    """analyze_lines for (file_key, filename, patch)."""
    from .lines import patch_lines

    return analyze_lines(patch_lines(files), max_findings)
