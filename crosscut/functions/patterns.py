"""Pattern groups: what a line is tested for. Each group becomes one alternation, tested once a line."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_WORD = "A-Za-z0-9_"

# The members of each group. A str is contained as it is; rx is a regular expression, irx one that ignores
# case. They are written for ASCII word and space classes.
rx = lambda p: ("rx", p)
irx = lambda p: ("irx", p)

GROUPS: dict[str, list] = {
    "io": [
        rx(r"fetch\s*\("), rx(r"axios\s*\."), rx(r"axios\s*\("), rx(r"request\s*\("), rx(r"fs\s*\."),
        rx(r"client\s*\.\s*query\s*\("), rx(r"db\s*\."), rx(r"execute\s*\("), rx(r"prisma\s*\."), rx(r"mongoose\s*\."),
        rx(r"redis\s*\."), rx(r"http\s*\."), rx(r"https\s*\."), rx(r"net\s*\."), rx(r"dgram\s*\."),
        rx(r"requests\s*\.\s*(?:get|post|put|delete|patch|head|options)\s*\("), rx(r"urllib\s*\."), rx(r"httpx\s*\."),
        rx(r"aiohttp\s*\."), rx(r"open\s*\("), rx(r"cursor\s*\.\s*execute\s*\("), rx(r"session\s*\.\s*(?:query|execute)\s*\("),
    ],
    "error_handling": ["try", "catch", ".catch(", "except", "except:", "finally:"],
    "debug": [
        "console.log", "console.error", "console.warn", "console.debug", rx(r"print\s*\("),
        rx(r"logging\s*\.\s*(?:debug|info|warning|error)\s*\("), rx(r"logger\s*\.\s*(?:debug|info|warning|error)\s*\("),
    ],
    "validation": [
        "zod", "yup", "Joi", "joi", "schema", "validate", "class-validator", "io-ts", "ajv", "validator", "sanitize", "parse",
        "safeParse", "pydantic", "marshmallow", "cerberus", "voluptuous",
    ],
    "request_input": [
        "req.body", "req.query", "req.params", "request.body", "request.query", "request.params", "request.json", "request.form",
        "request.args", "request.data", "request.GET", "request.POST",
    ],
    "route_handler": [
        rx(r"app\s*\.\s*(?:get|post|put|patch|delete)\s*\("), rx(r"router\s*\.\s*(?:get|post|put|patch|delete)\s*\("), "express.Router",
        rx(r"@app\s*\.\s*route\s*\("), rx(r"@blueprint\s*\.\s*route\s*\("), rx(r"@app\s*\.\s*(?:get|post|put|patch|delete)\s*\("),
        rx(r"@router\s*\.\s*(?:get|post|put|patch|delete)\s*\("), rx(r"def\s+\w+\s*\(\s*request"),
    ],
    "loop": [
        rx(r"for\s*\("), rx(r"for\s+await\s*\("), rx(r"while\s*\("), rx(r"\.forEach\s*\("), rx(r"\.map\s*\("), rx(r"\.reduce\s*\("),
        rx(r"for\s+\w+\s+in\s+"), rx(r"while\s+\w+"), rx(r"async\s+for\s+"),
    ],
    "async": [rx(r"async\s+function"), rx(r"async\s*\("), rx(r"async\s+def\s+"), rx(r"await\s+")],
    "db_query": [
        irx(r"SELECT\s+\*"), irx(r"SELECT\s+\*\s+FROM"), rx(r"\.findMany\s*\("), rx(r"\.find\s*\("), rx(r"\.findAll\s*\("),
        rx(r"Model\s*\.\s*find\s*\("), rx(r"Model\s*\.\s*findAll\s*\("), rx(r"\.aggregate\s*\("), rx(r"\.query\s*\("), rx(r"prisma\s*\."),
        rx(r"db\s*\.\s*select\s*\("), rx(r"db\s*\.\s*query\s*\("), rx(r"\.collection\s*\("), rx(r"\.getAll\s*\("),
        rx(r"\.query\s*\(\s*\w+\s*\)"), rx(r"session\s*\.\s*query\s*\("), rx(r"\.query\s*\([^)]*\)\s*\.filter\s*\("), rx(r"\.filter_by\s*\("),
        rx(r"\.all\s*\(\s*\)"), rx(r"\.objects\s*\.\s*(?:all|filter|exclude)\s*\("), rx(r"QuerySet"),
    ],
    "pagination": [
        rx(r"\.limit\s*\("), rx(r"\.take\s*\("), rx(r"\.skip\s*\("), rx(r"\.offset\s*\("), rx(r"\.page\s*\("), rx(r"\.perPage\s*\("),
        irx(r"LIMIT\s+\d"), irx(r"OFFSET\s+\d"), irx(r"TOP\s+\d"), irx(r"FETCH\s+FIRST"), "pageSize", "pagination", rx(r"\.slice\s*\("),
        rx(r"\.paginate\s*\("), rx(r"\[\s*:\s*\d+\s*\]"), rx(r"\.first\s*\(\s*\)"), rx(r"\.one\s*\(\s*\)"),
    ],
    "collection": [
        rx(r"\.map\s*\("), rx(r"\.filter\s*\("), rx(r"\.reduce\s*\("), rx(r"\.forEach\s*\("), rx(r"for\s*\("), rx(r"for\s+of\b"), rx(r"for\s+await\b"),
        rx(r"for\s+\w+\s+in\s+"), rx(r"\[\s*\w+\s+for\s+"),
    ],
    "batching": [
        rx(r"Promise\s*\.\s*all\s*\("), rx(r"Promise\s*\.\s*allSettled\s*\("), "chunk", "batch", "pageSize", "batchSize", "bulkWrite",
        "bulkInsert", "insertMany", "createMany", "$transaction", "bulk_create", "bulk_update", "executemany", rx(r"asyncio\s*\.\s*gather\s*\("),
    ],
    "memory": [
        rx(r"fs\s*\.\s*readFileSync\s*\("), rx(r"readFileSync\s*\("), rx(r"\.readFile\s*\("), rx(r"JSON\s*\.\s*parse\s*\(\s*fs\s*\."),
        rx(r"\.toString\s*\(\s*\)"), rx(r"Buffer\s*\.\s*from\s*\("), rx(r"\.getObject\s*\("), rx(r"\.download\s*\("), rx(r"\.toArray\s*\(\s*\)"),
        rx(r"\.read\s*\(\s*\)"), rx(r"\.readlines\s*\(\s*\)"), rx(r"json\s*\.\s*load\s*\("), rx(r"pickle\s*\.\s*load\s*\("), rx(r"list\s*\(\s*\w+\s*\)"),
    ],
    "file_write": [
        rx(r"fs\s*\.\s*writeFile\s*\("), rx(r"fs\s*\.\s*writeFileSync\s*\("), rx(r"fs\s*\.\s*appendFile\s*\("), rx(r"fs\s*\.\s*appendFileSync\s*\("),
        rx(r"writeFile\s*\("), rx(r"writeFileSync\s*\("), rx(r"appendFile\s*\("), rx(r"appendFileSync\s*\("),
        rx(r"open\s*\([^)]*['\"][wa]['\"][^)]*\)"), rx(r"\.write\s*\("),
    ],
    "retry": [irx("retry"), irx("retries"), irx("maxRetries"), irx("numRetries"), irx("attempt"), irx("attempts"), irx("tenacity"), irx("backoff")],
    "backoff": [
        irx("backoff"), irx("exponential"), irx("jitter"), "setTimeout", rx(r"sleep\s*\("), rx(r"wait\s*\("), rx(r"time\s*\.\s*sleep\s*\("),
        rx(r"asyncio\s*\.\s*sleep\s*\("),
    ],
    "tight_loop": [irx(r"while\s*\(\s*true\s*\)"), rx(r"while\s*\(\s*1\s*\)"), rx(r"for\s*\(\s*;\s*;\s*\)"), rx(r"while\s+True\s*:"), rx(r"while\s+1\s*:")],
    "check": [
        rx(r"\.findOne\s*\("), rx(r"\.findUnique\s*\("), rx(r"\.findFirst\s*\("), rx(r"\.get\s*\("), rx(r"\.getOne\s*\("), irx(r"SELECT\s+.*\s+WHERE"),
        rx(r"\.exists\s*\("), rx(r"\.first\s*\(\s*\)"), rx(r"\.get_or_none\s*\("), rx(r"\.filter\s*\([^)]+\)\s*\.first\s*\("),
    ],
    "act": [
        rx(r"\.create\s*\("), rx(r"\.insert\s*\("), rx(r"\.insertOne\s*\("), irx(r"INSERT\s+INTO"), rx(r"\.save\s*\("), rx(r"\.add\s*\("),
        rx(r"\.objects\s*\.\s*create\s*\("), rx(r"session\s*\.\s*add\s*\("),
    ],
    "secret": [
        irx(r"(?:api[_-]?key|apikey|secret[_-]?key|auth[_-]?token|access[_-]?token|private[_-]?key|password|passwd|pwd)\s*[:=]\s*['\"`][a-zA-Z0-9_\-]{20,}['\"`]"),
        rx(r"(?:AWS|aws)[_-]?(?:ACCESS|SECRET)[_-]?(?:KEY|ID)\s*[:=]\s*['\"`][A-Z0-9]{16,}['\"`]"), rx(r"AKIA[0-9A-Z]{16}"),
        irx(r"(?:bearer|token|auth)\s*[:=]\s*['\"`][a-zA-Z0-9_\-\.]{20,}['\"`]"), irx(r"(?:mongodb|postgres|mysql|redis)://[^:]+:[^@]+@"),
        rx(r"gh[pousr]_[a-zA-Z0-9]{36,}"), rx(r"glpat-[a-zA-Z0-9\-]{20,}"), rx(r"sk_(?:live|test)_[a-zA-Z0-9]{24,}"), rx(r"pk_(?:live|test)_[a-zA-Z0-9]{24,}"),
        rx(r"(?:SECRET_KEY|API_KEY|AUTH_TOKEN)\s*=\s*['\"][a-zA-Z0-9_\-]{20,}['\"]"),
    ],
    "blocking": [
        rx(r"fs\s*\.\s*readFileSync\s*\("), rx(r"fs\s*\.\s*writeFileSync\s*\("), rx(r"fs\s*\.\s*appendFileSync\s*\("), rx(r"fs\s*\.\s*existsSync\s*\("),
        rx(r"fs\s*\.\s*mkdirSync\s*\("), rx(r"fs\s*\.\s*readdirSync\s*\("), rx(r"fs\s*\.\s*statSync\s*\("), rx(r"fs\s*\.\s*unlinkSync\s*\("),
        rx(r"fs\s*\.\s*copyFileSync\s*\("), rx(r"readFileSync\s*\("), rx(r"writeFileSync\s*\("), rx(r"execSync\s*\("), rx(r"spawnSync\s*\("), rx(r"execFileSync\s*\("),
        rx(r"crypto\s*\.\s*pbkdf2Sync\s*\("), rx(r"crypto\s*\.\s*scryptSync\s*\("), rx(r"crypto\s*\.\s*randomFillSync\s*\("), rx(r"time\s*\.\s*sleep\s*\("),
    ],
    "stateful": [
        rx(r"this\s*\.\s*\w+\s*=\s*new\s+Map\s*\("), rx(r"this\s*\.\s*\w+\s*=\s*new\s+Set\s*\("), rx(r"this\s*\.\s*\w+\s*=\s*new\s+WeakMap\s*\("),
        rx(r"this\s*\.\s*\w+\s*=\s*new\s+WeakSet\s*\("), rx(r"this\s*\.\s*\w+\s*=\s*\[\s*\]"), rx(r"this\s*\.\s*\w+\s*=\s*\{\s*\}"),
        irx(r"this\s*\.\s*(?:cache|store|storage|sessions|activeConnections|listeners|handlers|subscribers|queue|messageQueue|taskQueue|pending|jobs)\s*="),
        rx(r"^(?:const|let|var)\s+(?:cache|store|sessions|connections|listeners|handlers|queue|messageQueue)\s*=\s*(?:new\s+(?:Map|Set)|\{\}|\[\])"),
        rx(r"self\s*\.\s*\w+\s*=\s*(?:dict\s*\(\s*\)|set\s*\(\s*\)|\[\s*\]|\{\s*\})"),
        irx(r"self\s*\.\s*(?:cache|store|sessions|connections|listeners|handlers|queue|message_queue)\s*="),
        rx(r"^var\s+\w+\s*=\s*make\s*\(\s*map\s*\["), rx(r"^var\s+\w+\s+map\s*\["),
    ],
    "prototype_infra": [
        rx(r"require\s*\(\s*['\"]sqlite3['\"]\s*\)"), rx(r"require\s*\(\s*['\"]better-sqlite3['\"]\s*\)"), rx(r"import\s+.*\s+from\s+['\"]sqlite3['\"]"),
        rx(r"import\s+.*\s+from\s+['\"]better-sqlite3['\"]"), rx(r"new\s+sqlite3\s*\.\s*Database\s*\("), irx(r"new\s+Database\s*\(\s*['\"][^'\"]+\.(?:db|sqlite)"),
        rx(r"require\s*\(\s*['\"]lowdb['\"]\s*\)"), rx(r"import\s+.*\s+from\s+['\"]lowdb['\"]"), rx(r"new\s+Low\s*\("), rx(r"require\s*\(\s*['\"]nedb['\"]\s*\)"),
        rx(r"import\s+.*\s+from\s+['\"]nedb['\"]"), rx(r"new\s+Datastore\s*\("), rx(r"JSON\s*\.\s*parse\s*\(\s*(?:fs\s*\.\s*)?readFileSync\s*\(\s*['\"][^'\"]+\.json['\"]"),
        rx(r"(?:fs\s*\.\s*)?writeFileSync\s*\(\s*['\"][^'\"]+\.json['\"]\s*,\s*JSON\s*\.\s*stringify"), rx(r"import\s+sqlite3"), rx(r"sqlite3\s*\.\s*connect\s*\("),
        rx(r"from\s+tinydb\s+import"), rx(r"TinyDB\s*\("), rx(r"session\s*:\s*\{\s*secret.*store\s*:\s*.*FileStore"), rx(r"new\s+FileStore\s*\("),
        irx(r"(?:data|db|database|storage)(?:Path|File|Dir)?\s*[:=]\s*['\"][./]"),
    ],
    "unsafe_eval": [
        rx(r"\beval\s*\("), rx(r"new\s+Function\s*\("), rx(r"setTimeout\s*\(\s*['\"`]"), rx(r"setInterval\s*\(\s*['\"`]"), rx(r"(?<!\.)exec\s*\("),
        rx(r"compile\s*\([^)]*,\s*['\"]exec['\"]"),
    ],
    "hardcoded_url": [
        rx(r"['\"`]https?://localhost[:/]"), rx(r"['\"`]https?://127\.0\.0\.1[:/]"), rx(r"['\"`]https?://0\.0\.0\.0[:/]"),
        irx(r"(?:api|service|backend)(?:Url|Endpoint|Host|Base)\s*[:=]\s*['\"`]https?://"), rx(r"['\"`]https?://[^'\"`:]+:\d{4,5}[/'\"`]"),
        rx(r"['\"`]wss?://localhost"), rx(r"['\"`]wss?://127\.0\.0\.1"),
    ],
    "hack": [irx(r"\b(?:TODO|FIXME|HACK|XXX|TEMP)\b")],
    "large_collection": [irx(r"\b(?:items|rows|users|messages|data|results|records|entries|documents|events|logs|orders|products)\b")],
    "streaming_hint": [irx("stream|pipe|chunk|createReadStream")],
    "hardcoded_path": [rx(r"(?:writeFile|appendFile)(?:Sync)?\s*\(\s*[\"'`][^\"'`]+[\"'`]")],
    "delay": [rx(r"setTimeout|sleep|await\s+delay|await\s+wait|await\s+new\s+Promise"), rx(r"\breturn\b|\bbreak\b")],
    "request_use": ["req.", "res.", "request.", "response."],
    "non_null": [rx(r"!\.\w"), rx(r"\w!\.")],
    "cast": [rx(r"as\s+\w+")],
    "async_call": ["fetch(", "axios.", "client.query(", "prisma.", "mongoose."],
    "async_handled": ["await", "return", ".then("],
    "module_literal": [rx(r"^(?:let|var)\s+\w+\s*=\s*(?:new\s+(?:Map|Set|Array)|\{|\[)")],
    "top_level_mutable": [rx(r"^\+(?:let|var)\s+\w+\s*="), rx(r"^\+const\s+\w+\s*=\s*[\[{]")],
}
#: In order: the first that matches names the call. http marks members whose text has http in it.
EXTERNAL_CALLS: list[tuple] = [
    rx(r"fetch\s*\("), rx(r"axios\s*\.\s*(?:get|post|put|delete)\s*\("), rx(r"axios\s*\("), rx(r"http\s*\.\s*get\s*\("), rx(r"https\s*\.\s*get\s*\("),
    rx(r"request\s*\("), rx(r"got\s*\("), "superagent", rx(r"requests\s*\.\s*(?:get|post|put|delete)\s*\("), rx(r"httpx\s*\.\s*(?:get|post|put|delete)\s*\("),
]
# End of the fixed values.


#: Texts of which every line that a group matches holds one; a line without them is not tested further. lower marks
#: groups whose texts are looked for in the lower-cased line, because they have members that ignore case.
HINTS: dict[str, list[str]] = {
    "io": ["fetch", "axios", "request", "fs", "client", "db", "execute", "prisma", "mongoose", "redis", "http", "net", "dgram", "urllib", "open", "session"],
    "error_handling": ["try", "catch", "except", "finally:"],
    "debug": ["console.", "print", "logg"],
    "route_handler": ["app", "router", "express.Router", "blueprint", "def"],
    "request_input": ["req"],
    "loop": ["for", "while", ".map", ".reduce"],
    "async": ["async", "await"],
    "batching": ["Promise", "chunk", "batch", "pageSize", "bulk", "Many", "$transaction", "executemany", "gather"],
    "collection": [".map", ".filter", ".reduce", "for"],
    "memory": ["read", "parse", "toString", "Buffer", "getObject", "download", "toArray", "load", "list"],
    "file_write": ["write", "append", "open"],
    "blocking": ["Sync", "sleep"],
    "stateful:lower": ["this", "self", "const", "let", "var"],
    "prototype_infra:lower": ["sqlite", "lowdb", "nedb", "new", "json", "tinydb", "filestore", "data", "db", "storage"],
    "unsafe_eval": ["eval", "Function", "setTimeout", "setInterval", "exec"],
    "hardcoded_url:lower": ["http", "ws"],
    "tight_loop:lower": ["while", "for"],
    "db_query:lower": ["select", ".find", ".aggregate", ".query", "prisma", "query", ".collection", ".getall", ".filter", ".all", ".objects", "model"],
    "pagination:lower": ["limit", ".take", ".skip", "offset", ".page", ".perpage", "top", "fetch", "pagesize", "pagination", ".slice", ".paginate", "[", ".first", ".one"],
    "check:lower": [".find", ".get", "select", ".exists", ".first", ".filter"],
    "act:lower": ["create", "insert", ".save", "add"],
    "secret:lower": ["'", '"', "`", "://", "akia", "gh", "glpat-", "sk_", "pk_"],
    "hack:lower": ["todo", "fixme", "hack", "xxx", "temp"],
    "retry:lower": ["retr", "attempt", "tenacity", "backoff"],
    "streaming_hint:lower": ["stream", "pipe", "chunk"],
    "hardcoded_path": ["writeFile", "appendFile"],
    "delay": ["setTimeout", "sleep", "await", "return", "break"],
    "cast": ["as"],
    "non_null": ["!"],
}


def literal(text: str) -> str:
    """text as a regular expression that both dialects read alike."""
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", text)


def java(group: str) -> str:
    """The group as one alternation for Spark."""
    return "|".join(java_member(m) for m in GROUPS[group])


def java_member(item) -> str:
    """A member for Spark, whose \\b is not between ASCII classes: before a word it becomes a look behind, after one a look ahead."""
    p = re.sub(r"\\b(?=[\w(])", f"(?<![{ASCII_WORD}])", _plain(item)).replace(r"\b", f"(?![{ASCII_WORD}])")
    return _cased(item, p)


def re2_member(item) -> str:
    """A member for a dialect without look-around, whose \\b lies between ASCII classes."""
    return _cased(item, _plain(item)).replace(r"(?<!\.)exec", "(?:^|[^.])exec")


def _plain(item) -> str:
    return literal(item) if isinstance(item, str) else item[1]


def _cased(item, p: str) -> str:
    return f"(?i:{p})" if not isinstance(item, str) and item[0] == "irx" else p


def re2(group: str) -> str:
    return "|".join(re2_member(m) for m in GROUPS[group])


def hint(line: Column, group: str, low: Column | None = None) -> Column | None:
    """Whether the line holds one of the group's hints, or null for a group without. low is the line in lower case."""
    texts, where = HINTS.get(group), line
    if texts is None:
        texts, where = HINTS.get(f"{group}:lower"), F.lower(line) if low is None else low
    if texts is None:
        return None
    out = where.contains(texts[0])
    for t in texts[1:]:
        out = out | where.contains(t)
    return out


def flag(line: Column, group: str, low: Column | None = None) -> Column:
    """Whether the line matches any member of the group. Members that are plain texts need no regular expression."""
    members = GROUPS[group]
    if all(isinstance(m, str) for m in members) and group not in HINTS:
        least = [m for m in members if not any(o != m and o in m for o in members)]
        out = line.contains(least[0])
        for t in least[1:]:
            out = out | line.contains(t)
        return out
    near = hint(line, group, low)
    return line.rlike(java(group)) if near is None else near & line.rlike(java(group))


def in_lower_case(line: Column, then: Callable[[Column], Column]) -> Column:
    """then(the line in lower case), which is made once.

    What then gives is not part of the generated method of its stage: many tests in one would make that method
    too long to be compiled to machine code.
    """
    return F.element_at(F.transform(F.array(F.lower(line)), then), 1)
