"""Short sources in each language with the findings that their structure holds, written out by hand."""

from __future__ import annotations

#: (file name, source, findings as "line KIND"); a fetch counts as a query too
SNIPPETS: list[tuple[str, str, list[str]]] = [
    ("a.ts", "export async function load(id) {\n  const r = await fetch(`/a/${id}`)\n  return r\n}", ["2 UNSAFE_IO", "2 UNBOUNDED_QUERY"]),
    ("a.ts", "async function load() {\n  try {\n    return await fetch('/a')\n  } catch (e) {\n    throw new Error('no')\n  }\n}", ["3 UNBOUNDED_QUERY"]),
    ("a.js", "function start() {\n  return fetch('/a').catch((e) => report(e))\n}", ["2 UNBOUNDED_QUERY"]),
    ("a.ts", "async function all(users) {\n  for (const u of users) {\n    await fetch(u.url)\n  }\n}", ["3 LOOPED_IO", "3 UNBOUNDED_QUERY"]),
    ("a.ts", "async function all(users) {\n  users.forEach(async (u) => {\n    await axios.get(u.url)\n  })\n}", ["3 LOOPED_IO"]),
    ("a.js", "const rows = ids.map((id) => fetch(id))", ["1 LOOPED_IO", "1 UNBOUNDED_QUERY"]),
    ("a.ts", "async function users() {\n  try {\n    return await prisma.user.findMany()\n  } catch (e) {\n    throw e\n  }\n}", ["3 UNBOUNDED_QUERY"]),
    ("a.ts", "async function users() {\n  try {\n    return await db.users.findMany().take(5)\n  } catch (e) {\n    throw e\n  }\n}", []),
    ("a.ts", "async function users() {\n  try {\n    return await db.users.findMany({ limit: 5 })\n  } catch (e) {\n    throw e\n  }\n}", []),
    ("a.ts", "const seen = []\nfunction add(x) {\n  seen.push(x)\n}", ["1 GLOBAL_MUTATION"]),
    ("a.ts", "let count = 0\nfunction next() {\n  count++\n}", ["1 GLOBAL_MUTATION"]),
    ("a.ts", "function next() {\n  let count = 0\n  count++\n}", []),
    ("a.js", "try {\n  run()\n} catch (e) {\n}", ["3 SILENT_ERROR"]),
    ("a.js", "try {\n  run()\n} catch (e) {\n  console.log(e)\n}", ["3 SILENT_ERROR"]),
    ("a.js", "try {\n  run()\n} catch (e) {\n  console.log(e)\n  throw e\n}", []),
    ("a.ts", "try {\n  const a = fs.readFileSync('x')\n} catch (e) {\n  throw e\n}", ["2 BLOCKING_OPERATION"]),
    ("a.ts", "execSync('ls')", ["1 BLOCKING_OPERATION"]),
    ("a.ts", "// fetch('/a')\nconst s = \"fetch('/b')\"", []),
    ("b.py", "import requests\n\ndef load():\n    return requests.get('/a')", ["4 UNSAFE_IO"]),
    ("b.py", "def load():\n    try:\n        return requests.get('/a')\n    except Exception as e:\n        raise ValueError(e)", []),
    ("b.py", "def load(urls):\n    for u in urls:\n        requests.get(u)", ["3 LOOPED_IO"]),
    ("b.py", "def load(urls):\n    return [requests.get(u) for u in urls]", ["2 LOOPED_IO"]),
    ("b.py", "try:\n    run()\nexcept Exception:\n    pass", ["3 SILENT_ERROR"]),
    ("b.py", "try:\n    run()\nexcept Exception as e:\n    print(e)", ["3 SILENT_ERROR"]),
    ("b.py", "try:\n    run()\nexcept Exception as e:\n    print(e)\n    raise", []),
    ("b.py", "seen = {}\n\ndef add(k):\n    seen[k] = 1", ["1 GLOBAL_MUTATION"]),
    ("b.py", "seen = []\n\ndef add(x):\n    seen.append(x)", ["1 GLOBAL_MUTATION"]),
    ("b.py", "import time\n\nasync def wait():\n    time.sleep(1)", ["4 BLOCKING_OPERATION"]),
    ("b.py", "def broken(:\n    x = 1\n\ndef load():\n    return requests.get('/a')", ["5 UNSAFE_IO"]),
    ("b.py", "print 'old'\n\ndef load(urls):\n    for u in urls:\n        requests.get(u)", ["5 LOOPED_IO"]),
    ("c.go", "package main\n\nfunc load(urls []string) {\n\tfor _, u := range urls {\n\t\tresp, err := http.Get(u)\n\t\tif err != nil {\n\t\t\treturn\n\t\t}\n\t\tuse(resp)\n\t}\n}", ["5 LOOPED_IO"]),
    ("c.go", "package main\n\nfunc load() error {\n\tresp, err := http.Get(\"/a\")\n\tif err != nil {\n\t\treturn err\n\t}\n\tuse(resp)\n\treturn nil\n}", []),
    ("d.rb", "class Loader\n  def load\n    begin\n      run\n    rescue => e\n      raise e\n    end\n  end\nend", []),
    ("d.rb", "def load(urls)\n  urls.each do |u|\n    HTTParty.get(u)\n  end\nend", ["3 LOOPED_IO"]),
    ("e.txt", "fetch('/a')", []),
]
#: (file name, source, outline)
OUTLINES: list[tuple[str, str, str]] = [
    ("m.ts", "import {\n  a,\n  b\n} from 'mod'\nimport c from 'c'\n\n// note\nexport class K {\n}\nexport interface I {\n}", "## File Structure: m.ts\n\n*Total lines: 11 | Imports: 2 | Definitions: 2*\n\n### Imports\n- `import { ... } from 'mod'`\n- `import c from 'c'`\n\n### Definitions\n- Class: `export class K {`\n- Interface: `export interface I {`\n"),
    ("m.py", "import os\nfrom a.b import c\n\n@cached\ndef f(x):\n    return x\n\nclass K:\n    pass", "## File Structure: m.py\n\n*Total lines: 9 | Imports: 2 | Definitions: 2*\n\n### Imports\n- `import os`\n- `from a.b import c`\n\n### Definitions\n- Function: `@cached def f(x):`\n- Class: `class K:`\n"),
    ("m.js", "const x = require('x')\nexport const go = async (a) => {\n}\nexport type T = string", "## File Structure: m.js\n\n*Total lines: 4 | Imports: 1 | Definitions: 2*\n\n### Imports\n- `const x = require('x')`\n\n### Definitions\n- Function: `export const go = async (a) => {`\n- Type: `export type T = string`\n"),
]
#: (file name, source, ranges as "type start-end")
RANGES: list[tuple[str, str, list[str]]] = [
    ("r.ts", "// one\nconst a = 'two'\n/* three\nfour */\nconst b = `five`", ["comment 1-1", "string 2-2", "comment 3-4", "string 5-5"]),
    ("r.py", "# one\na = 'two'\n\"\"\"three\nfour\"\"\"", ["comment 1-1", "string 2-2", "string 3-4"]),
    ("r.go", "package m // one\nvar a = \"two\"", ["comment 1-1", "string 2-2"]),
    ("r.rb", "# one\na = 'two'", ["comment 1-1", "string 2-2"]),
    ("r.md", "# one", []),
]
