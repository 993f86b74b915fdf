"""Rule catalogs: what the operators join lines of code with. Regexes are data."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from riskloom.functions.files import read_lines, write_lines

# File extension to language.
EXTENSIONS = {
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".py": "python", ".pyw": "python", ".pyx": "python", ".rb": "ruby", ".erb": "ruby", ".go": "go", ".rs": "rust",
    ".php": "php", ".phtml": "php", ".swift": "swift", ".cs": "csharp", ".scala": "scala", ".jl": "julia",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".pl": "perl", ".pm": "perl", ".lua": "lua", ".r": "r",
    ".m": "objc", ".mm": "objc", ".asm": "assembly", ".s": "assembly",
    ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss", ".sass": "sass",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".toml": "toml", ".sql": "sql",
}

# Marks of a language in a text without a name, in order; ^ is the begin of the text.
MARKERS = {
    "python": [r"^def\s+\w+\s*\(", r"^import\s+\w+", r"^from\s+\w+\s+import"],
    "javascript": [r"^const\s+", r"^let\s+", r"^var\s+", r"function\s*\w*\s*\("],
    "java": [r"^public\s+class", r"^private\s+", r"^import\s+java\."],
    "c": [r"^#include\s*<", r"^int\s+main\s*\(", r"printf\s*\("],
    "cpp": [r"^#include\s*<iostream>", r"^using\s+namespace", r"cout\s*<<"],
    "go": [r"^package\s+\w+", r"^func\s+", r"^import\s+\("],
    "rust": [r"^fn\s+main\s*\(", r"^use\s+std::", r"^let\s+mut\s+"],
    "php": [r"<\?php", r"\$\w+\s*=", r"^function\s+\w+\s*\("],
    "ruby": [r"^def\s+\w+", r"^class\s+\w+", r"^require\s+['\"]"],
}

# Functions to be wary of.
DANGEROUS = {
    "c": ["strcpy", "strncpy", "strcat", "strncat", "sprintf", "vsprintf", "gets", "scanf", "fscanf", "sscanf", "memcpy", "memmove", "memset", "malloc", "calloc", "realloc", "free", "alloca", "printf", "fprintf", "snprintf", "vprintf", "vfprintf", "system", "popen", "exec", "execl", "execle", "execlp", "execv", "execve", "execvp", "fopen", "freopen", "tmpfile", "tmpnam", "tempnam", "mktemp", "mkstemp"],
    "cpp": ["strcpy", "strncpy", "strcat", "sprintf", "gets", "memcpy", "memmove", "malloc", "free", "system", "popen", "new", "delete", "reinterpret_cast", "const_cast"],
    "java": ["Runtime.exec", "ProcessBuilder", "Class.forName", "Method.invoke", "ObjectInputStream.readObject", "XMLDecoder", "Statement.execute", "Statement.executeQuery", "Statement.executeUpdate", "InitialContext.lookup", "XMLReader", "SAXParser", "DocumentBuilder", "URL.openConnection", "HttpURLConnection", "new File", "FileInputStream", "FileOutputStream", "PrintWriter.print", "PrintWriter.println"],
    "javascript": ["eval", "Function", "setTimeout", "setInterval", "innerHTML", "outerHTML", "document.write", "document.writeln", "insertAdjacentHTML", "__proto__", "constructor.prototype", "child_process.exec", "child_process.spawn", "require('child_process')", "mysql.query", "connection.query", "fs.readFile", "fs.writeFile", "fs.readFileSync", "JSON.parse", "serialize", "unserialize"],
    "python": ["eval", "exec", "compile", "__import__", "os.system", "os.popen", "subprocess.call", "subprocess.run", "subprocess.Popen", "commands.getoutput", "pickle.load", "pickle.loads", "cPickle.load", "yaml.load", "yaml.unsafe_load", "marshal.load", "shelve.open", "cursor.execute", "connection.execute", "open", "file", "os.path.join", "urllib.urlopen", "urllib2.urlopen", "requests.get", "xml.etree.ElementTree.parse", "lxml.etree.parse", "render_template_string", "Template"],
    "php": ["eval", "assert", "create_function", "preg_replace", "system", "exec", "shell_exec", "passthru", "popen", "proc_open", "pcntl_exec", "backticks", "include", "include_once", "require", "require_once", "mysql_query", "mysqli_query", "pg_query", "unserialize", "maybe_unserialize", "file_get_contents", "file_put_contents", "fopen", "readfile", "move_uploaded_file", "simplexml_load_string", "DOMDocument::loadXML", "curl_exec"],
    "go": ["exec.Command", "os/exec", "db.Query", "db.Exec", "db.QueryRow", "os.Open", "ioutil.ReadFile", "os.Create", "template.HTML", "template.JS", "template.CSS", "json.Unmarshal", "gob.Decode", "xml.Unmarshal", "unsafe.Pointer"],
    "rust": ["unsafe", "transmute", "from_raw_parts", "Command::new", "process::Command", "as_ptr", "as_mut_ptr", "std::mem::forget", "std::mem::uninitialized"],
    "ruby": ["eval", "instance_eval", "class_eval", "module_eval", "send", "__send__", "public_send", "system", "exec", "`", "spawn", "popen", "IO.popen", "Open3.popen3", "Marshal.load", "YAML.load", "find_by_sql", "execute", "File.open", "File.read", "File.write", "ERB.new"],
}

# Where tainted data enters, and where it does harm (feature, semantic and data-flow passes).
INPUTS = {
    "c": [r"scanf\s*\(", r"fgets\s*\(", r"gets\s*\(", r"read\s*\(", r"recv\s*\(", r"getenv\s*\(", r"argv\["],
    "python": [r"input\s*\(", r"raw_input\s*\(", r"sys\.argv", r"request\.(args|form|data|json|values)", r"os\.environ", r"\.read\(\)", r"socket\.recv"],
    "javascript": [r"req\.(params|query|body|headers)", r"process\.argv", r"process\.env", r"document\.(location|cookie|referrer)", r"window\.location", r"\.value\b", r"localStorage\.getItem", r"sessionStorage\.getItem"],
    "java": [r"request\.getParameter", r"request\.getHeader", r"request\.getCookies", r"System\.getenv", r"\.readLine\(\)", r"Scanner\s*\(", r"args\["],
    "php": [r"\$_GET", r"\$_POST", r"\$_REQUEST", r"\$_COOKIE", r"\$_SERVER", r"\$_FILES", r"getenv\s*\(", r"file_get_contents\s*\(\s*['\"]php://input"],
    "go": [r"r\.URL\.Query\(\)", r"r\.FormValue\(", r"r\.Header\.Get\(", r"os\.Args", r"os\.Getenv\(", r"bufio\.NewReader"],
}
SINKS = {
    "c": [r"printf\s*\(", r"sprintf\s*\(", r"system\s*\(", r"exec\w*\s*\(", r"write\s*\(", r"send\s*\("],
    "python": [r"print\s*\(", r"os\.system\s*\(", r"subprocess\.\w+\s*\(", r"cursor\.execute\s*\(", r"\.write\s*\(", r"render_template\s*\("],
    "javascript": [r"eval\s*\(", r"innerHTML\s*=", r"document\.write\s*\(", r"\.exec\s*\(", r"\.query\s*\(", r"res\.(send|write|render)\s*\("],
    "java": [r"Runtime\..*exec\s*\(", r"Statement\.execute\w*\s*\(", r"\.write\s*\(", r"response\.getWriter\(\)\.print"],
    "php": [r"echo\s+", r"print\s+", r"system\s*\(", r"exec\s*\(", r"mysql\w*_query\s*\(", r"include\s*\("],
    "go": [r"fmt\.Print", r"io\.WriteString", r"exec\.Command", r"db\.(Query|Exec)", r"template\.Execute"],
}

# Regex families that features count.
FAMILIES = {
    "crypto": [r"(?i)(md5|sha1|sha256|sha512|aes|des|rsa|hmac|pbkdf)", r"(?i)(encrypt|decrypt|hash|sign|verify|key|secret|password)", r"(?i)(crypto|cipher|digest|random)"],
    "file": [r"(?i)(fopen|open|read|write|close|unlink|remove|rename)", r"(?i)(file|path|directory|folder)", r"\.\.\/"],
    "network": [r"(?i)(socket|connect|bind|listen|accept|send|recv)", r"(?i)(http|https|ftp|ssh|tcp|udp|url)", r"(?i)(request|response|client|server)"],
    "memory": [r"malloc\s*\(", r"calloc\s*\(", r"realloc\s*\(", r"free\s*\(", r"new\s+", r"delete\s+", r"memcpy\s*\(", r"memmove\s*\(", r"memset\s*\("],
}
DECISIONS = [r"\bif\b", r"\belse\s+if\b", r"\belif\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"\b\?\s*[^:]+\s*:", r"\b&&\b", r"\b\|\|\b", r"\band\b", r"\bor\b"]
POINTERS = [r"\w+\s*\+\+", r"\+\+\s*\w+", r"\w+\s*--", r"--\s*\w+", r"\w+\s*\+=\s*\d+", r"\w+\s*-=\s*\d+", r"\w+\s*\+\s*\d+", r"\w+\s*-\s*\d+", r"\[\s*\w+\s*\+", r"\[\s*\w+\s*-"]
LONE_CALL, CHECKED_CALL = r"^\s*[a-zA-Z_][a-zA-Z0-9_.:]*\s*\([^)]*\)\s*;?\s*$", r"^\s*(print|log|debug|assert|return)"

# Comment marks (line prefixes, block begin, block end).
COMMENTS = {
    **dict.fromkeys(["c", "cpp", "java", "javascript", "typescript", "rust", "go", "swift", "kotlin"], (["//"], "/*", "*/")),
    "python": (["#"], '"""', '"""'),
    "ruby": (["#"], "=begin", "=end"),
    "php": (["//", "#"], "/*", "*/"),
    "julia": (["#"], "#=", "=#"),
}

# Kinds of tokens, tried in this order.
TOKEN = "|".join([r"[a-zA-Z_][a-zA-Z0-9_]*", r"0[xX][0-9a-fA-F]+", r"0[bB][01]+", r"\d+\.?\d*[eE]?[+-]?\d*", r'"[^"\\]*(?:\\.[^"\\]*)*"', r"'[^'\\]*(?:\\.[^'\\]*)*'", r"[+\-*/%=<>!&|^~?:]+", r"[\[\]{}();,.]"])

# Function definitions, group 1 the name.
FUNCTIONS = {
    "c": [r"(?:static\s+)?(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*\{"],
    "cpp": [r"(?:static\s+)?(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*(?:const\s*)?\{"],
    "java": [r"(?:public|private|protected)?\s*(?:static\s+)?(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*\{"],
    "javascript": [r"function\s+(\w+)\s*\([^)]*\)\s*\{", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>", r"(\w+)\s*:\s*(?:async\s+)?function\s*\([^)]*\)"],
    "python": [r"def\s+(\w+)\s*\([^)]*\)\s*:"],
    "rust": [r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*\([^)]*\)"],
    "go": [r"func\s+(?:\([^)]+\)\s+)?(\w+)\s*\([^)]*\)"],
    "julia": [r"function\s+(\w+)\s*\([^)]*\)"],
}

# Declarations (kind, regex), assignments, casts, nulls, opens and closes, words that are no variables.
DECLARATIONS = {
    "python": [("variable", r"^([a-zA-Z_]\w*)\s*="), ("function", r"^def\s+([a-zA-Z_]\w*)\s*\("), ("class", r"^class\s+([a-zA-Z_]\w*)"), ("parameter", r"def\s+\w+\s*\(([^)]+)\)")],
    "javascript": [("variable", r"(?:const|let|var)\s+([a-zA-Z_$]\w*)"), ("function", r"function\s+([a-zA-Z_$]\w*)\s*\("), ("class", r"class\s+([a-zA-Z_$]\w*)")],
    "java": [("variable", r"(?:int|String|boolean|long|double|float|Object|\w+)\s+([a-zA-Z_]\w*)\s*[=;]"), ("function", r"(?:public|private|protected)?\s*(?:static\s+)?(?:\w+\s+)+([a-zA-Z_]\w*)\s*\("), ("class", r"class\s+([a-zA-Z_]\w*)")],
    "c": [("variable", r"(?:int|char|long|float|double|void|unsigned|signed|\w+\s*\*?)\s+([a-zA-Z_]\w*)\s*[=;,\[]"), ("function", r"(?:\w+\s+)+([a-zA-Z_]\w*)\s*\([^)]*\)\s*\{")],
    "go": [("variable", r"(?:var|const)\s+([a-zA-Z_]\w*)"), ("variable", r"([a-zA-Z_]\w*)\s*:="), ("function", r"func\s+([a-zA-Z_]\w*)\s*\(")],
}
ASSIGNMENTS = {
    "python": [r"^([a-zA-Z_]\w*)\s*=\s*(.+)$", r"^([a-zA-Z_]\w*)\s*\+=", r"^([a-zA-Z_]\w*)\s*-="],
    "javascript": [r"(?:const|let|var)\s+([a-zA-Z_$]\w*)\s*=\s*(.+)", r"([a-zA-Z_$]\w*)\s*=\s*(.+)"],
    "java": [r"(?:\w+\s+)+([a-zA-Z_]\w*)\s*=\s*(.+)", r"([a-zA-Z_]\w*)\s*=\s*(.+)"],
    "c": [r"(?:\w+\s*\*?\s+)+([a-zA-Z_]\w*)\s*=\s*(.+)", r"([a-zA-Z_]\w*)\s*=\s*(.+)"],
    "go": [r"([a-zA-Z_]\w*)\s*:=\s*(.+)", r"(?:var\s+)?([a-zA-Z_]\w*)\s*=\s*(.+)"],
}
CASTS = {"c": [r"(\([\w\s\*]+\))\s*\w+", r"reinterpret_cast<"], "cpp": [r"reinterpret_cast<", r"const_cast<", r"(\([\w\s\*]+\))\s*\w+"], "java": [r"\((\w+)\)\s*\w+"]}
OPENS = {"c": [r"fopen\s*\(", r"open\s*\(", r"malloc\s*\(", r"socket\s*\("], "python": [r"open\s*\(", r"connect\s*\("], "java": [r"new\s+\w*Stream", r"new\s+\w*Connection"]}
CLOSES = {"c": [r"fclose\s*\(", r"close\s*\(", r"free\s*\("], "python": [r"\.close\s*\(", r"with\s+"], "java": [r"\.close\s*\(", r"try-with-resources"]}
NULLS = {"c": r"(\w+)\s*=\s*NULL", "cpp": r"(\w+)\s*=\s*(?:NULL|nullptr)", "java": r"(\w+)\s*=\s*null", "javascript": r"(\w+)\s*=\s*(?:null|undefined)", "python": r"(\w+)\s*=\s*None"}
PRIVILEGES = [r"setuid", r"setgid", r"seteuid", r"chmod\s*\(\s*['\"]?\d{3,4}", r"admin", r"root", r"sudo", r"privilege", r"elevat"]
KEYWORDS = {
    "python": ["if", "else", "elif", "for", "while", "def", "class", "return", "import", "from", "try", "except", "finally", "with", "as", "print", "range", "len", "str", "int", "float", "list", "dict"],
    "javascript": ["if", "else", "for", "while", "function", "return", "const", "let", "var", "class", "new", "this", "typeof", "instanceof", "console", "Array", "Object", "String", "Number"],
    "java": ["if", "else", "for", "while", "return", "class", "public", "private", "static", "new", "this", "super", "extends", "implements"],
    "c": ["if", "else", "for", "while", "return", "struct", "typedef", "sizeof"],
    "go": ["if", "else", "for", "func", "return", "package", "import", "struct", "interface", "make", "new", "len", "cap", "append"],
}
BUILTINS = {
    "python": ["True", "False", "None", "print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple"],
    "javascript": ["true", "false", "null", "undefined", "console", "window", "document", "Math", "JSON", "Array"],
    "java": ["true", "false", "null", "System", "String", "Integer"],
    "c": ["NULL", "true", "false", "sizeof"],
    "go": ["true", "false", "nil", "make", "new", "len", "cap"],
}

# Control lines. Braces are escaped, as Java's regexes ask.
_BRACE_ELSE = r"^\}\s*else\s*\{"
IFS = {"python": r"^if\s+", "javascript": r"^if\s*\(", "java": r"^if\s*\(", "c": r"^if\s*\(", "go": r"^if\s+", "*": r"^if\s+"}
ELSES = {"python": r"^else\s*:", "javascript": _BRACE_ELSE, "java": _BRACE_ELSE, "c": _BRACE_ELSE, "go": _BRACE_ELSE, "*": r"^else\b"}
LOOPS = {"python": r"^(for|while)\s+", "javascript": r"^(for|while)\s*\(", "java": r"^(for|while)\s*\(", "c": r"^(for|while)\s*\(", "go": r"^for\s+", "*": r"^(for|while)\s+"}
RETURNS = r"^(return|throw|raise)\b"

# The taint pass's own sources, sinks, protections and sanitizers.
USER_INPUT = {
    "python": [r"input\s*\(", r"raw_input\s*\(", r"sys\.argv", r"request\.(args|form|data|json|values|get|post)", r"flask\.request", r"django\.request"],
    "javascript": [r"req\.(params|query|body|headers|cookies)", r"request\.(params|query|body)", r"process\.argv", r"document\.(location|URL|cookie|referrer)", r"window\.location", r"\.value\b", r"prompt\s*\("],
    "java": [r"request\.getParameter\s*\(", r"request\.getHeader\s*\(", r"request\.getCookies\s*\(", r"request\.getInputStream\s*\(", r"Scanner\s*\(\s*System\.in", r"args\["],
    "php": [r"\$_GET", r"\$_POST", r"\$_REQUEST", r"\$_COOKIE", r"\$_SERVER\s*\[\s*['\"](?:HTTP_|REQUEST_|QUERY_)", r"file_get_contents\s*\(\s*['\"]php://input", r"\$argv"],
    "c": [r"scanf\s*\(", r"gets\s*\(", r"fgets\s*\(", r"getchar\s*\(", r"argv\[", r"getenv\s*\("],
    "go": [r"r\.URL\.Query\s*\(", r"r\.FormValue\s*\(", r"r\.PostFormValue\s*\(", r"r\.Header\.Get\s*\(", r"os\.Args", r"bufio\.NewReader\s*\(\s*os\.Stdin"],
    "*": [r"(?i)input", r"(?i)request"],
}
TAINT_SOURCES = {
    "file": [r"(?i)read\s*\(", r"(?i)fread\s*\(", r"(?i)file_get_contents\s*\(", r"(?i)open\s*\([^)]+,\s*['\"]r", r"(?i)\.read\s*\(", r"(?i)\.readlines\s*\("],
    "network": [r"(?i)recv\s*\(", r"(?i)socket\.recv", r"(?i)\.get\s*\(", r"(?i)fetch\s*\(", r"(?i)XMLHttpRequest", r"(?i)axios\."],
    "env": [r"(?i)getenv\s*\(", r"(?i)os\.environ", r"(?i)process\.env", r"(?i)System\.getenv", r"(?i)\$_ENV"],
    "database": [r"(?i)\.fetch\w*\s*\(", r"(?i)cursor\.execute", r"(?i)\.query\s*\(", r"(?i)ResultSet\."],
}
TAINT_SINKS = {
    "sql": [r"(?i)\.execute\s*\(", r"(?i)\.query\s*\(", r"(?i)mysql_query\s*\(", r"(?i)mysqli_query\s*\(", r"(?i)pg_query\s*\(", r"(?i)cursor\.execute\s*\(", r"(?i)Statement\.execute", r"(?i)db\.(Query|Exec)\s*\("],
    "command": [r"(?i)system\s*\(", r"(?i)exec\s*\(", r"(?i)popen\s*\(", r"(?i)shell_exec\s*\(", r"(?i)subprocess\.", r"(?i)os\.system\s*\(", r"(?i)Runtime\..*exec\s*\(", r"(?i)ProcessBuilder\s*\(", r"(?i)child_process", r"(?i)exec\.Command\s*\("],
    "xss": [r"(?i)innerHTML\s*=", r"(?i)outerHTML\s*=", r"(?i)document\.write\s*\(", r"(?i)\.html\s*\(", r"(?i)echo\s+", r"(?i)print\s*\(", r"(?i)response\.write\s*\(", r"(?i)render_template\s*\(", r"(?i)fmt\.Fprint"],
    "file": [r"(?i)fopen\s*\(", r"(?i)open\s*\(", r"(?i)file_get_contents\s*\(", r"(?i)include\s*\(", r"(?i)require\s*\(", r"(?i)readFile\s*\(", r"(?i)writeFile\s*\(", r"(?i)os\.Open\s*\("],
    "code": [r"(?i)\beval\s*\(", r"(?i)Function\s*\(", r"(?i)exec\s*\(", r"(?i)compile\s*\(", r"(?i)__import__\s*\(", r"(?i)create_function\s*\(", r"(?i)preg_replace\s*\([^)]*\/[^\/]*e"],
    "ldap": [r"(?i)ldap_search\s*\(", r"(?i)ldap_bind\s*\(", r"(?i)InitialContext\.lookup\s*\("],
    "xpath": [r"(?i)xpath\s*\(", r"(?i)evaluate\s*\(", r"(?i)selectNodes\s*\("],
}
PROTECTIONS = r"(?i)(escape|sanitize|encode|quote|prepared|parameterized|htmlspecialchars|htmlentities)"
SANITIZERS = {
    "python": ["escape", "quote", "sanitize", "clean", "html.escape", "urllib.parse.quote", "bleach.clean", "markupsafe.escape"],
    "javascript": ["escape", "encodeURIComponent", "encodeURI", "sanitize", "DOMPurify.sanitize", "validator.escape", "he.encode"],
    "java": ["escapeHtml", "escapeXml", "escapeSql", "StringEscapeUtils", "HtmlUtils.htmlEscape", "PreparedStatement"],
    "php": ["htmlspecialchars", "htmlentities", "mysqli_real_escape_string", "addslashes", "filter_var", "strip_tags"],
    "go": ["html.EscapeString", "url.QueryEscape", "template.HTMLEscapeString"],
    "c": ["escape", "sanitize", "encode"],
}
ASSIGNED = {
    "python": r"^([a-zA-Z_]\w*)\s*=",
    "javascript": r"(?:const|let|var)?\s*([a-zA-Z_$]\w*)\s*=",
    "java": r"(?:\w+\s+)+([a-zA-Z_]\w*)\s*=",
    "php": r"(\$[a-zA-Z_]\w*)\s*=",
    "c": r"(?:\w+\s*\*?\s*)+([a-zA-Z_]\w*)\s*=",
    "go": r"([a-zA-Z_]\w*)\s*(?::=|=)",
    "*": r"([a-zA-Z_]\w*)\s*=",
}

# First lines that speak for a class.
LOCATIONS = {
    "INJECTION": r"(?i)(query|execute|eval|system|exec)",
    "BUFFER_OVERFLOW": r"(strcpy|sprintf|gets|memcpy)",
    "USE_AFTER_FREE": r"(free|delete)",
    "XSS": r"(innerHTML|document\.write|\.html\()",
    "CODE_EXECUTION": r"(eval|exec|system|popen)",
    "DESERIALIZATION": r"(unserialize|pickle|Marshal|yaml\.load)",
    "PATH_TRAVERSAL": r"(\.\./|\.\.\\|file_get_contents|readFile)",
    "SSRF": r"(curl|http|request|fetch|urlopen)",
}

# Default weights on numbered features, and bias, of the scoring model; the last is for all other classes.
WEIGHTS = {
    "INJECTION": ({5: 2.0, 6: 2.5, 11: 1.5, 12: 3.0}, -2.0),
    "BUFFER_OVERFLOW": ({8: 3.0, 11: 2.5, 14: 2.0}, -2.5),
    "USE_AFTER_FREE": ({8: 3.5, 1: 1.0, 2: 1.5}, -3.0),
    "XSS": ({5: 2.0, 6: 3.0, 12: 2.5}, -2.0),
    "CODE_EXECUTION": ({5: 2.5, 11: 4.0, 12: 3.0}, -3.0),
    "DESERIALIZATION": ({5: 2.0, 11: 3.5}, -2.5),
    "PATH_TRAVERSAL": ({5: 2.0, 9: 3.0, 12: 2.0}, -2.0),
    "SSRF": ({5: 2.5, 10: 3.0, 12: 2.5}, -2.5),
    "AUTHENTICATION_BYPASS": ({1: 1.5, 13: 2.0}, -2.0),
    "CRYPTO_WEAKNESS": ({7: 3.0, 11: 2.0}, -1.5),
    "*": ({1: 0.5, 11: 1.0, 12: 1.5}, -2.0),
}

# What makes a match a false positive, in order: key in the rule's exclusions, regex on the context, reason.
EXCLUSIONS = {
    "uses_strncpy": (r"\bstrncpy\b", "Uses safe strncpy alternative"),
    "uses_safe_load": (r"(?i)safe_load", "Uses safe_load"),
    "uses_constant_time": (r"(?i)(constant_time|secure_compare|hmac\.compare)", "Uses constant-time comparison"),
    "is_config_file": (r"(?i)(example|sample|template|default|placeholder)", "Appears to be example/template"),
    "is_checksum": (r"(?i)(checksum|hash.*file|integrity|etag)", "Used for checksum/integrity, not security"),
}
# Words of tests and examples, and marks of comments.
TEST_WORDS, COMMENT_MARKS = r"(?i)(test|example|demo|sample|mock|fake|dummy)", r"(//|#|/\*|\"\"\"|'')"
# Words that speak of cleaning, of prepared statements, of bounds checks and of security.
CLEANERS = r"(?i)(escape|sanitize|encode|clean|filter|validate)"
PREPARED = r"(?i)(prepare|parameterized|\?|:\w+|\$\d+)"
BOUNDS_CHECK = r"(?i)(if|assert|check|validate|verify).*\b(len|length|size|bound)"
SECURITY_WORDS = r"(?i)(password|secret|key|token|auth|crypt|secure)"


@dataclass(frozen=True)
class Pattern:
    """A rule of the matcher; ``semantic`` are literal words that custom rules may add."""

    name: str
    vuln_class: str
    regexes: tuple[str, ...]
    severity: float
    weight: float
    cwes: tuple[str, ...]
    languages: tuple[str, ...]
    requires: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    semantic: tuple[str, ...] = field(default=())


def custom_pattern(name: str, regex: str, vuln_class: str, severity: float = 0.7, cwes: tuple[str, ...] = (), languages: tuple[str, ...] = ()) -> Pattern:
    """A rule of one regex; by default for the eight common languages."""
    return Pattern(name, vuln_class, (regex,), severity, 0.8, cwes, languages or ("python", "javascript", "java", "c", "cpp", "php", "go", "ruby"))


_WEB = ("python", "javascript", "java", "php", "go", "ruby")
# The built-in rules.
PATTERNS = [
    Pattern("SQL Injection - String Concatenation", "INJECTION", (r"(?i)(select|insert|update|delete|drop)\s+.*\+\s*\w+", r"(?i)\".*\s+(select|insert|update|delete).*\"\s*\+", r"(?i)f\".*\{.*\}.*(?:select|insert|update|delete)", r"(?i)\$\".*\{.*\}.*(?:select|insert|update|delete)"), 0.9, 0.95, ("CWE-89", "CWE-564"), ("python", "javascript", "java", "php", "csharp", "go", "ruby")),
    Pattern("SQL Injection - Format String", "INJECTION", (r"(?i)\.format\s*\([^)]*\).*(?:select|insert|update|delete)", r"(?i)sprintf\s*\([^)]*(?:select|insert|update|delete)", r"(?i)%s.*(?:select|insert|update|delete)"), 0.85, 0.9, ("CWE-89",), ("python", "php", "c", "cpp")),
    Pattern("Command Injection - System Call", "CODE_EXECUTION", (r"(?i)system\s*\([^)]*\+", r"(?i)exec\s*\([^)]*\+", r"(?i)popen\s*\([^)]*\+", r"(?i)subprocess\.(?:call|run|Popen)\s*\([^)]*shell\s*=\s*True", r"(?i)os\.system\s*\([^)]*\+"), 0.95, 0.98, ("CWE-78", "CWE-77"), ("python", "php", "ruby", "c", "cpp", "java")),
    Pattern("Command Injection - Backticks", "CODE_EXECUTION", (r"`[^`]*\$", r"(?i)shell_exec\s*\(", r"(?i)`\s*\+"), 0.9, 0.95, ("CWE-78",), ("php", "ruby", "perl", "shell")),
    Pattern("XSS - innerHTML Assignment", "XSS", (r"(?i)\.innerHTML\s*=\s*[^;]*\+", r"(?i)\.innerHTML\s*=\s*`[^`]*\$\{", r"(?i)\.innerHTML\s*=\s*[^;]*(?:request|params|query|input)"), 0.85, 0.9, ("CWE-79",), ("javascript", "typescript")),
    Pattern("XSS - document.write", "XSS", (r"(?i)document\.write\s*\([^)]*\+", r"(?i)document\.write\s*\([^)]*(?:location|cookie|referrer)"), 0.9, 0.92, ("CWE-79",), ("javascript", "typescript")),
    Pattern("XSS - Template Without Escaping", "XSS", (r"\{\{\s*\w+\s*\}\}", r"\{\%\s*autoescape\s+false", r"(?i)render_template_string\s*\(", r"\|\s*safe\s*\}\}"), 0.7, 0.8, ("CWE-79",), ("python", "javascript", "ruby", "php")),
    Pattern("Buffer Overflow - strcpy", "BUFFER_OVERFLOW", (r"\bstrcpy\s*\(", r"\bstrcat\s*\(", r"\bsprintf\s*\("), 0.8, 0.85, ("CWE-120", "CWE-119"), ("c", "cpp"), excludes=("uses_strncpy",)),
    Pattern("Buffer Overflow - gets", "BUFFER_OVERFLOW", (r"\bgets\s*\(",), 1.0, 1.0, ("CWE-120", "CWE-242"), ("c", "cpp")),
    Pattern("Buffer Overflow - Unchecked Array Access", "BUFFER_OVERFLOW", (r"\w+\s*\[\s*\w+\s*\]\s*=", r"\*\s*\(\s*\w+\s*\+\s*\w+\s*\)"), 0.6, 0.7, ("CWE-119", "CWE-787"), ("c", "cpp"), requires=("has_bounds_check",)),
    Pattern("Insecure Deserialization - Pickle", "DESERIALIZATION", (r"(?i)pickle\.loads?\s*\(", r"(?i)cPickle\.loads?\s*\(", r"(?i)_pickle\.loads?\s*\("), 0.9, 0.95, ("CWE-502",), ("python",)),
    Pattern("Insecure Deserialization - YAML", "DESERIALIZATION", (r"(?i)yaml\.load\s*\([^)]*\)", r"(?i)yaml\.unsafe_load\s*\("), 0.85, 0.9, ("CWE-502",), ("python", "ruby"), excludes=("uses_safe_load",)),
    Pattern("Insecure Deserialization - PHP unserialize", "DESERIALIZATION", (r"(?i)unserialize\s*\(\s*\$", r"(?i)maybe_unserialize\s*\("), 0.9, 0.92, ("CWE-502",), ("php",)),
    Pattern("Insecure Deserialization - Java ObjectInputStream", "DESERIALIZATION", (r"(?i)ObjectInputStream\s*\(", r"(?i)\.readObject\s*\(\s*\)", r"(?i)XMLDecoder\s*\("), 0.85, 0.9, ("CWE-502",), ("java",)),
    Pattern("Path Traversal - Direct Concatenation", "PATH_TRAVERSAL", (r"(?i)open\s*\([^)]*\+", r"(?i)fopen\s*\([^)]*\+", r"(?i)file_get_contents\s*\([^)]*\+", r"(?i)readFile\s*\([^)]*\+", r"(?i)os\.path\.join\s*\([^)]*(?:request|params|input)"), 0.8, 0.85, ("CWE-22", "CWE-73"), ("python", "javascript", "php", "java", "ruby", "go")),
    Pattern("Path Traversal - Include/Require", "PATH_TRAVERSAL", (r"(?i)include\s*\(\s*\$", r"(?i)include_once\s*\(\s*\$", r"(?i)require\s*\(\s*\$", r"(?i)require_once\s*\(\s*\$"), 0.95, 0.98, ("CWE-22", "CWE-98"), ("php",)),
    Pattern("Hardcoded Credentials", "AUTHENTICATION_BYPASS", (r"(?i)password\s*=\s*['\"][^'\"]+['\"]", r"(?i)api_key\s*=\s*['\"][^'\"]+['\"]", r"(?i)secret\s*=\s*['\"][^'\"]+['\"]", r"(?i)token\s*=\s*['\"][A-Za-z0-9+/=]{20,}['\"]"), 0.7, 0.8, ("CWE-798", "CWE-259"), ("python", "javascript", "java", "php", "go", "ruby", "csharp"), excludes=("is_config_file",)),
    Pattern("Weak Password Comparison", "AUTHENTICATION_BYPASS", (r"(?i)password\s*==\s*", r"(?i)\.equals\s*\(\s*password", r"(?i)strcmp\s*\([^)]*password"), 0.6, 0.7, ("CWE-208",), ("python", "javascript", "java", "php", "c", "cpp"), excludes=("uses_constant_time",)),
    Pattern("Weak Cryptographic Algorithm - MD5", "CRYPTO_WEAKNESS", (r"(?i)\bmd5\s*\(", r"(?i)hashlib\.md5", r"(?i)MessageDigest\.getInstance\s*\(\s*['\"]MD5", r"(?i)crypto\.createHash\s*\(\s*['\"]md5"), 0.7, 0.8, ("CWE-327", "CWE-328"), _WEB, excludes=("is_checksum",)),
    Pattern("Weak Cryptographic Algorithm - SHA1", "CRYPTO_WEAKNESS", (r"(?i)\bsha1\s*\(", r"(?i)hashlib\.sha1", r"(?i)MessageDigest\.getInstance\s*\(\s*['\"]SHA-?1", r"(?i)crypto\.createHash\s*\(\s*['\"]sha1"), 0.6, 0.7, ("CWE-327", "CWE-328"), _WEB, excludes=("is_checksum",)),
    Pattern("Weak Random Number Generator", "CRYPTO_WEAKNESS", (r"(?i)\brandom\s*\(", r"(?i)Math\.random\s*\(", r"(?i)rand\s*\(", r"(?i)java\.util\.Random"), 0.5, 0.6, ("CWE-330", "CWE-338"), ("python", "javascript", "java", "php", "c", "cpp"), requires=("in_security_context",)),
]
# Classes that are critical.
CRITICAL_CLASSES = ["CODE_EXECUTION", "INJECTION", "BUFFER_OVERFLOW", "DESERIALIZATION"]

# Words and regexes that a code vector counts, in their order.
VECTOR_WORDS = """
    if else for while return function def class public private static const var let int string try catch throw new delete import export from
    true false null none nil void async await eval exec system query execute read write open password secret key token auth user admin root
    http https url request response socket connect file path directory buffer memory pointer malloc
""".split()
VECTOR_REGEXES = [
    r"(?i)password", r"(?i)secret", r"(?i)key", r"(?i)token", r"(?i)eval", r"(?i)exec", r"(?i)system", r"(?i)query", r"(?i)sql", r"(?i)injection", r"(?i)xss", r"(?i)csrf",
    r"\$_", r"request\.", r"\.query", r"\.execute", r"strcpy", r"sprintf", r"gets", r"malloc", r"free", r"delete", r"new\s+", r"unsafe",
    r"admin", r"root", r"sudo", r"chmod", r"http://", r"https://", r"ftp://", r"file://",
]

# Classes that an unusual feature (numbered from 1) speaks for.
FEATURE_CLASSES = {
    5: ["INJECTION", "XSS"], 6: ["INJECTION", "XSS"], 12: ["INJECTION", "XSS"], 8: ["BUFFER_OVERFLOW", "USE_AFTER_FREE"], 14: ["BUFFER_OVERFLOW", "USE_AFTER_FREE"],
    7: ["CRYPTO_WEAKNESS"], 9: ["PATH_TRAVERSAL"], 10: ["SSRF"], 11: ["CODE_EXECUTION", "DESERIALIZATION"],
}

# Conditions that limit a loop, with the variable that they limit.
BOUNDED = [r"(\w+)\s*<\s*\w+", r"(\w+)\s*<=\s*\w+", r"(\w+)\s*in\s+range", r"(\w+)\s*:=\s*range"]


def patterns_of(vuln_class: str | None = None, language: str | None = None, cwe: str | None = None, patterns: list[Pattern] | None = None) -> list[Pattern]:
    """The rules of a class, a language, a CWE, or of all that are given."""
    return [p for p in (PATTERNS if patterns is None else patterns) if vuln_class in (None, p.vuln_class) and (language is None or language in p.languages) and (cwe is None or cwe in p.cwes)]


def save_patterns(path: str, patterns: list[Pattern], spark=None) -> None:
    """Write rules as JSON, one for each line; with a session, as a text table in any file system that Spark knows."""
    write_lines([json.dumps(asdict(p), ensure_ascii=False) for p in patterns], path, spark)


def load_patterns(path: str | None = None, spark=None) -> list[Pattern]:
    """The rules that ``save_patterns`` wrote, or the built-in ones where there is no path or nothing at it."""
    found = read_lines(path, spark) if path is not None else None
    if found is None:
        return list(PATTERNS)
    return [Pattern(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(x).items()}) for x in found if x.strip()]


def update_patterns(known: list[Pattern], new: list[Pattern]) -> list[Pattern]:
    """The known rules with the new ones; of one name, the new one."""
    return list(({p.name: p for p in known} | {p.name: p for p in new}).values())

# Words whose places an embedding notes.
SENSITIVE = {"password", "secret", "key", "token", "auth", "eval", "exec", "system", "query", "sql"}

# Type definitions and their fields, and words of methods that make a type dangerous.
TYPES = {
    "python": (r"class\s+(\w+)", r"self\.(\w+)\s*="),
    "javascript": (r"class\s+(\w+)", r"this\.(\w+)\s*="),
    "java": (r"class\s+(\w+)", r"(?:private|public|protected)\s+\w+\s+(\w+)\s*[;=]"),
    "c": (r"struct\s+(\w+)", r"(\w+)\s+\w+\s*;"),
    "go": (r"type\s+(\w+)\s+struct", r"(\w+)\s+\w+"),
    "*": (r"class\s+(\w+)", r"(\w+)"),
}
DANGEROUS_METHODS = ["exec", "eval", "system", "query", "deserialize", "unserialize", "load", "parse", "execute"]

# The kinds of tokens that are embedded, tried in this order.
TOKEN_PIECES = [
    r"[a-zA-Z_][a-zA-Z0-9_]*",
    r"0[xX][0-9a-fA-F]+",
    r"\d+\.?\d*",
    r"\"[^\"]*\"",
    r"'[^']*'",
    r"[+\-*/%=<>!&|^~]+",
    r"[\[\]{}();,.:]+",
]

# Tokens of the default vocabulary: special ones, keywords, security words, operators and delimiters.
DEFAULT_VOCAB = """
    <PAD> <UNK> <BOS> <EOS>
    if else elif for while do switch case return break continue try catch throw finally
    function def fn func class struct interface public private protected static const var let
    import export from require include using new delete this self super null nil None
    true false True False void int string bool async await yield lambda with as in is
    password secret key token auth login session user admin root sudo credential certificate
    encrypt decrypt hash sign verify salt iv sql query execute prepare cursor database
    eval exec system shell command process input output read write open close file
    request response http https url socket connect buffer memory malloc free pointer array
    sanitize escape encode decode validate filter injection xss csrf ssrf overflow traversal
    + - * / % = == != < > <= >= && || ! & | ^ ~ << >> += -= *= /= ++ -- . , ; : ( ) [ ] { } -> => :: ...
""".split()
