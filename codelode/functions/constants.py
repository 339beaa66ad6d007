"""Lists, tables and patterns that results depend on."""

# Directories a scan does not enter.
IGNORED_DIRECTORIES = [
    ".git", ".svn", ".hg", "node_modules", ".next", "dist", "build", "out", "coverage", "__pycache__", ".pytest_cache", ".venv", "venv", "env",
    "target", "vendor", ".gradle", ".mvn", "bin", "obj", ".nuget", "packages", ".idea", ".vscode", ".vs", ".cache", ".tmp", "tmp", "temp",
]
# Extensions of binary files.
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".tiff", ".tif", ".mp3", ".wav", ".flac", ".aac", ".ogg", ".m4a", ".wma",
    ".mp4", ".avi", ".mov", ".wmv", ".flv", ".mkv", ".webm", ".m4v", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".xz", ".tgz", ".exe", ".dll",
    ".so", ".dylib", ".bin", ".app", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".db",
    ".sqlite", ".sqlite3", ".pyc", ".pyo", ".class", ".o", ".a", ".lib",
]
# Files that hold secrets.
SENSITIVE_FILES = [
    ".env", ".env.local", ".env.development", ".env.production", ".env.test", "secrets.json", "credentials.json", ".npmrc", ".pypirc",
]
# Language of an extension.
LANGUAGES = {
    ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".html": "HTML", ".htm": "HTML", ".css": "CSS",
    ".scss": "SCSS", ".sass": "Sass", ".less": "Less", ".vue": "Vue", ".py": "Python", ".pyx": "Cython", ".pyi": "Python", ".java": "Java",
    ".kt": "Kotlin", ".kts": "Kotlin", ".scala": "Scala", ".groovy": "Groovy", ".c": "C", ".h": "C", ".cpp": "C++", ".cc": "C++", ".cxx": "C++",
    ".hpp": "C++", ".hh": "C++", ".hxx": "C++", ".cs": "C#", ".rs": "Rust", ".go": "Go", ".rb": "Ruby", ".rake": "Ruby", ".php": "PHP",
    ".swift": "Swift", ".sh": "Shell", ".bash": "Bash", ".zsh": "Zsh", ".fish": "Fish", ".r": "R", ".sql": "SQL", ".json": "JSON",
    ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".xml": "XML", ".ini": "INI", ".cfg": "Config", ".conf": "Config", ".md": "Markdown",
    ".markdown": "Markdown", ".rst": "reStructuredText", ".txt": "Text", ".lua": "Lua", ".pl": "Perl", ".pm": "Perl", ".dart": "Dart",
    ".ex": "Elixir", ".exs": "Elixir", ".erl": "Erlang", ".hrl": "Erlang", ".clj": "Clojure", ".cljs": "ClojureScript", ".jl": "Julia",
    ".m": "Objective-C", ".mm": "Objective-C++",
}
# What makes a path that of a test, for change detection and for test detection.
CHANGE_TEST_DIRS = [
    "test", "tests", "__tests__", "spec", "specs", "test_", "e2e", "integration",
]
CHANGE_TEST_NAMES = ["test_", "_test", ".test.", ".spec.", "_spec"]
TEST_DIRS = [*CHANGE_TEST_DIRS, "unit"]
TEST_NAMES = [*CHANGE_TEST_NAMES, "test.", "spec."]
TEST_FUNCTIONS = ["test_", "test", "should_", "it_", "describe_", "spec_", "example_"]
# Root modules by which a test framework is known, in order.
FRAMEWORKS = {
    "pytest": ["pytest", "_pytest"], "unittest": ["unittest"], "jest": ["jest", "@jest"], "mocha": ["mocha"], "vitest": ["vitest"],
    "junit": ["junit", "org.junit"], "testng": ["testng", "org.testng"], "rspec": ["rspec"], "go_test": ["testing"],
}
DEFAULT_FRAMEWORKS = {"Python": "pytest", "JavaScript": "jest", "TypeScript": "jest", "Java": "junit", "Go": "go_test", "Rust": "cargo_test"}
# Substrings of paths.
SECURITY_PATHS = [
    "auth", "login", "password", "token", "jwt", "oauth", "security", "permission", "role", "access", "credential", "encrypt", "decrypt", "hash",
    "crypto", "session",
]
DATABASE_PATHS = [
    "model", "schema", "migration", "database", "db", "query", "repository", "dao", "entity", "orm", "alembic", "sqlalchemy", "sequelize", "prisma",
]
PAYMENT_PATHS = [
    "payment", "billing", "invoice", "checkout", "cart", "stripe", "paypal", "transaction", "charge", "refund",
]
NON_SOURCE_PATHS = [
    ".md", ".txt", ".json", ".yaml", ".yml", ".toml", ".xml", ".ini", ".cfg", ".conf", "license", "readme", "dockerfile", ".dockerignore",
    ".gitignore",
]
SOURCE_LANGUAGES = [
    "Python", "JavaScript", "TypeScript", "Java", "Go", "Rust", "C", "C++", "C#", "Ruby", "PHP", "Swift", "Kotlin",
]
# Patterns of failures, tried in this order.
FAILURE_PATTERNS = {
    "assertion": [r"AssertionError", r"assert\s+", r"assertEqual", r"assertNotEqual", r"assertTrue", r"assertFalse", r"expect\(.*\)\.to", r"Expected.*but got", r"expected.*actual"],
    "import_error": [r"ImportError", r"ModuleNotFoundError", r"Cannot find module", r"No module named", r"Failed to load module", r"import .* failed"],
    "setup_error": [r"setUp.*failed", r"tearDown.*failed", r"beforeEach.*failed", r"afterEach.*failed", r"beforeAll.*failed", r"afterAll.*failed", r"fixture.*failed", r"@pytest\.fixture"],
    "timeout": [r"TimeoutError", r"timeout", r"timed out", r"exceeded.*time", r"took too long"],
    "dependency_error": [r"DatabaseError", r"Connection.*refused", r"ECONNREFUSED", r"Cannot connect to", r"Service unavailable", r"Redis.*error", r"PostgreSQL.*error"],
    "network_error": [r"NetworkError", r"ConnectionError", r"RequestException", r"HTTP.*error", r"404.*Not Found", r"500.*Internal Server Error", r"ENOTFOUND", r"getaddrinfo.*failed"],
}
# Patterns of intents, in order of preference.
INTENT_PATTERNS = {
    "symbol_explanation": [r"\b(function|class|method|symbol)\b", r"\b(what does|explain|how does)\s+\w+\s+(work|do|function)", r"\b(implementation|defined|declared)\b"],
    "api_explanation": [r"\b(api|endpoint|route|handler)\b", r"\b(GET|POST|PUT|DELETE|PATCH)\s+/", r"\b(/api/|/v1/|/v2/)\b", r"\b(request|response|payload)\b"],
    "workflow_explanation": [r"\b(workflow|flow|process|execution)\b", r"\b(what happens|how does|sequence|pipeline)\b", r"\b(after|before|when|then)\b", r"\b(request flow|data flow|control flow)\b"],
    "dependency_question": [r"\b(depend|dependency|import|require)\b", r"\b(use|uses|used by|call|calls|called by)\b", r"\b(what calls|what uses|who calls)\b"],
    "impact_question": [r"\b(impact|affect|change|break|downstream)\b", r"\b(what (would )?break|what (would )?fail)\b", r"\b(if I change|if I modify|if I update)\b", r"\b(affected|impacted|broken)\b"],
    "history_question": [r"\b(history|commit|git|when|why)\b", r"\b(introduced|added|changed|modified|removed)\b", r"\b(who (wrote|created|added)|author)\b", r"\b(previous|original|old version)\b"],
    "architecture_question": [r"\b(architecture|structure|design|pattern)\b", r"\b(organized|structured|laid out)\b", r"\b(how is|how are|overall)\b", r"\b(repository|codebase|project)\b.*\b(structured|organized)\b"],
    "database_question": [r"\b(database|db|table|model|schema|query|orm)\b", r"\b(sql|postgres|mysql|mongodb)\b", r"\b(persist|store|save|retrieve)\b"],
}
# Short questions that point back to what was said before.
CONTEXT_DEPENDENCY = [r"\b(what calls|what uses|who uses|callers|users)\b", r"\b(calls it|uses it|depends on it)\b", r"\b(called by|used by)\b"]
CONTEXT_DETAIL = [r"\b(show|explain|describe|tell me about)\b", r"\b(that|this|it)\b", r"\b(more details|implementation)\b"]
# Commands that run tests, in order.
TEST_COMMANDS = [
    r"pytest\b", r"python\s+-m\s+pytest", r"python\s+-m\s+unittest", r"npm\s+test", r"npm\s+run\s+test", r"yarn\s+test", r"jest\b", r"vitest\b",
    r"go\s+test", r"cargo\s+test", r"mvn\s+test", r"gradle\s+test", r"rake\s+test", r"rspec\b", r"phpunit\b",
]
# Phrases of an answer without grounds.
INSUFFICIENT_PHRASES = ["cannot find", "no evidence", "not enough information", "insufficient evidence", "unclear from the evidence", "not present in the repository"]
# Secrets in texts and what replaces them, in order.
SECRET_PATTERNS = [
    (r"""(?i)(api[_-]?key|token|bearer)\s*[=:]\s*["']?([a-zA-Z0-9_\-]{20,})["']?""", "$1=***REDACTED***"),
    (r"redis://([^:]+):([^@]+)@", "redis://***:***@"),
    (r"postgresql(\+\w+)?://([^:]+):([^@]+)@", "postgresql$1://***:***@"),
    (r"""(?i)(authorization|auth)\s*:\s*["']?([^"']+)["']?""", "$1: ***REDACTED***"),
    (r"""(?i)(password|passwd|pwd)\s*[=:]\s*["']?([^"'&\s]+)["']?""", "$1=***REDACTED***"),
    (r"(?i)(AIzaSy[a-zA-Z0-9_\-]{33})", "***REDACTED_GEMINI_KEY***"),
    (r"(?i)(sk-[a-zA-Z0-9]{48})", "***REDACTED_OPENAI_KEY***"),
]
# Risk signals with their weight; a score of 86, 61 and 31 is critical, high and medium.
RISK_WEIGHTS = {
    "public_api_change": 25, "high_fanout_symbol": 20, "workflow_entry_affected": 15, "security_code_change": 20, "database_code_change": 15,
    "payment_code_change": 20, "many_files_changed": 10, "large_change_size": 10, "missing_test_changes": 15,
}
RISK_LEVELS = ((86, "critical"), (61, "high"), (31, "medium"))
# Suffixes tried for a relative import.
IMPORT_SUFFIXES = ["", ".js", ".ts", ".jsx", ".tsx", ".py", "/index.js", "/index.ts"]
