"""Values that results depend on: word lists, lookup tables, limits, patterns and message texts.

Everything in this module is a fixed value. Changing one changes query results.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Corpus scan: ignored names, languages, manifests, framework markers
# ---------------------------------------------------------------------------
# fixed values
IGNORED_NAMES = (
    "node_modules", ".git", "dist", "build", "out", "target", "__pycache__", ".venv", "venv",
    ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".coverage", "coverage", ".next",
    ".nuxt", ".svelte-kit", ".cache", ".idea", ".vscode", "site-packages", ".eggs", "htmlcov",
    ".gradle",
)
LOCK_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "Gemfile.lock",
    "composer.lock", "Cargo.lock",
)
# Ignored directory names differ per analyser.
IGNORED_BY_TOOL = {
    "dup": (
        "node_modules", "dist", "build", "target", ".git", ".venv", "venv", "coverage", ".next",
        ".nuxt", ".svelte-kit", "tests", "test", "__pycache__",
    ),
    "ts-morph": (
        "node_modules", "dist", "build", "target", ".git", ".venv", "venv", "coverage", ".next",
        ".nuxt", ".svelte-kit",
    ),
    "radon": ("tests", "test", ".git", "node_modules", "dist", "build"),
}
# extension -> (language, label)
LANGUAGES = {
    ".py": ("python", "Python"),
    ".pyi": ("python", "Python"),
    ".js": ("javascript", "JavaScript"),
    ".jsx": ("javascript", "JavaScript"),
    ".mjs": ("javascript", "JavaScript"),
    ".cjs": ("javascript", "JavaScript"),
    ".ts": ("typescript", "TypeScript"),
    ".tsx": ("typescript", "TypeScript"),
    ".html": ("html", "HTML"),
    ".css": ("css", "CSS"),
    ".json": ("json", "JSON"),
    ".md": ("markdown", "Markdown"),
}
SUPPORTED_LANGUAGES = ("python", "javascript", "typescript")
MANIFESTS = {
    "package.json": "npm",
    "pyproject.toml": "pyproject",
    "setup.py": "setuptools",
    "setup.cfg": "setuptools",
    "requirements.txt": "pip-requirements",
    "Pipfile": "pipenv",
    "go.mod": "go",
    "Cargo.toml": "cargo",
    "Gemfile": "bundler",
    "pom.xml": "maven",
    "build.gradle": "gradle",
}
FRAMEWORKS = {
    "fastapi": "FastAPI",
    "flask": "Flask",
    "django": "Django",
    "tornado": "Tornado",
    "express": "Express",
    "react": "React",
    "next": "Next.js",
    "vue": "Vue",
    "svelte": "Svelte",
}

# ---------------------------------------------------------------------------
# Intake limits and messages
# ---------------------------------------------------------------------------
# fixed values
MAX_ZIP_MB = 50
MAX_EXPANDED_MB = 200
MAX_REPO_MB = 300
MAX_FILE_MB = 10
MAX_FILE_COUNT = 20_000
MAX_ZIP_RATIO = 100
OWNER_REPO_PATTERN = r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"
UNSAFE_NAME_PATTERN = r"[^A-Za-z0-9_.-]+"
URL_NOT_SUPPORTED = "Only GitHub repository URLs are supported (github.com/owner/repo)"
URL_TOO_SHORT = "GitHub URL must look like https://github.com/owner/repo"
URL_BAD_NAME = "Invalid GitHub owner/repo in URL"
NOT_A_ZIP = "Uploaded file is not a valid ZIP archive"
BAD_JSON = "Tool output was not valid JSON"
ODD_SHAPE = "Tool output has another shape than expected"
NO_PARSER = "Tool output has no parser"

# ---------------------------------------------------------------------------
# Python rules
# ---------------------------------------------------------------------------
# fixed values
PY_SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "MERGE", "UNION")
PY_SECRET_NAME = (
    r"\b(password|passwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key"
    r"|client[_-]?secret|aws[_-]?secret)\b"
)
PY_SECRET_VALUE = r"^(secret|token|key|password|passwd)(\W|$)"
# dotted name -> (type, category, confidence)
CALL_SINKS = {
    "eval": ("DANGEROUS_EVAL", "SECURITY", 0.75),
    "exec": ("DANGEROUS_EVAL", "SECURITY", 0.75),
    "pickle.loads": ("DANGEROUS_DESERIALIZATION", "SECURITY", 0.9),
    "pickle.load": ("DANGEROUS_DESERIALIZATION", "SECURITY", 0.9),
    "cPickle.loads": ("DANGEROUS_DESERIALIZATION", "SECURITY", 0.9),
    "yaml.load": ("DANGEROUS_DESERIALIZATION", "SECURITY", 0.8),
    "os.system": ("UNSAFE_SUBPROCESS", "SECURITY", 0.8),
    "os.popen": ("UNSAFE_SUBPROCESS", "SECURITY", 0.8),
    "subprocess.Popen": ("UNSAFE_SUBPROCESS", "SECURITY", 0.6),
    "hashlib.md5": ("WEAK_HASH", "SECURITY", 0.5),
    "hashlib.sha1": ("WEAK_HASH", "SECURITY", 0.5),
}
SHELL_CALLS = (
    "subprocess.run", "subprocess.call", "subprocess.check_call", "subprocess.check_output",
)
# rule -> (type, category, confidence, message)
PY_RULES = {
    "SQL_STRING_CONCAT": (
        "SQL_INJECTION", "SECURITY", 0.85,
        "A query-looking string is built with concatenation or f-strings. If any part comes from "
        "user input, this is a SQL injection sink. Parameterized queries are required.",
    ),
    "SQL_FSTRING": (
        "SQL_INJECTION", "SECURITY", 0.8,
        "An f-string interpolates values into a SQL query. Interpolated user input would be a "
        "SQL injection; use parameterized queries.",
    ),
    "UNSAFE_SUBPROCESS_SHELL": (
        "UNSAFE_SUBPROCESS", "SECURITY", 0.8,
        "subprocess invoked with shell=True. If arguments contain user input, shell metacharacters "
        "can be injected; prefer argument lists without a shell.",
    ),
    "NONE_COMPARISON": (
        "NONE_COMPARISON", "CORRECTNESS", 0.7,
        "Comparing with '==' (or '!=') to None instead of 'is'/'is not None'. This usually works "
        "but violates Python convention and can mask custom __eq__ behavior.",
    ),
    "CONSTANT_CONDITION": (
        "CONSTANT_CONDITION", "CORRECTNESS", 0.9,
        "Condition is a constant, so a branch is always taken. Likely leftover debug code or a bug.",
    ),
    "SELF_COMPARISON": (
        "SELF_COMPARISON", "CORRECTNESS", 0.95,
        "Expression compared with itself; the condition is always False (or True).",
    ),
    "UNREACHABLE_CODE": (
        "UNREACHABLE_CODE", "CODE_SMELL", 0.95,
        "Code after a return/raise/break/continue can never execute.",
    ),
    "EMPTY_EXCEPT": (
        "EMPTY_EXCEPT", "CODE_SMELL", 0.7,
        "Exception handler swallows errors silently. In production this hides failures; consider "
        "logging the exception or narrowing the clause.",
    ),
    "BROAD_EXCEPT": (
        "BROAD_EXCEPT", "CODE_SMELL", 0.5,
        "Bare 'except:' catches everything including KeyboardInterrupt/SystemExit, and swallows "
        "the exception object, making debugging harder.",
    ),
    "UNUSED_IMPORT": (
        "UNUSED_IMPORT", "CODE_SMELL", 0.6,
        "Imported name is never referenced in this module. May be re-exported intentionally "
        "(check for __all__ / package exports).",
    ),
    "UNUSED_VARIABLE": (
        "UNUSED_VARIABLE", "CODE_SMELL", 0.55,
        "Local variable assigned but never read. Could be dead code or a sign of missing logic. "
        "Underscore-prefixed names and loop targets are intentionally skipped.",
    ),
    "ASSERT_VALIDATION": (
        "ASSERT_VALIDATION", "CORRECTNESS", 0.55,
        "assert used for input validation. Asserts are stripped under python -O, so validation "
        "silently disappears in optimized deployments.",
    ),
    "HARDCODED_SECRET": (
        "HARDCODED_SECRET", "SECURITY", 0.65,
        "A value that looks like a credential is assigned to a secret-named variable or passed "
        "as a literal. Real secrets belong in environment variables/secret storage.",
    ),
    "REDUNDANT_ELSE": (
        "REDUNDANT_ELSE", "CODE_SMELL", 0.7,
        "An else branch follows a block that always returns/raises; the else is redundant.",
    ),
}
SINK_MESSAGE = "Call to %s can be a dangerous sink when input is not trusted."
SHELL_TRUE_RULE = "UNSAFE_SUBPROCESS_SHELL"

# ---------------------------------------------------------------------------
# Duplicate functions
# ---------------------------------------------------------------------------
# fixed values
SHAPE_SKIPPED_KINDS = ("Name", "Constant", "Load", "Store", "Del", "arg", "arguments")
SHAPE_MIN_TOKENS = 8
DUP_MEMBERS_PER_GROUP = 4
DUP_GROUPS_PER_REPO = 100
DUP_CONFIDENCE = 0.6
DUP_DESCRIPTION = "normalized AST shape fingerprint"
DUP_MESSAGE = (
    "Function '%s' has the same body shape as %s other location(s): %s. "
    "Likely copy-pasted code; consider extracting a shared helper."
)

# ---------------------------------------------------------------------------
# JavaScript / TypeScript rules
# ---------------------------------------------------------------------------
# fixed values
JS_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
JS_RESOLVE_SUFFIXES = (
    "", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js",
)
JS_SQL_PATTERN = r"\b(select|insert|update|delete|drop|alter|union|where|from)\b"
JS_SECRET_NAME = r"secret|key|token|password|passwd|api"
JS_SECRET_PREFIX = r"^(sk-|pk-|ghp_|AKIA|eyJ)"
JS_SECRET_PLACEHOLDER = r"example|placeholder|your|changeme"
JS_SECRET_MIN_LENGTH = 16
JS_COMPLEXITY_LIMIT = 15
JS_SNIPPET_CHARS = 800
# rule -> (type, category, confidence, message, detail)
JS_RULES = {
    "HIGH_COMPLEXITY": (
        "HIGH_COMPLEXITY", "CODE_SMELL", 0.7,
        "Function '%s' has approximate cyclomatic complexity %s (threshold 15).",
        "estimated cc=%s",
    ),
    "UNUSED_FUNCTION_VALUE": (
        "UNUSED_FUNCTION", "CODE_SMELL", 0.5,
        "Function '%s' is never referenced anywhere in the repository. May be dead code or an "
        "entry point (check framework registration).",
        "dynamic use (frameworks, decorators, routes) cannot be proven statically",
    ),
    "UNUSED_FUNCTION": (
        "UNUSED_FUNCTION", "CODE_SMELL", 0.5,
        "Function '%s' is never referenced. May be dead code or an entry point (check framework "
        "registration).",
        "dynamic use (frameworks, decorators, routes) cannot be proven statically",
    ),
    "UNUSED_CLASS": (
        "UNUSED_CLASS", "CODE_SMELL", 0.5,
        "Class '%s' is never referenced. May be dead code or framework-registered.",
        "dynamic use (frameworks, decorators, routes) cannot be proven statically",
    ),
    "SQL_INJECTION": (
        "SQL_INJECTION", "SECURITY", 0.85,
        "SQL query built by string concatenation; untrusted input may alter query semantics.",
        "concat-based query construction",
    ),
    "UNSAFE_INNER_HTML": (
        "UNSAFE_INNER_HTML", "SECURITY", 0.8,
        "Assigning to innerHTML with interpolated content can enable DOM-based XSS.",
        "innerHTML assignment",
    ),
    "NONE_COMPARISON": (
        "NONE_COMPARISON", "CORRECTNESS", 0.5,
        "Comparing against null/undefined; prefer optional chaining or explicit guard.",
        "compared with %s",
    ),
    "SELF_COMPARISON": (
        "SELF_COMPARISON", "CORRECTNESS", 0.9,
        "Expression compares %s to itself; likely a copy-paste error.",
        "self comparison",
    ),
    "DANGEROUS_EVAL": (
        "DANGEROUS_EVAL", "SECURITY", 0.9,
        "eval() executes arbitrary code; avoid when input is not fully trusted.",
        "eval call",
    ),
    "DANGEROUS_FUNCTION": (
        "DANGEROUS_FUNCTION", "SECURITY", 0.8,
        "Dynamic Function() constructor is eval-like code execution.",
        "Function constructor",
    ),
    "HARDCODED_SECRET": (
        "HARDCODED_SECRET", "SECURITY", 0.85,
        "Potential hardcoded credential assigned to '%s'.",
        "secret literal",
    ),
}

# ---------------------------------------------------------------------------
# Reports of external analysers
# ---------------------------------------------------------------------------
# fixed values
BANDIT_CONFIDENCE = {"UNDEFINED": 0.5, "LOW": 0.35, "MEDIUM": 0.6, "HIGH": 0.9}
BANDIT_CODE_CHARS = 2000
RUFF_CATEGORY = {
    "F": "CORRECTNESS", "E": "STYLE", "W": "STYLE", "B": "CORRECTNESS", "S": "SECURITY",
    "A": "CODE_SMELL", "I": "STYLE", "N": "STYLE", "C": "CODE_SMELL", "D": "STYLE",
    "T": "CORRECTNESS",
}
ESLINT_CATEGORY = {
    "no-eval": "SECURITY",
    "no-implied-eval": "SECURITY",
    "no-new-func": "SECURITY",
    "no-prototype-builtins": "SECURITY",
    "no-debugger": "CODE_SMELL",
    "no-unreachable": "CORRECTNESS",
    "no-constant-condition": "CORRECTNESS",
    "no-self-compare": "CORRECTNESS",
    "no-dupe-keys": "CORRECTNESS",
    "no-duplicate-case": "CORRECTNESS",
    "no-fallthrough": "CORRECTNESS",
    "no-redeclare": "CORRECTNESS",
    "no-func-assign": "CORRECTNESS",
    "no-import-assign": "CORRECTNESS",
    "no-cond-assign": "CORRECTNESS",
    "no-unused-vars": "CODE_SMELL",
    "no-empty": "CODE_SMELL",
}
RADON_LIMIT = 15
RADON_MESSAGE = (
    "Function with cyclomatic complexity %s — exceeds recommended threshold of 15. "
    "High complexity correlates with defect density and reduced testability."
)

# ---------------------------------------------------------------------------
# Merging, scoring, run ledger
# ---------------------------------------------------------------------------
# fixed values
SOURCE_ORDER = ("ast-custom", "bandit", "ruff", "radon", "dup", "ts-morph", "eslint")
SOURCE_CAPS = {
    "bandit": 500, "ruff": 500, "radon": 200, "dup": 100, "ts-morph": 500, "eslint": 500,
}
RULE_DELTAS = {
    "SQL_INJECTION": 0.25,
    "DANGEROUS_DESERIALIZATION": 0.25,
    "DANGEROUS_EVAL": 0.25,
    "DANGEROUS_FUNCTION": 0.2,
    "HARDCODED_SECRET": 0.25,
    "UNSAFE_INNER_HTML": 0.2,
    "UNSAFE_SUBPROCESS": 0.2,
    "SELF_COMPARISON": 0.3,
    "ASSERT_VALIDATION": 0.05,
    "NONE_COMPARISON": 0.05,
    "UNUSED_VARIABLE": -0.15,
    "UNUSED_FUNCTION": -0.1,
    "UNUSED_CLASS": -0.1,
}
CATEGORY_DELTAS = {"SECURITY": 0.1, "CORRECTNESS": 0.05, "PERFORMANCE": -0.05, "CODE_SMELL": -0.05}
COMPLEXITY_BOOSTS = ((10.0, 0.03), (5.0, 0.015))
SCORE_FLOOR, SCORE_CEILING = 0.05, 0.98
SEVERITY_BANDS = ((0.8, "critical"), (0.65, "high"), (0.45, "medium"), (0.25, "low"))
LOWEST_SEVERITY = "info"
MODEL_VERSION = "heuristic-v1"
TRIAGE_STATUSES = ("open", "confirmed", "false_positive", "overridden")
HIGH_CONFIDENCE = 0.8
RUN_STAGES = (("ingest", 0), ("profile", 25), ("analyze", 50), ("predict", 75), ("finalize", 100))
ERROR_CHARS = 3000
TOP_FILES = 500
PAGE_SIZE = 100
