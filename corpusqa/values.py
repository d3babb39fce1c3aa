"""Rule packs, word lists, lookup maps and thresholds.

Everything here is data.  Each operator takes these as default arguments, so a
caller replaces a pack or a map without touching any code.  Patterns are kept in
Python regular-expression dialect; ``functions.patterns`` turns them into the
dialect Spark runs.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One pattern rule.

    ``pattern`` decides what is a hit.  ``fast`` is an equivalent pattern that
    Java runs in linear time where the plain form could backtrack for long; both
    must report the same lines; groups ``lead`` and
    ``hit`` part what stands before the match from it.  ``needles`` are literals of which at least one
    is in every hit, so that a plain substring search skips most documents.
    """

    name: str
    category: str
    severity: str
    description: str
    pattern: str
    languages: tuple[str, ...] = ("all",)
    needles: tuple[str, ...] = ()
    fast: str | None = None
    ignore_case: bool = False


CODE_SMELLS = "code_smells"
SECURITY = "security_issues"
PERFORMANCE = "performance_issues"
STYLE = "style_issues"
CATEGORIES = (CODE_SMELLS, SECURITY, PERFORMANCE, STYLE)

# ---------------------------------------------------------------- fixed values
# Rule names, severities, descriptions and patterns are fixed values.

PYTHON_RULES = (
    Rule("bare_except", CODE_SMELLS, "high", "Using bare except: statements",
         r"except\s*:", ("python",), ("except",)),
    Rule("import_star", CODE_SMELLS, "medium", "Using from module import *",
         r"from\s+\w+\s+import\s+\*", ("python",), ("import",)),
    Rule("mutable_default", CODE_SMELLS, "medium", "Using mutable default arguments",
         r"def\s+\w+\s*\([^)]*=\s*(?:\[\]|\{\}|\(\))", ("python",), ("def",),
         # Between two closing brackets there is at most one hit: from the first head on, if a default follows.
         fast=r"(?<![^)])(?<lead>(?>[^)]*?(?=def\s++\w++\s*+\()))(?<hit>def\s++\w++\s*+\("
              r"[^)=]*+(?:=(?!\s*+(?:\[\]|\{\}|\(\)))[^)=]*+)*+=\s*+(?:\[\]|\{\}|\(\)))"),
    Rule("eval_usage", CODE_SMELLS, "high", "Using eval() function",
         r"eval\s*\(", ("python",), ("eval",)),
)

JAVASCRIPT_RULES = (
    Rule("var_usage", CODE_SMELLS, "medium", "Using var instead of let/const",
         r"\bvar\s+", ("javascript", "typescript"), ("var",)),
    Rule("triple_equals", CODE_SMELLS, "medium", "Using == instead of ===",
         r"[^=!]==[^=]", ("javascript", "typescript"), ("==",)),
    Rule("eval_usage", CODE_SMELLS, "high", "Using eval() function",
         r"eval\s*\(", ("javascript", "typescript"), ("eval",)),
    Rule("with_statement", CODE_SMELLS, "high", "Using with statement",
         r"\bwith\s*\(", ("javascript", "typescript"), ("with",)),
)

SECURITY_RULES = (
    Rule("sql_injection", SECURITY, "critical", "Potential SQL Injection vulnerabilities",
         r".*(?:execute|query|run).*\+.*|.*(?:execute|query|run).*\$\{",
         ("python", "javascript", "php", "ruby"), ("execute", "query", "run"),
         # One hit per line: first keyword, then the first + or ${ after it.
         fast=r"(?md)^(?>[^\n]*?(?:execute|query|run))[^+$\n]*+(?:\$(?!\{)[^+$\n]*+)*+(?:\+|\$\{)"),
    Rule("xss", SECURITY, "critical", "Potential Cross-Site Scripting (XSS) vulnerabilities",
         r"innerHTML\s*=|document\.write\s*\(",
         ("javascript", "html"), ("innerHTML", "document.write")),
    Rule("eval_input", SECURITY, "critical",
         "Evaluating user input (can lead to code injection)",
         r"eval\s*\(.*(?:input|param|request|query|\$_GET|\$_POST)",
         ("python", "javascript", "php"), ("eval",)),
    Rule("hardcoded_credentials", SECURITY, "critical", "Hardcoded credentials or API keys",
         r"password\s*=\s*[\"'][^\"']+[\"']|api[_-]?key\s*=\s*[\"'][^\"']+[\"']",
         ("all",), ("password", "api")),
)

PERFORMANCE_RULES = (
    Rule("inefficient_loop", PERFORMANCE, "medium", "Inefficient loop patterns",
         r"for\s+\w+\s+in\s+range\s*\(\s*len\s*\(\s*\w+\s*\)\s*\)", ("python",), ("range",)),
    Rule("multiple_dom_access", PERFORMANCE, "medium",
         "Multiple DOM accesses that could be cached",
         r"document\.getElement(?:s)?By|\$\(\s*['\"]",
         ("javascript",), ("document.getElement", "$(")),
)

SIMPLE_CODE_RULES = (
    Rule("if_true", "simple_code", "low", "if True: condition - always executes",
         r"\bif\s+True\b", ignore_case=True),
    Rule("while_true", "simple_code", "low",
         "while True: loop - potentially infinite without break",
         r"\bwhile\s+True\b", ignore_case=True),
    Rule("self_assignment", "simple_code", "low", "Variable assigned to itself (e.g., x = x)",
         r"(\w+)\s*=\s*\1\b", needles=("=",), fast=r"(\w++)\s*+=\s*+\1\b", ignore_case=True),
    Rule("return_none", "simple_code", "low", "Explicitly returning None (often redundant)",
         r"return\s+None\b", ignore_case=True),
    Rule("self_comparison", "simple_code", "low",
         "Comparing a variable to itself (e.g., x == x)",
         r"\w+\s*==\s*\w+\b", needles=("==",), fast=r"(?<!\w)\w++\s*+==\s*+\w++",
         ignore_case=True),
)

ISSUE_RULES = PYTHON_RULES + JAVASCRIPT_RULES + SECURITY_RULES + PERFORMANCE_RULES

# Smells that are found by a scanner: name, severity, description.
DECLARED_SMELLS = (
    Rule("complex_conditional", CODE_SMELLS, "medium", "Overly complex conditional expressions", ""),
    Rule("magic_number", CODE_SMELLS, "low", "Magic numbers (hard-coded numeric literals)", ""),
    Rule("global_variable", CODE_SMELLS, "medium", "Excessive use of global variables", ""),
    Rule("empty_catch", CODE_SMELLS, "medium", "Empty catch blocks", ""),
)

LONG_LINE = ("long_line", STYLE, "low", "Line exceeds 100 characters")

KEYWORDS = (
    "rick", "morty", "schwifty", "wubba lubba dub dub", "get schwifty",
    "pickle rick", "plumbus", "meeseeks", "gazorpazorp", "squanch",
    "cronenberg", "birdperson", "unity", "jerry", "beth", "summer",
    "portal gun", "interdimensional", "council of ricks", "citadel",
    "tiny rick", "anatomy park", "blips and chitz",
)

WILDCARD_WORDS = ("f***", "s***", "a**", "b****", "c***", "d***", "hell", "damn")

TASK_MARKERS = ("TODO", "FIXME", "HACK", "XXX", "NOTE")

# Persona labels in the order their tests are made, with the score weight.
PERSONA_SIMPLE = "Simple Jerry"
PERSONA_CYNICAL = "Cynical Rick"
PERSONA_ANXIOUS = "Anxious Morty"
PERSONA_METHODICAL = "Methodical Beth"
PERSONA_OVERCONFIDENT = "Overconfident Summer"
PERSONA_NEUTRAL = "Chaotic Neutral"
PERSONA_WEIGHTS = {
    PERSONA_CYNICAL: 2,
    PERSONA_METHODICAL: 3,
    PERSONA_ANXIOUS: -1,
    PERSONA_SIMPLE: -5,
    PERSONA_OVERCONFIDENT: 1,
}

# Words and shapes that make a comment line look like code.
CODE_INDICATORS = (
    r"\bif\b", r"\bfor\b", r"\bwhile\b", r"\bdef\b", r"\bfunction\b",
    r"\breturn\b", r"\bclass\b", r"\{", r"\}", r"=", r"\(.*\)",
)

COARSE_LANGUAGES = {
    "Python": (".py", ".pyw"),
    "JavaScript": (".js", ".jsx", ".ts", ".tsx"),
    "Java": (".java",),
    "C/C++": (".c", ".cpp", ".h", ".hpp"),
    "C#": (".cs",),
    "Ruby": (".rb",),
    "PHP": (".php",),
    "Swift": (".swift",),
    "Go": (".go",),
    "Rust": (".rs",),
    "HTML": (".html", ".htm"),
    "CSS": (".css", ".scss", ".sass", ".less"),
    "SQL": (".sql",),
}

FINE_LANGUAGES = {
    "Python": (".py", ".pyw"),
    "JavaScript": (".js", ".jsx"),
    "TypeScript": (".ts", ".tsx"),
    "Java": (".java",),
    "C": (".c",),
    "C++": (".cpp", ".hpp"),
    "C/C++": (".h",),
    "C#": (".cs",),
    "Ruby": (".rb",),
    "PHP": (".php",),
    "Swift": (".swift",),
    "Go": (".go",),
    "Rust": (".rs",),
    "HTML": (".html", ".htm"),
    "CSS": (".css",),
    "SCSS": (".scss",),
    "SASS": (".sass",),
    "LESS": (".less",),
    "SQL": (".sql",),
}

IGNORED_DIRECTORIES = (
    ".git", ".svn", ".hg", "node_modules", "__pycache__",
    ".venv", "venv", "env", ".env", "build", "dist",
    ".idea", ".vscode", ".DS_Store",
)

BASIC_MARKERS = ("#", "//", "--", "%")

LINE_MARKERS = {
    "Python": ("#",),
    "JavaScript": ("//", "/*"),
    "Java": ("//", "/*"),
    "C": ("//", "/*"),
    "C++": ("//", "/*"),
    "C#": ("//", "/*"),
    "Ruby": ("#",),
    "PHP": ("//", "/*", "#"),
    "Swift": ("//", "/*"),
    "Go": ("//",),
    "Rust": ("//", "/*"),
}
DUPLICATE_MARKERS = {k: v for k, v in LINE_MARKERS.items() if k not in ("Swift", "Go", "Rust")}
DEFAULT_MARKERS = ("#", "//")
BLOCK_LANGUAGES = ("JavaScript", "Java", "C", "C++", "C#", "PHP", "Swift")
DUPLICATE_BLOCK_LANGUAGES = ("JavaScript", "Java", "C", "C++", "C#", "PHP")

STYLE_MARKERS = {
    "Python": "#", "JavaScript": "//", "Java": "//", "C++": "//", "C#": "//",
    "Ruby": "#", "PHP": "//",
}
DEFAULT_STYLE_MARKER = "#"

LOOP_WORDS = {
    "Python": ("for", "while"),
    "JavaScript": ("for", "while", "do"),
    "Java": ("for", "while", "do"),
    "C": ("for", "while", "do"),
    "C++": ("for", "while", "do"),
    "C#": ("for", "while", "do", "foreach"),
    "Ruby": ("for", "while", "until", "each"),
    "PHP": ("for", "while", "do", "foreach"),
}
DEFAULT_LOOP_WORDS = ("for", "while")

SEVERITY_HOURS = {"critical": 8, "high": 4, "medium": 2, "low": 1}
DEFAULT_HOURS = 2
SECURITY_FACTOR = 1.5
DUPLICATE_HOURS = 3
HOURS_PER_DAY = 8

SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "unknown": 1}

RATING_BANDS = ((80, "Excellent"), (60, "Good"), (40, "Fair"), (20, "Poor"))
LOWEST_RATING = "Very Poor"

BEST_PRACTICES = {
    "python": (
        "Use list comprehensions instead of map/filter when possible",
        "Follow PEP 8 style guide",
        "Use context managers (with statements) for file operations",
        "Prefer f-strings for string formatting in Python 3.6+",
        "Use virtual environments for project dependencies",
        "Use type hints for better code readability and tool support",
    ),
    "javascript": (
        "Use const and let instead of var",
        "Use === instead of ==",
        "Use promises or async/await for asynchronous operations",
        "Use destructuring for cleaner code",
        "Use template literals instead of string concatenation",
        "Use ESLint to enforce code style",
    ),
    "java": (
        "Follow the Java naming conventions",
        "Use try-with-resources for resource management",
        "Prefer StringBuilder over String concatenation in loops",
        "Use the @Override annotation when overriding methods",
        "Use generics for type safety",
    ),
}

REQUIREMENT_FILES = ("requirements.txt", "requirements.in", "pyproject.toml")
IGNORED_ADVISORIES = ("41002", "39462")

MAX_FILE_LINES = 100_000
LONG_LINE_CHARS = 100
WINDOW_LINES = 5
WINDOW_MIN_CHARS = 100
SNIPPET_CHARS = 300
CONTEXT_CHARS = 100
MATCH_CHARS = 80
TOP_TOKENS = 50
SAMPLE_LINES = 150
MAX_PARAMETERS = 5
MAX_FUNCTION_LINES = 50
MAX_COMPLEXITY = 10
MAX_NESTING = 4

# Recommendations in their order: name, topic, text.
RECOMMENDATIONS = (
    ("style", "style", "Enforce a consistent code style across the project"),
    ("linter", "style", "Consider using a linter or automated formatter"),
    ("security", "security", "Conduct a thorough security review and consider automated security scanning"),
    ("documentation", "project", "Improve code documentation - current comment density is too low"),
    ("debt", "project", "Allocate time to address technical debt (estimated at %s days)"),
    ("refactoring", "project", "Consider a significant refactoring effort to improve maintainability"),
    ("report_index", "report", "Improve overall code maintainability (score is low)."),
    ("report_density", "report", "Increase code documentation (comment density is low)."),
    ("report_security", "report", "Address detected security vulnerabilities."),
    ("report_issues", "report", "Prioritize fixing the high number of detected code issues."),
    ("report_clean", "report", "Code looks relatively clean based on available metrics!"),
)
OTHER_SMELL_ADVICE = "Address %d instances of '%s'"
SMELL_ADVICE = {
    "long_function": "Refactor %d long functions by breaking them into smaller, more focused methods",
    "too_many_parameters": "Reduce parameter count in %d functions by using parameter objects or restructuring",
    "deep_nesting": "Fix %d instances of deep nesting by extracting methods or using early returns",
    "duplicate_code": "Eliminate %d duplicated code blocks by creating reusable functions",
}
TYPE_ADVICE = {
    "sql_injection": "Use parameterized statements or ORM instead of string concatenation for SQL queries",
    "xss": "Sanitize output and use safer DOM manipulation methods instead of innerHTML",
    "hardcoded_credentials": "Move hardcoded credentials to environment variables or a secure credential store",
    "nested_loops": "Optimize nested loops to reduce algorithmic complexity",
    "inefficient_loop": "Replace inefficient loop patterns with more optimized approaches",
}


@dataclass(frozen=True)
class Limits:
    """From where on a recommendation is made."""

    style: int = 10
    security: int = 3
    density: float = 0.1
    debt_days: float = 10
    index: float = 59.5
    issues: int = 50
    ratings: tuple[str, ...] = ("Poor", "Very Poor")


LIMITS = Limits()
# ------------------------------------------------------------ end fixed values

# Own choices: how many are too many, and numbers that explain themselves.
MAX_CONDITION_OPERATORS = 3
MAX_GLOBALS = 5
PLAIN_NUMBERS = ("0", "1", "2", "10", "100", "0.0", "1.0")
