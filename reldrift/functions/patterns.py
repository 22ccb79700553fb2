"""Fixed values that decide results: patterns, word lists, suffix lists.

Everything here is a constant of the problem, not a tuning choice.  Patterns are
written for java.util.regex; ASCII classes are spelled out because the Java
shorthands differ from the ASCII-only dialect whose matches must be reproduced
(``\\s`` would add vertical tab, ``\\b`` is Unicode-aware).
"""

# --- token patterns -------------------------------------------------------
WHITESPACE = r"\t\n\f\r "

# http(s) URL up to whitespace, a quote, a backtick or a closing parenthesis
URL_TOKEN = r"https?://[^" + WHITESPACE + r"\"'`)]+"

# risky words, matched as whole ASCII words
RISKY_WORDS = ("child_process", "subprocess", "os/exec", "socket", "eval", "vm", "net")
# the first-letter test only saves the look-behind at most positions
RISKY_WORD_TOKEN = (
    "(?=[" + "".join(sorted({w[0] for w in RISKY_WORDS})) + "])"
    r"(?<![0-9A-Za-z_])(?:" + "|".join(RISKY_WORDS) + r")(?![0-9A-Za-z_])"
)

# double-quoted literal of at least 20 characters on one line
LITERAL_TOKEN = r'"[^"\n]{20,}+"'

# install-time hook: key and command
HOOK_TOKEN = r'(?iu)"(?:pre|post)?install"[' + WHITESPACE + r']*:[' + WHITESPACE + r']*"[^"]*+"'

# a hook that the end of a text breaks off
HOOK_TAIL = r'(?iu)"(?:pre|post)?install"[' + WHITESPACE + r']*+(?::[' + WHITESPACE + r']*+(?:"[^"]*+)?)?\z'

# --- comment removal (group 1 is the text that stays) ----------------------
_DOUBLE_QUOTED = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\\?\z)'
_SINGLE_QUOTED = r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+(?:'|\\?\z)"
_BACKTICKED = r"`[^`]*+(?:`|\z)"
_CHAR_LITERAL = r"'(?:\\[\x00-\x7F]|[\x00-\x5B\x5D-\x7F])'"

C_STYLE_COMMENTS = (
    "(" + _CHAR_LITERAL + "|" + _DOUBLE_QUOTED + "|" + _BACKTICKED + ")"
    r"|//[^\n]*+"
    r"|/\*[\s\S]*?(?:\*/|\z)"
)
PYTHON_COMMENTS = (
    r'(?:"{3}[\s\S]*?(?:"{3}|\z)'
    r"|'{3}[\s\S]*?(?:'{3}|\z)"
    r"|#[^\n]*+)"
    "|(" + _DOUBLE_QUOTED + "|" + _SINGLE_QUOTED + ")"
)

# --- file selection --------------------------------------------------------
TEXT_EXTENSIONS = (
    "js", "ts", "jsx", "tsx", "mjs", "cjs",
    "py", "pyi",
    "go", "rs",
    "java", "kt", "scala",
    "cs",
    "json", "toml", "yaml", "yml", "xml",
    "sh", "bash", "ps1",
    "txt", "md",
)
C_STYLE_EXTENSIONS = (
    "go", "rs", "js", "ts", "jsx", "tsx", "mjs", "cjs", "java", "kt", "scala", "cs",
)
PYTHON_EXTENSIONS = ("py", "pyi")
DOCUMENT_EXTENSIONS = ("md", "rst", "txt")
DOCUMENT_NAME_PREFIXES = (
    "readme", "changelog", "changes", "history",
    "authors", "contributors", "license", "notice",
)
LOCKFILES = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml",
    "go.sum", "cargo.lock", "poetry.lock", "composer.lock", "gemfile.lock", "pipfile.lock",
)
BUNDLE_SUFFIXES = ("min.js", "min.css", "map")
SKIPPED_DIRECTORIES = ("node_modules", "vendor", "dist", "build", "docs", "doc")

# --- URL rules -------------------------------------------------------------
RESERVED_HOSTS = (
    "testserver", "localhost", "127.0.0.1", "0.0.0.0", "::1",
    "example.com", "example.org", "example.net",
)
RESERVED_TOP_LEVELS = ("localhost", "local", "invalid", "test", "example")
DOCUMENTATION_HOSTS = (
    "docs.rs", "docs.python.org", "readthedocs.io", "readthedocs.org",
    "pkg.go.dev", "godoc.org", "javadoc.io",
)
NAVIGATION_SEGMENTS = ("issues", "pull", "blob", "tree", "wiki", "commit", "discussions")
PAYLOAD_HOSTS = (
    "raw.githubusercontent.com", "gist.githubusercontent.com", "gist.github.com", "pastebin.com",
)
PAYLOAD_EXTENSIONS = ("sh", "ps1", "exe", "bin", "dll", "scr")
RAW_IP_URL = r"https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"

# --- entropy ---------------------------------------------------------------
# a run is any stretch of bytes >= 0x2B ('+'); control bytes, space and !"#$%&'()* end it
ENCODED_RUN = r"[^\x00-\x2A]+"
MIN_RUN_BYTES = 24
ENTROPY_THRESHOLD = 5.0

# --- signals ---------------------------------------------------------------
# token kind -> (order, signal kind, description, weight)
SIGNALS = {
    "url": (1, "new_outbound_url", "Package version introduced new network destination(s)", 2),
    "import": (2, "new_dangerous_import",
               "Package version introduced imports granting code execution or network access", 3),
    "literal": (3, "high_entropy_string",
                "Package version introduced high-entropy string(s) consistent with encoded payloads", 3),
    "hook": (4, "new_install_hook", "Package version added install-time execution hook", 3),
}
URL_PAYLOAD_WEIGHT = 4

# summed weight -> severity: the first bound that is not exceeded decides
SEVERITY_BOUNDS = ((0, 0), (2, 1), (4, 2), (6, 3))
MAX_SEVERITY = 4
SEVERITY_LABELS = {4: "CRITICAL", 3: "HIGH", 2: "MEDIUM", 1: "LOW"}

ECOSYSTEMS = ("npm", "pypi", "go", "cargo", "maven", "nuget")

# --- artifact addresses ----------------------------------------------------
CARGO_BASE = "https://crates.io"
GO_BASE = "https://proxy.golang.org"
MAVEN_BASE = "https://repo1.maven.org/maven2"
NUGET_BASE = "https://api.nuget.org/v3-flatcontainer"

# --- limits ----------------------------------------------------------------
LIST_SIZE = 1000
RECENT_FINDINGS = (50, 200)   # default, largest accepted
RECENT_ACTIVITY = (30, 100)
