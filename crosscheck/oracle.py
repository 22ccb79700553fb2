"""DuckDB statements with the same results as the registered queries.

Written from the rules, not from the Spark plans: patterns are in the RE2 dialect,
the previous release is a plain ``lag`` and the difference a ``NOT EXISTS``.
"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


# --- derived tables ------------------------------------------------------------

_ECO = """CASE {0} % 6 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'go'
      WHEN 3 THEN 'cargo' WHEN 4 THEN 'maven' ELSE 'nuget' END"""

RELEASES = f"""releases AS (
  SELECT {_ECO.format('o_custkey')} AS ecosystem, concat('pkg-', CAST(o_custkey AS VARCHAR)) AS name,
         o_orderkey AS release_seq, concat('1.', CAST(o_orderkey AS VARCHAR)) AS version,
         CAST(o_orderkey AS VARCHAR) AS k
  FROM orders)"""

FILES = """release_files AS (
  SELECT r.ecosystem, r.name, r.release_seq, r.version, f.file_ord,
   CASE f.file_ord WHEN 0 THEN 'src/index.js' WHEN 1 THEN 'pkg/mod.py' WHEN 2 THEN 'package.json'
        WHEN 3 THEN 'README.md' ELSE 'dist/app.js' END AS path,
   CASE f.file_ord
    WHEN 0 THEN concat('const v = 1', chr(10), '// see https://c', k, '.lurk.zone/x', chr(10),
      CASE WHEN release_seq % 3 = 0 THEN concat('let kit = "https://kit', CAST(release_seq % 7 AS VARCHAR), '.parcels.zone/kit.js";', chr(10)) ELSE '' END,
      CASE WHEN release_seq % 11 = 0 THEN concat('send("http://198.51.100.', CAST(release_seq % 250 AS VARCHAR), '/in")', chr(10)) ELSE '' END,
      CASE WHEN release_seq % 5 = 0 THEN concat('var w = require("worker_threads"), r = require("child_process")', chr(10)) ELSE '' END,
      CASE WHEN release_seq % 7 = 0 THEN concat('let raw = "', to_base64(unhex(concat(sha256(k), substring(sha256(concat('x', k)), 1, 48)))), '"', chr(10)) ELSE '' END)
    WHEN 1 THEN concat('# https://doc.lurk.zone/', chr(10),
      CASE WHEN release_seq % 13 = 0 THEN concat('import socket', chr(10)) ELSE '' END,
      'home = "https://example.com/"', chr(10))
    WHEN 2 THEN concat('{"repository": "https://github.com/o/r.git"',
      CASE WHEN release_seq % 17 = 0 THEN concat(', "preinstall": "sh p', k, '.sh"') ELSE '' END, '}')
    ELSE 'see https://skipped.lurk.zone/a' END AS content
  FROM releases r, (VALUES (0), (1), (2), (3), (4)) f(file_ord))"""

_SCANNABLE = r"""regexp_matches(lower(path), '\.(js|ts|jsx|tsx|mjs|cjs|py|pyi|go|rs|java|kt|scala|cs|json|toml|yaml|yml|xml|sh|bash|ps1)$')
   AND NOT regexp_matches(lower(path), '\.(min\.js|min\.css|map)$')
   AND NOT regexp_matches(concat('/', lower(path)), '/(node_modules|vendor|dist|build|docs|doc)/')
   AND NOT regexp_matches(lower(path), '(^|[/\\])(readme|changelog|changes|history|authors|contributors|license|notice)[^/\\]*$')
   AND regexp_extract(lower(path), '[^/\\]*$') NOT IN ('package-lock.json', 'npm-shrinkwrap.json', 'yarn.lock', 'pnpm-lock.yaml', 'go.sum',
     'cargo.lock', 'poetry.lock', 'composer.lock', 'gemfile.lock', 'pipfile.lock')"""
_TEXT = r"""regexp_matches(lower(path), '\.(js|ts|jsx|tsx|mjs|cjs|py|pyi|go|rs|java|kt|scala|cs|json|toml|yaml|yml|xml|sh|bash|ps1|txt|md)$')"""
_LANGUAGE = r"""CASE WHEN regexp_matches(lower(path), '\.(go|rs|js|ts|jsx|tsx|mjs|cjs|java|kt|scala|cs)$') THEN 'c'
   WHEN regexp_matches(lower(path), '\.pyi?$') THEN 'python' ELSE 'other' END"""

_DOUBLE = r'"[^"\\]*(?:\\(?s:.)[^"\\]*)*(?:"|\\?\z)'
_SINGLE = _DOUBLE.replace('"', "''")
_C = r"(''(?:\\[\x00-\x7F]|[\x00-\x5B\x5D-\x7F])''|" + _DOUBLE + r"|`[^`]*(?:`|\z))|//[^\n]*|/\*(?s:.)*?(?:\*/|\z)"
_PY = r"""(?:"{3}(?s:.)*?(?:"{3}|\z)|'{3}(?s:.)*?(?:'{3}|\z)|#[^\n]*)""".replace("'", "''") + f"|({_DOUBLE}|{_SINGLE})"

STRIPPED = rf"""stripped AS (
  SELECT ecosystem, name, release_seq, version, file_ord, path,
   CASE {_LANGUAGE} WHEN 'c' THEN regexp_replace(content, '{_C}', '\1', 'g')
     WHEN 'python' THEN regexp_replace(content, '{_PY}', '\1', 'g') ELSE content END AS content
  FROM release_files WHERE {_SCANNABLE})"""

_PATTERNS = {
    "url": r"""https?://[^\t\n\f\r "''`)]+""",
    "import": r"\b(?:child_process|subprocess|os/exec|socket|eval|vm|net)\b",
    "literal": r'"[^"\n]{20,}"',
    "hook": r'(?i)"(?:pre|post)?install"[\t\n\f\r ]*:[\t\n\f\r ]*"[^"]*"',
}


def _token_rows(kind: str, source: str, keys: str, text: str) -> str:
    """Tokens of one kind with their place; risky words once per text, at their first place."""
    rows = (
        f"SELECT {keys}, u.p AS pos, u.t AS token FROM (SELECT {keys}, "
        f"unnest(list_transform(regexp_extract_all({text}, '{_PATTERNS[kind]}'), "
        f"lambda x, i: {{'t': x, 'p': CAST(i - 1 AS INTEGER)}})) AS u FROM {source})"
    )
    if kind != "import":
        return rows
    return (
        f"SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1 AS INTEGER) AS pos, token "
        f"FROM (SELECT {keys}, token, min(pos) AS pos FROM ({rows}) GROUP BY {keys}, token)"
    )


_RELEASE_KEYS = "ecosystem, name, release_seq, version, file_ord"

TOKENS = "tokens AS (" + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, * FROM ({_token_rows(kind, 'stripped', _RELEASE_KEYS, 'content')})" for kind in _PATTERNS
) + ")"

# --- rules on single tokens -------------------------------------------------------

_RUNS = r"regexp_extract_all({0}, '[^\x00-\x2A]+')"
_RUN = (
    "CASE WHEN len(" + _RUNS + ") = 0 THEN '' ELSE list_reduce(" + _RUNS
    + ", lambda a, b: CASE WHEN strlen(b) > strlen(a) THEN b ELSE a END) END"
)
_ENTROPY = """CASE WHEN strlen({0}) = 0 THEN 0.0 ELSE list_sum(list_transform(
    map_values(histogram_of_{1}), lambda n: -(n / strlen({0})) * log2(n / strlen({0})))) END"""


def _entropy_cte(name: str, source: str, key: str, text: str) -> str:
    """Character counts grouped per text, then the entropy sum: no shared trick with the Spark fold."""
    return f"""{name} AS (
  SELECT {key}, round(sum(-(n / bytes) * log2(n / bytes)), 9) AS entropy FROM (
    SELECT {key}, c, count(*)::DOUBLE AS n, max(bytes)::DOUBLE AS bytes FROM (
      SELECT {key}, unnest(string_split({text}, '')) AS c, strlen({text}) AS bytes FROM {source})
    GROUP BY {key}, c) GROUP BY {key})"""


# URL host, step by step
_AUTHORITY = r"regexp_extract({0}, '^https?://([^/?#]*)', 1)"
_BAD_PERCENT = r"%([^0-9A-Fa-f]|[0-9A-Fa-f]([^0-9A-Fa-f]|\z)|\z)"


def _host_ctes(source: str, column: str) -> list[str]:
    return [
        rf"""url_parts AS (
  SELECT {column} AS url, regexp_extract({column}, '^([^#]*)', 1) AS bare,
    regexp_extract({column}, '#((?s:.)*)', 1) AS fragment,
    regexp_extract({column}, '^https?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract({column}, '^https?://([^/?#]*)', 1) AS authority
  FROM (SELECT DISTINCT {column} FROM {source}))""",
        r"""url_hosts AS (
  SELECT *, regexp_extract(authority, '^((?s:.)*)@', 1) AS userinfo,
    regexp_extract(authority, '([^@]*)$', 1) AS hostport FROM url_parts)""",
        rf"""url_host AS (
  SELECT url, CASE WHEN NOT regexp_matches(bare, '[\x00-\x1F\x7F]')
      AND NOT regexp_matches(path, '{_BAD_PERCENT}') AND NOT regexp_matches(fragment, '{_BAD_PERCENT}')
      AND NOT regexp_matches(userinfo, '{_BAD_PERCENT}')
      AND regexp_full_match(userinfo, '[A-Za-z0-9\-._:~!$&''()*+,;=%@]*')
      AND regexp_full_match(regexp_replace(regexp_replace(hostport, ':[0-9]*$', ''), '%(25|[89A-Fa-f][0-9A-Fa-f])', '', 'g'),
            '[A-Za-z0-9\-._~!$&''()*+,;=<>"\[\]:\x{{80}}-\x{{10FFFF}}]*')
      AND CASE WHEN hostport LIKE '[%' THEN regexp_matches(hostport, '\](:[0-9]*)?$')
          ELSE NOT contains(hostport, ':') OR regexp_matches(hostport, ':[0-9]*$') END
    THEN lower(CASE WHEN hostport LIKE '[%' THEN regexp_extract(hostport, '^\[((?s:.)*)\](:[0-9]*)?$', 1)
         ELSE regexp_replace(hostport, ':[0-9]*$', '') END) END AS host
  FROM url_hosts)""",
        r"""url_rules AS (
  SELECT url, host, is_reserved, is_doc,
    is_reserved OR is_doc OR regexp_matches(url, '[{}#]') OR url LIKE '%.git'
      OR regexp_matches(url, '/(issues|pull|blob|tree|wiki|commit|discussions)/') AS is_noise,
    regexp_matches(lower(url), 'raw\.githubusercontent\.com|gist\.githubusercontent\.com|gist\.github\.com|pastebin\.com')
      OR regexp_matches(lower(url), '\.(sh|ps1|exe|bin|dll|scr)\z') AS is_payload,
    regexp_matches(url, 'https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') AS is_raw_ip
  FROM (SELECT url, host,
    coalesce(host IN ('testserver', 'localhost', '127.0.0.1', '0.0.0.0', '::1', 'example.com', 'example.org', 'example.net')
      OR regexp_matches(host, '\.(localhost|local|invalid|test|example)$'), false) AS is_reserved,
    coalesce(regexp_matches(host, '(^|\.)(docs\.rs|docs\.python\.org|readthedocs\.io|readthedocs\.org|pkg\.go\.dev|godoc\.org|javadoc\.io)$'), false) AS is_doc
    FROM url_host))""",
    ]


_LITERAL_CTES = [
    "literals AS (SELECT DISTINCT token FROM tokens WHERE kind = 'literal' AND NOT contains(token, chr(0)))",
    f"literal_runs AS (SELECT token, {_RUN.format('token')} AS run FROM literals)",
    _entropy_cte("literal_entropy", "literal_runs", "token", "run"),
    """suspicious AS (SELECT token FROM literal_runs JOIN literal_entropy USING (token)
  WHERE strlen(run) >= 24 AND entropy > 5.0)""",
]

PAIRS = """pairs AS (
  SELECT * FROM (SELECT ecosystem, name, version,
    lag(version) OVER (PARTITION BY ecosystem, name ORDER BY release_seq) AS prev_version, release_seq
  FROM releases) WHERE prev_version IS NOT NULL)"""

ADDED = """added AS (
  SELECT p.ecosystem, p.name, p.version, p.prev_version, t.kind, t.file_ord, t.pos, t.token
  FROM pairs p JOIN tokens t USING (ecosystem, name, version)
  WHERE NOT EXISTS (SELECT 1 FROM tokens o WHERE o.ecosystem = p.ecosystem AND o.name = p.name
    AND o.version = p.prev_version AND o.kind = t.kind AND o.token = t.token))"""

KEPT = """evidence AS (
  SELECT a.*, CASE WHEN kind = 'url' THEN CASE WHEN r.is_payload OR r.is_raw_ip THEN 4 ELSE 2 END ELSE 3 END AS weight,
    CASE kind WHEN 'url' THEN 1 WHEN 'import' THEN 2 WHEN 'literal' THEN 3 ELSE 4 END AS kind_ord
  FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, name, version, prev_version, kind, token
               ORDER BY file_ord, pos) AS nth FROM added) a
  LEFT JOIN url_rules r ON a.kind = 'url' AND a.token = r.url
  WHERE (kind <> 'import' OR nth = 1) AND (kind <> 'url' OR NOT r.is_noise)
    AND (kind <> 'literal' OR token IN (SELECT token FROM suspicious)))"""

SIGNALS = """signals AS (
  SELECT ecosystem, name, version, prev_version, kind_ord,
    CASE kind_ord WHEN 1 THEN 'new_outbound_url' WHEN 2 THEN 'new_dangerous_import'
      WHEN 3 THEN 'high_entropy_string' ELSE 'new_install_hook' END AS kind,
    CASE kind_ord WHEN 1 THEN 'Package version introduced new network destination(s)'
      WHEN 2 THEN 'Package version introduced imports granting code execution or network access'
      WHEN 3 THEN 'Package version introduced high-entropy string(s) consistent with encoded payloads'
      ELSE 'Package version added install-time execution hook' END AS description,
    string_agg(token, chr(10) ORDER BY file_ord, pos) AS evidence,
    string_agg(token, ', ' ORDER BY file_ord, pos) AS evidence_comma, list(token ORDER BY file_ord, pos) AS evidence_list,
    CAST(max(weight) AS INTEGER) AS weight
  FROM evidence GROUP BY ALL)"""

SEVERITY = """findings AS (
  SELECT *, CAST(CASE WHEN total_weight = 0 THEN 0 WHEN total_weight <= 2 THEN 1 WHEN total_weight <= 4 THEN 2
      WHEN total_weight <= 6 THEN 3 ELSE 4 END AS INTEGER) AS severity,
    CASE WHEN total_weight = 0 THEN 'NONE' WHEN total_weight <= 2 THEN 'LOW' WHEN total_weight <= 4 THEN 'MEDIUM'
      WHEN total_weight <= 6 THEN 'HIGH' ELSE 'CRITICAL' END AS label,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(substring(version, 3) AS BIGINT)) AS analyzed_at
  FROM (SELECT ecosystem, name, version, prev_version, count(*) AS signal_count,
      CAST(sum(weight) AS BIGINT) AS total_weight, string_agg(kind, ',' ORDER BY kind_ord) AS kinds,
      string_agg(evidence, chr(10) ORDER BY kind_ord) AS evidence,
      string_agg(concat(kind, ': ', description, ' (', evidence_comma, '). '), '' ORDER BY kind_ord) AS sentences,
      list({'kind': kind, 'description': description, 'evidence': evidence_list, 'weight': weight} ORDER BY kind_ord) AS documents
    FROM signals GROUP BY ecosystem, name, version, prev_version))"""

_DIFF = [
    RELEASES, FILES, STRIPPED, TOKENS,
    *_host_ctes("(SELECT token FROM tokens WHERE kind = 'url')", "token"),
    *_LITERAL_CTES, PAIRS, ADDED, KEPT, SIGNALS, SEVERITY,
]
_PAIR = "ecosystem, name, version, prev_version"
_FLAT = f"SELECT {_PAIR}, severity, signal_count, total_weight, kinds, evidence FROM "


def _diff(select: str) -> str:
    return _with(*_DIFF, select=select)


# --- poll log -------------------------------------------------------------------------

POLLS = """polls AS (SELECT 'npm' AS ecosystem, CAST(user_id AS VARCHAR) AS name, event_type AS latest,
    ts AS polled_at, event_id FROM events)"""
SEEN = """seen AS (SELECT *, lag(latest) OVER (PARTITION BY ecosystem, name ORDER BY polled_at, event_id) AS prev_version FROM polls)"""
_CHANGES = """SELECT ecosystem, name, latest AS version, prev_version, epoch_us(polled_at) AS polled_us, event_id
  FROM seen WHERE latest <> prev_version"""
WATCHED = """watched AS (SELECT ecosystem, name, latest AS last_version, polled_at AS updated_at FROM (
    SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY polled_at DESC, event_id DESC) AS rn
    FROM seen WHERE prev_version IS NULL OR latest <> prev_version) WHERE rn = 1)"""
_CUT = "TIMESTAMP '2024-01-15 00:00:00'"
_CYCLE = [
    POLLS.replace("polls AS", "all_polls AS"),
    f"polls AS (SELECT * FROM all_polls WHERE polled_at < {_CUT})", SEEN, WATCHED,
    f"""newest AS (SELECT ecosystem, name, latest FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, name
      ORDER BY polled_at DESC, event_id DESC) AS rn FROM all_polls WHERE polled_at >= {_CUT}) WHERE rn = 1)""",
]
_LOOKUP = """SELECT n.ecosystem, n.name, n.latest, coalesce(w.last_version, '') AS last_seen
  FROM newest n LEFT JOIN watched w ON n.ecosystem = w.ecosystem AND n.name = w.name"""

# --- registry documents ------------------------------------------------------------------

REGISTRY = """docs AS (
  SELECT ecosystem, CASE ecosystem
      WHEN 'maven' THEN CASE WHEN release_seq % 19 = 0 THEN name ELSE concat('org.acme.', name, ':', name) END
      WHEN 'go' THEN CASE WHEN release_seq % 31 = 0 THEN concat('Example.org/', name, '/Mod')
        WHEN release_seq % 37 = 0 THEN concat('example.org/', name, '/v1') ELSE concat('example.org/', upper(name), '/Mod') END
      WHEN 'nuget' THEN concat('Acme.', name) ELSE name END AS name,
    release_seq, last_seen,
    CASE WHEN release_seq % 23 = 0 THEN '{"broken' ELSE CASE ecosystem
      WHEN 'npm' THEN concat('{"dist-tags":{"latest":"', shown, '"},"versions":{',
        CASE WHEN release_seq % 5 = 0 THEN '' ELSE concat('"', prev, '":{"dist":{"tarball":"https://reg.io/', name, '-', prev, '.tgz"}},') END,
        '"', version, '":{"dist":{"tarball":"https://reg.io/', name, '-', version, '.tgz"}}}}')
      WHEN 'pypi' THEN concat('{"info":{"version":"', shown, '"},"releases":{"', prev, '":[',
        CASE WHEN release_seq % 5 = 0 THEN '' ELSE concat('{"url":"https://files.io/', prev, '.whl","packagetype":"bdist_wheel"}') END,
        '],"', version, '":[{"url":"https://files.io/', version, '.whl","packagetype":"bdist_wheel"},{"url":"https://files.io/', version,
        '.tar.gz","packagetype":"', CASE WHEN release_seq % 7 = 0 THEN 'bdist_egg' ELSE 'sdist' END, '"}]}}')
      WHEN 'cargo' THEN concat('{"crate":{"newest_version":"', shown, '"},"versions":[{"num":"', version,
        '","dl_path":"/api/v1/crates/', name, '/', version, '/download"}',
        CASE WHEN release_seq % 5 = 0 THEN '' ELSE concat(',{"num":"', prev, '","dl_path":"/api/v1/crates/', name, '/', prev, '/download"}') END, ']}')
      WHEN 'maven' THEN CASE WHEN release_seq % 29 = 0 THEN '{"response":{"docs":[]}}'
        ELSE concat('{"response":{"docs":[{"v":"', version, '"},{"v":"', prev, '"}]}}') END
      WHEN 'go' THEN concat('{"Version":"', shown, CASE WHEN shown = '' THEN '' ELSE '+incompatible' END, '"}')
      ELSE CASE WHEN release_seq % 29 = 0 THEN '{"versions":[]}'
        ELSE concat('{"versions":["', prev, '","', version, '-RC"]}') END END END AS body
  FROM (SELECT *, CASE WHEN last_seen = '' THEN '0.0' ELSE last_seen END AS prev,
      CASE WHEN release_seq % 29 = 0 THEN '' ELSE version END AS shown
    FROM (SELECT *, coalesce(lag(version) OVER (PARTITION BY ecosystem, name ORDER BY release_seq), '') AS last_seen FROM releases)))"""
PARSED = """parsed AS (
  SELECT *, CASE WHEN json_valid(body) THEN CASE ecosystem
      WHEN 'npm' THEN json_extract_string(body, '$."dist-tags".latest')
      WHEN 'pypi' THEN json_extract_string(body, '$.info.version')
      WHEN 'cargo' THEN json_extract_string(body, '$.crate.newest_version')
      WHEN 'maven' THEN json_extract_string(body, '$.response.docs[0].v')
      WHEN 'go' THEN json_extract_string(body, '$.Version')
      ELSE json_extract_string(body, '$.versions[#-1]') END END AS latest,
    (ecosystem = 'maven' AND NOT contains(name, ':')) OR (ecosystem = 'go'
      AND (NOT regexp_matches(name, '^[a-z0-9.-]+(/[-._~A-Za-z0-9]+)*$') OR regexp_matches(name, '/v[01]$'))) AS bad_coordinate
  FROM docs)"""


def _artifact(version: str) -> str:
    return f"""coalesce(CASE ecosystem
    WHEN 'npm' THEN json_extract_string(body, concat('$.versions."', {version}, '".dist.tarball'))
    WHEN 'pypi' THEN coalesce(
      list_filter(CAST(json_extract(body, concat('$.releases."', {version}, '"')) AS STRUCT(url VARCHAR, packagetype VARCHAR)[]),
        lambda f: f.packagetype = 'sdist')[1].url,
      CAST(json_extract(body, concat('$.releases."', {version}, '"')) AS STRUCT(url VARCHAR, packagetype VARCHAR)[])[1].url)
    WHEN 'cargo' THEN concat('https://crates.io', nullif(list_filter(
      CAST(json_extract(body, '$.versions') AS STRUCT(num VARCHAR, dl_path VARCHAR)[]), lambda v: v.num = {version})[1].dl_path, ''))
    WHEN 'maven' THEN concat('https://repo1.maven.org/maven2/', replace(split_part(name, ':', 1), '.', '/'), '/', split_part(name, ':', 2),
      '/', {version}, '/', split_part(name, ':', 2), '-', {version}, '.jar')
    WHEN 'go' THEN concat('https://proxy.golang.org/', lower(regexp_replace(name, '([A-Z])', '!\\1', 'g')), '/@v/', {version}, '.zip')
    ELSE concat('https://api.nuget.org/v3-flatcontainer/', lower(name), '/', lower({version}), '/', lower(name), '.', lower({version}), '.nupkg')
    END, '')"""


_RESOLVED = f"""resolved AS (
  SELECT ecosystem, name, latest AS version, {_artifact('latest')} AS source_url,
    last_seen AS prev_version, {_artifact('last_seen')} AS prev_source_url
  FROM (SELECT * FROM parsed WHERE NOT bad_coordinate AND latest <> '' AND latest <> last_seen AND last_seen <> ''))"""
# concat skips NULL, so a missing crate entry must be told apart from an empty path
_RESOLVED = _RESOLVED.replace(
    "concat('https://crates.io', nullif(", "('https://crates.io' || ("
).replace("[1].dl_path, ''))", "[1].dl_path))")

# --- landed archives and whole cycles --------------------------------------------------------

_FATES = """fates AS (SELECT release_seq, CASE WHEN release_seq % 31 = 2 THEN 'void' WHEN release_seq % 29 = 7 THEN 'unknown'
    WHEN release_seq % 23 = 5 THEN 'missing' WHEN release_seq % 19 = 3 THEN 'damaged' ELSE 'sound' END AS fate FROM releases)"""
_CYCLES = [
    RELEASES.replace("releases AS", "all_releases AS"),
    "releases AS (SELECT 'npm' AS ecosystem, * EXCLUDE (ecosystem) FROM all_releases)", _FATES, FILES,
    STRIPPED.replace("WHERE ", "JOIN fates USING (release_seq) WHERE fate = 'sound' AND ", 1),
    TOKENS, *_host_ctes("(SELECT token FROM tokens WHERE kind = 'url')", "token"), *_LITERAL_CTES,
    """aged AS (SELECT * FROM (SELECT name, version, release_seq, fate, row_number() OVER (PARTITION BY name ORDER BY release_seq DESC) AS age
    FROM releases JOIN fates USING (release_seq)) WHERE age <= 3)""",
    """compared AS (SELECT 'npm' AS ecosystem, n.name, n.version, p.version AS prev_version, n.release_seq, 4 - n.age AS cycle, n.fate, p.fate AS prev_fate
    FROM aged n JOIN aged p ON n.name = p.name AND p.age = n.age + 1)""",
    "pairs AS (SELECT * FROM compared WHERE fate <> 'damaged' AND prev_fate <> 'damaged')",
    ADDED, KEPT, SIGNALS, SEVERITY,
    """tried AS (SELECT DISTINCT name, version, fate, cycle FROM (SELECT name, version, fate, cycle FROM compared
    UNION ALL SELECT name, prev_version, prev_fate, cycle FROM compared) WHERE fate NOT IN ('missing', 'void'))""",
    """opened AS (SELECT t.* FROM tried t WHERE NOT EXISTS (SELECT 1 FROM tried e
    WHERE e.name = t.name AND e.version = t.version AND e.cycle < t.cycle AND e.fate <> 'damaged'))""",
]
_CYCLE_STATE = """
SELECT 'opened' AS part, concat('land://', name, '@', version) AS item, CAST(cycle AS VARCHAR) AS cycle,
  CASE fate WHEN 'sound' THEN 'ok' WHEN 'damaged' THEN 'error' ELSE 'empty' END AS detail FROM opened
UNION ALL SELECT 'rejected', concat('land://', name, '@', version), CAST(cycle AS VARCHAR),
  CASE fate WHEN 'damaged' THEN 'damaged archive' ELSE 'unknown format' END FROM opened WHERE fate <> 'sound'
UNION ALL SELECT 'finding', concat(f.name, '@', f.version), CAST(p.cycle AS VARCHAR), concat(CAST(severity AS VARCHAR), chr(10), f.prev_version, chr(10), evidence)
  FROM findings f JOIN pairs p USING (name, version)
UNION ALL SELECT 'scanned', concat(name, '@', version), CAST(cycle AS VARCHAR), prev_version FROM pairs
UNION ALL SELECT 'watched', name, '3', version FROM aged WHERE age = 1
UNION ALL SELECT 'evidence', kind, '', CAST(count(*) AS VARCHAR) FROM evidence GROUP BY kind
UNION ALL SELECT 'statistics', '', '', concat((SELECT count(DISTINCT name) FROM aged), ',', (SELECT count(*) FROM pairs), ',', (SELECT count(*) FROM findings))"""

# --- ranking --------------------------------------------------------------------------------

_TOP = f"""SELECT ecosystem, CAST(rank AS INTEGER) AS rank, name FROM (
  SELECT ecosystem, name, row_number() OVER (PARTITION BY ecosystem ORDER BY place) AS rank FROM (
    SELECT ecosystem, name, min(place) AS place FROM (
      SELECT {_ECO.format('p_partkey')} AS ecosystem, p_name AS name,
        row_number() OVER (ORDER BY n DESC, p_partkey) AS place
      FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)
    WHERE name <> '' GROUP BY ecosystem, name)) WHERE rank <= 1000"""

_FEED = """SELECT concat('[', label, '] ', ecosystem, '/', name, ' ', version, ' (was ', prev_version, ') — ',
    CAST(signal_count AS VARCHAR), ' signal(s)') AS title, 'https://feed.invalid' AS link,
  trim(concat('Severity: ', label, '. ', sentences)) AS description, ecosystem AS category,
  strftime(analyzed_at, '%a, %d %b %Y %H:%M:%S +0000') AS pub_date,
  concat('tag:feed.invalid,2026:', ecosystem, '/', name, '@', version, ':', CAST(CAST(epoch(analyzed_at) AS BIGINT) AS VARCHAR)) AS guid FROM """
_NEWEST = f"(SELECT * FROM findings ORDER BY analyzed_at DESC, {_PAIR} LIMIT 50)"


_BROKEN_TEXTS = [
    """concat('{"a": 1, "preinstall": "x', k, '"', CASE release_seq % 4 WHEN 0 THEN concat(', "postinstall": "sh ', k)
       WHEN 1 THEN ', "install" : ' WHEN 2 THEN ', "install"' ELSE '}' END)""",
    """CASE release_seq % 5 WHEN 0 THEN 'no quote here' WHEN 1 THEN ': "b' WHEN 2 THEN '"install": "c", "preinstall": "d'
       WHEN 3 THEN concat('go on" "install": "', k) ELSE '' END""",
    """CASE release_seq % 3 WHEN 0 THEN 'end", "preinstall": "e"' WHEN 1 THEN '"install": "f' ELSE ' "g" }' END""",
    """CASE release_seq % 2 WHEN 0 THEN '" "install":"h"' ELSE 'nothing' END""",
]


def _release_tokens(kind: str) -> str:
    return _with(
        RELEASES, FILES, STRIPPED,
        select=_token_rows(kind, "stripped", "release_seq, file_ord", "content"),
    )


def _signals(kind_ord: int) -> str:
    return _diff(f"SELECT {_PAIR}, kind, description, evidence, weight FROM signals WHERE kind_ord = {kind_ord}")


ORACLE = {
    "scannable_files": _with(RELEASES, FILES, select=f"""SELECT release_seq, file_ord, path,
  {_TEXT} AS is_text, {_SCANNABLE} AS is_scannable, {_LANGUAGE} AS language FROM release_files"""),
    "strip_comments": _with(RELEASES, FILES, STRIPPED, select="SELECT release_seq, file_ord, content AS stripped FROM stripped"),
    "release_text": _with(RELEASES, FILES, STRIPPED, select="""SELECT ecosystem, name, version,
  string_agg(concat(content, chr(10)), '' ORDER BY file_ord) AS text FROM stripped GROUP BY ecosystem, name, version"""),
    "nul_literals": _with(RELEASES, """tokens AS (SELECT release_seq, 'literal' AS kind, concat('"', to_base64(unhex(concat(sha256(version),
    substring(sha256(concat('x', version)), 1, 48)))), CASE WHEN release_seq % 3 = 0 THEN chr(0) ELSE '' END, '"') AS token FROM releases)""",
        *_LITERAL_CTES, select="SELECT release_seq, strlen(token) AS bytes, token IN (SELECT token FROM suspicious) AS signals FROM tokens"),
    "split_hooks": _with(RELEASES, f"""texts AS (SELECT version, concat({", chr(10), ".join(_BROKEN_TEXTS)}, chr(10)) AS text FROM releases)""",
        select=f"""SELECT version, CAST(u.p AS INTEGER) AS place, u.t AS token FROM (SELECT version, unnest(list_transform(
  regexp_extract_all(text, '{_PATTERNS["hook"]}'), lambda x, i: {{'t': x, 'p': i}})) AS u FROM texts)"""),
    "url_tokens": _release_tokens("url"),
    "import_tokens": _release_tokens("import"),
    "literal_tokens": _release_tokens("literal"),
    "hook_tokens": _release_tokens("hook"),
    "page_tokens": " UNION ALL ".join(
        f"SELECT page_id, '{kind}' AS kind, pos, token FROM ({_token_rows(kind, 'pages', 'page_id', 'html')})" for kind in _PATTERNS
    ),
    "url_classify": _with(
        RELEASES, FILES, STRIPPED, TOKENS,
        *_host_ctes("(SELECT token FROM tokens WHERE kind = 'url' UNION SELECT url FROM pages)", "token"),
        select="SELECT url, host, is_reserved, is_doc, is_noise, is_payload, is_raw_ip FROM url_rules",
    ),
    "string_entropy": _with(
        f"runs AS (SELECT doc_id, text, {_RUN.format('text')} AS run FROM documents)",
        _entropy_cte("run_entropies", "runs", "doc_id", "run"),
        _entropy_cte("text_entropies", "runs", "doc_id", "text"),
        select="""SELECT doc_id, strlen(run) AS run_bytes, md5(run) AS run_md5, coalesce(r.entropy, 0.0) AS run_entropy,
  coalesce(t.entropy, 0.0) AS text_entropy, strlen(run) >= 24 AND coalesce(r.entropy, 0.0) > 5.0 AS is_high
  FROM runs LEFT JOIN run_entropies r USING (doc_id) LEFT JOIN text_entropies t USING (doc_id)""",
    ),
    "high_entropy_literals": _with(
        RELEASES, FILES, STRIPPED, TOKENS, *_LITERAL_CTES,
        select="SELECT release_seq, file_ord, pos, token FROM tokens WHERE kind = 'literal' AND token IN (SELECT token FROM suspicious)",
    ),
    "release_pairs": _with(RELEASES, PAIRS, select="SELECT * FROM pairs"),
    "new_urls": _signals(1),
    "new_imports": _signals(2),
    "new_high_entropy": _signals(3),
    "new_hooks": _signals(4),
    "signals": _diff(f"SELECT {_PAIR}, kind, description, evidence, weight FROM signals"),
    "findings": _diff(_FLAT + "findings"),
    "evidence": _diff(f"SELECT {_PAIR}, kind, file_ord, pos, token FROM evidence"),
    "severity_score": _diff(f"SELECT {_PAIR}, signal_count AS signals, total_weight, severity, label FROM findings"),
    "version_changes": _with(POLLS, SEEN, select=_CHANGES),
    "first_seen": _with(POLLS, SEEN, select="""SELECT ecosystem, name, latest AS version, epoch_us(polled_at) AS polled_us, event_id
  FROM seen WHERE prev_version IS NULL"""),
    "watched_versions": _with(POLLS, SEEN, WATCHED, select="SELECT ecosystem, name, last_version, epoch_us(updated_at) AS updated_us FROM watched"),
    "last_seen_lookup": _with(*_CYCLE, select=_LOOKUP),
    "changed_since_last_seen": _with(*_CYCLE, select=f"SELECT * FROM ({_LOOKUP}) WHERE latest <> last_seen AND last_seen <> ''"),
    "watched_upsert": _with(*_CYCLE, select="""SELECT coalesce(w.ecosystem, n.ecosystem) AS ecosystem, coalesce(w.name, n.name) AS name,
  CASE WHEN n.latest IS DISTINCT FROM w.last_version AND n.latest IS NOT NULL THEN n.latest ELSE w.last_version END AS last_version,
  epoch_us(CASE WHEN n.latest IS DISTINCT FROM w.last_version AND n.latest IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE w.updated_at END) AS updated_us
  FROM watched w FULL JOIN newest n ON w.ecosystem = n.ecosystem AND w.name = n.name"""),
    "watchlist_restrict": _with(POLLS, select="""SELECT ecosystem, name, latest, event_id FROM polls
  WHERE name IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')"""),
    "registry_latest": _with(RELEASES, REGISTRY, PARSED, select="""SELECT ecosystem, name, release_seq, last_seen, latest FROM parsed
  WHERE NOT bad_coordinate AND latest <> ''"""),
    "rejected_documents": _with(RELEASES, REGISTRY, PARSED, select="""SELECT ecosystem, name, release_seq,
  CASE WHEN bad_coordinate THEN 'bad coordinate' WHEN NOT json_valid(body) THEN 'malformed document' ELSE 'no latest version' END AS reason
  FROM parsed WHERE bad_coordinate OR coalesce(latest, '') = ''"""),
    "artifact_lookup": _with(RELEASES, REGISTRY, PARSED, _RESOLVED, select="SELECT * FROM resolved WHERE ecosystem IN ('npm', 'pypi', 'cargo')"),
    "detect_changes": _with(RELEASES, REGISTRY, """newest_docs AS (SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY release_seq DESC) AS place FROM docs) WHERE place = 1)""",
        PARSED.replace("FROM docs)", "FROM newest_docs)"), _RESOLVED, select="SELECT * FROM resolved"),
    "artifact_urls": _with(RELEASES, REGISTRY, PARSED, _RESOLVED, select="SELECT * FROM resolved"),
    "recent_findings": _diff(_FLAT + _NEWEST),
    "recent_activity": _with(POLLS, SEEN, WATCHED, select="""SELECT ecosystem, name, last_version AS version FROM watched
  ORDER BY updated_at DESC, ecosystem, name LIMIT 30"""),
    "scan_stats": _with(*_DIFF, POLLS, SEEN, WATCHED, select="""SELECT (SELECT count(*) FROM watched) AS packages_watched,
  (SELECT count(*) FROM pairs) AS versions_scanned, (SELECT count(*) FROM findings) AS findings_total"""),
    "feed_items": _diff(_FEED + "findings"),
    "newest_feed": _diff(_FEED + _NEWEST),
    "findings_json": _diff(f"""SELECT {_PAIR}, CAST(to_json({{'package': {{'ecosystem': ecosystem, 'name': name, 'version': version, 'source_url': ''}},
  'prev_version': prev_version, 'signals': documents, 'severity': severity, 'analyzed_at': strftime(analyzed_at, '%Y-%m-%dT%H:%M:%SZ')}}) AS VARCHAR) AS json FROM findings"""),
    "signals_json_roundtrip": _diff(_FLAT + "findings"),
    "top_names": _TOP,
    "allowlist_roundtrip": _TOP,
    "allowlist_scan": f"SELECT * FROM ({_TOP}) WHERE ecosystem <> 'nuget'",
    "archive_scan": _with(RELEASES, FILES, _FATES, select=f"""SELECT concat('land://', name, '@', version) AS source_url,
  CASE fate WHEN 'sound' THEN 'ok' WHEN 'damaged' THEN 'error' ELSE 'empty' END AS archive_status,
  CASE WHEN fate = 'sound' THEN file_ord END AS file_ord, CASE WHEN fate = 'sound' THEN path END AS path, CASE WHEN fate = 'sound' THEN content END AS content
  FROM release_files JOIN fates USING (release_seq) WHERE fate NOT IN ('missing', 'void') AND {_SCANNABLE} AND (fate = 'sound' OR file_ord = 0)"""),
    "run_cycle": _with(*_CYCLES, select=_CYCLE_STATE),
    "archive_files": _with(RELEASES, FILES, select=f"SELECT ecosystem, name, version, file_ord, path, content FROM release_files WHERE {_SCANNABLE}"),
    "stored_findings": _diff(_FLAT + "findings"),
    "recent_stored_findings": _diff(_FLAT + _NEWEST),
    "stored_scan_log": _with(RELEASES, PAIRS, select="SELECT ecosystem, count(*) AS versions_scanned FROM pairs GROUP BY ecosystem"),
    "stream_version_changes": _with(POLLS, SEEN, select=_CHANGES),
    "stream_changes_in_batches": _with(POLLS, SEEN, select=_CHANGES),
    "stream_last_seen": _with(POLLS, SEEN, WATCHED, select="SELECT ecosystem, name, last_version, epoch_us(updated_at) AS updated_us FROM watched"),
    "stream_changes_stateful": _with(POLLS, SEEN, select=_CHANGES),
    "stream_findings": _diff(_FLAT + "findings"),
}
