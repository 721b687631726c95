"""Configuration by key path: YAML by indentation, INI and TOML by sections, JSON by its structure, others line by line.

A setting has the path of keys that leads to it, so what a value means is read from its keys and not from the whole line."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provark.sources.readers import ports
from provark.sources.taint import again

#: Fixed value: larger files are data, not configuration.
MOST_BYTES = 400_000
#: The roles of files by name, the first that fits.
ROLES = (
    (r"(^|/)\.env(\.|$)", "environment"),
    (r"(^|/)docker-compose[^/]*\.ya?ml$", "orchestration"),
    (r"(^|/)Dockerfile", "container"),
    (r"(^|/)\.github/workflows/", "ci"),
    (r"(^|/)(\.gitlab-ci\.ya?ml|\.circleci/|azure-pipelines\.ya?ml|Jenkinsfile)", "ci"),
    (r"(^|/)(k8s|kubernetes|helm|charts)/", "orchestration"),
    (r"(^|/)(nginx|httpd|apache)[^/]*\.conf$", "webserver"),
    (r"(^|/)(alembic\.ini|migrations?/env\.py|knexfile\.\w+|ormconfig\.\w+)$", "database"),
    (r"(^|/)(database|db)\.(ya?ml|json|toml|ini)$", "database"),
    (r"(^|/)(auth|authentication|oauth|keycloak)[^/]*\.(ya?ml|json|toml|ini)$", "authentication"),
    (r"(^|/)(routes?|urls?)\.(py|js|ts|ya?ml|json)$", "routing"),
    (r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.ya?ml|poetry\.lock|uv\.lock|Cargo\.lock|Gemfile\.lock|composer\.lock)$", "lockfile"),
    (r"(^|/)(package\.json|pyproject\.toml|requirements[^/]*\.txt|Cargo\.toml|go\.mod|Gemfile|pom\.xml|build\.gradle|composer\.json)$", "dependency_manifest"),
    (r"(^|/)(next|nuxt|vite|webpack|rollup|tsconfig|babel|tailwind|jest|vitest)\.?[^/]*\.(json|js|ts|mjs|cjs)$", "framework"),
    (r"(^|/)(Makefile|CMakeLists\.txt|build\.sh|meson\.build)$", "build"),
    (r"(^|/)(settings|config|application)[^/]*\.(py|ya?ml|json|toml|ini|cfg|properties)$", "application"),
)
#: Other files that may be configuration by suffix, if named so or near the root, and folders of data and tests.
SUFFIXES = r"\.(json|yaml|yml|toml|ini|cfg|conf|env|properties|xml)$"
NAMED = "config|settings|conf|options|env|profile|manifest|policy|rules|schema|app|server|service|logging|secrets"
DATA = "corpus|fixtures|fixture|testdata|test-data|__fixtures__|snapshots|__snapshots__|golden|seeds|samples|mocks|__mocks__|locales|i18n|translations|test|tests|spec|specs|__tests__"
PROSE = r"(?i)\.(md|rst|txt|adoc)$"
#: What is no real credential, and lines that change permissions.
PLACEHOLDER = r"(?i)(change[-_]?me|your[-_]|example|placeholder|xxx+|\.\.\.|<[^>]+>|dummy|sample|redacted)"
PERMISSION = r"(?i)\b(chmod|chown|setuid|setgid|umask|setfacl)\b"
#: Class and severity of settings as candidates; others are of no class and low.
RISKS = {"debug_enabled": ("CWE-489", "medium"), "bind_all_interfaces": ("CWE-1327", "medium")}
SETTING = "path string, line int, keys string, key string, raw string, value string, snippet string"


def config_role(path: Column) -> Column:
    """What a file configures; null for what is no configuration: prose, data, tests and deep files of no such name."""
    role = F.when(path.rlike(PROSE) & ~path.rlike(r"(^|/)(requirements[^/]*|CMakeLists)\.txt$"), F.lit(None).cast("string"))
    for pattern, name in ROLES:
        role = role.when(path.rlike(pattern), name)
    inner = path.rlike(rf"(?i)(^|/)({DATA})/")
    named = path.rlike(rf"(?i)(^|/)(\.[^/]*|[^/]*({NAMED})[^/]*)\.[^./]+$") | path.rlike(r"(^|/)\.[^/]+$")
    shallow = F.size(F.split(path, "/")) <= 2
    return role.when(path.rlike("(?i)" + SUFFIXES) & ~inner & (named | shallow), "generic")


@again
def _plain(raw: str) -> str:
    text = raw.strip().rstrip(",").strip()
    if len(text) > 1 and text[0] in "\"'" and text[0] in text[1:]:
        return text[1 : text.index(text[0], 1)]
    return re.split(r"\s+[#;]", text, maxsplit=1)[0].strip()


@again
def _keyed(line: str) -> tuple[int, str, str | None, str]:
    """Indent, dashes, key and value of a line of YAML."""
    m = _KEYED.match(line)
    return len(m[1]), m[2], m[4], m[5]


_KEYED = re.compile(r"^(\s*)((?:-\s+)*)(?:([\"']?)([\w.\-/$@ ]+?)\3\s*:(?=\s|$)\s*)?(.*)$")


def _indented(lines: list[str]) -> Iterator[tuple[int, list[str], str]]:
    """Keys by indentation; an item of a list belongs to the key above it."""
    open_: list[tuple[int, str]] = []
    for n, line in enumerate(lines, 1):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        indent, dashes, key, value = _keyed(line)
        at = indent + len(dashes)
        # an item may stand right under its key
        open_ = [o for o in open_ if o[0] < indent or (dashes and o[0] == indent)]
        if key is not None:
            open_.append((at, key.strip()))
        yield n, [k for _, k in open_], value


def _sectioned(lines: list[str]) -> Iterator[tuple[int, list[str], str]]:
    section: list[str] = []
    for n, line in enumerate(lines, 1):
        text = line.strip()
        if not text or text[0] in "#;" or text.startswith("//"):
            continue
        if m := re.match(r"^\[\[?([^\]]+)\]\]?\s*([#;].*)?$", text):
            section = [p.strip("\"' ") for p in m[1].split(".")]
        elif m := re.match(r"^(?:export\s+)?[\"']?([\w.\-]+)[\"']?\s*[:=]\s*(.*)$", text):
            yield n, [*section, *m[1].split(".")], m[2]
        else:
            yield n, section, text


def _structured(text: str, lines: list[str]) -> Iterator[tuple[int, list[str], str]]:
    """Every scalar of a JSON text; its line is the first, from the last one on, that has its key."""
    at = 0

    def walk(x: Any, keys: list[str]) -> Iterator[tuple[list[str], Any]]:
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(v, [*keys, str(k)])
        elif isinstance(x, list):
            for v in x:
                yield from walk(v, keys)
        else:
            yield keys, x

    for keys, value in walk(json.loads(text), []):
        want = json.dumps(keys[-1]) if keys else ""
        found = next((i for i in range(at, len(lines)) if want in lines[i]), at)
        at = found
        yield found + 1, keys, json.dumps(value)


def _instructions(lines: list[str]) -> Iterator[tuple[int, list[str], str]]:
    for n, line in enumerate(lines, 1):
        text = line.strip()
        if text and not text.startswith(("#", "//", ";")):
            m = re.match(r"^([\w.\-]+)\s*[:=]\s*(.*)$", text) or re.match(r"^(\S+)\s*(.*)$", text)
            yield n, [m[1]], m[2]


def settings_of(path: str, text: str) -> list[tuple]:
    """Rows of SETTING of one file; JSON that does not parse is read by indentation."""
    lines, name = text.splitlines(), path.rsplit("/", 1)[-1].lower()
    try:
        rows = list(_structured(text, lines)) if name.endswith(".json") else None
    except (ValueError, RecursionError):
        rows = None
    if rows is None:
        if name.endswith((".yml", ".yaml", ".json")):
            rows = list(_indented(lines))
        elif name.endswith((".toml", ".ini", ".cfg", ".properties")) or name.startswith(".env") or name.endswith(".env"):
            rows = list(_sectioned(lines))
        else:
            rows = list(_instructions(lines))
    return [(path, n, ".".join(keys), keys[-1] if keys else "", raw, _plain(raw), (lines[n - 1] if n <= len(lines) else "").strip()[:200]) for n, keys, raw in rows]


def settings(files: DataFrame) -> DataFrame:
    """path, line, keys (the key path), key, raw, value, snippet of the settings of files (path, text): those with a role
    but lock files, up to MOST_BYTES. Null texts have none. Values keep their quotes in raw only."""
    role = config_role(F.col("path"))
    own = files.filter(role.isNotNull() & (role != "lockfile") & F.col("text").isNotNull() & (F.octet_length("text") <= MOST_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SETTING.split(", ")]
        for b in batches:
            rows = [r for p, t in zip(b["path"].to_pylist(), b["text"].to_pylist(), strict=True) for r in settings_of(p, t)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            types = [pa.string(), pa.int32(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return own.select("path", "text").mapInArrow(run, SETTING)


def guarded(rows: DataFrame) -> DataFrame:
    """id, path, line, keys, snippet of the eight settings that bear on security, of rows of `settings`.

    A value is judged with its keys: an address that binds everything counts under a key of hosts, a literal credential
    only where it is quoted, eight letters long and no placeholder."""
    key, keys, value = F.lower("key"), F.lower("keys"), F.lower("value")
    off, on = value.rlike("^(false|0|no|off)$"), value.rlike("^(true|1|yes|on)$")
    literal = F.col("raw").rlike(r"""^\s*["'][^"'\s{}$]{8,}["']""")
    rules = {
        "debug_enabled": key.rlike(r"\bdebug$") & on,
        "bind_all_interfaces": F.col("value").rlike(r"""(^|[\s"'=/@])(0\.0\.0\.0|\[?::\]?|\*)(:\d+)?($|[\s"';,])""") & F.concat_ws(" ", keys, F.lower("snippet")).rlike("host|bind|listen|addr"),
        "tls_verification_disabled": (key.rlike(r"^(verify|rejectunauthorized)$") & (value == "false")) | ((key == "node_tls_reject_unauthorized") & value.startswith("0")) | ((key == "insecure_skip_verify") & (value == "true")),
        "permissive_cors": (key.rlike(r"allow[_-]?origins?$") & F.col("value").rlike(r"""^\[?\s*["']?\*""")) | (keys.rlike(r"access-control-allow-origin$") & F.col("value").startswith("*")),
        "secret_literal": key.rlike(r"\b(secret|password|passwd|api[_-]?key|token|private[_-]?key)$") & literal & ~F.col("snippet").rlike(PLACEHOLDER) & ~F.col("value").rlike(PLACEHOLDER),
        "auth_disabled": key.rlike(r"(auth(entication)?[_-]?(required|enabled)|require[_-]?auth)$") & off & (value != "off"),
        "container_runs_as_root": (key == "user") & (value == "root") & ~F.col("snippet").rlike("[:=]"),
        "privileged_container": (key == "privileged") & (value == "true"),
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return rows.select(F.explode(hits).alias("id"), "path", "line", "keys", "snippet")


def deployment_units(files: DataFrame) -> DataFrame:
    """path, kind, signals of what is deployed: images, compose stacks, process lists and build scripts; that a container
    may run as root (it says so, or an image says nothing), each port, and that everything is bound."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.when(name.startswith("Dockerfile"), "container_image").when(name.startswith("docker-compose"), "compose_stack").when(name == "Procfile", "process_manifest").when(name.isin("Makefile", "build.sh"), "build_script")
    text = F.coalesce("text", F.lit(""))
    root = text.rlike(r"(?m)^\s*USER\s+root\b") | (name.startswith("Dockerfile") & ~text.rlike(r"(?m)^\s*USER\s"))
    bound = text.rlike(r"""(^|[\s"'=])0\.0\.0\.0\b""")
    signals = F.concat(F.array_compact(F.array(F.when(root, "container may run as root"))), F.transform(ports(text), lambda p: F.concat(F.lit("exposes port "), p.cast("string"))), F.array_compact(F.array(F.when(bound, "binds all interfaces"))))
    return files.withColumn("kind", kind).filter("kind is not null").select("path", "kind", signals.alias("signals"))


def permissions(files: DataFrame) -> DataFrame:
    """path, line, snippet of lines that change permissions, outside of prose."""
    lines = files.filter(~F.col("path").rlike(PROSE)).select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)).alias("at", "content"))
    return lines.filter(F.col("content").rlike(PERMISSION)).select("path", (F.col("at") + 1).alias("line"), F.substring(F.trim("content"), 1, 200).alias("snippet"))


def config_candidates(files: DataFrame, most_permissions: int = 10) -> DataFrame:
    """Candidates of channel `config`: guarded settings (.75; read at every start, so .9 reachable), signals of deployment
    units (.6) and the first ten permission changes (.45; the report's bound, by path and line). None has a plan, as none
    can be shown by running it, and each says why."""
    none = "no execution tells this setting's states apart"

    def told(rows: DataFrame, location: Column, rule: Column, cwe: Column, severity: Column, reach: float, sure: float, radius: float, reason: str, said: Column) -> DataFrame:
        scores = (F.lit(x).alias(c) for x, c in ((reach, "reachability"), (sure, "confidence"), (radius, "blast_radius")))
        return rows.select(F.lit("config").alias("channel"), location.alias("location"), rule.alias("rule_id"), cwe.alias("cwe"), severity.alias("severity"), *scores, F.lit(False).alias("has_plan"), F.lit(reason).alias("reason"), said.alias("description"))

    of = lambda i, default: F.coalesce(F.create_map(*[F.lit(x) for k, v in RISKS.items() for x in (k, v[i])])[F.col("id")], F.lit(default))
    at = lambda line: F.concat_ws(":", "path", line.cast("string"))
    hits = told(guarded(settings(files)), at(F.col("line")), F.concat(F.lit("config."), F.col("id")), of(0, ""), of(1, "low"), 0.9, 0.75, 0.35, none, F.col("snippet"))
    units = deployment_units(files).select("path", "kind", F.explode("signals").alias("signal"))
    units = told(units, at(F.lit(1)), F.concat(F.lit("deployment."), F.col("kind")), F.lit(""), F.lit("low"), 0.5, 0.6, 0.4, "the target runs without its container", F.col("signal"))
    changed = permissions(files).orderBy("path", "line").limit(most_permissions)
    changed = told(changed, at(F.col("line")), F.lit("config.permission_change"), F.lit(""), F.lit("low"), 0.4, 0.45, 0.3, "permissions are not observed", F.col("snippet"))
    return hits.unionByName(units).unionByName(changed)
