"""Key paths against Python's parsers; each guarded setting with a hit and a twin that is none."""

import configparser
import json
import random
import tomllib

import pytest
from pyspark.sql import functions as F

from provark.sources import settings as st


def leaves(x, keys=()):
    if isinstance(x, dict):
        for k, v in x.items():
            yield from leaves(v, (*keys, str(k)))
    elif isinstance(x, list):
        for v in x:
            yield from leaves(v, keys)
    else:
        yield ".".join(keys), x


def tree(rnd, depth=3, lists=True):
    out = {}
    for _ in range(rnd.randrange(1, 4)):
        key = "k" + str(rnd.randrange(100))
        kind = rnd.choice(["leaf", "leaf", "map", "list"] if depth and lists else ["leaf", "map"] if depth else ["leaf"])
        out[key] = tree(rnd, depth - 1, lists) if kind == "map" else [f"v{rnd.randrange(9)}" for _ in range(rnd.randrange(1, 3))] if kind == "list" else f"v{rnd.randrange(1000)}"
    return out


def yaml_of(x, rnd, pad=""):
    out = []
    for k, v in x.items():
        if rnd.random() < 0.2:
            out += [pad + "# note: 1", ""]
        if isinstance(v, dict):
            out += [f"{pad}{k}:", yaml_of(v, rnd, pad + rnd.choice(["  ", "    "]))]
        elif isinstance(v, list):
            inner = pad + rnd.choice(["", "  "])
            out += [f"{pad}{k}:", *[f"{inner}- {i}" for i in v]]
        else:
            out.append(f"{pad}{k}: " + rnd.choice([v, f'"{v}"', f"{v}  # why"]))
    return "\n".join(out)


def found(path, text):
    return [(r[2], r[5]) for r in st.settings_of(path, text) if r[5]]


def test_key_paths_of_random_trees():
    rnd = random.Random(4)
    for _ in range(200):
        x = tree(rnd)
        assert found("a.yaml", yaml_of(x, rnd)) == list(leaves(x))
        text = json.dumps(x, indent=rnd.choice([None, 2]))
        assert [(k, json.loads(f'"{v}"')) for k, v in found("a.json", text)] == list(leaves(x))
        flat = {f"s{i}": {k: v for k, v in tree(rnd, 0).items()} for i in range(3)}
        toml = "\n".join(f"[{s}]\n" + "\n".join(f'{k} = "{v}" # c' for k, v in own.items()) for s, own in flat.items())
        assert found("a.toml", toml) == list(leaves(tomllib.loads(toml)))
        ini = toml.replace('"', "").replace(" # c", "")
        parsed = configparser.ConfigParser()
        parsed.read_string(ini)
        assert found("a.ini", ini) == [(f"{s}.{k}", v) for s in parsed.sections() for k, v in parsed[s].items()]


def test_lists_of_maps_and_lines():
    text = "services:\n  web:\n    privileged: true\n    ports:\n      - \"8080:80\"\n    env:\n    - name: A\n      value: x\n    - name: B\nother: 1\n"
    rows = [(r[1], r[2], r[5]) for r in st.settings_of("docker-compose.yml", text) if r[5]]
    assert rows == [(3, "services.web.privileged", "true"), (5, "services.web.ports", "8080:80"), (7, "services.web.env.name", "A"), (8, "services.web.env.value", "x"), (9, "services.web.env.name", "B"), (10, "other", "1")]


TWINS = [
    ("debug_enabled", "config.yaml", "app:\n  debug: true", "app:\n  debug: false\n  debug_level: 1"),
    ("debug_enabled", "settings.toml", "[app]\ndebug = 1", "[debug]\nx = 1"),
    ("bind_all_interfaces", "config.ini", "[server]\nbind = 0.0.0.0:80", "[server]\nnetmask = 0.0.0.0"),
    ("bind_all_interfaces", "config.yaml", "host:\n  value: '*'", "glob: '*'"),
    ("tls_verification_disabled", "config.json", '{"tls": {"rejectUnauthorized": false}}', '{"tls": {"rejectUnauthorized": true}}'),
    ("tls_verification_disabled", ".env", "NODE_TLS_REJECT_UNAUTHORIZED=0", "NODE_TLS_REJECT_UNAUTHORIZED=1"),
    ("permissive_cors", "config.yaml", "cors:\n  allow_origins:\n    - \"*\"", "cors:\n  allow_origins:\n    - https://a.b"),
    ("permissive_cors", "config.toml", 'allow-origins = ["*"]', 'allow-methods = ["*"]'),
    ("secret_literal", "config.yaml", "db:\n  password: \"hunter2hunter2\"", "db:\n  password: \"changeme-please\""),
    ("secret_literal", "config.json", '{"api_key": "abcdefgh1234"}', '{"api_key": "${API_KEY_OF_ENV}", "keyboard": "abcdefgh1234"}'),
    ("auth_disabled", "config.yaml", "auth_required: no", "auth_required: yes"),
    ("container_runs_as_root", "Dockerfile", "FROM a\nUSER root", "FROM a\nUSER app"),
    ("privileged_container", "docker-compose.yml", "services:\n  a:\n    privileged: true", "services:\n  a:\n    privileged: false"),
]


@pytest.mark.parametrize(("name", "path", "hit", "twin"), TWINS)
def test_guarded_settings(spark, name, path, hit, twin):
    files = spark.createDataFrame([(f"a/{path}", hit), (f"b/{path}", twin), (f"c/{path}", None)], "path string, text string")
    assert [(r.id, r.path) for r in st.guarded(st.settings(files)).collect()] == [(name, f"a/{path}")]


def test_roles(spark):
    roles = {".env.local": "environment", "x/Dockerfile.dev": "container", "k8s/a.yaml": "orchestration", "src/db.toml": "database", "package.json": "dependency_manifest", "a/b/c/yarn.lock": "lockfile", "a/b/c/data.json": None, "a/app-server.yaml": "generic", "tests/x.json": None, "x.json": "generic", "docs/config.md": None, "requirements.txt": "dependency_manifest", "src/settings.py": "application", "a/b/logging.conf": "generic", "nginx.conf": "webserver", "main.py": None}
    df = spark.createDataFrame([(p,) for p in roles], "path string")
    assert {r.path: r.role for r in df.select("path", st.config_role(F.col("path")).alias("role")).collect()} == roles


def test_units_permissions_and_candidates(spark):
    files = spark.createDataFrame([("Dockerfile", "FROM a\nEXPOSE 8080\n"), ("x/Dockerfile", "FROM a\nUSER app\nCMD serve 0.0.0.0\n"), ("Procfile", "web: run --port=5000\n"), ("run.sh", "chmod 777 /x\necho\nchown a b\n"), ("note.md", "chmod 1"), ("config.yaml", "debug: on\n")], "path string, text string")
    assert {r.path: (r.kind, r.signals) for r in st.deployment_units(files).collect()} == {"Dockerfile": ("container_image", ["container may run as root", "exposes port 8080"]), "x/Dockerfile": ("container_image", ["binds all interfaces"]), "Procfile": ("process_manifest", ["exposes port 5000"])}
    got = sorted((r.rule_id, r.location, r.cwe, r.confidence) for r in st.config_candidates(files).collect())
    assert got == [
        ("config.debug_enabled", "config.yaml:1", "CWE-489", 0.75), ("config.permission_change", "run.sh:1", "", 0.45), ("config.permission_change", "run.sh:3", "", 0.45),
        ("deployment.container_image", "Dockerfile:1", "", 0.6), ("deployment.container_image", "Dockerfile:1", "", 0.6), ("deployment.container_image", "x/Dockerfile:1", "", 0.6), ("deployment.process_manifest", "Procfile:1", "", 0.6),
    ]
    assert st.config_candidates(files.filter("false")).collect() == []


def test_repeated_lines_are_read_once():
    """a line of YAML that comes again is not matched again; a long one is not kept."""
    from provark.sources import settings

    assert settings._keyed("  - a b: 1 # x") is settings._keyed("  - a b: 1 # x")
    assert settings._keyed("  - a b: 1 # x") == (2, "- ", "a b", "1 # x")
    long = "k: " + "v" * 5000
    assert settings._keyed(long) is not settings._keyed(long)
