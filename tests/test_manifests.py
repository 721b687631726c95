"""Manifests against Python's own parsers, on generated files; ports, and files that are odd."""

import json
import random
import re
import tomllib

import pytest
from pyspark.sql import functions as F

from provark.sources import manifests, readers


def declared(spark, files):
    rows = manifests.declared(spark.createDataFrame(files, "path string, text string")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.path, r.at)):
        out.setdefault(r.path, []).append((r.name, r.version, r.dev))
    return out


def word(rnd):
    return rnd.choice("abcdefgh") + "".join(rnd.choice("abcdefgh-_0123") for _ in range(rnd.randrange(6))) + rnd.choice("xyz")


def version(rnd):
    return ".".join(str(rnd.randrange(20)) for _ in range(rnd.randrange(1, 4)))


def test_json_maps(spark):
    rnd, files, want = random.Random(1), [], {}
    for i in range(40):
        npm = i % 2
        maps = manifests.NPM if npm else manifests.COMPOSER
        data = {"name": word(rnd), "version": version(rnd), "engines": {"node": ">=18"}, "scripts": {"build": "tsc 1.0"}, "type": "module"}
        for m in maps:
            if rnd.random() < 0.6:
                data[m] = {("@s/" if npm and rnd.random() < 0.3 else "") + word(rnd): rnd.choice(["^", "~", "", "workspace:"]) + version(rnd) for _ in range(rnd.randrange(5))}
        path = f"p{i}/" + ("package.json" if npm else "composer.json")
        files.append((path, json.dumps(data, indent=rnd.choice([None, 2]))))
        want[path] = [(k, v, dev) for m, dev in maps.items() for k, v in data.get(m, {}).items()]
    files += [("bad/package.json", '{"dependencies": {"a": '), ("odd/package.json", '{"dependencies": ["a"], "devDependencies": null}'), ("none/package.json", None), ("x/package.json.txt", "{}")]
    assert declared(spark, files) == {p: w for p, w in want.items() if w}


def toml_value(rnd, name):
    v = version(rnd)
    return rnd.choice([f'"{v}"', f'{{ version = "{v}", features = ["x"] }}', f'{{ git = "https://a.b/{name}", branch = "m" }}', "{ workspace = true }"])


def test_cargo_tables(spark):
    rnd, files, want = random.Random(2), [], {}
    for i in range(40):
        parts = [f'[package]\nname = "{word(rnd)}"\nversion = "0.1"\nedition = "2021"\n']
        for header in ("dependencies", "dev-dependencies", "build-dependencies", "target.'cfg(unix)'.dependencies", "features", "profile.release"):
            if rnd.random() < 0.7:
                names = {word(rnd) for _ in range(rnd.randrange(4))}
                values = {n: toml_value(rnd, n) if "dependencies" in header else '["a"]' if header == "features" else "3" for n in names}
                parts.append(f"[{header}]\n# note = \"1\"\n" + "".join(f"{n} = {v}\n" for n, v in values.items()))
        if rnd.random() < 0.5:
            parts.append(f'[dependencies.own]\npath = "../own"\nversion = "{version(rnd)}"\noptional = true\n')
        head, rest = parts[0], parts[1:]
        text = "\n".join([head, *rest])
        path = f"c{i}/Cargo.toml"
        files.append((path, text))
        data, found = tomllib.loads(text), []
        tables = [(data.get(k, {}), k.startswith("dev")) for k in ("dependencies", "dev-dependencies", "build-dependencies")]
        tables.append((data.get("target", {}).get("cfg(unix)", {}).get("dependencies", {}), False))
        for t, dev in tables:
            found += [(n, v if isinstance(v, str) else v.get("version"), dev) for n, v in t.items()]
        want[path] = sorted(found, key=str)
    got = declared(spark, files)
    assert {p: sorted(v, key=str) for p, v in got.items()} == {p: w for p, w in want.items() if w}


def requirement(rnd):
    name = word(rnd)
    v = version(rnd)
    extra = rnd.choice(["", "", "[standard]", "[a,b]"])
    op = rnd.choice(["", "==", ">=", "~=", " >= "])
    return f"{name}{extra}{op}{v if op else ''}" + rnd.choice(["", "", '; python_version < "3.9"', ",<99" if op else ""]), (name, v if op else None)


def test_pyproject_and_requirements(spark):
    rnd, files, want = random.Random(3), [], {}
    quote = lambda x: f"'{x}'" if '"' in x else f'"{x}"'
    for i in range(40):
        own, dev = [requirement(rnd) for _ in range(rnd.randrange(5))], [requirement(rnd) for _ in range(rnd.randrange(3))]
        between = rnd.choice([", ", ",\n    ", ",  # why not\n    "])
        listed = lambda rs, b=between: "[" + b.join(quote(r) for r, _ in rs) + rnd.choice(["]", "\n]"])
        text = f'[build-system]\nrequires = ["hatchling>=1"]\n\n[project]\nname = "{word(rnd)}"\nversion = "1.0"\nclassifiers = [\n  "Private :: x",\n]\ndependencies = {listed(own)}\n\n[project.scripts]\nrun = "a:b"\n\n[project.optional-dependencies]\ntest = {listed(dev)}\n\n[tool.ruff]\nselect = ["E"]\n'
        tomllib.loads(text)
        files.append((f"q{i}/pyproject.toml", text))
        want[f"q{i}/pyproject.toml"] = [(*r, False) for _, r in own] + [(*r, True) for _, r in dev]
        lines = [rnd.choice(["", "# c\n", "-r other.txt\n", "-e .\n", "--hash=sha256:00\n", "https://a.b/c.whl\n"]) + r + rnd.choice(["", "  # why", " --hash=sha256:ab", " \\\n  --hash=sha256:cd"]) for r, _ in own]
        files.append((f"q{i}/requirements-dev.txt", "\n".join(lines)))
        want[f"q{i}/requirements-dev.txt"] = [(*r, True) for _, r in own]
    assert declared(spark, files) == {p: w for p, w in want.items() if w}


def test_other_formats(spark):
    files = [
        ("go.mod", "module a.b/c // x v1\n\ngo 1.22\nrequire one.io/a v1.2.3 // indirect\nrequire (\n\ttwo.io/b v0.1.0\n\t// gone.io/x v9.9.9\n\tthree.io/c/v2 v2.0.0-rc.1 // indirect\n)\nreplace (\n\ttwo.io/b v0.1.0 => ../b v1.0.0\n)\nexclude bad.io/z v1.0.0\n"),
        ("Gemfile", "source 'https://rubygems.org'\ngem 'rails', '~> 7.0'\n  gem \"pg\"\n# gem 'old', '1'\n"),
        ("pom.xml", "<project><artifactId>self</artifactId><version>9</version><parent><artifactId>up</artifactId></parent><!-- <dependency><artifactId>no</artifactId></dependency> --><dependencies><dependency><groupId>g</groupId>\n<artifactId> a </artifactId><version>1.0</version><exclusions><exclusion><artifactId>ex</artifactId></exclusion></exclusions></dependency><dependency><artifactId>b</artifactId><scope>test</scope></dependency></dependencies></project>"),
        ("build.gradle.kts", "plugins { id(\"x\") version \"1\" }\ndependencies {\n  implementation(\"g.h:lib:1.2\")\n  testImplementation 'j:unit:4.1'\n  api(project(\":own\"))\n  kapt(\"a:b:1\")\n}\n"),
        ("Pipfile", "[[source]]\nname = \"pypi\"\n[packages]\nflask = \"*\"\nx = {version = \"==1.0\"}\n[dev-packages]\npytest = \"*\"\n[requires]\npython_version = \"3.9\"\n"),
        ("pubspec.yaml", "name: a\nversion: 1.0\ndependencies:\n  http: ^1.1.0\n  flutter:\n    sdk: flutter\ndev_dependencies:\n  test: any # x\nflutter:\n  uses: true\n"),
        ("poetry/pyproject.toml", "[tool.poetry]\nname = \"a\"\n[tool.poetry.dependencies]\npython = \"^3.9\"\nrequests = \"^2.0\"\nx.version = \"1\"\n[tool.poetry.group.t.dependencies]\npytest = {version = \"8\", optional = true}\n"),
        ("Cargo.toml", ""),
    ]
    assert declared(spark, files) == {
        "go.mod": [("one.io/a", "v1.2.3", False), ("two.io/b", "v0.1.0", False), ("three.io/c/v2", "v2.0.0-rc.1", False)],
        "Gemfile": [("rails", "~> 7.0", False), ("pg", None, False)],
        "pom.xml": [("a", "1.0", False), ("b", None, True)],
        "build.gradle.kts": [("lib", "1.2", False), ("unit", "4.1", True)],
        "Pipfile": [("flask", "*", False), ("x", "==1.0", False), ("pytest", "*", True)],
        "pubspec.yaml": [("http", "^1.1.0", False), ("flutter", None, False), ("test", "any", True)],
        "poetry/pyproject.toml": [("requests", "^2.0", False), ("x", "1", False), ("pytest", "8", True)],
    }


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("support 1234", []),
        ("port: 8080\nPORT=99999\nport = '0'", [8080]),
        ("EXPOSE 8080\nEXPOSE 99999", [8080]),
        ('ports:\n  - "8080:80"\n  - 127.0.0.1:5432:5432/tcp\n  - 9000:9000\n', [8080, 80, 5432, 9000]),
        ("listen 443 ssl;\nlisten 127.0.0.1:81;\n", [443, 81]),
        ('{"http_port": 3000, "report": 77, "port": "3000"}', [3000]),
        ("transport: 55\nexport 66", []),
        (None, []),
    ],
)
def test_ports(spark, text, found):
    df = spark.createDataFrame([(text,)], "t string")
    assert (df.select(readers.ports(F.col("t"))).head()[0] or []) == found
    assert all(1 <= p <= 65535 for p in found) and (text is None or all(re.search(str(p), text) for p in found))


def test_a_manifest_is_named_and_parsed_once(spark, tmp_path):
    """A format is told once a file and a text parsed once, not for each dependency, map or group; repeated items count once."""
    from provark.plans import source_queries

    plan = manifests.declared(spark.createDataFrame([("a/package.json", "{}")], "path string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2 and plan.count("^go\\.mod$") == 1
    rows = [(k, n, 7, 5) for k in (4, 5, 6, 7) for n in (1, 2, 2, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = source_queries.manifest_files(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = sorted(tuple(r) for r in found.select("ecosystem", "file", "name", "version", "dev", "times").collect())
    assert got == [("crates", 5, "p7", "1.5", True, 3), ("go", 6, "x.io/p7", "v1.5.0", False, 3), ("npm", 7, "p7", "^1.5", True, 3), ("pypi", 4, "p7", "1.5", True, 3)]
