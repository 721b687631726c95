"""What built-in expressions cannot say, in batches: signatures, canonical JSON, diffs."""

from __future__ import annotations

import difflib
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fields that differ from run to run and are taken out before a comparison.
VOLATILE = {"timestamp", "duration", "duration_ms", "elapsed", "request_id", "trace_id", "pid"}


def canonical(value) -> str:
    """Sorted keys, compact separators, UTF-8 kept, sets as sorted lists."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=lambda s: sorted(s) if isinstance(s, (set, frozenset)) else str(s))


def _without(value, names):
    if isinstance(value, dict):
        return {k: _without(v, names) for k, v in value.items() if k not in names}
    return [_without(v, names) for v in value] if isinstance(value, list) else value


def _of_json(text: str | None, change) -> str | None:
    try:
        return None if text is None else canonical(change(json.loads(text)))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """The canonical form of JSON texts; null for what is none."""
    return texts.map(lambda t: _of_json(t, lambda v: v))


@F.pandas_udf(StringType())
def without_volatile(texts: pd.Series) -> pd.Series:
    """Canonical JSON without volatile fields at any depth."""
    return texts.map(lambda t: _of_json(t, lambda v: _without(v, VOLATILE)))


def hmac_sha256(key: bytes):
    """text column -> signature: two SHA-256 over the key's fixed pads, as the standard composes them."""
    own = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda by: F.lit(bytearray(b ^ by for b in own))

    def sign(text) -> Column:
        inner = F.sha2(F.concat(pad(0x36), F.encode(text, "UTF-8")), 256)
        return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)

    return sign


def hmac_verify(key: bytes):
    """(text, signature) columns -> whether the signature is the text's; false where either is null."""
    return lambda text, signature: F.coalesce(hmac_sha256(key)(text) == (F.col(signature) if isinstance(signature, str) else signature), F.lit(False))


@F.udf(StringType(), useArrow=False)
def unified_diff(before: str | None, after: str | None) -> str:
    """Diffs of texts, null as empty; a last line without an end is marked as such. Whole texts go by the hundred, not by
    batches of Arrow: a batch is counted in rows, so its bytes would follow the texts."""
    ended = lambda line: line if line.endswith("\n") else f"{line}\n{NO_END}\n"
    return "".join(map(ended, difflib.unified_diff(_lines(before), _lines(after), "a", "b")))


NO_END = "\\ No newline at end of file"


def _lines(text: str | None) -> list[str]:
    """Lines with their line feeds; nothing else ends one."""
    return re.findall(r"[^\n]*\n|[^\n]+", text or "")


def hunks(patch: str) -> list[tuple[int, int, list[str]]]:
    """(first old line from 0, old lines, changed and kept lines) of each hunk; a head's lengths tell where it ends."""
    out: list[tuple[int, int, list[str]]] = []
    old = new = 0
    for line in _lines(patch):
        if line.startswith("\\ ") and out and out[-1][2]:
            out[-1][2][-1] = out[-1][2][-1].removesuffix("\n")
        elif old > 0 or new > 0:
            out[-1][2].append(line)
            old -= line[:1] in "- \n"
            new -= line[:1] in "+ \n"
        elif head := re.match(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,(\d+))? @@", line):
            first, old, new = int(head[1]), int(head[2] or 1), int(head[3] or 1)
            out.append((first - (old > 0), old, []))
    return out


def apply_patch(before: str, patch: str) -> str:
    """The text after a unified diff; ValueError where a context or removed line does not match or hunks overlap."""
    source, out, at = _lines(before), [], 0
    for start, _, lines in hunks(patch):
        if start < at:
            raise ValueError("hunks overlap")
        out += source[at:start]
        at = start
        for line in lines:
            if line[:1] == "+":
                out.append(line[1:])
            elif line[:1] in "- ":
                if at >= len(source) or source[at] != line[1:]:
                    raise ValueError("the patch does not fit")
                if line[0] == " ":
                    out.append(source[at])
                at += 1
    return "".join(out + source[at:])


@F.udf(StringType(), useArrow=False)
def patched(before: str | None, patch: str | None) -> str | None:
    """Texts after their diffs; null where a diff does not fit. Rows go as in unified_diff."""
    try:
        return apply_patch(before or "", patch or "")
    except ValueError:
        return None


@F.pandas_udf(StringType())
def hunk_summary(patch: pd.Series) -> pd.Series:
    """`hunk: -removed +added` for each hunk, joined by `; `."""

    count = lambda lines, sign: sum(x[:1] == sign for x in lines)
    one = lambda text: "; ".join(f"hunk: -{count(x, '-')} +{count(x, '+')}" for _, _, x in hunks(text or ""))
    return patch.map(one)
