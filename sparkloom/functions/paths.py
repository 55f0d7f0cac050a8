"""Which paths are source files, what language they are in, what they are called as modules; redaction of secrets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that are skipped, languages by extension, extensions of binary files.
IGNORED = (
    "node_modules", "vendor", "dist", "build", ".venv", "venv", "__pycache__", "generated", "migrations",
    ".git", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".tox", ".idea", ".vscode", "target", "site-packages",
)
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "rs": "rust",
}
BINARY = (
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "svg", "pdf", "zip", "gz", "tar", "tgz", "bz2", "7z", "rar",
    "so", "dylib", "dll", "a", "o", "class", "jar", "pyc", "pyd", "exe", "bin", "wasm", "woff", "woff2", "ttf", "eot",
    "mp3", "mp4", "mov", "avi", "wav", "ogg", "webp", "parquet", "pkl", "pt", "onnx", "npy", "npz", "db", "sqlite",
)
SECRET_FILE = r"(^|/)(\.env(\.[a-z]+)?|id_(rsa|dsa|ed25519)|[^/]*\.(pem|key|p12|pfx|keystore)|credentials(\.json)?|\.netrc|\.pgpass)$"
#: Label -> pattern of what redact() takes out. Of an assigned literal the name and the quotes (groups 1 and 2) stay, so that code still parses.
SECRETS = {
    "assigned": "(?i)((?:password|passwd|secret|token|api_?key)[ ]*[=:][ ]*[\"'])[^\"'\\n]{6,}([\"'])",
    "aws_key": "AKIA[0-9A-Z]{16}",
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer": "[Bb]earer [A-Za-z0-9_.-]{16,}",
    "hub_token": "gh[pousr]_[A-Za-z0-9]{30,}",
}


def redacted_as(label: str, mark: str = "$") -> str:
    """The replacement for what a label's pattern matches, in a dialect whose groups are named by `mark`."""
    note = f"[REDACTED:{label}]"
    return f"{mark}1{note}{mark}2" if label == "assigned" else note


def extension(path: Column) -> Column:
    """What follows the last dot of the path, in lower case; null without a dot."""
    return F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1)))


def language_of(path: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), F.coalesce(extension(path), F.lit("")))


def is_binary(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*BINARY), F.lit(False))


def in_ignored_dir(path: Column, extra: Sequence[str] = ()) -> Column:
    """Whether a folder of the path is one to skip, or an extra fragment is a folder of it or a part of it."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    out = F.arrays_overlap(dirs, F.array(*map(F.lit, IGNORED)))
    for frag in filter(None, extra):
        out = out | F.array_contains(dirs, frag.strip("/")) | path.contains(frag)
    return out


def is_secret_file(path: Column) -> Column:
    return F.lower(path).rlike(SECRET_FILE)


def should_index(path: Column, extra: Sequence[str] = ()) -> Column:
    return ~in_ignored_dir(path, extra) & ~is_secret_file(path) & ~is_binary(path) & language_of(path).isNotNull()


def module_name(path: Column) -> Column:
    """The dotted name of a path: without extension and trailing __init__; `root` if nothing is left."""
    bare = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\.[^.]*$", "")
    parts = F.filter(F.split(bare, "/", -1), lambda x: x != "")
    parts = F.when(F.element_at(F.concat(F.array(F.lit("")), parts), -1) == "__init__", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.coalesce(F.nullif(F.array_join(parts, "."), F.lit("")), F.lit("root"))


def redact(text: Column) -> tuple[Column, Column, Column]:
    """(text, how many, labels): each secret replaced by a marker with its label."""
    out, count, labels = text, F.lit(0), []
    for label, pattern in SECRETS.items():
        count = count + F.regexp_count(out, F.lit(pattern))
        labels.append(F.when(F.regexp_count(out, F.lit(pattern)) > 0, F.lit(label)))
        out = F.regexp_replace(out, pattern, redacted_as(label))
    return out, count.cast("long"), F.array_compact(F.array(*labels))


def is_test_symbol(name: Column, path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.lower(name).startswith("test") | p.contains("/tests/") | p.startswith("tests/") | F.substring_index(p, "/", -1).startswith("test_")
